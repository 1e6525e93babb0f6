"""Dialects of text, numbers and dates, value by value."""

import pytest
from pyspark.sql import functions as F

from tidemill.functions import dates, numbers, text


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(("f", "cases"), [
    (numbers.last_separator_amount, {"1.234": 1.234, "1,234": 1.234, "1.234,56": 1234.56, "1,234.56": 1234.56, "1.234.567": None, "1,234,567": None, "EUR 12,50": 12.5, "": None, None: None, "-3,5": -3.5}),
    (numbers.comma_decimal, {"1.234": 1234.0, "1.234,56": 1234.56, "12,5": 12.5, "": None, None: None, "x": None, "1,2,3": None}),
    (numbers.quantity, {"1.600": 1600.0, "1.60": 1.6, " 12 ": 12.0, None: None}),
    (numbers.lenient_number, {"12": 12.0, " 1e3 ": 1000.0, "Infinity": None, "5d": None, "": None, None: None}),
    (dates.text_to_iso, {"1.2.2024": "2024-02-01", "01/12/24": "2024-12-01", "2024-3-5": "2024-03-05", "99.99.2024": "2024-99-99", "1.2": None, "123.1.2024": None, None: None}),
    (text.fold_key, {" IĞDIR ": "ığdır", "İstanbul": "istanbul", None: None}),
    (text.fold_header, {"Malzeme Tanımı": "malzeme tanimi", "GTİP": "gtip"}),
    (text.initials, {"Ada Yılmaz Can": "AY", "ada": "AD", "": "??", None: "??"}),
    (text.country_of_address, {"Fő utca 1, VESZPREM Hungary.": "Hungary", "x ANKARA": None, "12 ab": None, "Street 12": None, "": None, None: None}),
    (text.blank_to_null, {"  x  ": "x", " ": None, None: None}),
    (text.escape_xml, {"<a & 'b' \"c\">": "&lt;a &amp; &apos;b&apos; &quot;c&quot;&gt;"}),
    (text.escape_pattern, {"a.b*c": "a\\.b\\*c"}),
    (text.tail_ref, {"65f0a1b2c3d4e5f60718293a": "DCL-18293A", "xyz": "DCL-000"}),
    (text.transport_code, {"By Sea": "denizyolu", "Havayolu": "havayolu", "kara": "karayolu", "?": "karayolu"}),
])
def test_values(spark, f, cases):
    assert dict(zip(cases, values(spark, f, list(cases)), strict=True)) == cases


def test_repairs(spark):
    rows = [("5", "10,00", "50,00"), (None, "10,00", "50,00"), ("90", "10,63", "956,70"), ("9", "10,6300", "95,67"), ("9", "010,63", "956,70"), ("1", "2,00", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, p string, a string")
    c = [F.col(x) for x in "qpa"]
    got = df.select("i", numbers.repaired_quantity(*c).alias("r"), numbers.resplit_quantity_price(*c).alias("s")).orderBy("i").collect()
    assert [tuple(x.r) for x in got][:2] == [("5", True), ("5", False)]
    assert tuple(got[4].s) == ("90", "10,63", False)
    assert got[0].s.unsure is False and got[5].s.unsure is True


def test_formats(spark):
    one = spark.range(1)
    got = one.select(numbers.tr_format(F.lit(1234567.5)), numbers.plain_format(F.lit(3.0)), numbers.plain_format(F.lit(0.25)), text.padded_ref(F.lit("IHR"), F.lit(2024), F.lit(7)), text.padded_ref(F.lit("IHR"), F.lit(2024), F.lit(12345))).first()
    assert tuple(got) == ("1.234.567,50", "3", "0.25", "IHR-2024-0007", "IHR-2024-12345")
    day = F.lit("2024-05-10 12:00:00").cast("timestamp")
    ago = lambda s: dates.relative_time(F.lit(s).cast("timestamp"), day)
    assert tuple(one.select(ago("2024-05-10 11:59:30"), ago("2024-05-10 11:15:00"), ago("2024-05-10 01:00:00"), ago("2024-05-01 00:00:00")).first()) == ("Az önce", "45 dk önce", "11 sa önce", "01.05.2024")


def test_product_codes(spark):
    got = values(spark, text.product_code, ["12 AG.XY.900 rest", "ab.12c", "none", None])
    assert [tuple(x) for x in got] == [(12, "AG.XY.900", "900"), (None, "AB.12C", "AB.12C"), (None, None, None), (None, None, None)]
