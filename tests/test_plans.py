"""Extraction, resolution, validation, XML, approval, sources and streams on small documents."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators import changes, joins, scans, stats
from tidemill.plans import approval, extract_spatial, extract_text, resolve, validate, xmlout
from tidemill.sources import collections, pdf, xlsx
from tidemill.streaming import events

INVOICE = """e-FATURA
ACME MAKİNA A.Ş.
Adres: Sanayi Cad. 5
KONYA Türkiye
VKN: 1234567890
SAYIN
Buyer Kft.
Fő utca 1 Budapest Hungary
ETTN: x
Fatura No: ABC2024000000123
Fatura Tarihi: 05.03.2024
Genel Toplam: 1.250,50 EUR
ÖDEME ŞEKLİ : PESIN -
Teslim FCA
TOPLAM KAP : 12 PALET
BRÜT KG : 1.500,25
NET KG : 1.400,00
1
AB1234567890
Vida seti
M8
1.600
Adet 2,50
EUR 4.000,00
Karayolu 731815000000
2
Somun
M9
10
Adet 1,25
EUR
12,50
Karayolu 731816000011
son"""


def test_text_invoice(spark):
    df = spark.createDataFrame([(1, INVOICE), (2, None), (3, "GTIP 731815000000 steel bolts ADET 5 2,50 12,50\nplain"), (4, "SAYIN Buyer Ltd\nRoad 1 France\nETTN: y\nFatura Tarihi: 01.02.2024\nSeller AS\nVKN 99887766554\ne-FATURA")], "id int, text string")
    got = {r.id: r for r in extract_text.extract_invoices(df).collect()}
    a = got[1]
    assert (a.invoice_no, a.invoice_date, a.currency, a.total_amount, a.delivery_term, a.transport_mode) == ("ABC2024000000123", "2024-03-05", "EUR", 1250.5, "FCA", "Karayolu")
    assert (a.total_package, a.package_type, a.gross_kg, a.net_kg, a.payment_type) == (12.0, "PALET", 1500.25, 1400.0, "PESIN")
    assert tuple(a.seller) == ("ACME MAKİNA A.Ş.", "Sanayi Cad. 5 KONYA Türkiye", "1234567890")
    assert a.buyer.name == "Buyer Kft." and a.buyer_country == "Hungary"
    assert [tuple(g) for g in a.goods] == [(1, "731815000000", "Vida seti", 1600.0, "Adet", 2.5, 4000.0), (2, "731816000011", "Somun", 10.0, "Adet", 1.25, 12.5)]
    assert got[2].goods is None and got[2].invoice_no is None
    one = got[3].goods
    assert len(one) == 1 and one[0].hs_code == "731815000000" and (one[0].quantity, one[0].unit_price, one[0].line_total) == (5.0, 2.5, 12.5)
    assert one[0].unit == "ADET" and one[0].description == "steel bolts"
    assert got[4].buyer.name == "Buyer Ltd" and got[4].seller.name == "Seller AS" and got[4].seller.tax_no == "99887766554"


def box(pos, text, x, y, w=60, page=1, doc="d"):
    return (doc, page, pos, text, float(x), float(y), float(x + w), float(y + 20), 1.0)


def test_spatial_items(spark):
    words = [
        box(0, "Malzeme/Hizmet", 100, 700), box(1, "Miktar", 500, 700), box(2, "Birim Fiyat", 700, 700), box(3, "Tutar", 900, 700),
        box(4, "1", 60, 800), box(5, "AG.XY.900", 110, 800), box(6, "CELIK", 200, 800), box(7, "VIDA", 260, 800), box(8, "TOPLAM", 300, 805), box(9, "80 Adet", 500, 800), box(10, "2,50", 700, 800), box(11, "200,00", 900, 800), box(12, "EUR", 960, 800), box(13, "FCA", 1000, 800), box(14, "KARAY0LU", 1050, 800), box(15, "73181500001", 1200, 800),
        box(16, "123456789012", 1200, 300), box(17, "ZZ.TOP.1", 110, 1000), box(18, "999999999999", 900, 1000),
    ]
    df = spark.createDataFrame(words, "doc_id string, page int, pos int, text string, x0 double, y0 double, x1 double, y1 double, score double")
    items = extract_spatial.extract_items(df).collect()
    assert len(items) == 1  # above the table on page one, and left of the code column, are no candidates
    i = items[0]
    assert (i.gtip, i.line_no, i.product_code, i.product_code_full, i.currency, i.delivery_term, i.transport_mode) == ("731815000010", 1, "900", "AG.XY.900", "EUR", "FCA", "Karayolu")
    assert (i.quantity, i.unit, i.unit_price, i.amount, i.needs_review, i.description) == ("80", "ADET", "2,50", "200,00", False, "AG.XY.900 CELIK VIDA")
    assert i.boxes.amount == [900.0, 800.0, 960.0, 820.0] and i.boxes.product_code[0] == 110.0
    src = extract_spatial.as_source(extract_spatial.extract_items(df)).first()
    assert src.item_count == 1 and src.goods[0].line_total == 200.0


def test_items_broadcast_no_words(spark, tmp_path):
    """Words exploded from a small file look as small as it; the joins of items must not send them through the driver."""
    line = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(s).alias("text"), F.lit(x).alias("x0"), F.lit(800.0).alias("y0"), F.lit(x + 60).alias("x1"), F.lit(820.0).alias("y1"), F.lit(0.9).alias("score")) for i, (x, s) in enumerate(((100.0, "AB.CE.101"), (500.0, "2 ADET"), (1100.0, "731815000012")))))
    spark.range(20).write.parquet(str(tmp_path / "docs"))
    words = spark.read.parquet(str(tmp_path / "docs")).select(F.col("id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.explode(line).alias("w")).select("doc_id", "page", "w.*")
    items = extract_spatial.extract_items(words)
    assert "Broadcast" not in items._jdf.queryExecution().sparkPlan().toString()
    assert sorted((int(i.doc_id), i.gtip, i.quantity, i.product_code_full) for i in items.collect()) == [(k, "731815000012", "2", "AB.CE.101") for k in range(20)]


def test_money_texts_are_read_once_for_their_pairs(spark):
    """A line's texts are searched in one place of the plan, and the first ordered pair is as a plain search finds it."""
    lines = [(["1,00 EUR", "10,50", "7,77", "= 21,00"], "2"), (["2,00 2,00", None, "4,00"], "2"), (["1,OO", "3,00\n1,00"], "3"), (["5,00"], "1"), (["1,00", "1,00"], "1"), (["1,00", "1,01"], "1"), (["1.000,50", "2.001,00"], "2"), (["1,00", "2,00"], "0"), (["1,00", "2,00"], None), ([], "2"), (["x"], "y")]
    df = spark.createDataFrame([([(t,) for t in ts], q) for ts, q in lines], "line array<struct<text:string>>, q string")
    found = df.select(extract_spatial.price_and_amount(F.col("line"), F.col("q")).alias("pa"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r.pa and tuple(r.pa) for r in found.collect()] == [("10,50", "21,00"), ("2,00", "4,00"), ("1,00", "3,00"), None, None, ("1,00", "1,01"), ("1.000,50", "2.001,00"), None, None, None, None]


def test_resolution(spark):
    rows = [("d", "E_INVOICE_XML", 0, "header.invoiceNo", "X2"), ("d", "INVOICE", 1, "header.invoiceNo", ""), ("d", "INVOICE", 2, "header.invoiceNo", "A1"), ("d", "PACKING_LIST", 3, "header.invoiceNo", "P"), ("d", "INVOICE", 1, "parties.buyer.address", "Fő utca Hungary"), ("d", "INVOICE", 1, "parties.seller.country", "Germany")]
    values = spark.createDataFrame(rows, "id string, source string, pos int, path string, value string")
    got = resolve.with_overrides(resolve.resolve_fields(values, "id", resolve.priority_table(spark)), values.select("id").distinct(), "id")
    by = {r.path: (r.value, r.source) for r in got.collect()}
    assert by == {"header.invoiceNo": ("A1", "INVOICE"), "parties.buyer.address": ("Fő utca Hungary", "INVOICE"), "parties.seller.country": ("TÜRKİYE", None), "parties.buyer.country": ("Hungary", None)}
    trace = resolve.source_trace(got, "id").first().trace
    assert trace["header.invoiceNo"].source == "INVOICE"
    lists = spark.createDataFrame([("d", "PROFORMA", 0, [{"hsCode": "1"}]), ("d", "INVOICE", 1, []), ("d", "EXPORT_INVOICE", 2, [{"HSCode": " 7 ", "LineNo": "0", "quantity": "x"}, {"lineNo": "9"}])], "id string, source string, pos int, lines array<map<string,string>>")
    g = resolve.resolve_goods(lists, "id").select("source", resolve.normal_goods(F.col("lines")).alias("l")).first()
    assert g.source == "EXPORT_INVOICE" and [(x.lineNo, x.hsCode, x.quantity) for x in g.l] == [(1, "7", None), (9, None, None)]


def test_validation_and_xml(spark):
    df = spark.createDataFrame([("1", "A<1>", None, 0), ("2", "B", "S", 2)], "id string, no string, seller string, n int")
    fields = {"header.invoiceNo": F.col("no"), "header.invoiceDate": F.lit("2024-01-01"), "parties.seller.name": F.col("seller"), "parties.buyer.name": F.lit("b")}
    got = {r.id: r.e for r in df.select("id", validate.errors_of(fields, F.col("n")).alias("e")).collect()}
    assert got == {"1": ["Alıcı (gönderen) firma zorunludur.", "En az bir ürün kalemi olmalıdır."], "2": []}
    goods = F.array(F.struct(F.lit("7").alias("hsCode"), F.lit("x & y").alias("description"), F.lit(2.0).alias("quantity"), F.lit("").alias("unit"), F.lit(1.5).alias("unitPrice"), F.lit(3.0).alias("lineTotal")))
    xml = df.where("id = '1'").select(xmlout.declaration_xml({"header.invoiceNo": F.col("no")}, goods)).first()[0]
    assert "<InvoiceNo>A&lt;1&gt;</InvoiceNo>" in xml and "<Description>x &amp; y</Description>" in xml and "<Unit>" not in xml and "<LineTotal>3</LineTotal>" in xml and "<GrossKg></GrossKg>" in xml


def test_approval_and_import(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(xlsx.template_bytes([["GTİP", "Malzeme No", "Malzeme Tanımı"], ["1", "A1", "x"], ["2", "a1", "y"], ["", "-", ""], ["3", "", "z"], ["4", "OLD", "w"]]))
    (tmp_path / "in" / "b.xlsx").write_bytes(b"not a workbook")
    cells = xlsx.read_xlsx(spark, str(tmp_path / "in"))
    assert cells.where("error is not null").count() == 1
    sheet = xlsx.material_rows(cells.where("error is null"))
    records = spark.createDataFrame([("old",)], "materialNo string")
    got = {r.row: r.error for r in approval.import_rows(sheet, records).collect()}
    assert set(got) == {2, 3, 5, 6} and got[2] is None
    assert got[3].endswith("a1") and "Malzeme No" in got[5] and got[6].endswith("OLD")
    items = spark.createDataFrame([(0, "A", "", None), (1, " a", "d", "1"), (2, "OLD", "d", "1")], "pos int, materialNo string, description string, foundGtip string")
    sent = {r.pos: (r.outcome, r.description, r.gtipNo) for r in approval.send_to_approval(items, records).collect()}
    assert sent == {0: ("sent", "—", "—"), 1: ("duplicate", "d", "1"), 2: ("existing", "d", "1")}


def test_capabilities(spark):
    registry = spark.createDataFrame([("s1", "s1.edit", 0), ("s1", "s1.view", 1), ("s2", "s2.run", 0), ("s2", "s2.stop", 1)], "screen string, capability string, pos int")
    screens = spark.createDataFrame([(1, "s1", "view"), (1, "s2", "view"), (2, "s1", "operate")], "user_id int, screen string, level string")
    assert {tuple(r) for r in approval.capabilities(screens, registry).collect()} == {(1, "s1.view"), (1, "s2.run"), (2, "s1.edit"), (2, "s1.view")}


def test_changes(spark):
    base = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.9)], "k int, v string, confidence double")
    new = spark.createDataFrame([(2, "B", 0.7), (3, "C", 0.1), (1, "A", 0.6)], "k int, v string, confidence double")
    assert {tuple(r)[:2] for r in changes.merged_by_confidence(base, new, ["k"], "confidence").collect()} == {(1, "A"), (2, "b"), (3, "C")}
    after, refused = changes.bulk_insert(base, new, F.col("k"))
    assert after.count() == 2 and {tuple(r) for r in refused.collect()} == {(1, "existing"), (2, "existing")}
    after, refused = changes.bulk_insert(base, new.where("k = 3"), F.col("k"))
    assert after.count() == 3 and refused.count() == 0
    arr = spark.range(1).select(F.array(F.struct(F.lit("x").alias("f"), F.lit(1).alias("v"))).alias("a"))
    put = lambda f, v: changes.list_upsert(F.col("a"), F.struct(F.lit(f).alias("f"), F.lit(v).alias("v")), "f")
    assert [[tuple(x) for x in c] for c in arr.select(put("x", 2), put("y", 3)).first()] == [[("x", 2)], [("x", 1), ("y", 3)]]


def test_collections_and_pdf(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "f" / "b.pdf").write_bytes(b"text")
    files = collections.read_documents(spark, str(tmp_path / "f"))
    assert {r.path[-5:]: r.is_pdf for r in files.collect()} == {"a.pdf": True, "b.pdf": False}
    assert collections.landed(files, "t").where("extractionStatus = 'PENDING'").count() == 2
    assert pdf.word_boxes(files).where("error is not null").count() == 2
    w = spark.createDataFrame([("d", 1, "x", 2, None), ("e", 1, None, 1, None), ("f", 1, "x", 0, None)], "doc_id string, page int, text string, images int, error string")
    assert {r.doc_id: r.pdf_type for r in pdf.classify(w).collect()} == {"d": "MOSTLY_IMAGE_PDF", "e": "IMAGE_BASED_PDF", "f": "DIGITAL_TEXT_PDF"}
    out = spark.createDataFrame([("1", "t1", "c", "A", "d", "7", ["ihracat"], "pending", "fatura", None, None)], collections.collection("material_records"))
    collections.write_collection(out, str(tmp_path / "m"))
    assert scans.tenant_scan(collections.read_collection(spark, str(tmp_path / "m"), "material_records"), "t1").count() == 1
    collections.write_xml(spark.createDataFrame([("1", "<a>\n</a>")], "id string, x string"), str(tmp_path / "x"), "id", F.col("x"))
    assert [p.read_text() for p in (tmp_path / "x").glob("id=1/*.txt")][0].rstrip("\0") == "<a>\n</a>"


def test_summaries(spark):
    pts = spark.range(1).select(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((3, 1), (1, 5)))).alias("p"))
    assert tuple(pts.select(stats.bounding_box(F.col("p")).alias("b")).first().b) == (1, 1, 3, 5)
    a = spark.createDataFrame([(1, 0), (2, 10), (3, 25)], "id int, at long").withColumn("g", F.lit(1))
    assert {(r.id, r.b_id) for r in joins.near_pairs(a, a, ["g"], "at", 15, ("id", "id")).collect()} == {(1, 2), (2, 1), (2, 3), (3, 2)}


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, "2024-01-01 00:%02d:00" % (i % 60), "click" if i % 2 else "view") for i in range(40)], "event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"), df.schema)
    q = events.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.event_type, r.n) for r in spark.table("counts").collect()} == {("click", 20), ("view", 20)}


def test_pdf_text_says_why_a_file_is_none(spark):
    from tidemill.sources import pdf

    files = spark.createDataFrame([("a.txt", b"%PDF-1.7"), ("b.pdf", b"hello"), ("c.PDF", b"%PDF-broken"), ("d.pdf", b"x")], "path string, content binary")
    got = {x.path: x for x in pdf.texts(files).collect()}
    assert [got[k].reason for k in ("a.txt", "b.pdf", "c.PDF", "d.pdf")] == ["non-pdf", "not-pdf-binary", None, None]
    assert all(x.text is None for x in got.values()) and got["c.PDF"].error


def test_number_formats(spark):
    from tidemill.functions import numbers

    rows = spark.createDataFrame([(x,) for x in (5.0, 12345678.5, 0.0001, 1e21, 1.5e-7, 1e20, -2.5, 0.1, 1e15)], "x double")
    plain = [r[0] for r in rows.select(numbers.plain_format(F.col("x"))).collect()]
    assert plain == ["5", "12345678.5", "0.0001", "1e+21", "1.5e-7", "100000000000000000000", "-2.5", "0.1", "1000000000000000"]
    shown = spark.createDataFrame([(1430.5, 0.125, 2.5)], "a double, b double, c double").select(numbers.tr_format(F.col("a"), 0), numbers.tr_format(F.col("b")), numbers.tr_format(F.col("c"), 0)).first()
    assert tuple(shown) == ("1.431", "0,13", "3")


def test_keep_first_takes_null_keys_apart_and_patches_do_not_multiply(spark):
    from tidemill.operators import changes, dedupe

    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, n int")
    assert {x.n: x.outcome for x in dedupe.keep_first(df, F.col("k"), [F.col("n")]).collect()} == {1: "sent", 2: "sent", 3: "sent", 4: "duplicate"}
    base, patch = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 5), ("a", 7)], "k string, v int")
    assert [tuple(x) for x in changes.patched(base, patch, "k").collect()] == [("a", 7)]
