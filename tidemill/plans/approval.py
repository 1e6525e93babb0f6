"""From query results or spreadsheets to material records, and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_key, is_empty_cell, js_trim
from ..operators.dedupe import keep_first

TRANSACTION_TYPES = ("ihracat", "ithalat", "transit", "antrepo")
# Labels of the import's columns.
LABELS = {"materialNo": "Malzeme No", "description": "Malzeme Tanımı", "gtipNo": "GTİP"}


def send_to_approval(items: DataFrame, records: DataFrame) -> DataFrame:
    """Items (pos, materialNo, description, foundGtip) with `outcome`; sent ones are new pending records, blanks shown by a dash."""
    rows = keep_first(items, fold_key(F.col("materialNo")), [F.col("pos")], records, fold_key(F.col("materialNo")))
    dash = lambda c: F.when(F.coalesce(js_trim(F.col(c)), F.lit("")) == "", "—").otherwise(js_trim(F.col(c)))
    return rows.select("pos", js_trim(F.col("materialNo")).alias("materialNo"), dash("description").alias("description"), dash("foundGtip").alias("gtipNo"), F.array(*map(F.lit, TRANSACTION_TYPES)).alias("transactionTypes"), F.lit("pending").alias("status"), F.lit("fatura").alias("source"), "outcome")


def import_rows(sheet: DataFrame, records: DataFrame) -> DataFrame:
    """Sheet rows (row, materialNo, description, gtipNo) with `error` (null: accepted): missing fields, then repeats in the file, then stored numbers.

    Numbers in the file are compared by Turkish lower case, stored ones by plain case-insensitive equality. Empty rows are left out.
    """
    cells = sheet.select("row", *(js_trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in LABELS))
    cells = cells.where(~(is_empty_cell(F.col("materialNo")) & is_empty_cell(F.col("description")) & is_empty_cell(F.col("gtipNo"))))
    lacking = F.array_compact(F.array(*(F.when(is_empty_cell(F.col(c)), F.lit(n)) for c, n in LABELS.items())))
    cells = cells.withColumn("_lack", lacking)
    full = keep_first(cells.where(F.size("_lack") == 0), fold_key(F.col("materialNo")), [F.col("row")])
    there = records.select(F.lower("materialNo").alias("_m")).distinct().withColumn("_there", F.lit(True))
    full = full.withColumn("_m", F.lower("materialNo")).join(there, "_m", "left")
    repeat = F.when(F.col("outcome") == "duplicate", F.concat(F.lit("Dosyada tekrarlayan malzeme no: "), F.col("materialNo")))
    stored = F.when(F.col("_there"), F.concat(F.lit("Bu malzeme numarası zaten mevcut: "), F.col("materialNo")))
    good = full.select("row", *LABELS, F.coalesce(repeat, stored).alias("error"))
    bad = cells.where(F.size("_lack") > 0).select("row", *LABELS, F.concat(F.lit("Eksik/geçersiz alanlar: "), F.array_join("_lack", ", "), F.lit(". Tüm alanlar dolu olmalıdır.")).alias("error"))
    return good.unionByName(bad)


def compliance(system: Column, customer: Column) -> Column:
    """An extension: how a customer's tariff code agrees with the system's."""
    blank = lambda c: F.coalesce(js_trim(c), F.lit("")) == ""
    return F.when(blank(system) | blank(customer), "Eksik").when(F.regexp_replace(system, "[^0-9]", "") == F.regexp_replace(customer, "[^0-9]", ""), "Uyumlu").otherwise("Uyumsuz")


def conflicts(values: DataFrame, key: str) -> DataFrame:
    """An extension: (key, path) whose sources give different values, with those values."""
    return values.groupBy(key, "path").agg(F.array_sort(F.collect_set("value")).alias("values")).where(F.size("values") > 1)


def capabilities(screens: DataFrame, registry: DataFrame) -> DataFrame:
    """user_id, capability: operate gives all of a screen's capabilities, view those that end in .view, or the first without any."""
    views = registry.where(F.endswith("capability", F.lit(".view")))
    first = registry.groupBy("screen").agg(F.min_by("capability", "pos").alias("capability")).join(views, "screen", "left_anti")
    seen = views.select("screen", "capability").unionByName(first.select("screen", "capability"))
    full = screens.where("level = 'operate'").join(registry, "screen").select("user_id", "capability")
    return full.unionByName(screens.where("level = 'view'").join(seen, "screen").select("user_id", "capability")).distinct()


def approval_levels(declarations: DataFrame, rules: DataFrame, kind: str = "operationType") -> DataFrame:
    """Declarations with `level` (1 or 2): what their company's rule row says of their type; 1 without a rule."""
    of = F.create_map(*(x for t in TRANSACTION_TYPES for x in (F.lit(t), F.col(t))))
    table = rules.select("companyId", of.alias("_levels"))
    return declarations.join(table, "companyId", "left").withColumn("level", F.coalesce(F.element_at("_levels", F.col(kind)), F.lit(1))).drop("_levels")


def licence_valid(start: Column, end: Column, as_of: Column) -> Column:
    """Inside the window, five minutes of clock skew allowed on both ends."""
    skew = F.expr("interval 5 minutes")
    return (as_of >= start - skew) & (as_of <= end + skew)
