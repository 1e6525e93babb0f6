"""Priority resolution of fields from several documents, with lineage.

Sources are long rows (declaration, source type, position, path, value); one aggregation per declaration and path picks the
value of the best (priority, position). The rules are a small literal table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import country_of_address, is_empty

# Source types by priority for each field, and for goods lines.
_INVOICES = ["INVOICE", "E_INVOICE_XML"]
_EXPORT = ["INVOICE", "E_INVOICE_XML", "EXPORT_INVOICE"]
_TRADE = ["INVOICE", "E_INVOICE_XML", "EXPORT_INVOICE", "PROFORMA"]
_PACKING = ["INVOICE", "E_INVOICE_XML", "EXPORT_INVOICE", "PACKING_LIST"]
_NOTIFY = ["BILL_OF_LADING_INSTRUCTION", "EXPORT_INVOICE", "INVOICE", "E_INVOICE_XML"]
_TRANSPORT = ["INVOICE", "E_INVOICE_XML", "EXPORT_INVOICE", "BILL_OF_LADING_INSTRUCTION"]
PRIORITY = {
    "header.invoiceNo": _INVOICES, "header.invoiceDate": _INVOICES, "header.currency": _EXPORT, "header.totalAmount": _EXPORT,
    "parties.seller.name": _EXPORT, "parties.seller.taxNo": _EXPORT, "parties.seller.address": _EXPORT, "parties.seller.country": _EXPORT,
    "parties.buyer.name": _EXPORT, "parties.buyer.taxNo": _EXPORT, "parties.buyer.address": _EXPORT, "parties.buyer.country": _EXPORT,
    "parties.notify.name": _NOTIFY, "parties.notify.address": _NOTIFY,
    "trade.deliveryTerm": _TRADE, "trade.paymentType": _TRADE, "trade.origin": _EXPORT,
    "transport.mode": _TRANSPORT,
    "packageInfo.totalPackage": _PACKING, "packageInfo.packageType": _PACKING, "packageInfo.grossKg": _PACKING, "packageInfo.netKg": _PACKING,
}
GOODS_PRIORITY = _TRADE
SELLER_COUNTRY = "TÜRKİYE"
GOODS_FIELDS = {"lineNo": "int", "hsCode": "string", "description": "string", "quantity": "double", "unit": "string", "unitPrice": "double", "lineTotal": "double", "origin": "string", "grossKg": "double", "netKg": "double"}


def priority_table(spark: SparkSession, rules: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(p, t, i) for p, types in (rules or PRIORITY).items() for i, t in enumerate(types)]
    return spark.createDataFrame(rows, "path string, source string, priority int")


def resolve_fields(values: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, path, value, source): the first non-empty value by source priority, then position. Sources without a rule don't count.

    values: (key, source, pos, path, value). The rules are (path, source, priority): a literal table of a few dozen rows, which Spark
    broadcasts by its known size, or a stored one of any size.
    """
    known = values.where(~is_empty(F.col("value"))).join(rules, ["path", "source"])
    return known.groupBy(key, "path").agg(F.min_by(F.struct("value", "source"), F.struct("priority", "pos")).alias("best")).select(key, "path", "best.value", "best.source")


def with_overrides(resolved: DataFrame, declarations: DataFrame, key: str) -> DataFrame:
    """The seller's country is fixed where a declaration has any source, the buyer's is guessed from the address; both have no source."""
    seller = declarations.select(key, F.lit("parties.seller.country").alias("path"), F.lit(SELLER_COUNTRY).alias("value"))
    guess = resolved.where("path = 'parties.buyer.address'").select(key, F.lit("parties.buyer.country").alias("path"), country_of_address(F.col("value")).alias("value")).where("value is not null")
    forced = seller.unionByName(guess).withColumn("source", F.lit(None).cast("string"))
    return resolved.join(forced.select(key, "path"), [key, "path"], "left_anti").unionByName(forced)


def first_object(sources: DataFrame, key: str, value: str, pos: str = "pos") -> DataFrame:
    """(key, value): the first source's object that is there, of whatever type the source is."""
    return sources.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, pos).alias(value))


def field_rules(rules: DataFrame) -> DataFrame:
    """Stored field rules (path, primary, fallback) as a rule table for resolve_fields. An extension: they are only stored elsewhere."""
    rows = rules.select("path", F.posexplode(F.array("primary", "fallback")).alias("priority", "source"))
    return rows.where("source is not null and source <> ''").select("path", "source", "priority")


def resolve_goods(lists: DataFrame, key: str) -> DataFrame:
    """(key, source, lines): the whole first non-empty list by source priority and position, never mixed."""
    rank = F.array_position(F.array(*map(F.lit, GOODS_PRIORITY)), F.col("source"))
    full = lists.where((F.size("lines") > 0) & (rank > 0))
    return full.groupBy(key).agg(F.min_by(F.struct("source", "lines"), F.struct(rank, "pos")).alias("b")).select(key, "b.source", "b.lines")


def normal_goods(lines: Column) -> Column:
    """Goods lines (maps of text) with known fields in either capitalisation, trimmed and cast; a missing or zero line number is the position."""

    def one(m: Column, i: Column) -> Column:
        def text(name: str) -> Column:
            pascal = "HSCode" if name == "hsCode" else name[0].upper() + name[1:]
            t = F.trim(F.coalesce(F.element_at(m, name), F.element_at(m, pascal)))
            return F.when(t != "", t)

        cell = {n: text(n).try_cast(k) for n, k in GOODS_FIELDS.items()}
        number = text("lineNo").try_cast("double").try_cast("int")
        cell["lineNo"] = F.when(F.coalesce(number, F.lit(0)) != 0, number).otherwise(i + 1)
        return F.struct(*(c.alias(n) for n, c in cell.items()))

    return F.transform(lines, one)


def source_trace(resolved: DataFrame, key: str) -> DataFrame:
    """(key, trace): a map from path to its value and source; a declaration has a few dozen paths at most."""
    entry = F.struct("path", F.struct("value", "source"))
    return resolved.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("trace"))


def as_columns(resolved: DataFrame, key: str, paths: list[str]) -> DataFrame:
    """One column for each path (dots become underscores)."""
    return resolved.groupBy(key).agg(*(F.max(F.when(F.col("path") == p, F.col("value"))).alias(p.replace(".", "_")) for p in paths))
