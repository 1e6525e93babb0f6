"""XML of a declaration: text assembled by expressions, in a fixed layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import plain_format
from ..functions.text import escape_xml

# Tags of the head, package and weight blocks, and their paths.
HEAD_TAGS = {"InvoiceNo": "header.invoiceNo", "InvoiceDate": "header.invoiceDate", "Currency": "header.currency", "Buyer": "parties.buyer.name", "Seller": "parties.seller.name", "DeliveryTerm": "trade.deliveryTerm", "TransportMode": "transport.mode", "PaymentType": "trade.paymentType", "Origin": "trade.origin"}
PACKAGE_TAGS = {"TotalPackage": "packageInfo.totalPackage"}
WEIGHT_TAGS = {"GrossKg": "packageInfo.grossKg", "NetKg": "packageInfo.netKg"}


def flat_mapping() -> dict[str, str]:
    """Block and tag of every element to its path: the three tables in one."""
    return {f"{block}.{t}": p for block, tags in (("Beyanname", HEAD_TAGS), ("Package", PACKAGE_TAGS), ("Weight", WEIGHT_TAGS)) for t, p in tags.items()}


def tag(name: str, value: Column, indent: int) -> Column:
    """An element on a line of its own; empty for null."""
    return F.concat(F.lit(f"{' ' * indent}<{name}>"), F.coalesce(escape_xml(value), F.lit("")), F.lit(f"</{name}>"))


def goods_xml(line: Column) -> Column:
    """A goods line; its unit only if it is not empty, its total only if there is one."""
    rows = [
        F.lit("  <GoodsLine>"), tag("HSCode", line["hsCode"], 4), tag("Description", line["description"], 4), tag("Quantity", plain_format(line["quantity"]), 4),
        tag("UnitPrice", plain_format(line["unitPrice"]), 4), F.when(line["unit"] != "", tag("Unit", line["unit"], 4)),
        F.when(line["lineTotal"].isNotNull(), tag("LineTotal", plain_format(line["lineTotal"]), 4)), F.lit("  </GoodsLine>"),
    ]
    return F.concat_ws("\n", *rows)


def declaration_xml(paths: dict[str, Column], goods: Column) -> Column:
    """The whole document. paths: text columns by path; goods: an array of goods-line structs."""
    at = lambda p: paths.get(p, F.lit(None).cast("string"))
    lines = F.transform(F.coalesce(goods, F.array()), goods_xml) if goods is not None else F.array()
    return F.concat_ws(
        "\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>'), F.lit('<Beyanname xmlns="urn:evrim:draft">'), *(tag(t, at(p), 2) for t, p in HEAD_TAGS.items()),
        F.lit("  <GoodsLines>"), lines, F.lit("  </GoodsLines>"), F.lit("  <Package>"), *(tag(t, at(p), 4) for t, p in PACKAGE_TAGS.items()),
        F.lit("  </Package>"), F.lit("  <Weight>"), *(tag(t, at(p), 4) for t, p in WEIGHT_TAGS.items()), F.lit("  </Weight>"), F.lit("</Beyanname>"),
    )
