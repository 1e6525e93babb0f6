"""Declarative validation and the status of declarations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_empty
from ..operators.changes import checks

# Messages in rule order, and document types of which one is mandatory.
MESSAGES = {
    "header.invoiceNo": "Fatura numarası zorunludur.",
    "header.invoiceDate": "Fatura tarihi zorunludur.",
    "parties.seller.name": "Alıcı (gönderen) firma zorunludur.",
    "parties.buyer.name": "Yurt dışı alıcı firma zorunludur.",
    "goodsLines": "En az bir ürün kalemi olmalıdır.",
}
INVOICE_TYPES = ("INVOICE", "E_INVOICE_XML")


def errors_of(fields: dict[str, Column], goods_count: Column, messages: dict[str, str] | None = None) -> Column:
    """Messages of all missing fields, and of goods lines if there is none, in rule order."""
    rules = messages or MESSAGES
    return checks([(F.coalesce(goods_count, F.lit(0)) < 1 if p == "goodsLines" else is_empty(fields[p]), m) for p, m in rules.items()])


def has_invoice(types: Column) -> Column:
    return F.exists(types, lambda t: t.isin(*INVOICE_TYPES))


def next_status(normalised: Column, errors: Column, xml: Column) -> Column:
    """DRAFT until normalised; ERROR if a check failed; XML_GENERATED with XML, else READY."""
    return F.when(~normalised, "DRAFT").when(F.size(errors) > 0, "ERROR").when(xml.isNotNull(), "XML_GENERATED").otherwise("READY")


def rule_errors(conditions: Column, documents: Column) -> Column:
    """A stored rule needs two enabled conditions with a value, and a document."""
    full = F.size(F.filter(conditions, lambda c: c["enabled"] & ~is_empty(F.trim(c["value"]))))
    return checks([(full < 2, "conditions"), (F.coalesce(F.size(documents), F.lit(0)) < 1, "documents")])
