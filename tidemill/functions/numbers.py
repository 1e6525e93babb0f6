"""Numbers in two dialects that must not be mixed, repairs by arithmetic, and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import js_trim

MONEY = r"\d{1,3}(?:\.\d{3})*,\d{2,4}"
_PLAIN = r"^-?(\d+\.?\d*|\.\d+)$"


def lenient_number(c: Column) -> Column:
    """A finite number, else null; blank text is null."""
    t = js_trim(c.cast("string"))
    n = F.when(F.regexp_like(t, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), t.try_cast("double"))
    return F.when(F.abs(n) < F.lit(float("inf")), n)


def last_separator_amount(c: Column) -> Column:
    """Digits, dots, commas and dashes of a text; the separator that comes last is the decimal one. Null if that is no number.

    With the comma last, dots go and only the first comma becomes a point; with the dot last, commas go. So "1.234" is 1.234.
    """
    s = F.regexp_replace(c, r"[^0-9.,\-]", "")
    comma, dot = (F.when(F.instr(s, x) > 0, F.length(s) - F.instr(F.reverse(s), x)).otherwise(F.lit(-1)) for x in (",", "."))
    point = F.regexp_replace(F.replace(s, F.lit("."), F.lit("")), "^([^,]*),", "$1.")
    n = F.when(comma > dot, point).when(dot > comma, F.replace(s, F.lit(","), F.lit(""))).otherwise(s)
    return F.when(F.regexp_like(n, F.lit(_PLAIN)), n.try_cast("double"))


def comma_decimal(c: Column) -> Column:
    """Dots group, the comma is decimal: "1.234" is 1234. Null or empty gives null."""
    n = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(F.regexp_like(n, F.lit(_PLAIN)), n.try_cast("double"))


def quantity(c: Column) -> Column:
    """1.600 is a grouped 1600; other texts as last_separator_amount."""
    t = js_trim(c)
    return F.when(F.regexp_like(t, F.lit(r"^\d{1,3}(?:\.\d{3})+$")), F.replace(t, F.lit("."), F.lit("")).try_cast("double")).otherwise(last_separator_amount(t))


def money_values(c: Column) -> Column:
    """All money texts of a text, in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({MONEY})"), F.lit(1))


def repaired_quantity(q: Column, price: Column, amount: Column) -> Column:
    """struct(quantity, unsure) of texts: the whole number amount / price replaces a quantity that is missing or doesn't fit."""
    qn, p, a = comma_decimal(q), comma_decimal(price), comma_decimal(amount)
    whole = F.rint(a / p)
    near = (p != 0) & (a != 0) & (a / p > 0) & (F.abs(a / p - whole) < 0.01)
    use = F.coalesce(near & (qn.isNull() | (qn == 0) | (F.abs(qn * p - a) > 0.05)), F.lit(False))
    return F.struct(F.when(use, whole.cast("long").cast("string")).otherwise(q).alias("quantity"), (~use).alias("unsure"))


def resplit_quantity_price(q: Column, price: Column, amount: Column) -> Column:
    """struct(quantity, unit_price, unsure): the first cut of the joined digits at which quantity times price gives the amount.

    Texts whose product is the amount already stay as they are and are sure.
    """
    a = comma_decimal(amount)
    joined = F.concat(q, price)
    digits, tail = F.regexp_extract(joined, r"^(\d+)(\d,\d{2,4})$", 1), F.regexp_extract(joined, r"^(\d+)(\d,\d{2,4})$", 2)
    cut = lambda i: F.struct(F.substring(digits, F.lit(1), i).alias("quantity"), F.concat(F.substring(digits, i + 1, F.length(digits)), tail).alias("unit_price"))
    cuts = F.when(F.length(digits) > 0, F.transform(F.sequence(F.lit(1), F.length(digits)), cut))
    fits = lambda x: F.coalesce((comma_decimal(x["quantity"]) != 0) & (F.abs(comma_decimal(x["quantity"]) * comma_decimal(x["unit_price"]) - a) < 0.05), F.lit(False))
    best = F.get(F.filter(cuts, fits), F.lit(0))
    sure = F.coalesce(F.abs(comma_decimal(q) * comma_decimal(price) - a) < 0.05, F.lit(False)) & F.coalesce((comma_decimal(q) != 0) & (a != 0), F.lit(False))
    keep = sure | best.isNull()
    return F.struct(F.when(keep, q).otherwise(best["quantity"]).alias("quantity"), F.when(keep, price).otherwise(best["unit_price"]).alias("unit_price"), (~sure & best.isNull()).alias("unsure"))


def tr_format(c: Column, decimals: int = 2) -> Column:
    """Dots between groups and a decimal comma; halves are rounded away from zero."""
    return F.translate(F.format_number(F.round(c, decimals), decimals), ",.", ".,")


def plain_format(c: Column) -> Column:
    """A finite number as JavaScript writes it: no trailing zeros, no exponent from 1e-6 up to 1e21. Its shortest digits are made once."""

    def told(x: Column) -> Column:
        v, shown = x["v"], x["shown"]
        size = F.abs(v)
        plain = lambda kind: F.regexp_replace(shown.cast(kind).cast("string"), r"\.?0+$", "")
        exponent = F.regexp_replace(F.regexp_replace(shown, r"(\.0)?E(\d)", "e+$2"), r"(\.0)?E-", "e-")
        far = F.when((size >= 1) & (size < 1e21), plain("decimal(38,16)")).when((size >= 1e-6) & (size < 1), plain("decimal(38,30)")).otherwise(exponent)
        # only numbers below a thousandth and from ten million on are shown with an exponent
        return F.when(v == 0, "0").when(F.contains(shown, F.lit("E")), far).when(F.endswith(shown, F.lit(".0")), F.left(shown, F.length(shown) - 2)).otherwise(shown)

    c = c.cast("double")
    return F.get(F.transform(F.array(F.struct(c.alias("v"), c.cast("string").alias("shown"))), told), F.lit(0))


def scaled_box(x: Column, size: Column, to: int) -> Column:
    """A coordinate on the common canvas."""
    return x * to / size


def column_span(centre: Column, width: float) -> Column:
    """struct(x_min, x_max) of a column around its centre, not below zero."""
    return F.struct(F.greatest(F.lit(0.0), centre - width / 2).alias("x_min"), (centre + width / 2).alias("x_max"))


def env_flag(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("1", "true", "yes", "on")


def env_number(c: Column, default: float) -> Column:
    return F.coalesce(lenient_number(c), F.lit(default))
