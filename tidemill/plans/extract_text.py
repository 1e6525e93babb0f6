"""Fields of invoices from their plain text, by expressions over text and its lines.

Line-anchored parts work on arrays of lines: the first line that meets a predicate is an array position, blocks are slices.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import text_to_iso
from ..functions.numbers import last_separator_amount, quantity
from ..functions.text import JS_SPACE, collapse, country_of_address, js_trim, line_after_label

# The patterns of the fields. A word begins or ends where no ASCII word character is next to it.
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
INVOICE_NO = [
    r"(?i)(?:Fatura\s*No|Invoice\s*No\.?|Fatura\s*Numaras[ıi]|Invoice\s*Number|FATURA\s*NO)\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/]{3,40})",
    rf"(?i){_L}(CLK[0-9A-Z\-]{{6,32}}){_R}",
    rf"{_L}([A-Z]{{2,5}}\d{{8,18}}){_R}",
]
ISO_DATE = rf"{_L}(20\d{{2}}-\d{{2}}-\d{{2}}){_R}"
DATES = [r"(?i)(?:Fatura\s*Tarihi|Invoice\s*Date|Date\s*of\s*Invoice)\s*[:\-]?\s*(\d{2}[./-]\d{2}[./-]\d{4})", rf"{_L}(\d{{2}}[./-]\d{{2}}[./-]\d{{4}}){_R}"]
CURRENCY = rf"{_L}(EUR|USD|TRY|GBP|CHF|JPY|CNY){_R}"
TOTALS = [r"(?i)Mal\s*Hizmet\s*Toplam\s*Tutar[ıi]?\s*([\d.]+,\d{2})\s*(?:EUR|USD|TRY)?", r"(?i)(?:Genel\s*Toplam|Grand\s*Total|Toplam\s*Tutar|[Öö]denecek\s*Tutar)\s*[:\-]?\s*([\d.]+,\d{2}|\d+[.,]\d{2})"]
TERM = rf"(?i){_L}(EXW|FOB|FCA|FAS|CFR|CIF|CPT|CIP|DAP|DPU|DDP){_R}"
PAYMENT = [r"(?i)[Öö]DEME\s*[Şş]EKLİ\s*:\s*([^-\n]{2,80}?)(?=\s*-|\s*$)", r"(?i)(?:[Öö]deme\s*[Şş]ekli|Payment\s*Terms?|Payment\s*Type)\s*[:\-]?\s*([^-\n]{3,80})"]
ORIGIN = [r"(?i)MALLARIMIZ\s+([^.]+)\.", r"(?i)(?:Men[şŞ]e|Origin|Country\s*of\s*origin)\s*[:\-]?\s*([A-Za-zğüşöçıİĞÜŞÖÇ\s]{3,80})"]
MODES = [r"(?i)(?:Ta[şŞ]ıma|G[öÖ]nderilme|Transport)\s*(?:[Şş]ekli|Mode|Type)?\s*[:\-]?\s*(Karayolu|Denizyolu|Havayolu|Demiryolu|Multimodal)", rf"{_L}(Karayolu|Denizyolu|Havayolu|Demiryolu){_R}"]
PACKAGES = r"(?i)TOPLAM\s*KAP\s*:\s*(\d+)\s*([A-ZÇĞİÖŞÜa-zçğıöşü]+)?"
PACKAGE_COUNT = r"(?i)(?:Kap\s*Adedi|Toplam\s*Kap|Total\s*Packages?|No\.?\s*of\s*Packages?)\s*[:\-]?\s*(\d+)"
GROSS = [r"(?i)BR[Üü]T\s*KG\s*:\s*([\d.,]+)", r"(?i)(?:Br[üÜ]t|Gross)\s*(?:A[ğĞ]ırlık|Weight|KG|kg)?\s*[:\-]?\s*([\d.,]+)"]
NET = [r"(?i)NET\s*KG\s*:\s*([\d.,]+)", r"(?i)(?:Net|Net\s*A[ğĞ]ırlık|Net\s*Weight)\s*[:\-]?\s*([\d.,]+)"]
SELLER_LABELS, BUYER_LABELS = "(?:Satıcı|Seller|Vendor|Tedarik[çÇ]i|G[öÖ]nderen)", "(?:Alıcı|Buyer|Customer|M[üÜ][şŞ]teri|Consignee)"
FLAT_SELLER_LABELS, FLAT_BUYER_LABELS = "(?:Satıcı|Seller|Vendor)", "(?:Alıcı|Buyer|Customer)"
BUYER_END = r"(?i)^(?:[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}$|ETTN\s*:|[Öö]zelle[şŞ]tirme\s*No|Senaryo\s*:|Fatura\s*T[üÜ]r[üÜ])"
SELLER_END = rf"(?i)^e\s*-?\s*fatura|{_L}e\s*-?\s*fatura{_R}|^ETTN\s*:|^Sıra\s*$"
ADDRESS_END = r"(?i)^(?:Tel|Fax|Web\s*Sitesi|E-Posta|Vergi\s*Dairesi|VKN|TİCARESİCİLNO|TİCARETSİCİLNO|TICARETSICILNO|MERSISNO|MERSİSNO)\s*:"
NOISE = r"(?i)^(?:e\s*-?\s*fatura|T\.C\.\s*.*(?:Hazine|Maliye|Gelir)|TASLAK$)"
TAX_NO = [rf"(?i){_L}VKN\s*[:：]\s*(\d{{10,11}}){_R}", rf"(?i){_L}VKN\s*[.:]\s*(\d{{10,11}}){_R}", rf"(?i){_L}VKN\s+(\d{{10,11}}){_R}"]
GOODS_BLOCK, GOODS_END = rf"\n\d{{1,3}}\n[\s\S]*?{_L}Karayolu\s+\d{{12}}{_R}", r"Karayolu\s+\d{12}\z"
#: Words in lower case of which every match of a pattern has one.
NEEDED = {
    DATES[0]: ["tarihi", "date"], CURRENCY: ["eur", "usd", "try", "gbp", "chf", "jpy", "cny"], TOTALS[0]: ["hizmet"], TOTALS[1]: ["toplam", "grand", "denecek"],
    TERM: "exw fob fca fas cfr cif cpt cip dap dpu ddp".split(), PAYMENT[0]: ["deme"], PAYMENT[1]: ["deme", "payment"], ORIGIN[0]: ["mallar"], ORIGIN[1]: ["menş", "origin"], MODES[0]: ["yolu", "multimodal"], MODES[1]: ["yolu"],
    PACKAGES: ["toplam"], PACKAGE_COUNT: ["kap", "package"], GROSS[0]: ["kg"], GROSS[1]: ["brüt", "gross"], NET[0]: ["net"], NET[1]: ["net"],
}
UNITS = "KGM KG NIU C62 SET PCS PCE ADET MTR LTR".split()
MOST_GOODS_LINES = 80


def _like(c: Column, p: str) -> Column:
    return F.regexp_like(c, F.lit(p))


def _first(lines: Column, test: Callable[[Column], Column]) -> Column:
    """Position from 0 of the first line that passes; null if none does."""
    n = F.array_position(F.transform(lines, lambda x: F.coalesce(test(x), F.lit(False))), True)
    return F.when(n > 0, n - 1).cast("int")


def _cut(lines: Column, start: Column, end: Column) -> Column:
    """Lines from start up to end, both from 0."""
    return F.slice(lines, start.cast("int") + 1, F.greatest(F.lit(0), (end - start).cast("int")))


def with_party(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Adds struct(name, address, tax_no) of a party's lines: leading noise is dropped, the first line is the name, the address ends at a labelled line.

    Every array is a column of its own, so that no expression holds another one twice.
    """
    clean, start, rows, rest, upto, body = (F.col(f"_{out}_{n}") for n in ("clean", "start", "rows", "rest", "upto", "body"))
    df = df.withColumn(f"_{out}_clean", F.filter(F.transform(raw, js_trim), lambda x: x != ""))
    df = df.withColumn(f"_{out}_start", F.coalesce(_first(clean, lambda x: ~_like(x, NOISE)), F.size(clean)))
    df = df.withColumn(f"_{out}_rows", _cut(clean, start, F.size(clean)))
    df = df.withColumn(f"_{out}_rest", _cut(rows, F.lit(1), F.size(rows))).withColumn(f"_{out}_body", F.translate(F.array_join(rows, "\n"), "\u00a0\u2007", "  "))
    df = df.withColumn(f"_{out}_upto", _cut(rest, F.lit(0), F.coalesce(_first(rest, lambda x: _like(x, ADDRESS_END)), F.size(rest))))
    tax = F.coalesce(*(F.when(_like(body, p), F.regexp_extract(body, p, 1)) for p in TAX_NO))
    name = F.substring(js_trim(collapse(F.regexp_replace(F.get(rows, F.lit(0)), r"(?i)^Firma\s*Adı\s*:\s*(?=\S)", ""))), 1, 240)
    parts = F.filter(F.transform(upto, lambda x: js_trim(F.regexp_replace(x, r"(?i)^Adres\s*:\s*", ""))), lambda x: x != "")
    address = F.substring(js_trim(F.regexp_replace(F.array_join(parts, " "), f"{JS_SPACE}{{2,}}", " ")), 1, 500)
    return df.withColumn(out, F.struct(F.nullif(name, F.lit("")).alias("name"), F.nullif(address, F.lit("")).alias("address"), tax.alias("tax_no")))


def parties(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds seller and buyer: split at the line that begins with SAYIN; if that is the first, the seller stands after a dated line."""
    keep = df.columns
    lines, at, after, tail, late = (F.col(c) for c in ("_lines", "_at", "_after", "_tail", "_late"))
    none = F.array().cast("array<string>")
    ends = lambda c: _first(c, lambda x: _like(js_trim(x), BUYER_END))
    out = df.withColumn("_lines", F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n"))
    out = out.withColumn("_at", _first(lines, lambda x: _like(js_trim(x), r"(?i)^SAYIN(\s+\S.*)?$")))
    out = out.withColumn("_after", _cut(lines, at + 1, F.size(lines))).withColumn("_tail", _cut(lines, F.coalesce(ends(lines), F.lit(1)), F.size(lines)))
    inline = F.regexp_extract(js_trim(F.get(lines, at)), r"(?i)^SAYIN\s+(.+)$", 1)
    buyer = _cut(after, F.lit(0), F.coalesce(ends(after), F.size(after)))
    out = out.withColumn("_buyer", F.concat(F.when(inline != "", F.array(inline)).otherwise(none), buyer))
    mark = F.coalesce(_first(tail, lambda x: _like(x, r"(?i)^\s*İrsaliye\s*Tarihi\s*:")), _first(tail, lambda x: _like(x, r"(?i)^\s*Fatura\s*Tarihi\s*:")))
    out = out.withColumn("_mark", mark).withColumn("_late", _cut(tail, F.col("_mark") + 1, F.size(tail)))
    out = out.withColumn("_late", _cut(late, F.lit(0), F.coalesce(_first(late, lambda x: _like(js_trim(x), SELLER_END)), F.size(late))))
    out = out.withColumn("_seller", F.when(at > 0, _cut(lines, F.lit(0), at)).otherwise(F.coalesce(late, none)))
    out = with_party(with_party(out, "_seller", "s"), "_buyer", "b")
    out = out.withColumn("_flat_text", js_trim(collapse(F.col(text))))
    label = lambda names, flat: F.substring(F.regexp_replace(F.coalesce(line_after_label(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), names), line_after_label(F.col("_flat_text"), flat)), r"\s{2,}", " "), 1, 240)
    known = lambda c: F.when(at.isNotNull(), F.col(c))
    named = lambda s, names, flat: F.struct(F.coalesce(known(s)["name"], label(names, flat)).alias("name"), known(s)["address"].alias("address"), known(s)["tax_no"].alias("tax_no"))
    out = out.select(*keep, named("s", SELLER_LABELS, FLAT_SELLER_LABELS).alias("seller"), named("b", BUYER_LABELS, FLAT_BUYER_LABELS).alias("buyer"))
    return out.withColumn("buyer_country", country_of_address(F.col("buyer")["address"]))


def with_header_fields(df: DataFrame, flat: str) -> DataFrame:
    """Adds the head, trade, transport and package fields, from the text in one line (a column).

    The first ISO date anywhere comes before labelled dates. Matches that are used more than once are columns of their own first.
    """
    c, low = F.col(flat), F.col("_low")
    df = df.withColumn("_low", F.lower(flat))

    def one(p: str, g: int = 1) -> Column:
        """The group, null without a match. No group is empty, so one search tells both; texts without a word that every match has are not searched."""
        found = F.nullif(F.regexp_extract(c, p, g), F.lit(""))
        needs = NEEDED.get(p)
        return F.when(reduce(or_, (F.contains(low, F.lit(w)) for w in needs)), found) if needs else found

    first = lambda patterns: F.coalesce(*map(one, patterns))
    short = lambda c, n: F.substring(js_trim(c), 1, n)
    again = {"_date": first(DATES), "_total": first(TOTALS), "_gross": first(GROSS), "_net": first(NET)}
    df = df.withColumns(again)
    fields = {
        "invoice_no": js_trim(first(INVOICE_NO)),
        "invoice_date": F.coalesce(one(ISO_DATE), text_to_iso(F.col("_date"))),
        "currency": one(CURRENCY),
        "total_amount": last_separator_amount(F.col("_total")),
        "delivery_term": F.upper(one(TERM)),
        "payment_type": short(F.regexp_replace(first(PAYMENT), "[-_]{3,}", ""), 120),
        "origin": short(first(ORIGIN), 120),
        "transport_mode": first(MODES),
        "total_package": first([PACKAGES, PACKAGE_COUNT]).try_cast("double"),
        "package_type": F.substring(one(PACKAGES, 2), 1, 40),
        "gross_kg": last_separator_amount(F.col("_gross")),
        "net_kg": last_separator_amount(F.col("_net")),
    }
    return df.withColumns(fields).drop(*again, "_low")


def _goods(line_no: Column, hs: Column, description: Column, qty: Column, unit: Column, price: Column, total: Column) -> Column:
    return F.struct(line_no.cast("int").alias("line_no"), hs.alias("hs_code"), description.alias("description"), qty.alias("quantity"), unit.alias("unit"), price.alias("unit_price"), total.alias("line_total"))


def _grown(df: DataFrame, name: str, step: Callable[[Column, Column], dict[str, Column]], names: list[str]) -> DataFrame:
    """Adds fields to the structs of an array, made from the fields they have."""
    return df.withColumn(name, F.transform(name, lambda x, i: F.struct(*(x[n].alias(n) for n in names), *(c.alias(k) for k, c in step(x, i).items()))))


def with_goods_blocks(df: DataFrame, text: str, out: str) -> DataFrame:
    """Goods lines of the blocks `\\n<number>\\n ... Karayolu <12 digits>` of a text."""
    got: list[str] = []

    def grow(df: DataFrame, step: Callable[[Column, Column], dict[str, Column]], *names: str) -> DataFrame:
        df = _grown(df, out, step, list(got))
        got.extend(names)
        return df

    # a block is matched once, and cut by what stands at its ends
    blocks = F.when(F.contains(text, F.lit("Karayolu")), F.regexp_extract_all(text, F.lit(GOODS_BLOCK), F.lit(0))).otherwise(F.when(F.col(text).isNotNull(), F.array().cast("array<string>")))
    df = df.withColumn(out, F.transform(blocks, lambda b: F.struct(F.split_part(b, F.lit("\n"), F.lit(2)).alias("no"), js_trim(F.regexp_replace(F.substring(b, F.length(F.split_part(b, F.lit("\n"), F.lit(2))) + 3, F.length(b)), GOODS_END, "")).alias("body"), F.right(b, F.lit(12)).alias("hs"))))
    got += ["no", "body", "hs"]
    df = grow(df, lambda x, _: {"lines": F.filter(F.transform(F.split(x["body"], "\n"), js_trim), lambda v: v != "")}, "lines")
    df = grow(df, lambda x, _: {"unit_at": _first(x["lines"], lambda v: _like(v, rf"(?i)^Adet{_R}"))}, "unit_at")
    df = grow(df, lambda x, _: {"before": F.when(x["unit_at"] > 0, F.get(x["lines"], x["unit_at"] - 1))}, "before")
    df = grow(df, lambda x, _: {"qty": F.when(_like(x["before"], r"^[\d.,]+$"), quantity(x["before"])), "price": last_separator_amount(F.nullif(F.regexp_extract(x["body"], r"(?i)Adet\s+([\d.,]+)", 1), F.lit("")))}, "qty", "price")
    # `EUR` and an amount on a line, or alone with the amount on the next one; a percentage line is none
    amount = lambda ls: F.transform(ls, lambda v, i: F.when(F.contains(v, F.lit("%")), None).when(_like(v, r"^EUR\s+[\d.,]+\s*$"), F.regexp_extract(v, r"^EUR\s+([\d.,]+)", 1)).when((v == "EUR") & _like(F.get(ls, i + 1), r"^[\d.,]+$"), F.get(ls, i + 1)))
    stop = lambda x: F.when(x["unit_at"].isNotNull(), x["unit_at"] - F.when(x["qty"].isNotNull(), 2).otherwise(1)).otherwise(F.size(x["lines"]))
    df = grow(df, lambda x, _: {"total": F.array_max(F.filter(F.transform(amount(x["lines"]), last_separator_amount), lambda v: v > 1)), "words": _cut(x["lines"], F.lit(0), F.greatest(F.lit(0), stop(x)))}, "total", "words")
    code = lambda v: _like(v, "^[A-Z0-9]{10,28}$") & _like(v, "[0-9]") & _like(v, "[A-Z]")
    df = grow(df, lambda x, _: {"upto": F.coalesce(_first(x["words"], lambda v: ~code(v) & _like(v, rf"(?i)^EUR{_R}")), F.size(x["words"]))}, "upto")
    df = grow(df, lambda x, _: {"text": F.substring(js_trim(F.regexp_replace(F.array_join(F.filter(_cut(x["words"], F.lit(0), x["upto"]), lambda v: ~code(v)), " "), r"\s{2,}", " ")), 1, 500)}, "text")
    return df.withColumn(out, F.transform(out, lambda x: _goods(x["no"], x["hs"], F.coalesce(F.nullif(x["text"], F.lit("")), F.substring(x["body"], 1, 400)), x["qty"], F.lit("Adet"), x["price"], x["total"])))


def with_goods_rows(df: DataFrame, text: str, out: str) -> DataFrame:
    """Goods lines of single text lines, 80 at most: after a 10 to 12 digit code a description, a known unit perhaps, and up to three numbers: quantity, price, total."""
    tokens = lambda v: F.filter(F.split(v, f"{JS_SPACE}+"), lambda t: t != "")
    df = df.withColumn(out, F.transform(F.split(text, "\n"), lambda v: F.struct(tokens(v).alias("tokens"), F.regexp_extract(v, rf"{_L}(\d{{10,12}}){_R}", 1).alias("code"))))
    df = df.withColumn(out, F.slice(F.filter(out, lambda x: (x["code"] != "") & F.array_contains(x["tokens"], x["code"])), 1, MOST_GOODS_LINES))
    # what follows the code, from the right: the first number is the line's last
    df = df.withColumn(out, F.transform(out, lambda x: F.struct(x["code"].alias("code"), F.reverse(_cut(x["tokens"], F.array_position(x["tokens"], x["code"]).cast("int"), F.size(x["tokens"]))).alias("right"))))
    value = lambda v: F.when(_like(v, r"^[\d.,-]+$"), last_separator_amount(v))
    df = _grown(df, out, lambda x, _: {"nums": F.transform(F.slice(x["right"], 1, 3), value)}, ["code", "right"])
    df = _grown(df, out, lambda x, _: {"n": F.coalesce(_first(x["nums"], lambda v: v.isNull()), F.size(x["nums"]))}, ["code", "right", "nums"])
    df = _grown(df, out, lambda x, _: {"unit": F.regexp_replace(F.upper(F.get(x["right"], x["n"])), "[^A-Z0-9]", "")}, ["code", "right", "nums", "n"])

    def line(x: Column, i: Column) -> Column:
        known = F.coalesce(x["unit"].isin(*UNITS), F.lit(False))
        num = lambda k: F.when(x["n"] > k, F.get(x["nums"], F.lit(k)))
        rest = F.array_join(F.reverse(_cut(x["right"], x["n"] + known.cast("int"), F.size(x["right"]))), " ")
        return _goods(i + 1, x["code"], F.substring(rest, 1, 500), num(2), F.when(known, x["unit"]), num(1), num(0))

    return df.withColumn(out, F.transform(out, line))


def goods_lines(df: DataFrame, keep: list[str], goods: str) -> DataFrame:
    """One row for each goods line of an array, with the columns to keep.

    The outer explode is on purpose: a plain one asks for arrays that are not empty, and Spark would push that question below all
    steps that make the array and so work them out twice.
    """
    return df.select(*keep, F.explode_outer(goods).alias("_line")).where("_line is not null").select(*keep, "_line.*")


def extract_invoices(df: DataFrame, text: str = "text") -> DataFrame:
    """All fields of invoice texts: parties, head, trade, transport, packages, goods lines (of blocks, or of single lines without one).

    A null text gives null fields. Columns that begin with an underscore are used inside.
    """
    out = parties(df, text).withColumn("_flat", js_trim(collapse(F.col(text)))).withColumn("_text", F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")))
    out = with_header_fields(out, "_flat")
    out = with_goods_rows(with_goods_blocks(out, "_text", "_blocks"), "_text", "_rows")
    return out.withColumn("goods", F.when(F.size("_blocks") > 0, F.col("_blocks")).otherwise(F.col("_rows"))).drop("_flat", "_text", "_blocks", "_rows")
