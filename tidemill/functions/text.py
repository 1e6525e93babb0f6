"""Text functions. All are built-in expressions, so they stay in generated code and push through plans."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript sees it: Java's \s lacks the no-break and other Unicode spaces.
JS_SPACE = r"[\s\u000B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

# Turkish letters and their ASCII folds; words that end an address but are no country; placeholders of mail templates.
TURKISH = ("ığüşöç", "igusoc")
PYTHON_FOLD = ("İÜŞĞÖÇ", "IUSGOC")
NOT_COUNTRY = "VESZPREM ISTANBUL İSTANBUL ANKARA İZMİR IZMIR KONYA BURSA ADANA HRSZ UTCA".split()
OCR_WORDS = {"KARAYOIU": "KARAYOLU", "KARAY0LU": "KARAYOLU", "KARAY0IU": "KARAYOLU"}


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(c, f"{JS_SPACE}+", " ")


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    t = js_trim(c.cast("string"))
    return F.when(t != "", t)


def is_empty(c: Column) -> Column:
    """Null or empty text. Zero and false are values."""
    return c.isNull() | (c.cast("string") == "")


def is_empty_cell(c: Column) -> Column:
    """Empty cells of spreadsheets: blank or a dash."""
    return F.coalesce(js_trim(c.cast("string")), F.lit("")).isin("", "-")


def turkish_lower(c: Column) -> Column:
    """Lower case by Turkish rules: dotless capital I gives ı, dotted İ gives i."""
    return F.lower(F.translate(c, "Iİ", "ıi"))


def fold_key(c: Column) -> Column:
    """Case-folded trimmed key by which records are told apart."""
    return turkish_lower(js_trim(c))


def _accents() -> tuple[str, str]:
    """Latin letters whose canonical decomposition begins with an ASCII letter, and those letters."""
    parts = {chr(i): unicodedata.normalize("NFD", chr(i)) for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00)) for i in range(lo, hi)}
    known = {c: d[0] for c, d in parts.items() if len(d) > 1 and d[0].isascii()}
    return "".join(known), "".join(known.values())


def fold_header(c: Column) -> Column:
    """Header text in lower case, Turkish letters as ASCII, accents of Latin letters and combining marks dropped."""
    t = F.translate(turkish_lower(js_trim(c)), *TURKISH)
    return F.regexp_replace(F.translate(t, *_accents()), r"[\u0300-\u036F]", "")


def fold_upper(c: Column) -> Column:
    """Trimmed upper case with Turkish letters as ASCII, as the spatial parser compares words."""
    return F.translate(F.upper(F.trim(F.coalesce(c, F.lit("")))), *PYTHON_FOLD)


def repair_transport(c: Column) -> Column:
    """Common misreadings of the word for road transport."""
    out = fold_upper(c)
    for wrong, right in OCR_WORDS.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def repair_digits(c: Column) -> Column:
    """Letters that were read for a zero."""
    return F.translate(F.coalesce(c.cast("string"), F.lit("")), "OoD", "000")


def bare_code(c: Column) -> Column:
    """A code without dashes, dots and spaces."""
    return F.translate(fold_upper(c), "-. ", "")


def escape_pattern(c: Column) -> Column:
    """Regular-expression metacharacters escaped."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def escape_xml(c: Column) -> Column:
    """The five XML escapes, ampersand first."""
    for raw, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        c = F.replace(c, F.lit(raw), F.lit(f"&{name};"))
    return c


def initials(c: Column) -> Column:
    """Two letters for a name: ?? without a word, the first two of a single word, else those of the first two words."""
    words = F.filter(F.split(js_trim(F.coalesce(c, F.lit(""))), f"{JS_SPACE}+"), lambda w: w != "")
    two = F.concat(F.substring(F.get(words, F.lit(0)), 1, 1), F.substring(F.get(words, F.lit(1)), 1, 1))
    return F.upper(F.when(F.size(words) == 0, "??").when(F.size(words) == 1, F.substring(F.get(words, F.lit(0)), 1, 2)).otherwise(two))


def padded_ref(prefix: Column, year: Column, number: Column) -> Column:
    """PREFIX-YYYY-0001; longer numbers are not cut."""
    text = number.cast("string")
    return F.concat_ws("-", prefix, year.cast("string"), F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text))


def tail_ref(ident: Column) -> Column:
    """A reference from the last six hex digits of an id; DCL-000 without any."""
    tail = F.upper(F.substring(F.regexp_replace(ident, "[^a-fA-F0-9]", ""), -6, 6))
    return F.concat(F.lit("DCL-"), F.when(tail == "", "000").otherwise(tail))


def first_match(text: Column, patterns: list[str], group: int = 1) -> Column:
    """The first pattern's group, tried on the text in one line and then on the text as it is; null if none matches."""
    flat = collapse(text)
    tries = []
    for p in patterns:
        for t in (flat, text):
            tries.append(F.when(F.regexp_like(t, F.lit(p)), F.regexp_extract(t, p, group)))
    return F.coalesce(*tries)


def line_after_label(text: Column, label: str) -> Column:
    """What follows a label, a colon or dash perhaps between, on its line: 3 to 240 characters."""
    p = f"(?i){label}\\s*[:\\-]?\\s*([^\\n]{{3,240}})"
    return F.when(F.regexp_like(text, F.lit(p)), js_trim(F.regexp_extract(text, p, 1)))


def country_of_address(c: Column) -> Column:
    """The last word of an address if it can be a country: 3 to 56 letters and no known town; else null."""
    last = F.regexp_replace(F.element_at(F.split(js_trim(collapse(F.coalesce(c, F.lit("")))), " "), -1), "[,;:.]+$", "")
    ok = (F.length(last) >= 3) & (F.length(last) <= 56) & F.regexp_like(last, F.lit(r"^\p{L}+$")) & ~F.upper(last).isin(*NOT_COUNTRY)
    return F.when(ok, last)


def transport_code(c: Column) -> Column:
    """Transport mode by the words it holds; road if none."""
    t = F.lower(F.coalesce(c, F.lit("")))
    has = lambda *w: F.regexp_like(t, F.lit("|".join(w)))
    return F.when(has("deniz", "sea"), "denizyolu").when(has("hava", "air"), "havayolu").when(has("kara", "road"), "karayolu").otherwise("karayolu")


def placeholders_in(c: Column, names: list[str]) -> Column:
    """Which {placeholders} a template holds, in the order of `names`."""
    return F.filter(F.array(*(F.lit("{" + n + "}") for n in names)), lambda p: F.contains(c, p))


def clean_array(c: Column) -> Column:
    """Elements as trimmed text, without empty ones; null is an empty array."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: js_trim(x.cast("string"))), lambda x: F.coalesce(x, F.lit("")) != "")


def joined(separator: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty, with a separator between."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), separator)


def at_path(c: Column, path: str) -> Column:
    """A dotted path into JSON text; null where a step is missing or no object."""
    return F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path.split(".")))


def part_of(c: Column, separator: str, number: int) -> Column:
    return F.trim(F.split_part(c, F.lit(separator), F.lit(number)))


def product_code(c: Column) -> Column:
    """struct(line_no, full, short) of the first dotted code of a text; codes that begin with AG. are known by their last part."""
    p = r"(?i)(?:(\d{1,3})\s+)?((?:[A-Z]{2,5}\.)+[A-Z0-9]+(?:\.[A-Z0-9]+)*)"
    c = F.coalesce(c, F.lit(""))
    full = F.when(F.regexp_like(c, F.lit(p)), F.upper(F.regexp_extract(c, p, 2)))
    short = F.when(F.startswith(full, F.lit("AG.")), F.element_at(F.split(full, r"\."), -1)).otherwise(full)
    return F.struct(F.regexp_extract(c, p, 1).try_cast("int").alias("line_no"), full.alias("full"), short.alias("short"))
