"""Items of invoices from word boxes.

Words stay rows. What is asked of a word (its folded text, its money texts and so on) is worked out once for each. The columns of a
page are one summary a page. A tariff-code candidate meets the words of its own band through a join on page and band of y,
and the words of its description through another, so that no page is copied to its items. Words are often exploded from smaller rows, so
these joins sort both sides and broadcast none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import comma_decimal, money_values, repaired_quantity, resplit_quantity_price
from ..functions.text import bare_code, fold_upper, product_code, repair_digits, repair_transport
from ..operators.joins import by_merge

# Geometry on the common canvas, words of the fields, header names of the columns.
CANVAS = (1700.0, 2500.0)
BAND, RIGHT_SIDE, FIRST_PAGE_TOP = 55.0, 1000.0, 650.0
DESCRIPTION_X, ABOVE, BELOW, NEXT_GAP = (90.0, 430.0), 35.0, 95.0, 5.0
TERMS = "EXW FCA FOB CIF CFR DAP DPU DDP FAS CPT CIP".split()
MODES = {"KARAYOLU": "Karayolu", "ROAD": "Karayolu", "DENIZYOLU": "Denizyolu", "SEA": "Denizyolu", "HAVAYOLU": "Havayolu", "AIR": "Havayolu", "DEMIRYOLU": "Demiryolu", "RAIL": "Demiryolu"}
CURRENCIES = {"EUR": "EUR", "GBP": "GBP", "TL": "TRY", "TRY": "TRY", "USD": "USD"}
UNITS = "ADET ADE PCS KG SET MT".split()
STOP_WORDS = "VERGI MUAFIYET ODEME KOSULU ACIKLAMALAR TOPLAM".split()
SKIP_WORDS = "MALZEME HIZMET KODU ACIKLAMASI ACIKLAMA SATIR ACIKLAMAS! AGIKLAMASI AGIKLAMAS!".split()
SKIP_COUNTRIES = "GERMANY MOROCCO U.K UK TURKEY TURKIYE FRANCE ITALY INDIA POLAND CHINA".split()
HEADERS = {"PRODUCT": ["MALZEME", "HIZMET KODU", "MAL HIZMET", "ITEM CODE", "PRODUCT CODE"], "QTY": ["MIKTAR", "QTY", "QUANTITY"], "PRICE": ["BIRIM FIYAT", "UNIT PRICE", "PRICE"], "AMOUNT": ["MALZEME HIZMET TUTARI", "MAL HIZMET TUTARI", "TUTAR", "AMOUNT", "TOTAL"], "GTIP": ["GTIP", "HS CODE", "TARIFF"]}
WIDTHS = {"GTIP": 180.0, "PRODUCT": 160.0, "QTY": 100.0, "PRICE": 110.0, "AMOUNT": 150.0}
CONFIDENCE = {"header": 0.8, "GTIP": 0.75, "PRODUCT": 0.75, "QTY": 0.7, "PRICE": 0.55, "AMOUNT": 0.55}
DOTTED = r"(?i)(?:[A-Z]{2,5}\.)+[A-Z0-9]+(?:\.[A-Z0-9]+)*"
NUMBER = r"\d{1,6}(?:\.\d{3})*"
_UNIT = "|".join(UNITS)


def _like(c: Column, p: str) -> Column:
    return F.regexp_like(c, F.lit(p))


def pages_of(words: DataFrame) -> DataFrame:
    """doc_id, page, words: an array of structs (y0, x0, pos, text, x1, y1, score) in reading order."""
    return words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "pos", "text", "x1", "y1", "score"))).alias("words"))


def by_x(words: Column) -> Column:
    return F.array_sort(words, lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).when(a["pos"] < b["pos"], -1).otherwise(1))


def tariff_codes(text: Column) -> Column:
    """struct(gtip, exact, method, needs_review) of every run of 10 to 12 digits; shorter ones are filled by zeros."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d{10,12})"), F.lit(1))
    method = lambda n: F.when(n == 12, "exact").when(n == 11, "padded_zero_11").otherwise("padded_zero_10")
    return F.transform(runs, lambda r: F.struct(F.rpad(r, 12, "0").alias("gtip"), (F.length(r) == 12).alias("exact"), method(F.length(r)).alias("method"), (F.length(r) != 12).alias("needs_review")))


def candidates(pages: DataFrame) -> DataFrame:
    """One row for each tariff code in the right part of a page; on the first page below the head."""
    word = F.filter("words", lambda w: (w["x0"] > RIGHT_SIDE) & ((F.col("page") != 1) | (w["y0"] >= FIRST_PAGE_TOP)))
    found = pages.select("doc_id", "page", "words", F.explode(word).alias("w")).select("*", F.posexplode(tariff_codes(F.col("w.text"))).alias("run", "c"))
    return found.select("doc_id", "page", "words", "w", "run", "c.*")


def pdf_type(words: Column, images: Column) -> Column:
    return F.when((words == 0) & (images > 0), "IMAGE_BASED_PDF").when((words < 30) & (images > 0), "MOSTLY_IMAGE_PDF").otherwise("DIGITAL_TEXT_PDF")


def _plain(folded: Column) -> Column:
    return F.trim(F.translate(folded, "/\n", "  "))


def span(field: str, low: Column, high: Column, method: str, confidence: float) -> Column:
    return F.struct(F.lit(field).alias("field"), low.cast("double").alias("x_min"), high.cast("double").alias("x_max"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))


def _median(xs: Column) -> Column:
    s, n = F.array_sort(xs), F.size(xs)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def column_of(words: Column, field: str) -> Column:
    """The span of a column: by its header word, else by the words that look like its values; the header is surer, so it wins."""
    plain = lambda w: _plain(fold_upper(w["text"]))
    head = F.get(F.filter(words, lambda w: reduce(lambda a, b: a | b, (F.contains(plain(w), F.lit(h)) for h in HEADERS[field]))), F.lit(0))
    by_head = F.when(head.isNotNull(), span(field, head["x0"] - 20, head["x1"] + 20, "header", CONFIDENCE["header"]))
    centre = lambda w: (w["x0"] + w["x1"]) / 2
    if field == "QTY":
        near = F.flatten(F.transform(words, lambda w, i: F.when(_like(plain(w), _UNIT), F.slice(words, F.greatest(F.lit(1), i - 2), F.least(i, F.lit(3)) + 4)).otherwise(F.array().cast(_WORDS))))
        hits = F.filter(near, lambda w: _like(plain(w), r"^\d{1,6}$"))
    elif field == "GTIP":
        hits = F.filter(words, lambda w: _like(w["text"], r"\d{10,12}"))
    elif field == "PRODUCT":
        hits = F.filter(words, lambda w: _like(w["text"], r"(?i)[A-Z]{1,5}\.?\s*[A-Z]{1,5}\.?\s*\d+") | _like(F.trim(w["text"]), r"^\d{5,10}$"))
    else:
        hits = F.filter(words, lambda w: F.size(money_values(w["text"])) > 0)
    xs, half = F.transform(hits, centre), WIDTHS[field] / 2
    money = field in ("PRICE", "AMOUNT")
    x = {"PRICE": F.array_min(xs), "AMOUNT": F.array_max(xs)}[field] if money else _median(xs)
    by_values = F.when(F.size(xs) >= (4 if money else 2), span(field, F.greatest(F.lit(0.0), x - half), x + half, "pattern", CONFIDENCE[field]))
    return F.coalesce(by_head, by_values)


_WORDS = "array<struct<y0:double,x0:double,pos:int,text:string,x1:double,y1:double,score:double>>"


def first_hit(keys: list[str], text: Column, values: dict[str, str] | None = None) -> Column:
    return F.coalesce(*(F.when(F.contains(text, F.lit(k)), F.lit(values[k] if values else k)) for k in keys))


Text = Callable[[Column], Column]


def _folded(w: Column) -> Column:
    return fold_upper(w["text"])


def currency_of(line: Column, t: Text = _folded) -> Column:
    """Of the first word that has one; several in one word are taken in the order listed. t gives a word's folded text."""
    one = lambda w: F.coalesce(*(F.when(_like(t(w), rf"\b{k}\b"), F.lit(v)) for k, v in CURRENCIES.items()))
    return F.get(F.array_compact(F.transform(line, one)), F.lit(0))


def quantity_of(line: Column, t: Text = _folded) -> Column:
    """struct(quantity, unit): both in one box, or a number among the three words on each side of a unit word, the nearest."""
    both = F.get(F.filter(line, lambda w: _like(t(w), rf"\b({_UNIT})\b") & _like(t(w), NUMBER)), F.lit(0))
    whole = F.when(both.isNotNull(), F.struct(F.regexp_extract(t(both), f"({NUMBER})", 1).alias("quantity"), F.regexp_extract(t(both), rf"\b({_UNIT})\b", 1).alias("unit")))

    def beside(w: Column, i: Column) -> Column:
        numbers = F.filter(F.slice(line, F.greatest(F.lit(1), i - 2), F.least(i, F.lit(3)) + 4), lambda n: _like(t(n), f"^{NUMBER}$"))
        best = F.get(F.array_sort(F.transform(numbers, lambda n: F.struct((F.abs(n["x0"] - w["x0"]) + F.abs(n["y0"] - w["y0"])).alias("d"), n["x0"].alias("x0"), n["pos"].alias("pos"), t(n).alias("t")))), F.lit(0))
        return F.when(_like(t(w), f"^({_UNIT})$") & best.isNotNull(), F.struct(best["t"].alias("quantity"), t(w).alias("unit")))

    return F.coalesce(whole, F.get(F.array_compact(F.transform(line, beside)), F.lit(0)))


def joined_quantity(text: Column) -> Column:
    return joined_in(fold_upper(text))


def joined_in(u: Column) -> Column:
    """struct(quantity, unit, unit_price) of a box in which they run together, by its folded text; three patterns in order."""
    made = lambda p, q, n, a: F.when(_like(u, p), F.struct(F.regexp_extract(u, p, q).alias("quantity"), (F.regexp_extract(u, p, n) if n else F.lit(None).cast("string")).alias("unit"), F.regexp_extract(u, p, a).alias("unit_price")))
    return F.coalesce(made(rf"(\d{{1,5}})\s*({_UNIT})\s*(\d{{1,3}},\d{{2,4}})", 1, 2, 3), made(rf"({_UNIT})\s*(\d{{1,5}})(\d{{1,3}},\d{{2,4}})", 2, 1, 3), made(r"\b(\d{1,3})(\d{1,3},\d{2,4})\b", 1, 0, 2))


def price_and_amount(line: Column, quantity: Column) -> Column:
    # no money text goes over the end of a word, so the words are read as one text
    return pair_of_money(money_values(repair_digits(F.array_join(line["text"].cast("array<string>"), "\n"))), quantity)


def pair_of_money(money: Column, quantity: Column) -> Column:
    """struct(price, amount): the first ordered pair of money texts, unlike each other, with quantity times price near the amount.

    Quantity and texts are read as numbers once, before they meet in pairs.
    """
    read = F.transform(money, lambda m: F.struct(m.alias("text"), comma_decimal(m).alias("n")))
    fits = lambda q, p: lambda a: (F.abs(q * p["n"] - a["n"]) < 0.05) & (a["text"] != p["text"])
    pair = lambda x: lambda p: F.transform(F.filter(x["read"], fits(x["q"], p)), lambda a: F.struct(p["text"].alias("price"), a["text"].alias("amount")))
    known = lambda x: F.when(x["q"] != 0, F.get(F.flatten(F.transform(x["read"], pair(x))), F.lit(0)))
    return F.get(F.transform(F.array(F.struct(comma_decimal(quantity).alias("q"), read.alias("read"))), known), F.lit(0))


def best_amount(money: Column, quantity: Column, price: Column) -> Column:
    """The first money text near quantity times price, else the last that is not zero, else the last."""
    fits = F.filter(money, lambda m: F.abs(comma_decimal(m) - comma_decimal(quantity) * comma_decimal(price)) < 0.05)
    some = F.filter(money, lambda m: comma_decimal(m) != 0)
    return F.coalesce(F.get(fits, F.lit(0)), F.get(some, F.size(some) - 1), F.get(money, F.size(money) - 1))


def word_features(words: DataFrame) -> DataFrame:
    """Words with what items ask of them: t trimmed, f folded, v as values are compared, money (misread zeros repaired) and money_read."""
    text = F.col("text")
    return words.withColumns({"t": F.trim(text), "f": fold_upper(text), "v": F.translate(fold_upper(repair_digits(text)), ".,", ""), "money": money_values(repair_digits(text)), "money_read": money_values(text)})


def page_columns(words: DataFrame) -> DataFrame:
    """doc_id, page and col_GTIP, col_PRODUCT, col_QTY, col_PRICE, col_AMOUNT: the span of each column (null where none is seen), one row a page, from word_features.

    As column_of says it of an array: the first header word, else the middle of the words that look like values, whose median is
    exact. Windows and groups are a page each.
    """
    in_order = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "pos").rowsBetween(-3, 3)
    plain = _plain(F.col("f"))
    near = F.sum(_like(plain, _UNIT).cast("int")).over(in_order)
    w = words.select("doc_id", "page", "y0", "x0", "pos", "x1", "text", "t", plain.alias("plain"), F.size("money_read").alias("n_money"), near.alias("near"), ((F.col("x0") + F.col("x1")) / 2).alias("centre"))
    hits = {
        "GTIP": _like(F.col("text"), r"\d{10,12}"), "PRODUCT": _like(F.col("text"), r"(?i)[A-Z]{1,5}\.?\s*[A-Z]{1,5}\.?\s*\d+") | _like(F.col("t"), r"^\d{5,10}$"),
        "QTY": _like(F.col("plain"), r"^\d{1,6}$") & (F.col("near") > 0), "PRICE": F.col("n_money") > 0, "AMOUNT": F.col("n_money") > 0,
    }
    aggs = []
    for field, hit in hits.items():
        heads = reduce(lambda a, b: a | b, (F.contains("plain", F.lit(h)) for h in HEADERS[field]))
        x = F.when(hit, F.col("centre"))
        # a number counts once for every unit word that it is near to
        middle = {"PRICE": F.min(x), "AMOUNT": F.max(x), "QTY": F.percentile(x, 0.5, F.greatest("near", F.lit(1)))}.get(field, F.percentile(x, 0.5))
        n = F.sum(F.when(hit, F.col("near"))) if field == "QTY" else F.count_if(hit)
        aggs += [F.min(F.when(heads, F.struct("y0", "x0", "pos", "x1"))).alias(f"head_{field}"), middle.alias(f"x_{field}"), n.alias(f"n_{field}")]
    found = w.groupBy("doc_id", "page").agg(*aggs)

    def column(field: str) -> Column:
        head, x, half, least = F.col(f"head_{field}"), F.col(f"x_{field}"), WIDTHS[field] / 2, 4 if field in ("PRICE", "AMOUNT") else 2
        by_values = F.when(F.col(f"n_{field}") >= least, span(field, F.greatest(F.lit(0.0), x - half), x + half, "pattern", CONFIDENCE[field]))
        return F.coalesce(F.when(head.isNotNull(), span(field, head["x0"] - 20, head["x1"] + 20, "header", CONFIDENCE["header"])), by_values)

    return found.select("doc_id", "page", *(column(f).alias(f"col_{f}") for f in hits))


def lines_at(rows: DataFrame, words: DataFrame, reach: float, value: Column, name: str) -> DataFrame:
    """rows (doc_id, page, y, at, run and others) with the array of `value` of the words of their page whose y0 is within reach, in order.

    A join on page and band of y: words are dealt to their own band and its two neighbours.
    """
    keys = ["doc_id", "page", "y", "at", "run"]
    band = F.floor(F.col("y0") / reach).cast("long")
    dealt = words.select("doc_id", "page", "y0", value.alias("word"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    met = rows.withColumn("band", F.floor(F.col("y") / reach).cast("long")).join(by_merge(dealt), ["doc_id", "page", "band"]).where(F.abs(F.col("y0") - F.col("y")) <= reach)
    others = [c for c in rows.columns if c not in keys]
    return met.groupBy(*keys).agg(*(F.first(c).alias(c) for c in others), F.array_sort(F.collect_set("word")).alias(name))


def value_box(line: Column, value: Column, y: Column, column: Column, exact: bool) -> Column:
    """The box of the word of a band with a value, in the column if there is one: least distance in y, then from the column's left edge, then pos."""
    v = F.translate(fold_upper(value), ".,", "")
    inside = lambda w: column.isNull() | ((w["x0"] >= column["x_min"]) & (w["x0"] <= column["x_max"]))
    hits = F.filter(line, lambda w: inside(w) & ((w["v"] == v) if exact else F.contains(w["v"], v)))
    near = F.transform(hits, lambda w: F.struct(F.abs(w["y0"] - y).alias("dy"), F.coalesce(F.abs(w["x0"] - column["x_min"]), w["x0"]).alias("dx"), w["pos"].alias("pos"), F.array(w["x0"], w["y0"], w["x1"], w["y1"]).alias("box")))
    return F.when(v != "", F.array_min(near)["box"])


def with_descriptions(items: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """items (doc_id, page, y, at, run, product_code) with description: the words of its column from the product's row to the next product.

    The product's row is that of the first word of the page that holds the code, found in the page's text as one string. Headers, numbers
    and the code itself are left out, and all from a stop word on. Words meet items by a join on page and band of y.
    """
    keys = ["doc_id", "page", "y", "at", "run"]
    code, y, mark, band = F.col("product_code"), F.col("y"), "\x01", 100.0
    on_page = items.join(by_merge(pages), ["doc_id", "page"])
    at = F.call_function("instr", F.col("page_text"), fold_upper(code))
    ahead = F.substring(F.col("page_text"), F.lit(1), at)
    own = F.when(code.isNotNull() & (at > 0), F.get("page_ys", F.length(ahead) - F.length(F.replace(ahead, F.lit(mark), F.lit("")))))
    on_page = on_page.withColumn("top", F.coalesce(own, y)).drop("page_text", "page_ys")
    below = F.array_min(F.filter("page_codes", lambda d: d > F.col("top")))
    on_page = on_page.withColumn("bottom", F.when(F.coalesce(below, F.lit(0.0)) != 0, below - NEXT_GAP).otherwise(F.col("top") + BELOW)).drop("page_codes")
    bands = F.sequence(F.floor((F.col("top") - ABOVE) / band).cast("long"), F.floor(F.col("bottom") / band).cast("long"))
    others = [c for c in items.columns if c not in keys]
    spread = on_page.select(*keys, F.struct(*others).alias("item"), "top", "bottom", F.explode(F.when(F.col("bottom") >= F.col("top") - ABOVE, bands).otherwise(F.array(F.lit(0).cast("long")))).alias("band"))
    rows = words.where((F.col("x0") >= DESCRIPTION_X[0]) & (F.col("x0") <= DESCRIPTION_X[1]) & (F.col("t") != "")).select(F.col("doc_id").alias("w_doc"), F.col("page").alias("w_page"), F.floor(F.col("y0") / band).cast("long").alias("w_band"), F.struct("y0", "x0", "pos", "f", "t").alias("word"))
    near = (F.col("doc_id") == F.col("w_doc")) & (F.col("page") == F.col("w_page")) & (F.col("band") == F.col("w_band")) & (F.col("word.y0") >= F.col("top") - ABOVE) & (F.col("word.y0") < F.col("bottom"))
    met = spread.join(by_merge(rows), near, "left").groupBy(*keys).agg(F.first("item").alias("item"), F.array_sort(F.collect_set("word")).alias("rows"))
    kept = F.filter("rows", lambda w: ~w["f"].isin(*SKIP_WORDS, *SKIP_COUNTRIES) & ~F.coalesce(bare_code(F.col("item.product_code")) == F.translate(w["f"], "-. ", ""), F.lit(False)) & ~_like(w["f"], r"^\d{1,3}$"))
    met = met.withColumn("rows", kept)
    stop = F.array_position(F.transform("rows", lambda w: w["f"].isin(*STOP_WORDS)), True)
    upto = F.when(stop > 0, F.slice("rows", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("rows"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(upto, lambda w: w["t"]), " "), r"\s+", " "))
    return met.withColumn("description", F.when(text != "", text)).select(*keys, "item.*", "description")


def extract_items(words: DataFrame) -> DataFrame:
    """One row for each tariff-code candidate of each document, numbered by page and place. Words that repeat in all their columns count once."""
    from ..operators.scans import numbered

    w = word_features(words)
    right = (F.col("x0") > RIGHT_SIDE) & ((F.col("page") != 1) | (F.col("y0") >= FIRST_PAGE_TOP))
    c = w.where(right).select("doc_id", "page", F.col("y0").alias("y"), F.col("pos").alias("at"), F.array("x0", "y0", "x1", "y1").alias("gtip_box"), F.posexplode(tariff_codes(F.col("text"))).alias("run", "c"))
    c = lines_at(c.select("doc_id", "page", "y", "at", "run", "gtip_box", "c.gtip"), w, BAND, F.struct("x0", "pos", "y0", "x1", "y1", "t", "f", "v", "money", "money_read"), "line")
    y = F.col("y")
    texts, folded = F.transform("line", lambda w: w["t"]), F.transform("line", lambda w: w["f"])
    c = c.withColumns({"raw_line": F.array_join(texts, " "), "joined": F.array_join(folded, " "), "road": F.array_join(F.transform(folded, repair_transport), " "), "digits": F.get(F.filter(texts, lambda t: _like(t, r"^\d{5,10}$")), F.lit(0)),
                       "q": quantity_of(F.col("line"), lambda w: w["f"]), "currency": currency_of(F.col("line"), lambda w: w["f"]), "read": F.flatten(F.transform("line", lambda w: w["money_read"])), "repaired": F.flatten(F.transform("line", lambda w: w["money"]))})
    c = c.withColumns({"code": product_code(F.col("raw_line")), "delivery_term": first_hit(TERMS, F.col("joined")), "transport_mode": first_hit(list(MODES), F.col("road"), MODES), "pa": pair_of_money(F.col("repaired"), F.col("q.quantity")), "some": F.filter("read", lambda m: comma_decimal(m) != 0)})
    c = c.withColumns({"product_code": F.coalesce("code.short", "digits"), "product_code_full": F.coalesce("code.full", "digits"), "unit_price": F.coalesce("pa.price", F.get("some", F.lit(0))), "amount": F.coalesce(F.col("pa.amount"), F.when(F.size("some") >= 2, F.get("some", F.size("some") - 1)))})
    split = F.get(F.array_compact(F.transform(folded, joined_in)), F.lit(0))
    c = c.withColumn("s", F.when(F.col("q.quantity").isNull() | F.col("unit_price").isNull(), split))
    c = c.withColumns({"quantity": F.coalesce("q.quantity", "s.quantity"), "unit": F.coalesce(F.col("q.unit"), F.col("s.unit"), F.when(F.col("s").isNotNull(), "ADET")), "unit_price": F.coalesce("unit_price", "s.unit_price")})
    c = c.withColumn("amount", F.coalesce(F.col("amount"), F.when(F.col("quantity").isNotNull() & F.col("unit_price").isNotNull(), best_amount(F.col("read"), F.col("quantity"), F.col("unit_price")))))
    c = c.withColumn("r", resplit_quantity_price(F.col("quantity"), F.col("unit_price"), F.col("amount")))
    c = c.withColumn("p", repaired_quantity(F.col("r.quantity"), F.col("r.unit_price"), F.col("amount")))
    c = c.withColumns({"quantity": F.col("p.quantity"), "unit_price": F.col("r.unit_price"), "needs_review": F.col("r.unsure") & F.col("p.unsure")})

    dotted = _like(F.col("text"), DOTTED)
    order = F.array_sort(F.collect_list(F.struct("y0", "x0", "pos", "f")))
    texts_of = w.groupBy("doc_id", "page").agg(order.alias("ws"), F.collect_set(F.when(dotted, F.col("y0"))).alias("page_codes"))
    texts_of = texts_of.select("doc_id", "page", F.array_join(F.transform("ws", lambda x: x["f"]), "\x01").alias("page_text"), F.transform("ws", lambda x: x["y0"]).alias("page_ys"), "page_codes")
    c = c.join(by_merge(page_columns(w)), ["doc_id", "page"])
    boxes = F.struct(F.col("gtip_box").alias("gtip"), *(value_box(F.col("line"), F.col(v), y, F.col(f"col_{f}"), e).alias(v) for v, f, e in (("product_code", "PRODUCT", False), ("quantity", "QTY", True), ("unit_price", "PRICE", True), ("amount", "AMOUNT", True))))
    c = c.withColumn("boxes", boxes).select("doc_id", "page", "y", "at", "run", "gtip", "product_code", "product_code_full", "currency", "delivery_term", "transport_mode", "quantity", "unit", "unit_price", "amount", "needs_review", "raw_line", "boxes")
    c = with_descriptions(c, w, texts_of)
    return numbered(c, ["doc_id"], [F.col("page"), y, F.col("at"), F.col("run")]).withColumnsRenamed({"y": "y0", "at": "pos"})


def as_source(items: DataFrame) -> DataFrame:
    """Per document: head fields of the first item and goods lines, as an extracted source."""
    from ..functions.numbers import last_separator_amount as n

    line = F.struct("line_no", F.col("gtip").alias("hs_code"), "description", n(F.col("quantity")).alias("quantity"), "unit", n(F.col("unit_price")).alias("unit_price"), n(F.col("amount")).alias("line_total"), "needs_review")
    first = lambda c: F.min_by(c, "line_no").alias(c)
    return items.groupBy("doc_id").agg(first("currency"), first("delivery_term"), first("transport_mode"), F.array_sort(F.collect_list(line)).alias("goods"), F.count("*").alias("item_count"), F.count_if("needs_review").alias("review_count"))
