"""More queries of the catalogue: functions, view models, and extraction from made texts and word boxes, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import changes, filters, joins, ordered, scans, search, stats
from ..sources import collections, landing, pdf, workbooks
from . import approval, extract_spatial, extract_text, resolve, validate, views, xmlout
from .catalogue import query


# --- texts of invoices, made from orders


def invoice_texts(t) -> DataFrame:
    """o_orderkey and a text with the seller above SAYIN and the buyer below it."""
    o = scans.spread(t("orders")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    vkn = F.lpad(F.col("o_custkey").cast("string"), 10, "0")
    return o.select("o_orderkey", F.concat_ws(
        "\n", F.lit("e-Fatura"), F.concat(F.lit("ACME "), F.col("o_custkey")), F.lit("Adres: Cadde 5"), F.lit("ANKARA"), F.concat(F.lit("VKN: "), vkn), F.lit("SAYIN"), F.concat(F.lit("Firma Adı: "), F.col("c_name")),
        F.concat(F.lit("Main  St "), F.col("c_nationkey")), F.lit("HUNGARY"), F.lit("Tel: 1"), F.lit("ETTN: x"),
    ).alias("text"))


@query("""SELECT o_orderkey, 'ACME ' || o_custkey AS seller, 'Cadde 5 ANKARA' AS seller_address, lpad(o_custkey::VARCHAR, 10, '0') AS seller_tax, c_name AS buyer,
'Main St ' || c_nationkey || ' HUNGARY' AS buyer_address, NULL::VARCHAR AS buyer_tax, 'HUNGARY' AS buyer_country FROM orders JOIN customer ON o_custkey = c_custkey""")
def invoice_parties(t):
    p = extract_text.parties(invoice_texts(t))
    return p.select("o_orderkey", F.col("seller.name").alias("seller"), F.col("seller.address").alias("seller_address"), F.col("seller.tax_no").alias("seller_tax"), F.col("buyer.name").alias("buyer"), F.col("buyer.address").alias("buyer_address"), F.col("buyer.tax_no").alias("buyer_tax"), "buyer_country")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'Shop ' || o_custkey ELSE 'Next Line Ltd' END AS seller, CASE WHEN o_orderkey % 2 = 0 THEN 'Bob ' || o_custkey END AS buyer FROM orders""")
def labelled_parties(t):
    k = F.col("o_orderkey")
    body = F.concat_ws("\n", F.lit("head"), F.when(k % 3 == 1, F.concat(F.lit("Satıcı : Shop "), "o_custkey")).when(k % 3 == 2, F.lit("SELLER:\nNext Line Ltd")).otherwise("SATICI: ABC Ltd"), F.when(k % 2 == 0, F.concat(F.lit("müŞteri - Bob "), "o_custkey")).otherwise("ALICI: Bob"))
    p = extract_text.parties(t("orders").select("o_orderkey", body.alias("text")))
    return p.select("o_orderkey", F.col("seller.name").alias("seller"), F.col("buyer.name").alias("buyer"))


@query("""SELECT o_orderkey, 'INV' || lpad(o_orderkey::VARCHAR, 9, '0') AS invoice_no, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, 'EUR' AS currency, CAST(floor(o_totalprice) + 0.25 AS DOUBLE) AS total_amount, 'FOB' AS delivery_term,
'PESIN' AS payment_type, 'TURKEY' AS origin, 'Denizyolu' AS transport_mode, (o_custkey % 40 + 1)::DOUBLE AS total_package, 'KUTU' AS package_type, CAST(o_custkey % 900 + 1.5 AS DOUBLE) AS gross_kg, (o_custkey % 900 + 1)::DOUBLE AS net_kg FROM orders""")
def invoice_heads(t):
    amount = numbers.tr_format(F.floor("o_totalprice") + 0.25)
    flat = F.concat_ws(
        " ", F.concat(F.lit("fatura no: INV"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")), F.concat(F.lit("Fatura Tarihi : "), F.date_format("o_orderdate", "dd.MM.yyyy")), F.concat(F.lit("Genel Toplam: "), amount, F.lit(" EUR")),
        F.lit("fob ÖDEME ŞEKLİ : PESIN - x MALLARIMIZ TURKEY. Taşıma Şekli: Denizyolu"), F.concat(F.lit("TOPLAM KAP : "), F.col("o_custkey") % 40 + 1, F.lit(" KUTU")),
        F.concat(F.lit("BRÜT KG : "), F.col("o_custkey") % 900 + 1, F.lit(",5 NET KG: "), F.col("o_custkey") % 900 + 1),
    )
    return extract_text.with_header_fields(t("orders").select("o_orderkey", flat.alias("flat")), "flat").drop("flat")


@query("""SELECT o_orderkey, v.i AS line_no, lpad((o_orderkey * 10 + v.i)::VARCHAR, 12, '8') AS hs_code, 'Part ' || v.i || ' of ' || o_custkey AS description, CAST(CASE v.i WHEN 1 THEN 1600 ELSE 3 END AS DOUBLE) AS quantity, 'Adet' AS unit, CAST(12.5 AS DOUBLE) AS unit_price, (o_custkey + 2.75)::DOUBLE AS line_total
FROM orders, (VALUES (1), (2)) v(i)""")
def goods_blocks(t):
    block = lambda i: F.concat(
        F.lit(f"\n{i}\nPart "[:-1] + f" {i} of "), F.col("o_custkey").cast("string"), F.lit("\nAB12CD34EF56\n" + ("1.600" if i == 1 else "3") + "\nAdet 12,50\n%18 EUR 4,00\nEUR 1,50\nEUR\n"), (F.col("o_custkey") + 2).cast("string"),
        F.lit(",75\nKarayolu "), F.lpad((F.col("o_orderkey") * 10 + i).cast("string"), 12, "8"),
    )
    g = extract_text.with_goods_blocks(scans.spread(t("orders")).select("o_orderkey", F.concat(F.lit("head"), block(1), block(2), F.lit("\nend")).alias("text")), "text", "goods")
    return extract_text.goods_lines(g, ["o_orderkey"], "goods")


@query("""SELECT o_orderkey, v.i AS line_no, lpad((o_orderkey * 10 + v.i)::VARCHAR, 11, '7') AS hs_code, 'Widget no ' || o_custkey AS description, CAST(CASE v.i WHEN 1 THEN 4 END AS DOUBLE) AS quantity, CASE v.i WHEN 1 THEN 'KGM' END AS unit, CAST(CASE v.i WHEN 1 THEN 2.5 END AS DOUBLE) AS unit_price, CAST(10.25 AS DOUBLE) AS line_total
FROM orders, (VALUES (1), (2)) v(i)""")
def goods_rows(t):
    code = lambda i: F.lpad((F.col("o_orderkey") * 10 + i).cast("string"), 11, "7")
    lines = F.concat(F.lit("title\n1 "), code(1), F.lit(" Widget no x"), F.col("o_custkey").cast("string"), F.lit(" kgm 4 2,50 10,25\n2 "), code(2), F.lit(" Widget no x"), F.col("o_custkey").cast("string"), F.lit(" 10,25\nno code 12 3"))
    g = extract_text.with_goods_rows(t("orders").select("o_orderkey", lines.alias("text")), "text", "goods")
    return extract_text.goods_lines(g, ["o_orderkey"], "goods").withColumn("description", F.replace(F.col("description"), F.lit("no x"), F.lit("no ")))


# --- items, from word boxes made from suppliers


def word_boxes(t) -> DataFrame:
    """Two pages a supplier: each of four lines is a row of boxes with code, quantity, unit, price, amount, currency, term and tariff code."""
    k, n = F.col("s_suppkey"), F.col("n")
    lines = t("supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n"))
    y = 700.0 + 200.0 * n
    q, p = n * 3 + 2, n * 10
    cell = lambda pos, x, s, dy=0.0: F.struct((n * 20 + pos).cast("int").alias("pos"), s.cast("string").alias("text"), F.lit(float(x)).alias("x0"), (y + dy).alias("y0"), F.lit(float(x) + 60).alias("x1"), (y + dy + 20).alias("y1"), F.lit(0.9).alias("score"))
    cells = [
        cell(1, 100, F.concat(F.lit("AB.CD."), n + 100)), cell(2, 110, F.lit("Steel"), 30.0), cell(3, 180, F.lit("bolt"), 30.0), cell(4, 500, q), cell(5, 570, F.lit("ADET")), cell(6, 700, F.concat(p, F.lit(",50"))),
        cell(7, 850, numbers.tr_format(q * (p + 0.5))), cell(8, 930, F.lit("EUR FOB")), cell(9, 990, F.lit("KARAY0LU")), cell(10, 1100, F.lpad((k * 10 + n).cast("string"), 12, "9")),
    ]
    return lines.select(k.cast("string").alias("doc_id"), (n % 2 + 1).cast("int").alias("page"), F.explode(F.array(*cells)).alias("w")).select("doc_id", "page", "w.*")


_ITEM_SQL = """WITH l AS (SELECT s_suppkey AS k, v.n FROM supplier, (VALUES (1), (2), (3), (4)) v(n)), i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n % 2, n) AS line_no, n * 3 + 2 AS q, n * 10 AS p FROM l)
"""


@query(_ITEM_SQL + """SELECT k::VARCHAR AS doc_id, line_no, (n % 2 + 1)::INTEGER AS page, lpad((k * 10 + n)::VARCHAR, 12, '9') AS gtip, (n + 100)::VARCHAR AS code_tail, 'AB.CD.' || (n + 100) AS product_code_full, q::VARCHAR AS quantity, 'ADET' AS unit, p || ',50' AS unit_price,
replace(printf('%.2f', q * (p + 0.5)), '.', ',') AS amount, 'EUR' AS currency, 'FOB' AS delivery_term, 'Karayolu' AS transport_mode, false AS needs_review, 'Steel bolt' AS description FROM i""")
def items(t):
    i = extract_spatial.extract_items(word_boxes(t))
    return i.select("doc_id", "line_no", "page", "gtip", F.element_at(F.split("product_code", r"\."), -1).alias("code_tail"), "product_code_full", "quantity", "unit", "unit_price", "amount", "currency", "delivery_term", "transport_mode", "needs_review", "description")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem) SELECT k::VARCHAR AS doc_id, arg_min('C' || n, n) AS currency, 'FOB' AS delivery_term, 'Karayolu' AS transport_mode, count(*) AS item_count, count(*) FILTER (n % 2 = 0) AS review_count,
string_agg('G' || n, ',' ORDER BY n) AS codes, CAST(sum(n * 1000.5) AS DOUBLE) AS total FROM l GROUP BY 1""")
def items_as_source(t):
    n = F.col("line_no")
    found = t("lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("line_no")).distinct()
    found = found.select("doc_id", "line_no", F.concat(F.lit("G"), n).alias("gtip"), F.lit("d").alias("description"), F.lit("2").alias("quantity"), F.lit("KG").alias("unit"), F.lit("1,5").alias("unit_price"), numbers.tr_format(n * 1000.5).alias("amount"), (n % 2 == 0).alias("needs_review"), F.concat(F.lit("C"), n).alias("currency"), F.lit("FOB").alias("delivery_term"), F.lit("Karayolu").alias("transport_mode"))
    s = extract_spatial.as_source(found)
    return s.select("doc_id", "currency", "delivery_term", "transport_mode", "item_count", "review_count", F.array_join(F.transform("goods", lambda g: g["hs_code"]), ",").alias("codes"), F.aggregate("goods", F.lit(0.0), lambda a, g: a + g["line_total"]).alias("total"))


@query(_ITEM_SQL + """SELECT k::VARCHAR AS doc_id, (n % 2 + 1)::INTEGER AS page, lpad((k * 10 + n)::VARCHAR, 12, '9') AS gtip, 'exact' AS method FROM i""")
def tariff_candidates(t):
    return extract_spatial.candidates(extract_spatial.pages_of(word_boxes(t))).select("doc_id", "page", "gtip", "method")


@query(_ITEM_SQL + """, g AS (SELECT k, n % 2 + 1 AS page, count(*) AS c FROM i GROUP BY 1, 2) SELECT k::VARCHAR AS doc_id, page::INTEGER AS page, CAST(CASE WHEN c >= 2 THEN 480 END AS DOUBLE) AS qty_from, CAST(CASE WHEN c >= 2 THEN 580 END AS DOUBLE) AS qty_to, CASE WHEN c >= 2 THEN 'pattern' END AS method, CAST(CASE WHEN c >= 2 THEN 1040 END AS DOUBLE) AS gtip_from FROM g""")
def column_spans(t):
    p = extract_spatial.pages_of(word_boxes(t))
    q, g = extract_spatial.column_of(F.col("words"), "QTY"), extract_spatial.column_of(F.col("words"), "GTIP")
    return p.select("doc_id", "page", q.alias("q"), g.alias("g")).select("doc_id", "page", F.col("q.x_min").alias("qty_from"), F.col("q.x_max").alias("qty_to"), F.col("q.method").alias("method"), F.col("g.x_min").alias("gtip_from"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber % 2 = 0 THEN 'KG' ELSE 'ADET' END AS unit, (l_linenumber * 7)::VARCHAR AS quantity FROM lineitem""")
def quantity_near_unit(t):
    n = F.col("l_linenumber")
    w = lambda x, s: F.struct(F.lit(1.0).alias("y0"), F.lit(float(x)).alias("x0"), F.lit(x).cast("int").alias("pos"), s.cast("string").alias("text"))
    unit = F.when(n % 2 == 0, "KG").otherwise("ADET")
    line = F.array(w(10, F.lit("55")), w(200, F.lit("x")), w(210, F.lit("y")), w(220, F.lit("z")), w(400, n * 7), w(430, unit), w(500, F.lit("999")))
    q = extract_spatial.quantity_of(line)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", q["unit"].alias("unit"), q["quantity"].alias("quantity"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, (l_linenumber + 10) || ',50' AS price, replace(printf('%.2f', (l_linenumber + 1) * (l_linenumber + 10.5)), '.', ',') AS amount FROM lineitem""")
def price_amount_pair(t):
    n = F.col("l_linenumber")
    w = lambda s: F.struct(s.cast("string").alias("text"))
    line = F.array(w(F.lit("1,00 EUR")), w(F.concat(n + 10, F.lit(",50"))), w(F.lit("7,77")), w(F.concat(F.lit("= "), F.replace(F.format_number((n + 1) * (n + 10.5), 2), F.lit("."), F.lit(",")))))
    # the pair as a column, so that it is looked for once and not for each of its parts
    found = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", extract_spatial.price_and_amount(line, (n + 1).cast("string")).alias("pa"))
    return found.select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("pa.price").alias("price"), F.col("pa.amount").alias("amount"))


@query("""SELECT p_partkey, (p_size + 1)::VARCHAR AS quantity, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 'ADET' END AS unit, '12,50' AS unit_price FROM part WHERE p_size < 9""")
def joined_quantities(t):
    n = F.col("p_size") + 1
    s = F.when(F.col("p_partkey") % 3 == 0, F.concat(n, F.lit(" adet 12,50"))).when(F.col("p_partkey") % 3 == 1, F.concat(n, F.lit("ADET12,50"))).otherwise(F.concat(n, F.lit("12,50")))
    j = extract_spatial.joined_quantity(s)
    out = t("part").where("p_size < 9").select("p_partkey", j["quantity"].alias("quantity"), j["unit"].alias("unit"), j["unit_price"].alias("unit_price"))
    # digits that run together are cut later, where the product fits: the joined text is kept as one
    fit = numbers.resplit_quantity_price(F.col("quantity"), F.col("unit_price"), numbers.tr_format((F.col("quantity_n")) * 12.5))
    return out.join(t("part").select("p_partkey", (F.col("p_size") + 1).alias("quantity_n")), "p_partkey").withColumn("f", fit).select("p_partkey", F.col("f.quantity").alias("quantity"), "unit", F.col("f.unit_price").alias("unit_price"))


# --- functions


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey * 1000)::VARCHAR ELSE (o_orderkey * 1000)::VARCHAR || '.5' END AS plain, replace(replace(replace(printf('%,d', o_orderkey + 1), ',', '#'), '.', ','), '#', '.') AS halves, '0.000' || (o_orderkey % 9 + 1) AS small FROM orders""")
def number_formats(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", numbers.plain_format(k * 1000 + F.when(k % 2 == 0, 0.0).otherwise(0.5)).alias("plain"), numbers.tr_format(k + 0.5, 0).alias("halves"), numbers.plain_format((k % 9 + 1) / 10000).alias("small"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN p_size * 1000 ELSE p_size + 0.25 END AS DOUBLE) AS quantity, CAST(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size + 0.5 END AS DOUBLE) AS lenient, p_size % 4 = 1 AS flag, CAST(coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size + 0.5 END, 7) AS DOUBLE) AS env,
p_size || ',50' AS first_money, 2 AS n_money, CAST(p_size * 1700.0 / 850 AS DOUBLE) AS scaled, CAST(greatest(0.0, p_size - 10.0) AS DOUBLE) AS x_min, CAST(p_size + 10.0 AS DOUBLE) AS x_max FROM part""")
def number_texts(t):
    n = F.col("p_size")
    half = F.when(n % 3 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), n, F.lit(".5 ")))
    money = numbers.money_values(F.concat(F.lit("a "), n, F.lit(",50 b 1.200,00 9,9")))
    span = numbers.column_span(n.cast("double"), 20.0)
    return t("part").select(
        "p_partkey", numbers.quantity(F.when(n % 2 == 0, F.concat(n, F.lit(".000"))).otherwise(F.concat(n, F.lit(",25")))).alias("quantity"), numbers.lenient_number(half).alias("lenient"),
        numbers.env_flag(F.when(n % 4 == 1, " Yes ").when(n % 4 == 2, "no")).alias("flag"), numbers.env_number(half, 7.0).alias("env"), F.get(money, F.lit(0)).alias("first_money"), F.size(money).alias("n_money"),
        numbers.scaled_box(n.cast("double"), F.lit(850.0), 1700).alias("scaled"), span["x_min"].alias("x_min"), span["x_max"].alias("x_max"),
    )


@query("""SELECT l_orderkey, l_linenumber, (l_linenumber + 1)::VARCHAR AS quantity, CASE WHEN l_linenumber % 3 = 1 THEN false WHEN l_linenumber % 3 = 2 THEN true ELSE false END AS unsure FROM lineitem""")
def quantity_repairs(t):
    """Three branches: a wrong quantity is replaced, a right one stays (and is unsure), a missing one is filled."""
    n = F.col("l_linenumber")
    q = F.when(n % 3 == 1, F.lit("99")).when(n % 3 == 2, (n + 1).cast("string"))
    fixed = numbers.repaired_quantity(q, F.lit("2,50"), numbers.tr_format((n + 1) * 2.5))
    return t("lineitem").select("l_orderkey", "l_linenumber", fixed["quantity"].alias("quantity"), fixed["unsure"].alias("unsure"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS trimmed, c_custkey % 4 = 0 AS empty, c_custkey % 3 = 0 AS empty_cell, 'igusoc eao ' || lower(c_mktsegment) AS header, 'ISTANBUL ' || c_mktsegment AS upper, 'KARAYOLU' AS road, '10' || c_custkey AS digits,
'AB' || c_custkey AS bare, c_mktsegment || ', x' AS joined, CASE c_custkey % 3 WHEN 0 THEN 'denizyolu' WHEN 1 THEN 'havayolu' ELSE 'karayolu' END AS mode, 'a\\.b' AS escaped, 'x' AS part, '{a},{c}' AS holes, c_custkey || ',z' AS cleaned FROM customer""")
def text_functions(t):
    c, s = F.col("c_custkey"), F.col("c_mktsegment")
    return t("customer").select(
        "c_custkey", text.blank_to_null(F.when(c % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit("  "), s, F.lit("\t")))).alias("trimmed"), text.is_empty(F.when(c % 8 == 0, F.lit("")).when(c % 4 != 0, F.lit("0"))).alias("empty"),
        text.is_empty_cell(F.when(c % 3 == 0, F.lit(" - ")).otherwise("v")).alias("empty_cell"), text.fold_header(F.concat(F.lit(" IĞÜŞÖÇ ÉÃō "), F.upper(s))).alias("header"), text.fold_upper(F.concat(F.lit(" İstanbul "), s)).alias("upper"), text.repair_transport(F.lit("karay0lu")).alias("road"),
        text.repair_digits(F.concat(F.lit("1O"), c)).alias("digits"), text.bare_code(F.concat(F.lit("a.b- "), c)).alias("bare"), text.joined(", ", s, F.lit(None).cast("string"), F.lit(""), F.lit("x")).alias("joined"),
        text.transport_code(F.when(c % 3 == 0, "SEA freight").when(c % 3 == 1, "Hava").otherwise("")).alias("mode"), text.escape_pattern(F.lit("a.b")).alias("escaped"), text.part_of(F.lit("x — y"), "—", 1).alias("part"),
        F.array_join(text.placeholders_in(F.lit("<{a} and {c}>"), ["a", "b", "c"]), ",").alias("holes"), F.array_join(text.clean_array(F.array(c.cast("string"), F.lit(" "), F.lit(None).cast("string"), F.lit(" z "))), ",").alias("cleaned"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END AS line_no, 'AG.XY.' || p_size AS full, p_size::VARCHAR AS short FROM part WHERE p_size < 100""")
def product_codes(t):
    n = F.col("p_size")
    c = text.product_code(F.concat(F.when(n % 2 == 0, F.concat(n, F.lit(" "))).otherwise(F.lit("x ")), F.lit("ag.xy."), n, F.lit(" bolt")))
    return t("part").where("p_size < 100").select("p_partkey", c["line_no"].alias("line_no"), c["full"].alias("full"), c["short"].alias("short"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, CASE o_orderkey % 4 WHEN 0 THEN 'Az önce' WHEN 1 THEN '5 dk önce' WHEN 2 THEN '3 sa önce' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS ago, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS long FROM orders""")
def date_texts(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    back = F.when(k % 4 == 0, 30).when(k % 4 == 1, 330).when(k % 4 == 2, 3 * 3600 + 5).otherwise(90000)
    now = F.timestamp_seconds(F.unix_timestamp(d) + back)
    return t("orders").select("o_orderkey", dates.iso_or_null(d).alias("iso"), dates.relative_time(d, now).alias("ago"), dates.short_date(d, True).alias("long"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS none FROM events""")
def nested_paths(t):
    return t("events").select("event_id", text.at_path(F.col("props"), "k").alias("k"), text.at_path(F.col("props"), "k.deeper.x").alias("none"))


# --- scans, filters, counts


@query("""SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_acctbal DESC, c_custkey""")
def tenant_rows(t):
    return scans.tenant_scan(t("customer"), 3, "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_custkey", "c_name")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 5""")
def tenant_suppliers(t):
    return scans.tenant_scan(t("supplier"), 5, "s_nationkey", [F.col("s_suppkey")]).select("s_suppkey", "s_name")


@query("""SELECT o_orderkey, o_orderstatus <> 'O' AS approval, o_orderstatus = 'P' AS material, true AS any_status FROM orders""")
def status_sets(t):
    s = F.col("o_orderstatus")
    sets = {"verified": ["O"], "pending": ["P", "F"]}
    return t("orders").select("o_orderkey", filters.status_in(s, "pending", sets).alias("approval"), filters.status_in(s, "pending", {"pending": ["P"]}).alias("material"), filters.status_in(s, "tumu", sets).alias("any_status"))


@query("""SELECT c_custkey, c_mktsegment = 'BUILDING' AND c_nationkey < 12 AS mt, c_nationkey < 12 AS active FROM customer""")
def role_filters(t):
    status = F.when(F.col("c_nationkey") < 12, "Aktif").otherwise("Pasif")
    return t("customer").select("c_custkey", filters.active_role(F.col("c_mktsegment"), status, "BUILDING").alias("mt"), filters.active_role(F.col("c_mktsegment"), status).alias("active"))


@query("""SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS conflict FROM lineitem WHERE l_linenumber = 2""")
def page_conflicts(t):
    m = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("page"), F.when(F.col("l_returnflag") == "R", "uyumsuz").otherwise("uyumlu").alias("status"))).alias("m"))
    on = m.select("l_orderkey", F.explode(F.filter("m", lambda x: filters.on_page(x["page"], 2))).alias("x"), "m")
    # conflicts count on the page that is shown
    return on.select("l_orderkey", F.col("x.page").alias("l_linenumber"), filters.has_conflict(F.filter("m", lambda x: x["page"] == 2)).alias("conflict"))


@query("""SELECT count(*) AS n FROM orders WHERE o_orderpriority LIKE '1-%' AND o_custkey % 2 = 1""")
def filtered_count(t):
    return stats.count_where(t("orders"), F.col("o_orderpriority").startswith("1-") & (F.col("o_custkey") % 2 == 1))


@query("""SELECT count(*) AS total, count(*) FILTER (p_size > 25) AS active, count(*) FILTER (p_size <= 25) AS passive, count(DISTINCT p_type) AS steps FROM part""")
def template_statistics(t):
    return stats.template_stats(t("part"), F.col("p_size") > 25, "p_type")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'""")
def archived_files(t):
    return t("orders").where(filters.archived(F.col("o_orderstatus") == "F", F.col("o_orderpriority"), "2-HIGH")).select("o_orderkey")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS some FROM customer""")
def non_empty_arrays(t):
    a = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("a"))
    return t("customer").select("c_custkey").join(a, "c_custkey", "left").select("c_custkey", filters.not_empty(F.col("a")).alias("some"))


@query("""SELECT p_partkey, p_brand = 'Brand#11' AND p_type LIKE 'ECONOMY%' AS hit FROM part""")
def stored_rules(t):
    cond = lambda f, o, v, e=True: F.struct(F.lit(f).alias("field"), F.lit(o).alias("operator"), F.lit(v).alias("value"), F.lit(e).alias("enabled"))
    rule = F.array(cond("brand", "equals", "Brand#11"), cond("type", "starts_with", "ECONOMY"), cond("type", "equals", "never", False))
    return t("part").select("p_partkey", filters.rule_matches(rule, {"brand": F.col("p_brand"), "type": F.col("p_type")}).alias("hit"))


@query("""SELECT o_orderkey, o_orderstatus = 'F' AS invoice, CASE WHEN o_orderstatus = 'O' THEN 'conditions' WHEN o_orderstatus = 'P' THEN 'conditions,documents' ELSE '' END AS errors FROM orders""")
def payload_checks(t):
    s = F.col("o_orderstatus")
    cond = lambda v, e: F.struct(v.alias("value"), F.lit(e).alias("enabled"))
    conditions = F.array(cond(F.lit("a"), True), cond(F.when(s == "F", "b").otherwise(" "), True), cond(F.lit("c"), False))
    documents = F.when(s == "P", F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    return t("orders").select("o_orderkey", validate.has_invoice(F.array(F.when(s == "F", "E_INVOICE_XML").otherwise("OTHER"))).alias("invoice"), F.array_join(validate.rule_errors(conditions, documents), ",").alias("errors"))


@query("""SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views FROM events GROUP BY 1""")
def list_counters(t):
    return stats.count_bundle(t("events"), {"total": F.lit(True), "clicks": F.col("event_type") == "click", "views": F.col("event_type") == "view"}, ["user_id"])


@query("""SELECT event_type, count(value) AS filled, count(*) FILTER (user_id % 2 = 0) AS mapped, count(*) FILTER (value > 50) AS conflicted FROM events GROUP BY 1""")
def section_counters(t):
    return stats.section_counts(t("events"), "event_type", F.col("value").cast("string"), F.col("user_id") % 2 == 0, F.col("value") > 50)


@query("""SELECT l_orderkey, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem GROUP BY 1""")
def bounding_boxes(t):
    p = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))).alias("p"))
    return p.select("l_orderkey", stats.bounding_box(F.col("p")).alias("b")).select("l_orderkey", "b.*")


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS waiting, count(*) FILTER (o_orderstatus = 'F') AS started, 0::BIGINT AS completed, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS yellow_red, count(*) FILTER (o_orderpriority = '5-LOW') AS blue_green FROM orders""")
def registration_summary(t):
    p = F.col("o_orderpriority")
    rows = t("orders").select(F.when(F.col("o_orderstatus") == "F", "started").otherwise("x").alias("status"), F.when(p == "1-URGENT", "Sarı").when(p == "2-HIGH", "Kırmızı").when(p == "5-LOW", "Mavi").alias("line"))
    return views.registration_counts(rows)


@query("""SELECT count(*) FILTER (o_orderstatus = 'O') AS waiting, count(*) FILTER (o_orderstatus = 'F') AS uploaded, 0::BIGINT AS reconciled, count(*) FILTER (o_orderstatus = 'P') AS warnings, count(*) FILTER (o_orderstatus = 'P') AS cost_pending FROM orders""")
def closing_summary(t):
    return views.closing_counts(t("orders").select(joins.labelled(F.col("o_orderstatus"), {"O": "kontrol-bekliyor", "F": "mutabakat-hazir", "P": "maliyet-bekliyor"}).alias("status")))


# --- view models


def declarations(t) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    own = k % 3 == 0
    when = lambda c: F.when(own, c)
    op = F.struct(
        when(F.concat(F.lit("REF-"), k)).alias("ref"), when(F.lit("Acme")).alias("customerName"), F.lit("Sea way").alias("transportMode"), when(F.when(k % 2 == 0, "tescil")).alias("fileStatus"), when(F.lit("ithalat")).alias("operationType"), when(k % 2 == 0).alias("isArchived"), F.lit("Sarı").alias("line"),
        F.lit(None).cast("string").alias("declarationNo"), F.lit(None).cast("timestamp").alias("receivedAt"), F.lit(None).cast("timestamp").alias("closedAt"), F.lit(None).cast("boolean").alias("escalation"), F.lit(None).cast("array<string>").alias("missingDocuments"),
    )
    status = F.when(s == "O", "READY").when(s == "F", "XML_GENERATED").otherwise("ERROR")
    return t("orders").select(F.lpad(F.hex(k), 24, "0").alias("id"), F.col("o_custkey").cast("string").alias("companyId"), op.alias("operation"), status.alias("status"), F.when(s == "F", "x.xml").alias("generatedXmlPath"), F.col("o_orderdate").cast("timestamp").alias("createdAt"), F.lit(None).cast("timestamp").alias("updatedAt"), k.alias("o_orderkey"))


_FILES = """WITH d AS (SELECT lower(lpad(to_hex(o_orderkey), 24, '0')) AS id, o_orderkey AS k, o_orderkey % 3 = 0 AS own, CASE o_orderstatus WHEN 'O' THEN 'READY' WHEN 'F' THEN 'XML_GENERATED' ELSE 'ERROR' END AS s, o_orderstatus AS o FROM orders),
f AS (SELECT id, k, CASE WHEN own THEN 'REF-' || k ELSE 'DCL-' || upper(right(id, 6)) END AS ref, CASE WHEN own THEN 'Acme' ELSE '—' END AS customer, CASE WHEN own AND k % 2 = 0 THEN 'tescil' WHEN s = 'READY' THEN 'ic-kontrol' WHEN s = 'XML_GENERATED' THEN 'tescil' ELSE 'evrak-bekleniyor' END AS status,
CASE WHEN own THEN 'ithalat' ELSE 'ihracat' END AS operation_type, own AND k % 2 = 0 AS archived, 'denizyolu' AS mode, s = 'ERROR' AS escalation, s FROM d)
"""


@query(_FILES + """SELECT id, ref, customer, status, operation_type, archived, mode, CASE WHEN s = 'XML_GENERATED' THEN ref END AS declaration_no, escalation FROM f""")
def customs_files(t):
    f = views.customs_files(declarations(t))
    return f.select(F.lower("id").alias("id"), "ref", "customer", "status", F.col("operationType").alias("operation_type"), F.col("isArchived").alias("archived"), F.col("transportMode").alias("mode"), F.col("declarationNo").alias("declaration_no"), "escalation")


@query(_FILES + """SELECT count(*) AS total, count(*) FILTER (status = 'yeni-talep') AS yeni_talep, count(*) FILTER (status = 'gtip-hazirlik') AS gtip_hazirlik, count(*) FILTER (status = 'evrak-bekleniyor') AS evrak_bekleniyor, count(*) FILTER (status = 'beyanname-yazim') AS beyanname,
count(*) FILTER (status = 'ic-kontrol') AS ic_kontrol, count(*) FILTER (status = 'tescil') AS tescil, count(*) FILTER (status = 'kapanis-bekleyen') AS kapanis_bekleyen, count(*) FILTER (escalation) AS eskalasyon FROM f WHERE NOT archived""")
def file_summary(t):
    return views.file_counts(views.customs_files(declarations(t)))


@query("""WITH d AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'N') AS lack FROM lineitem GROUP BY 1)
SELECT o_orderkey::VARCHAR AS id, CASE WHEN coalesce(lack, 0) > 0 THEN lack || ' eksik evrak' WHEN n IS NULL THEN 'Evrak bekleniyor' ELSE 'Tüm evraklar geldi' END AS meta, coalesce(n > 0 AND lack = 0, false) AS all_ready FROM orders LEFT JOIN d ON l_orderkey = o_orderkey""")
def readiness(t):
    docs = t("lineitem").select(F.col("l_orderkey").cast("string").alias("declarationId"), F.when(F.col("l_returnflag") == "N", "SUCCESS").when(F.col("l_returnflag") == "A", "FAILED").alias("extractionStatus"))
    return views.readiness(docs, t("orders").select(F.col("o_orderkey").cast("string").alias("id")))


@query("""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'Eksik' WHEN 'N' THEN 'Geldi' ELSE 'Koşullu' END AS label, l_quantity FROM lineitem""")
def document_statuses(t):
    status = F.when(F.col("l_returnflag") == "N", "SUCCESS").when(F.col("l_returnflag") == "A", "FAILED").otherwise("PENDING")
    return t("lineitem").select("l_orderkey", "l_linenumber", views.document_status(status).alias("label"), "l_quantity")


@query("""SELECT p_partkey::VARCHAR AS doc_id, p_size AS line_no, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'KALEM-' || p_size END AS "materialNo", CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN left(p_type || p_type, 120) ELSE '—' END AS description,
CASE WHEN p_size % 5 = 0 THEN '—' ELSE p_size::VARCHAR END AS "foundGtip", CASE WHEN p_size % 5 = 0 THEN 'Operasyon Girişi Gerekli' ELSE 'Bulundu' END AS status, CASE WHEN p_size % 5 = 0 THEN 'Giriş Bekliyor' ELSE 'Onay Bekliyor' END AS "approvalStatus", p_size > 9 AS needs_review FROM part""")
def query_results(t):
    n = F.col("p_size")
    rows = t("part").select(F.col("p_partkey").cast("string").alias("doc_id"), n.alias("line_no"), F.when(n % 2 == 0, F.col("p_brand")).otherwise(" ").alias("product_code"), F.when(n % 3 == 0, F.col("p_name")).alias("description"), F.when(n % 3 == 1, F.concat("p_type", "p_type")).alias("raw_line"), F.when(n % 5 != 0, n.cast("string")).otherwise("").alias("gtip"), (n > 9).alias("needs_review"))
    return views.query_results(rows)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 7 ELSE 6 END::INTEGER AS n, CASE WHEN o_orderstatus = 'O' THEN o_custkey % 2 = 0 END AS transport, o_custkey % 3 <> 0 AS packing, (o_custkey % 9) || CASE WHEN o_orderstatus = 'F' THEN ' günde tamamlandı' ELSE ' gündür' END AS age,
CASE WHEN o_orderstatus = 'F' OR o_custkey % 9 <= 2 THEN 'ok' WHEN o_custkey % 9 <= 5 THEN 'warn' ELSE 'red' END AS level, CASE WHEN o_custkey % 2 = 0 THEN 'done' ELSE 'wait' END AS third, CASE WHEN o_orderstatus = 'F' THEN 'Müşteri bilgilendirildi' ELSE 'Müşteri bekleme durumunda' END AS last FROM orders""")
def archive_views(t):
    k, s = F.col("o_custkey"), F.col("o_orderstatus")
    missing = F.concat(F.when(k % 2 == 1, F.array(F.lit("CMR"))).otherwise(F.array().cast("array<string>")), F.when(k % 3 == 0, F.array(F.lit("Çeki Listesi"))).otherwise(F.array().cast("array<string>")))
    done = F.when(s == "F", "completed").otherwise("started")
    rows = t("orders").select("o_orderkey", views.archive_checklist(F.when(s == "O", "transit").otherwise("ihracat"), missing).alias("c"), views.ageing(k % 9, done).alias("a"), views.timeline(F.lit("Sarı"), k % 2 == 0, done).alias("t"))
    named = lambda n: F.get(F.filter("c", lambda x: F.contains(x["name"], F.lit(n))), F.lit(0))["available"]
    return rows.select("o_orderkey", F.size("c").alias("n"), named("CMR").alias("transport"), named("Çeki").alias("packing"), F.col("a.text").alias("age"), F.col("a.level").alias("level"), F.get("t", F.lit(2))["state"].alias("third"), F.get("t", F.lit(3))["title"].alias("last"))


@query("""SELECT c_custkey, 'a' AS access, CASE WHEN c_nationkey < 9 THEN 'view,edit' ELSE 'view' END AS actions, CASE WHEN c_custkey % 2 = 0 THEN 'viewCosts,downloadDocuments' ELSE '' END AS special FROM customer""")
def menu_rights(t):
    right = lambda v, o: F.struct(v.alias("view"), o.alias("operate"))
    p = F.create_map(F.lit("a"), right(F.lit(True), F.col("c_nationkey") < 9), F.lit("b"), right(F.lit(False), F.lit(True)))
    caps = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("kapanis.maliyet"), F.lit("arsiv.view"))).otherwise(F.array(F.lit("none")))
    return t("customer").select("c_custkey", F.array_join(views.menu_access(p), ",").alias("access"), F.array_join(F.element_at(views.menu_actions(p, {"a": ["view", "edit"]}), "a"), ",").alias("actions"), F.array_join(views.special_actions(caps), ",").alias("special"))


@query("""SELECT p_partkey FROM part WHERE p_size % 3 = 0 OR p_brand IN ('Brand#11', 'Brand#12')""")
def visible_menu(t):
    items = t("part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("capabilities"))
    return views.visible_menu(items, F.array(F.lit("Brand#11"), F.lit("Brand#12"))).select("p_partkey")


@query("""SELECT user_id, 'amount' AS label, max(value)::VARCHAR AS value, 'click' AS source FROM events WHERE event_type = 'click' AND value IS NOT NULL GROUP BY 1""")
def trace_rows(t):
    best = t("events").where("event_type = 'click' and value is not null").groupBy("user_id").agg(F.max("value").cast("string").alias("value")).select("user_id", F.lit("head.amount").alias("path"), "value", F.lit("click").alias("source"))
    trace = resolve.source_trace(best, "user_id")
    return trace.select("user_id", F.explode(views.trace_entries(F.col("trace"))).alias("e")).select("user_id", "e.*")


@query("""WITH f AS (SELECT o_custkey, arg_min('K' || o_orderkey, (o_orderdate, o_orderkey)) AS ref FROM orders GROUP BY 1) SELECT c_custkey::VARCHAR AS key, ref FROM customer JOIN f ON o_custkey = c_custkey""")
def rows_by_key(t):
    rows = t("orders").select(F.concat(F.lit("K"), "o_orderkey").alias("ident"), F.col("o_custkey").cast("string").alias("cust"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return views.first_by_key(rows, t("customer").select(F.col("c_custkey").cast("string").alias("key")), F.col("cust"), "ident", "at").select("key", F.col("ident").alias("ref"))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey = 17 UNION ALL (SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = 17) ORDER BY c_custkey LIMIT 1)""")
def row_or_first(t):
    c = t("customer").select("c_custkey", "c_name", F.col("c_custkey").cast("string").alias("ref"))
    return views.or_first(c, "ref", "17", [F.col("c_custkey")]).select("c_custkey", "c_name")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size > 10 THEN p_brand END, 'none') AS brand, coalesce(CASE WHEN p_size > 20 THEN p_size END, 1) AS size FROM part""")
def template_defaults(t):
    part = F.struct(F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"), F.when(F.col("p_size") > 20, F.col("p_size")).alias("size"))
    return t("part").select("p_partkey", views.over_template(part, {"brand": "none", "size": 1}).alias("x")).select("p_partkey", "x.*")


@query("""SELECT o_orderkey, v.i AS n, CASE v.i WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN 'C' || o_custkey ELSE '—' END WHEN 2 THEN strftime(o_orderdate, '%d.%m.%Y') || ' / ' || o_orderkey WHEN 3 THEN replace(replace(replace(printf('%,.2f', floor(o_totalprice) + 0.5), ',', '#'), '.', ','), '#', '.') || ' EUR' WHEN 4 THEN '5' END AS value
FROM orders, (VALUES (1), (2), (3), (4)) v(i)""")
def form_fields(t):
    m = F.create_map(
        F.lit("parties.buyer.name"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("C"), "o_custkey")), F.lit("header.invoiceDate"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("header.invoiceNo"), F.col("o_orderkey").cast("string"),
        F.lit("header.totalAmount"), (F.floor("o_totalprice") + 0.5).cast("string"), F.lit("header.currency"), F.lit("EUR"), F.lit("packageInfo.totalPackage"), F.lit("5"),
    )
    keys = {"alici": 1, "fatura": 2, "kiymet": 3, "kap": 4}
    f = t("orders").select("o_orderkey", F.explode(views.writing_fields(m)).alias("f"))
    return f.where(F.col("f.key").isin(*keys)).select("o_orderkey", F.element_at(F.create_map(*(F.lit(x) for kv in keys.items() for x in kv)), F.col("f.key")).alias("n"), F.col("f.value").alias("value"))


# --- changes


@query("""SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM part WHERE p_size = 1) AS n_good, (SELECT count(*) FROM part) AS n_bad, (SELECT count(*) FROM part WHERE p_size = 2) AS refused""")
def bulk_inserts(t):
    stored = t("part").select("p_partkey", "p_name")
    good, _ = changes.bulk_insert(stored, t("part").where("p_size = 1").select((-F.col("p_partkey") - 1).alias("p_partkey"), "p_name"), F.col("p_partkey"))
    bad, refused = changes.bulk_insert(stored, t("part").where("p_size in (1, 2)").select(F.when(F.col("p_size") == 1, -F.col("p_partkey") - 1).otherwise(F.col("p_partkey")).alias("p_partkey"), "p_name"), F.col("p_partkey"))
    count = lambda df, n: df.agg(F.count("*").alias(n))
    return count(good, "n_good").crossJoin(count(bad, "n_bad")).crossJoin(count(refused, "refused"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_nationkey < 10 THEN c_mktsegment END, 'OTHER') AS segment, 'DRAFT' AS status FROM customer""")
def insert_defaults(t):
    rows = t("customer").select("c_custkey", F.when(F.col("c_nationkey") < 10, F.col("c_mktsegment")).alias("segment"))
    return changes.with_defaults(rows, {"segment": "OTHER", "status": "DRAFT"})


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a=9,b=2' ELSE 'a=1,b=2,c=9' END AS items FROM part""")
def list_upserts(t):
    cell = lambda k, v: F.struct(k.alias("k"), F.lit(v).alias("v"))
    out = changes.list_upsert(F.array(cell(F.lit("a"), 1), cell(F.lit("b"), 2)), cell(F.when(F.col("p_size") % 2 == 0, "a").otherwise("c"), 9), "k")
    return t("part").select("p_partkey", F.array_join(F.transform(out, lambda x: F.concat_ws("=", x["k"], x["v"].cast("string"))), ",").alias("items"))


@query("""SELECT p_partkey AS row, CASE WHEN p_size = 1 THEN 'Eksik/geçersiz alanlar: GTİP. Tüm alanlar dolu olmalıdır.' WHEN n > 1 THEN 'Dosyada tekrarlayan malzeme no: ' || p_brand WHEN there THEN 'Bu malzeme numarası zaten mevcut: ' || p_brand END AS error
FROM (SELECT *, p_brand IN ('Brand#11', 'Brand#22') AS there, row_number() OVER (PARTITION BY p_brand, p_size = 1 ORDER BY p_partkey) AS n FROM part)""")
def import_sheet(t):
    sheet = t("part").select(F.col("p_partkey").alias("row"), F.concat(F.lit(" "), "p_brand").alias("materialNo"), F.col("p_name").alias("description"), F.when(F.col("p_size") == 1, "-").otherwise(F.col("p_size").cast("string")).alias("gtipNo"))
    records = t("part").where("p_brand in ('Brand#11', 'Brand#22')").select(F.upper("p_brand").alias("materialNo"))
    return approval.import_rows(sheet, records).select("row", "error")


# --- resolution


@query("""SELECT user_id, 'parties.seller.country' AS path, 'TÜRKİYE' AS value, NULL::VARCHAR AS source FROM events GROUP BY 1 UNION ALL SELECT user_id, 'parties.buyer.country', 'HUNGARY', NULL FROM events GROUP BY 1
UNION ALL SELECT user_id, 'parties.buyer.address', 'Street ' || user_id || ' HUNGARY', 'INVOICE' FROM events GROUP BY 1""")
def overrides(t):
    u = t("events").select("user_id").distinct()
    row = lambda p, v: u.select("user_id", F.lit(p).alias("path"), v.cast("string").alias("value"), F.lit("INVOICE").alias("source"))
    resolved = changes.appended(row("parties.buyer.address", F.concat(F.lit("Street "), "user_id", F.lit(" HUNGARY"))), row("parties.seller.country", F.lit("DE")), row("parties.buyer.country", F.lit("FR")))
    return resolve.with_overrides(resolved, u, "user_id").select("user_id", "path", "value", "source")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END::INTEGER AS line_no, p_brand AS hs, CAST(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size + 0.5 END AS DOUBLE) AS quantity, 2::INTEGER AS second_no FROM part""")
def goods_normal(t):
    n = F.col("p_size")
    line = F.create_map(F.lit("lineNo"), F.when(n % 2 == 0, n.cast("string")).otherwise("0"), F.lit("HSCode"), F.concat(F.lit(" "), "p_brand"), F.lit("Quantity"), F.when(n % 3 == 0, "x").otherwise(F.concat(n, F.lit(".5"))))
    g = resolve.normal_goods(F.array(line, F.create_map(F.lit("x"), F.lit("y"))))
    return t("part").select("p_partkey", g.alias("g")).select("p_partkey", F.col("g")[0]["lineNo"].alias("line_no"), F.col("g")[0]["hsCode"].alias("hs"), F.col("g")[0]["quantity"].alias("quantity"), F.col("g")[1]["lineNo"].alias("second_no"))


@query("""WITH r AS (SELECT user_id, event_type, max(event_id) AS id FROM events GROUP BY 1, 2) SELECT user_id, count(*) AS n, string_agg(event_type || '=' || id || '@' || CASE WHEN id % 2 = 0 THEN 'INVOICE' ELSE 'PACKING_LIST' END, ',' ORDER BY event_type) AS trace FROM r GROUP BY 1""")
def lineage(t):
    last = t("events").groupBy("user_id", F.col("event_type").alias("path")).agg(F.max("event_id").alias("id"))
    rows = last.select("user_id", "path", F.col("id").cast("string").alias("value"), F.when(F.col("id") % 2 == 0, "INVOICE").otherwise("PACKING_LIST").alias("source"))
    entries = F.transform(F.array_sort(F.map_entries("trace")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"], F.lit("@"), e["value"]["source"]))
    return resolve.source_trace(rows, "user_id").select("user_id", F.size("trace").cast("long").alias("n"), F.array_join(entries, ",").alias("trace"))


@query("""SELECT user_id, arg_min(props, event_id) AS head FROM events WHERE event_type <> 'click' GROUP BY 1""")
def first_objects(t):
    e = t("events").select("user_id", F.col("event_id").alias("pos"), F.when(F.col("event_type") != "click", F.col("props")).alias("head"))
    return resolve.first_object(e, "user_id", "head")


@query("""SELECT user_id, 'p' || user_id % 25 AS path, CASE WHEN user_id % 25 % 2 = 0 THEN coalesce(max(value) FILTER (event_type = 'click'), max(value) FILTER (event_type = 'view')) ELSE coalesce(max(value) FILTER (event_type = 'view'), max(value) FILTER (event_type = 'click')) END::VARCHAR AS value
FROM events WHERE event_type IN ('click', 'view') AND user_id % 25 <> 7 GROUP BY 1 HAVING max(value) IS NOT NULL""")
def field_rule_priorities(t):
    """One stored rule a nation; every other one takes its sources the other way round, and one is disabled by empty sources."""
    values = t("events").where("event_type in ('click', 'view')").groupBy("user_id", F.col("event_type").alias("source")).agg(F.max("value").cast("string").alias("value")).withColumn("pos", F.lit(0)).withColumn("path", F.concat(F.lit("p"), F.col("user_id") % 25))
    k = F.col("n_nationkey")
    rules = t("nation").select(F.concat(F.lit("p"), k).alias("path"), F.when(k == 7, "").when(k % 2 == 0, "click").otherwise("view").alias("primary"), F.when(k == 7, None).when(k % 2 == 0, "view").otherwise("click").alias("fallback"))
    return resolve.resolve_fields(values, "user_id", resolve.field_rules(rules)).select("user_id", "path", "value")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus = 'O' THEN 2 ELSE 1 END::INTEGER AS level FROM orders""")
def approval_levels(t):
    rules = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("companyId"), F.lit(1).alias("ihracat"), F.lit(2).alias("ithalat"), F.lit(1).alias("transit"), F.lit(1).alias("antrepo"))
    d = t("orders").select("o_orderkey", F.col("o_custkey").alias("companyId"), F.when(F.col("o_orderstatus") == "O", "ithalat").otherwise("ihracat").alias("operationType"))
    return approval.approval_levels(d, rules).select("o_orderkey", "level")


@query("""SELECT o_orderkey, o_custkey % 6 NOT IN (1, 4) AS valid FROM orders""")
def licences(t):
    """Windows that begin or end four or six minutes off the moment asked for, or far from it: five minutes are allowed on both ends."""
    at, k = F.col("o_orderdate").cast("timestamp"), F.col("o_custkey") % 6
    minutes = lambda n: F.make_interval(mins=F.lit(n))
    start = F.when(k == 0, at + minutes(4)).when(k == 1, at + minutes(6)).otherwise(at - minutes(9000))
    end = F.when(k == 3, at - minutes(4)).when(k == 4, at - minutes(6)).when(k == 5, at).otherwise(at + minutes(9000))
    return t("orders").select("o_orderkey", approval.licence_valid(start, end, at).alias("valid"))


@query("""WITH r AS (SELECT DISTINCT p_brand AS screen, p_type AS capability FROM part) SELECT DISTINCT c_custkey % 50 AS user_id, capability FROM customer JOIN r ON screen = 'Brand#' || (11 + c_custkey % 3) WHERE c_custkey % 2 = 0
UNION SELECT DISTINCT c_custkey % 50, (SELECT min(capability) FROM r WHERE screen = 'Brand#11') FROM customer WHERE c_custkey % 2 = 1""")
def capability_sets(t):
    registry = t("part").select(F.col("p_brand").alias("screen"), F.col("p_type").alias("capability")).distinct().withColumn("pos", F.col("capability"))
    k = F.col("c_custkey")
    screens = t("customer").select((k % 50).alias("user_id"), F.when(k % 2 == 0, F.concat(F.lit("Brand#"), 11 + k % 3)).otherwise("Brand#11").alias("screen"), F.when(k % 2 == 0, "operate").otherwise("view").alias("level"))
    return approval.capabilities(screens, registry)


@query("SELECT o_orderkey, 'header.invoiceNo=' || o_orderkey || ',trade.paymentType=' || CASE WHEN o_custkey % 2 = 0 THEN 'own' ELSE o_orderpriority END AS merged FROM orders")
def map_concatenation(t):
    """Two maps of each order; of a key in both, the second map's value holds."""
    one = F.create_map(F.lit("header.invoiceNo"), F.col("o_orderkey").cast("string"), F.lit("trade.paymentType"), F.col("o_orderpriority"))
    two = F.create_map(F.when(F.col("o_custkey") % 2 == 0, "trade.paymentType").otherwise("header.invoiceNo"), F.when(F.col("o_custkey") % 2 == 0, "own").otherwise(F.col("o_orderkey").cast("string")))
    merged = F.array_sort(F.map_entries(views.merged_maps(one, two)))
    return t("orders").select("o_orderkey", F.array_join(F.transform(merged, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("merged"))


@query("""SELECT o_orderkey, v.tag, CASE v.tag WHEN 'Beyanname.InvoiceNo' THEN o_orderkey::VARCHAR WHEN 'Beyanname.PaymentType' THEN o_orderpriority END AS value FROM orders, (SELECT unnest(['Beyanname.Buyer', 'Beyanname.Currency', 'Beyanname.DeliveryTerm', 'Beyanname.InvoiceDate', 'Beyanname.InvoiceNo', 'Beyanname.Origin', 'Beyanname.PaymentType', 'Beyanname.Seller', 'Beyanname.TransportMode', 'Package.TotalPackage', 'Weight.GrossKg', 'Weight.NetKg']) AS tag) v""")
def xml_mapping(t):
    """Every tag of an order's document with the value that its path has."""
    m = F.create_map(*(F.lit(x) for kv in xmlout.flat_mapping().items() for x in kv))
    values = F.create_map(F.lit("header.invoiceNo"), F.col("o_orderkey").cast("string"), F.lit("trade.paymentType"), F.col("o_orderpriority"))
    return t("orders").select("o_orderkey", values.alias("values"), F.explode(m).alias("tag", "path")).select("o_orderkey", "tag", F.try_element_at("values", F.col("path")).alias("value"))


# --- sources


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'INVOICE' WHEN 'P' THEN 'PACKING_LIST' ELSE 'OTHER' END AS source_type, CASE o_orderstatus WHEN 'F' THEN 'f' || o_custkey WHEN 'P' THEN 'p' ELSE '' END AS data, CASE WHEN o_custkey % 2 = 0 THEN 'first' ELSE 'second' END AS result, CASE WHEN o_custkey % 2 = 1 THEN 'failed' END AS extract_error FROM orders""")
def extractor_dispatch(t):
    types = F.when(F.col("o_orderstatus") == "F", "INVOICE").when(F.col("o_orderstatus") == "P", "PACKING_LIST").otherwise("LETTER")
    d = collections.dispatch(t("orders").withColumn("type", types), "type", {"INVOICE": F.concat(F.lit("f"), "o_custkey"), "PACKING_LIST": F.lit("p")}, F.lit(""))
    d = collections.with_fallback(d, F.when(F.col("o_custkey") % 2 == 0, "first"), F.lit("failed"), F.lit("second"))
    return d.select("o_orderkey", "source_type", "data", "result", "extract_error")


@query("""SELECT p_partkey, CASE WHEN p_size = 1 THEN 'IMAGE_BASED_PDF' WHEN p_size < 30 AND p_size % 2 = 0 THEN 'MOSTLY_IMAGE_PDF' ELSE 'DIGITAL_TEXT_PDF' END AS kind FROM part""")
def pdf_kinds(t):
    n = F.col("p_size")
    return t("part").select("p_partkey", extract_spatial.pdf_type(F.when(n == 1, 0).otherwise(n), F.when((n == 1) | (n % 2 == 0), 3).otherwise(0)).alias("kind"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN o_orderstatus = 'P' THEN 'broken' END AS error, CASE WHEN o_orderstatus <> 'P' THEN o_custkey::VARCHAR END AS data FROM orders""")
def extraction_runs(t):
    rows = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("data"), F.when(F.col("o_orderstatus") == "P", "broken").alias("error"))
    return collections.extraction_outcome(rows, F.col("data"), F.col("error")).select("o_orderkey", F.col("extractionStatus").alias("status"), F.get("parseErrors", F.lit(0)).alias("error"), F.col("extractedData").alias("data"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'non-pdf' WHEN doc_id % 3 = 1 THEN 'not-pdf-binary' END AS reason FROM documents""")
def pdf_reasons(t):
    k = F.col("doc_id")
    return t("documents").select("doc_id", pdf.refusal(F.when(k % 3 == 0, "a.txt").otherwise("a.PDF"), F.lit(None).cast("string"), F.encode(F.when(k % 3 == 2, "%PDF-1.7 x").otherwise("hello"), "UTF-8")).alias("reason"))


# --- boxes and values of items, case by case; words of a column; order within large groups


@query("""WITH l AS (SELECT s_suppkey AS k, v.n FROM supplier, (VALUES (1), (2), (3), (4)) v(n)), i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n % 2, n) AS line_no, n * 3 + 2 AS q, n * 10 AS p, 700.0 + 200 * n AS y FROM l)
SELECT k::VARCHAR AS doc_id, line_no, CASE n WHEN 1 THEN '5' WHEN 4 THEN '3' ELSE '1' END AS quantity, CASE n WHEN 1 THEN '10,50' WHEN 4 THEN '10,00' ELSE '12,50' END AS unit_price,
CASE n WHEN 1 THEN '52,50' WHEN 4 THEN '47,77' ELSE '12,50' END AS amount, n = 4 AS needs_review, CASE WHEN n = 3 THEN NULL ELSE CAST(500 AS DOUBLE) END AS quantity_x, CASE WHEN n = 3 THEN NULL ELSE CAST(y - 5 AS DOUBLE) END AS quantity_y,
CAST(700 AS DOUBLE) AS price_x, CASE WHEN n IN (1, 4) THEN CAST(850 AS DOUBLE) END AS amount_x, CAST(100 AS DOUBLE) AS code_x, CAST(1100 AS DOUBLE) AS gtip_x FROM i""")
def item_boxes(t):
    """A pair of price and amount (line 1), an amount by expectation (2), the last money text (3), and figures that fit nothing (4); every quantity stands twice, as near above as below."""
    k, n = F.col("s_suppkey"), F.col("n")
    y = 700.0 + 200.0 * n
    case = lambda *v: F.element_at(F.array(*map(F.lit, v)), n)
    cell = lambda pos, x, s, dy=0.0: F.struct((n * 20 + pos).cast("int").alias("pos"), s.cast("string").alias("text"), F.lit(float(x)).alias("x0"), (y + dy).alias("y0"), F.lit(float(x) + 60).alias("x1"), (y + dy + 20).alias("y1"), F.lit(0.9).alias("score"))
    head = lambda pos, x, s: F.struct((n * 0 + 900 + pos).cast("int").alias("pos"), F.lit(s).alias("text"), F.lit(float(x)).alias("x0"), F.lit(600.0).alias("y0"), F.lit(float(x) + 60).alias("x1"), F.lit(620.0).alias("y1"), F.lit(0.9).alias("score"))
    q = case("5", "1", "4", "3")
    cells = [
        cell(1, 100, F.concat(F.lit("AB.CE."), n + 100)), cell(4, 500, q, -5.0), cell(14, 500, q, 5.0), cell(5, 570, F.lit("ADET")), cell(6, 700, case("10,50", "12,50", "12,50", "10,00")), cell(7, 850, case("52,50", "-", "-", "47,77")),
        cell(10, 1100, F.lpad((k * 10 + n).cast("string"), 12, "9")), head(0, 90, "Malzeme"), head(1, 490, "Miktar"), head(2, 690, "Birim Fiyat"), head(3, 840, "Tutar"),
    ]
    lines = t("supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n"))
    words = lines.select(k.cast("string").alias("doc_id"), (n % 2 + 1).cast("int").alias("page"), F.explode(F.array(*cells)).alias("w")).select("doc_id", "page", "w.*").distinct()
    b = lambda c, i: F.get(F.col(f"boxes.{c}"), F.lit(i))
    i = extract_spatial.extract_items(words)
    return i.select("doc_id", "line_no", "quantity", "unit_price", "amount", "needs_review", b("quantity", 0).alias("quantity_x"), b("quantity", 1).alias("quantity_y"), b("unit_price", 0).alias("price_x"), b("amount", 0).alias("amount_x"), b("product_code", 0).alias("code_x"), b("gtip", 0).alias("gtip_x"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity * 20 AS DOUBLE) AS x, l_returnflag AS f FROM lineitem),
p AS (SELECT k, n, x AS place, n * 30 + 7.0 AS y, CASE WHEN n % 3 > 0 THEN x - 100 END AS x_min, CASE WHEN n % 3 > 0 THEN x + 100 END AS x_max FROM l),
m AS (SELECT p.k, p.n, p.place, l.x AS x0, l.n * 30.0 AS y0, abs(l.n * 30 - p.y) AS dy, coalesce(abs(l.x - p.x_min), l.x) AS dx, l.n AS pos FROM p JOIN l ON l.k = p.k AND l.f = 'N' AND abs(l.n * 30 - p.y) <= 55 AND (p.x_min IS NULL OR l.x BETWEEN p.x_min AND p.x_max)),
r AS (SELECT *, row_number() OVER (PARTITION BY k, n, place ORDER BY dy, dx, pos, x0, y0) AS i FROM m) SELECT k, n, CAST(place AS DOUBLE) AS place, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(dy AS DOUBLE) AS dy, CAST(dx AS DOUBLE) AS dx FROM r WHERE i = 1""")
def nearest_in_columns(t):
    n, x = F.col("n"), F.col("x")
    rows = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") * 20).cast("double").alias("x"), "l_returnflag").distinct()
    probes = rows.select("k", "n", x.alias("place"), F.lit("N").alias("value"), (n * 30 + 7.0).cast("double").alias("y"), F.when(n % 3 > 0, x - 100).alias("x_min"), F.when(n % 3 > 0, x + 100).alias("x_max")).distinct()
    words = rows.select("k", F.col("l_returnflag").alias("value"), x.alias("x0"), (n * 30).cast("double").alias("y0"), n.alias("pos"))
    return joins.nearest_in_column(probes, words, ["k"], ["k", "n", "place"], 55.0).select("k", "n", "place", "x0", "y0", "dy", "dx")


@query("""SELECT event_id, min(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_at FROM events""")
def next_event_of_all(t):
    """All events are one group, in blocks of 2,000."""
    e = t("events").select("event_id", F.lit("all").alias("g"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    return ordered.next_wanted(e, ["g"], "at", F.col("event_type") == "purchase", "next_at", rows=2000).select("event_id", "next_at")


@query("""SELECT o_orderkey, sum(o_totalprice::DECIMAL(18, 2)) OVER w AS total, count(*) OVER w AS n, min(o_custkey) OVER w AS least FROM orders WINDOW w AS (ORDER BY o_custkey, o_orderkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def around_of_all(t):
    """All orders are one group, in blocks of 1,500 with a halo of three rows."""
    o = t("orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.lit(0).alias("g"))
    return ordered.around_at(o, ["g"], "o_custkey", "o_orderkey", {"total": F.sum("price"), "n": F.count("*"), "least": F.min("o_custkey")}, rows=1500).select("o_orderkey", F.col("total").cast("decimal(38,2)").alias("total"), "n", "least")


@query("""SELECT NULL AS flag, median(l_extendedprice) AS median FROM lineitem UNION ALL SELECT l_returnflag, median(l_extendedprice) FROM lineitem GROUP BY 1""")
def exact_medians(t):
    """Of all rows as one group, and of each flag, by rounds of histograms down to 50 values."""
    both = t("lineitem").select(F.explode(F.array(F.lit(None).cast("string"), F.col("l_returnflag"))).alias("flag"), F.col("l_extendedprice").alias("v"))
    return ordered.exact_median(both, ["flag"], "v", few=50)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10 OFFSET (SELECT (count(*) - 1) // 10 * 10 FROM lineitem)""")
def deep_page(t):
    """The last page of ten rows, from a table written in sixteen ranges of the order."""
    order = ["l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = t("lineitem").select(*order)
    pages = ordered.Pages.write(rows, order, f"{ordered.shared_folder(rows.sparkSession)}/pages-{uuid.uuid4().hex}", 16)
    return pages.page(pages.count(10), 10)


# --- searches, rules and navigation


@query("""WITH w AS (SELECT DISTINCT trim(lower(unnest(string_split(p_type, ' ')))) AS term FROM part UNION SELECT DISTINCT lower(left(p_name, 2)) FROM part UNION SELECT DISTINCT lower(right(p_brand, 1)) FROM part UNION SELECT 'no such text')
SELECT term, p_partkey FROM w JOIN part ON contains(lower(p_name), term) OR contains(lower(p_type), term) OR contains(lower(p_brand), term) WHERE term <> ''""")
def search_terms(t):
    """All words of part types, two and one letters, and a term that nothing has, in three columns at once."""
    p = scans.spread(t("part"))
    terms = p.select(F.explode(F.split("p_type", " ")).alias("term")).union(p.select(F.substring("p_name", 1, 2))).union(p.select(F.right("p_brand", F.lit(1)))).distinct()
    terms = terms.union(p.limit(1).select(F.lit("no such text"))).union(p.limit(1).select(F.lit("  ")))
    return search.search_all(p, "p_partkey", ["p_name", "p_type", "p_brand"], terms)


@query("""WITH r AS (SELECT s_suppkey AS rule_id, CASE s_suppkey % 4 WHEN 0 THEN p_brand ELSE left(p_brand, 6 + s_suppkey % 3) END AS brand, s_suppkey % 4 AS kind, left(p_type, 5) AS start, p_size AS size FROM supplier JOIN part ON p_partkey = s_suppkey)
SELECT p_partkey, rule_id FROM r JOIN part p ON CASE WHEN kind = 0 THEN p.p_brand = r.brand ELSE starts_with(p.p_brand, r.brand) END AND starts_with(p.p_type, start) AND (kind <> 2 OR p.p_size = r.size)""")
def rules_at_once(t):
    """One rule a supplier, made from a part: a brand or its beginning, the beginning of a type, for some a size, and a condition that is off."""
    n = F.col("s_suppkey")
    made = t("supplier").join(t("part"), n == F.col("p_partkey"))
    c = lambda field, operator, value, on=None: F.struct(F.lit(field).alias("field"), operator.alias("operator"), value.cast("string").alias("value"), (F.lit(True) if on is None else on).alias("enabled"))
    brand = F.when(n % 4 == 0, F.col("p_brand")).otherwise(F.substring(F.col("p_brand"), F.lit(1), (6 + n % 3).cast("int")))
    conditions = F.array(c("p_brand", F.when(n % 4 == 0, "equals").otherwise("starts_with"), brand), c("p_type", F.lit("starts_with"), F.substring("p_type", 1, 5)), c("p_size", F.lit("equals"), F.col("p_size"), n % 4 == 2), c("p_name", F.lit("equals"), F.lit("never"), F.lit(False)))
    return search.match_rules(t("part"), "p_partkey", ["p_brand", "p_type", "p_size", "p_name"], made.select(n.alias("rule_id"), conditions.alias("conditions")))


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 40 > 0 THEN p_partkey // 40 * 40 + (p_partkey % 40 - 1) // 3 END AS parent, p_brand AS cap, p_size AS size FROM part),
i AS (SELECT n.*, k IN (SELECT parent FROM n WHERE parent IS NOT NULL) AS inside FROM n),
down AS (SELECT k, parent, k AS root, 1 AS depth, size % 7 = 0 AS admin, cap, inside FROM i WHERE parent IS NULL AND size % 5 > 0 UNION ALL SELECT i.k, i.parent, d.root, d.depth + 1, d.admin, i.cap, i.inside FROM down d JOIN i ON i.parent = d.k),
up AS (SELECT k, parent FROM down WHERE NOT inside AND depth > 1 AND (admin OR cap IN ('Brand#11', 'Brand#23', 'Brand#42')) UNION SELECT d.k, d.parent FROM up JOIN down d ON d.k = up.parent)
SELECT d.k AS node_id, d.depth, d.root FROM down d WHERE d.k IN (SELECT k FROM up)""")
def navigation_tree(t):
    """Parts as nodes of trees of three children a node and up to five levels; the roots of some ask for another mode, some are for super admins."""
    k = F.col("p_partkey")
    root = k % 40 == 0
    parent = F.when(~root, F.floor(k / 40) * 40 + F.floor((k % 40 - 1) / 3))
    nodes = t("part").select(k.alias("node_id"), parent.cast("long").alias("parent_id"), F.array("p_brand").alias("capabilities"), F.when(root & (F.col("p_size") % 5 == 0), "cloud").when(root & (F.col("p_size") % 5 == 1), "local").alias("required_mode"), (root & (F.col("p_size") % 7 == 0)).alias("super_admin_only"))
    return views.visible_navigation(nodes, ["Brand#11", "Brand#23", "Brand#42"], "local", True)


# --- single operators that no query reached


@query("""SELECT o_orderkey, CASE WHEN d IS NULL THEN NULL WHEN o_custkey % 2 = 0 THEN 'normal' WHEN d >= 14 THEN 'red' ELSE 'warn' END AS level FROM (SELECT *, greatest(0, date_diff('day', o_orderdate::DATE, DATE '1998-08-02')) AS d FROM orders)""")
def open_day_levels(t):
    return t("orders").select("o_orderkey", dates.open_days_level(dates.open_days(F.col("o_orderdate"), F.lit("1998-08-02").cast("date")), F.col("o_custkey") % 2 == 1).alias("level"))


@query("""SELECT l_orderkey, string_agg(coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END, i) || ':' || l_returnflag, ',' ORDER BY i) AS lines
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS i FROM lineitem) GROUP BY 1""")
def goods_line_numbers(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("rows"))
    lines = F.transform("rows", lambda r: F.struct(F.when(r["l_linenumber"] % 2 == 0, r["l_partkey"]).alias("lineNo"), r["l_returnflag"].alias("hsCode")))
    numbered = views.with_line_numbers(lines, ["hsCode"])
    return rows.select("l_orderkey", F.array_join(F.transform(numbered, lambda x: F.concat_ws(":", x["lineNo"].cast("string"), x["hsCode"])), ",").alias("lines"))


@query("""WITH g AS (SELECT l_orderkey AS k, count(*) AS n, string_agg(l_returnflag, ' / ' ORDER BY l_linenumber, l_partkey, l_returnflag) FILTER (l_returnflag <> 'A') AS every, arg_min(l_returnflag, (l_linenumber, l_partkey, l_returnflag)) AS one FROM lineitem GROUP BY 1)
SELECT k, CASE WHEN one <> 'A' THEN one ELSE coalesce(every, '—') END AS name, CASE WHEN k % 3 = 0 THEN '— / 1.234,5 KG' WHEN k % 3 = 1 THEN (k % 7) || ' KAP / —' ELSE '—' END AS packed FROM g""")
def goods_summaries(t):
    k = F.col("l_orderkey")
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("rows"))
    names = F.transform("rows", lambda r: F.when(r["l_returnflag"] != "A", r["l_returnflag"]))
    return rows.select(k.alias("k"), views.trade_name(names).alias("name"), views.packed(F.when(k % 3 == 1, k % 7), F.when(k % 3 == 0, F.lit(1234.5))).alias("packed"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 3 = 0 AS failed FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS props FROM events)""")
def parsed_json(t):
    """Every third text is cut, so that it is no JSON; what can't be parsed is null and told."""
    p = views.parsed(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")), "k long")
    return t("events").select("event_id", p.alias("p")).select("event_id", F.col("p.value.k").alias("k"), F.col("p.failed").alias("failed"))


@query("""SELECT s_suppkey::VARCHAR AS doc_id, CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 40 END AS words, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 3 END AS images,
CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 > 0 THEN 'IMAGE_BASED_PDF' WHEN s_suppkey % 3 = 1 AND s_suppkey % 5 > 0 THEN 'MOSTLY_IMAGE_PDF' ELSE 'DIGITAL_TEXT_PDF' END AS pdf_type,
CASE WHEN s_suppkey % 3 = 2 OR s_suppkey % 5 = 0 THEN CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 40 END ELSE 1 END AS routed_words FROM supplier""")
def pdf_pages(t):
    """Sums over two pages a document, and where its words come from: its own, or one word of the other source."""
    k, n = F.col("s_suppkey"), F.col("n")
    each = F.when(k % 3 == 0, 0).when(k % 3 == 1, 5).otherwise(20)
    pages = t("supplier").select("s_suppkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    words = pages.select(k.cast("string").alias("doc_id"), n.alias("page"), F.when(k % 5 == 0, 0).otherwise(n).alias("images"), F.lit(None).cast("string").alias("error"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_repeat(F.lit("w"), each))).alias("text"))
    kinds = pdf.classify(words)
    ocr = t("supplier").select(k.cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit("seen").alias("text"))
    counts = pdf.routed(words, ocr).groupBy("doc_id").agg(F.count("text").alias("routed_words"))
    return kinds.join(counts, "doc_id", "left").select("doc_id", "words", "images", "pdf_type", F.coalesce("routed_words", F.lit(0)).alias("routed_words"))


@query("""SELECT o_orderkey, 'ACME ' || o_custkey || ' LTD' AS name, 'Cadde 5 KONYA' AS address FROM orders""")
def hard_spaces(t):
    """No-break and figure spaces of a seller's lines become plain ones."""
    k = F.col("o_custkey").cast("string")
    text_ = F.concat(F.lit("ACME\u00a0"), k, F.lit("\u2007LTD\nAdres:\u00a0Cadde\u00a05\nKONYA\nVKN:\u00a01234567890\nSAYIN\nBuyer\nETTN: x"))
    p = extract_text.parties(t("orders").select("o_orderkey", text_.alias("text")))
    return p.select("o_orderkey", F.translate("seller.name", "\u00a0\u2007", "  ").alias("name"), F.translate("seller.address", "\u00a0", " ").alias("address"))


@query("""SELECT s_suppkey::VARCHAR AS doc_id, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 8 > 0 THEN 2 WHEN s_suppkey % 8 = 0 THEN 2 ELSE 1 END AS attempt, CASE WHEN s_suppkey % 8 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE s_name END AS data FROM supplier""")
def extraction_ledger(t):
    """Two runs over all suppliers as documents: in the first every fourth fails, in the second, which takes only those, every eighth."""
    docs = t("supplier").select(F.col("s_suppkey").alias("doc_id"), "s_name", F.col("s_suppkey").alias("k"))
    ledger = landing.Ledger(docs.sparkSession, f"{ordered.shared_folder(docs.sparkSession)}/ledger-{uuid.uuid4().hex}")
    for n in (4, 8):
        ledger.run(docs, lambda d, n=n: (F.col("s_name"), F.when(F.col("k") % n == 0, "no text")))
    return ledger.latest().select("doc_id", F.col("attempt").cast("long").alias("attempt"), F.col("extractionStatus").alias("status"), F.col("extractedData").alias("data"))


@query("""SELECT s_suppkey::VARCHAR AS key, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey::VARCHAR ELSE '' END AS nation FROM supplier""")
def workbook_rows(t):
    """All suppliers written as workbooks, one a task, and read back; nulls are empty cells."""
    rows = scans.spread(t("supplier")).select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey")).alias("nation"))
    workbooks.register(rows.sparkSession)
    folder = f"{ordered.shared_folder(rows.sparkSession)}/workbooks-{uuid.uuid4().hex}"
    rows.write.format("workbook").mode("append").save(folder)
    cell = lambda i: F.get("cells", F.lit(i))
    return rows.sparkSession.read.format("workbook").load(folder).where("row > 1").select(cell(0).alias("key"), cell(1).alias("name"), F.coalesce(cell(2), F.lit("")).alias("nation"))


@query("""SELECT p_partkey::VARCHAR AS declaration, CASE WHEN p_partkey % 5 = 0 THEN 'file' ELSE 'b.pdf' END AS name, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE length(p_name) END AS length, CASE WHEN p_partkey % 7 = 0 THEN 'FAILED' ELSE 'PENDING' END AS status, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS content FROM part""")
def landed_uploads(t):
    """Part names landed as uploads, and read back from where their metadata says; every seventh is empty."""
    k = F.col("p_partkey")
    up = t("part").select(F.lit("c").alias("companyId"), k.cast("string").alias("declarationId"), F.lit("INVOICE").alias("type"), F.when(k % 5 > 0, "../a/b.pdf").alias("fileName"), F.when(k % 7 > 0, F.encode("p_name", "UTF-8")).alias("content"))
    folder = f"{ordered.shared_folder(up.sparkSession)}/uploads-{uuid.uuid4().hex}".removeprefix("file:").replace("///", "/")
    meta = landing.land(scans.spread(up), folder)
    return landing.contents(meta).select(F.col("declarationId").alias("declaration"), F.col("fileName").alias("name"), "length", F.col("extractionStatus").alias("status"), F.decode("content", "UTF-8").alias("content"))
