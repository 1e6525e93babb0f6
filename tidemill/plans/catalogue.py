"""The query catalogue: every operator on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import changes, dedupe, filters, joins, scans, stats
from . import approval, extract_spatial, extract_text, resolve, validate, xmlout

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function of its tables under its name, with its SQL."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        SQL[f.__name__] = sql
        return f

    return register


def micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


STATUSES = {"open": "O", "filled": "F", "pending": "P"}


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS filled,
count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderpriority = '1-URGENT') AS escalated FROM orders""")
def status_dashboard(t):
    return stats.count_bundle(t("orders"), {"total": F.lit(True)} | {n: F.col("o_orderstatus") == s for n, s in STATUSES.items()} | {"escalated": F.col("o_orderpriority") == "1-URGENT"})


@query("""SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2""")
def customer_order_counts(t):
    return joins.child_counts(t("customer").select("c_custkey", "c_name"), "c_custkey", t("orders"), "o_custkey")


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1""")
def group_count(t):
    return stats.group_count(t("orders"), ["o_custkey"]).orderBy("o_custkey")


@query("""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7
ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 10""")
def tenant_scan_page(t):
    mine = t("customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    return scans.page_of(t("orders").join(mine, "o_custkey", "left_semi").select("o_orderkey", "o_orderdate", "o_totalprice"), 2, 10, [F.desc("o_orderdate"), F.col("o_orderkey")])


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 5 ORDER BY o_orderdate""")
def child_scan(t):
    return scans.child_scan(t("orders").select("o_orderkey", "o_orderdate", "o_custkey"), "o_custkey", 5, [F.col("o_orderdate")]).select("o_orderkey", "o_orderdate")


@query("""SELECT * FROM customer WHERE c_custkey = 42 AND c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 42)""")
def point_lookup(t):
    return scans.point_lookup(t("customer"), c_custkey=42)


@query("""SELECT n_nationkey, coalesce(b.level, 1) AS level FROM nation LEFT JOIN (SELECT c_nationkey, max(CASE WHEN c_acctbal > 9900 THEN 2 END) AS level
FROM customer GROUP BY 1) b ON n_nationkey = c_nationkey""")
def singleton_default(t):
    stored = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max(F.when(F.col("c_acctbal") > 9900, 2)).alias("level"))
    return scans.singleton_or_default(t("nation"), stored, "n_nationkey", {"level": 1})


@query("""SELECT greatest(1, ceil(count(*) / 10.0))::BIGINT AS total_pages FROM orders""")
def page_count(t):
    return scans.total_pages(t("orders"), 10)


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'""")
def filter_conjunction(t):
    keep = filters.every(filters.equals_unless_blank("o_orderstatus", "O"), filters.equals_unless_blank("o_orderpriority", "2-HIGH"), filters.equals_unless_blank("o_custkey", ""), filters.equals_unless_blank("o_orderkey", filters.ALL))
    return t("orders").where(keep).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')""")
def search_multi(t):
    return t("part").where(filters.search(["p_name", "p_brand", "p_type"], " RED ")).select("p_partkey", "p_name", "p_brand")


@query("""SELECT o.o_orderkey, s.shipped FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey
WHERE s.shipped IS NULL OR (s.shipped >= TIMESTAMP '1997-01-01' AND s.shipped < TIMESTAMP '1998-01-01')""")
def date_range_nullpass(t):
    shipped = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    return t("orders").select("o_orderkey").join(shipped, "o_orderkey", "left").where(filters.within_dates(F.col("shipped").cast("timestamp"), "1997-01-01", "1997-12-31"))


@query("""WITH q AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'tescil' WHEN 'F' THEN 'kapanis-bekleyen' END AS file,
CASE WHEN o_orderpriority = '1-URGENT' THEN 'started' WHEN o_orderpriority = '2-HIGH' THEN 'completed' END AS reg,
CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'kapandi' WHEN o_orderpriority = '5-LOW' THEN 'kontrol-bekliyor' END AS closing FROM orders)
SELECT o_orderkey, ((file IS NOT DISTINCT FROM 'tescil' OR reg IS NOT DISTINCT FROM 'started') AND reg IS DISTINCT FROM 'completed') AS registration,
(file IS NOT DISTINCT FROM 'kapanis-bekleyen' OR coalesce(closing <> '' AND closing <> 'kapandi', false)) AS closing_queue FROM q""")
def queue_predicates(t):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    file, reg = F.when(s == "O", "tescil").when(s == "F", "kapanis-bekleyen"), F.when(p == "1-URGENT", "started").when(p == "2-HIGH", "completed")
    closing = F.when(p == "3-MEDIUM", "kapandi").when(p == "5-LOW", "kontrol-bekliyor")
    return t("orders").select("o_orderkey", filters.registration_queue(file, reg).alias("registration"), filters.closing_queue(file, closing).alias("closing_queue"))


@query("""WITH a AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS flags FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_contains(flags, 'R') OR len(list_distinct(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(flags, x)))) = 0 AS holds, len(flags)::INTEGER AS n FROM a""")
def array_containment(t):
    a = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return a.select("l_orderkey", filters.contains_or_all(F.col("flags"), "R", ["A", "N", "R"]).alias("holds"), F.size("flags").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(quantity, 0) AS quantity, greatest(0, 3 - coalesce(n, 0)) AS late FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def parent_child_rollup(t):
    per = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return joins.left_with_default(t("orders").select("o_orderkey"), per, "o_orderkey", {"n": 0, "quantity": 0.0}).withColumn("late", F.greatest(F.lit(0).cast("long"), 3 - F.col("n")))


@query("""WITH s AS (SELECT l_orderkey, l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS total, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(total::VARCHAR || ' ' || l_returnflag, ' / ' ORDER BY first, l_returnflag) AS totals FROM s GROUP BY 1""")
def currency_totals(t):
    return stats.sums_as_text(t("lineitem"), ["l_orderkey"], "l_returnflag", F.col("l_quantity"), F.col("l_linenumber"), lambda c: c.cast("long").cast("string"))


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def anti_existing(t):
    return joins.missing_from(t("customer").select("c_custkey", "c_name"), t("orders").where("o_orderstatus = 'P'"), F.col("c_custkey"), F.col("o_custkey"))


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def semi_exists(t):
    return joins.existing_in(t("customer").select("c_custkey"), t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'taslak' WHEN 'F' THEN 'kontrol' ELSE o_orderstatus END AS label,
CASE o_orderpriority WHEN '1-URGENT' THEN 'acil' ELSE 'normal' END AS priority FROM orders""")
def label_lookup(t):
    return t("orders").select("o_orderkey", joins.labelled(F.col("o_orderstatus"), {"O": "taslak", "F": "kontrol"}).alias("label"), joins.labelled(F.col("o_orderpriority"), {"1-URGENT": "acil"}, F.lit("normal")).alias("priority"))


@query("""SELECT o_orderkey, coalesce(c_name, 'none') AS name, coalesce(s_name, 'none') AS agent FROM orders
LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_custkey""")
def reference_join(t):
    o = joins.left_with_default(t("orders").select("o_orderkey", F.col("o_custkey").alias("k")), t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), "k", {"name": "none"})
    return joins.left_with_default(o, t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("agent")), "k", {"agent": "none"}).drop("k")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'existing' WHEN n > 1 THEN 'duplicate' ELSE 'sent' END AS outcome FROM e""")
def dedupe_first(t):
    e = t("events")
    stored = e.where("user_id % 10 = 0").select("user_id", "event_type")
    key = F.concat_ws("/", "user_id", "event_type")
    return dedupe.keep_first(e, key, [F.col("ts"), F.col("event_id")], stored, key).select("event_id", "outcome")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
o AS (SELECT CASE WHEN n > 1 THEN 'duplicate' ELSE 'sent' END AS outcome FROM e)
SELECT count(*) FILTER (outcome = 'sent') AS sent, count(*) FILTER (outcome <> 'sent') AS skipped, count(*) FILTER (outcome = 'duplicate') AS skipped_duplicates, 0::BIGINT AS skipped_existing FROM o""")
def dedupe_counts(t):
    return dedupe.outcome_counts(dedupe.keep_first(t("events"), F.concat_ws("/", "user_id", "event_type"), [F.col("ts"), F.col("event_id")]))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def uniqueness_violations(t):
    return dedupe.violations(t("lineitem"), [F.col("l_orderkey"), F.col("l_linenumber")])


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 1),
h AS (SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS had FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2)
SELECT o_orderkey, n.o_orderstatus || '-' || year(o_orderdate) || '-' || CASE WHEN k + coalesce(had, 0) < 1000 THEN lpad((k + coalesce(had, 0))::VARCHAR, 4, '0') ELSE (k + coalesce(had, 0))::VARCHAR END AS ref
FROM n LEFT JOIN h ON h.o_orderstatus = n.o_orderstatus AND h.y = year(n.o_orderdate)""")
def reference_numbers(t):
    o = t("orders").withColumn("year", F.year("o_orderdate"))
    n = dedupe.reference_numbers(o.where("o_orderkey % 2 = 1"), o.where("o_orderkey % 2 = 0"), ["o_orderstatus", "year"], [F.col("o_orderdate"), F.col("o_orderkey")], F.to_date("o_orderdate"))
    return n.select("o_orderkey", text.padded_ref(F.col("o_orderstatus"), F.col("year"), F.col("number")).alias("ref"))


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no FROM events""")
def ordinal_lines(t):
    return scans.numbered(t("events").select("event_id", "user_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "line_no")


@query("""SELECT event_id, round(avg(value) OVER w, 6) AS mean, count(*) FILTER (event_type = 'error') OVER w AS errors FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def sliding_pm3(t):
    rows = scans.around(t("events"), ["user_id"], [F.col("ts"), F.col("event_id")], {"mean": F.avg("value"), "errors": F.count(F.when(F.col("event_type") == "error", 1))})
    return rows.select("event_id", F.round("mean", 6).alias("mean"), "errors")


@query("""SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped FROM events) WHERE stopped = 0""")
def take_while(t):
    return scans.before_first(t("events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error").select("event_id", "user_id")


@query("""SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def neighbour_lines(t):
    return scans.neighbours(t("events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("event_id", "before", "after")


@query("""SELECT a.event_id, b.event_id AS other_id, epoch_us(b.ts) - epoch_us(a.ts) AS gap FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 21600000000""")
def band_join(t):
    e = t("events").select("event_id", "user_id", micros("ts").alias("at"))
    p = joins.near_pairs(e, e, ["user_id"], "at", 21_600_000_000, ("event_id", "event_id"))
    return p.select("event_id", F.col("b_event_id").alias("other_id"), (F.col("b_at") - F.col("at")).alias("gap"))


@query("""SELECT event_id, (SELECT min(epoch_us(p.ts)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts) AS next_at FROM events e""")
def next_event(t):
    e = t("events").select("event_id", "user_id", "event_type", micros("ts").alias("at"))
    return joins.next_matching(e, ["user_id"], "at", F.col("event_type") == "purchase", "next_at").select("event_id", "next_at")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS tick FROM events),
r AS (SELECT a.event_id, b.event_id AS nearest_id, abs(a.tick - b.tick) AS nearest_gap,
row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.tick - b.tick), b.tick, b.event_id) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id <> b.event_id)
SELECT e.event_id, nearest_id, nearest_gap FROM e LEFT JOIN r ON r.event_id = e.event_id AND n = 1""")
def nearest(t):
    e = t("events").select("event_id", "user_id", micros("ts").alias("at"))
    return joins.nearest_other(e, ["user_id"], "at", "event_id").select("event_id", "nearest_id", "nearest_gap")


@query("""WITH l AS (SELECT l_orderkey, l_quantity AS q, l_extendedprice AS p FROM lineitem)
SELECT a.l_orderkey, a.q, a.p AS first, b.p AS second FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.p <> b.p AND abs(a.p - b.p) < 50""")
def theta_self(t):
    a = t("lineitem").select("l_orderkey", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("first"))
    b = t("lineitem").select("l_orderkey", F.col("l_extendedprice").alias("second"))
    return a.join(b, "l_orderkey").where((F.col("first") != F.col("second")) & (F.abs(F.col("first") - F.col("second")) < 50))


@query("""SELECT user_id, round(median(value), 6) AS median, count(value) AS n FROM events GROUP BY 1 HAVING count(value) >= 2""")
def median_centre(t):
    return stats.median_if(t("events"), ["user_id"], "value", 2).withColumn("median", F.round("median", 6))


@query("""SELECT l_orderkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high, max(l_extendedprice) FILTER (l_returnflag = 'R') AS high_r FROM lineitem GROUP BY 1 HAVING count(*) >= 4""")
def extremes(t):
    return stats.extremes(t("lineitem"), ["l_orderkey"], "l_extendedprice", 4, F.col("l_returnflag") == "R").withColumnRenamed("high_if", "high_r")


@query("""SELECT count(*) AS total, count(*) FILTER (date_trunc('month', o_orderdate) = TIMESTAMP '1998-03-01') AS this_month,
count(*) FILTER (o_orderpriority <> '1-URGENT') AS clean, count(*) FILTER (o_orderpriority = '1-URGENT') AS warned FROM orders WHERE o_orderstatus = 'F'""")
def archive_stats(t):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    fine = filters.complete(urgent, F.array())
    return stats.count_bundle(t("orders").where("o_orderstatus = 'F'"), {"total": F.lit(True), "this_month": dates.same_month(F.col("o_orderdate").cast("timestamp"), F.lit("1998-03-15").cast("timestamp")), "clean": fine, "warned": ~fine})


@query("""WITH a AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (len(s) > 3) AS active, count(*) FILTER (len(s) <= 3) AS passive, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS distinct_items FROM a""")
def array_distinct_count(t):
    a = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    return stats.distinct_over_arrays(a, "s", F.size("s") > 3)


@query("""SELECT DISTINCT p_brand FROM part ORDER BY 1""")
def distinct_sorted(t):
    return stats.distinct_sorted(t("part"), "p_brand")


RULES = {"value": ["purchase", "click", "view"]}


@query("""WITH e AS (SELECT user_id, event_type AS source, event_id AS pos, CAST(value AS VARCHAR) AS value, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS p FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p, pos) AS n FROM e WHERE p IS NOT NULL AND value <> '')
SELECT user_id, 'value' AS path, value, source FROM r WHERE n = 1""")
def priority_resolve(t):
    e = t("events")
    values = e.select("user_id", F.col("event_type").alias("source"), F.col("event_id").alias("pos"), F.lit("value").alias("path"), F.col("value").cast("string").alias("value"))
    return resolve.resolve_fields(values, "user_id", resolve.priority_table(e.sparkSession, RULES))


@query("""WITH e AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'INVOICE' WHEN 'click' THEN 'E_INVOICE_XML' WHEN 'view' THEN 'EXPORT_INVOICE' WHEN 'error' THEN 'OTHER' ELSE 'PROFORMA' END AS source, event_id FROM events),
g AS (SELECT user_id, source, count(*) AS n, min(event_id) AS first FROM e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE source WHEN 'INVOICE' THEN 1 WHEN 'E_INVOICE_XML' THEN 2 WHEN 'EXPORT_INVOICE' THEN 3 ELSE 4 END) AS k FROM g WHERE source <> 'OTHER')
SELECT user_id, source, n, first FROM r WHERE k = 1""")
def goods_resolve(t):
    source = joins.labelled(F.col("event_type"), {"purchase": "INVOICE", "click": "E_INVOICE_XML", "view": "EXPORT_INVOICE", "error": "OTHER", "signup": "PROFORMA"})
    lists = t("events").groupBy("user_id", source.alias("source")).agg(F.array_sort(F.collect_list("event_id")).alias("lines"), F.min("event_id").alias("pos"))
    return resolve.resolve_goods(lists, "user_id").select("user_id", "source", F.size("lines").cast("long").alias("n"), F.get("lines", F.lit(0)).alias("first"))


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'Fatura numarası zorunludur.' END, CASE WHEN c_name IS NULL THEN 'Yurt dışı alıcı firma zorunludur.' END,
CASE WHEN coalesce(n, 0) < 1 THEN 'En az bir ürün kalemi olmalıdır.' END], lambda x: x IS NOT NULL), '; ') AS errors,
CASE WHEN o_orderstatus = 'P' OR c_name IS NULL OR coalesce(n, 0) < 1 THEN 'ERROR' WHEN o_orderstatus = 'F' THEN 'XML_GENERATED' ELSE 'READY' END AS status
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN s ON l_orderkey = o_orderkey""")
def validate_rules(t):
    per = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left").join(per, "o_orderkey", "left")
    fields = {"header.invoiceNo": F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey").cast("string")), "parties.buyer.name": F.col("c_name")}
    messages = {k: validate.MESSAGES[k] for k in ("header.invoiceNo", "parties.buyer.name", "goodsLines")}
    errors = validate.errors_of(fields, F.col("n"), messages)
    return o.select("o_orderkey", F.array_join(errors, "; ").alias("errors"), validate.next_status(F.lit(True), errors, F.when(F.col("o_orderstatus") == "F", "x")).alias("status"))


@query(r"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\d{10,12}')) AS run FROM documents)
SELECT doc_id, rpad(run, 12, '0') AS gtip, length(run) <> 12 AS needs_review, CASE length(run) WHEN 12 THEN 'exact' WHEN 11 THEN 'padded_zero_11' ELSE 'padded_zero_10' END AS method FROM r""")
def gtip_runs(t):
    return scans.spread(t("documents")).select("doc_id", F.explode(extract_spatial.tariff_codes(F.col("text"))).alias("c")).select("doc_id", "c.gtip", "c.needs_review", "c.method")


# The patterns of the fields in DuckDB's dialect, as in extract_text.
_D = r"CASE WHEN regexp_matches(f, '{0}') THEN regexp_extract(f, '{0}', 1) END"
_NUM = "CASE WHEN strpos(reverse({0}), ',') > 0 AND (strpos(reverse({0}), '.') = 0 OR strpos(reverse({0}), ',') < strpos(reverse({0}), '.')) THEN TRY_CAST(regexp_replace(replace({0}, '.', ''), '^([^,]*),', '\\1.') AS DOUBLE) ELSE TRY_CAST(replace({0}, ',', '') AS DOUBLE) END"
_HEAD = {
    "no1": r"(?i)(?:Fatura\s*No|Invoice\s*No\.?|Fatura\s*Numaras[ıi]|Invoice\s*Number|FATURA\s*NO)\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/]{3,40})", "no2": r"(?i)\b(CLK[0-9A-Z\-]{6,32})\b", "no3": r"\b([A-Z]{2,5}\d{8,18})\b",
    "iso": r"\b(20\d{2}-\d{2}-\d{2})\b", "d1": r"(?i)(?:Fatura\s*Tarihi|Invoice\s*Date|Date\s*of\s*Invoice)\s*[:\-]?\s*(\d{2}[./-]\d{2}[./-]\d{4})", "d2": r"\b(\d{2}[./-]\d{2}[./-]\d{4})\b",
    "cur": r"\b(EUR|USD|TRY|GBP|CHF|JPY|CNY)\b", "t1": r"(?i)Mal\s*Hizmet\s*Toplam\s*Tutar[ıi]?\s*([\d.]+,\d{2})\s*(?:EUR|USD|TRY)?", "t2": r"(?i)(?:Genel\s*Toplam|Grand\s*Total|Toplam\s*Tutar|Ödenecek\s*Tutar)\s*[:\-]?\s*([\d.]+,\d{2}|\d+[.,]\d{2})",
    "term": r"(?i)\b(EXW|FOB|FCA|FAS|CFR|CIF|CPT|CIP|DAP|DPU|DDP)\b", "p1": r"(?i)ÖDEME\s*ŞEKLİ\s*:\s*([^-\n]{2,80}?)(?:\s*-|\s*$)", "p2": r"(?i)(?:Ödeme\s*Şekli|Payment\s*Terms?|Payment\s*Type)\s*[:\-]?\s*([^-\n]{3,80})",
    "o1": r"(?i)MALLARIMIZ\s+([^.]+)\.", "o2": r"(?i)(?:Menşe|Origin|Country\s*of\s*origin)\s*[:\-]?\s*([A-Za-zğüşöçıİĞÜŞÖÇ\s]{3,80})",
    "m1": r"(?i)(?:Taşıma|Gönderilme|Transport)\s*(?:Şekli|Mode|Type)?\s*[:\-]?\s*(Karayolu|Denizyolu|Havayolu|Demiryolu|Multimodal)", "m2": r"\b(Karayolu|Denizyolu|Havayolu|Demiryolu)\b",
    "k1": r"(?i)TOPLAM\s*KAP\s*:\s*(\d+)", "k2": r"(?i)(?:Kap\s*Adedi|Toplam\s*Kap|Total\s*Packages?|No\.?\s*of\s*Packages?)\s*[:\-]?\s*(\d+)", "kt": r"(?i)TOPLAM\s*KAP\s*:\s*\d+\s*([A-ZÇĞİÖŞÜa-zçğıöşü]+)",
    "g1": r"(?i)BRÜT\s*KG\s*:\s*([\d.,]+)", "g2": r"(?i)(?:Brüt|Gross)\s*(?:Ağırlık|Weight|KG|kg)?\s*[:\-]?\s*([\d.,]+)", "n1": r"(?i)NET\s*KG\s*:\s*([\d.,]+)", "n2": r"(?i)(?:Net|Net\s*Ağırlık|Net\s*Weight)\s*[:\-]?\s*([\d.,]+)",
}


@query("WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents), m AS (SELECT doc_id, " + ", ".join(f"{_D.format(p)} AS {n}" for n, p in _HEAD.items()) + """ FROM f),
x AS (SELECT *, coalesce(t1, t2) AS t, coalesce(g1, g2) AS g, coalesce(n1, n2) AS n, coalesce(d1, d2) AS d FROM m)
SELECT doc_id, coalesce(no1, no2, no3) AS invoice_no, coalesce(iso, d[7:10] || '-' || d[4:5] || '-' || d[1:2]) AS invoice_date, cur AS currency, """ + _NUM.format("t") + """ AS total_amount, upper(term) AS delivery_term,
left(trim(regexp_replace(coalesce(p1, p2), '[-_]{3,}', '', 'g')), 120) AS payment_type, left(trim(coalesce(o1, o2)), 120) AS origin, coalesce(m1, m2) AS transport_mode, CAST(coalesce(k1, k2) AS DOUBLE) AS total_package, left(kt, 40) AS package_type, """ + _NUM.format("g") + " AS gross_kg, " + _NUM.format("n") + " AS net_kg FROM x")
def text_fields(t):
    flat = scans.spread(t("documents")).select("doc_id", text.js_trim(text.collapse(F.col("text"))).alias("flat"))
    return extract_text.with_header_fields(flat, "flat").drop("flat")


@query(r"""WITH w AS (SELECT doc_id, regexp_replace(list_extract(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), -1), '[,;:.]+$', '') AS w FROM documents)
SELECT doc_id, CASE WHEN length(w) BETWEEN 3 AND 56 AND regexp_full_match(w, '\p{L}+') AND upper(w) NOT IN ('VESZPREM','ISTANBUL','İSTANBUL','ANKARA','İZMİR','IZMIR','KONYA','BURSA','ADANA','HRSZ','UTCA') THEN w END AS country FROM w""")
def country_token(t):
    return t("documents").select("doc_id", text.country_of_address(F.col("text")).alias("country"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, replace(replace(replace(printf('%,.2f', l_extendedprice), ',', '#'), '.', ','), '#', '.') AS shown FROM lineitem)
SELECT l_orderkey, l_linenumber, shown, CAST(replace(replace(shown, '.', ''), ',', '.') AS DOUBLE) AS last_separator, CAST(replace(replace(shown, '.', ''), ',', '.') AS DOUBLE) AS comma_decimal FROM a""")
def amount_parse(t):
    shown = numbers.tr_format(F.col("l_extendedprice"))
    return t("lineitem").select("l_orderkey", "l_linenumber", shown.alias("shown"), numbers.last_separator_amount(shown).alias("last_separator"), numbers.comma_decimal(shown).alias("comma_decimal"))


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, CAST(floor(l_extendedprice) AS BIGINT) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(q AS BIGINT)::VARCHAR AS quantity FROM q WHERE p > 0""")
def quantity_repair(t):
    p = F.floor("l_extendedprice")
    amount = F.concat((p * F.col("l_quantity").cast("long")).cast("string"), F.lit(",00"))
    fixed = numbers.repaired_quantity(F.lit("7777"), F.concat(p.cast("string"), F.lit(",00")), amount)
    return t("lineitem").where(p > 0).select("l_orderkey", "l_linenumber", fixed["quantity"].alias("quantity"))


@query("""SELECT c_custkey, CASE WHEN contains(trim(c_name), ' ') THEN upper(substr(c_name, 1, 1) || substr(string_split(c_name, ' ')[2], 1, 1)) ELSE upper(substr(c_name, 1, 2)) END AS initials,
lower(replace(replace(trim(c_mktsegment), 'I', 'ı'), 'İ', 'i')) AS fold_key, 'DCL-' || upper(right(lpad(to_hex(c_custkey), 24, '0'), 6)) AS ref,
replace(replace('<' || c_name || ' & co>', '&', '&amp;'), '<', '&lt;') AS half_escaped FROM customer""")
def name_functions(t):
    half = F.replace(F.replace(F.concat(F.lit("<"), "c_name", F.lit(" & co>")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return t("customer").select("c_custkey", text.initials(F.col("c_name")).alias("initials"), text.fold_key(F.col("c_mktsegment")).alias("fold_key"), text.tail_ref(F.lpad(F.hex("c_custkey"), 24, "0")).alias("ref"), half.alias("half_escaped"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml,
lower(replace(replace(text, 'I', 'ı'), 'İ', 'i')) AS folded FROM documents""")
def text_escapes(t):
    return scans.spread(t("documents")).select("doc_id", text.escape_xml(F.col("text")).alias("xml"), text.turkish_lower(F.col("text")).alias("folded"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""WITH a AS (SELECT doc_id, max(toxic) AS mark, 0.7 AS confidence FROM labels GROUP BY 1), b AS (SELECT doc_id, n_chars % 2 AS mark, CASE WHEN n_chars > 2000 THEN 0.8 ELSE 0.5 END AS confidence FROM documents)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CAST(CASE WHEN a.doc_id IS NULL OR a.confidence < b.confidence THEN b.mark ELSE a.mark END AS BIGINT) AS mark FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def merge_confidence(t):
    a = t("labels").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("mark"), F.lit(0.7).alias("confidence"))
    b = t("documents").select("doc_id", (F.col("n_chars") % 2).alias("mark"), F.when(F.col("n_chars") > 2000, 0.8).otherwise(0.5).alias("confidence"))
    return changes.merged_by_confidence(a, b, ["doc_id"], "confidence").select("doc_id", "mark")


@query("""SELECT event_id, value FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, value FROM events WHERE event_type = 'purchase'""")
def append_union(t):
    e = t("events")
    return changes.appended(e.where("event_type = 'error'"), e.where("event_type = 'purchase'")).select("event_id", "value")


@query("""SELECT c_custkey, c_name, coalesce(p.bal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS bal FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) p ON o_custkey = c_custkey""")
def patch_merge(t):
    patch = t("orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return changes.patched(t("customer").select("c_custkey", "c_name", "c_acctbal"), patch, "c_custkey")


@query("""SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -1 AS c_custkey, 'new' AS c_name""")
def upsert_rows(t):
    c = t("customer").select("c_custkey", "c_name")
    one = c.sparkSession.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("new").alias("c_name"))
    new = t("customer").where("c_nationkey = 3").select("c_custkey", F.lit("new").alias("c_name")).unionByName(one)
    return changes.upserted(c, new, ["c_custkey"])


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def cascade_delete(t):
    gone = t("customer").where("c_nationkey = 3").select("c_custkey")
    left = changes.cascade_delete({"customer": t("customer"), "orders": t("orders").withColumnRenamed("o_custkey", "c_custkey")}, gone, "c_custkey", ("customer", "c_custkey"))
    return left["orders"].select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NOT (o_totalprice > 100000) ELSE o_totalprice > 100000 END AS active FROM orders""")
def toggle_flag(t):
    o = t("orders").withColumn("active", F.col("o_totalprice") > 100000)
    return changes.toggled(o, "active", F.col("o_orderstatus") == "O").select("o_orderkey", "active")


@query("""SELECT o_orderkey, greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02')) AS days,
CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') <= 2 THEN '0-2' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') <= 5 THEN '3-5' ELSE '5+' END AS bucket,
strftime(o_orderdate, '%d.%m.%Y') AS shown FROM orders""")
def open_days(t):
    d = dates.open_days(F.col("o_orderdate"), F.lit("1998-08-02").cast("date"))
    return t("orders").select("o_orderkey", d.cast("long").alias("days"), dates.age_bucket(d).alias("bucket"), dates.short_date(F.col("o_orderdate")).alias("shown"))


@query("""WITH g AS (SELECT l_orderkey, string_agg('  <GoodsLine>' || chr(10) || '    <HSCode>' || l_partkey || '</HSCode>' || chr(10) || '    <Description>' || l_linestatus || '</Description>' || chr(10)
|| '    <Quantity>' || CAST(l_quantity AS BIGINT) || '</Quantity>' || chr(10) || '    <UnitPrice></UnitPrice>' || chr(10) || '    <Unit>' || l_returnflag || '</Unit>' || chr(10) || '  </GoodsLine>', chr(10)
ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<Beyanname xmlns="urn:evrim:draft">' || chr(10) || '  <InvoiceNo>' || o_orderkey || '</InvoiceNo>' || chr(10) || '  <InvoiceDate>' || strftime(o_orderdate, '%Y-%m-%d') || '</InvoiceDate>' || chr(10)
|| '  <Currency></Currency>' || chr(10) || '  <Buyer></Buyer>' || chr(10) || '  <Seller></Seller>' || chr(10) || '  <DeliveryTerm></DeliveryTerm>' || chr(10) || '  <TransportMode></TransportMode>' || chr(10) || '  <PaymentType>' || o_orderpriority || '</PaymentType>' || chr(10) || '  <Origin></Origin>' || chr(10)
|| '  <GoodsLines>' || chr(10) || coalesce(lines || chr(10), '') || '  </GoodsLines>' || chr(10) || '  <Package>' || chr(10) || '    <TotalPackage></TotalPackage>' || chr(10) || '  </Package>' || chr(10) || '  <Weight>' || chr(10) || '    <GrossKg></GrossKg>' || chr(10) || '    <NetKg></NetKg>' || chr(10) || '  </Weight>' || chr(10) || '</Beyanname>' AS xml
FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""")
def xml_document(t):
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    goods = F.transform("rows", lambda r: F.struct(r["l_partkey"].cast("string").alias("hsCode"), r["l_linestatus"].alias("description"), r["l_quantity"].alias("quantity"), r["l_returnflag"].alias("unit"), F.lit(None).cast("double").alias("unitPrice"), F.lit(None).cast("double").alias("lineTotal")))
    o = t("orders").join(lines, "o_orderkey", "left").withColumn("goods", F.coalesce(goods, F.array().cast("array<struct<hsCode:string,description:string,quantity:double,unit:string,unitPrice:double,lineTotal:double>>")))
    paths = {"header.invoiceNo": F.col("o_orderkey").cast("string"), "header.invoiceDate": F.date_format("o_orderdate", "yyyy-MM-dd"), "trade.paymentType": F.col("o_orderpriority")}
    return o.select("o_orderkey", xmlout.declaration_xml(paths, F.col("goods")).alias("xml"))


@query("""WITH r AS (SELECT p_partkey, lower(replace(replace(trim(p_name), 'I', 'ı'), 'İ', 'i')) AS k, row_number() OVER (PARTITION BY lower(replace(replace(trim(p_name), 'I', 'ı'), 'İ', 'i')) ORDER BY p_partkey) AS n FROM part),
e AS (SELECT DISTINCT lower(replace(replace(trim(p_name), 'I', 'ı'), 'İ', 'i')) AS k FROM part WHERE p_size = 1)
SELECT p_partkey AS pos, CASE WHEN e.k IS NOT NULL THEN 'existing' WHEN n > 1 THEN 'duplicate' ELSE 'sent' END AS outcome, 'pending' AS status FROM r LEFT JOIN e ON e.k = r.k""")
def send_to_approval(t):
    items = t("part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("materialNo"), F.col("p_type").alias("description"), F.col("p_brand").alias("foundGtip"))
    stored = t("part").where("p_size = 1").select(F.col("p_name").alias("materialNo"))
    return approval.send_to_approval(items, stored).select("pos", "outcome", "status")


@query("""SELECT p_partkey, CASE WHEN p_size < 3 THEN 'Eksik' WHEN p_size % 2 = 0 THEN 'Uyumlu' ELSE 'Uyumsuz' END AS verdict FROM part""")
def compliance(t):
    theirs = F.when(F.col("p_size") < 3, "").otherwise(F.concat(F.lit("8471."), (F.col("p_size") % 2).cast("string")))
    return t("part").select("p_partkey", approval.compliance(F.lit("84710"), theirs).alias("verdict"))


@query("""SELECT user_id, array_to_string(list_sort(list(DISTINCT CAST(value AS VARCHAR))), ',') AS vals FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 HAVING count(DISTINCT value) > 1""")
def source_conflicts(t):
    v = t("events").where("event_type in ('click', 'view')").select("user_id", F.lit("value").alias("path"), F.col("value").cast("string").alias("value"))
    return approval.conflicts(v, "user_id").select("user_id", F.array_join("values", ",").alias("vals"))
