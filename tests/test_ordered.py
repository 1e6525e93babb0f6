"""Order within groups of any size against plain Python: one group of all rows, ties, nulls, empty tables."""

import random
import statistics

from pyspark.sql import functions as F

from tidemill.operators import joins, ordered


def test_next_wanted_in_blocks(spark):
    r = random.Random(1)
    rows = [(i, "g", r.randrange(3000), r.random() < 0.05) for i in range(900)] + [(1000 + i, "h", i % 4, i == 7) for i in range(20)] + [(2000, None, 5, True)]
    df = spark.createDataFrame(rows, "id int, g string, at long, w boolean")
    for size in (50, 5, 10_000):
        got = {x.id: x.nxt for x in ordered.next_wanted(df, ["g"], "at", F.col("w"), "nxt", rows=size).collect()}
        want = {i: min((b for _, h, b, w in rows if h == g and w and b > a), default=None) for i, g, a, _ in rows if g}
        assert {k: v for k, v in got.items() if k != 2000} == want and got[2000] is None and len(got) == len(rows)
    assert ordered.next_wanted(df.limit(0), ["g"], "at", F.col("w"), "nxt").count() == 0


def test_next_wanted_takes_time_in_proportion(spark):
    """No frame that shrinks from row to row, which Spark makes anew for each, and blocks found by halves; a row without a place has no next."""
    df = spark.createDataFrame([(i, "g", i // 3, i % 50 == 0) for i in range(3000)] + [(-1, "g", None, False)], "id int, g string, at long, w boolean")
    out = ordered.next_wanted(df, ["g"], "at", F.col("w"), "nxt", rows=10)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "unboundedfollowing" not in plan and "filter(_cuts" not in plan
    got = {r.id: r.nxt for r in out.collect()}
    places = [i // 3 for i in range(3000) if i % 50 == 0]
    assert got == {i: next((p for p in places if p > i // 3), None) for i in range(3000)} | {-1: None}
    cuts = [*range(0, 2 * (ordered.MOST_BLOCKS - 1), 2)]
    asked = [-1, 0, 1, 2, 999, 1000, cuts[-1] - 1, cuts[-1], cuts[-1] + 1, None]
    rows = spark.createDataFrame([(cuts, v) for v in asked] + [([], 1), (None, 1)], "cuts array<int>, v int")
    assert [r[0] for r in rows.select(ordered.places_upto(F.col("cuts"), F.col("v"))).collect()] == [sum(c <= v for c in cuts) if v is not None else 0 for v in asked] + [0, 0]


def test_halo_of_neighbours(spark):
    r = random.Random(2)
    rows = [(i, "g", r.choice([r.randrange(400), 7]), r.randrange(100)) for i in range(500)] + [(600, "h", 1, 5), (601, "h", 1, 6)]
    df = spark.createDataFrame(rows, "id int, g string, at int, v int")
    for size in (40, 3, 1000):
        got = {x.id: (x.s, x.n) for x in ordered.around_at(df, ["g"], "at", "id", {"s": F.sum("v"), "n": F.count("*")}, rows=size).collect()}
        for g in "gh":
            own = sorted((a, i, v) for i, h, a, v in rows if h == g)
            for k, (_, i, _) in enumerate(own):
                near = own[max(0, k - 3) : k + 4]
                assert got[i] == (sum(v for _, _, v in near), len(near))


def test_exact_median(spark):
    r = random.Random(3)
    groups = {"many": [r.gauss(0, 1e6) for _ in range(3001)], "even": [r.choice([1.0, 2.0]) for _ in range(400)], "one": [5.0], "same": [2.5] * 700, "far": [1e-300, 1e300, 1e299, -1e300] * 30, None: [float(i) for i in range(100)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("many", None), ("many", float("nan")), ("none", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    for few in (20, 10_000):
        got = {x.g: x["median"] for x in ordered.exact_median(df, ["g"], "v", few=few).collect()}
        assert got == {g: statistics.median(vs) for g, vs in groups.items()}
    assert ordered.exact_median(df.limit(0), ["g"], "v").count() == 0


def test_pages_read_their_range_only(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, r.choice([None, *range(30)])) for i in range(1003)]
    df = spark.createDataFrame(rows, "id int, k int").repartition(5)
    pages = ordered.Pages.write(df, ["k", "id"], str(tmp_path / "pages"), 8)
    own = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    assert pages.count(10) == 101
    for n in (1, 2, 57, 101, 102):
        assert [tuple(x)[:2] for x in pages.page(n, 10).select("id", "k").collect()] == own[(n - 1) * 10 : n * 10]
    assert "PartitionFilters: [isnotnull(_range" in pages.page(101, 10)._jdf.queryExecution().toString().replace("_range#", "_range")
    empty = ordered.Pages.write(df.limit(0), ["k", "id"], str(tmp_path / "none"), 4)
    assert empty.count(10) == 1 and empty.page(1, 10).count() == 0


def test_nearest_word_of_a_column(spark):
    r = random.Random(5)
    words = [(r.choice("ab"), r.choice("uv"), float(r.randrange(0, 900, 10)), float(r.randrange(0, 300, 5)), i) for i in range(300)]
    probes = [(i, r.choice("abc"), r.choice("uvw"), float(r.randrange(300)), *(r.choice([(None, None), (float(x := r.randrange(800)), x + float(r.randrange(250)))]))) for i in range(200)]
    got = joins.nearest_in_column(spark.createDataFrame(probes, "id int, g string, value string, y double, x_min double, x_max double"), spark.createDataFrame(words, "g string, value string, x0 double, y0 double, pos int"), ["g"], ["id"], 55.0)
    want = {}
    for i, g, v, y, low, high in probes:
        near = [(abs(b - y), abs(a - low) if low is not None else a, p) for h, w, a, b, p in words if (h, w) == (g, v) and abs(b - y) <= 55 and (low is None or low <= a <= high)]
        if near:
            want[i] = min(near)
    assert {x.id: (x.dy, x.dx, x.pos) for x in got.collect()} == want
