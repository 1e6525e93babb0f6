"""Gram and rule indexes, navigation trees and small view models against plain Python."""

import random
import re

from pyspark.sql import functions as F

from tidemill.functions import dates
from tidemill.operators import filters, search
from tidemill.plans import extract_text, views
from tidemill.sources import pdf
from tidemill.streaming import events


def test_searches_find_what_a_scan_finds(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("abcÇi ") for _ in range(r.randrange(0, 30))), r.choice([None, "Common Part", "x"])) for i in range(300)]
    terms = ["abc", "ab", "a", "Ç", "common part", " mon p", "zzz", "", "  ", "abcab", "AB", None, "abc"]
    df, asked = spark.createDataFrame(rows, "id int, t string, u string"), spark.createDataFrame([(x,) for x in terms], "term string")
    got = sorted(map(tuple, search.search_all(df, "id", ["t", "u"], asked).collect()))
    wanted = {x.strip(" ").lower() for x in terms if x} - {""}
    assert got == sorted((w, i) for w in wanted for i, t, u in rows if w in t.lower() or w in (u or "").lower())
    kept = search.postings(df, "id", ["t", "u"])
    assert sorted(map(tuple, search.search_all(df, "id", ["t", "u"], asked, kept).collect())) == got
    assert search.search_all(df.limit(0), "id", ["t"], asked).count() == 0 and search.search_all(df, "id", ["t"], asked.limit(0)).count() == 0


def test_searches_broadcast_nothing_but_measured_terms(spark, tmp_path, monkeypatch):
    """Grams exploded from a small file look as small as it; only terms that were counted go through the driver."""
    spark.range(50).select("id", F.concat(F.lit("part "), "id").alias("t")).write.parquet(str(tmp_path / "rows"))
    rows, terms = spark.read.parquet(str(tmp_path / "rows")), spark.createDataFrame([("art 4",), ("9",)], "term string")
    wanted = [("9", i) for i in range(50) if "9" in str(i)] + [("art 4", i) for i in (4, *range(40, 50))]
    for chars, sent in ((search.BROADCAST_CHARS, 1), (0, 0)):
        monkeypatch.setattr(search, "BROADCAST_CHARS", chars)
        found = search.search_all(rows, "id", ["t"], terms)
        assert found._jdf.queryExecution().sparkPlan().toString().count("Broadcast") == sent
        assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_rules_at_once_as_one_by_one(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["AB1", "AB2", "B", None, ""]), r.choice(["x", "xy", "xyz"])) for i in range(120)]
    word = lambda: r.choice(["A", "AB", "AB1", "x", "xy", "", "q"])
    rules = [(k, [(r.choice(["f", "g", "none"]), r.choice(["equals", "starts_with"]), word(), r.random() < 0.8) for _ in range(r.randrange(4))]) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, f string, g string")
    ruled = spark.createDataFrame(rules, "rule_id int, conditions array<struct<field:string,operator:string,value:string,enabled:boolean>>")
    got = sorted(map(tuple, search.match_rules(df, "id", ["f", "g"], ruled).collect()))
    every = df.crossJoin(ruled).where(filters.rule_matches(F.col("conditions"), {"f": F.col("f"), "g": F.col("g")}))
    assert got == sorted(map(tuple, every.select("id", "rule_id").collect()))


def test_rules_meet_classes_of_rows(spark, tmp_path, monkeypatch):
    """Rows that are equal in what is asked meet rules once; no exploded side is broadcast; an id that is there twice keeps its rows apart."""
    monkeypatch.setattr(search, "IDS", 2)
    rows = [(i // 2, ["AB1", "AB2", "C", None][i % 4], f"only {i}") for i in range(40)] + [(None, "C", "x")]
    c = lambda field, operator, value, on=True: (field, operator, value, on)
    rules = [(k, [c("f", "starts_with", "AB")]) for k in range(7)] + [(8, [c("f", "equals", "C"), c("none", "equals", "")]), (9, [c("g", "equals", "x", False)]), (10, []), (11, [c("none", "equals", "y")]), (12, None), (None, [c("f", "equals", "")]), (13, [c("f", None, "AB1")])]
    spark.createDataFrame(rows, "id int, f string, g string").write.parquet(str(tmp_path / "rows"))
    spark.createDataFrame(rules, "rule_id int, conditions array<struct<field:string,operator:string,value:string,enabled:boolean>>").write.parquet(str(tmp_path / "rules"))
    df, ruled = spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "rules"))
    got = search.match_rules(df, "id", ["f", "g"], ruled)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    # the lengths of prefixes, a row a field, are all that is sent
    assert plan.count("Broadcast") == len(re.findall(r"BroadcastHashJoin \[at#\d+\], \[at#\d+\]", plan)) > 0
    every = df.crossJoin(ruled).where(filters.rule_matches(F.col("conditions"), {"f": F.col("f"), "g": F.col("g")}))
    assert sorted(map(str, got.collect())) == sorted(map(str, every.select("id", "rule_id").collect()))
    met = [r.rule_id for r in got.where("id = 0").collect()]
    assert sorted(met, key=str) == sorted([*range(7)] * 2 + [9, 10] * 2 + [13], key=str)


NODES = "node_id string, parent_id string, capabilities array<string>, required_mode string, super_admin_only boolean"


def test_navigation_of_any_depth(spark):
    nodes = spark.createDataFrame([
        ("a", None, None, None, None), ("a1", "a", ["x"], None, None), ("a2", "a", None, None, None), ("a21", "a2", ["y"], None, None), ("a22", "a2", None, None, None), ("a221", "a22", ["z"], None, None), ("a3", "a", [], None, None),
        ("b", None, None, None, None), ("b1", "b", ["z"], None, None), ("c", None, None, "cloud", True), ("c1", "c", ["z"], None, None), ("d", None, None, "local", False), ("d1", "d", ["y"], None, None), ("e", None, None, None, None), ("lost", "nowhere", None, None, None),
    ], NODES)
    seen = lambda held, mode, admin: {r.node_id: (r.depth, r.root) for r in views.visible_navigation(nodes, held, mode, admin).collect()}
    assert seen(["y"], "local", False) == {"a": (1, "a"), "a2": (2, "a"), "a21": (3, "a"), "a3": (2, "a"), "d": (1, "d"), "d1": (2, "d")}
    assert seen(["z"], "cloud", True) == {"a": (1, "a"), "a2": (2, "a"), "a22": (3, "a"), "a221": (4, "a"), "a3": (2, "a"), "b": (1, "b"), "b1": (2, "b"), "c": (1, "c"), "c1": (2, "c")}
    assert seen([], "cloud", True).keys() == {"a", "a3", "c", "c1"} and seen([], "cloud", False).keys() == {"a", "a3"}
    assert views.visible_navigation(nodes.limit(0), ["x"], "local", True).count() == 0


def test_small_view_models(spark):
    one = spark.range(1)
    level = lambda d, e: one.select(dates.open_days_level(F.lit(d), F.lit(e))).first()[0]
    assert [level(13, True), level(14, True), level(20, False), level(20, None), level(None, True)] == ["warn", "red", "normal", "normal", None]
    lines = F.from_json(F.lit('[{"lineNo":7,"h":"a"},{"h":"b"}]'), "array<struct<lineNo:int,h:string>>")
    assert [tuple(x) for x in one.select(views.with_line_numbers(lines, ["h"])).first()[0]] == [(7, "a"), (2, "b")]
    assert one.select(views.with_line_numbers(F.lit(None).cast("array<struct<lineNo:int,h:string>>"), ["h"])).first()[0] == []
    packed = lambda p, g: one.select(views.packed(F.lit(p).cast("int"), F.lit(g).cast("double"))).first()[0]
    assert [packed(None, None), packed(3, None), packed(3, 1234.25), packed(None, 10.0)] == ["—", "3 KAP / —", "3 KAP / 1.234,25 KG", "— / 10 KG"]
    parsed = spark.createDataFrame([('{"k": 5}',), ("{nope",), (None,), ('{"k": "x"}',)], "t string").select(views.parsed(F.col("t"), "k long").alias("p"))
    assert [(r.p.value and r.p.value.k, r.p.failed) for r in parsed.collect()] == [(5, False), (None, True), (None, False), (None, True)]
    maps = one.select(views.merged_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))), views.merged_maps(F.lit(None).cast("map<string,string>"), F.create_map(F.lit("b"), F.lit("3")))).first()
    assert maps[0] == {"a": "1", "b": "3"} and maps[1] == {"b": "3"}


def test_goods_blocks_without_any(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\n1\nno end"), (4, "\n1\na\n2\nb Karayolu 123456789012 x\n3\nKarayolu 12345678901")], "id int, text string")
    got = {r.id: r.goods for r in extract_text.with_goods_blocks(df, "text", "goods").collect()}
    assert got[1] is None and got[2] == [] and got[3] == [] and [(g.line_no, g.hs_code) for g in got[4]] == [(1, "123456789012")]
    assert extract_text.goods_lines(extract_text.with_goods_blocks(df, "text", "goods"), ["id"], "goods").count() == 1


def test_words_come_from_the_right_source(spark):
    words = spark.createDataFrame([("d", 1, "w", 0, None)] * 40 + [("s", 1, None, 2, None), ("bad", 1, None, 0, "broken")], "doc_id string, page int, text string, images int, error string")
    ocr = spark.createDataFrame([("s", 1, "seen"), ("d", 1, "not this")], "doc_id string, page int, text string")
    assert sorted((r.doc_id, r.text) for r in pdf.routed(words, ocr).distinct().collect()) == [("d", "w"), ("s", "seen")]


def test_stream_keeps_the_first_of_each_key(spark, tmp_path):
    rows = [(i % 4, f"2024-01-01 00:0{i}:00") for i in range(8)]
    spark.createDataFrame(rows, "k int, ts string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.first_seen(events.event_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), ["k"])
    q = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.ts.minute) for r in spark.table("firsts").collect()) == [(0, 0), (1, 1), (2, 2), (3, 3)]
