"""Periodic runs against a plain search over all periods, and on odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import periodic

DDL = "doc_id long, text string, lang string"


def plain_runs(words):
    """(start, length, period) of all runs: every period, every stretch that it spans, smallest periods only."""
    n, spans = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                spans.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in spans.items())


def plain_digest(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(((-size, s, q) for s, size, q in runs), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def listed(rows):
    return [(a, b - a, q) for a, b, q in rows.tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=5))
def test_runs_of_few_words(texts):
    got = periodic.runs_together([np.array(t, np.int32) for t in texts])
    assert [listed(x) for x in got] == [plain_runs(t) for t in texts]


def test_runs_of_powers_and_nested_repeats():
    r = random.Random(5)
    for _ in range(150):
        part = [r.randrange(3) for _ in range(r.randint(1, 9))]
        words = []
        for _ in range(r.randint(1, 4)):
            words += part * r.randint(1, 9) + [r.randrange(9) for _ in range(r.randint(0, 5))]
            part = part * r.randint(1, 4) + [r.randrange(3)] * r.randint(0, 2)
        assert listed(periodic.runs_together([np.array(words, np.int32)])[0]) == plain_runs(words)


def test_candidates_are_settled_in_parts(monkeypatch):
    monkeypatch.setattr(periodic, "CANDIDATES", 7)
    words = [0] * 90 + [1, 2] * 40 + [3]
    assert listed(periodic.runs_together([np.array(words, np.int32)])[0]) == plain_runs(words)


def test_query_against_plain_search(spark, tmp_path):
    r = random.Random(8)
    texts = [" ".join(r.choice(["a", "b", "ü", "c\x85d"]) for _ in range(r.choice([0, 3, 9, 40, 200]))) for _ in range(400)]
    rows = [(i, t.replace("b a", "b\n\ta"), "en") for i, t in enumerate(texts)]
    rows += [(None, "x " * 50, None), (7, None, "en"), (7, "", None), (7, "", None), (8, "one long text " * 20_000, "en"), (9, " ".join(map(str, range(3000))), "en")]
    spark.createDataFrame(rows, DDL).withColumn("n_runs", F.lit("clash")).withColumn("period", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    out = periodic.op11_kmr_runs(spark, str(tmp_path))
    assert out.dtypes == [tuple(c.replace("long", "bigint").split()) for c in periodic.SCHEMA.split(", ")]
    quick = [x for x in rows if len(x[1] or "") < 100_000]
    key = lambda x: (x[0] is None, x[0] or 0, x[-2], x[-1])
    got = {r.doc_id: tuple(r) for r in out.where("doc_id = 8 and n_runs = 1 and length > 10000").collect()}
    assert len(got) == 1 and got[8][2:4] == (0, 60_000)
    rest = [tuple(r) for r in out.collect() if not (r.doc_id == 8 and (r.length or 0) > 10_000)]
    assert sorted(rest, key=key) == sorted((plain_digest(i, t) for i, t, _ in quick), key=key)


def test_operator_gives_runs_and_texts(spark):
    docs = spark.createDataFrame([(1, "say it again again again again again again now", "en"), (2, None, None)], DDL)
    got = {r.doc_id: (r.runs, r.collapsed) for r in periodic.find_runs(docs).collect()}
    assert got == {1: ([(2, 6, 1)], "say it again now"), 2: ([], "")}
    assert periodic.find_runs(docs.limit(0)).count() == 0
