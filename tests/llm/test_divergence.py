"""The audit of sources against plain Python in whole numbers, and on odd inputs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import divergence

DDL = "doc_id long, text string, lang string, source string"


def plain_audit(rows, least, top):
    docs = [((x[2] or ""), (x[3] or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda c: c[0].lower(), x[1] or ""))) for x in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if t in kept)
        every = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in counts.items():
            pairs = [(-sum(abs(p(c, t) - p(o, t)) for t in kept), x.encode(), x) for x, o in counts.items() if x != s]
            terms = [(p(every, t) - p(c, t), t.encode(), t) for t in kept if c[t] and p(c, t) > p(every, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out.update((lang, s, part, item, -less, n) for n, (less, _, item) in enumerate(found, 1))
    return out


@pytest.mark.parametrize(("groups", "terms", "held"), [(64, 512, 300_000), (3, 4, 20)])
def test_audit_matches_plain_python(spark, monkeypatch, groups, terms, held):
    monkeypatch.setattr(divergence, "LEAST_DOCS", 6)
    monkeypatch.setattr(divergence, "TILE_GROUPS", groups)
    monkeypatch.setattr(divergence, "TILE_TERMS", terms)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    r = random.Random(9)
    words = ["Aa", "aa", "b", "ÉÉ", "éé", "z\x85z", "q1q", "中文", "d-e", *(f"w{'x' * i}" for i in range(40))]
    rows = [(i, " ".join(r.choice(words[: 9 + i % 40]) for _ in range(r.choice([0, 1, 20]))), r.choice(["en", "de", None]), r.choice([*"abcdefgh", None, ""])) for i in range(500)]
    rows += [(1, None, "fr", "only"), (1, "few words here", "it", "x"), (None, "", "it", "y"), (3, "long " * 60_000, "en", "long"), (3, "long " * 9, "en", "a"), (5, "!? 12", "it", "ä")]
    df = spark.createDataFrame(rows, DDL).withColumns({c: F.lit("clash") for c in ("n", "term", "block", "row", "value", "rank", "size", "item")})
    assert Counter(map(tuple, divergence.audit_sources(df).collect())) == plain_audit(rows, 6, divergence.TOP)


def test_ranks_to_fifty_and_equal_values(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST_DOCS", 1)
    monkeypatch.setattr(divergence, "TILE_TERMS", 16)
    names = ["".join(chr(97 + (i // 26**k) % 26) for k in range(2)) for i in range(150)]
    rows = [(1, " ".join(names), "en", "all"), (2, "other words", "en", "two"), (2, "other words", "en", "two")]
    got = divergence.audit_sources(spark.createDataFrame(rows, DDL)).collect()
    assert Counter(map(tuple, got)) == plain_audit(rows, 1, divergence.TOP)
    assert max(r["rank"] for r in got if r.part == "term") == 50


def test_empty_table(spark):
    assert divergence.audit_sources(spark.createDataFrame([], DDL)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**14), st.integers(0, 9 * 10**14))
def test_shares_are_exact(count, more):
    whole = count + 5 + more
    assert divergence.share(np.array([count]), np.array([whole]))[0] == 1 + 10**9 * (count + 5) // whole


def test_pair_sums_over_blocks():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 10**9, (5, 30)), r.integers(0, 10**9, (7, 30))
    want = [[sum(abs(int(x) - int(y)) for x, y in zip(p, q)) for q in b] for p in a]
    assert divergence.pair_sums(a, b).tolist() == want
    assert (sum(divergence.pair_sums(a[:, k : k + 7], b[:, k : k + 7]) for k in range(0, 30, 7))).tolist() == want
