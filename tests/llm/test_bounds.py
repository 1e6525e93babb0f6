"""Samples that repeated ids and dirty values cannot fill or empty, hostile texts, and models against plain versions of themselves."""

import base64
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import language, quality, rules, secret_scan, topk
from tidemill.llm.common import MOST_CLASSES, bounded_sample

DDL = "doc_id long, text string, lang string, source string, n_chars long"


# --- samples


@pytest.mark.parametrize("ids", ["one", "null", "many"])
def test_sample_of_repeated_ids(spark, ids):
    doc = {"one": F.lit(7).cast("long"), "null": F.lit(None).cast("long"), "many": F.col("id")}[ids]
    df = spark.range(5000).select(doc.alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("text "), "id").alias("text"))
    assert 60 < bounded_sample(df, "lang", ["doc_id", "text"], 100).count() < 150
    # one row over and over beside fifty others
    same = df.select("doc_id", "lang", F.when(F.col("text").rlike("^text [1-5][0-9]$"), F.col("text")).otherwise("same").alias("text"))
    assert 10 < bounded_sample(same, "lang", ["doc_id", "text"], 60).count() <= 5000 if ids == "many" else bounded_sample(same, "lang", ["doc_id", "text"], 60).count() == 51


def test_sample_of_thousands_of_classes(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "en").otherwise(F.concat(F.lit("x"), F.col("id") % 5000)).alias("lang"), F.lit("t").alias("text"))
    got = bounded_sample(df, "lang", ["doc_id"], 100, 640).groupBy("lang").count().collect()
    assert len(got) <= MOST_CLASSES and sum(r["count"] for r in got) < 1000 and "en" in {r.lang for r in got}


def test_language_fit_on_one_id_and_dirty_langs(spark):
    words = {"en": "the thing that they have and would", "de": "und der nicht sich auch eine wird"}
    r = random.Random(3)
    say = lambda lang: " ".join(r.choice(words[lang].split()) for _ in range(20))
    rows = [(5, say(x := r.choice(["en", "de"])), x, None, 0) for _ in range(600)] + [(5, say("en"), f"junk{i}", None, 0) for i in range(3000)]
    model = language.fit(spark.createDataFrame(rows, DDL))
    known = [x for ladder in model.within.values() for x in ladder.names]
    assert {"en", "de"} <= set(known) and len(known) <= MOST_CLASSES


def test_language_fit_holds_its_sample_once(spark):
    """Two full samples are 2,000 vectors of 8 KB at half width; the driver must not hold wide copies of all of them."""
    rows = [(i, f"{'the wood' if i % 2 else 'der wald'} {i:x}\n{'and sea' if i % 2 else 'und see'} {i * 7:x}", "en" if i % 2 else "de") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language.fit(df.limit(10))
    tracemalloc.start()
    model = language.fit(df)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert [model.predict(t)[0] for t in ("the wood and sea", "der wald und see")] == ["en", "de"]


def test_votes_are_recounted(spark):
    """The ladder's decision, and the family before it, from each machine's own margin."""
    r = np.random.default_rng(4)
    langs = np.array(["en", "de", "nl", "fr", "es", "ru"] * 20, object)
    X = np.abs(r.normal(size=(120, language.BUCKETS))).astype(np.float32)
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    model = language.Model(X, langs)
    for x in X[:30]:
        votes, sums = Counter(), Counter()
        for ladder in (model.top,):
            for (a, b), w, c in zip(ladder.pairs, ladder.W, ladder.b):
                m = float(w @ x + c)
                votes[ladder.names[a if m >= 0 else b]] += 1
                sums[ladder.names[a]] += m
                sums[ladder.names[b]] -= m
        family = max(model.top.names, key=lambda n: (votes[n], sums[n]))
        assert model.top.decide(x)[0] == family
        assert model.within[family].decide(x)[0] in {k for k in set(langs) if language.family(k) == family}


def test_quality_fit_is_bounded_by_lines(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_LINES", 300)
    seen = []
    monkeypatch.setattr(quality, "fit_field", lambda docs, good: seen.append((docs, good)))
    rows = [(i % 90, "\n".join(["a good line of words."] * (5 + i % 7)), "en", None, 0) for i in range(400)] + [(99, "w\n" * 9000, "en", None, 0)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    quality.fit(spark.createDataFrame(rows, DDL), labels)
    docs, good = seen[0]
    for label in (0, 1):
        assert 200 < sum(len(x) for (x, _), q in zip(docs, good) if q == label) <= 300


def test_document_quality_is_the_weighted_mean_of_lines():
    r = np.random.default_rng(2)
    field = quality.Field(np.zeros(38), np.ones(38), r.normal(size=38) * 0.1, 0.2, r.normal(size=(2, 2)), 1.3, -0.1)
    docs = [quality.document_features(t) for t in ("one line.", "a line\n\nand || another!!\nLAST", "", "x\n" * 40)]
    for (x, w), score in zip(docs, field.quality(docs)):
        if not len(w):
            assert score == 0
            continue
        p = field.line_marginals([x])[0]
        mean = sum(a * b for a, b in zip(p, w)) / sum(w)
        z = 1.3 * np.log((mean + 1e-4) / (1 - mean + 1e-4)) - 0.1
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_flat_trees_score_as_recursive_ones():
    r = np.random.default_rng(7)
    X = r.normal(size=(600, len(rules.FEATURES)))
    y = (X[:, 0] + 0.5 * r.normal(size=600) > X[:, 1]).astype(float)
    trees = rules.grow(X, y, list(rules.FEATURES.values()), trees=12)

    def walk(at, x):
        if trees.left[at] == at:
            return trees.value[at]
        return walk(trees.left[at] if x[trees.feature[at]] <= trees.cut[at] else trees.right[at], x)

    want = [1 / (1 + np.exp(-(trees.base + sum(walk(k, x) for k in trees.root)))) for x in X]
    assert np.allclose(trees.score(X), want) and len({round(v, 6) for v in want}) > 20


def test_counts_of_rules_from_plain_python():
    r = random.Random(1)
    for _ in range(60):
        text = "".join(r.choice(["word ", "#$ ", "ünï|", "\n", "same line again\n", " ", "a b c d e f g h "]) for _ in range(30))
        words = re.findall("[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeat = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        got = rules.statistics(text)[0]
        assert got == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat))


def test_empty_vectors_score_nothing(spark):
    rows = [(i, [float(i % 5) - 2, 1.0], 0) for i in range(30)] + [(40, [], 0), (41, [], 0), (60, None, 0)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), every=20, k=3).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 40] == [(1, 0, 0), (2, 1, 0), (3, 2, 0)]
    assert {r.query_id for r in got} == {0, 20, 40}


# --- secrets


def plain_fills(b):
    """Whether bytes are DER values one after another, each with nested values that fill it."""
    at = 0
    while at < len(b):
        v = secret_scan.der_value(b, at, len(b))
        if v is None or (v[0] & 0x20 and not plain_fills(b[v[1] : v[2]])):
            return False
        at = v[2]
    return True


def plain_key(b):
    v = secret_scan.der_value(b, 0, len(b))
    return bool(v) and v[0] == 0x30 and v[2] == len(b) >= 24 and b[v[1]] in (2, 0x30) and plain_fills(b)


def value(r, depth):
    kind = r.random()
    body = r.randbytes(r.randrange(1, 20)) if depth == 0 or kind < 0.5 else b"".join(value(r, depth - 1) for _ in range(r.randrange(0, 4)))
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x81, len(body)]) if len(body) < 256 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([r.choice([2, 4, 6]) if depth == 0 or kind < 0.5 else 0x30]) + size + body


def test_base64_keys_as_a_search_of_all_ends():
    r = random.Random(12)
    found = 0
    for _ in range(250):
        parts = []
        for _ in range(r.randrange(1, 4)):
            b = b"\x02\x01\x00" + b"".join(value(r, 2) for _ in range(r.randrange(1, 4)))
            b = b"\x30" + (bytes([len(b)]) if len(b) < 128 else b"\x81" + bytes([len(b)]) if len(b) < 256 else b"\x82" + len(b).to_bytes(2, "big")) + b
            if r.random() < 0.3:
                b = b[: r.randrange(len(b))] + r.randbytes(2) + b[r.randrange(len(b)) :]
            parts += [base64.b64encode(b).decode().rstrip("="), r.choice([" ", "-", ". ", "/x "])]
        text, want, past = "".join(parts), [], 0
        for m in re.finditer(r"(?<![A-Za-z0-9])M[A-I](?=[A-Za-z0-9+/_-]{28})", text):
            run = re.compile(r"[A-Za-z0-9+/_-]+").match(text, m.start())
            for end in range(m.start() + 4, run.end() + 1) if m.start() >= past else ():
                raw = secret_scan.unbase64(text[m.start() : end])
                if raw and plain_key(raw) and -(-len(raw) * 4 // 3) == end - m.start() and not re.match("[A-Za-z0-9]", text[end : end + 1]):
                    want.append((m.start(), end, "der"))
                    past = end
                    break
        found += len(want)
        assert secret_scan.base64_spans(text) == want
    assert found > 150


@pytest.mark.parametrize("claim", [b"\x30\x83\x08\x00\x00\x02\x00aaaa", b"\x30\x83\x0a\x00\x00\x02\x01\x05\x05\x00\x05\x00", b"\x30\x83\x08\x00\x00\x30\x83\x07\xf0\x00\x02\x01\x01", b"\x00\x00\x00\x0bssh-ed25519\x00\x0a\x00\x00", b"\x00\x00\x00\x07ssh-rsa\x00\x05\x00\x00\x00\x05\x00\x00"])
def test_long_claims_cost_linear_time(claim):
    head = "-" + base64.b64encode(claim + b"\0" * (-len(claim) % 3) + b"\x05\x00\x05" * 6).decode()
    text = head * (1_000_000 // len(head))
    began = time.process_time()
    secret_scan.find(text)
    assert time.process_time() - began < 2
