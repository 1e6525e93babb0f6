"""Operators of tidemill.llm against brute force, round trips and held-out accuracy, and on odd inputs."""

import base64
import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import chat, language, lexicon, line_dedup, ngram_join, packing, quality, rules, secret_scan, topk
from tidemill.llm.common import components

DDL = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "", None, "s", None), (None, "no id here at all, still a text", "en", "s", 5), (4, "word " * 30_000, None, None, 1), (5, "same text twice over and over again", "en", "s", 1), (5, "same text twice over and over again", "en", "s", 1), (6, "中文 und Ünïcodé <|endoftext|> \x1c\x85 x", "de", "s", 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def clashing(df):
    """Extra columns with the names that operators use inside."""
    out = df
    for c in ("n_lines", "n_dropped", "score", "lang_pred", "part", "before", "ids", "n", "node", "h1", "band", "spans", "held_out", "kept", "at", "_kept"):
        out = out.withColumn(c, F.lit("clash"))
    return out


# --- 1 line dedup


def one_edit(x, y):
    if abs(len(x) - len(y)) > 1:
        return False
    p = 0
    while p < min(len(x), len(y)) and x[p] == y[p]:
        p += 1
    a, b = x[p:], y[p:]
    return a[1:] == b[1:] or a[1:] == b or a == b[1:]


def dedup_brute(docs):
    seen, out = [], {}
    for i, t in sorted(d for d in docs if d[0] is not None):
        if t is None:
            out[i] = None
            continue
        keep = []
        for line in t.split("\n"):
            if line:
                dup = any(line == s or (min(len(line), len(s)) >= line_dedup.MIN_CHARS and one_edit(line, s)) for s in seen)
                seen.append(line)
                if dup:
                    continue
            keep.append(line)
        out[i] = "\n".join(keep)
    return out


@pytest.mark.parametrize("hot", [64, 4])
def test_line_dedup_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "WORTH", hot)
    r = random.Random(4)
    base = [" ".join(r.choice(["alpha", "beta", "deltå", "eps 中", "zeta"]) for _ in range(9)) for _ in range(10)]

    def changed(s):
        k, i = r.random(), r.randrange(len(s))
        return s if k < 0.3 else s[:i] + s[i + 1 :] if k < 0.5 else s[:i] + "x" + s[i:] if k < 0.7 else s[:i] + "y" + s[i + 1 :]

    docs = [(i, "\n".join(r.choice(["", "short", changed(r.choice(base)), changed(changed(r.choice(base)))]) for _ in range(r.randint(0, 6)))) for i in range(150)] + [(900, None), (901, "")]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dedup_brute(docs)


def test_line_dedup_threshold_grows_with_length(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MIN_CHARS", 16)
    r = random.Random(6)
    base = ["".join(r.choice("abcdé ") for _ in range(n)) for n in (16, 24, 31, 33, 40, 66, 70, 130)]

    def changed(s):
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            i = r.randrange(len(s))
            s = r.choice([s[:i] + s[i + 1 :], s[:i] + r.choice("xyz") + s[i:], s[:i] + "w" + s[i + 1 :]])
        return s

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row, old = [i], row
            for j, b in enumerate(y, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
        return row[-1]

    docs = [(i, "\n".join(changed(r.choice(base)) for _ in range(4))) for i in range(60)]
    seen, want = [], {}
    for i, t in docs:
        keep = []
        for x in t.split("\n"):
            if not any(x == s or (min(len(x), len(s)) >= 16 and abs(len(x) - len(s)) < 6 and distance(x, s) <= min(len(x), len(s)).bit_length() - 4) for s in seen):
                keep.append(x)
            seen.append(x)
        want[i] = "\n".join(keep)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for hot, worth in ((64, 2000), (4, 3)):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        monkeypatch.setattr(line_dedup, "WORTH", worth)
        got = {x.doc_id: x.text for x in line_dedup.dedup_lines(df, lambda n: F.length(F.bin(n.cast("long"))) - 4).collect()}
        assert got == want, hot


@pytest.mark.parametrize(("hot", "worth"), [(64, 2000), (4, 40)])
def test_line_dedup_of_lines_with_another_word(spark, monkeypatch, tmp_path, hot, worth):
    """Lines with another word go, as by brute force; one edit leaves nearly all of them."""
    from tidemill.llm import queries

    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "WORTH", worth)
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghilmnoprstué") for _ in range(r.randint(2, 9))) for _ in range(60)]
    base = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (6, 7, 9, 12, 12, 16, 25, 40)]

    def changed(s):
        w = s.split(" ")
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            i = r.randrange(len(w))
            w[i : i + 1] = r.choice([[], [r.choice(vocabulary)], [r.choice(vocabulary)], [w[i], r.choice(vocabulary)], [w[i], ""]])
        return " ".join(w)

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row, old = [i], row
            for j, b in enumerate(y, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
        return row[-1]

    docs = [(i, "\n".join(changed(r.choice(base)) for _ in range(3))) for i in range(50)]
    seen, want = [], {}
    for i, t in docs:
        keep = []
        for x in t.split("\n"):
            a = x.split(" ")
            others = [(s, s.split(" ")) for s in seen if min(len(x), len(s)) >= 32]
            if x not in seen and not any(one_edit(x, s) or (min(len(a), len(b)) >= 5 and distance(a, b) <= 1 + min(len(a), len(b)) // 16) for s, b in others):
                keep.append(x)
            seen.append(x)
        want[i] = "\n".join(keep)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in queries.queries()["op1_line_dedup_words"](spark, str(tmp_path)).collect()}
    assert {i: x.text for i, x in got.items()} == want
    one = line_dedup.dedup_lines(df).agg(F.sum("n_dropped")).first()[0]
    assert sum(x.n_dropped for x in got.values()) > one + 30


def test_one_hot_segment_beside_cool_ones(spark, monkeypatch):
    """A segment that half of all lines share is split, whatever the many small hot ones would allow on average."""
    monkeypatch.setattr(line_dedup, "HOT", 4)
    monkeypatch.setattr(line_dedup, "WORTH", 12)
    r = random.Random(11)
    hot = "the passage that all of these lines begin with and "
    make = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    lines = [hot + make(40) for _ in range(60)] + [make(45) + x for x in (make(46) for _ in range(12)) for _ in range(6)]
    lines += [x[:70] + "Q" + x[71:] for x in lines[::5]] + [x[:20] + x[21:] for x in lines[::7]]
    r.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 3 : i * 3 + 3])) for i in range(-(-len(lines) // 3))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(df).collect()}
    assert got == dedup_brute(docs)
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(df, near_least=10_000).collect()} == {i: t for i, t in docs}


def test_frequent_words_take_all_counts_above_a_level(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["aa", "bb", "cc"]) if r.random() < 0.7 else f"w{'x' * r.randint(1, 9)}" for _ in range(30)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, None)], "doc_id long, text string")
    counts = Counter(w for t in texts for w in t.split())
    for most in (3, 6, 100):
        got = lexicon.frequent_words(docs, most)
        assert len(got) <= most and (not got or min(counts[w] for w in got) > max([0, *(n for w, n in counts.items() if w not in got and n > 1)]))
    assert set(lexicon.frequent_words(docs, 100)) == {w for w, n in counts.items() if n > 1}


def test_line_dedup_odd_rows(spark):
    out = line_dedup.dedup_lines(clashing(frame(spark, ODD)))
    rows = out.collect()
    assert len(rows) == len(ODD)
    by = {x.doc_id: x for x in rows}
    assert by[1].text is None and by[1].n_lines == 0 and by[2].text == "" and by[2].n_lines == 1
    assert by[None].text == ODD[3][1] and by[5].n_dropped == 0
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=7), st.text("ab", max_size=7)), min_size=80, max_size=150))
def test_banded_distance(spark, pairs):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row, old = [i], row
            for j, b in enumerate(y, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
        return row[-1]

    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "i int, x string, y string")
    tests = [(line_dedup.within_edits, 1), (line_dedup.within_edits, 2)] + [(line_dedup.reaches_end, n) for n in (0, 1, 2, 4)]
    for r in df.select("i", *(test(F.col("x"), F.col("y"), F.lit(n)).alias(f"t{k}") for k, (test, n) in enumerate(tests))).collect():
        assert [r[f"t{k}"] for k in range(len(tests))] == [distance(*pairs[r.i]) <= n for _, n in tests]


# --- 2 secrets


def der(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x80 | (len(b := n.to_bytes((n.bit_length() + 7) // 8, "big")))]) + b
    return bytes([tag]) + head + body


def b64url(x):
    return base64.urlsafe_b64encode(x).rstrip(b"=").decode()


def test_secret_structures():
    key = der(0x30, b"".join(der(2, bytes([1 + i]) * 40) for i in range(5)))
    jwt = ".".join([b64url(json.dumps({"alg": "HS256"}).encode()), b64url(b'{"sub":"x"}'), b64url(b"s" * 32)])
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"k" * 32))
    for text, kind in ((base64.b64encode(key).decode(), "der"), (key.hex(), "der"), (jwt, "jwt"), ("ssh-ed25519 " + base64.b64encode(ssh).decode(), "ssh"), (f"-----BEGIN RSA PRIVATE KEY-----\n{base64.encodebytes(key).decode()}-----END RSA PRIVATE KEY-----", "pem")):
        kinds = Counter(k for _, _, k in secret_scan.find(f"näch {text} end"))
        assert kinds[kind], (kind, kinds)
    broken = key[:-1] + b""
    assert not [s for s in secret_scan.find(base64.b64encode(broken).decode()) if s[2] == "der"]
    assert not [s for s in secret_scan.find("eyJhYmM" + "x" * 60 + ".abc.def") if s[2] == "jwt"]


def test_secret_base_semantics(spark):
    text = "secret:token:abcdef PassWord = 'abc' api_key=\"longenough\" ſecret=abcdefg AKIA" + "A" * 16 + " " + "f" * 24 + " é token: " + "0" * 23
    spans = secret_scan.find(text)
    assert [text[a:b] for a, b, k in spans if k == "assign"] == ['api_key="longenough', "token: " + "0" * 23]
    assert [k for *_, k in spans if k in ("access", "hex")] == ["access", "hex"]
    got = secret_scan.scan(clashing(frame(spark, ODD))).collect()
    assert len(got) == len(ODD) and not got[0].spans
    assert secret_scan.redact(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()[1].text is None
    assert secret_scan.scan(frame(spark, [])).count() == 0


def test_redact_leaves_no_base_secret(spark):
    text = "x token = " + "ab12" * 10 + " y"
    out = secret_scan.redact(frame(spark, [(1, text, None, None, 3)])).first()
    assert out.text == "x [SECRET] y" and out.n_chars == len(out.text)


# --- 3, 5 quality


def junk(r, n=12):
    return "\n".join(" ".join(r.choice(["abc", "def", "ghi"]) + r.choice(["***", "###", "$$$"]) for _ in range(9)) for _ in range(n // 4))


def prose(r, n=12):
    return "\n".join(" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(12)) + "." for _ in range(n // 4))


def labelled(spark, n=240):
    r = random.Random(1)
    docs = [(i, (junk if i % 4 == 0 else prose)(r), "en", "s", 1) for i in range(n)]
    return frame(spark, docs), spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n)], "doc_id long, quality int, toxic int"), n


def test_quality_crf_held_out(spark):
    docs, labels, n = labelled(spark)
    field = quality.fit(docs, labels.where("doc_id % 3 > 0"))
    got = {x.doc_id: x for x in quality.score_documents(docs, field).collect()}
    assert sum(got[i].predicted == int(i % 4 != 0) for i in range(0, n, 3)) >= 0.95 * n / 3
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in got.items())
    odd = quality.score_documents(clashing(frame(spark, ODD)), field).collect()
    assert len(odd) == len(ODD) and all(0 <= x.score <= 1 for x in odd) and odd[0].score == 0
    assert quality.score_documents(frame(spark, []), quality.fit(docs, labels.limit(0))).count() == 0


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    unary, trans = rng.normal(size=(1, 4)), rng.normal(size=(2, 2))
    marginal, pair, log_z = quality.forward_backward(unary, trans, np.array([4]))
    total, m, p = 0.0, np.zeros(4), np.zeros((2, 2))
    for k in range(16):
        y = [k >> i & 1 for i in range(4)]
        w = np.exp(sum(unary[0, i] * y[i] for i in range(4)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += w
        m += w * np.array(y)
        for a, b in zip(y, y[1:]):
            p[a, b] += w
    assert np.allclose(marginal[0], m / total) and np.allclose(pair[0], p / total) and np.isclose(log_z[0], np.log(total))


def repeat_brute(words):
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)})


@settings(deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=60))
def test_repeat_words(words):
    assert rules.n_repeat_words(words) == repeat_brute(words)


def test_rule_statistics():
    text = "one# x two\x0bthree\n\n \none# x two\x0bthree\n$| é é"
    (n, chars, symbols, dup, repeat), _ = rules.statistics(text)
    assert (n, chars, symbols, dup, repeat) == (8, len(text) - sum(c in " \t\n\x0b\x0c\r" for c in text), 4, 1, 0)
    assert rules.statistics(None)[0] == (0, 0, 0, 0, 0)


def test_rules_monotonic_and_whole(spark):
    docs, labels, n = labelled(spark)
    trees = rules.fit(docs, labels.where("doc_id % 3 > 0"))
    got = {x.doc_id: x.kept for x in rules.apply_rules(docs, trees).collect()}
    assert sum(got[i] == (i % 4 != 0) for i in range(0, n, 3)) >= 0.95 * n / 3
    X = np.array([rules.statistics(t)[1] for t in (prose(random.Random(i)) for i in range(20))])
    for j, sign in enumerate(rules.FEATURES.values()):
        if sign:
            grid = np.repeat(X, 50, 0)
            grid[:, j] = np.tile(np.linspace(0, 3, 50), 20)
            assert (np.diff(trees.score(grid).reshape(20, 50), axis=1) * sign >= -1e-12).all()
    odd = rules.apply_rules(clashing(frame(spark, ODD)), trees).collect()
    assert len(odd) == len(ODD) and odd[0].base_failed and not odd[0].kept
    assert rules.apply_rules(frame(spark, []), rules.fit(docs, labels.limit(0))).count() == 0


# --- 4, 8 tokens


def plain_texts():
    r = random.Random(3)
    alphabet = " \n\t'stdlreve_09a²½éÀß.!?\x85\xa0\x1c中文אا٣αΣİ́Ⅳǅ<|"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) + r.choice(["", "<|endoftext|>x", "'ll  x", "<|startoftext|>", "aaaaaaa"]) for _ in range(1500)] + ["", "the " * 2000]


def test_lexicon_automaton(tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    merger = lexicon.Merger(path)
    r = random.Random(0)
    words = sorted({"".join(r.choice("abn") for _ in range(r.randint(1, 7))) + r.choice(["", "ing", "ação"]) for _ in range(800)})
    raw = [w.encode() for w in words]
    ids = merger.ids(raw)
    (tmp_path / "x.bin").write_bytes(lexicon.compile_lexicon(zip(raw, ids, strict=True)))
    lex = lexicon.Lexicon(str(tmp_path / "x.bin"))
    found = lex.find([*raw, b"zzz", b"", b"a" * 99])
    assert found[-3:].tolist() == [-1, -1, -1] and sorted(found[:-3].tolist()) == list(range(len(raw)))
    assert all(lex.ids(n).tolist() == i.tolist() for n, i in zip(found.tolist(), ids, strict=False))
    assert len(lex.key) < sum(map(len, raw)) / 3  # prefixes and suffixes are shared
    (tmp_path / "none.bin").write_bytes(lexicon.compile_lexicon([]))
    assert lexicon.Lexicon(str(tmp_path / "none.bin")).find([b"a"]).tolist() == [-1]


def test_word_bpe_equals_library(spark):
    texts = plain_texts()
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, None)], "doc_id long, text string")
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {x.doc_id: x for x in lexicon.encode(docs, lambda ids, text: {"ids": hashlib.sha256(ids).hexdigest(), "shown": text}, "ids string, shown string").collect()}
    for i, t in enumerate(texts):
        ids = whole.encode(t, add_special_tokens=False).ids
        assert got[i].ids == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t
        assert got[i].shown == whole.decode(ids, skip_special_tokens=False)
    assert got[None].shown == ""
    assert lexicon.encode(frame(spark, []), lambda ids, text: {"n": 0}, "n long").count() == 0


def test_packing_covers_every_id(spark):
    texts = plain_texts() + [None, "long text " * 5000]
    docs = clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DDL).repartition(3))
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    pieces = packing.pack(docs, 512, with_ids=True).collect()
    by, seqs = {}, {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
        seqs.setdefault(p.sequence_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(p.ids) and p.length == len(p.ids) // 4 and p.doc_tokens == len(want[p.doc_id])
    for i, ids in want.items():
        parts = sorted(by[i], key=lambda p: p.start)
        assert [p.start for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == ids
    for k, parts in seqs.items():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
        assert sum(p.length for p in parts) == 512 or k == max(seqs)
    assert packing.pack(frame(spark, [])).count() == 0


# --- 6 language


def test_language_id(spark):
    r = random.Random(2)
    made = {"en": ["the", "and", "thing", "which"], "de": ["der", "und", "schön", "nicht"], "fr": ["le", "été", "eau", "que"], "es": ["el", "ción", "que", "año"]}
    docs = [(i, " ".join(r.choice(made[x]) for _ in range(12)), x, "s", 1) for i, x in enumerate(r.choice(list(made)) for _ in range(400))]
    df = frame(spark, docs)
    model = language.fit(df.where("doc_id % 3 <> 1"))
    got = {x.doc_id: x.lang_pred for x in language.identify(df, model).collect()}
    held = [d for d in docs if d[0] % 3 == 1]
    assert sum(got[d[0]] == d[2] for d in held) >= 0.95 * len(held)
    odd = language.identify(clashing(frame(spark, [*ODD, (7, "123 !?", "en", "s", 1)])), model).collect()
    assert len(odd) == len(ODD) + 1 and [x.lang_pred for x in odd if x.doc_id in (1, 2, 7)] == ["und"] * 3 and all(0 <= x.score <= 1 for x in odd)
    assert language.identify(df, language.fit(frame(spark, []))).where("lang_pred <> 'und'").count() == 0


# --- 7 chat


def test_preferences(spark):
    rows = [(1, 0, 0, "user", "hé"), (1, 1, 0, "user", "hé"), (1, 0, 1, "assistant", "good"), (1, 1, 1, "assistant", "bad"), (1, 1, 2, "user", "why"), (2, 0, 0, "user", "same"), (2, 1, 0, "user", "same"), (3, 1, None, None, None), (None, 0, 0, "user", "x"), (1, 0, 0, "user", "hé")]
    df = spark.createDataFrame(rows, "pair_id long, side int, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("c", F.lit("clash"))
    got = {x.pair_id: x for x in chat.format_preferences(df).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one.n_prompt_turns == 1 and one.prompt == "<|user|>\nhé<|end|>\n"
    a, b = map(int, one.chosen_mask.split(":"))
    assert one.chosen[a:b] == "good<|end|>" and one.rejected.endswith("<|user|>\nwhy<|end|>\n")
    assert got[2].chosen == got[2].rejected == "" and got[2].n_prompt_turns == 1
    assert got[3].chosen is None and got[3].rejected == "<||>\n<|end|>\n" and got[3].prompt == ""
    assert chat.format_preferences(df.limit(0)).count() == 0


# --- 9 top-k


@pytest.mark.parametrize("n", [3, 90])
def test_top_k(spark, n):
    r = np.random.default_rng(5)
    X = r.normal(size=(n, 8)).astype(np.float32)
    X[1::3] = X[0]  # ties
    rows = [(i, [float(v) for v in x], 0) for i, x in enumerate(X)] + [(1000, None, 1), (1010, [float("nan")] * 8, 1), (1020, [None] + [1.0] * 7, 1), (None, [1.0] * 8, 1), (1040, [float("inf")] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for x in topk.top_k(df, every=10, k=5).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    V = np.floor(64 * X.astype(np.float64)).astype(np.int64)
    for q in range(0, n, 10):
        s = V @ V[q]
        best = sorted((-int(s[c]), c) for c in range(n) if c != q)[:5]
        assert sorted(got[q]) == [(k + 1, c, -m) for k, (m, c) in enumerate(best)]
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("top", [5_000, 1 << 28])
def test_top_k_large_components(top):
    r = np.random.default_rng(8)
    C = top + r.integers(-3, 4, size=(300, 8))
    a, b, s = topk.nra_block(C[:20], np.arange(20), C, np.arange(300), 5)
    for q in range(20):
        full = C @ C[q]
        assert [(int(c), int(v)) for i, c, v in zip(a, b, s) if i == q] == [(c, -m) for m, c in sorted((-int(full[c]), c) for c in range(300) if c != q)[:5]]


# --- 10 Jaccard join


def classes_brute(docs):
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t in docs}
    ids = sorted(grams)
    root, links = {i: i for i in ids}, Counter()

    def find(i):
        return i if root[i] == i else find(root[i])

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(grams[a] & grams[b])
            if both and 5 * both >= 4 * len(grams[a] | grams[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), links[i]) for i in ids}


def test_ngram_join(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 16)
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(6)]
    docs = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(60)] = r.choice(words)
        docs.append((i, " ".join(w)))
    docs += [(200 + i, " ".join(r.choice(words) for _ in range(40))) for i in range(30)] + [(300, None), (301, ""), (302, ""), (303, "one two"), (304, "one  two"), (305, "one two three")]
    got = {x.doc_id: (x.class_id, x.n_links) for x in ngram_join.near_classes(clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DDL))).collect()}
    assert got == classes_brute(docs)


def test_ngram_join_odd_rows(spark):
    got = ngram_join.near_classes(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert [(x.class_id, x.n_links) for x in got if x.doc_id == 5] == [(5, 1), (5, 1)]
    assert [(x.class_id, x.n_links) for x in got if x.doc_id is None] == [(None, 0)]
    assert ngram_join.near_classes(frame(spark, [])).count() == 0


def test_bands_reach_recall():
    b = ngram_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**6) ** b >= 0.999 > 1 - (1 - 0.8**6) ** (b - 1)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {x.id: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        return i if root[i] == i else find(root[i])

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {i: find(i) for i in {x for e in edges if e[0] != e[1] for x in e}}


def test_repeated_ids_keep_their_links(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(words[::-1])
    docs = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (8, "else")]
    got = sorted((x.doc_id, x.class_id, x.n_links) for x in ngram_join.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(5, 5, 1), (5, 5, 1), (6, 5, 1), (7, 5, 1), (8, 8, 0)]
    line = "a line of more than thirty-two characters, "
    rows = [(5, line + "one"), (5, "other text"), (6, line + "ons"), (7, "other text"), (7, "x")]
    left = sorted((x.doc_id, x.text) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left == [(5, line + "one"), (5, "other text"), (6, ""), (7, ""), (7, "x")]


def test_swapped_answers(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 2, "user", "end"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1" * 50_000), (2, 0, "user", "alone"), (3, 0, "user", "p"), (3, 1, "assistant", "a3"), (None, 0, "user", "x"), (5, 1, "assistant", "a5"), (5, 0, None, None), (5, 0, None, None)]
    got = {x.pair_id: x for x in chat.render_preferences(chat.swapped_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert {k: v.n_prompt_turns for k, v in got.items()} == {0: 1, 1: 1, 2: 1, 3: 1, 5: 1}
    assert got[0].chosen == "<|assistant|>\na0<|end|>\n<|user|>\nend<|end|>\n" and "a1" * 50_000 in got[0].rejected and got[1].rejected.startswith("<|assistant|>\na0<")
    assert got[2].chosen == got[2].rejected == "" and got[3].rejected == "" and got[5].rejected == ""
    a, b = map(int, got[0].rejected_mask.split(":"))
    assert got[0].rejected[a:b] == "a1" * 50_000 + "<|end|>"


@pytest.mark.parametrize("size", [1, 1_000, 1_000_000])
def test_nra_block_against_integers(size):
    r = np.random.default_rng(size)
    C = (r.normal(size=(250, 12)) * 64 * size).astype(np.int64)
    C[7] = 64 * 10**9 if size == 1 else C[7]
    C[1::9] = C[0]
    ids, depths = r.permutation(250), []
    a, b, s = topk.nra_block(C[:20], ids[:20], C, ids, 5, depths)
    for q in range(20):
        best = sorted((-sum(int(x) * int(y) for x, y in zip(C[c], C[q])), int(ids[c])) for c in range(250) if c != q)[:5]
        assert [(-int(v), int(ids[c])) for i, c, v in zip(a, b, s) if i == q] == best
    assert len(depths) == 20 and all(0 < d <= 1 for d in depths)


def base_by_hand(text):
    """The base kinds by walking characters, without patterns."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    low = "".join(c.lower() if c.isascii() else "\0" for c in text)
    value, out = set(letters + letters.upper() + "0123456789+/_.=-"), []
    i = 0
    while i < len(text):
        hit = None
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(name, i):
                continue
            p = i + len(name)
            for quote in ((1, 0) if text[p : p + 1] in ("'", '"') and text[p : p + 1] else (0,)):
                q = p + quote
                while text[q : q + 1] == " ":
                    q += 1
                if text[q : q + 1] not in (":", "=") or not text[q : q + 1]:
                    continue
                q += 1
                while text[q : q + 1] == " ":
                    q += 1
                q += bool(text[q : q + 1]) and text[q : q + 1] in "'\""
                e = q
                while e < len(text) and text[e] in value:
                    e += 1
                if e > q:
                    hit = (i, e, e - q)
                    break
            if hit:
                break
        if hit:
            out += [(hit[0], hit[1], "assign")] * (hit[2] >= 6)
            i = hit[1]
        else:
            i += 1
    for kind, head, chars, least in (("access", "AKIA", set(letters.upper() + "0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            e = i + len(head)
            while text.startswith(head, i) and e < len(text) and text[e] in chars:
                e += 1
            if text.startswith(head, i) and e > i + len(head):
                out += [(i, e, kind)] * (e - i >= least)
                i = e
            else:
                i += 1
    return sorted(out)


def test_secret_base_against_a_plain_walk():
    r = random.Random(5)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apiKEY", '"', "'", " ", ":", "=", "abc", "Xy9", "+/", "AKIA", "A" * 9, "B2" * 5, "0a" * 7, "f", "é", "\n", "ſecret", "-"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert sorted(x for x in secret_scan.find(text) if x[2] in secret_scan.LEAST) == base_by_hand(text), text


def test_secret_keys_glued_and_folded():
    key = der(0x30, b"".join(der(2, bytes([1 + i]) * 40) for i in range(5)))
    small = base64.b64encode(der(0x30, der(2, b"\1" * 11) + der(2, b"\2" * 11))).decode()
    b = base64.b64encode(key).decode()
    for text in (f"key-{b}", f"my_key_{b}", f"x/{b}", "\n".join(b[i : i + 64] for i in range(0, len(b), 64)), "\r\n ".join(b[i : i + 76] for i in range(0, len(b), 76)), small, "k_" + key.hex()):
        assert [k for *_, k in secret_scan.confirmed_spans(f"né {text} end")] == ["der"], text
    for hostile in ("eyJ-" * 50_000 + ".a.b", "-----BEGIN PRIVATE KEY-----" * 8_000, "/MIIBMIIA" * 20_000):
        assert secret_scan.confirmed_spans(hostile) == []


def test_queries_keep_their_contract(spark, tmp_path):
    docs, labels, _ = labelled(spark, 120)
    texts = spark.createDataFrame([(1000, None, None, None, None), (1001, "token = abcdefgh " + "ab" * 14, "en", "s", 1)], DDL)
    docs.unionByName(texts).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    want = {
        secret_scan.op2_secret_scan: "doc_id bigint,n_assign bigint,n_access bigint,n_hex bigint,base_sha256 string,spans string",
        quality.op3_quality_crf: "doc_id bigint,held_out boolean,score double,predicted int",
        lexicon.op4_fst_bpe: "doc_id bigint,n_tokens bigint,ids_sha256 string,decoded_sha256 string",
        rules.op5_quality_rules: "doc_id bigint,n_words bigint,word_chars bigint,n_symbols bigint,n_dup_lines bigint,n_repeat_words bigint,base_failed boolean,kept boolean",
        language.op6_language_id: "doc_id bigint,held_out boolean,lang_pred string,score double",
        packing.op8_packing: "doc_id bigint,start bigint,length bigint,ids_crc32 bigint,doc_tokens bigint,sequence_id bigint,offset bigint",
    }
    for query, columns in want.items():
        out = query(spark, str(tmp_path))
        assert ",".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema).startswith(columns)
        rows = {x.doc_id: x for x in out.collect()}
        assert len(rows) == 122
        if query is secret_scan.op2_secret_scan:
            spans = ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(base_by_hand("token = abcdefgh " + "ab" * 14)))
            assert rows[1001].base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and rows[1001].spans == spans
            assert (rows[1001].n_assign, rows[1001].n_access, rows[1001].n_hex) == (1, 0, 1) and rows[1000].spans == ""


# --- pipeline


def test_pipeline_odd_rows(spark):
    import corpus_pipeline as P

    stages = dict(P.STAGES)
    for name in ("language_id", "line_dedup", "ngram_jaccard_join", "secret_scan"):
        assert stages[name](spark, frame(spark, []), "").count() == 0
        out = stages[name](spark, clashing(frame(spark, ODD)), "")
        assert out.columns == P.COLUMNS and {x.doc_id for x in out.collect()} <= {x[0] for x in ODD}
    kept = stages["ngram_jaccard_join"](spark, clashing(frame(spark, [*ODD, (5, "another text under the same id again", "en", "s", 1)])), "").collect()
    assert sorted(str(x.doc_id) for x in kept) == sorted(["1", "2", "3", "None", "4", "5", "5", "6"])


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(9)
    en, fr = "the and thing which that with from have".split(), "le été eau que dans une pour avec".split()
    long = [" ".join(r.choice(en) + str(k) * (k % 7 == 0) for k in range(40)) for _ in range(60)]
    docs = [(i, "\n".join(r.sample(long, 2)) if i % 2 else " ".join(r.choice(fr) for _ in range(30)) + f" fin{i}", "en" if i % 2 else "fr", "s", 1) for i in range(80)]
    docs += [(100, "!!! 123", None, "s", 7), (101, None, None, None, None), (102, docs[1][1], "en", "s", 1), (103, "here is a token = " + "ab" * 20 + " in words", "en", "s", 1)]
    df = frame(spark, docs)
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "secret_scan", "packing"]
    kept = {x.doc_id: x.text for x in P.identify_language(spark, df, "").collect()}
    assert not {100, 101} & kept.keys() and len(kept) >= 80
    cut = {x.doc_id: x.text for x in P.dedup_lines(spark, df, "").collect()}
    want = dedup_brute([d[:2] for d in docs])
    assert cut == {i: t for i, t in want.items() if t is None or t.strip() or t == dict(d[:2] for d in docs)[i]}
    near = {x.doc_id for x in P.join_near_copies(spark, df, "").collect()}
    assert near == {c for c, _ in classes_brute([d[:2] for d in docs]).values()}
    safe = {x.doc_id: x.text for x in P.redact_secrets(spark, df, "").collect()}
    assert safe[103] == "here is a [SECRET] in words" and safe[1] == docs[1][1]
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = P.run(spark, str(tmp_path))
    sizes = {x.doc_id: (x.doc_tokens, x.total) for x in out.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("total")).collect()}
    assert sizes and all(a == b for a, b in sizes.values()) and not {100, 101, 102} & sizes.keys() and 103 in sizes


def test_pipeline_drops_short_repeated_lines(spark):
    import corpus_pipeline as P

    texts = ["one\n\nAll rights reserved.", "two\n\nAll rights reserved.\nx\nx", "one\n", "three\n\n"]
    got = {x.doc_id: x.text for x in P.dedup_lines(spark, frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), "").collect()}
    assert got == {0: texts[0], 1: "two\n\nx", 3: texts[3]}


def test_pipeline_rejects_unknown_languages(spark):
    import corpus_pipeline as P

    r = random.Random(3)
    made = {"en": "the and thing which that with from have".split(), "fr": "le été eau que dans une pour avec".split()}
    docs = [(i, " ".join(r.choice(made[x]) for _ in range(30)), x, "s", 1) for i, x in enumerate(["en", "fr"] * 60)]
    junk = [(200, "это совсем другой язык " * 9, None, "s", 1), (201, "zqxv kkjj wqzz xxqj vvkk xqq " * 9, None, "s", 1), (202, "中文文本没有空格 " * 20, None, "s", 1)]
    assert {x.doc_id for x in P.identify_language(spark, frame(spark, docs + junk), "").collect()} == {d[0] for d in docs}


def test_pipeline_levels_come_from_all_held_out_documents(spark, monkeypatch):
    import corpus_pipeline as P

    monkeypatch.setattr(P, "PART", 1.0)
    r = random.Random(5)
    made = {"en": "the and thing which that with from have".split(), "fr": "le été eau que dans une pour avec".split()}
    other = sum(made.values(), [])
    docs = [(i, " ".join(r.choice(other if r.random() < 0.3 else made[x]) for _ in range(r.choice([6, 14]))), x, "s", 1) for i, x in enumerate(["en", "fr"] * 7000)]
    df = frame(spark, docs + docs[:50])
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    told = language.identify(df, language.fit(df.where("crc32(cast(doc_id as string)) % 3 <> 1"))).distinct().collect()
    scores = {}
    for x in told:
        if held(x.doc_id) and x.lang_pred == x.lang:
            scores.setdefault(len(x.text).bit_length(), []).append(x.score)
    assert sum(map(len, scores.values())) > 4000
    level = {n: float(np.percentile(s, 0.1)) for n, s in scores.items()}
    got = P.low_levels(spark.createDataFrame([(n, s) for n, each in scores.items() for s in each], "size int, score double"))
    assert got == pytest.approx(level, rel=1e-12)
    kept = {x.doc_id for x in P.identify_language(spark, df, "").collect()}
    assert kept == {x.doc_id for x in told if x.score >= got.get(len(x.text).bit_length(), min(got.values()))}


def test_pipeline_without_known_languages(spark):
    import corpus_pipeline as P

    df = frame(spark, [(1, "some words", None, "s", 1), (2, "123 !?", None, "s", 1), (3, None, None, "s", 1), (4, "中文", None, "s", 1), (5, "_1é", None, "s", 1)])
    assert {x.doc_id for x in P.identify_language(spark, df, "").collect()} == {1, 4, 5}
