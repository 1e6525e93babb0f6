"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on the driver from a bounded sample of labelled documents' statistics, with monotonic constraints on
chosen features, and flattened into numpy node arrays. Scoring walks all rows of a slice down all trees together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import bounded_sample, map_slices, table

SYMBOLS = b"#*$%&|<>"
#: Labelled documents of each quality that trees are grown from: a parameter that bounds what the driver gathers.
SAMPLE = 6000
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

#: Features and the sign of their constraint: -1 if a score may never rise with the feature.
FEATURES = {"log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "shout_share": -1, "distinct_share": 0, "mean_line": 0, "end_mark_share": 0}


def n_repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words that the text holds twice or more; first occurrences and overlaps count."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    if not all((ids[a + k] == ids[b + k]).all() for k in range(window)):  # two windows share a hash: count them by themselves
        seen: dict[tuple, list[int]] = {}
        for i in range(n):
            seen.setdefault(tuple(words[i : i + window]), []).append(i)
        at = np.array([i for v in seen.values() if len(v) > 1 for i in v], np.int64)
    else:
        at = np.concatenate([a, b])
    cover = np.zeros(len(words) + 1, np.int64)
    hit = np.unique(at)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features of a text; null is no word."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: parts at space, tab, line feed, vertical tab, form feed and return
    n = len(words)
    blanks = len(raw) - sum(map(len, words))
    chars = len(text) - blanks
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    repeat = n_repeat_words(words)
    shout = sum(w[-2:] == b"!!" or (len(w) > 2 and w.isupper()) for w in words)
    ends = sum(w[-1:] in (b".", b"!", b"?") for w in words)
    d, m = max(n, 1), max(len(lines), 1)
    return (n, chars, symbols, dup, repeat), [np.log1p(n), chars / d, symbols / d, dup / m, repeat / d, shout / d, len(set(words)) / d, n / m, ends / d]


@dataclass
class Trees:
    """Flattened trees: node arrays of all trees one after another; a leaf points at itself."""

    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, X: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        rows = np.arange(len(X))
        total = np.full(len(X), self.base)
        for r in self.root:
            at = np.full(len(X), r)
            for _ in range(self.depth):
                at = np.where(X[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(X: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0) -> Trees:
    """Boosted trees for the logistic loss. A split on a constrained feature must order its children's values, and their
    subtrees stay on their side of the middle between them, so the whole score is monotonic in that feature."""
    edges = [np.unique(np.quantile(X[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(X) else np.zeros(0) for j in range(X.shape[1])]
    code = np.stack([np.searchsorted(e, X[:, j], "left") for j, e in enumerate(edges)], 1)
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(X), base)
    root, feature, cut, left, right, value = [], [], [], [], [], []

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(feature)
        for a, v in ((feature, 0), (cut, 0.0), (left, me), (right, me), (value, 0.0)):
            a.append(v)
        G, H = g[rows].sum(), h[rows].sum()
        weight = lambda g_, h_: np.clip(-g_ / (h_ + l2), low, high)
        gain_of = lambda g_, h_, w: -(g_ * w + 0.5 * (h_ + l2) * w * w)
        w0 = weight(G, H)
        best = (1e-6, None)
        if level < depth and len(rows) >= 40:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gs = np.cumsum(np.bincount(code[rows, j], g[rows], len(e) + 1))[:-1]
                hs = np.cumsum(np.bincount(code[rows, j], h[rows], len(e) + 1))[:-1]
                wl, wr = weight(gs, hs), weight(G - gs, H - hs)
                gain = gain_of(gs, hs, wl) + gain_of(G - gs, H - hs, wr) - gain_of(G, H, w0)
                gain[(hs < 1) | (H - hs < 1) | ((wr - wl) * signs[j] < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, wl[k], wr[k]))
        if best[1] is None:
            value[me] = rate * float(w0)
            return me
        j, k, wl, wr = best[1]
        mid = (wl + wr) / 2
        go = code[rows, j] <= k
        bounds = ((low, mid), (mid, high)) if signs[j] > 0 else ((mid, high), (low, mid)) if signs[j] < 0 else ((low, high),) * 2
        feature[me], cut[me] = j, float(edges[j][k])
        left[me] = node(rows[go], g, h, level + 1, *bounds[0])
        right[me] = node(rows[~go], g, h, level + 1, *bounds[1])
        return me

    for _ in range(trees if len(X) else 0):
        p = 1 / (1 + np.exp(-margin))
        first = len(feature)
        root.append(node(np.arange(len(X)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        at = np.full(len(X), first)
        f, c, a, b, v = (np.array(z) for z in (feature, cut, left, right, value))
        for _ in range(depth):
            at = np.where(X[np.arange(len(X)), f[at]] <= c[at], a[at], b[at])
        margin += v[at]
    return Trees(np.array(root, np.int64), np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(right, np.int64), np.array(value), depth, base)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, text, quality of at most about per_class documents of each quality; a document with several labels counts once, by the least.

    Labels are narrow, so they alone are grouped and sampled; the texts of the sample are then joined. The sample's size is
    bounded by the parameter, so it is broadcast.
    """
    from pyspark.sql import functions as F

    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = bounded_sample(one, "quality", ["doc_id"], per_class)
    # rows that repeat an id would multiply the sample, so each id gives its least text
    found = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Trees:
    """Trees for quality 1 from a bounded sample of labelled documents; without labels every score is one half."""

    def work(rows: dict) -> dict:
        return {"doc_id": rows["doc_id"], "quality": rows["quality"], "x": [statistics(t)[1] for t in rows["text"]]}

    got = sorted(map(tuple, map_slices(labelled_sample(docs, labels, per_class), work, "doc_id long, quality int, x array<double>").collect()))
    X = np.array([x for _, _, x in got]).reshape(len(got), len(FEATURES))
    return grow(X, np.array([float(q) for _, q, _ in got]), list(FEATURES.values()))


def apply_rules(docs: DataFrame, trees: Trees, least: float = 0.5) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, score and kept (not base_failed, and score >= least).

    A null or empty text has no words and so fails the base rules. Ids may be null or repeat; every row is judged.
    """

    def work(rows: dict) -> dict:
        got = [statistics(t) for t in rows["text"]]
        score = trees.score(np.array([x for _, x in got]))
        failed = [c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT_PERCENT * c[0] for c, _ in got]
        return {"doc_id": rows["doc_id"]} | dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), zip(*(c for c, _ in got), strict=True), strict=True)) | {"base_failed": failed, "score": score.tolist(), "kept": [not f and s >= least for f, s in zip(failed, score.tolist(), strict=True)]}

    return map_slices(docs.select("doc_id", "text"), work, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def op5_quality_rules(spark, sf_dir):
    """Judge every row of documents; odd rows as in apply_rules, and a label's id that several rows have counts once in the fit."""
    docs = table(spark, sf_dir, "documents")
    out = apply_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
