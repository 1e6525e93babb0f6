"""Quality classifier: a linear-chain conditional random field labels every line of a document good or bad.

A line's evidence is its own statistics and those of the lines before and after it; neighbouring labels pull on each
other. Forward-backward marginals, weighted by line length, add up to a document's quality, which a logistic step fitted on the
same sample maps to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold, map_slices, table
from .rules import labelled_sample

#: Labelled documents of each quality that the field is fitted on: a parameter that bounds what the driver gathers.
SAMPLE = 2500
#: Labelled documents of more lines take no part in the fit, which looks at all lines of the others; scores always use all lines.
FIT_LONGEST = 4096
#: Lines of each quality that the fit takes in all, in an order by hash: bounds the driver's memory (about 0.5 kB a line, 200 MB).
FIT_LINES = 200_000
OWN = 12
_SIGNS = b"#*$%&|<>"


def line_features(line: bytes) -> list[float]:
    """Statistics of one line."""
    words = line.split()
    n, d = len(words), max(len(words), 1)
    signs = len(line) - len(line.translate(None, _SIGNS))
    size = max(len(line), 1)
    distinct = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:]))
    shout = sum(w.isupper() and len(w) > 1 for w in words)
    marks = sum(w[-1:] in b".,;:!?" for w in words)
    digits = len(line) - len(line.translate(None, b"0123456789"))
    return [np.log1p(len(line)), np.log1p(n), min(signs / d, 3.0), line.count(b"|") / d, shout / d, distinct / d, same / d, line.count(b"!!") / d, digits / size, marks / d, min(len(line) / d, 40.0), float(line[-1:] in (b".", b"!", b"?"))]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line with a word and of its neighbours, line lengths); no rows if there is no such line."""
    lines = [x for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x.split()]
    if not lines:
        return np.zeros((0, 3 * OWN + 2), np.float32), np.zeros(0)
    own = np.array([line_features(x) for x in lines], np.float32)
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[0], after[-1] = own[0], own[-1]
    first, last = np.zeros(len(own), np.float32), np.zeros(len(own), np.float32)
    first[0] = last[-1] = 1
    return np.column_stack([own, before, after, first, last]).astype(np.float32), np.array([len(x) for x in lines], np.float64)


def forward_backward(unary: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences (rows of `unary`, scores for label 1 against 0, filled up to the longest): marginals of label 1,
    expected label pairs (2 x 2, summed over neighbours of each sequence) and log partition values."""
    B, T = unary.shape
    score = np.stack([np.zeros_like(unary), unary], 2)
    alpha, beta = np.zeros((B, T, 2)), np.zeros((B, T, 2))
    alpha[:, 0] = score[:, 0]
    for t in range(1, T):
        m = alpha[:, t - 1, :, None] + trans
        step = np.logaddexp(m[:, 0], m[:, 1]) + score[:, t]
        alpha[:, t] = np.where((lengths > t)[:, None], step, alpha[:, t - 1])
    for t in range(T - 2, -1, -1):
        m = trans + (score[:, t + 1] + beta[:, t + 1])[:, None, :]
        beta[:, t] = np.where((lengths > t + 1)[:, None], np.logaddexp(m[..., 0], m[..., 1]), 0)
    log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    inside = np.arange(T)[None, :] < lengths[:, None]
    marginal = np.exp(np.minimum(alpha[..., 1] + beta[..., 1] - log_z[:, None], 0)) * inside
    pair = np.zeros((B, 2, 2))
    if T > 1:
        joint = alpha[:, :-1, :, None] + trans + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - log_z[:, None, None, None]
        pair = (np.exp(np.minimum(joint, 0)) * inside[:, 1:, None, None]).sum(axis=1)
    return marginal, pair, log_z


def alike(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rising lengths, each of which ends at twice its first, so that little is filled up."""
    at = 0
    while at < len(lengths):
        end = int(np.searchsorted(lengths, max(2 * lengths[at], 8), "right"))
        yield at, end
        at = end


@dataclass
class Field:
    """A fitted field: feature scaling, weights, label transitions and the logistic step on a document's mean."""

    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    bias: float
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def line_marginals(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of `good` of every line of each document; documents of like length are worked on together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(docs)
        order = sorted((i for i in range(len(docs)) if len(docs[i])), key=lambda i: len(docs[i]))
        for a, b in alike(np.array([len(docs[i]) for i in order], np.int64)):
            group = order[a:b]
            n = np.array([len(docs[i]) for i in group])
            flat = ((np.concatenate([docs[i] for i in group]) - self.mean) / self.spread).clip(-8, 8) @ self.weight + self.bias
            unary = np.zeros((len(group), n.max()))
            unary[np.arange(n.max())[None, :] < n[:, None]] = flat
            marginal, _, _ = forward_backward(unary, self.trans, n)
            for k, i in enumerate(group):
                out[i] = marginal[k, : n[k]]
        return out

    def quality(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The score of each document; one without a word is of no quality: 0."""
        mean = np.array([float(p @ w / w.sum()) if len(w) else 0.0 for p, (_, w) in zip(self.line_marginals([x for x, _ in docs]), docs, strict=True)])
        x = np.log((mean + 1e-4) / (1 - mean + 1e-4))
        return np.where([len(w) > 0 for _, w in docs], 1 / (1 + np.exp(-(self.slope * x + self.shift))), 0.0)


def fit_field(docs: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, steps: int = 150, l2: float = 1e-2) -> Field:
    """Maximum likelihood by accelerated gradient steps (Adam). Every line of a training document carries its document's label."""
    width = 3 * OWN + 2
    keep = [i for i, (x, _) in enumerate(docs) if len(x)]
    field = Field(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)))
    if not keep or len(set(good[keep].tolist())) < 2:
        return field
    keep.sort(key=lambda i: len(docs[i][0]))
    parts = [docs[i][0] for i in keep]
    y, n = good[keep].astype(np.float64), np.array([len(p) for p in parts])
    flat = np.concatenate(parts).astype(np.float64)
    field.mean, field.spread = flat.mean(0), flat.std(0) + 1e-6
    ends = np.cumsum(n)
    groups = list(alike(n))
    X = ((flat - field.mean) / field.spread).clip(-8, 8)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) / n  # classes and documents weigh alike
    line_share, line_y = np.repeat(share, n), np.repeat(y, n)
    pairs = np.zeros((len(y), 2, 2))
    pairs[np.arange(len(y)), y.astype(int), y.astype(int)] = n - 1
    theta, m, v = np.zeros(width + 5), np.zeros(width + 5), np.zeros(width + 5)
    for t in range(1, steps + 1):
        flat_unary = X @ theta[:width] + theta[width]
        flat_marginal, pair = np.zeros(len(X)), np.zeros((len(y), 2, 2))
        for a, b in groups:
            rows = slice(ends[a] - n[a], ends[b - 1])
            inside = np.arange(n[b - 1])[None, :] < n[a:b, None]
            unary = np.zeros(inside.shape)
            unary[inside] = flat_unary[rows]
            marginal, pair[a:b], _ = forward_backward(unary, theta[width + 1 :].reshape(2, 2), n[a:b])
            flat_marginal[rows] = marginal[inside]
        err = (flat_marginal - line_y) * line_share
        grad = np.concatenate([X.T @ err + l2 * theta[:width] / width, [err.sum()], ((pair - pairs) * share[:, None, None]).sum(0).ravel() + l2 * theta[width + 1 :]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    field.weight, field.bias, field.trans = theta[:width], float(theta[width]), theta[width + 1 :].reshape(2, 2)
    # the logistic step from a document's mean marginal to a probability
    p = field.quality([docs[i] for i in keep]).clip(1e-6, 1 - 1e-6)
    x, w = np.log(p / (1 - p)), np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    a, b = 1.0, 0.0
    for _ in range(300):
        e = (1 / (1 + np.exp(-(a * x + b))) - y) * w
        a, b = max(a - 0.3 * float(e @ x), 0.05), b - 0.3 * float(e.sum())
    field.slope, field.shift = a, b
    return field


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Field:
    """The field of a bounded sample of labelled documents; without both labels it scores every document with a word one half."""

    def work(rows: dict) -> dict:
        got = [document_features(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "quality": rows["quality"], "x": [x.tobytes() for x, _ in got], "w": [w.tolist() for _, w in got]}

    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    upto = F.sum(lines).over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    sample = labelled_sample(docs.where(lines <= FIT_LONGEST), labels, per_class).withColumn("upto", upto).where(F.col("upto") <= FIT_LINES).drop("upto")
    got = sorted((tuple(r) for r in map_slices(sample, work, "doc_id long, quality int, x binary, w array<double>").collect()), key=lambda r: r[:2])
    parts = [(np.frombuffer(x, np.float32).reshape(-1, 3 * OWN + 2), np.array(w)) for _, _, x, w in got]
    return fit_field(parts, np.array([q for _, q, _, _ in got]))


def score_documents(docs: DataFrame, field: Field, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null or empty text scores 0. Ids may be null (never held out) or repeat."""

    def work(rows: dict) -> dict:
        score = field.quality([document_features(t) for t in rows["text"]]).tolist()
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": score, "predicted": [int(s >= least) for s in score]}

    held = docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"))
    return map_slices(held, work, "doc_id long, held_out boolean, score double, predicted int")


def op3_quality_crf(spark, sf_dir):
    """Score every row of documents by a field that is fitted outside the held-out quarter; odd rows as in score_documents and labelled_sample."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2)
    return score_documents(docs, fit(docs, labels))
