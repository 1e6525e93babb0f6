"""Periodic runs of words by Karp-Miller-Rosenberg naming: blocks of 2^k words get names, level by level, so that equal blocks have
equal names. Common extensions descend the levels. Candidates stand on a grid and are extended by names alone: no rolling hash and no
suffix array is made.

Texts of a batch are laid end to end with a word of its own behind each, so that NumPy works on many short texts at once. Nothing
is shuffled: every text is one row's work.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, arrow_schema, spread, table

#: Words of the texts that are worked on together; a longer text is worked on alone.
TOGETHER = 1 << 16
#: Grid candidates that are extended at a time: bounds what a text of one repeated word holds.
CANDIDATES = 1 << 20
#: A run has this many words, and periods, at least. The grid below relies on three periods or more.
LEAST_WORDS, LEAST_PERIODS = 6, 4

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def next_level(names: np.ndarray, live: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of blocks of 2 * step words from those of step words, and the places whose block occurs elsewhere too.

    A block that occurs once is named -1 - place, which equals no other name; so only live places are ever sorted.
    """
    out = -1 - np.arange(len(names), dtype=names.dtype)
    live = live[live + step < len(names)]
    live = live[names[live + step] >= 0]
    if not len(live):
        return out, live
    pairs = names[live].astype(np.int64) * len(names) + names[live + step]
    order = np.argsort(pairs, kind="stable")
    fresh = np.concatenate(([True], np.diff(pairs[order]) != 0))
    group = np.cumsum(fresh) - 1
    again = np.bincount(group)[group] > 1
    live = live[order][again]
    out[live] = group[again]
    return out, np.sort(live)


def name_levels(words: np.ndarray) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4 ... words at every place, up to the last size of which any block occurs twice."""
    words = words.astype(np.int32)
    once = np.bincount(words)[words] == 1
    names = np.where(once, -1 - np.arange(len(words), dtype=np.int32), words).astype(np.int32)
    levels, live = [names], np.flatnonzero(~once)
    while len(live):
        names, live = next_level(names, live, 1 << (len(levels) - 1))
        if len(live):
            levels.append(names)
    return levels


def common_after(levels: list[np.ndarray], i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from i + q on. No block of twice the last size repeats, so each level is asked once."""
    n, got = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + got, i + got + q
        inside = b < n
        got += (inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])).astype(np.int64) << k
    return got


def common_before(levels: list[np.ndarray], i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many words before i equal those before i + q."""
    got = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a = i - got - (1 << k)
        inside = a >= 0
        a = np.where(inside, a, 0)
        got += (inside & (levels[k][a] == levels[k][np.where(inside, a + q, 0)])).astype(np.int64) << k
    return got


def runs_of(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of an array of word names, by start, then period; `longest` bounds a run's words.

    Words a period q apart are equal over three periods or more of a run, so a place that 2q divides has there a block of q or fewer
    words equal to the one q on. Of the periods that give one stretch, the least divides the others.
    """
    levels = name_levels(words)
    found: list[np.ndarray] = []
    held: list[tuple[np.ndarray, int]] = []

    def settle() -> None:
        i = np.concatenate([x for x, _ in held])
        q = np.repeat(np.array([y for _, y in held], np.int64), [len(x) for x, _ in held])
        held.clear()
        start, end = i - common_before(levels, i, q), i + q + common_after(levels, i, q)
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        found.append(np.unique(np.stack([start[long], end[long], q[long]], axis=1), axis=0))

    n_held = 0
    for q in range(1, min(longest // LEAST_PERIODS, (1 << len(levels)) - 1) + 1):
        names = levels[q.bit_length() - 1]
        ahead = names[q :: 2 * q]
        at = np.flatnonzero(names[: len(names) - q : 2 * q][: len(ahead)] == ahead)
        if len(at):
            held.append((at.astype(np.int64) * 2 * q, q))
            n_held += len(at)
            if n_held >= CANDIDATES:
                settle()
                n_held = 0
    if held:
        settle()
    rows = np.concatenate([np.empty((0, 3), np.int64), *found])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    _, least = np.unique(rows[:, :2], axis=0, return_index=True)
    rows = rows[least]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_together(texts: list[np.ndarray]) -> list[np.ndarray]:
    """runs_of each text (an array of names that all texts share), worked out on all of them at once."""
    sizes = np.array([len(t) for t in texts])
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    line, top = np.empty(first[-1], np.int32), max((int(t.max()) + 1 for t in texts if len(t)), default=0)
    for n, (t, at) in enumerate(zip(texts, first[:-1], strict=True)):
        line[at : at + len(t)] = t
        line[at + len(t)] = top + n
    rows = runs_of(line, int(sizes.max()))
    of = np.searchsorted(first, rows[:, 0], side="right") - 1
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    return [rows[a:b] - [at, at, 0] for a, b, at in zip(cut, cut[1:], first, strict=False)]


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each of n places: every tenth document by the crc of its id repeats a stretch to its end.

    With h = crc32 of the decimal id and g = h // 10, a document of h % 10 = 0 has from place a = g % n on the period
    1 + (n - a) // (3 + g % 8). A null id has no h and repeats nothing.
    """
    at = np.arange(n)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def outside_repeats(n: int, rows: np.ndarray) -> np.ndarray:
    """Places of n words that no run contains behind its first period."""
    if not len(rows):
        return np.arange(n)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, rows[:, 0] + rows[:, 2], 1)
    np.add.at(inside, rows[:, 1], -1)
    return np.flatnonzero(np.cumsum(inside[:n]) == 0)


def find_runs(docs: DataFrame, repeats=None, schema: str = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string", result=None) -> DataFrame:
    """doc_id, runs (by start, then period) and collapsed: the words outside the repeats of any run, joined by one space.

    Words lie between ASCII white space. A run is a longest stretch of consecutive words that has a period, of LEAST_WORDS words
    and LEAST_PERIODS of its smallest periods at least. A null or empty text has no word, no run and an empty collapsed text. Whole texts
    are read, however long: a text of n words takes about n * log2(its longest repeat) small integers. Rows stand alone, so null and repeated
    ids give a row each; an empty table gives none; other columns are ignored.
    repeats(doc_id, n), if given, says which original word stands at each place; result(doc_id, rows, collapsed bytes) makes
    another row, of `schema`.
    """
    arrow = arrow_schema(schema)
    result = result or (lambda doc, rows, text: (doc, [{"start": a, "length": b - a, "period": q} for a, b, q in rows.tolist()], text.decode()))

    def group(part: list[tuple]) -> Iterator[tuple]:
        names = pa.array([w for _, words in part for w in words], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cut = np.cumsum([0] + [len(words) for _, words in part])
        order = [repeats(doc, len(words)) if repeats else np.arange(len(words)) for doc, words in part]
        found = runs_together([names[a:b][o] for a, b, o in zip(cut, cut[1:], order, strict=False)])
        for (doc, words), o, rows in zip(part, order, found, strict=True):
            kept = o[outside_repeats(len(words), rows)].tolist()
            yield result(doc, rows, b" ".join([words[i] for i in kept]))

    def work(docs: Iterator[tuple]) -> Iterator[tuple]:
        held, n = [], 0
        for doc, words in sorted(docs, key=lambda x: len(x[1])):
            if held and n + len(words) > TOGETHER:
                yield from group(held)
                held, n = [], 0
            held.append((doc, words))
            n += len(words)
        if held:
            yield from group(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                # bytes.split() splits at ASCII white space alone
                split = ((doc, (text or b"").split()) for doc, text in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True))
                cols = list(zip(*work(split), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return spread(docs.select("doc_id", F.col("text").cast("binary").alias("text"))).mapInArrow(run, schema)


def digest(doc: int | None, rows: np.ndarray, text: bytes) -> tuple:
    """A row of SCHEMA: the longest run (ties: least start, then period) and hashes of all runs and of the collapsed text."""
    listed = rows.copy()
    listed[:, 1] -= listed[:, 0]
    every = "".join("%d,%d,%d\n" % tuple(r) for r in listed.tolist())
    best = (None,) * 4
    if len(rows):
        start, length, period = listed[np.lexsort((listed[:, 2], listed[:, 0], -listed[:, 1]))[0]].tolist()
        best = (start, length, period, 1000 * length // period)
    return (doc, len(rows), *best, hashlib.sha256(every.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def op11_kmr_runs(spark, sf_dir):
    """Runs of every whole text of documents, with the repeats that `planted` states.

    One row per row of documents: n_runs, the longest run (nulls without one) and two hashes. Nulls, repeats, empty tables and long
    texts as in find_runs; a null id plants nothing.
    """
    return find_runs(table(spark, sf_dir, "documents"), planted, SCHEMA, digest)
