"""How far the sources of a language differ in their terms, by dense tiles of groups and terms.

Tasks count the terms of their documents and give partial sums. The kept terms of a language are dealt into blocks, its sources into
blocks too; a tile is the dense int64 matrix of what each source of one block gives each term of another. All pairs of
two tiles of one term block are taken at once by broadcasting and summed over its terms; the partial pair matrices of
the term blocks add up. The terms that a source has most over its language are kept in a heap per tile and source, and the heaps merged.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SLICE, discard, spread, stored, table

#: Documents of a language that a term needs, what is added to every count, and the whole of which shares are parts.
LEAST_DOCS, ADDED, WHOLE = 30, 5, 1_000_000_000
#: Ranks of the part `term`.
TOP = 50
#: Sources and terms of a tile: all pairs of two tiles take 8 * 64 * 64 * 512 bytes, 16 MB.
TILE_GROUPS, TILE_TERMS = 64, 512
#: Distinct terms of groups that a task holds before it gives them away as partial sums, and pair matrices (32 kB) likewise.
HELD_TERMS, HELD_PAIRS = 300_000, 1000

#: Bytes to bytes: A-Z lower-cased, other letters and all bytes of other alphabets as they are, the rest a space.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

KEYS = ["lang", "block", "gblock"]


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term and the documents that have it; a null term says that the group occurs. Stored."""

    def given(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            names = [None, *n]
            cols = [pa.array([lang] * len(names)), pa.array([source] * len(names)), pa.array(names, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                for lang, source, text in zip(*(rows[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                    n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                    words, before = terms_of(text or b""), len(n)
                    n.update(words)
                    docs.update(set(words))
                    held += len(n) - before
                    if held > HELD_TERMS:
                        yield from given(groups)
                        groups, held = {}, 0
        yield from given(groups)

    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("binary").alias("text"))
    parts = spread(named).mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return stored(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(WHOLE * (count + ADDED) / whole), exact: three digits of the quotient at a time, so whole may be up to 9e15."""
    out, rest = np.divmod(np.asarray(count, np.int64) + ADDED, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return 1 + out


def pair_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over terms (columns) of |row of a - row of b|, for all pairs of rows."""
    return np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2)


def tile_of(groups: pd.DataFrame, counts: pd.DataFrame) -> tuple[np.ndarray, list[tuple[int, str, int]]]:
    """The shares of one block of sources in one block of terms, and of each source the TOP terms over the language's share: (row, term, value)."""
    groups = groups.sort_values("row")
    width, kept = int(groups["width"].iloc[0]), int(groups["kept"].iloc[0])
    tile = np.zeros((len(groups), width), np.int64)
    row, slot = counts["row"].to_numpy(np.int64), counts["slot"].to_numpy(np.int64)
    tile[row, slot] = counts["n"].to_numpy(np.int64)
    if kept:
        tile = share(tile, groups["size"].to_numpy(np.int64)[:, None] + ADDED * kept)
    over = tile[row, slot] - share(counts["total"].to_numpy(np.int64), np.int64(int(groups["lang_size"].iloc[0]) + ADDED * kept)) if len(counts) else np.empty(0, np.int64)
    best = []
    names = counts["term"].to_numpy()
    for r in range(len(groups)):
        at = np.flatnonzero((row == r) & (over > 0))
        best += [(r, term, -less) for less, term in heapq.nsmallest(TOP, zip((-over[at]).tolist(), names[at], strict=True))]
    return tile, best


def make_tiles(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, block, gblock, n (sources), width (terms), tile (int64 bytes by row) and best (array of row, term, value) of every tile. Stored."""

    def work(groups: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if groups.empty:
            return pd.DataFrame()
        tile, best = tile_of(groups, counts)
        first = groups.iloc[0]
        found = [{"row": r, "term": t, "value": v} for r, t, v in best]
        return pd.DataFrame({"lang": [first["lang"]], "block": [first["block"]], "gblock": [first["gblock"]], "n": [len(groups)], "width": [tile.shape[1]], "tile": [tile.astype("<i8").tobytes()], "best": [found]})

    kept = kept.select(*(F.col(c).alias(c) for c in kept.columns))  # columns of its own, as both sides come from groups
    schema = "lang string, block long, gblock int, n int, width int, tile binary, best array<struct<row:int,term:string,value:long>>"
    return stored(groups.groupBy(*KEYS).cogroup(kept.groupBy(*KEYS)).applyInPandas(work, schema), "tiles")


def pair_matrices(tiles: DataFrame) -> DataFrame:
    """lang, a, b, value: the sum over all kept terms for every two different sources (numbered in their language), both ways."""
    side = lambda c: tiles.select("lang", "block", "width", *(F.col(x).alias(f"{x}_{c}") for x in ("gblock", "n", "tile")))
    both = side("a").join(side("b").drop("width"), ["lang", "block"]).where("gblock_a <= gblock_b").drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}

        def given() -> pa.RecordBatch:
            cols = [pa.array([k[0] for k in sums]), *(pa.array([k[i] for k in sums], pa.int32()) for i in (1, 2)), pa.array([m.shape[1] for m in sums.values()], pa.int32()), pa.array([m.ravel() for m in sums.values()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["lang", "gblock_a", "gblock_b", "n_b", "sums"])

        for batch in batches:
            for at in range(batch.num_rows):
                x = batch.slice(at, 1).to_pylist()[0]
                a, b = (np.frombuffer(x[f"tile_{c}"], "<i8").reshape(x[f"n_{c}"], x["width"]) for c in "ab")
                key = (x["lang"], x["gblock_a"], x["gblock_b"])
                sums[key] = sums[key] + pair_sums(a, b) if key in sums else pair_sums(a, b)
                if len(sums) >= HELD_PAIRS:
                    yield given()
                    sums.clear()
        if sums:
            yield given()

    matrices = both.mapInArrow(run, "lang string, gblock_a int, gblock_b int, n_b int, sums array<long>")
    cells = matrices.select("lang", "gblock_a", "gblock_b", "n_b", F.posexplode("sums").alias("at", "value"))
    cells = cells.select("lang", (F.col("gblock_a") * TILE_GROUPS + F.floor(F.col("at") / F.col("n_b"))).cast("int").alias("a"), (F.col("gblock_b") * TILE_GROUPS + F.col("at") % F.col("n_b")).alias("b"), "value")
    one = cells.where("a < b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return one.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "value").select("lang", "p.a", "p.b", "value")


def audit_sources(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of docs (lang, source, text).

    Terms are stretches of ASCII letters and of all other alphabets' characters, A-Z lower-cased; a language keeps those in LEAST_DOCS of
    its documents. A source has a share of WHOLE for every kept term, from its count and ADDED. Part `pair` has for each
    source every other one of the language and the summed difference of shares (0 if no term is kept); part `term` the TOP terms that
    it has and has more of than the language. Ranks go by value, then item.

    Null lang, source and text are empty. Every row is a document, whatever its id; a group of empty texts still occurs. An empty table
    gives no row, other columns are ignored. The rows of `pair` grow with the square of a language's sources, as the result is all pairs.
    """
    counts = count_terms(docs)
    vocab = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    vocab = stored(vocab, "vocab")
    langs = vocab.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size")).withColumn("blocks", F.ceil(F.col("kept") / TILE_TERMS))
    in_block = Window.partitionBy("lang", "block")
    placed = vocab.join(langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).drop("blocks")
    placed = stored(placed.withColumn("slot", F.row_number().over(in_block.orderBy("term")) - 1), "placed")
    mine = stored(counts.where("term is not null").join(placed, ["lang", "term"]).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "total", "block", "slot"), "kept")
    sizes = mine.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    # numbered in one task a language, as it has few sources beside its rows
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").select("lang", "source", F.coalesce("size", F.lit(0)).alias("size"), number.alias("g"))
    groups = stored(groups.withColumns({"gblock": F.floor(F.col("g") / TILE_GROUPS).cast("int"), "row": F.col("g") % TILE_GROUPS}), "groups")
    widths = placed.groupBy("lang", "block").agg(F.count("*").alias("width"))
    every = groups.join(langs, "lang", "left").select("lang", "gblock", "row", "size", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "lang_size")), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.coalesce("blocks", F.lit(1)), F.lit(1)) - 1)).alias("block"))
    every = every.join(widths, ["lang", "block"], "left").na.fill(0, ["width"])
    tiles = make_tiles(every, mine.join(groups.select("lang", "source", "gblock", "row"), ["lang", "source"]).select(*KEYS, "row", "slot", "n", "total", "term"))

    name = lambda c: groups.select("lang", F.col("g").alias(c), F.col("source").alias("source" if c == "a" else "item"))
    pairs = pair_matrices(tiles).join(name("a"), ["lang", "a"]).join(name("b"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = tiles.select("lang", "gblock", F.explode("best").alias("t")).select("lang", (F.col("gblock") * TILE_GROUPS + F.col("t.row")).alias("a"), F.col("t.term").alias("item"), F.col("t.value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = best.join(name("a"), ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    out = stored(pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms), "divergence")
    discard(counts, vocab, placed, mine, groups, tiles)
    return out


def op13_term_tiles(spark, sf_dir):
    """All sources of documents against one another; odd rows as in audit_sources."""
    return audit_sources(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), w AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS size FROM (SELECT DISTINCT lang FROM g) l LEFT JOIN k ON k.lang = l.lang GROUP BY 1),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS size FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (s.size + 5 * v.v) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (v.size + 5 * v.v) AS q
  FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
