"""N-gram Jaccard join by MinHash banding.

Texts that are equal are one node. Each node's word n-grams give MinHash values, cut into bands whose number and rows
follow from the recall wanted at the threshold. Nodes are shuffled on band hashes; every bucket only links its members to
its least one. Connected candidates form blocks, blocks are dealt in tiles, and every pair of a tile is verified on
the full n-gram sets with one sparse product: a task emits a count and a root per node, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_slices, stored, table

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.999, 6
#: Nodes of a tile: bounds the rows of a verification task at twice this.
TILE = 512
#: Rows up to which candidate nodes (about 100 bytes each) are broadcast to read texts again, and classes to name them; beyond it they are joined by a shuffle.
BROADCAST_NODES = 200_000

_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def bands_for(threshold: float, recall: float, rows: int = ROWS) -> int:
    """The least number of bands of so many rows with which a pair at the threshold shares one at the wanted rate."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BASE, -k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of all runs of `words` words; a shorter text is one run, a text without a word none.

    Words stand between spaces, tabs, line feeds, vertical tabs, form feeds and returns.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate([[False], ~_BLANK[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.to(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
    word = mixed((total[end] - total[start]) * down[start])
    k = min(words, len(word))
    run = np.zeros(len(word) - k + 1, np.uint64)
    for i in range(k):
        run = run * np.uint64(0xD6E8FEB86659FD93) + word[i : i + len(run)]
    return np.unique(mixed(run + np.uint64(k)))


def band_hashes(grams: np.ndarray, bands: int, rows: int = ROWS) -> list[int]:
    """One signed 64-bit hash for each band, its number mixed in; none for an empty set."""
    if not len(grams):
        return []
    factors = np.array([pow(_BASE, 2 * i + 3, 1 << 64) | 1 for i in range(bands * rows)], np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        np.minimum(least, (grams[at : at + 2048, None] * factors).min(axis=0), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = mixed(out * np.uint64(_BASE) + least.reshape(bands, rows)[:, r])
    return out.view(np.int64).tolist()


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Boolean matrix of the pairs whose Jaccard similarity is num / den or more, by exact counts; no set is linked to itself."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    gram = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    new = np.append(True, gram[1:] != gram[:-1])
    number = np.cumsum(new) - 1
    shared = (np.bincount(number) > 1)[number]  # a gram of one set adds to no intersection
    owner, number = owner[shared], number[shared]
    number = np.unique(number, return_inverse=True)[1] if len(number) else number
    inter = np.zeros((n, n), np.float64)
    for at in range(0, int(number.max()) + 1 if len(number) else 0, 4096):
        lo, hi = np.searchsorted(number, (at, at + 4096))
        m = np.zeros((n, int(number[hi - 1]) - at + 1), np.float32)
        m[owner[lo:hi], number[lo:hi] - at] = 1
        inter += m @ m.T
    both = inter.astype(np.int64)
    union = size[:, None] + size[None, :] - both
    out = (den * both >= num * union) & (union > 0)
    np.fill_diagonal(out, False)
    return out


def verifier(threshold: float) -> Callable[[pa.Table], pa.Table]:
    from fractions import Fraction

    exact = Fraction(str(threshold))

    def verify(group: pa.Table) -> pa.Table:
        node = group["node"].to_numpy()
        side, copies = group["tile"].to_numpy(), group["copies"].to_numpy()
        found = linked([np.frombuffer(x.as_buffer(), np.uint64) for x in group["grams"]], exact.numerator, exact.denominator)
        if group["ti"][0].as_py() != group["tj"][0].as_py():
            found &= side[:, None] != side[None, :]
        root = node.copy()
        while True:  # least id among linked nodes, until nothing changes
            least = np.where(found, root[None, :], np.iinfo(np.int64).max).min(axis=1)
            least = np.minimum(least, root)
            if (least == root).all():
                break
            root = least
        return pa.table({"node": node, "root": root, "links": (found * copies[None, :]).sum(axis=1).astype(np.int64)})

    return verify


def near_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links for every row of docs, as `told_apart` gives them."""
    return told_apart(docs, words, threshold, recall).select("doc_id", "class_id", "n_links")


def told_apart(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), class_id, n_links, leads for every row of docs: its class of documents linked by Jaccard similarity of word n-grams.

    leads: whether the row's id and text are the least of its class; true for a row that is in no class.

    class_id is the least doc_id of the class; n_links counts other documents at the threshold or above, copies included.
    Texts without a word (null too) are linked to nothing; a row without an id is of no class and has no links. Rows
    with an equal text are copies of each other, repeated ids among them. Rows that repeat an id with another text are documents of their own.
    """
    bands = bands_for(threshold, recall)
    text = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"), "text")

    def sign(rows: dict) -> dict:
        return {"doc_id": rows["doc_id"], "h1": rows["h1"], "h2": rows["h2"], "bands": [band_hashes(shingles(t, words), bands) for t in rows["text"]]}

    signed = stored(map_slices(text, sign, "doc_id long, h1 long, h2 long, bands array<long>"), "signed")
    real = signed.where(F.col("doc_id").isNotNull() & (F.size("bands") > 0))
    nodes = stored(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("band"))
    least = rows.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("band", "least")
    edges = rows.join(least, "band").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    block = stored(components(edges), "blocks")
    sizes = block.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiled = block.join(sizes, "root").join(nodes.select(F.col("node").alias("id"), "first", "copies", "h1", "h2"), "id").select(F.col("id").alias("node"), "first", "root", "copies", "h1", "h2", "tiles", F.pmod(F.xxhash64("id"), "tiles").cast("int").alias("tile"))
    tiled = stored(tiled, "tiled")

    wanted = tiled.select(F.col("first").alias("doc_id"), "h1", "h2", "node", "root", "copies", "tiles", "tile")
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    # a node's first row: repeats of that row are dropped below, by node
    own = text.join(wanted, ["doc_id", "h1", "h2"])

    def grams(rows: dict) -> dict:
        return {"node": rows["node"], "grams": [shingles(t, words).tobytes() for t in rows["text"]]} | {c: rows[c] for c in ("root", "copies", "tiles", "tile")}

    sets = map_slices(own.select("node", "text", "root", "copies", "tiles", "tile"), grams, "node long, grams binary, root long, copies long, tiles int, tile int").dropDuplicates(["node"])
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("node", "grams", "root", "copies", "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"))
    found = stored(dealt.groupBy("root", "ti", "tj").applyInArrow(verifier(threshold), "node long, root long, links long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = stored(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("node"), F.col("root").alias("class")), "classes")
    names = stored(classes.join(nodes.select("node", "first", "h1", "h2"), "node").groupBy("class").agg(F.min(F.struct("first", "h1", "h2")).alias("name")), "names")
    classes = classes.join(F.broadcast(names) if names.count() <= BROADCAST_NODES else names, "class")
    named = nodes.select("h1", "h2", "node", "first", "copies").join(links, "node", "left").join(classes, "node", "left")
    named = named.select("h1", "h2", F.coalesce("name", F.struct("first", "h1", "h2")).alias("name"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    # texts without a word are not among the nodes, so they stay by themselves
    key = F.when(F.col("doc_id").isNotNull() & (F.size("bands") > 0), F.col("h1"))
    rows = signed.select("doc_id", "h1", key.alias("k1"), "h2").join(named.withColumnRenamed("h1", "k1"), ["k1", "h2"], "left")
    leads = F.coalesce(F.col("name") == F.struct(F.col("doc_id").alias("first"), "h1", "h2"), F.col("name").isNull())
    return rows.select("doc_id", "h1", "h2", F.coalesce("name.first", "doc_id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), leads.alias("leads"))


def op10_ngram_join(spark, sf_dir):
    """Class and number of links of every row of documents; odd rows as in told_apart."""
    return near_classes(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS gram
  FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 5 * shared >= 4 * (a.n + b.n - shared)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y)
SELECT d.doc_id, (SELECT min(y) FROM reach r WHERE r.x = d.doc_id) AS class_id,
       (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links
FROM documents d
"""
