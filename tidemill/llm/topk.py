"""Exact top-k by inner product: no-random-access aggregation over sorted lists, one list per component.

Each block of candidates keeps, for every component, its rows sorted by value. Lists are read in lockstep, a step of rows at
a time: in falling order for queries whose weight of the component is positive, in rising order where it is negative. What is
read is added to a running lower bound of its candidate's score, in which components not yet read count as the list's far
end. The last values read bound a candidate that no list has shown yet; once none such can qualify for a query, upper
bounds are drawn for all its candidates, and the query stops when only few can still qualify: final scores of those are resolved,
and of no others. Queries that have stopped leave the running sums; lists end early when all have.

Running sums are in float32 where no sum can pass 2^24, so that they are exact, else in float64 with bounds widened by its
rounding. Final scores are exact integers; one beyond a long counts as the long's end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERY_BLOCK, CANDIDATE_BLOCK, CHUNK = 16384, 8192, 128
#: Steps in which a list is read.
STEPS = 16
_LONG = (-(1 << 63), (1 << 63) - 1)


def exact_scores(X: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of X with q as longs, by Python's integers where 64 bits might not do."""
    if float(np.abs(X.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * X.shape[1] < 1 << 62:
        return X @ q
    return np.array([min(max(sum(map(int.__mul__, x, q.tolist())), _LONG[0]), _LONG[1]) for x in X.tolist()], np.int64)


def nra_block(queries: np.ndarray, q_ids: np.ndarray, cands: np.ndarray, c_ids: np.ndarray, k: int, depths: list[float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates in this block of each query, but of its own id: (query row, candidate row, score), exact, ties to the smaller id.

    Fewer than k candidates: all. Repeated rows count each on its own. `depths` takes the share of the lists read for each query.
    """
    n, dims = cands.shape
    by_id = np.argsort(c_ids, kind="stable")
    cands, c_ids = cands[by_id], c_ids[by_id]
    order = np.argsort(cands, axis=0, kind="stable")[::-1]  # the sorted lists; rising order is the same read from the end
    most = float(np.abs(cands.astype(np.float64)).max(initial=0)) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * dims
    kind = np.float32 if most <= 1 << 24 else np.float64
    slack = 0.0 if most <= 1 << 52 else most * dims * 2.0**-50
    value = np.take_along_axis(cands, order, 0).astype(kind)
    exact = cands.astype(kind if most <= 1 << 52 else np.int64)
    lo, hi = value[-1], value[0]
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], 0)
    few, step = max(4 * k, n // 16), max(1, -(-n // STEPS))
    out_q, out_c, out_s = [], [], []
    for at in range(0, len(queries), CHUNK):
        rows = np.arange(at, min(at + CHUNK, len(queries)))
        weight = queries[rows].T.astype(kind)
        pos, neg = np.maximum(weight, 0), np.minimum(weight, 0)
        lower = np.repeat((lo @ pos + hi @ neg)[None, :], n, 0)
        for r in range(0, n, step):
            e = min(n, r + step)
            for d in range(dims):
                lower[order[r:e, d]] += (value[r:e, d] - lo[d])[:, None] * pos[d]
                lower[order[n - e : n - r, d]] += (value[n - e : n - r, d] - hi[d])[:, None] * neg[d]
            # what a list can still add over its far end
            gain = np.concatenate([pos * (value[e - 1] - lo)[:, None], neg * (value[n - e] - hi)[:, None]])
            unseen = (lo @ pos + hi @ neg) + gain.sum(0)
            ready = np.flatnonzero((unseen - slack <= lower.max(0) + slack) | (e == n))
            if not len(ready):
                continue
            low = np.ascontiguousarray(lower[:, ready].T)
            own = q_ids[rows[ready]][:, None] == c_ids[None, :]
            low[own] = -np.inf
            kth = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(ready), -np.inf, kind)
            if slack:  # scores beyond a long are equal
                kth = np.where(kth < _LONG[0], -np.inf, np.minimum(kth, _LONG[1]))
            able = np.flatnonzero((unseen[ready] <= kth + 2 * slack) | (e == n))
            if not len(able):
                continue
            hidden = np.concatenate([place >= e, place < n - e], 1).astype(kind)
            open_ = low[able] + (hidden @ gain[:, ready[able]]).T + 2 * slack >= kth[able, None]
            open_ &= ~own[able]
            stop = (open_.sum(1) <= few) | (e == n)
            for i in np.flatnonzero(stop):
                c = np.flatnonzero(open_[i])
                q = queries[rows[ready[able[i]]]]
                s = exact_scores(cands[c], q) if exact.dtype == np.int64 else (exact[c] @ q.astype(kind)).astype(np.int64)
                best = np.lexsort((c, ~s))[:k]
                out_q.append(np.full(len(best), rows[ready[able[i]]]))
                out_c.append(by_id[c[best]])
                out_s.append(s[best])
                if depths is not None:
                    depths.append(e / n)
            stay = np.delete(np.arange(len(rows)), ready[able[stop]])
            if len(stay) < len(rows):
                rows, pos, neg, lower = rows[stay], pos[:, stay], neg[:, stay], np.ascontiguousarray(lower[:, stay])
            if not len(rows):
                break
    if not out_q:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows by integer inner product for each row whose id is divisible by `every`.

    Components become floor(scale * x), those beyond a long its end. Rows whose id is null, or whose vector is null or holds a
    null, NaN or infinite component, take no part; an empty vector scores 0. A shorter vector counts as ended by zeros. Repeated query ids give one
    list each, of the row that comes first by vector; repeated candidate rows count each. Empty table: no rows.
    Queries are met in blocks with blocks of candidates, so a task holds QUERY_BLOCK and CANDIDATE_BLOCK vectors at
    most and sends k rows per query on.
    """
    x = F.transform(vector_col, lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("long"))
    sound = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    base = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    total, dims, queries = base.agg(F.count("*"), F.max(F.size("x")), F.count(F.when(F.col("id") % every == 0, 1))).first()
    if not total or not queries:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(dims, 1)
    c_blocks, q_blocks = -(-total // CANDIDATE_BLOCK), -(-queries // QUERY_BLOCK)
    deal = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), F.lit(n)).cast("int")
    cand = base.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), F.pmod(F.xxhash64("id", "x"), F.lit(c_blocks)).cast("int").alias("cb"))
    query = base.where(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("x")).select("id", "x", deal(q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))

    def matrix(col: pd.Series) -> np.ndarray:
        out = np.zeros((len(col), dims), np.int64)
        for i, v in enumerate(col):
            out[i, : len(v)] = v
        return out

    def kernel(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q_ids, c_ids = q["id"].to_numpy(), c["id"].to_numpy()
        a, b, s = nra_block(matrix(q["x"]), q_ids, matrix(c["x"]), c_ids, k)
        return pd.DataFrame({"query_id": q_ids[a], "vec_id": c_ids[b], "score": s})

    part = query.groupBy("qb", "cb").cogroup(cand.groupBy("qb", "cb")).applyInPandas(kernel, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_nra(spark, sf_dir):
    """The 20 best others for every twentieth row of embeddings; odd rows as in top_k."""
    from .common import table

    return top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(CASE WHEN len(q.x) = len(c.x) AND len(q.x) > 0 THEN list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[]))
                   ELSE coalesce(list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1), lambda i: q.x[i] * c.x[i])), 0) END AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
