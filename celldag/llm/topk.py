"""Exact top-k inner-product search without random access (NRA).

For a query q, dimension d is a list of all candidates sorted by falling q_d * x_d, which is the
order of x_d, read forwards or backwards by q_d's sign; so a block of candidates is sorted once
for all its queries.  The lists are read from the top, a window at a time and all to the same
depth, and only what was just read is added to its candidates' sums.  A candidate's upper bound
adds, for each list in which it wasn't met, the last value read there; its lower bound adds that
list's least value.  Candidates whose upper bound is below the k-th best lower bound are dead.
Reading stops when no outsider can qualify and few are left, and those get their final scores.

Candidates and queries are dealt into a grid of blocks of bounded size; each cell yields its own
top k of each query, and the cells of a query are merged.  One block of candidates is searched
first; the k-th best score that a query has there is where the bounds begin in all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from celldag.llm.common import cut

CANDIDATES, QUERIES = 4096, 1024
DEPTHS = (0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)  # the shares of the lists after which bounds are compared
#: Reading goes on while more than this share of the candidates may still qualify.
FEW = 0.35
LONG = 2**63 - 1


def exact_scores(x: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products, components of x up to `most`: in doubles or 64-bit integers where these hold every sum, else in Python's integers, brought into 64 bits last."""
    limit = most * float(np.abs(q).max(initial=0)) * len(q)
    if limit < 2**53:
        return (x @ q).astype(np.int64)
    if limit < 2**62:
        return x.astype(np.int64) @ q.astype(np.int64)
    whole = [int(c) for c in q]
    return np.array([max(-LONG, min(LONG, sum(int(a) * b for a, b in zip(row, whole)))) for row in x], np.int64)


class Lists:
    """A block's candidates, sorted by each dimension, in both directions: [0] by rising component, [1] by falling."""

    def __init__(self, x: np.ndarray):
        n, dims = x.shape
        order = np.argsort(x, axis=0, kind="stable")
        values = np.take_along_axis(x, order, axis=0).T
        self.x, self.order = x, np.ascontiguousarray(np.stack([order.T, order.T[:, ::-1]]))  # a list lies in one piece
        self.values = np.ascontiguousarray(np.stack([values, values[:, ::-1]]))
        self.most = float(np.abs(values).max(initial=0))


def nra(lists: Lists, q: np.ndarray, out: np.ndarray, k: int, least: float) -> tuple[np.ndarray, int]:
    """(the candidates that may be among the k best, entries read).

    out: candidates that don't count.  least: a score that k candidates elsewhere reach already; where it is known, lower bounds are not needed.
    """
    n, dims = lists.x.shape
    alive = np.flatnonzero(~out)
    weight, way = q[:, None], (q > 0).astype(np.int64)
    every = np.arange(dims)
    first, last = (lists.values[way, every, i] * q for i in (0, -1))  # the most and the least that a list gives
    # A bound's rounding error stays below this.
    slack = float(np.maximum(np.abs(first), np.abs(last)).sum()) * (dims + 2) * 2.0**-50
    total, floor, read, a, alone = np.zeros(n), np.full(n, last.sum()), 0, 0, least == -np.inf
    for depth in DEPTHS:
        b = max(a + 1, round(depth * n))
        if b > n:
            break
        got, at = lists.values[way, every, a:b] * weight, lists.order[way, every, a:b].ravel()
        total += np.bincount(at, got.ravel(), minlength=n)
        if alone:
            floor -= np.bincount(at, np.repeat(last, b - a), minlength=n)
        read, a = read + got.size, b
        if alone and len(alive) >= k:
            lower = (total + floor)[alive]
            least = max(least, float(np.partition(lower, len(alive) - k)[len(alive) - k]) - slack)
        # Where a candidate was met, its own value counts instead of the last one read there.
        met = np.bincount(lists.order[way, every, :b].ravel(), np.repeat(got[:, -1], b), minlength=n)
        alive = alive[(total - met)[alive] + got[:, -1].sum() + slack >= least]
        if len(alive) <= max(k, FEW * n):
            break
    return alive, read


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row of the query, vec_id, score), the k best of each query in this block, and how many entries of lists were read.

    A query's own id doesn't count.  least: for each query a score that k others have reached elsewhere, or -inf.
    """
    rows, found, scores, read = [], [], [], 0
    if len(ids) and len(query_ids):
        lists = Lists(x) if x.shape[1] else None
        for i in range(len(query_ids)):
            own = ids == query_ids[i]
            alive, n = nra(lists, q[i], own, k, -np.inf if least is None else float(least[i])) if lists else (np.flatnonzero(~own), 0)
            score = exact_scores(x[alive], q[i], lists.most if lists else 0.0)
            best = np.lexsort((ids[alive], -score))[:k]
            rows.append(np.full(len(best), i))
            found.append(ids[alive][best])
            scores.append(score[best])
            read += n
    join = lambda parts: np.concatenate([*parts, np.empty(0, np.int64)])
    return join(rows), join(found), join(scores), read


def whole_vectors(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """id, x (floor(scale * component), array<double>), dim; rows with a null or non-finite component, or a null id, are left out."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null").where(finite.eqNullSafe(True))
    return rows.select("id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("double")).alias("x")).withColumn("dim", F.size("x"))


def exact_topk(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest integer inner product for each query row.

    is_query: a condition on `id`.  Candidates are all other rows of the same dimension; ties go
    to the smaller vec_id.  Repeated rows count once.  Fewer than k candidates: all of them; an empty table: none.
    Empty vectors score 0 with each other.  Scores are exact; those that no long holds are given as the nearest one.
    Further columns are ignored, whatever their names.
    """
    rows = whole_vectors(df, id_col, vector, scale)
    queries = rows.where(is_query)
    n, m = rows.count(), queries.count()
    n_c, n_q = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    own = F.xxhash64("id", "x")
    every = lambda first, size: F.explode(F.sequence(F.lit(first), F.lit(size - 1)))
    left = rows.select("id", "x", "dim", F.pmod(own, F.lit(n_c)).cast("int").alias("c"))
    right = queries.select("id", "x", "dim", F.pmod(own, F.lit(n_q)).cast("int").alias("q"))
    keys = ("dim", "c", "q")

    def unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        t = t.combine_chunks()
        ids = t.column("id").to_numpy()
        if not len(ids):
            return ids, np.zeros((0, 0)), None
        dim = t.column("dim")[0].as_py()
        x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        x = x + 0.0  # no -0.0, so that equal vectors have equal bits
        keep = np.unique(np.column_stack([ids, x.view(np.int64)]), axis=0, return_index=True)[1]
        least = t.column("least").to_numpy(zero_copy_only=False)[keep] if "least" in t.column_names else None
        return ids[keep], x[keep], least

    def cell(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        ids, x, _ = unpack(candidates)
        query_ids, q, least = unpack(wanted)
        row, found, score, _ = search_block(ids, x, query_ids, q, k, least)
        return pa.table({"query_id": pa.array(query_ids[row], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64())})

    def search(candidates: DataFrame, wanted: DataFrame) -> DataFrame:
        return candidates.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score long")

    best = search(left.where("c = 0").select("*", every(0, n_q).alias("q")), right.withColumn("c", F.lit(0)))
    if n_c > 1:
        best = cut(best)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        least = best.withColumn("r", rank).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
        # The double below the score, as a double may be above the long it stands for.
        known = right.join(least, "id", "left").withColumn("least", F.coalesce(F.col("least") - F.abs("least") * 2.0**-52, F.lit(float("-inf"))))
        others = left.where("c > 0").select(*[F.col(x).alias(x) for x in left.columns], every(0, n_q).alias("q"))  # columns apart from those joined above
        rest = search(others, known.select("*", every(1, n_c).alias("c")))
        best = best.unionByName(rest)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: The same in SQL.
ORACLE = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v) q JOIN (SELECT DISTINCT * FROM v) c ON q.id <> c.id AND len(q.x) = len(c.x) WHERE q.id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
