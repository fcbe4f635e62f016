"""Operator 9: exact top-k by inner product with no-random-access aggregation over sorted lists.

Each component is one list, sorted by its part of the score: values from the top where the query's
component is positive, from the bottom where it is negative. All lists of a block of candidates are read
in step, slice by slice. After each slice a candidate's lower bound takes the worst value of the lists in
which it hasn't turned up yet, its upper bound the value at which the reading stands. Reading stops
for a query once no outsider's upper bound reaches its k-th lower bound; the scores of those left are
then resolved. Many queries share one pass: with x clamped to the reading's front, upper bounds are
max(x, front) and lower bounds the value or the end of the list, so a slice costs two matrix products.
Queries and candidates meet in blocks, every block pair in a task of its own; blocks keep k rows per query.

Defined cases: vectors that are null or hold null or non-finite components take no part, as query or
candidate; only vectors of equal length are compared; ties go to the smaller id; a query with fewer
candidates than k gets them all; rows of one id are queries and candidates of their own, each barred from itself alone;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellshift.llm.common import materialize

DEPTHS = (0.125, 0.25, 0.5, 0.75)  # shares of the lists read before bounds are compared anew
QUERY_ROWS, CANDIDATE_ROWS = 4096, 8192


def _ends(vectors: np.ndarray, read: int) -> tuple[np.ndarray, np.ndarray]:
    """The values at which the reading from the top and from the bottom stands."""
    n = len(vectors)
    ordered = np.sort(vectors, axis=0)
    return ordered[n - read], ordered[read - 1]


def block_top(q_rows: np.ndarray, queries: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of one block for each query: query row, candidate row, score. Integer values in doubles are exact."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    n = len(candidates)
    worst_top, worst_bottom = candidates.min(axis=0), candidates.max(axis=0)
    open_ = np.arange(len(queries))
    picked: list[tuple[int, np.ndarray]] = []

    def own(rows: np.ndarray) -> np.ndarray:
        return q_rows[rows][:, None] == c_rows[None, :]

    for share in (*DEPTHS, 1.0):
        read = max(1, int(np.ceil(share * n)))
        if share == 1.0 or n <= 4 * k:
            read = n
        top, bottom = _ends(candidates, read)
        seen_top, seen_bottom = candidates >= top, candidates <= bottom
        upper = up[open_] @ np.where(seen_top, candidates, top).T + down[open_] @ np.where(seen_bottom, candidates, bottom).T
        if read == n:
            lower = upper
        else:
            lower = up[open_] @ np.where(seen_top, candidates, worst_top).T + down[open_] @ np.where(seen_bottom, candidates, worst_bottom).T
        mine = own(open_)
        lower[mine] = -np.inf
        upper[mine] = -np.inf
        bar = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_), -np.inf)
        left = (upper >= bar[:, None]) & ~mine
        few = left.sum(axis=1) <= max(4 * k, n // 16)
        closed = np.ones(len(open_), bool) if read == n else few
        picked += [(int(open_[r]), np.flatnonzero(left[r])) for r in np.flatnonzero(closed)]
        open_ = open_[~closed]
        if not len(open_):
            break
    found = []
    for row, near in picked:  # resolve what can still qualify
        scores = candidates[near] @ queries[row]
        if len(near) > k:
            order = np.lexsort((c_ids[near], -scores))[:k]
            near, scores = near[order], scores[order]
        found.append((np.full(len(near), row), near, scores))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose vec_id is divisible by `every`, candidates all rows but the query's own."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = vectors.select("vec_id", "embedding").where(finite & F.col("vec_id").isNotNull()).select("vec_id", whole.alias("v"), F.size("embedding").alias("dim"))
    usable = materialize(usable.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = usable.where(F.col("vec_id") % every == 0)
    n_queries, n_candidates = asked.count(), usable.count()
    q_blocks, c_blocks = max(1, -(-n_queries // QUERY_ROWS)), max(1, -(-n_candidates // CANDIDATE_ROWS))

    def block(salt: str, n: int):
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")

    queries = asked.select("row", "vec_id", "v", "dim", block("q", q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))
    candidates = usable.select("row", "vec_id", "v", "dim", block("c", c_blocks).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})
        q_rows, c_rows, q_ids, c_ids = left["row"].to_numpy(), right["row"].to_numpy(), left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        q, c = (np.array(x["v"].tolist(), dtype=float).reshape(len(x), int(x["dim"].iloc[0])) for x in (left, right))
        step = max(1, (8 << 20) // max(1, 8 * len(c)))  # about 8 MB a bound matrix
        parts = [block_top(q_rows[a : a + step], q[a : a + step], c_rows, c_ids, c, k) for a in range(0, len(q), step)]
        asks = np.concatenate([a + p[0] for a, p in zip(range(0, len(q), step), parts, strict=True)])
        return pd.DataFrame({"query_row": q_rows[asks], "query_id": q_ids[asks], "vec_id": c_ids[np.concatenate([p[1] for p in parts])], "score": np.concatenate([p[2] for p in parts]).astype(np.int64)})

    met = queries.groupBy("dim", "qb", "cb").cogroup(candidates.groupBy("dim", "qb", "cb")).applyInPandas(meet, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
