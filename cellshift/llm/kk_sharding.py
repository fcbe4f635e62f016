"""Operator 6: shards of near-equal bytes by Karmarkar-Karp differencing; equal texts stay together.

Groups are the distinct texts; a group weighs its documents' bytes and never leaves its shard. In
differencing, a partial partition is a vector of part sums; the two of largest spread are combined, the
largest part of one with the smallest of the other, until one is left. Here this runs as a tree: tasks
difference up to FAN_IN groups each, the partial partitions that they leave are differenced FAN_IN at a
time in the next level, and so on, so that no task and no driver ever holds all groups. Only the part
numbers travel back down.

Defined cases: size is the text's UTF-8 bytes plus 1 (null: 1); null texts are one group, empty texts
another; documents of one text share its shard even if doc_ids repeat; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.llm.common import gapless_rank, materialize

FAN_IN = 4096  # partial partitions that one task combines


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions: sums is (n, k). Returns the (n, k) part that each
    partition's part number ends in, and the k final sums. Equal spreads go by row order."""
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    tree: list[tuple] = [(i, order[i]) for i in range(n)]  # what rank r of a node stands for
    heap = []
    for i in range(n):
        ranked = sums[i, order[i]]
        heap.append((-(int(ranked[0]) - int(ranked[-1])), i, ranked))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        merged = left + right[::-1]
        by_sum = np.argsort(-merged, kind="stable")
        ranked = merged[by_sum]
        tree.append((a, b, by_sum))
        heapq.heappush(heap, (-(int(ranked[0]) - int(ranked[-1])), len(tree) - 1, ranked))
    parts = np.empty((n, k), dtype=np.int32)
    final = heap[0][2] if heap else np.zeros(k, dtype=np.int64)
    stack = [(len(tree) - 1, np.arange(k))] if n else []  # a node and the part of each of its ranks
    while stack:
        node, part = stack.pop()
        if len(tree[node]) == 2:
            parts[node, tree[node][1]] = part
        else:
            a, b, by_sum = tree[node]
            position = np.empty(k, dtype=np.int64)
            position[by_sum] = part
            stack.append((a, position))
            stack.append((b, position[::-1]))
    return parts, final


def _level(nodes: DataFrame, shards: int, fan_in: int, parents: int) -> DataFrame:
    """nodes (node, sums): (node, parent, parts, sums of the parent on its first row)."""

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        parts, final = difference(np.array(rows["sums"].tolist(), dtype=np.int64).reshape(len(rows), shards))
        return pd.DataFrame({"node": rows["node"], "parent": rows["parent"], "parts": list(parts), "sums": [final if i == 0 else None for i in range(len(rows))]})

    dealt = nodes.withColumn("parent", F.pmod(F.xxhash64("node"), F.lit(parents)))
    return materialize(dealt.groupBy("parent").applyInPandas(combine, "node long, parent long, parts array<int>, sums array<long>"), "kk-level")


def shard(docs: DataFrame, shards: int = 16, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot is the place inside the shard, gapless from 0."""
    text = F.coalesce("text", F.lit(""))
    sized = materialize(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(F.col("text"), 256), F.lit("null")).alias("same"),
    ), "kk-sized")
    weights = sized.groupBy("same").agg(F.sum("size").alias("weight"))
    n_groups = weights.count()
    tasks = max(1, -(-n_groups // (fan_in // 2)))  # hashed, so aim at half of what a task may take
    leaves = weights.withColumn("leaf", F.pmod(F.xxhash64("same"), F.lit(tasks)))

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["weight", "same"], ascending=[False, True])
        sums = np.zeros((len(rows), shards), dtype=np.int64)
        sums[:, 0] = rows["weight"]
        parts, final = difference(sums)
        return pd.DataFrame({"same": rows["same"], "leaf": rows["leaf"], "part": parts[:, 0], "sums": [final if i == 0 else None for i in range(len(rows))]})

    placed = materialize(leaves.groupBy("leaf").applyInPandas(split, "same string, leaf long, part int, sums array<long>"), "kk-leaves")
    nodes, levels = placed.where("sums is not null").select(F.col("leaf").alias("node"), "sums"), []
    count = tasks
    while count > 1:
        parents = 1 if count <= fan_in else -(-count // (fan_in // 2))
        levels.append(level := _level(nodes, shards, fan_in, parents))
        nodes, count = level.where("sums is not null").select(F.col("parent").alias("node"), "sums"), parents
    if levels:  # compose the part numbers from the top down
        down = levels[-1].select("node", F.col("parts").alias("final"))
        for level in reversed(levels[:-1]):
            up = down.select(F.col("node").alias("above"), F.col("final").alias("onto"))
            down = level.join(up, F.col("parent") == F.col("above")).select("node", F.transform("parts", lambda p: F.get("onto", p)).alias("final"))
        placed = placed.join(down, F.col("leaf") == F.col("node")).select("same", F.get("final", F.col("part")).alias("shard"))
    else:
        placed = placed.select("same", F.col("part").alias("shard"))
    joined = materialize(sized.join(placed, "same").select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard")), "kk-placed")
    return gapless_rank(joined, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
