"""Operator 12: a Merkle manifest as a rollup of nested structs.

Leaves are ranked by doc_id within their group. The octal digits of a rank are the way to the root: grouping by all
but the lowest digit collects a run of eight into one struct, grouping by all but the two lowest collects eight of
those, and so on, children nested inside. Blocks of 8 ** LEVELS leaves are rolled up so, with the block as the
distribution of the one shuffle that all levels share; a block's root is a leaf of the next rollup, and so until each group has
one node, then over the groups' roots. One transform over a block's nested structs and one explode give every leaf
with the siblings on its way; no leaf is joined to anything. Only blocks, one row per 4,096 leaves, are joined
to what lies above them.

Ranks come from range partitions: their rows are numbered inside and shifted by the counts of the partitions before,
so no group, however large, is sorted in one task.

Defined cases: a null doc_id sorts first and is never tampered with; rows of one doc_id are ordered by their leaf; repeated rows are
leaves of their own; null and empty values differ (`-` against `0:`); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellshift.llm.common import materialize

ARITY_BITS, LEVELS = 3, 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, grp, leaf, changed): leaf is the row's digest, changed that of the row with A-Z lower-cased in its
    text, where crc32 of the doc_id is divisible by 3; else null."""
    head = [encoded(F.col(c)) for c in FIELDS[:-1]]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", _UPPER, _UPPER.lower())
    return docs.select("doc_id", F.col("lang").alias("grp"), digest(*head, encoded(F.col("text"))).alias("leaf"), F.when(tampered, digest(*head, encoded(lower))).alias("changed"))


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds `rank` from 0 and `n`, the number of rows, inside groups; nulls first. Equal rows are told apart by a row number, so that they can be dealt to several partitions."""
    split = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*group, *order, "__row"]])
    split = materialize(split.withColumn("__part", F.spark_partition_id()), name)
    inside = F.row_number().over(Window.partitionBy("__part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in [*order, "__row"]])) - 1
    counts = split.groupBy("__part", *group).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # a row per partition and group at most
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__{c}") for c in group], before.alias("__shift"), F.sum("__n").over(whole).alias("n"))
    same = F.col("__part") == F.col("__p")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    numbered = split.withColumn("__at", inside).join(shifts, same)
    return numbered.withColumn("rank", F.col("__at") + F.col("__shift")).drop("__row", "__part", "__p", "__at", "__shift", *[f"__{c}" for c in group])


def _text(run: Column, low: Column, count: Column) -> Column:
    return F.array_join(F.transform(F.slice(run, low, count), lambda k: k["node"]), "")


def _steps(run: Column, i: Column, hashed: Column) -> Column:
    """The way up from child i of a run: what stands before and behind it; no step where the run's only child goes on as it is."""
    step = F.struct(_text(run, F.lit(1), i).alias("before"), _text(run, i + 2, F.greatest(F.size(run) - i - 1, F.lit(0))).alias("behind"))
    return F.when(hashed, F.array(step)).otherwise(F.array().cast("array<struct<before:string,behind:string>>"))


def blocks(nodes: DataFrame) -> DataFrame:
    """nodes (grp, rank, n, node, own): (grp, rank, n, node, kids), a row per block of 8 ** LEVELS nodes and the number and size of the blocks' own level; kids nests
    LEVELS structs (d, node, kids), own innermost. A level is hashed while its group has several nodes."""
    block = F.shiftright("rank", ARITY_BITS * LEVELS)
    digits = [F.shiftright("rank", ARITY_BITS * k).bitwiseAND(F.lit(7)).cast("int").alias(f"d{k}") for k in range(LEVELS)]
    rows = nodes.select("grp", block.alias("block"), "n", *digits, "node", F.col("own").alias("kids")).repartition("grp", "block")
    for k in range(LEVELS):
        child = F.struct(F.col(f"d{k}").alias("d"), "node", "kids")
        run = rows.groupBy("grp", "block", "n", *[f"d{j}" for j in range(LEVELS - 1, k, -1)]).agg(F.sort_array(F.collect_list(child)).alias("kids"))
        hashed = F.sha2(F.array_join(F.transform("kids", lambda c: c["node"]), ""), 256)
        several = F.col("n") > 1 << ARITY_BITS * k  # nodes of this level
        rows = run.withColumn("node", F.when(several, hashed).otherwise(F.get("kids", F.lit(0))["node"]))
    size = F.shiftright(F.col("n") + ((1 << ARITY_BITS * LEVELS) - 1), ARITY_BITS * LEVELS)
    return rows.select("grp", F.col("block").alias("rank"), size.alias("n"), "node", "kids", F.col("n").alias("below"))


def ways(kids: Column, below: Column) -> Column:
    """array<struct<own, way>> of all leaves of a block; way lists the steps from the leaf to the block's root."""

    def down(run: Column, level: int, above: Column) -> Column:
        hashed = below > 1 << ARITY_BITS * level

        def one(child: Column, i: Column) -> Column:
            way = F.concat(_steps(run, i, hashed), above)
            return F.array(F.struct(child["kids"].alias("own"), way.alias("way"))) if level == 0 else down(child["kids"], level - 1, way)

        return F.flatten(F.transform(run, one))

    return down(kids, LEVELS - 1, F.array().cast("array<struct<before:string,behind:string>>"))


def tree(nodes: DataFrame, name: str) -> DataFrame:
    """nodes (grp, rank, n, node, own), ranks gapless from 0: (grp, kids, below, rest, root), a row per block; rest is
    the way from the block's root to root, its group's."""
    rolled = materialize(blocks(nodes), f"{name}-blocks")
    none = F.array().cast("array<struct<before:string,behind:string>>")
    if rolled.where("n > 1").isEmpty():
        return rolled.select("grp", "kids", "below", none.alias("rest"), F.col("node").alias("root"))
    above = leaves_of(tree(rolled.select("grp", "rank", "n", "node", F.col("rank").alias("own")), f"{name}-up"))
    above = materialize(above.select(F.col("grp").alias("g"), F.col("own").alias("r"), F.col("way").alias("rest"), "root"), f"{name}-above")
    return rolled.join(above, F.col("grp").eqNullSafe(F.col("g")) & (F.col("rank") == F.col("r"))).select("grp", "kids", "below", "rest", "root")


def leaves_of(held: DataFrame) -> DataFrame:
    """(grp, root, own, way) of every leaf of a tree's blocks."""
    each = held.select("grp", "root", "rest", F.explode(ways(F.col("kids"), F.col("below"))).alias("x"))
    return each.select("grp", "root", F.col("x.own").alias("own"), F.concat("x.way", "rest").alias("way"))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; its group is its lang."""
    rows = ranked(leaves(docs), ["grp"], ["doc_id", "leaf"], "manifest-leaves")
    own = F.struct("doc_id", "leaf", "changed").alias("own")
    lower = tree(rows.select("grp", "rank", "n", F.col("leaf").alias("node"), own), "manifest").withColumnRenamed("root", "subroot")
    tops = ranked(lower.select("grp", "subroot").distinct(), [], ["grp"], "manifest-groups")
    upper = tree(tops.select(F.lit("").alias("grp"), "rank", "n", F.col("subroot").alias("node"), F.struct(F.col("grp").alias("g")).alias("own")), "manifest-top")
    upper = materialize(leaves_of(upper).select(F.col("own.g").alias("g"), F.col("way").alias("more"), "root"), "manifest-roots")
    joined = lower.join(upper, F.col("grp").eqNullSafe(F.col("g")))
    whole = leaves_of(joined.select(F.struct("grp", "subroot").alias("grp"), "root", F.concat("rest", "more").alias("rest"), "kids", "below"))
    proof = F.sha2(F.array_join(F.transform("way", lambda s: F.concat(s["before"], s["behind"])), ""), 256)
    folded = F.aggregate("way", F.coalesce("own.changed", "own.leaf"), lambda at, s: digest(s["before"], at, s["behind"]))
    out = whole.select("own.doc_id", "own.leaf", "grp.subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
