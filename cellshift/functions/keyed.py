"""Keyed pseudo-random order: reproducible shuffles without a random generator.

Rows are ordered by an md5 digest of (seed, purpose, keys). Because the digests are uniform, a rank
inside a group can be taken bucket by bucket: digests sharing a prefix form a bucket, bucket sizes
give each bucket's offset, and only rows within one bucket are sorted together. A group that holds
a third of all rows is spread over all its buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 128
MAX_DIGITS = 3  # at most 4096 buckets per group
DEVIATIONS = 8.0  # of a uniform digest's rank; a cutoff is sought so far from where it is expected


def digest(seed: int, purpose: str, *keys) -> Column:
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *parts))


def prefix_length(largest_group: int) -> int:
    """Hex digits needed so that a bucket of the largest group holds about ROWS_PER_BUCKET rows."""
    if largest_group <= ROWS_PER_BUCKET:
        return 0
    return min(MAX_DIGITS, math.ceil(math.log(largest_group / ROWS_PER_BUCKET, 16)))


def bucket_offsets(df: DataFrame, group: list[str], key: str, digits: int, *extra: Column) -> DataFrame:
    """Rows per digest bucket with `_before`, the number of group rows in earlier buckets."""
    counts = df.groupBy(*group, F.substring(key, 1, digits).alias("_bucket")).agg(F.count("*").alias("_in_bucket"), *extra)
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_in_bucket").over(earlier), F.lit(0)))


def keyed_rank(df: DataFrame, group: list[str], key: str, digits: int, out: str = "rank") -> DataFrame:
    """1-based rank of the digest column `key` within its group."""
    bucketed = df.withColumn("_bucket", F.substring(key, 1, digits))
    within = Window.partitionBy(*group, "_bucket").orderBy(key)
    offsets = bucket_offsets(df, group, key, digits).select(*group, "_bucket", "_before")
    return (
        bucketed.withColumn("_within", F.row_number().over(within))
        .join(offsets, [*group, "_bucket"])
        .withColumn(out, (F.col("_before") + F.col("_within")).cast("long"))
        .drop("_bucket", "_before", "_within")
    )


def keyed_cutoff(df: DataFrame, group: list[str], key: str, take: str, digits: int, out: str = "cutoff") -> DataFrame:
    """Per group, the digest of the row ranked `take`: rows at or below it are the first `take` rows.

    `take` is a column constant within the group. Only the one bucket that holds the wanted rank is
    sorted; every other row is merely counted.
    """
    hit = (
        bucket_offsets(df, group, key, digits, F.max(take).alias("_take"))
        .where((F.col("_before") < F.col("_take")) & (F.col("_take") <= F.col("_before") + F.col("_in_bucket")))
        .select(*group, "_bucket", (F.col("_take") - F.col("_before")).alias("_want"))
    )
    within = Window.partitionBy(*group, "_bucket").orderBy(key)
    return (
        df.withColumn("_bucket", F.substring(key, 1, digits))
        .join(hit, [*group, "_bucket"])
        .withColumn("_rn", F.row_number().over(within))
        .where(F.col("_rn") == F.col("_want"))
        .select(*group, F.col(key).alias(out))
    )


def central_cutoff(
    df: DataFrame, groups: DataFrame, group: list[str], key: str, digits: int, keep: Callable[[DataFrame, str], DataFrame], out: str = "cutoff"
) -> DataFrame:
    """`keyed_cutoff` for groups (group, take, size) whose number of rows is known: one scan of df (group, key), few rows moved.

    A uniform digest of rank k among n lies near k / n. Digests below the range of DEVIATIONS standard deviations around
    it are one count per group, combined before the shuffle; those inside (about the square root of n) are moved, those above
    dropped. Groups whose cutoff lies elsewhere, as that of many equal keys may, are looked for bucket by bucket. `keep` stores a table.
    """
    n, k = F.col("size").cast("double"), F.col("take").cast("double")
    spread = F.sqrt(k * F.greatest(n - k, F.lit(1.0)) / n) * DEVIATIONS + DEVIATIONS

    def edge(rank: Column) -> Column:
        """The digest expected at a rank, its first 12 digits."""
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), rank / n))
        return F.lpad(F.lower(F.hex((share * F.lit(float(16**12 - 1))).cast("long"))), 12, "0")

    edges = groups.withColumn("_low", edge(k - spread)).withColumn("_high", F.concat(edge(k + spread), F.lit("~")))
    near = df.join(edges.select(*group, "_low", "_high"), group).where(F.col(key) < F.col("_high"))
    counted = near.select(*group, F.when(F.col(key) >= F.col("_low"), F.col(key)).alias(out)).groupBy(*group, out).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*group).orderBy(F.col(out).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("_upto", F.sum("_n").over(upto)).join(groups.select(*group, "take"), group)
    found = keep(ranked.where((F.col("_upto") >= F.col("take")) & (F.col("_upto") - F.col("_n") < F.col("take")) & F.col(out).isNotNull()).select(*group, out), "cutoffs")
    missed = groups.join(found, group, "left_anti")
    if missed.isEmpty():
        return found
    return found.unionByName(keyed_cutoff(df.join(missed.select(*group, "take"), group), group, key, "take", digits, out))
