"""Differential expression: per-plate Mann-Whitney tests, Stouffer combination, Benjamini-Hochberg.

Ranks are taken from value histograms, not from cells. One scan counts how often each expression
value occurs per (condition or control, batch, gene). Cumulating the control counts over the values
of a (line, batch, gene) once serves every condition of that batch: for a treated value v the rank
sum needs only the control cells below v and equal to v. Controls are never repeated per condition.
The cumulation runs inside narrow value buckets plus an offset per bucket, so that a batch with very
many cells is spread over many tasks. The histogram is exchanged once, by bucket, and reduced there to one
row per (condition or controls, bucket): offsets and totals are sums of those, so it is never stored or read again.

Zero entries are absent from the sparse data. They form one tie block below all other values, added
in closed form; values must be non-negative. Tests use the normal approximation with tie and continuity
correction, but for batches with at most EXACT_CELLS cells on one side in which no gene of the axis has
a tie (two zeros are one): those have the exact null distribution of U. Sparse data hardly have such
batches, dense profiles do.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellshift.operators.pseudobulk import Matching

Z_MAX = -NormalDist().inv_cdf(5e-301)  # two-sided p values are clipped at 1e-300
BUCKETS_PER_UNIT = 16  # value range of one cumulation bucket is 1/16 in log space
EXACT_CELLS = 8  # a side of at most so many cells, without ties, is tested exactly

_AT = ["plate_id", "gene_idx"]


def value_histogram(placed: DataFrame) -> DataFrame:
    """(plate_id, gene_idx, bucket, pair_id, value, n): cells per expression value; pair_id is NULL for controls.

    `placed` is the expression of placed cells. Values seldom repeat, so they are exchanged once, by bucket, and
    counted there; a bucket holds at most one entry of each cell of its plate.
    """
    bucketed = _bucketed(placed).repartition(*_AT, "bucket")
    return bucketed.groupBy(*_AT, "bucket", "pair_id", "value").agg(F.count("*").alias("n"))


def _bucketed(values: DataFrame) -> DataFrame:
    return values.withColumn("bucket", F.floor(F.col("value") * BUCKETS_PER_UNIT))


def _cubes(n):
    return n.cast("double") * n * n - n


@lru_cache(maxsize=32)
def exact_p(small: int, large: int) -> np.ndarray:
    """Two-sided p values of U without ties, by the smaller of U and its mirror image: entry k is twice P(U <= k), 1 at most.

    The numbers of arrangements are the coefficients of a Gaussian binomial, taken one treated cell at a time as whole
    numbers; those beyond small * large / 2 mirror the ones before.
    """
    half = small * large // 2
    total = math.comb(small + large, small)
    ways = np.zeros(half + 1, dtype=np.int64 if total < 1 << 62 else object)
    ways[0] = 1
    for i in range(1, small + 1):
        if large + i <= half:
            ways[large + i :] = ways[large + i :] - ways[: half + 1 - large - i]
        for r in range(min(i, half + 1)):
            ways[r::i] = np.cumsum(ways[r::i])
    return np.minimum(np.array([2 * w / total for w in np.cumsum(ways).tolist()]), 1.0)


def _exact(tested: DataFrame) -> DataFrame:
    """tested with p and the size of z from the exact null; row-local, a worker keeps the distributions it has met."""

    @F.pandas_udf("p double, size double")
    def tails(n_treated: pd.Series, n_control: pd.Series, u: pd.Series) -> pd.DataFrame:
        normal = NormalDist()
        p = [
            float(exact_p(int(min(n1, n2)), int(max(n1, n2)))[int(min(x, n1 * n2 - x))])
            for n1, n2, x in zip(n_treated, n_control, u, strict=True)
        ]
        return pd.DataFrame({"p": p, "size": [0.0 if x >= 1 else -normal.inv_cdf(x / 2) for x in p]})

    return tested.withColumn("tail", tails("n_treated", "n_control", "u")).withColumn("p", F.col("tail.p")).withColumn("size", F.col("tail.size")).drop("tail")


def bucket_sums(hist: DataFrame) -> DataFrame:
    """(plate_id, gene_idx, bucket, pair_id, n, wins, cubes, total): what a bucket of values adds to the tests.

    Rows of controls (pair_id NULL) hold their cells, tie cubes and sum of values; rows of a pair its cells, wins over
    controls of the same bucket, the tie cubes it adds to those of the controls, and its sum of values.
    """
    is_control = F.col("pair_id").isNull()
    rows = (hist if "bucket" in hist.columns else _bucketed(hist)).withColumn("c", F.when(is_control, F.col("n")).otherwise(F.lit(0)))
    # control cells up to and at each value inside its bucket; both windows share one sort
    upto = Window.partitionBy(*_AT, "bucket").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at_value = Window.partitionBy(*_AT, "bucket", "value")
    ranked = rows.withColumn("c_upto", F.sum("c").over(upto)).withColumn("c_at", F.sum("c").over(at_value))
    n, c = F.col("n"), F.col("c_at")
    return ranked.groupBy(*_AT, "bucket", "pair_id").agg(
        F.sum(n).alias("n"),
        F.sum(n * (F.col("c_upto") - c / 2)).alias("wins"),
        F.sum(F.when(is_control, _cubes(n)).otherwise(_cubes(n + c) - _cubes(c))).alias("cubes"),
        F.sum(n * F.col("value")).alias("total"),
    )


def plate_z(buckets: DataFrame, matching: Matching, n_genes: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Signed z of the two-sided Mann-Whitney test per usable (condition, batch, gene), from stored `bucket_sums`.

    Columns: cond_id, eff_batch, gene_idx, n_treated, n_control, u, z, p; p is the exact p value and NULL where the
    normal approximation is used. Batches with fewer than two cells on either side are left out. Genes absent
    from both sides are absent here (their z is 0). n_genes is the length of the gene axis. `keep` stores a table.
    """
    lower = Window.partitionBy(*_AT).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # buckets that hold treated cells alone take part, so that their offset is known too
    sizes = buckets.groupBy(*_AT, "bucket").agg(F.sum(F.when(F.col("pair_id").isNull(), F.col("n")).otherwise(0)).alias("size"))
    before = sizes.select(*_AT, "bucket", F.coalesce(F.sum("size").over(lower), F.lit(0)).alias("before"))
    treated = buckets.where("pair_id IS NOT NULL").join(before, [*_AT, "bucket"]).groupBy("pair_id", "gene_idx").agg(
        F.sum("n").alias("t_nonzero"),
        F.sum(F.col("n") * F.col("before") + F.col("wins")).alias("wins"),
        F.sum("cubes").alias("added_cubes"),
        F.sum("total").alias("t_sum"),
    )
    own = [F.sum(F.when(F.col("pair_id").isNull(), F.col(x)).otherwise(0)).alias(f"c_{y}") for x, y in (("n", "nonzero"), ("cubes", "cubes"), ("total", "sum"))]
    totals = buckets.groupBy(*_AT).agg(*own)
    tested = matching.pairs.where("n_treated >= 2 AND n_control >= 2").select(
        "pair_id", "plate_id", "cond_id", "eff_batch", "n_treated", "n_control"
    )
    zero = F.lit(0.0)
    n1, n2 = F.col("n_treated"), F.col("n_control")
    z1, z2 = n1 - F.col("t_nonzero"), n2 - F.col("c_nonzero")
    joined = (
        tested.join(totals, "plate_id")
        .join(treated, ["pair_id", "gene_idx"], "left")
        .na.fill(0, ["t_nonzero"]).na.fill(0.0, ["wins", "added_cubes", "t_sum"])
        .withColumn("u", F.col("wins") + F.col("t_nonzero") * z2 + z1 * z2 * 0.5)
        .withColumn("ties", F.col("c_cubes") + F.col("added_cubes") + _cubes(z1 + z2))
        .withColumn("direction", F.when(F.col("t_sum") / n1 < F.col("c_sum") / n2, -1.0).otherwise(1.0))
    )
    # few batches are that small, and only their rows are looked at for this
    untied = joined.where((F.least(n1, n2) <= EXACT_CELLS) & (F.col("ties") == 0)).groupBy("pair_id").count()
    untied = keep(untied.where(F.col("count") == n_genes).select("pair_id"), "untied")
    total = n1 + n2
    variance = n1.cast("double") * n2 / 12 * ((total + 1) - F.col("ties") / (total.cast("double") * (total - 1)))
    # |u - mean| < 0.5 gives p = 1 and z = 0, as does a sample that is all ties
    size = F.coalesce(F.try_divide(F.abs(F.col("u") - n1.cast("double") * n2 / 2) - 0.5, F.sqrt("variance")), zero)
    approximate = (
        joined.join(untied, "pair_id", "left_anti").withColumn("variance", F.greatest(variance, zero))
        .withColumn("size", F.when(F.col("variance") > 0, size).otherwise(zero)).withColumn("p", F.lit(None).cast("double"))
    )
    out = ["cond_id", "eff_batch", "gene_idx", "n_treated", "n_control", "u"]
    signed = F.least(F.greatest(F.col("size"), zero), F.lit(Z_MAX)) * F.col("direction")
    both = [rows.select(*out, signed.alias("z"), "p") for rows in (approximate, _exact(joined.join(untied, "pair_id", "left_semi")))]
    return both[0].unionByName(both[1])


def stouffer(plates: DataFrame, matching: Matching) -> DataFrame:
    """Combined z per (cond_id, gene_idx): sum(w z) / sqrt(sum(w^2)) with w = sqrt(n_treated).

    The denominator runs over all tested batches of the condition, including those where the gene
    is absent (z = 0).
    """
    weight = matching.pairs.where("n_treated >= 2 AND n_control >= 2").groupBy("cond_id").agg(
        F.sqrt(F.sum("n_treated").cast("double")).alias("scale")
    )
    return (
        plates.groupBy("cond_id", "gene_idx")
        .agg(F.sum(F.sqrt(F.col("n_treated").cast("double")) * F.col("z")).alias("wz"))
        .join(weight, "cond_id")
        .select("cond_id", "gene_idx", (F.col("wz") / F.col("scale")).alias("z"))
    )


def bh_cutoffs(spark: SparkSession, n_genes: int, alpha: float) -> DataFrame:
    """(k, z_cut): the k-th smallest of n_genes p values is at most alpha*k/n_genes iff |z| >= z_cut.

    Testing |z| against normal quantiles avoids computing p values per row; the table is as long as
    the gene axis.
    """
    normal = NormalDist()
    rows = [(k, -normal.inv_cdf(alpha * k / n_genes / 2)) for k in range(1, n_genes + 1)]
    return spark.createDataFrame(rows, "k int, z_cut double")


def de_genes(combined: DataFrame, n_genes: int, alpha: float) -> DataFrame:
    """(cond_id, gene_idx) pairs rejected by Benjamini-Hochberg over all n_genes of the condition.

    Genes absent from `combined` have p = 1 and sort last, so their rows are not needed.
    """
    cut = bh_cutoffs(combined.sparkSession, n_genes, alpha)
    by_p = Window.partitionBy("cond_id").orderBy(F.abs("z").desc(), "gene_idx")  # at most n_genes rows
    ranked = combined.withColumn("k", F.row_number().over(by_p)).join(cut, "k")
    last = F.max(F.when(F.abs("z") >= F.col("z_cut"), F.col("k"))).over(Window.partitionBy("cond_id"))
    return ranked.withColumn("last", last).where("k <= last").select("cond_id", "gene_idx", "z")


def de_sets(rejected: DataFrame, obs: DataFrame) -> DataFrame:
    """One row per condition: the sorted gene positions found differential (possibly none)."""
    sets = rejected.groupBy("cond_id").agg(F.sort_array(F.collect_list("gene_idx")).alias("de"))
    return obs.select("cond_id").join(sets, "cond_id", "left").withColumn("de", F.coalesce("de", F.array().cast("array<int>")))
