"""Pooling of fold-level results and the comparisons the report draws from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.operators.metrics import CEILING, FULL, HALF, METRIC_DIRECTION
from cellshift.operators.normalize import lookup

Z95 = 1.96


def pool(rows: DataFrame, keys: list[str], value: str = "value", std: str = "std") -> DataFrame:
    """(keys, mean, std, n): fold rows pooled by their number of conditions.

    The variance has a within- and a between-fold part. A fold with one condition has no deviation
    of its own and takes the weighted mean deviation of the others (0 when there is none). Undefined
    rows are left out; keys without any usable row are absent.
    """
    usable = rows.where(F.col(value).isNotNull() & (F.col("n_conditions") > 0)).select(
        *keys, F.col("n_conditions").cast("double").alias("n"), F.col(value).alias("v"), F.col(std).alias("s")
    )
    known = (F.col("n") > 1) & F.col("s").isNotNull()
    weighted = F.sum(F.when(known, F.col("n") * F.col("s")))
    totals = usable.groupBy(*keys).agg(
        F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean"),
        F.coalesce(F.try_divide(weighted, F.sum(F.when(known, F.col("n")))), F.lit(0.0)).alias("imputed"),
    )
    s = F.when(known, F.col("s")).otherwise(F.col("imputed"))
    spread = F.col("n") * (s * s + (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean")))
    return usable.join(totals, keys).groupBy(*keys).agg(
        F.first("mean").alias("mean"),
        F.sqrt(F.greatest(F.sum(spread) / F.first("total"), F.lit(0.0))).alias("std"),
        F.first("total").cast("long").alias("n"),
    )


def pool_normalized(results: DataFrame, keys: list[str]) -> DataFrame:
    """pool() of the normalized scores; rows where the guard fired are left out."""
    return pool(results.where("normalization_valid"), keys, "normalized", "normalized_std")


def pooled_results(results: DataFrame) -> DataFrame:
    """Raw and normalised pools per (split, baseline, metric, representation, target), each with its own n."""
    keys = ["split", "baseline", "metric", "representation", "target"]
    raw = pool(results, keys)
    norm = pool_normalized(results, keys).select(
        *keys, F.col("mean").alias("normalized_mean"), F.col("std").alias("normalized_std"), F.col("n").alias("normalized_n")
    )
    fired = results.groupBy(*keys).agg(F.count_if(~F.col("normalization_valid")).alias("n_guard_fired"))
    return fired.join(raw, keys, "left").join(norm, keys, "left")


def with_normal_ci(pooled: DataFrame) -> DataFrame:
    """Normal-approximation 95% interval of a pooled mean."""
    half = F.lit(Z95) * F.col("std") / F.sqrt(F.col("n").cast("double"))
    return pooled.withColumn("lo", F.col("mean") - half).withColumn("hi", F.col("mean") + half)


def intervals_apart(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """True when the intervals do not touch; False when they do or one is undefined."""
    return F.coalesce((hi < other_lo) | (lo > other_hi), F.lit(False))


def compare_baselines(results: DataFrame, first: str, second: str, split: str | None = "held_out_context") -> DataFrame:
    """Per metric: pooled scores of two baselines on the folds both ran in, their gap and the winner.

    A winner needs disjoint intervals; the direction of the metric then decides.
    """
    rows = results.where((F.col("representation") == "delta") & (F.col("target") == HALF))
    if split:
        rows = rows.where(F.col("split") == split)
    shared = rows.where(F.col("baseline") == second).select("fold", "metric").distinct()
    rows = rows.join(shared, ["fold", "metric"], "left_semi").where(F.col("baseline").isin(first, second))
    pooled = with_normal_ci(pool(rows, ["metric", "baseline"]))

    def side(name: str, tag: str) -> DataFrame:
        return pooled.where(F.col("baseline") == name).select(
            "metric", *[F.col(c).alias(f"{tag}_{c}") for c in ("mean", "std", "n", "lo", "hi")]
        )

    metrics = rows.select("metric").distinct()
    joined = metrics.join(side(first, "a"), "metric", "left").join(side(second, "b"), "metric", "left")
    apart = intervals_apart(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"))
    higher = lookup(F.col("metric"), METRIC_DIRECTION) == "higher_better"
    winner = (
        F.when(F.col("a_mean").isNull() | F.col("b_mean").isNull(), "n/a (NaN)")
        .when(~apart, "no significant difference")
        .when((F.col("b_mean") > F.col("a_mean")) == higher, second)
        .otherwise(first)
    )
    return joined.select(
        "metric", "a_mean", "a_std", "a_n", "b_mean", "b_std", "b_n",
        (F.col("b_mean") - F.col("a_mean")).alias("gap"), (~apart).alias("overlap"), winner.alias("winner"),
    )


def beats_floor(results: DataFrame) -> DataFrame:
    """Baselines better than no_change on a delta metric with disjoint intervals, compared on shared folds."""
    rows = results.where((F.col("representation") == "delta") & (F.col("target") == HALF))
    none = rows.where("baseline = 'no_change'")
    others = rows.where(~F.col("baseline").isin("no_change", CEILING))
    pairs = none.join(others.select("fold", "metric", F.col("baseline").alias("other")), ["fold", "metric"])
    a = with_normal_ci(pool(pairs, ["metric", "other"])).select(
        "metric", "other", F.col("mean").alias("floor_mean"), F.col("lo").alias("floor_lo"), F.col("hi").alias("floor_hi")
    )
    b = with_normal_ci(pool(others, ["metric", "baseline"]))
    norm = pool_normalized(others, ["metric", "baseline"]).select(
        "metric", "baseline", F.col("mean").alias("normalized_mean"), F.col("std").alias("normalized_std")
    )
    higher = lookup(F.col("metric"), METRIC_DIRECTION) == "higher_better"
    better = F.when(higher, F.col("mean") > F.col("floor_mean")).otherwise(F.col("mean") < F.col("floor_mean"))
    return (
        b.join(a, (b.metric == a.metric) & (b.baseline == a.other)).drop(a.metric)
        .where(better & intervals_apart(F.col("lo"), F.col("hi"), F.col("floor_lo"), F.col("floor_hi")))
        .select("baseline", "metric", "mean", "floor_mean").join(norm, ["metric", "baseline"], "left")
    )


def best_by_split(results: DataFrame) -> DataFrame:
    """(metric, split, best): highest pooled normalised score of any baseline on the primary target."""
    rows = results.where((F.col("representation") == "delta") & (F.col("target") == HALF) & (F.col("baseline") != CEILING))
    return pool_normalized(rows, ["metric", "split", "baseline"]).groupBy("metric", "split").agg(F.max("mean").alias("best"))


def fallback_table(results: DataFrame, column: str = "fallback_rate") -> DataFrame:
    """Mean fallback rate, baselines by splits."""
    once = results.where(F.col("baseline") != CEILING).select("split", "fold", "baseline", column).distinct()
    return once.groupBy("baseline").pivot("split", ["random", "held_out_context", "held_out_drug", "held_out_both"]).agg(F.avg(column))


def de_skip(results: DataFrame) -> DataFrame:
    """One row: how many test exposures have too few differential genes for the *_de metrics."""
    rows = results.where(
        (F.col("baseline") == "global_mean_delta") & (F.col("metric") == "pearson_r_de")
        & (F.col("representation") == "delta") & (F.col("target") == FULL)
    )
    return rows.agg(F.sum("n_skipped").alias("n_skipped"), F.sum("n_test").alias("n_test")).withColumn(
        "skip_fraction", F.try_divide(F.col("n_skipped").cast("double"), F.col("n_test"))
    )


def mae_pairs(results: DataFrame) -> DataFrame:
    """(fold, ceiling, floor, denominator) of mae on the primary target."""
    m = results.where((F.col("metric") == "mae") & (F.col("representation") == "delta") & (F.col("target") == HALF))
    side = lambda b, n: m.where(F.col("baseline") == b).select("fold", F.col("value").alias(n))
    return side(CEILING, "ceiling").join(side("no_change", "floor"), "fold").withColumn("denominator", F.col("ceiling") - F.col("floor"))


def mae_instability(results: DataFrame) -> DataFrame:
    """One row: how small the mae range between floor and ceiling is, and how often it has the wrong sign."""
    pairs = mae_pairs(results)
    either = pairs.select(F.explode(F.array(F.abs("ceiling"), F.abs("floor"))).alias("v"))
    typical = either.agg(F.percentile("v", F.lit(0.5)).alias("typical")).scalar()
    return pairs.agg(
        F.percentile(F.abs("denominator"), F.lit(0.5)).alias("median_denominator"),
        F.count_if(F.col("denominator") > 0).alias("n_wrong_sign"), F.count("*").alias("n_folds"),
    ).withColumn("typical", typical).withColumn("ratio", F.try_divide(F.col("typical"), F.col("median_denominator")))


def inflation(results: DataFrame) -> DataFrame:
    """no_change's pooled pearson_r per split and representation: undefined on delta, high on absolute."""
    rows = results.where((F.col("baseline") == "no_change") & (F.col("metric") == "pearson_r") & (F.col("target") == HALF))
    keys = ["split", "representation"]
    return rows.select(*keys).distinct().join(pool(rows, keys), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
