"""Floor-to-ceiling normalisation with the direction guard, and the results table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.operators.metrics import CEILING, FULL, HALF, METRIC_DIRECTION, aggregate, bootstrap_ci, unpivot
from cellshift.session import materialize

# The predictor whose mean is each metric's floor.
FLOOR_BASELINE = {
    "pearson_r": "global_mean_delta",
    "pearson_r_de": "global_mean_delta",
    "mae": "no_change",
    "direction_acc_de": "global_mean_delta",
    "pert_discrimination": "no_change",
}

# The columns of the results table.
RESULTS_COLUMNS = [
    "split", "fold", "baseline", "metric", "representation", "target", "value", "std", "n_conditions", "n_test", "n_skipped",
    "ci_low", "ci_high", "normalized", "normalized_std", "normalization_valid", "floor_source", "floor_value", "ceiling_value",
    "fallback_rate", "fallback_rate_dose_collapsed",
]
SORT_KEYS = ["split", "fold", "baseline", "metric", "representation", "target"]
GROUP = ["fold", "baseline", "target", "representation", "metric"]


def lookup(column: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[column]


def normalized_score(value: Column, floor: Column, ceiling: Column) -> Column:
    """(value - floor) / (ceiling - floor); NULL when the two coincide."""
    return F.try_divide(value - floor, F.when(ceiling != floor, ceiling - floor))


def with_guard(rows: DataFrame) -> DataFrame:
    """Add normalized, normalized_std and normalization_valid to rows with value, std, metric, floor_value, ceiling_value.

    When the ceiling lies on the wrong side of the floor for the metric's direction nothing is
    normalised and the row is marked invalid. An undefined or equal floor and ceiling also give NULL,
    but count as valid.
    """
    range_ = F.col("ceiling_value") - F.col("floor_value")
    higher = lookup(F.col("metric"), METRIC_DIRECTION) == "higher_better"
    valid = F.coalesce((range_ == 0) | ((range_ > 0) == higher), F.lit(True))
    return (
        rows.withColumn("normalization_valid", valid)
        .withColumn("normalized", F.when(valid, normalized_score(F.col("value"), F.col("floor_value"), F.col("ceiling_value"))))
        .withColumn("normalized_std", F.when(valid, F.try_divide(F.col("std"), F.abs(F.when(range_ != 0, range_)))))
    )


def attach_floor_and_ceiling(stats: DataFrame) -> DataFrame:
    """stats(GROUP, value, ...) with floor_source, floor_value and ceiling_value per (fold, target, representation, metric).

    The ceiling is scored once and serves both targets, as its own row under each of them.
    """
    on = ["fold", "target", "representation", "metric"]
    ceiling = stats.where(F.col("baseline") == CEILING)
    both = stats.unionByName(ceiling.withColumn("target", F.lit(FULL)))
    floor = stats.withColumn("floor_source", lookup(F.col("metric"), FLOOR_BASELINE)).where("baseline = floor_source").select(
        *on, "floor_source", F.col("value").alias("floor_value")
    )
    top = ceiling.select("fold", "representation", "metric", F.col("value").alias("ceiling_value"))
    return both.join(floor, on, "left").join(top, ["fold", "representation", "metric"], "left")


def results_table(scores: DataFrame, folds: DataFrame, rates: DataFrame, seed: int, n_boot: int = 1000) -> DataFrame:
    """The long results table: one row per (fold, baseline, metric, representation, target).

    n_conditions counts every repetition of a condition under the replicate target, as do the
    intervals; ci_low and ci_high of such rows are therefore narrow (see clustered_ci). With n_boot 0 both are NULL.
    """
    values = unpivot(scores)
    stats = materialize(aggregate(values, GROUP).withColumnRenamed("mean", "value"), "stats")
    if n_boot:
        intervals = bootstrap_ci(values, GROUP, ["cond_id", "rep"], seed, n_boot)
    else:
        intervals = stats.select(*GROUP, *[F.lit(None).cast("double").alias(c) for c in ("ci_low", "ci_high")])
    sizes = folds.where("role = 'test'").groupBy(F.col("regime").alias("split"), "fold").agg(F.count("*").alias("n_test"))
    # the ceiling's row under the other target repeats its one interval
    scored_on = F.when(F.col("baseline") == CEILING, F.lit(HALF)).otherwise(F.col("target"))
    rows = with_guard(attach_floor_and_ceiling(stats)).withColumn("scored_on", scored_on)
    return (
        rows.join(intervals.withColumnRenamed("target", "scored_on"), ["fold", "baseline", "scored_on", "representation", "metric"], "left")
        .join(rates, ["fold", "baseline"], "left").join(sizes, "fold")
        .withColumn("n_conditions", F.col("n")).withColumn("floor_source", lookup(F.col("metric"), FLOOR_BASELINE))
        .select(*RESULTS_COLUMNS)
    )


def clustered_ci(scores: DataFrame, seed: int, n_boot: int = 1000) -> DataFrame:
    """Bootstrap interval over conditions: a condition's repetitions are averaged before resampling."""
    per_condition = unpivot(scores).groupBy(*GROUP, "cond_id").agg(F.avg("v").alias("v"))
    return bootstrap_ci(per_condition, GROUP, ["cond_id"], seed, n_boot)


def guard_census(results: DataFrame) -> DataFrame:
    """One row: distinct (split, fold, metric, representation, target) in all, and where the guard fired."""
    combo = F.struct("split", "fold", "metric", "representation", "target")
    return results.agg(
        F.count_distinct(combo).alias("n_total"),
        F.count_distinct(F.when(~F.col("normalization_valid"), combo)).alias("n_fired"),
    )


