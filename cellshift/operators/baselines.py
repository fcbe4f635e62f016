"""Reference predictors: no change, global mean, per-compound mean and nearest context.

A predictor maps (Fit) to predictions(fold, cond_id, pred, fallback, tier): one row per test condition
and an array over the fold's genes. More predictors can be added with `register_predictor`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.functions import arrays
from cellshift.operators.hvg import gene_lists, train_means
from cellshift.operators.ridge import ridge_predictions


@dataclass
class Fit:
    """What predictors see: condition profiles, fold rows and each fold's selected genes."""

    profiles: DataFrame
    folds: DataFrame
    selected: DataFrame

    @cached_property
    def genes(self) -> DataFrame:
        return gene_lists(self.selected)

    @cached_property
    def exposures(self) -> DataFrame:
        """(fold, cond_id, cell_line, compound, dose, genes) of every test condition."""
        meta = self.profiles.select("cond_id", "cell_line", "compound", "dose")
        return self.folds.where("role = 'test'").select("fold", "cond_id").join(meta, "cond_id").join(self.genes, "fold")

    def means(self, column: str, keys: list[str], wanted: DataFrame | None = None) -> DataFrame:
        return train_means(self.profiles, self.folds, self.selected, column, keys, wanted)


Predictor = Callable[[Fit], DataFrame]
PREDICTORS: dict[str, Predictor] = {}


def register_predictor(name: str, predictor: Predictor) -> None:
    PREDICTORS[name] = predictor


def _plain() -> list[Column]:
    return [F.lit(False).alias("fallback"), F.lit(None).cast("int").alias("tier")]


def no_change(fit: Fit) -> DataFrame:
    return fit.exposures.select("fold", "cond_id", F.array_repeat(F.lit(0.0), F.size("genes")).alias("pred"), *_plain())


def global_mean_delta(fit: Fit) -> DataFrame:
    return fit.exposures.join(fit.means("delta", []), "fold").select("fold", "cond_id", F.col("mean").alias("pred"), *_plain())


def _tiered(rows: DataFrame, exact: DataFrame, near: DataFrame, overall: DataFrame, exact_on: list[str], near_on: list[str]) -> DataFrame:
    """Prediction from the first of three tables that has the row's keys; tier 2 is the fallback."""
    tier = F.when(F.col("m0").isNotNull(), 0).when(F.col("m1").isNotNull(), 1).otherwise(2)
    return (
        rows.join(exact.withColumnRenamed("mean", "m0"), exact_on, "left")
        .join(near.withColumnRenamed("mean", "m1"), near_on, "left")
        .join(overall.withColumnRenamed("mean", "m2"), "fold", "left")
        .select("fold", "cond_id", F.coalesce("m0", "m1", "m2").alias("pred"), (tier == 2).alias("fallback"), tier.alias("tier"))
    )


def per_drug_mean_delta(fit: Fit) -> DataFrame:
    """Mean training delta of the same compound and dose, else of the compound at any dose, else of all.

    The middle tier averages conditions, not dose means. Time is not part of the keys.
    """
    rows = fit.exposures
    exact_on, near_on = ["fold", "compound", "dose"], ["fold", "compound"]
    exact = fit.means("delta", ["compound", "dose"], rows.select(*exact_on))
    near = fit.means("delta", ["compound"], rows.select(*near_on))
    return _tiered(rows, exact, near, fit.means("delta", []), exact_on, near_on)


def context_candidates(fit: Fit) -> DataFrame:
    """(fold, cond_id, line, tier, sim): training lines holding the test condition's compound.

    Tier 0 lines hold the exact dose. sim is the cosine between the condition's control profile and
    the line's mean training control, on the fold's genes. Only lines that can be chosen are compared.
    """
    holds = (
        fit.folds.where("role = 'train'").select("fold", "cond_id")
        .join(fit.profiles.select("cond_id", F.col("cell_line").alias("line"), "compound", F.col("dose").alias("held_dose")), "cond_id")
        .select("fold", "line", "compound", "held_dose").distinct()
    )
    control = fit.profiles.select("cond_id", F.col("control").alias("own"))
    choices = fit.exposures.join(holds, ["fold", "compound"]).groupBy("fold", "cond_id", "line").agg(
        F.min(F.when(F.col("held_dose") == F.col("dose"), 0).otherwise(1)).alias("tier")
    )
    lines = fit.means("control", ["cell_line"]).withColumnRenamed("cell_line", "line")
    return (
        choices.join(lines, ["fold", "line"]).join(control, "cond_id").join(fit.genes, "fold")
        .select("fold", "cond_id", "line", "tier", arrays.cosine(arrays.gather(F.col("own"), F.col("genes")), F.col("mean")).alias("sim"))
    )


def nearest_context(fit: Fit) -> DataFrame:
    """Copy the delta of the most similar training line that has the compound and dose, else the compound."""
    best = (
        context_candidates(fit).groupBy("fold", "cond_id")
        .agg(F.min(F.struct("tier", (-F.col("sim")).alias("minus_sim"), "line")).alias("best"))
        .select("fold", "cond_id", F.col("best.line").alias("line"), F.col("best.tier").alias("want"))
    )
    rows = fit.exposures.drop("cell_line").join(best, ["fold", "cond_id"], "left").withColumnRenamed("line", "cell_line")
    exact_on, near_on = ["fold", "cell_line", "compound", "dose"], ["fold", "cell_line", "compound"]
    exact = fit.means("delta", exact_on[1:], rows.where("want = 0").select(*exact_on))
    near = fit.means("delta", near_on[1:], rows.where("want = 1").select(*near_on))
    return _tiered(rows, exact, near, fit.means("delta", []), exact_on, near_on)


def ridge(fit: Fit) -> DataFrame:
    return ridge_predictions(fit.profiles, fit.folds, fit.genes, use_compound=True)


def ridge_no_drug(fit: Fit) -> DataFrame:
    return ridge_predictions(fit.profiles, fit.folds, fit.genes, use_compound=False)


for _name, _fn in [
    ("no_change", no_change), ("global_mean_delta", global_mean_delta), ("per_drug_mean_delta", per_drug_mean_delta),
    ("ridge", ridge), ("ridge_no_drug", ridge_no_drug), ("nearest_context", nearest_context),
]:
    register_predictor(_name, _fn)
BUILT_IN = frozenset(PREDICTORS)  # what a caller registers beyond these runs in every regime


def predictors_for(regime: str) -> list[str]:
    """Regimes with unseen compounds use the compound-free ridge."""
    linear = "ridge_no_drug" if regime in ("held_out_drug", "held_out_both") else "ridge"
    added = [name for name in PREDICTORS if name not in BUILT_IN]
    return ["no_change", "global_mean_delta", "per_drug_mean_delta", linear, "nearest_context", *added]


def predict_all(fit: Fit, names: list[str] | None = None) -> DataFrame:
    """Predictions of every predictor that applies to each fold's regime, with a `baseline` column."""
    regimes = [r.regime for r in fit.folds.select("regime").distinct().collect()]
    parts = []
    for name, predictor in PREDICTORS.items():
        applies = [r for r in regimes if name in (names or predictors_for(r))]
        if not applies:
            continue
        narrowed = Fit(fit.profiles, fit.folds.where(F.col("regime").isin(applies)), fit.selected)
        out = predictor(narrowed).select("fold", "cond_id", F.lit(name).alias("baseline"), "pred", "fallback", "tier")
        parts.append(out)
    return reduce(DataFrame.unionByName, parts)


def fallback_rates(predictions: DataFrame) -> DataFrame:
    """Per fold and baseline: share of fallback rows, and of dose-collapsed rows (NULL without tiers)."""
    return predictions.groupBy("fold", "baseline").agg(
        F.avg(F.col("fallback").cast("double")).alias("fallback_rate"),
        F.avg(F.when(F.col("tier").isNotNull(), (F.col("tier") == 1).cast("double"))).alias("fallback_rate_dose_collapsed"),
    )
