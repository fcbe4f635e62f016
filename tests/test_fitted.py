"""Predictors written as classes: shards and merges against a plain fit of whole folds, and a full sweep."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellshift.config import Config
from cellshift.operators import baselines, fitted, hvg, normalize
from cellshift.plans.sweep import Sweep
from tests.test_models import folds, grid  # noqa: F401  fixtures


class OwnMean(fitted.Model):
    """A third party's class: mean delta, written as sum and count, divided at the end."""

    def __init__(self):
        self.total, self.n, self.done = 0.0, 0, 0

    def partial_fit(self, meta, control, delta):
        self.total, self.n = self.total + delta.sum(axis=0), self.n + len(delta)

    def merge(self, other):
        self.total, self.n, self.done = self.total + other.total, self.n + other.n, self.done + other.done

    def finish(self):
        self.mean, self.done = self.total / self.n, self.done + 1

    def predict(self, meta, control):
        assert self.done == 1  # finished once, at the top
        return np.tile(self.mean, (len(meta), 1))


@pytest.fixture(scope="module")
def fit(grid, folds):  # noqa: F811
    return baselines.Fit(grid, folds, hvg.all_genes(folds, 12))


@pytest.mark.parametrize("rows_per_shard", [1024, 6, 1])
def test_merged_shards_equal_the_plain_mean(fit, rows_per_shard):
    """One shard, six (one round of merges) and 36 (two rounds)."""
    got = {(r.fold, r.cond_id): r for r in fitted.model_predictor(OwnMean, rows_per_shard)(fit).collect()}
    plain = {(r.fold, r.cond_id): r for r in baselines.global_mean_delta(fit).collect()}
    assert got.keys() == plain.keys()
    for key, r in got.items():
        assert np.allclose(r.pred, plain[key].pred, atol=1e-12) and r.fallback is False and r.tier is None


def test_dose_slope_matches_plain_least_squares(fit):
    """Slopes per compound, that of all where the compound is not in training."""
    profiles = fit.profiles.toPandas().set_index("cond_id")
    roles = fit.folds.select("fold", "cond_id", "role").toPandas()
    train = {fold: profiles.loc[rows.cond_id] for fold, rows in roles[roles.role == "train"].groupby("fold")}
    found = fitted.model_predictor(fitted.DoseSlope, 7)(fit).collect()
    assert len(found) == (roles.role == "test").sum() and {r.fallback for r in found} == {True, False}
    for r in found:
        rows, own = train[r.fold], profiles.loc[r.cond_id]
        same = rows[rows["compound"] == own["compound"]]
        used = same if len(same) else rows
        slope = np.linalg.lstsq(used.log_dose.to_numpy()[:, None], np.stack(used.delta), rcond=None)[0][0]
        assert np.allclose(r.pred, slope * own.log_dose, atol=1e-9) and r.fallback == (len(same) == 0)


def test_a_class_in_a_full_sweep(spark, grid, monkeypatch):  # noqa: F811
    half = grid.select("cond_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("rep"), F.col("delta").alias("h0"), F.col("delta").alias("h1"))
    de = grid.select("cond_id", F.array(F.lit(1), F.lit(4), F.lit(7)).alias("de"))
    data = SimpleNamespace(cfg=Config(n_hvg=8), profiles=grid, de=de, n_genes=12, halves=lambda genes: half)
    monkeypatch.setitem(baselines.PREDICTORS, "own_mean", fitted.model_predictor(OwnMean, 5))
    res = Sweep(data, regimes=("held_out_context",)).results(n_boot=5).toPandas()
    keys = ["fold", "metric", "representation", "target"]
    keys = [k for k in keys if k in res.columns]
    own = res[res.baseline == "own_mean"].sort_values(keys)
    plain = res[res.baseline == "global_mean_delta"].sort_values(keys)
    assert list(res.columns) == normalize.RESULTS_COLUMNS and len(own) == len(plain) > 0
    assert np.allclose(own.value, plain.value, atol=1e-9, equal_nan=True)


def test_bad_predictions_are_refused():
    with pytest.raises(ValueError, match="Odd.predict"):
        fitted.checked(np.zeros((2, 3)), 3, 3, "Odd")
    with pytest.raises(FloatingPointError, match="1 values"):
        fitted.checked(np.array([[1.0, np.nan]]), 1, 2, "Odd")


def test_dose_slope_without_doses():
    model = fitted.DoseSlope()
    model.partial_fit(pd.DataFrame({"compound": ["a", "a"], "log_dose": [0.0, 0.0]}), np.zeros((2, 2)), np.ones((2, 2)))
    got = model.predict(pd.DataFrame({"compound": ["a"], "log_dose": [1.0]}), np.zeros((1, 2)))
    assert (got == 0).all() and model.fallback.tolist() == [True]
