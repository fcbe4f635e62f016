"""Predictors written as a class with partial_fit, merge and predict, run as Spark jobs.

A class sees blocks of rows only: every fold's training conditions are dealt to shards of about ROWS_PER_SHARD, each is
fitted on its own, and the models of a fold are merged FAN at a time, round by round. The merged model goes to the shards of
the fold's test conditions. No task holds a fold; a task holds one shard, or FAN models.

    class DoseMean(Model):
        ...

    register_predictor("dose_mean", model_predictor(DoseMean))
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.functions import arrays
from cellshift.operators.baselines import Fit

ROWS_PER_SHARD = 1024
FAN = 8
META = ["cond_id", "cell_line", "compound", "dose", "log_dose"]

_MODEL = "fold string, shard int, model binary"
_OUT = "fold string, cond_id string, pred array<double>, fallback boolean"


class Model(ABC):
    """What a predictor has to offer. `meta` holds META, a row per condition; the matrices are conditions x fold genes.

    `partial_fit` sees each training condition once, in any blocks and any order, so that merged models must not depend on
    how the conditions were dealt. `finish` follows the last merge. `fallback` may be set by `predict`: which rows
    had no knowledge of their own.
    """

    fallback: np.ndarray | None = None

    @abstractmethod
    def partial_fit(self, meta: pd.DataFrame, control: np.ndarray, delta: np.ndarray) -> None: ...

    @abstractmethod
    def merge(self, other: "Model") -> None: ...

    def finish(self) -> None:
        """Whatever needs all conditions' sums."""

    @abstractmethod
    def predict(self, meta: pd.DataFrame, control: np.ndarray) -> np.ndarray: ...


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(float)


def checked(pred: np.ndarray, rows: int, genes: int, name: str) -> np.ndarray:
    """pred as a finite rows x genes matrix, or an error that names the class."""
    pred = np.asarray(pred, dtype=float)
    if pred.shape != (rows, genes):
        raise ValueError(f"{name}.predict gave {pred.shape} instead of {(rows, genes)}")
    if not np.isfinite(pred).all():
        raise FloatingPointError(f"{name}.predict gave {int((~np.isfinite(pred)).sum())} values that are not finite")
    return pred


def _rows(fit: Fit, n_shards: int) -> DataFrame:
    """(fold, shard, train, META, control, delta): the fold's genes only; delta of training rows alone."""
    train = F.col("role") == "train"
    return (
        fit.folds.select("fold", "cond_id", train.alias("train"))
        .join(fit.profiles.select(*META, "control", "delta"), "cond_id").join(fit.genes, "fold")
        .select(
            "fold", F.pmod(F.xxhash64("cond_id"), F.lit(n_shards)).cast("int").alias("shard"), "train", *META,
            arrays.gather(F.col("control"), F.col("genes")).alias("control"),
            F.when(F.col("train"), arrays.gather(F.col("delta"), F.col("genes"))).alias("delta"),
        )
    )


def merged_models(train: DataFrame, factory: Callable[[], Model], n_shards: int) -> DataFrame:
    """(fold, shard, model): one model a fold, of all its training rows; log(n_shards) rounds of merges."""
    single = n_shards == 1

    def fit_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cond_id", ignore_index=True)
        model = factory()
        model.partial_fit(pdf[META], _matrix(pdf.control), _matrix(pdf.delta))
        if single:
            model.finish()
        return pd.DataFrame({"fold": [pdf.fold.iloc[0]], "shard": [int(pdf.shard.iloc[0])], "model": [cloudpickle.dumps(model)]})

    models = train.groupBy("fold", "shard").applyInPandas(fit_shard, _MODEL)
    while n_shards > 1:
        n_shards = math.ceil(n_shards / FAN)
        models = _merge_round(models, last=n_shards == 1)
    return models


def _merge_round(models: DataFrame, last: bool) -> DataFrame:
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        packed = pdf.sort_values("shard").model.to_list()
        model = cloudpickle.loads(packed[0])
        for other in packed[1:]:
            model.merge(cloudpickle.loads(other))
        if last:
            model.finish()
        return pd.DataFrame({"fold": [pdf.fold.iloc[0]], "shard": [int(pdf.upper.iloc[0])], "model": [cloudpickle.dumps(model)]})

    dealt = models.withColumn("upper", F.floor(F.col("shard") / FAN).cast("int"))
    return dealt.groupBy("fold", "upper").applyInPandas(merge, _MODEL)


def model_predictor(factory: Callable[[], Model], rows_per_shard: int = ROWS_PER_SHARD) -> Callable[[Fit], DataFrame]:
    """A predictor for `baselines.register_predictor` from a Model class (or anything that makes one).

    Counts the conditions first (one number) for the number of shards.
    """
    name = getattr(factory, "__name__", type(factory).__name__)

    def predict_shard(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=["fold", "cond_id", "pred", "fallback"])
        if right.empty:
            raise RuntimeError(f"{name}: fold {left.fold.iloc[0]} has test conditions but no training conditions")
        left = left.sort_values("cond_id", ignore_index=True)
        model, control = cloudpickle.loads(right.model.iloc[0]), _matrix(left.control)
        pred = checked(model.predict(left[META], control), *control.shape, name)
        fallback = np.zeros(len(left), bool) if model.fallback is None else np.asarray(model.fallback, bool)
        return pd.DataFrame({"fold": left.fold, "cond_id": left.cond_id, "pred": list(pred), "fallback": fallback})

    def predictor(fit: Fit) -> DataFrame:
        n_shards = math.ceil(max(1, fit.profiles.count()) / rows_per_shard)
        rows = _rows(fit, n_shards)
        models = merged_models(rows.where("train"), factory, n_shards)
        test = rows.where("NOT train")
        placed = arrays.fresh(test.select("fold", "shard").distinct().join(models.select("fold", "model"), "fold"))
        out = test.groupBy("fold", "shard").cogroup(placed.groupBy("fold", "shard")).applyInPandas(predict_shard, _OUT)
        return out.withColumn("tier", F.lit(None).cast("int"))

    return predictor


class DoseSlope(Model):
    """Delta proportional to log dose: one slope a gene for each compound, that of all compounds for one not seen."""

    def __init__(self) -> None:
        self.sums: dict[str | None, tuple[float, np.ndarray]] = {}

    def _add(self, compound: str | None, square: float, product: np.ndarray) -> None:
        held = self.sums.get(compound)
        self.sums[compound] = (square, product) if held is None else (held[0] + square, held[1] + product)

    def partial_fit(self, meta: pd.DataFrame, control: np.ndarray, delta: np.ndarray) -> None:
        dose = meta.log_dose.to_numpy(float)
        for compound, at in meta.groupby("compound", dropna=False).indices.items():
            self._add(compound, float((dose[at] ** 2).sum()), dose[at] @ delta[at])
        self._add(None, float((dose**2).sum()), dose @ delta)

    def merge(self, other: "DoseSlope") -> None:
        for compound, (square, product) in other.sums.items():
            self._add(compound, square, product)

    def predict(self, meta: pd.DataFrame, control: np.ndarray) -> np.ndarray:
        known = {c: s for c, s in self.sums.items() if c is not None and s[0] > 0}
        square, product = self.sums[None]
        rest = product / square if square > 0 else np.zeros(control.shape[1])
        self.fallback = np.array([c not in known for c in meta["compound"]], dtype=bool)
        slopes = [known[c][1] / known[c][0] if c in known else rest for c in meta["compound"]]
        return np.stack(slopes) * meta.log_dose.to_numpy(float)[:, None]
