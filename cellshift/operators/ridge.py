"""Ridge regression of deltas on whitened control components, compound indicators and log dose.

The fit needs only sums over training conditions, so it is a chain of small aggregations:

* the scatter matrix of centred control profiles gives the principal components;
* with features z = (1, components, dose), per compound sums of z and y, and Z'Z and Z'Y, the
  compound indicators are eliminated in closed form (their block is diagonal), leaving a system as
  small as z;
* kept per cross-validation part, the same sums give every validation error, so no alpha needs
  another pass over the data.

Every fold is cut into shards of about ROWS_PER_SHARD conditions whose sums are added up; no task holds
a fold's rows. What a single task must hold is the model: genes x genes for the components, (features +
compounds) x genes for the solution.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.functions import arrays, keyed

MAX_COMPONENTS = 50
MIN_VARIANCE_RATIO = 1e-6
ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)
CV_PARTS = 5
ROWS_PER_SHARD = 1024

_OUT = "fold string, cond_id string, pred array<double>, fallback boolean, alpha double, n_components int"


# --- numerics on one block of rows -----------------------------------------------------------


def check_finite(values: np.ndarray, where: str) -> None:
    if not np.isfinite(values).all():
        raise FloatingPointError(f"ridge: {int((~np.isfinite(values)).sum())} of {values.size} values are not finite in {where}")


def whitening(scatter: np.ndarray, n: int) -> np.ndarray:
    """Rows are principal directions scaled to unit variance; noise-level directions are left out first."""
    total = float(np.trace(scatter))
    values, vectors = np.linalg.eigh(scatter)
    wanted = max(1, min(MAX_COMPONENTS, n - 1, len(values)))
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    keep = max(1, int((values > MIN_VARIANCE_RATIO * total).sum()))
    if n < 2 or not values[0] > 0 or total <= 0:
        raise RuntimeError("ridge: the control profiles of the training conditions have no varying direction")
    variance = values[:keep] / (n - 1)
    return (vectors[:, :keep] / np.sqrt(variance)).T


def features(components: np.ndarray, centred: np.ndarray, dose: np.ndarray) -> np.ndarray:
    z = np.column_stack([np.ones(len(dose)), centred @ components.T, dose])
    check_finite(z, "the features")
    return z


def partial_sums(z: np.ndarray, y: np.ndarray, cv: np.ndarray, compound: np.ndarray) -> pd.DataFrame:
    """Rows (cv, compound, i, n, sums): i >= 0 is row i of [Z'Z | Z'Y]; i = -1 holds [sum z | sum y]
    of one compound; i = -2 holds the sum of y squared."""
    out = []
    for part in np.unique(cv):
        at = cv == part
        zp, yp = z[at], y[at]
        for i, row in enumerate(zp.T @ np.hstack([zp, yp])):
            out.append((int(part), "", i, len(zp), row))
        out.append((int(part), "", -2, len(zp), np.array([float((yp * yp).sum())])))
        names = compound[at]
        for name in np.unique(names):
            rows = names == name
            out.append((int(part), name, -1, int(rows.sum()), np.concatenate([zp[rows].sum(0), yp[rows].sum(0)])))
    return pd.DataFrame(out, columns=["cv", "compound", "i", "n", "sums"])


class _Sums:
    """Sums of a set of cross-validation parts, in matrix form."""

    def __init__(self, zz, zy, yy, n, counts, cz, cy):
        self.zz, self.zy, self.yy, self.n, self.counts, self.cz, self.cy = zz, zy, yy, n, counts, cz, cy

    def __sub__(self, other: "_Sums") -> "_Sums":
        return _Sums(*(a - b for a, b in zip(vars(self).values(), vars(other).values())))

    def __add__(self, other: "_Sums") -> "_Sums":
        return _Sums(*(a + b for a, b in zip(vars(self).values(), vars(other).values())))

    def solve(self, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of z and the compound effects; the constant feature is not penalised."""
        penalty = alpha * np.eye(len(self.zz))
        penalty[0, 0] = 0.0
        shrink = self.cz / (self.counts + alpha)[:, None]
        beta = np.linalg.solve(self.zz + penalty - shrink.T @ self.cz, self.zy - shrink.T @ self.cy)
        gamma = (self.cy - self.cz @ beta) / (self.counts + alpha)[:, None]
        gamma[self.counts == 0] = 0.0
        return beta, gamma

    def squared_error(self, beta: np.ndarray, gamma: np.ndarray) -> float:
        fit = (beta * self.zy).sum() + (gamma * self.cy).sum()
        norm = (beta * (self.zz @ beta)).sum() + 2 * ((self.cz @ beta) * gamma).sum() + (self.counts[:, None] * gamma * gamma).sum()
        return float(self.yy - 2 * fit + norm)


def solve_fold(sums: pd.DataFrame, use_compound: bool) -> tuple[float, np.ndarray, list[str], np.ndarray]:
    """Choose alpha by cross-validation and fit: (alpha, beta, compounds, gamma)."""
    names = sorted(set(sums.loc[sums.i == -1, "compound"]))
    index = {c: k for k, c in enumerate(names)}
    parts = {}
    for cv, rows in sums.groupby("cv"):
        dense = rows[rows.i >= 0].sort_values("i")
        block = np.stack(dense["sums"].to_list())
        p = len(block)
        cells = rows[rows.i == -1]
        counts, per = np.zeros(len(names)), np.zeros((len(names), block.shape[1]))
        if use_compound:
            at = [index[c] for c in cells["compound"]]
            counts[at] = cells["n"].to_numpy(float)
            per[at] = np.stack(cells["sums"].to_list())
        yy = float(rows.loc[rows.i == -2, "sums"].iloc[0][0])
        parts[cv] = _Sums(block[:, :p], block[:, p:], yy, int(dense["n"].iloc[0]), counts, per[:, :p], per[:, p:])
    whole = sum(list(parts.values())[1:], list(parts.values())[0])
    alpha = 1.0
    if len(parts) >= 2:
        best = -np.inf
        for candidate in ALPHAS:
            scores = []
            for held in parts.values():
                beta, gamma = (whole - held).solve(candidate)
                scores.append(-held.squared_error(beta, gamma) / (held.n * held.zy.shape[1]))
            if np.mean(scores) > best:
                best, alpha = float(np.mean(scores)), candidate
    beta, gamma = whole.solve(alpha)
    return alpha, beta, names, gamma


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(float)


def _fold_result(fold, cond, z, compounds, alpha, beta, names, gamma, use_compound) -> pd.DataFrame:
    index = {c: k for k, c in enumerate(names)}
    pred = z @ beta
    seen = np.array([c in index for c in compounds], dtype=bool)
    if use_compound and seen.any():
        pred[seen] += gamma[[index[c] for c in compounds[seen]]]
    check_finite(pred, "the predictions")
    return pd.DataFrame({
        "fold": fold, "cond_id": cond, "pred": list(pred), "fallback": ~seen if use_compound else np.zeros(len(pred), bool),
        "alpha": float(alpha), "n_components": z.shape[1] - 2,
    })


# --- plan ------------------------------------------------------------------------------------


def _rows(profiles: DataFrame, folds: DataFrame, genes: DataFrame, n_shards: int) -> DataFrame:
    """(fold, cond_id, train, compound, dose, cv, shard, control, delta): standardised dose, fold genes only."""
    train = folds.where("role = 'train'").select("fold", "cond_id")
    ranked = keyed.keyed_rank(train.withColumn("key", keyed.digest(0, "ridge-cv", "fold", "cond_id")), ["fold"], "key", 2)
    sizes = train.groupBy("fold").agg(F.count("*").alias("n_train"))
    parts = F.least(F.lit(CV_PARTS), F.col("n_train"))
    cv = ranked.join(sizes, "fold").select("fold", "cond_id", F.pmod(F.col("rank") - 1, parts).cast("int").alias("cv"))
    doses = train.join(profiles.select("cond_id", "log_dose"), "cond_id").groupBy("fold").agg(
        F.avg("log_dose").alias("dose_mean"), F.stddev_pop("log_dose").alias("dose_sd")
    )
    scale = F.when(F.col("dose_sd") > 1e-12, F.col("dose_sd")).otherwise(1.0)
    return (
        folds.select("fold", "cond_id", (F.col("role") == "train").alias("train"))
        .join(cv, ["fold", "cond_id"], "left")
        .join(profiles.select("cond_id", "compound", "log_dose", "control", "delta"), "cond_id")
        .join(genes, "fold").join(doses, "fold")
        .select(
            "fold", "cond_id", "train", "compound", ((F.col("log_dose") - F.col("dose_mean")) / scale).alias("dose"),
            F.coalesce("cv", F.lit(-1)).alias("cv"),
            F.pmod(F.xxhash64("cond_id"), F.lit(n_shards)).cast("int").alias("shard"),
            arrays.gather(F.col("control"), F.col("genes")).alias("control"),
            F.when(F.col("train"), arrays.gather(F.col("delta"), F.col("genes"))).alias("delta"),
        )
    )


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise sum of the `sums` arrays (and of n) over shards."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[[0]].copy()
        first["n"] = int(pdf["n"].sum())
        first["sums"] = [np.sum(_matrix(pdf["sums"]), axis=0)]
        return first

    return parts.groupBy(*keys).applyInPandas(add, parts.schema)


def _fit(rows: DataFrame, use_compound: bool) -> DataFrame:
    train = rows.where("train")
    # control means per fold, by gene position, so that the scatter is taken around them exactly
    centres = (
        train.select("fold", F.posexplode("control").alias("pos", "v")).groupBy("fold", "pos").agg(F.avg("v").alias("m"))
        .groupBy("fold").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("centre"))
    )
    rows = rows.join(centres, "fold").withColumn("control", arrays.subtract(F.col("control"), F.col("centre"))).drop("centre")
    train = rows.where("train")

    def scatter(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf.control)
        s = x.T @ x
        return pd.DataFrame({"fold": pdf.fold.iloc[0], "i": np.arange(len(s)), "n": len(x), "sums": list(s)})

    scatters = train.groupBy("fold", "shard").applyInPandas(scatter, "fold string, i int, n long, sums array<double>")

    def components(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        w = whitening(_matrix(pdf["sums"]), int(pdf["n"].iloc[0]))
        return pd.DataFrame({"fold": [pdf.fold.iloc[0]], "components": [list(w)]})

    model = _summed(scatters, ["fold", "i"]).groupBy("fold").applyInPandas(components, "fold string, components array<array<double>>")
    shards = rows.select("fold", "shard").distinct()

    def featurize(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["fold", "cond_id", "train", "compound", "cv", "shard", "z", "delta"])
        z = features(_matrix(pd.Series(list(right.components.iloc[0]))), _matrix(left.control), left.dose.to_numpy())
        out = left[["fold", "cond_id", "train", "compound", "cv", "shard"]].copy()
        out["z"], out["delta"] = list(z), left["delta"]
        return out

    featured = (
        rows.groupBy("fold", "shard").cogroup(arrays.fresh(shards.join(model, "fold")).groupBy("fold", "shard"))
        .applyInPandas(featurize, "fold string, cond_id string, train boolean, compound string, cv int, shard int, z array<double>, delta array<double>")
    )

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        out = partial_sums(_matrix(pdf.z), _matrix(pdf.delta), pdf.cv.to_numpy(), pdf["compound"].to_numpy())
        out.insert(0, "fold", pdf.fold.iloc[0])
        return out

    part = featured.where("train").groupBy("fold", "shard").applyInPandas(
        sums, "fold string, cv int, compound string, i int, n long, sums array<double>"
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        alpha, beta, names, gamma = solve_fold(pdf, use_compound)
        return pd.DataFrame({"fold": [pdf.fold.iloc[0]], "alpha": [alpha], "beta": [list(beta)], "names": [names], "gamma": [list(gamma)]})

    solved = _summed(part, ["fold", "cv", "compound", "i"]).groupBy("fold").applyInPandas(
        solve, "fold string, alpha double, beta array<array<double>>, names array<string>, gamma array<array<double>>"
    )

    def predict(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["fold", "cond_id", "pred", "fallback", "alpha", "n_components"])
        m = right.iloc[0]
        return _fold_result(
            left.fold.iloc[0], left.cond_id.to_numpy(), _matrix(left.z), left["compound"].to_numpy(), m.alpha,
            _matrix(pd.Series(list(m.beta))), list(m.names), _matrix(pd.Series(list(m.gamma))), use_compound,
        )

    test = featured.where("NOT train")
    return test.groupBy("fold", "shard").cogroup(arrays.fresh(shards.join(solved, "fold")).groupBy("fold", "shard")).applyInPandas(predict, _OUT)


def ridge_predictions(
    profiles: DataFrame, folds: DataFrame, genes: DataFrame, use_compound: bool, rows_per_shard: int = ROWS_PER_SHARD
) -> DataFrame:
    """Predictions for every fold's test conditions, with the chosen alpha and the number of components.

    Counts the conditions first (one number) for the number of shards.
    """
    n_shards = math.ceil(max(1, profiles.count()) / rows_per_shard)
    return _fit(_rows(profiles, folds, genes, n_shards), use_compound).select("fold", "cond_id", "pred", "fallback", F.lit(None).cast("int").alias("tier"), "alpha", "n_components")
