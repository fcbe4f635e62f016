"""The benchmark sweep: folds, gene selection, predictions, scores and the results table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.config import Config
from cellshift.operators import baselines, hvg, metrics, normalize, splits
from cellshift.session import materialize


def first_folds(folds: DataFrame, limit: int) -> DataFrame:
    """The first folds of each regime by name, as many as the caller asks for."""
    names = folds.groupBy("regime").agg(F.slice(F.sort_array(F.collect_set("fold")), 1, limit).alias("names"))
    kept = names.select(F.explode("names").alias("fold"))
    return folds.join(kept, "fold", "left_semi").select(*folds.columns)


@dataclass
class Sweep:
    """One sweep over a built dataset (anything with cfg, obs, profiles, de, n_genes and halves).

    Every fold and every selected gene, unless the caller limits folds_per_regime or genes_per_fold.
    """

    build: Any
    folds_per_regime: int | None = None
    genes_per_fold: int | None = None
    regimes: tuple[str, ...] = tuple(splits.REGIMES)
    skip: DataFrame | None = None
    names: tuple[str, ...] | None = None

    @property
    def cfg(self) -> Config:
        return self.build.cfg

    @property
    def profiles(self) -> DataFrame:
        return self.build.profiles

    @cached_property
    def obs(self) -> DataFrame:
        """What folds are made from: the conditions' metadata, which profiles hold too."""
        return getattr(self.build, "obs", self.build.profiles)

    @cached_property
    def folds(self) -> DataFrame:
        folds = splits.all_folds(self.obs, self.cfg.seed, list(self.regimes))
        if self.folds_per_regime:
            folds = first_folds(folds, self.folds_per_regime)
        if self.skip is not None:
            folds = folds.join(self.skip, "fold", "left_anti")
        return materialize(folds.select("regime", "fold", "cond_id", "role"), "folds")

    @cached_property
    def meta(self) -> DataFrame:
        return splits.fold_meta(self.obs, self.folds, self.cfg.seed)

    @cached_property
    def selected(self) -> DataFrame:
        """(fold, gene_idx), from training rows only."""
        if self.cfg.gene_set == "all":
            chosen = hvg.all_genes(self.folds, self.build.n_genes)
        else:
            chosen = hvg.select_genes(hvg.fold_gene_variance(self.profiles, self.folds), self.cfg.n_hvg, self.build.n_genes)
        if self.genes_per_fold:
            chosen = hvg.gene_lists(chosen, self.genes_per_fold).select("fold", F.explode("genes").alias("gene_idx"))
        return materialize(chosen.select("fold", "gene_idx"), "selected")

    @cached_property
    def fit(self) -> baselines.Fit:
        return baselines.Fit(self.profiles, self.folds, self.selected)

    @cached_property
    def predictions(self) -> DataFrame:
        return materialize(baselines.predict_all(self.fit, list(self.names) if self.names else None), "predictions")

    @cached_property
    def halves(self) -> DataFrame:
        return self.build.halves(hvg.gene_union(self.selected))

    @cached_property
    def truth(self) -> DataFrame:
        return materialize(metrics.truths(self.fit.exposures, self.profiles, self.build.de, self.build.n_genes), "truth")

    @cached_property
    def half(self) -> DataFrame:
        return materialize(metrics.half_truths(self.fit.exposures, self.halves), "half")

    @cached_property
    def scores(self) -> DataFrame:
        pairs = metrics.scoring_pairs(self.predictions, self.truth, self.half)
        return materialize(metrics.score_conditions(pairs, metrics.truth_pools(self.truth, self.half)), "scores")

    def results(self, n_boot: int = 1000, fold: str | None = None) -> DataFrame:
        """The results table, of one fold or of all; folds share the stored predictions and scores."""
        scores, folds, predictions = (df if fold is None else df.where(F.col("fold") == fold) for df in (self.scores, self.folds, self.predictions))
        return normalize.results_table(scores, folds, baselines.fallback_rates(predictions), self.cfg.seed, n_boot)
