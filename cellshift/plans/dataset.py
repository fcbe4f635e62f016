"""Build the condition-level dataset from an assay.

The order of passes is chosen so that the wide rows (the counts) are only ever scanned and reduced:

0. a source that is not row-compressed yet is regrouped and written once;
1. narrow pass: per-cell statistics, written as a table of cell keys and flags (no counts);
2. gene pass: detection counts, giving the kept gene axis;
3. wide passes: group sums, value histograms and half sums, each one scan with map-side combining.

The small tables between the passes are written to the shared folder, so that later plans see their
true sizes and lost executors cannot force a rerun of the scans.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellshift.config import Config
from cellshift.operators import de, halves, pseudobulk, qc
from cellshift.session import materialize
from cellshift.sources.assay import Assay

CELL_COLUMNS = [
    "cell_id", "cell_line", "compound", "dose", "time", "batch", "target", "is_control", "n_genes",
    "total_count", "mito_count", "pct_mito", "pass_min_genes", "pass_mito", "keep",
]


def _together(*stages) -> None:
    with ThreadPoolExecutor(len(stages)) as pool:
        for stage in [pool.submit(s) for s in stages]:
            stage.result()


@dataclass
class Build:
    """Lazily built stages of one dataset; each stage is written once and reused."""

    assay: Assay
    cfg: Config

    def prepare(self) -> "Build":
        """Build the condition-level tables, independent stages side by side.

        The scans of one dataset do not depend on each other once the cells are matched, so their
        jobs are submitted together and fill the cluster between them.
        """
        self.cells
        _together(lambda: self.n_genes, lambda: self.median, lambda: self.matching)
        _together(lambda: self.obs, lambda: self.buckets, lambda: self.half_cutoffs)
        _together(lambda: self.profiles, lambda: self.de)  # group sums are read from the buckets
        return self

    @cached_property
    def stored(self) -> Assay:
        """The assay in row-compressed form; a long source is regrouped and written once."""
        if self.assay.packed:
            return self.assay
        return replace(self.assay, cells=materialize(self.assay.cells, "packed"), packed=True)

    @cached_property
    def stats(self) -> DataFrame:
        return qc.cell_stats(self.stored, self.cfg)

    @cached_property
    def cells(self) -> DataFrame:
        return materialize(self.stats.select(*CELL_COLUMNS), "cells")

    @cached_property
    def genes(self) -> DataFrame:
        """Kept genes with their position gene_idx on the gene axis (the axis is short: one window)."""
        kept = qc.gene_detection(self.stored).where("keep").select("gene_id", "gene")
        if self.stored.already_normalized:
            kept = self.stored.genes.select("gene_id", "gene")
        axis = kept.withColumn("gene_idx", (F.row_number().over(Window.orderBy("gene_id")) - 1).cast("int"))
        return materialize(axis, "genes")

    @cached_property
    def n_genes(self) -> int:
        return self.genes.count()

    @cached_property
    def median(self) -> float:
        found = qc.median_total(self.cells).first()
        return 1.0 if found is None or found[0] is None else float(found[0])

    def expression(self, cells: DataFrame, *keys: str) -> DataFrame:
        return qc.expression(cells, self.genes, self.median, list(keys), not self.stored.already_normalized)

    @property
    def placed_expression(self) -> DataFrame:
        return self.expression(pseudobulk.place(self.stats, self.matching), "plate_id", "pair_id")

    @cached_property
    def sizes(self) -> DataFrame:
        return materialize(pseudobulk.group_sizes(self.cells), "sizes")

    @cached_property
    def matching(self) -> pseudobulk.Matching:
        return pseudobulk.match_controls(self.sizes, self.cfg.min_cells_per_condition, materialize)

    @cached_property
    def obs(self) -> DataFrame:
        found = pseudobulk.conditions(self.matching, pseudobulk.compound_targets(self.cells))
        return materialize(found, "conditions")

    @cached_property
    def sums(self) -> DataFrame:
        if "buckets" in self.__dict__:
            return materialize(self.buckets.groupBy("plate_id", "pair_id", "gene_idx").agg(F.sum("total").alias("s")), "sums")
        return materialize(pseudobulk.group_sums(self.placed_expression), "sums")

    @cached_property
    def control_profiles(self) -> DataFrame:
        return materialize(pseudobulk.control_profiles(self.sums, self.matching.controls), "control_profiles")

    @cached_property
    def profiles(self) -> DataFrame:
        entries = pseudobulk.profile_entries(self.sums, self.matching, self.control_profiles)
        return materialize(pseudobulk.profiles(entries, self.obs, self.n_genes), "profiles")

    @cached_property
    def buckets(self) -> DataFrame:
        return materialize(de.bucket_sums(de.value_histogram(self.placed_expression)), "buckets")

    @cached_property
    def plate_z(self) -> DataFrame:
        return de.plate_z(self.buckets, self.matching, self.n_genes, materialize).drop("p")

    @cached_property
    def combined_z(self) -> DataFrame:
        return de.stouffer(self.plate_z, self.matching)

    @cached_property
    def de(self) -> DataFrame:
        rejected = de.de_genes(self.combined_z, self.n_genes, self.cfg.de_alpha)
        return materialize(de.de_sets(rejected, self.obs), "de")

    @cached_property
    def half_cutoffs(self) -> DataFrame:
        largest = self.matching.pairs.agg(F.max("n_treated")).first()[0] or 0
        found = halves.half_cutoffs(self.cells, self.matching, self.cfg.n_ceiling_reps, self.cfg.seed, largest, materialize)
        return materialize(found, "half_cutoffs")

    def halves(self, genes: DataFrame | None = None, n_rep: int | None = None) -> DataFrame:
        """Half profiles over the gene axis; with `genes` (gene_idx) only those positions are summed, the rest stay 0."""
        n_rep = n_rep or self.cfg.n_ceiling_reps
        marked = halves.mark_halves(self.stats, self.matching, self.half_cutoffs, n_rep, self.cfg.seed)
        expr, ctrl = self.expression(marked, "pair_id", "halves"), self.control_profiles
        if genes is not None:
            expr, ctrl = expr.join(genes, "gene_idx", "left_semi"), ctrl.join(genes, "gene_idx", "left_semi")
        found = halves.half_profiles(expr, self.matching, ctrl, self.obs, self.n_genes, n_rep)
        return materialize(found, "halves")
