"""Batch-matched pseudobulk: control matching, mean profiles, deltas and plate diagnostics.

Cells are reduced to (group, gene) sums in one scan with map-side combining; everything after works
on those sums. A missing (group, gene) row is zero, so means divide by the group's cell count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellshift.functions import arrays
from cellshift.sources.assay import KEYS

FALLBACK = "__cellline_fallback__"
UNKNOWN = "unknown"


def condition_id(line: str = "cell_line", compound: str = "compound") -> Column:
    """`line|compound|dose|time`; a bar or backslash inside a name is escaped, so the key is unique."""

    def safe(name: str) -> Column:
        return F.replace(F.replace(F.col(name), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))

    return F.concat_ws("|", safe(line), safe(compound), F.col("dose").cast("string"), F.col("time").cast("string"))


@dataclass
class Matching:
    """Outcome of matching treated groups to controls.

    groups: treated (keys, batch) groups with cond_id, eff_batch (NULL when the group is dropped),
        n_cells, n_total (usable cells of the condition) and usable (condition kept and group used).
    controls: control groups (plate_id, cell_line, eff_batch, n_control), pooled fallback rows included.
    pairs: usable (pair_id, plate_id, cond_id, cell_line, eff_batch) with n_treated, n_control, n_total.
    placement: (keys, batch, is_control, plate_id, pair_id) of every group that is used; pair_id is
        NULL for controls, which appear a second time under the fallback where their line needs it.

    plate_id and pair_id stand for the string keys in everything computed from cells, so that the
    large shuffles carry two longs.
    """

    groups: DataFrame
    controls: DataFrame
    pairs: DataFrame
    placement: DataFrame


def group_sizes(cells: DataFrame) -> DataFrame:
    """Kept cells per (cell line, compound, dose, time, batch, is_control)."""
    return cells.where(F.col("keep")).groupBy(*KEYS, "batch", "is_control").agg(F.count("*").alias("n_cells"))


def match_groups(sizes: DataFrame, min_cells: int) -> DataFrame:
    """Match every treated (condition, batch) group to the controls of its own line and batch.

    A group without such controls is dropped; a condition none of whose groups match uses the
    line's pooled controls for all its cells as one pseudo-batch; a line without controls loses its
    conditions. Conditions with fewer than `min_cells` usable cells are dropped.
    """
    control = _own_controls(sizes)
    pooled = control.groupBy("cell_line").agg(F.sum("n_control").alias("n_pooled"))
    treated = (
        sizes.where("NOT is_control")
        .withColumn("cond_id", condition_id())
        .join(control, ["cell_line", "batch"], "left")
        .join(pooled, "cell_line", "left")
    )
    whole = Window.partitionBy("cond_id")  # one row per batch of the condition
    matched = F.max(F.col("n_control").isNotNull()).over(whole)
    eff = (
        F.when(F.col("n_control").isNotNull(), F.col("batch"))
        .when(~F.col("any_match") & F.col("n_pooled").isNotNull(), F.lit(FALLBACK))
    )
    used = F.when(F.col("eff_batch").isNotNull(), F.col("n_cells"))
    return (
        treated.withColumn("any_match", matched)
        .withColumn("eff_batch", eff)
        .withColumn("n_control", F.when(F.col("any_match"), F.col("n_control")).otherwise(F.col("n_pooled")))
        .withColumn("n_total", F.coalesce(F.sum(used).over(whole), F.lit(0)))
        .withColumn("usable", F.col("eff_batch").isNotNull() & (F.col("n_total") >= min_cells))
        .drop("n_pooled")
    )


def _own_controls(sizes: DataFrame) -> DataFrame:
    return sizes.where("is_control").groupBy("cell_line", "batch").agg(F.sum("n_cells").alias("n_control"))


def match_controls(sizes: DataFrame, min_cells: int, keep: Callable[[DataFrame, str], DataFrame]) -> Matching:
    """The matching, with ids. `keep` stores a table: ids are numbered while a table is written, so
    each table has to be stored before the next refers to its ids."""
    groups = keep(match_groups(sizes, min_cells), "groups")
    fallback_lines = groups.where(F.col("usable") & (F.col("eff_batch") == FALLBACK)).select("cell_line").distinct()
    own = _own_controls(sizes).withColumnRenamed("batch", "eff_batch")
    pooled = own.join(fallback_lines, "cell_line", "left_semi").groupBy("cell_line").agg(F.sum("n_control").alias("n_control"))
    controls = own.unionByName(pooled.withColumn("eff_batch", F.lit(FALLBACK)))
    controls = keep(controls.withColumn("plate_id", F.monotonically_increasing_id()), "controls")
    paired = (
        groups.where("usable").groupBy("cond_id", "cell_line", "eff_batch")
        .agg(F.sum("n_cells").alias("n_treated"), F.max("n_total").alias("n_total"))
        .join(controls, ["cell_line", "eff_batch"])
    )
    pairs = keep(paired.withColumn("pair_id", F.monotonically_increasing_id()), "pairs")
    at = [*KEYS, "batch", "is_control"]
    treated_at = groups.where("usable").join(pairs, ["cond_id", "cell_line", "eff_batch"]).select(*at, "plate_id", "pair_id")
    nobody = F.lit(None).cast("long").alias("pair_id")
    control_cells = sizes.where("is_control")
    own_at = control_cells.withColumn("eff_batch", F.col("batch")).join(controls, ["cell_line", "eff_batch"])
    pooled_at = control_cells.join(controls.where(F.col("eff_batch") == FALLBACK), "cell_line")
    placement = treated_at.unionByName(own_at.select(*at, "plate_id", nobody)).unionByName(pooled_at.select(*at, "plate_id", nobody))
    return Matching(groups, controls, pairs, keep(placement, "placement"))


def place(stats: DataFrame, matching: Matching) -> DataFrame:
    """Kept cells with plate_id and pair_id. The wide rows are joined to the small placement table."""
    return stats.where("keep").join(matching.placement, [*KEYS, "batch", "is_control"])


def compound_targets(cells: DataFrame) -> DataFrame:
    """One target per compound: the smallest annotated one; NULL, empty, 'nan' and 'unknown' do not count."""
    known = F.when(~F.lower("target").isin("", "nan", UNKNOWN), F.col("target"))
    return cells.where(F.col("keep")).groupBy("compound").agg(F.coalesce(F.min(known), F.lit(UNKNOWN)).alias("target"))


def conditions(matching: Matching, targets: DataFrame) -> DataFrame:
    """The condition table: one row per kept condition."""
    return (
        matching.groups.where("usable")
        .groupBy("cond_id", *KEYS)
        .agg(
            F.array_join(F.sort_array(F.collect_set("eff_batch")), ",").alias("batch"),
            F.sum("n_cells").alias("n_cells"),
        )
        .withColumn("log_dose", F.log1p("dose"))
        .withColumn("is_control", F.lit(False))
        .join(targets, "compound", "left")
        .withColumn("target", F.coalesce("target", F.lit(UNKNOWN)))
        .select("cond_id", *KEYS, "log_dose", "batch", "n_cells", "is_control", "target")
    )


def plate_summary(matching: Matching, min_cells: int) -> DataFrame:
    """One row of counters: plate purity, multi-plate conditions, and what was dropped and why."""
    unmatched = F.col("n_control").isNull() | ~F.col("any_match")
    per_condition = (
        matching.groups.groupBy("cond_id")
        .agg(
            F.max("any_match").alias("any_match"),
            F.max(F.col("eff_batch").isNotNull()).alias("any_control"),
            F.max("n_total").alias("n_total"),
            F.count_if("usable").alias("n_plates"),
            F.max(F.when(F.col("usable"), F.col("n_cells"))).alias("largest"),
            F.sum(F.when(unmatched, F.col("n_cells")).otherwise(0)).alias("cells_unmatched"),
            F.count_if(unmatched).alias("pairs_unmatched"),
        )
        # the fallback pools all plates into one, so its largest plate is the whole condition
        .withColumn("plates", F.when(F.col("any_match"), F.col("n_plates")).otherwise(F.lit(1)))
        .withColumn("purity", F.when(~F.col("any_match"), F.lit(1.0)).otherwise(F.try_divide(F.col("largest").cast("double"), F.col("n_total"))))
        .withColumn("kept", F.col("any_control") & (F.col("n_total") >= min_cells))
    )
    purity = F.when(F.col("kept"), F.col("purity"))
    return per_condition.agg(
        F.count_if("kept").alias("n_conditions_total"),
        F.count_if(F.col("kept") & (F.col("plates") > 1)).alias("n_conditions_multi_plate"),
        F.avg(purity).alias("modal_plate_purity_mean"),
        F.percentile(purity, F.lit(0.5)).alias("modal_plate_purity_median"),
        F.coalesce(F.sum("cells_unmatched"), F.lit(0)).alias("n_cells_dropped_plate_no_control"),
        F.coalesce(F.sum("pairs_unmatched"), F.lit(0)).alias("n_condition_plate_pairs_dropped_no_control"),
        F.count_if(~F.col("any_match") & F.col("any_control")).alias("n_conditions_fallback_control"),
        F.count_if(~F.col("any_control")).alias("n_conditions_line_without_control"),
        F.count_if(~F.col("kept")).alias("n_conditions_dropped_too_few_cells"),
    )


def group_sums(placed: DataFrame) -> DataFrame:
    """(plate_id, pair_id, gene_idx) sums of the placed cells' expression: one scan of the counts."""
    return placed.groupBy("plate_id", "pair_id", "gene_idx").agg(F.sum("value").alias("s"))


def control_profiles(sums: DataFrame, controls: DataFrame) -> DataFrame:
    """Mean control profile per (plate_id, cell_line, eff_batch, gene), pooled fallback profiles included."""
    total = sums.where("pair_id IS NULL").select("plate_id", "gene_idx", "s")
    return total.join(controls, "plate_id").select(
        "plate_id", "cell_line", "eff_batch", "gene_idx", (F.col("s") / F.col("n_control")).alias("control")
    )


def line_control_profiles(profiles: DataFrame, controls: DataFrame) -> DataFrame:
    """Mean control profile per (cell_line, gene) over all its control cells."""
    own = controls.where(F.col("eff_batch") != FALLBACK)
    n = own.groupBy("cell_line").agg(F.sum("n_control").alias("n"))
    total = profiles.join(own.select("plate_id", "n_control"), "plate_id").groupBy("cell_line", "gene_idx").agg(
        F.sum(F.col("control") * F.col("n_control")).alias("s")
    )
    return total.join(n, "cell_line").select("cell_line", "gene_idx", (F.col("s") / F.col("n")).alias("control"))


def profile_entries(sums: DataFrame, matching: Matching, ctrl: DataFrame) -> DataFrame:
    """Sparse long profiles (cond_id, gene_idx, x, control).

    x is the mean over usable cells, control the cell-weighted mean of each batch's own control
    profile. Both parts meet in one aggregation on (cond_id, gene_idx).
    """
    pairs = matching.pairs.select("pair_id", "plate_id", "cond_id", "n_treated", "n_total")
    x_part = sums.where("pair_id IS NOT NULL").drop("plate_id").join(pairs, "pair_id").select(
        "cond_id", "gene_idx", "n_total", F.col("s").alias("x"), F.lit(0.0).alias("c")
    )
    c_part = pairs.join(ctrl.select("plate_id", "gene_idx", "control"), "plate_id").select(
        "cond_id", "gene_idx", "n_total", F.lit(0.0).alias("x"), (F.col("n_treated") * F.col("control")).alias("c")
    )
    n = F.max("n_total")
    return (
        x_part.unionByName(c_part)
        .groupBy("cond_id", "gene_idx")
        .agg((F.sum("x") / n).alias("x"), (F.sum("c") / n).alias("control"))
    )


def profiles(entries: DataFrame, obs: DataFrame, n_genes: int) -> DataFrame:
    """One row per condition: its metadata and dense x, control and delta arrays over the gene axis."""
    packed = entries.groupBy("cond_id").agg(
        F.sort_array(F.collect_list(F.struct("gene_idx", "x", "control"))).alias("e")
    )
    dense = obs.join(packed, "cond_id", "left").withColumn(
        "e", F.coalesce("e", F.array().cast("array<struct<gene_idx:int,x:double,control:double>>"))
    )
    return (
        dense.withColumn("x", arrays.densify(F.col("e"), "gene_idx", "x", n_genes))
        .withColumn("control", arrays.densify(F.col("e"), "gene_idx", "control", n_genes))
        .withColumn("delta", arrays.subtract(F.col("x"), F.col("control")))
        .drop("e")
    )


def unpack(frame: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Dense arrays back to long rows (keys, gene_idx, columns)."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    return frame.select(*keys, F.posexplode(zipped).alias("gene_idx", "v")).select(
        *keys, "gene_idx", *[F.col(f"v.{c}").alias(c) for c in columns]
    )
