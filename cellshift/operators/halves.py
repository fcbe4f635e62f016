"""Split-half replicates: each condition's cells are halved within every batch, n_rep times.

A cell's half is decided by comparing its digest with the group's median digest, so the split is a
row-local test against a small table, and all repetitions are summed in one scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.functions import arrays, keyed
from cellshift.operators.pseudobulk import Matching, place

PURPOSE = "halves"


def half_cutoffs(
    cells: DataFrame, matching: Matching, n_rep: int, seed: int, largest_group: int, keep: Callable[[DataFrame, str], DataFrame]
) -> DataFrame:
    """(pair_id, rep, cutoff): cells with a digest up to the cutoff are the first half of their batch."""
    reps = F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1))).alias("rep")
    sizes = matching.pairs.where("n_treated >= 2").select(
        "pair_id", reps, F.floor(F.col("n_treated") / 2).alias("take"), F.col("n_treated").alias("size")
    )
    treated = place(cells, matching).where("pair_id IS NOT NULL").select("cell_id", "pair_id", reps)
    spread = treated.select("pair_id", "rep", keyed.digest(seed, PURPOSE, "rep", "cell_id").alias("key"))
    return keyed.central_cutoff(spread, sizes, ["pair_id", "rep"], "key", keyed.prefix_length(largest_group), keep)


def mark_halves(cells: DataFrame, matching: Matching, cutoffs: DataFrame, n_rep: int, seed: int) -> DataFrame:
    """Placed treated cells with `halves`, an array of flags: element r is true when the cell is in the first half of repetition r.

    Only the small tables of placements and cutoffs are joined to the wide rows.
    """
    packed = cutoffs.groupBy("pair_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rep", "cutoff"))), lambda s: s["cutoff"]).alias("cuts")
    )
    first = [keyed.digest(seed, PURPOSE, F.lit(rep), F.col("cell_id")) <= F.get("cuts", F.lit(rep)) for rep in range(n_rep)]
    return place(cells, matching).join(packed, "pair_id").withColumn("halves", F.array(*first)).drop("cuts")


def half_profiles(expr: DataFrame, matching: Matching, ctrl: DataFrame, obs: DataFrame, n_genes: int, n_rep: int) -> DataFrame:
    """(cond_id, rep, h0, h1): count-weighted means of half minus the batch's own control, dense arrays.

    expr carries the flags of `mark_halves`. The second half's sums are the totals minus the first
    half's. A condition whose batches all have a single cell has NULL halves.
    """
    firsts = [f"s{r}" for r in range(n_rep)]
    in_first = [F.when(F.get("halves", F.lit(r)), F.col("value")).otherwise(0.0) for r in range(n_rep)]
    split = matching.pairs.where("n_treated >= 2").withColumn("k0", F.floor(F.col("n_treated") / 2)).withColumn(
        "k1", F.col("n_treated") - F.col("k0")
    )
    treated = (
        expr.groupBy("pair_id", "gene_idx")
        .agg(F.sum("value").alias("s"), *[F.sum(v).alias(n) for v, n in zip(in_first, firsts)])
        .join(split.select("pair_id", "cond_id"), "pair_id")
        .select("cond_id", "gene_idx", "s", *firsts, F.lit(0.0).alias("c0"), F.lit(0.0).alias("c1"))
    )
    control = split.join(ctrl.select("plate_id", "gene_idx", "control"), "plate_id").select(
        "cond_id", "gene_idx", F.lit(0.0).alias("s"), *[F.lit(0.0).alias(n) for n in firsts],
        (F.col("k0") * F.col("control")).alias("c0"), (F.col("k1") * F.col("control")).alias("c1"),
    )
    sums = treated.unionByName(control).groupBy("cond_id", "gene_idx").agg(
        *[F.sum(n).alias(n) for n in ["s", *firsts, "c0", "c1"]]
    )
    weights = split.groupBy("cond_id").agg(F.sum("k0").alias("w0"), F.sum("k1").alias("w1"))
    halves = F.array(*[
        F.struct(
            F.lit(r).alias("rep"),
            ((F.col(f"s{r}") - F.col("c0")) / F.col("w0")).alias("h0"),
            ((F.col("s") - F.col(f"s{r}") - F.col("c1")) / F.col("w1")).alias("h1"),
        )
        for r in range(n_rep)
    ])
    packed = (
        sums.join(weights, "cond_id")
        .select("cond_id", "gene_idx", F.explode(halves).alias("h"))
        .groupBy("cond_id", "h.rep")
        .agg(F.sort_array(F.collect_list(F.struct("gene_idx", "h.h0", "h.h1"))).alias("e"))
    )
    slots = obs.select("cond_id", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1))).alias("rep"))
    return slots.join(packed, ["cond_id", "rep"], "left").select(
        "cond_id", "rep",
        F.when(F.col("e").isNotNull(), arrays.densify(F.col("e"), "gene_idx", "h0", n_genes)).alias("h0"),
        F.when(F.col("e").isNotNull(), arrays.densify(F.col("e"), "gene_idx", "h1", n_genes)).alias("h1"),
    )
