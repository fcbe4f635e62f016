"""Train-only gene selection, and aggregation over the training conditions of many folds at once.

Most conditions train in most folds. Conditions with the same set of training folds are
interchangeable for any fold-level aggregate, so values are first reduced per such set (`sig`) and
only those partial results are repeated per fold. The condition rows themselves are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def training_sets(folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cond_id, sig) and (sig, fold): conditions grouped by the set of folds they train in."""
    member = folds.where("role = 'train'").groupBy("cond_id").agg(F.sort_array(F.collect_set("fold")).alias("train_folds"))
    signed = member.withColumn("sig", F.md5(F.to_json("train_folds")))
    sets = signed.groupBy("sig").agg(F.first("train_folds").alias("train_folds"))
    return signed.select("cond_id", "sig"), sets.select("sig", F.explode("train_folds").alias("fold"))


def fold_gene_variance(profiles: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, gene_idx, var): population variance of x over each fold's training conditions.

    Partial moments per training set are combined around a common centre per gene, which keeps the
    combination free of cancellation.
    """
    cond_sig, sig_fold = training_sets(folds)
    long = profiles.join(cond_sig, "cond_id").select("sig", F.posexplode("x").alias("gene_idx", "x"))
    part = long.groupBy("sig", "gene_idx").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    centre = part.groupBy("gene_idx").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m0"))
    off = F.col("m") - F.col("m0")
    n, d = F.sum("n"), F.sum(F.col("n") * off)
    q = F.sum(F.col("n") * (F.col("v") + off * off))
    return (
        part.join(centre, "gene_idx").join(sig_fold, "sig")
        .groupBy("fold", "gene_idx").agg((q / n - (d / n) * (d / n)).alias("var"))
    )


def select_genes(variance: DataFrame, n_hvg: int | None, n_genes: int) -> DataFrame:
    """(fold, gene_idx, var): the n_hvg most variable genes of each fold; all genes when that covers the axis."""
    if n_hvg is None or n_hvg >= n_genes:
        return variance.select("fold", "gene_idx", "var")
    top = Window.partitionBy("fold").orderBy(F.desc("var"), F.desc("gene_idx"))  # one row per gene
    return variance.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= n_hvg).select("fold", "gene_idx", "var")


def all_genes(folds: DataFrame, n_genes: int) -> DataFrame:
    return folds.select("fold").distinct().select("fold", F.explode(F.sequence(F.lit(0), F.lit(n_genes - 1))).alias("gene_idx"))


def gene_lists(selected: DataFrame, limit: int | None = None) -> DataFrame:
    """(fold, genes): each fold's gene positions in ascending order, optionally only the first ones."""
    genes = F.sort_array(F.collect_list("gene_idx"))
    return selected.groupBy("fold").agg((F.slice(genes, 1, limit) if limit else genes).alias("genes"))


def gene_union(selected: DataFrame) -> DataFrame:
    return selected.select("gene_idx").distinct()


def uncovered_genes(selected: DataFrame, available: DataFrame) -> DataFrame:
    """(fold, gene_idx) pairs that a stored half-profile table does not cover; must be empty."""
    return selected.join(available, "gene_idx", "left_anti")


def assert_covered(selected: DataFrame, available: DataFrame) -> None:
    missing = uncovered_genes(selected, available).limit(10).collect()
    if missing:
        raise AssertionError(f"half profiles do not cover fold genes, e.g. {[r.asDict() for r in missing]}; rebuild the derived tables")


def train_means(
    profiles: DataFrame, folds: DataFrame, selected: DataFrame, column: str, keys: list[str], wanted: DataFrame | None = None
) -> DataFrame:
    """(fold, keys, mean): mean of an array column over training conditions sharing the keys.

    `mean` is an array over the fold's selected genes, ascending. `wanted` (fold, keys) limits the
    result to the combinations somebody asks for.
    """
    cond_sig, sig_fold = training_sets(folds)
    long = profiles.join(cond_sig, "cond_id").select("sig", *keys, F.posexplode(column).alias("gene_idx", "v"))
    part = long.groupBy("sig", *keys, "gene_idx").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    if wanted is None:
        part = part.join(sig_fold, "sig")
    else:
        asked = (
            profiles.join(cond_sig, "cond_id").select("sig", *keys).distinct().join(sig_fold, "sig")
            .join(wanted, ["fold", *keys], "left_semi")
        )
        part = part.join(asked, ["sig", *keys])
    means = (
        part.join(selected, ["fold", "gene_idx"], "left_semi")
        .groupBy("fold", *keys, "gene_idx").agg((F.sum("s") / F.sum("n")).alias("m"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("gene_idx", "m")))
    return means.groupBy("fold", *keys).agg(F.transform(ordered, lambda e: e["m"]).alias("mean"))
