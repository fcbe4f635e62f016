"""Cell quality control, gene detection and library-size normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellshift.config import DETECTION_FRACTION, MIN_DETECTED_CELLS, Config
from cellshift.functions.quantiles import exact_percentiles
from cellshift.sources.assay import Assay, detect_input_kind


def is_mito_name(gene: Column) -> Column:
    """Mitochondrial by symbol: upper-cased prefix 'MT-' or 'MT.'."""
    return F.upper(gene).startswith("MT-") | F.upper(gene).startswith("MT.")


def mito_gene_ids(genes: DataFrame) -> list[int]:
    """Ids of mitochondrial genes. Runs a job over the gene axis; the result is a handful of ids."""
    return [r.gene_id for r in genes.where(is_mito_name(F.col("gene"))).select("gene_id").distinct().collect()]


def _total(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["count"])


def cell_stats(assay: Assay, cfg: Config, mito_ids: list[int] | None = None) -> DataFrame:
    """The cells with n_genes, total_count, mito_count, pct_mito and the keep flags.

    Row-local: each statistic folds the cell's own vector. Without mitochondrial genes the mito
    columns are NULL and the filter keeps everything.
    """
    ids = mito_gene_ids(assay.genes) if mito_ids is None else mito_ids
    cells = assay.cells.withColumn(
        "n_genes", F.size(F.filter("features", lambda e: e["count"] > 0))
    ).withColumn("total_count", _total(F.col("features")))
    if ids:
        id_array = F.array(*[F.lit(i) for i in sorted(ids)])
        mito = _total(F.filter("features", lambda e: F.array_contains(id_array, e["gene_id"])))
        cells = cells.withColumn("mito_count", mito).withColumn(
            "pct_mito", F.coalesce(F.try_divide(F.lit(100.0) * F.col("mito_count"), F.col("total_count")), F.lit(0.0))
        )
    else:
        nothing = F.lit(None).cast("double")
        cells = cells.withColumn("mito_count", nothing).withColumn("pct_mito", nothing)
    return (
        cells.withColumn("pass_min_genes", F.col("n_genes") >= cfg.min_genes)
        .withColumn("pass_mito", F.coalesce(F.col("pct_mito") <= cfg.max_pct_mito, F.lit(True)))
        .withColumn("keep", F.col("pass_min_genes") & F.col("pass_mito"))
    )


def qc_summary(stats: DataFrame, cfg: Config) -> DataFrame:
    """One row: cell counters and, over all cells, the percentiles of pct_mito."""
    passed = F.col("pass_min_genes")
    counters = stats.agg(
        F.count("*").alias("n_cells_before_qc"),
        F.count_if(~passed).alias("n_cells_dropped_min_genes"),
        F.count_if(passed & ~F.col("pass_mito")).alias("n_cells_dropped_mito"),
        F.count_if("keep").alias("n_cells_after_qc"),
        F.count_if(F.col("pct_mito").isNotNull()).alias("_with_mito"),
        F.try_divide(
            F.count_if(passed & ~F.col("pass_mito")).cast("double"), F.greatest(F.lit(1), F.count_if(passed))
        ).alias("frac_cells_dropped_by_mito_overall"),
    )
    quantiles = exact_percentiles(
        stats, "pct_mito", {"mito_p25": 0.25, "mito_median": 0.5, "mito_p75": 0.75, "mito_p90": 0.9, "mito_p99": 0.99}
    )
    out = counters.withColumn("mito_filter_applied", F.col("_with_mito") > 0).drop("_with_mito")
    out = out.withColumn("_q", quantiles.select(F.struct("*")).scalar())  # one subquery for all percentiles
    out = out.withColumns({name: F.col("_q")[name] for name in quantiles.columns}).drop("_q")
    return out.withColumn("max_pct_mito_threshold", F.lit(float(cfg.max_pct_mito)))


def mito_drop_rates(stats: DataFrame) -> DataFrame:
    """Share of cells failing the mito filter among those with enough genes, by line and by dose.

    Controls form the 'vehicle' dose bucket. Buckets with no passing cell have a NULL rate.
    """
    dose = F.when(F.col("is_control"), "vehicle").otherwise(F.col("dose").cast("string"))
    keyed = stats.select(
        F.explode(F.array(
            F.struct(F.lit("cell_line").alias("axis"), F.col("cell_line").alias("bucket")),
            F.struct(F.lit("dose").alias("axis"), dose.alias("bucket")),
        )).alias("k"), "pass_min_genes", "pass_mito",
    )
    failed = F.count_if(F.col("pass_min_genes") & ~F.col("pass_mito")).cast("double")
    return keyed.groupBy("k.axis", "k.bucket").agg(
        F.count_if("pass_min_genes").alias("n_cells"),
        F.try_divide(failed, F.count_if("pass_min_genes")).alias("drop_rate"),
    )


def gene_detection(assay: Assay) -> DataFrame:
    """Per gene: cells with a positive count over all cells (before QC), the threshold, and `keep`."""
    n_cells = assay.cells.agg(F.count("*").alias("n")).scalar()
    detected = assay.counts().where(F.col("count") > 0).groupBy("gene_id").agg(F.count("*").alias("n_detected"))
    return (
        assay.genes.join(detected, "gene_id", "left")
        .withColumn("n_detected", F.coalesce("n_detected", F.lit(0)))
        .withColumn("threshold", F.greatest(F.lit(MIN_DETECTED_CELLS), F.ceil(F.lit(DETECTION_FRACTION) * n_cells)))
        .withColumn("keep", F.col("n_detected") >= F.col("threshold"))
    )


def median_total(stats: DataFrame) -> DataFrame:
    """One row: the median library size over all cells with a positive total (before QC)."""
    return exact_percentiles(stats.where(F.col("total_count") > 0), "total_count", {"median_total": 0.5})


def expression(
    cells: DataFrame, genes_kept: DataFrame, median: float, keys: list[str], normalize: bool = True
) -> DataFrame:
    """Long expression (keys, gene_idx, value) of kept cells on kept genes.

    value = log1p(count / total * median), the total taken over the full vector; absent entries are
    zero. Stays map-only: the vector is unnested in place and the gene axis (a table whose size the
    planner knows) is joined to it.
    """
    scaled = F.log1p(F.col("f.count") / F.col("total_count") * F.lit(median)) if normalize else F.col("f.count")
    return (
        cells.where("keep")
        .select(*keys, "total_count", F.explode("features").alias("f"))
        .where(F.col("f.count") != 0)
        .select(*keys, F.col("f.gene_id").alias("gene_id"), scaled.alias("value"))
        .join(genes_kept.select("gene_id", "gene_idx"), "gene_id")
        .drop("gene_id")
    )
