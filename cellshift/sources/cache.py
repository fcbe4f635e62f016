"""Stored datasets: the derived tables of one configuration, keyed by content."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cellshift.config import DETECTION_FRACTION, Config
from cellshift.operators import hvg, pseudobulk, qc
from cellshift.plans.dataset import Build
from cellshift.plans.sweep import Sweep
from cellshift.session import data_version
import cellshift.sources.orders  # noqa: F401  (registers its loader)
from cellshift.sources.assay import get_loader

TABLES = ["genes", "obs", "profiles", "de", "half_profiles", "half_genes"]


@dataclass
class Dataset:
    """What a sweep reads: condition profiles, differential genes and half profiles."""

    cfg: Config
    genes: DataFrame
    obs: DataFrame
    profiles: DataFrame
    de: DataFrame
    half_profiles: DataFrame
    half_genes: DataFrame
    meta: dict

    @property
    def n_genes(self) -> int:
        return self.meta["n_genes_total"]

    def halves(self, genes: DataFrame) -> DataFrame:
        hvg.assert_covered(genes.select(F.lit("any").alias("fold"), "gene_idx"), self.half_genes)
        return self.half_profiles


def content_key(spark: SparkSession, cfg: Config, source: str) -> str:
    """Key of everything derived from the source as it is now: data replaced in place gets another key."""
    return cfg.cache_key(f"{source}@{data_version(spark, source)}")


def cache_path(spark: SparkSession, cfg: Config, source: str) -> str:
    return f"{cfg.cache_dir.rstrip('/')}/dataset_{cfg.dataset}_{content_key(spark, cfg, source)}"


def load_stored(spark: SparkSession, cfg: Config, source: str) -> Dataset | None:
    """The stored dataset, or None. The metadata is written last, so its presence means all tables are complete."""
    base = cache_path(spark, cfg, source)
    try:
        meta = json.loads(spark.read.text(f"{base}/meta", wholetext=True).first()[0])
        tables = {t: spark.read.parquet(f"{base}/{t}") for t in TABLES}
    except (AnalysisException, TypeError):
        return None
    return Dataset(cfg, meta=meta, **tables)


def store(build: Build, source: str) -> Dataset:
    """Build every table and write it under the content key."""
    cfg, spark = build.cfg, build.profiles.sparkSession
    base = cache_path(spark, cfg, source)
    union = hvg.gene_union(Sweep(build).selected)
    n_conditions, n_union = build.profiles.count(), union.count()
    frames = {
        "genes": build.genes, "profiles": build.profiles, "de": build.de,
        "obs": build.obs, "half_profiles": build.halves(union), "half_genes": union,
    }
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{base}/{name}")
    meta = {**dataset_meta(build, source), "n_conditions": n_conditions, "n_ceiling_reps": cfg.n_ceiling_reps, "halves_n_genes": n_union}
    spark.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/meta")
    return load_stored(spark, cfg, source)


def dataset_meta(build: Build, source: str) -> dict:
    """Counters that the report prints; a handful of one-row results."""
    assay, cfg = build.assay, build.cfg
    one = lambda df: df.first().asDict()
    rates = qc.mito_drop_rates(build.cells).collect()
    times = build.obs.where(~F.col("time").isin(0.0, 24.0)).agg(
        F.count("*").alias("n_conditions_time_ne_24"), F.coalesce(F.sum("n_cells"), F.lit(0)).alias("n_cells_in_time_ne_24_conditions")
    )
    return {
        "dataset": cfg.dataset, "source": source, "seed": cfg.seed,
        "qc": one(qc.qc_summary(build.cells, cfg)),
        "mito_drop_rate": {f"{r['axis']}={r['bucket']}": r["drop_rate"] for r in rates},
        "plate_matching": one(pseudobulk.plate_summary(build.matching, cfg.min_cells_per_condition)),
        "time_identity": one(times),
        "n_conditions_zero_de_genes": build.de.where(F.size("de") == 0).count(),
        "n_genes_before": assay.genes.count(), "n_genes_total": build.n_genes, "min_detection_fraction": DETECTION_FRACTION,
        "median_total": build.median, "batch_metadata_available": assay.has_batch, "time_metadata_available": assay.has_time,
        "detected_columns": assay.detected_columns, "min_cells_per_condition": cfg.min_cells_per_condition,
    }


def load_dataset(spark: SparkSession, cfg: Config, source: str) -> Dataset:
    """Stored tables when present, otherwise built by the loader registered for cfg.dataset and stored.

    Either way the stored half profiles are checked to cover every fold's selected genes.
    """
    found = load_stored(spark, cfg, source)
    if found is None:
        found = store(Build(get_loader(cfg.dataset)(spark, source), cfg).prepare(), source)
    hvg.assert_covered(Sweep(found).selected, found.half_genes)
    return found
