"""The assay: one row per observed cell, its counts held as a sparse vector, plus the feature axis.

Keeping a cell's counts in its own row (row-compressed storage) makes quality control and
normalisation row-local. The raw data is then scanned, filtered and partially aggregated in place;
no operator has to shuffle it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted column names in order of preference, and names of vehicle treatments.
CELL_LINE_NAMES = ["cell_line", "celltype", "cell_type", "cell_line_short"]
COMPOUND_NAMES = ["compound", "perturbation", "product_name", "drug"]
DOSE_NAMES = ["dose_value", "dose", "concentration"]
BATCH_NAMES = ["plate", "batch", "culture_plate", "hash_plate", "well", "rt_well", "pcr_well", "replicate"]
TARGET_NAMES = ["target", "pathway", "pathway_level_1", "moa", "gene_target"]
TIME_NAMES = ["time", "timepoint", "time_point", "hours", "treatment_time"]
CONTROL_VALUES = ["vehicle", "control", "dmso", "none", "untreated", "ctrl"]

NO_BATCH = "__no_batch__"
KEYS = ["cell_line", "compound", "dose", "time"]


@dataclass
class Assay:
    """cells(cell_id, cell_line, compound, dose, time, batch, target, is_control,
    features ARRAY<STRUCT<gene_id, count>>) and genes(gene_id, gene)."""

    cells: DataFrame
    genes: DataFrame
    has_batch: bool = True
    has_time: bool = True
    already_normalized: bool = False
    packed: bool = True  # False: `cells` still regroups a long table; store it before scanning it repeatedly
    source: str = ""
    detected_columns: dict = field(default_factory=dict)

    def counts(self) -> DataFrame:
        """Long view: one row per stored (cell, gene) entry."""
        return self.cells.select("cell_id", F.explode("features").alias("f")).select("cell_id", "f.gene_id", "f.count")


def pick_column(columns: list[str], candidates: list[str]) -> str | None:
    """First candidate present among the columns, ignoring case; returns the column's own spelling."""
    spelled = {c.lower(): c for c in columns}
    return next((spelled[c] for c in candidates if c in spelled), None)


def is_control_name(compound: Column) -> Column:
    return F.lower(compound).isin(CONTROL_VALUES)


def _number(name: str | None) -> Column:
    if name is None:
        return F.lit(0.0)
    parsed = F.col(name).try_cast("double")
    return F.when(parsed.isNull() | F.isnan(parsed), F.lit(0.0)).otherwise(parsed)


def standardize_cells(obs: DataFrame) -> tuple[DataFrame, dict]:
    """Map observation metadata with free column names onto the assay's cell columns."""
    names = {
        "cell_line": pick_column(obs.columns, CELL_LINE_NAMES),
        "compound": pick_column(obs.columns, COMPOUND_NAMES),
        "dose": pick_column(obs.columns, DOSE_NAMES),
        "batch": pick_column(obs.columns, BATCH_NAMES),
        "target": pick_column(obs.columns, TARGET_NAMES),
        "time": pick_column(obs.columns, TIME_NAMES),
    }
    absent = [k for k in ("cell_line", "compound", "dose") if names[k] is None]
    if absent:
        raise RuntimeError(f"no column found for {absent} among {obs.columns}; detected {names}")

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("nan"))

    keep = ["cell_id"] + (["features"] if "features" in obs.columns else [])
    cells = obs.select(
        *keep,
        text(names["cell_line"]).alias("cell_line"),
        text(names["compound"]).alias("compound"),
        _number(names["dose"]).alias("dose"),
        _number(names["time"]).alias("time"),
        (text(names["batch"]) if names["batch"] else F.lit(NO_BATCH)).alias("batch"),
        (F.col(names["target"]).cast("string") if names["target"] else F.lit(None).cast("string")).alias("target"),
        is_control_name(text(names["compound"])).alias("is_control"),
    )
    return cells, names


def assay_from_long(obs: DataFrame, counts: DataFrame, genes: DataFrame, **options) -> Assay:
    """Assay from metadata plus long counts(cell_id, gene_id, count).

    The one place where counts are shuffled: they are brought together per cell, once for both sums and
    vectors. A cell holds at most one entry per gene, so a vector is bounded by the length of the gene
    axis. Cells without any count survive with an empty vector.
    """
    cells, names = standardize_cells(obs)
    vectors = (
        counts.where(F.col("cell_id").isNotNull()).repartition("cell_id").groupBy("cell_id", "gene_id")
        .agg(F.sum(F.col("count").cast("double")).alias("count"))
        .groupBy("cell_id")
        .agg(F.collect_list(F.struct("gene_id", "count")).alias("features"))
    )
    empty = F.array().cast("array<struct<gene_id:int,count:double>>")
    vectors = vectors.withColumn("features", F.col("features").cast("array<struct<gene_id:int,count:double>>"))
    cells = cells.join(vectors, "cell_id", "left").withColumn("features", F.coalesce("features", empty))
    return Assay(
        cells, genes, has_batch=names["batch"] is not None, has_time=names["time"] is not None,
        detected_columns=names, packed=False, **options,
    )


def detect_input_kind(counts: DataFrame) -> DataFrame:
    """One row: whether long counts look like raw integers that still need normalising, judged on every entry."""
    off = F.max(F.when(F.col("count") > 0, F.abs(F.col("count") - F.rint("count"))))
    judged = counts.agg(F.coalesce(F.max("count"), F.lit(0.0)).alias("max_value"), F.coalesce(off <= 1e-6, F.lit(False)).alias("looks_integer"))
    raw = F.col("looks_integer") & (F.col("max_value") > 30)
    return judged.select("max_value", "looks_integer", F.when(raw, "raw_counts").otherwise("already_normalized_or_log").alias("detected_input"))


# --- loader registry -------------------------------------------------------------------------

Loader = Callable[[SparkSession, str], Assay]
_loaders: dict[str, Loader] = {}


def register_loader(name: str, loader: Loader) -> None:
    _loaders[name] = loader


def get_loader(name: str) -> Loader:
    if name not in _loaders:
        raise KeyError(f"no loader registered for {name!r}; registered: {sorted(_loaders)}")
    return _loaders[name]


def parquet_assay(spark: SparkSession, path: str) -> Assay:
    """Assay stored as parquet: obs, genes, and either sparse vectors in obs or a long counts table.

    Whether the values are raw counts or already normalised is judged on all of them, in one scan.
    """
    assay = _stored_assay(spark, path)
    kind = detect_input_kind(assay.counts() if assay.packed else spark.read.parquet(f"{path}/counts")).first()["detected_input"]
    return replace(assay, already_normalized=kind != "raw_counts")


def _stored_assay(spark: SparkSession, path: str) -> Assay:
    obs = spark.read.parquet(f"{path}/obs")
    genes = spark.read.parquet(f"{path}/genes").select(F.col("gene_id").cast("int").alias("gene_id"), "gene")
    if "features" in obs.columns:
        cells, names = standardize_cells(obs)
        return Assay(
            cells, genes, has_batch=names["batch"] is not None, has_time=names["time"] is not None,
            source=path, detected_columns=names,
        )
    return assay_from_long(obs, spark.read.parquet(f"{path}/counts"), genes, source=path)


register_loader("sciplex3", parquet_assay)
register_loader("parquet", parquet_assay)
