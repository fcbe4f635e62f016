"""Assay view of the order tables, so the engine can run on them.

An order is a cell, its customer's market segment the cell line, the order priority the compound
('4-NOT SPECIFIED' is the control), the order status the dose, the order year the batch, and the
brand of the ordered parts the gene; counts are summed quantities. With `planted`, every order of
two priorities carries extra units of fixed brands, growing with dose, so that the data contains a
known response; nothing found in it is a real signal.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellshift.sources.assay import Assay, assay_from_long, register_loader

DOSES = {"F": 10.0, "O": 100.0, "P": 1000.0}
TARGETS = {"1-URGENT": "TARGET1", "2-HIGH": "TARGET1", "3-MEDIUM": "TARGET2", "5-LOW": "unknown"}
PLANTED = {"1-URGENT": [3, 7, 11, 15], "3-MEDIUM": [5, 7, 19]}
PLANTED_UNITS = {10.0: 20.0, 100.0: 40.0, 1000.0: 60.0}
MITO_BRANDS = {24: "MT.", 25: "mt-"}


def _mapped(col, pairs: dict):
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[col]


def orders_assay(
    spark: SparkSession,
    sf_dir: str,
    planted: bool = True,
    half_year_time: bool = False,
    with_batch: bool = True,
    drop_controls_of_batch: str | None = None,
    fallback_line: str | None = None,
) -> Assay:
    """Variants: `half_year_time` splits conditions by half-year; `with_batch=False` hides the
    batches; `drop_controls_of_batch` removes one batch's controls everywhere; `fallback_line`
    moves that line's '2-HIGH' cells to batches without any control, which forces the
    pooled-control fallback for them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")

    control = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    month = F.month("o_orderdate")
    obs = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("cell_id"),
        F.col("c_mktsegment").alias("cell_line"),
        F.when(control, "control").otherwise(F.col("o_orderpriority")).alias("compound"),
        F.when(control, 0.0).otherwise(_mapped(F.col("o_orderstatus"), DOSES)).alias("dose"),
        (F.when(control | (month <= 6), 24.0).otherwise(72.0) if half_year_time else F.lit(24.0)).alias("time"),
        F.year("o_orderdate").cast("string").alias("batch"),
        _mapped(F.col("o_orderpriority"), TARGETS).alias("target"),
    )
    if drop_controls_of_batch:
        obs = obs.where(~((F.col("compound") == "control") & (F.col("batch") == drop_controls_of_batch)))
    if fallback_line:
        stray = (F.col("cell_line") == fallback_line) & (F.col("compound") == "2-HIGH")
        obs = obs.withColumn("batch", F.when(stray, F.concat(F.lit("x"), F.col("batch"))).otherwise(F.col("batch")))
    if not with_batch:
        obs = obs.drop("batch")

    gene_id = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("int")
    counts = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("cell_id"), gene_id.alias("gene_id"), F.col("l_quantity").alias("count")
    )
    if planted:
        brands = F.create_map(*[x for k, v in PLANTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        extra = obs.select(
            "cell_id", F.explode(brands[F.col("compound")]).alias("gene_id"),
            _mapped(F.col("dose"), PLANTED_UNITS).alias("count"),
        )
        counts = counts.unionByName(extra)
    counts = counts.where(F.col("gene_id").isNotNull())

    prefix = F.coalesce(_mapped(F.col("gene_id"), MITO_BRANDS), F.lit(""))
    genes = (
        part.select(gene_id.alias("gene_id"), "p_brand").distinct()
        .select("gene_id", F.concat(prefix, F.col("p_brand")).alias("gene"))
    )
    return assay_from_long(obs, counts, genes, source=sf_dir)


register_loader("orders", orders_assay)
