"""Small in-memory assays."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cellshift.sources.assay import Assay, assay_from_long


def assay_from_dense(spark: SparkSession, obs, matrix, gene_names: list[str], **options) -> Assay:
    """Small in-memory fixture: a pandas frame of metadata and a dense cells x genes matrix."""
    frame = obs.reset_index(drop=True).copy()
    frame.insert(0, "cell_id", range(len(frame)))
    rows = [
        (int(i), int(j), float(matrix[i][j]))
        for i in range(len(frame)) for j in range(len(gene_names)) if matrix[i][j] != 0
    ]
    counts = spark.createDataFrame(rows, "cell_id long, gene_id int, count double")
    genes = spark.createDataFrame(list(enumerate(gene_names)), "gene_id int, gene string")
    return assay_from_long(spark.createDataFrame(frame), counts, genes, **options)
