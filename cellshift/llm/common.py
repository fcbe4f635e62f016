"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellshift.session import discard, materialize

__all__ = ["batch_slices", "discard", "gapless_rank", "held_out", "kept", "let", "materialize", "read", "release", "stratified", "text_bytes"]

_kept: dict[tuple, Any] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task, one thing at a time: workers serve one stage after the other, and
    without that they would hold the models of all of them."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Let go of what this worker keeps; the allocator gives back what is free. Tasks that need none of it begin so."""
    _kept.clear()
    pa.default_memory_pool().release_unused()


def batch_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `limit` bytes of text at most, one row at least: long texts bound memory."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start)
        del batch, sizes  # not held while the next batch is read
        pa.default_memory_pool().release_unused()


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], out: str, rows_per_chunk: int = 20_000) -> DataFrame:
    """Adds a rank from 0 without gaps within keys, no key being sorted in one task.

    Rows of a key are dealt to chunks by the hash of their order columns, ranked inside the chunk and
    shifted by the sizes of the chunks before. Equal rows take neighbouring ranks in any order.
    """
    chunks = max(1, -(-df.count() // rows_per_chunk))
    dealt = df.withColumn("__chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy(*keys, "__chunk").agg(F.count("*").alias("__n")).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("__chunk").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(*order)) - 1
    same = F.col("__chunk") == F.col("__at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    ranked = dealt.withColumn("__rank", inside).join(shifts, same, "left")
    return ranked.withColumn(out, F.col("__rank") + F.col("__shift")).drop("__chunk", "__rank", "__at", "__shift", *[f"__{k}" for k in keys])


def stratified(df: DataFrame, stratum: str, per_stratum: int, key: str = "doc_id", total: int = 200_000) -> DataFrame:
    """At most per_stratum rows of each stratum, those of smallest key hash: a bounded sample to fit a model on. With so
    many strata that this exceeds total, each gives an equal part of total, one row at least.

    Counts per stratum come first, then a hash threshold per stratum leaves about twice the rows wanted, and
    only these are ranked. Rows with a null key or stratum are not drawn.
    """
    usable = df.where(F.col(key).isNotNull() & F.col(stratum).isNotNull())
    counts = materialize(usable.groupBy(stratum).count(), "strata")  # its size is known to the planner
    wanted = max(1, min(per_stratum, total // max(1, counts.count())))
    mark, steps = F.xxhash64(F.col(key), F.lit("sample")), 1 << 20
    share = F.least(F.lit(1.0), F.lit(2.0 * wanted + 32) / F.col("count"))
    drawn = usable.join(counts, stratum).where(F.pmod(mark, F.lit(steps)) < share * steps)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(mark))
    return drawn.withColumn("__rank", rank).where(F.col("__rank") <= wanted).drop("__rank", "count")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: the optimiser merges projections and would otherwise repeat a costly
    expression at each mention, inside lambdas even for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
