"""Operator 1: exact length histogram of encoded documents, with suffix sums.

Every text is encoded whole; equal lengths meet in one histogram row per group, so what is sorted
afterwards is the set of distinct lengths and never the documents. From the histogram, suffix sums
answer for every context limit: documents longer, tokens cut off, truncated totals and quantiles.

Defined cases: a null or empty text has length 0; a null group value is a group of its own; repeated
rows count each time; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellshift.llm.common import batch_slices, materialize, text_bytes
from cellshift.llm.encoding import default_path, encoder

BUCKET = 1024  # lengths per bucket of the two-level suffix sums


def length_histogram(docs: DataFrame, by: Sequence[str] = (), tokenizer: str | None = None) -> DataFrame:
    """(by..., length, n_docs): documents of each encoded length, counted inside each batch before the shuffle."""
    path, by = tokenizer or default_path(), list(by)
    fields = [docs.schema[c] for c in by]
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in fields], T.StructField("length", T.LongType()), T.StructField("n_docs", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batch_slices(batches):
            lengths = [len(x) // 4 for x in encode(text_bytes(batch))]
            groups = zip(*[batch.column(c).to_pylist() for c in by], lengths, strict=True)
            found = Counter(groups)
            columns = list(zip(*found, strict=True)) if found else [()] * (len(by) + 1)
            types = [batch.schema.field(c).type for c in by] + [pa.int64()]
            arrays = [pa.array(v, t) for v, t in zip(columns, types, strict=True)] + [pa.array(found.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*by, "length", "n_docs"])

    counted = docs.select(*by, "text").mapInArrow(count, schema)
    return counted.groupBy(*by, "length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct length, read as a context limit of that many tokens:

    n_docs and n_tokens at this length; docs_at_least and tokens_at_least (suffix sums, this length
    included); docs_longer (truncated at this limit); tokens_kept (total when each text is cut at this
    limit) and tokens_cut; quantile (share of documents not longer). Between two lengths the totals are
    linear in the limit. Sums run inside buckets of lengths and over the buckets' totals, in two levels.
    """
    by = list(by)
    rows = histogram.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("__bucket", F.floor(F.col("length") / BUCKET))
    totals = rows.groupBy(*by, "__bucket").agg(F.sum("n_docs").alias("__docs"), F.sum("n_tokens").alias("__tokens"))
    later = Window.partitionBy(*by).orderBy(F.col("__bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    after = totals.select(
        *[F.col(c).alias(f"__{c}") for c in by], F.col("__bucket").alias("__at"),
        *[F.coalesce(F.sum(f"__{x}").over(later), F.lit(0)).alias(f"__{x}_after") for x in ("docs", "tokens")],
        *[F.sum(f"__{x}").over(whole).alias(f"__{x}_all") for x in ("docs", "tokens")],
    )
    same = F.col("__bucket") == F.col("__at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = Window.partitionBy(*by, "__bucket").orderBy(F.col("length").desc())
    summed = rows.withColumn("__docs_in", F.sum("n_docs").over(inside)).withColumn("__tokens_in", F.sum("n_tokens").over(inside)).join(after, same)
    at_least = summed.withColumn("docs_at_least", F.col("__docs_in") + F.col("__docs_after")).withColumn("tokens_at_least", F.col("__tokens_in") + F.col("__tokens_after"))
    longer = at_least.withColumn("docs_longer", F.col("docs_at_least") - F.col("n_docs"))
    kept = longer.withColumn("tokens_kept", F.col("__tokens_all") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least"))
    return kept.select(
        *by, "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least", "docs_longer", "tokens_kept",
        (F.col("__tokens_all") - F.col("tokens_kept")).alias("tokens_cut"),
        (1 - F.col("docs_longer") / F.col("__docs_all")).alias("quantile"),
    )


def totals_at(summed: DataFrame, limits: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Any context limits, from the suffix sums: the next longer length carries all sums needed."""
    by, out = list(by), None
    for limit in limits:
        cut = F.col("length") > limit
        beyond = F.coalesce(F.max(F.when(cut, F.col("docs_at_least"))), F.lit(0))
        tokens = F.coalesce(F.max(F.when(cut, F.col("tokens_at_least"))), F.lit(0))
        one = summed.groupBy(*by).agg(
            F.lit(limit).cast("long").alias("limit"), beyond.alias("docs_longer"),
            (F.max("tokens_at_least") - tokens + F.lit(limit) * beyond).alias("tokens_kept"), (tokens - F.lit(limit) * beyond).alias("tokens_cut"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def quantiles(summed: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Shortest length that at least each share of the documents does not exceed, one column q_<share> each."""
    return summed.groupBy(*by).agg(*[F.min(F.when(F.col("quantile") >= q, F.col("length"))).alias(f"q_{q:g}") for q in shares])
