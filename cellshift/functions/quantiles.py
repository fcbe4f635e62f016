"""Exact linear-interpolation percentiles of large columns, in two counting passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_BUCKETS = 4096


def exact_percentiles(df: DataFrame, value: str | Column, probs: dict[str, float]) -> DataFrame:
    """One row, one column per entry of `probs` (name -> probability); NULL on empty input.

    Values are first collapsed to a histogram of distinct values, the histogram is counted into
    equal-width buckets, and only the buckets that contain a wanted order statistic are sorted. No
    task ever sees more than one bucket's distinct values.
    """
    hist = (
        df.select(F.col(value).alias("v") if isinstance(value, str) else value.alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy("v")
        .agg(F.count("*").alias("n"))
    )
    span = hist.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    known = span.select(F.struct("lo", "hi", "total")).scalar()
    position = F.coalesce(F.try_divide((F.col("v") - known["lo"]) * N_BUCKETS, known["hi"] - known["lo"]), F.lit(0.0))
    bucketed = hist.withColumn("b", F.least(F.floor(position), F.lit(N_BUCKETS - 1)).cast("int"))

    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most N_BUCKETS rows
    sizes = (
        bucketed.groupBy("b")
        .agg(F.sum("n").alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    )
    ranks = F.array(*[F.lit(p) * (F.col("total") - 1) for p in probs.values()])
    wanted = F.transform(
        ranks,
        lambda r: F.struct(F.floor(r).alias("k0"), F.ceil(r).alias("k1"), (r - F.floor(r)).alias("frac")),
    )
    after = F.col("before") + F.col("size")
    held = lambda k: (k >= F.col("before")) & (k < after)
    hits = (
        sizes.withColumn("total", known["total"])
        .withColumn("w", wanted)
        .where(F.exists("w", lambda w: held(w["k0"]) | held(w["k1"])))
        .select("b", "before", "w")
    )
    inside = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.join(hits, "b").withColumn("first", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))

    def order_statistic(i: int, k: str) -> Column:
        at = F.col("w")[i][k]
        return F.max(F.when((F.col("first") <= at) & (at < F.col("first") + F.col("n")), F.col("v")))

    out = []
    for i, name in enumerate(probs):
        low, high = order_statistic(i, "k0"), order_statistic(i, "k1")
        out.append((low + F.max(F.col("w")[i]["frac"]) * (high - low)).alias(name))
    return placed.agg(*out)
