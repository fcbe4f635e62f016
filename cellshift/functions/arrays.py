"""Dense and sparse vector expressions on array columns, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def densify(entries: Column, position: str, value: str, length: int) -> Column:
    """Dense array of `length` from an array of structs sorted by `position` (0-based); gaps are 0.0.

    Each entry contributes the zeros since its predecessor plus its own value, so the work is linear
    in the length.
    """

    def piece(entry: Column, i: Column) -> Column:
        previous = F.when(i > 0, F.get(entries, i - 1)[position]).otherwise(F.lit(-1))
        return F.concat(F.array_repeat(F.lit(0.0), entry[position] - previous - 1), F.array(entry[value]))

    last = F.coalesce(F.get(entries, F.size(entries) - 1)[position], F.lit(-1))
    return F.concat(F.flatten(F.transform(entries, piece)), F.array_repeat(F.lit(0.0), F.lit(length) - last - 1))


def gather(values: Column, positions: Column) -> Column:
    """values[p] for each p in positions."""
    return F.transform(positions, lambda p: F.get(values, p))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; -infinity when either vector has zero length."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(float("-inf"))).otherwise(F.try_divide(dot(a, b), scale))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def rounded(col: Column, digits: int = 6) -> Column:
    """Rounded double with negative zero folded into zero, for comparison across engines."""
    return F.round(col, digits) + F.lit(0.0)


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that a frame can be cogrouped with one it derives from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])
