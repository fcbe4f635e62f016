"""Operator 11: what filters do to each other in every order, audited with wide packed counters.

Five filters give a document a mask of those it fails. What a mask does under all orders is fixed: for each order and
step it is kept, removed there, or redundant (fails a filter that comes after the one that removed it), and, where the
labels say so, a good or toxic one lost. Each mask and label becomes one wide integer that holds a field for every
outcome of all 120 * 5 steps. A document adds its mask's integer to that of its part; integers are added in
tasks, then in a bounded fan-in by part and task group, then by part, and unpacked once. A field is as wide as the
number of all documents needs, counted first, so no sum runs into its neighbour. What depends on a filter alone is read
off the same fields: documents that fail it only are those it removes as the last step, and its removals
over all orders add up to the shapley column.

Texts are read once. Equal texts are found by SHA-256 digest: a digest's smallest doc_id is aggregated before the
shuffle, digests of one row are dropped, and those that hold over 1 / HOT of all rows (HOT at most) are joined by
broadcast while their rows keep out of the shuffle, so a group of copies of any size is no hot key.

Defined cases: a null text is an empty one, a null lang the part of the empty string; a null doc_id has no label, is no
smaller id and has no smaller one; repeated rows count each, and rows of one doc_id and text are no copies of each
other; of labels of one doc_id any that says 1 counts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.llm.common import batch_slices, materialize, text_bytes

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTERS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 100, 80, 10, b"#$%&*|"
HOT, FAN_IN, HELD = 10_000, 64, 256  # broadcast digests at most; task groups a part is added in; integers a task holds

_UPPER = bytes(range(65, 91))
_NO_UPPER = bytes(b for b in range(256) if b not in _UPPER)
_CONTINUED = bytes(range(0x80, 0xC0))
_NO_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)


def text_mask(text: bytes | None) -> int:
    """Bits 0 to 3: whether A to D fail. Words are split at ASCII blanks, code points are bytes that continue none."""
    text = text or b""
    words = text.split()
    failed = int(len(words) < MIN_WORDS)
    failed |= (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
    failed |= (100 * len(text.translate(None, _NO_UPPER)) > UPPER_PERCENT * len(text.translate(None, _CONTINUED))) << 2
    return failed | bool(text.translate(None, _NO_SYMBOL)) << 3


def outcomes(mask: int, good: bool, toxic: bool) -> Iterator[int]:
    """0 or 1 for each counter of each step of each order."""
    for order in ORDERS:
        gone = False
        for letter in order:
            fails = bool(mask >> FILTERS.index(letter) & 1)
            here = fails and not gone
            yield from (not (gone or fails), here, fails and gone, here and good, here and toxic)
            gone |= here


def packed(mask: int, good: bool, toxic: bool, width: int) -> int:
    """The outcomes of one document, a field of `width` bits each, the first lowest."""
    return sum(1 << i * width for i, yes in enumerate(outcomes(mask, good, toxic)) if yes)


def unpacked(total: int, width: int) -> np.ndarray:
    """Fields of a sum: one row per order and step, one column per counter."""
    count = len(ORDERS) * len(FILTERS) * len(COUNTERS)
    bits = np.unpackbits(np.frombuffer(total.to_bytes(-(-count * width // 8), "little"), dtype=np.uint8), bitorder="little", count=count * width)
    return (bits.reshape(count, width).astype(np.int64) << np.arange(width)).sum(axis=1).reshape(-1, len(COUNTERS))


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest, row): mask of A to D; digest names the text, row the row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches):
            texts = text_bytes(batch)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("part"), pa.array([text_mask(t) for t in texts], pa.int32()),
                pa.array([hashlib.sha256(t or b"").digest() for t in texts], pa.binary()),
            ], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(compute, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary").withColumn("row", F.monotonically_increasing_id())


def with_copies(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows with bit 4 of mask set where a smaller doc_id has the same digest."""
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts.withColumnRenamed("digest", "d"), "audit-copies")
    often = F.col("n") * HOT > n_rows  # fewer than HOT digests can
    hot, rest = firsts.where(often), firsts.where(~often)
    if not hot.isEmpty():
        rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("d"), "left").drop("d")
        # what has met its first id is dealt by its row, away from the other digests
        hot_row = F.col("n").isNotNull()
        rows = rows.withColumn("digest", F.when(hot_row, F.unhex(F.lpad(F.hex("row"), 16, "0"))).otherwise(F.col("digest"))).drop("n")
    else:
        rows = rows.withColumn("first", F.lit(None).cast(rows.schema["doc_id"].dataType))
    rows = rows.join(rest.select("d", F.col("first").alias("own")), F.col("digest") == F.col("d"), "left")
    copied = F.coalesce(F.col("doc_id") > F.coalesce("first", "own"), F.lit(False))
    return rows.select("doc_id", "part", "row", F.when(copied, F.col("mask").bitwiseOR(F.lit(16))).otherwise(F.col("mask")).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic); rows without an id are dealt apart, as they meet no label."""
    told = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("l")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"),
    ).withColumn("m", F.lit(-1).cast("long"))
    dealt = F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(-1)
    keyed = rows.withColumn("__id", F.coalesce("doc_id", F.lit(0))).withColumn("__dealt", dealt)
    met = keyed.join(told, (F.col("__id") == F.col("l")) & (F.col("__dealt") == F.col("m")), "left")
    return met.select("part", "mask", (F.coalesce("q", F.lit(0)) == 1).alias("good"), (F.coalesce("t", F.lit(0)) == 1).alias("toxic"))


def wide_sums(rows: DataFrame, width: int) -> DataFrame:
    """(part, task, total): the integers of a task's rows, added up per part; a task holds HELD of them and hands on full ones."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[int, int] = {}
        totals: dict[str, int] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(totals, pa.string()), pa.array([_bytes(x) for x in totals.values()], pa.binary())], names=["part", "total"])
            totals.clear()
            return out

        for batch in batches:
            code = batch.column("mask").to_numpy() + 32 * batch.column("good").to_numpy(zero_copy_only=False) + 64 * batch.column("toxic").to_numpy(zero_copy_only=False)
            parts = batch.column("part").dictionary_encode()
            met, times = np.unique(parts.indices.to_numpy().astype(np.int64) * 128 + code, return_counts=True)
            names = parts.dictionary.to_pylist()
            for x, n in zip(met.tolist(), times.tolist(), strict=True):
                kind = x % 128
                if kind not in table:
                    table[kind] = packed(kind & 31, bool(kind & 32), bool(kind & 64), width)
                name = names[x // 128]
                totals[name] = totals.get(name, 0) + n * table[kind]
                if len(totals) >= HELD:
                    yield handed()
        if totals:
            yield handed()

    return rows.mapInArrow(compute, "part string, total binary").withColumn("task", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))


def _bytes(x: int) -> bytes:
    return x.to_bytes(-(-x.bit_length() // 8), "little")


def added(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total): integers of equal keys added one after the other."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, 0
        schema = pa.schema([("part", pa.string()), *([("task", pa.int32())] if "task" in keys else []), ("total", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != key:
                    if key is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(keys, key, strict=True), total=_bytes(total))], schema)
                    key, total = now, 0
                total += int.from_bytes(row["total"], "little")
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(keys, key, strict=True), total=_bytes(total))], schema)

    ordered = sums.select(*keys, "total").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(compute, ", ".join([*(f"{k} {'int' if k == 'task' else 'string'}" for k in keys), "total binary"]))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    scanned = materialize(masks(docs), "audit-masks")
    n_rows = scanned.count()
    width = max(1, n_rows.bit_length())  # a field counts n_rows documents at most
    sums = added(added(wide_sums(labelled(with_copies(scanned, n_rows), labels), width), ["part", "task"]), ["part"])
    letters = [x for order in ORDERS for x in order]
    last = {order[-1]: 5 * i + 4 for i, order in enumerate(ORDERS)}  # a row at which each filter comes last
    counters = {"kept": 0, "removed": 1, "redundant": 2, "good_lost": 3, "toxic_lost": 4}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fields = unpacked(int.from_bytes(row["total"], "little"), width)
                removed = fields[:, 1]
                alone = {x: int(removed[at]) for x, at in last.items()}
                shapley = {x: int(removed[[y == x for y in letters]].sum()) for x in FILTERS}
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(letters)), pa.array([o for o in ORDERS for _ in FILTERS]), pa.array([*range(1, 6)] * len(ORDERS), pa.int32()), pa.array(letters),
                    *[pa.array(fields[:, i]) for i in counters.values()], pa.array([alone[x] for x in letters]), pa.array([shapley[x] for x in letters]),
                ], names=["part", "filter_order", "step", "filter", *counters, "unique_fails", "shapley"])

    return sums.mapInArrow(unpack, "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, good_lost long, toxic_lost long, unique_fails long, shapley long")
