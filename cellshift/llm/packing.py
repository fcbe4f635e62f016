"""Operator 7: best-fit packing of token pieces after Martello-Toth dominance reduction.

Documents are encoded and cut into pieces of at most `capacity` tokens. Packing depends on lengths
alone, so the instance is the histogram of piece lengths: at most `capacity` rows whatever the corpus
holds. The reduction fixes sequences that dominate all alternatives (a piece that fits with nothing, a
pair that fills the sequence or that no feasible pair or triple can beat); the rest goes best-fit in
decreasing length, many equal sequences at a time. The plan comes back as runs of ranks: the r-th piece
of a length has its sequence and offset. Ranks are dealt in chunks, so a length that a third of all
documents share is never sorted in one task.

Defined cases: a null text counts as empty and is the end token alone; repeated rows are packed each
time; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.llm.common import batch_slices, gapless_rank, materialize, release, text_bytes
from cellshift.llm.encoding import default_path, encoder

CAPACITY = 4096
END = (1).to_bytes(4, "little")


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, the end token included."""
    path, key = tokenizer or default_path(), docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batch_slices(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            for at, ids in enumerate(encode(text_bytes(batch))):
                ids += END
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    rows.append((at, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            at, *columns = zip(*rows, strict=True)
            arrays = [batch.column("doc_id").take(pa.array(at, pa.int64()))]
            arrays += [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {key}, piece int, start long, length long, ids_crc32 long")


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], dict[int, int]]:
    """Sequences fixed by dominance, as (how many, [(length, times)]), and the lengths left.

    For the longest piece j left, let k be the longest that fits beside it. {j} is fixed when nothing
    fits; {j, k} when they fill the sequence, when no third piece fits beside j and another, or when no
    feasible pair beside j exceeds k and no feasible triple exists. Else j is left to best fit.
    """
    left, fixed = dict(counts), []
    lengths = sorted(left)

    def total(values: list[int], n: int) -> int | None:
        """Sum of the n smallest pieces left beside j."""
        out, need = 0, n
        for v in values:
            take = min(need, left[v])
            out, need = out + take * v, need - take
            if not need:
                return out
        return None

    def pair(values: list[int], room: int) -> int:
        """Largest sum of two pieces within room."""
        best, low, high = 0, 0, len(values) - 1
        while low <= high:
            s = values[low] + values[high]
            if low == high and left[values[low]] < 2:
                break
            if s > room:
                high -= 1
            else:
                best, low = max(best, s), low + 1
        return best

    at_j = len(lengths) - 1
    while at_j >= 0:  # longest first; pieces passed over stay partners of the shorter ones
        j = lengths[at_j]
        left[j] -= 1  # one j is looked at; the others stay candidates
        beside = lengths if left[j] else [*lengths[:at_j], *lengths[at_j + 1 :]]
        room = capacity - j
        at = bisect.bisect_right(beside, room) - 1
        if at < 0:
            fixed.append((left[j] + 1, [(j, 1)]))
            left[j] = 0
        else:
            k = beside[at]
            two, three = total(beside, 2), total(beside, 3)
            dominates = k == room or two is None or two > room
            if not dominates and (three is None or three > room):
                dominates = pair(beside[: at + 1], room) <= k
            left[j] += 1
            if not dominates:
                at_j -= 1
                continue
            times = left[j] // 2 if k == j else min(left[j], left[k])  # fewer pieces leave fewer rivals: it holds for all
            fixed.append((times, [(j, 2)] if k == j else [(j, 1), (k, 1)]))
            for x in {j, k}:
                left[x] -= times * (2 if k == j else 1)
        lengths = [x for x in lengths if left[x]]
        at_j = min(bisect.bisect_right(lengths, j) - 1, len(lengths) - 1)
    return fixed, {x: left[x] for x in lengths}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over a histogram: equal sequences are kept and filled together."""
    open_: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []  # sorted rooms that some open sequence has
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def add(room: int, times: int, held: tuple) -> None:
        if not times:
            return
        if not room:
            done.append((times, list(held)))
            return
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((times, held))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fits = capacity // length
                add(capacity - fits * length, n // fits, ((length, fits),))
                if n % fits:
                    add(capacity - n % fits * length, 1, ((length, n % fits),))
                break
            room = rooms[at]
            times, held = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            fits = room // length
            full = min(times, n // fits)
            add(room - fits * length, full, (*held, (length, fits)))
            n -= full * fits
            if full < times:
                if n:
                    add(room - n * length, 1, (*held, (length, n)))
                add(room, times - full - bool(n), held)
                n = 0
    return done + [(times, list(held)) for groups in open_.values() for times, held in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """Per length the runs of ranks, as columns first rank, first sequence, times per sequence, offset."""
    fixed, rest = reduce_dominated(counts, capacity)
    used: dict[int, int] = dict.fromkeys(counts, 0)
    runs: dict[int, list[tuple[int, int, int, int]]] = {length: [] for length in counts}
    sequence = 0
    for times, held in fixed + best_fit(rest, capacity):
        offset = 0
        for length, per in held:
            runs[length].append((used[length], sequence, per, offset))
            used[length] += times * per
            offset += length * per
        sequence += times
    return {length: np.array(r, dtype=np.int64) for length, r in runs.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces. The histogram (at most `capacity` rows) is all that the driver sees."""
    cut = materialize(cut, "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = cut.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    ranked = gapless_rank(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "__r")
    key = cut.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # all texts are encoded by now
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__r"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            by_length = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[by_length])) + 1
            for rows in np.split(by_length, cuts) if len(by_length) else []:
                size = length[rows[0]]
                run = runs.value[int(size)]
                first, base, per, at = run[np.searchsorted(run[:, 0], rank[rows], side="right") - 1].T
                step = rank[rows] - first
                sequence[rows] = base + step // per
                offset[rows] = at + step % per * size
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "__r").mapInArrow(place, f"doc_id {key}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
