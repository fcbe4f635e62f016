"""Operator 5: SimHash near-duplicates, compared bit plane by bit plane.

Fingerprints: majority bits of the XXH64 hashes of word shingles. Exact copies collapse to one row per
fingerprint before anything is compared. Two fingerprints within the radius agree on all bits of some
choice of bands (pigeonhole), so each is dealt under every such choice; only rows of one cell are compared.
Inside a task, rows lie in tiles of 64 lanes: bit b of a tile's rows is one 64-bit word. A row is held
against a whole tile by XOR with its own bit, and a carry-save counter of two planes adds up to 64
distances at once; tiles whose lanes have all passed the radius are abandoned.

A cell never emits pairs: it unites linked rows on the spot and gives each row one edge to its cell's
root. Cells above `cell_rows` are cut into a grid of blocks, each pair of blocks in a cell of its own, so
that every pair is still compared and no task takes an unbounded group. Edges meet in connected
components by alternating large and small stars, written to the shared folder after each round.

Defined cases: null and empty texts have fingerprint zero and link like any other; rows with a null
doc_id take part, but a component's id is its smallest doc_id that is not null; repeated rows are
returned each time; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.llm.common import batch_slices, materialize, text_bytes

SEED = 42
CELL_ROWS = 4096
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes | None, width: int) -> list[int]:
    """XXH64 of each run of `width` words, repeats included; of all words when there are fewer."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined, starts, at = b" ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = starts[width:] + [at]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends, strict=False)]


def majority(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n documents: a bit is set if it is in over half of a document's hashes."""
    votes = np.zeros((n, 64), dtype=np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)  # little-endian
    for i in range(8):
        seen = np.bincount(owner * 256 + octets[:, i], minlength=256 * n).reshape(n, 256)
        votes[:, 8 * i : 8 * i + 8] = seen @ _BITS
    total = np.bincount(owner, minlength=n)
    return np.packbits(votes * 2 > total[:, None], axis=1, bitorder="little").view(np.uint64).reshape(n)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): 64-bit fingerprints as signed longs."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, limit=2 << 20):
            found = [np.array(shingle_hashes(t, width), dtype=np.uint64) for t in text_bytes(batch)]
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
            fp = majority(np.concatenate(found), owner, len(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(compute, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def band_masks(radius: int, spare: int = 2) -> list[int]:
    """Masks such that two words within the radius agree under at least one: radius + spare bands, `spare` of them kept."""
    n = radius + spare
    edges = [round(64 * i / n) for i in range(n + 1)]
    bands = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(bands, spare)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_sorted(keys: np.ndarray, fps: np.ndarray, radius: int, block: int = 1 << 14) -> np.ndarray:
    """Root row of each row. Rows are sorted by key; rows of one key within the radius are united."""
    n = len(fps)
    root = np.arange(n)
    if n < 2:
        return root
    change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    end = np.repeat(np.append(change, n), np.diff(np.concatenate(([0], change, [n]))))  # of each row's cell
    bits = (fps[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    padded = np.zeros((-(-n // 64) * 64, 64), dtype=np.uint8)
    padded[:n] = bits
    planes = np.packbits(padded.reshape(-1, 64, 64), axis=1, bitorder="little")  # tile, 8 bytes, bit
    planes = np.ascontiguousarray(planes.transpose(2, 0, 1)).view(np.uint64).reshape(64, -1)
    own = (np.uint64(0) - bits).T  # all ones where the row's bit is set
    rows = np.flatnonzero(end - np.arange(n) > 1)
    first, last = (rows + 1) // 64, (end[rows] - 1) // 64
    per = last - first + 1
    stops = np.cumsum(per)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    width = max(1, int(radius).bit_length())
    start = (1 << width) - 1 - radius  # counters overflow once the distance passes the radius
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(stops, (stops[a - 1] if a else 0) + block, side="right")))
        i = np.repeat(rows[a:b], per[a:b])
        tile = np.arange(len(i)) - np.repeat(stops[a:b] - per[a:b] - (stops[a - 1] if a else 0), per[a:b]) + np.repeat(first[a:b], per[a:b])
        low = np.clip(i + 1 - 64 * tile, 0, 63).astype(np.uint64)
        high = np.clip(64 * tile + 64 - end[i], 0, 63).astype(np.uint64)
        near = (ones << low) & (ones >> high)  # lanes after the row, in its cell, still within the radius
        counter = [np.full(len(i), ones if start >> w & 1 else np.uint64(0)) for w in range(width)]
        for bit in range(64):
            carry = planes[bit, tile] ^ own[bit, i]
            for w in range(width):
                counter[w], carry = counter[w] ^ carry, counter[w] & carry
            near &= ~carry
            if bit % 8 == 7 and bit < 63:
                kept = np.flatnonzero(near)
                if len(kept) < len(i):  # abandon tiles with no lane left
                    i, tile, near, counter = i[kept], tile[kept], near[kept], [c[kept] for c in counter]
                if not len(i):
                    break
        if len(i):
            at, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            unite(root, i[at], 64 * tile[at] + lane)
        a = b
    return root


def unite(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the trees of left and right rows, in place; roots are the smallest rows."""
    while len(left):
        a, b = root[left], root[right]
        differ = a != b
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        if not len(left):
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def links(distinct: DataFrame, radius: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(u, v): edges that connect all fingerprints (column fp, distinct) within the radius, one per row and cell at most."""
    masks = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("band")) for k, m in enumerate(band_masks(radius))])
    dealt = distinct.select("fp", F.explode(masks).alias("x")).select("fp", F.xxhash64("x.mask", "x.band").alias("cell"))
    half = max(1, cell_rows // 2)
    hot = dealt.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select(F.col("cell").alias("hot"), F.ceil(F.col("n") / half).cast("int").alias("blocks"))
    gridded = dealt.join(hot, F.col("cell") == F.col("hot"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("cell", F.least(own, j), F.greatest(own, j)))
    cells = gridded.select("fp", F.explode(F.when(F.col("blocks") == 1, F.array("cell")).otherwise(grid)).alias("cell"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(parts):
            keys, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
            root = link_sorted(keys, fps, radius)
            rows = np.flatnonzero(root != np.arange(len(root)))
            signed = fps.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[rows]), pa.array(signed[root[rows]])], names=["u", "v"])

        for batch in batches:  # sorted by cell; the last cell of a batch may go on in the next
            keys = batch.column("cell").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            at = int(np.searchsorted(keys, keys[-1]))
            held.append((keys[:at], fps[:at]))
            if at:
                yield flush(held)
                held = []
            held.append((keys[at:], fps[at:]))
        if held:
            yield flush(held)

    return cells.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(compare, "u long, v long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes without edges are absent.

    Large star: every node hands its larger neighbours to the smallest node it knows. Small star: every
    node hands itself and its smaller neighbours to the smallest. Repeated until nothing changes.
    """

    def centred(rows: DataFrame) -> DataFrame:
        """rows (u, v): adds the smallest of each u and its v; summed up before the shuffle, joined back so that AQE can split a hot u."""
        least = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return rows.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c"))

    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        large = centred(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        starred = centred(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        small = starred.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits; the smallest doc_id reachable over links."""
    marked = materialize(fingerprints(docs, width), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    classed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classed.join(ids.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return marked.join(named, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
