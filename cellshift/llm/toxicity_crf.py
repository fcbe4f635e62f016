"""Operator 2: toxic spans by a linear-chain conditional random field over two tags.

Labels mark documents, not words, so token labels are made first: over a bounded sample of labelled
documents Spark counts in how many toxic and clean ones each word and each word beginning occurs; those that
chance cannot explain mark their tokens in toxic documents. Their occurrences in clean documents stay clean. The field is fitted to windows around such
tokens and windows of clean texts (own, previous and next word's features, hashed; transitions), so that it
learns from context and word parts what the counts are too thin for. Forward-backward marginals of whole
texts aggregate to three figures (highest log-odds, expected toxic tokens, their density) that a logistic
curve, fitted to the sampled documents, turns into the document's score; offsets of likely toxic tokens are
returned as spans.

Word scores depend on the word alone and are kept per worker. The two passes run as a scan over chunks of
CHUNK tokens: a product of 2x2 matrices per chunk, messages from chunk to chunk, then all chunks at once.

The fit uses at most PER_CLASS documents of each label. Defined cases: null and empty texts and texts
without words have the lowest score and no spans; several labels of one document count as toxic if any is;
without labels of both kinds every score is 0; repeated rows are scored each time.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.llm.common import batch_slices, kept, materialize, release, stratified, text_bytes

PER_CLASS = 2500
FLOOR = -2.0
DIM, REACH, WINDOWS_PER_DOC, CHUNK = 1 << 18, 12, 3, 64
_WORD = re.compile(r"[^\W_]+")
STARTS = (4, 5, 6, 7, 8)  # lengths of word beginnings that count as features
N_FEATURES = 2 + len(STARTS) + 4


def tokens(text: str) -> list[str]:
    return _WORD.findall(lowered(text))


def lowered(text: str) -> str:
    """Lower case with every offset kept."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _slot(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}{value}".encode("utf-8", "replace")) % DIM


def features(word: str) -> tuple[list[int], list[int], list[int]]:
    """Slots of a word's features (a constant, itself, its beginnings) for its own tag, for the next word's and for the previous word's."""
    own = [_slot("bias", ""), _slot("w", word), *[_slot("p", word[:k]) if len(word) >= k else DIM for k in STARTS]]
    return own, [_slot("x", word), _slot("y", word[:4])], [_slot("u", word), _slot("v", word[:4])]


@dataclass
class Model:
    weights: np.ndarray  # per slot: log-odds of the toxic tag
    moves: np.ndarray  # 2 x 2 transition scores; a text starts as if after a clean token
    curve: np.ndarray  # bias and weights of the document features
    centre: np.ndarray
    spread: np.ndarray


@dataclass
class WordScores:
    """Scores of words seen by this worker, grown on demand."""

    weights: np.ndarray
    limit: int = 200_000  # words, about 40 MB; a worker that is full starts anew
    index: dict = field(default_factory=dict)
    values: np.ndarray = field(default_factory=lambda: np.zeros((1 << 16, 3), dtype=np.float32))

    def rows(self, words: list[str]) -> np.ndarray:
        index = self.index
        if len(index) > self.limit:
            index.clear()
        found = list(map(index.get, words))
        if None in found:
            for i, row in enumerate(found):
                if row is None:
                    row = index.get(words[i])
                    if row is None:
                        row = index[words[i]] = len(index)
                        if row == len(self.values):
                            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
                        self.values[row] = [sum(self.weights[x] for x in s if x < DIM) for s in features(words[i])]
                    found[i] = row
        return np.array(found, dtype=np.int64)


def emissions(scores: WordScores, words: list[str]) -> np.ndarray:
    rows = scores.rows(words)  # may grow the table
    e = scores.values[rows] if words else np.zeros((0, 3), np.float32)
    out = e[:, 0].astype(np.float64)
    out[1:] += e[:-1, 1]
    out[:-1] += e[1:, 2]
    return out


def marginals(emission: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Log-odds of the toxic tag for each token of each sequence, by forward-backward over chunks."""
    lengths = np.array([len(e) for e in emission])
    chunks = -(-lengths // CHUNK)
    first = np.concatenate(([0], np.cumsum(chunks)))
    n = int(first[-1])
    if not n:
        return [np.zeros(0) for _ in emission]
    flat, real = np.zeros(n * CHUNK), np.zeros(n * CHUNK, dtype=bool)
    for e, at in zip(emission, first, strict=False):
        flat[at * CHUNK : at * CHUNK + len(e)] = e
        real[at * CHUNK : at * CHUNK + len(e)] = True
    w = np.exp(np.clip(flat, -30, 30)).reshape(n, CHUNK).T  # step, chunk
    real = real.reshape(n, CHUNK).T
    m = np.exp(moves)
    product = np.tile(np.eye(2)[:, :, None], (1, 1, n))
    for t in range(CHUNK):  # transfer matrix of each chunk
        clean, toxic = product[:, 0] * m[0, 0] + product[:, 1] * m[1, 0], (product[:, 0] * m[0, 1] + product[:, 1] * m[1, 1]) * w[t]
        step = np.stack([clean, toxic], axis=1)
        step /= step.max(axis=(0, 1))
        product = np.where(real[t], step, product)
    into, outof = np.ones((2, n)), np.ones((2, n))
    into[1, first[:-1][chunks > 0]] = 0
    order = np.argsort(-chunks, kind="stable")
    for c in range(int(chunks.max()) - 1):  # messages from chunk to chunk
        at = first[order[: int((chunks > c + 1).sum())]] + c
        f = np.einsum("an,abn->bn", into[:, at], product[:, :, at])
        into[:, at + 1] = f / f.sum(axis=0)
        back = first[order[: len(at)]] + chunks[order[: len(at)]] - 1 - c
        b = np.einsum("abn,bn->an", product[:, :, back], outof[:, back])
        outof[:, back - 1] = b / b.sum(axis=0)
    ahead = np.empty((CHUNK, n))  # log ratio of forward messages
    a0, a1 = into
    for t in range(CHUNK):
        b0, b1 = a0 * m[0, 0] + a1 * m[1, 0], (a0 * m[0, 1] + a1 * m[1, 1]) * w[t]
        s = b0 + b1
        a0, a1 = np.where(real[t], b0 / s, a0), np.where(real[t], b1 / s, a1)
        ahead[t] = np.log(np.maximum(a1, 1e-300)) - np.log(np.maximum(a0, 1e-300))
    odds = np.empty((CHUNK, n))
    b0, b1 = outof
    for t in range(CHUNK - 1, -1, -1):
        odds[t] = ahead[t] + np.log(b1) - np.log(b0)
        c0, c1 = m[0, 0] * b0 + m[0, 1] * w[t] * b1, m[1, 0] * b0 + m[1, 1] * w[t] * b1
        s = c0 + c1
        b0, b1 = np.where(real[t], c0 / s, b0), np.where(real[t], c1 / s, b1)
    odds = odds.T.reshape(-1)
    return [odds[at * CHUNK : at * CHUNK + k] for at, k in zip(first, lengths, strict=False)]


def summary(odds: np.ndarray) -> list[float]:
    """Highest log-odds, expected toxic tokens (log), their share (log); tokens below FLOOR are plainly clean and count alike."""
    if not len(odds):
        return [FLOOR, 0.0, 0.0]
    p = np.where(odds > FLOOR, 1 / (1 + np.exp(-np.clip(odds, -30, 30))), 0)
    return [float(np.clip(odds.max(), FLOOR, -4 * FLOOR)), float(np.log1p(p.sum())), float(np.log1p(100 * p.mean()))]


def train_field(words: list[list[str]], tags: list[list[int]], epochs: int = 6, batch: int = 128, rate: float = 0.4, decay: float = 1e-5, hide: float = 0.25, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Adagrad on the conditional log-likelihood of tagged windows of equal length at most 2 * REACH + 1."""
    rng, width = np.random.default_rng(seed), 2 * REACH + 1
    slots = {w: features(w) for ws in words for w in ws}
    pad = ([DIM] * (2 + len(STARTS)), [DIM] * 2, [DIM] * 2)
    n = len(words)
    ids, gold, live = np.full((n, width, N_FEATURES), DIM, dtype=np.int32), np.zeros((n, width), dtype=np.int8), np.zeros((n, width), dtype=bool)
    for i, (ws, ts) in enumerate(zip(words, tags, strict=True)):
        parts = [pad, *[slots[w] for w in ws], pad]
        for t in range(len(ws)):
            ids[i, t] = parts[t + 1][0] + parts[t][1] + parts[t + 2][2]
        gold[i, : len(ws)], live[i, : len(ws)] = ts, True
    weights, seen = np.zeros(DIM + 1), np.full(DIM + 1, 1e-6)
    moves, moved = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), -(-n // batch)):
            k, y, on = len(rows), gold[rows].astype(int), live[rows]
            used = ids[rows]  # a copy
            used[(y == 0) & (rng.random(y.shape) < hide), 1:] = DIM  # only the constant left: unknown words are clean ones
            e = weights[used].sum(axis=2)
            m, w = np.exp(moves), np.exp(np.clip(e, -30, 30))
            a = np.empty((width + 1, k, 2))
            a[0] = [1, 0]
            for t in range(width):
                step = a[t] @ m
                step[:, 1] *= w[:, t]
                a[t + 1] = np.where(on[:, t, None], step / step.sum(axis=1, keepdims=True), a[t])
            b, grad_e, grad_m = np.ones((k, 2)), np.zeros((k, width)), np.zeros((2, 2))
            before = np.concatenate([np.zeros((k, 1), int), y[:, :-1]], axis=1)
            for t in range(width - 1, -1, -1):
                joint = a[t][:, :, None] * m[None] * np.stack([np.ones(k), w[:, t]], axis=1)[:, None, :] * b[:, None, :]
                joint *= (on[:, t] / joint.sum(axis=(1, 2)))[:, None, None]
                grad_e[:, t] = np.where(on[:, t], y[:, t] - joint[:, :, 1].sum(axis=1), 0)
                grad_m -= joint.sum(axis=0)
                np.add.at(grad_m, (before[on[:, t], t], y[on[:, t], t]), 1)
                back = (m[None] * np.stack([np.ones(k), w[:, t]], axis=1)[:, None, :] * b[:, None, :]).sum(axis=2)
                b = np.where(on[:, t, None], back / back.sum(axis=1, keepdims=True), b)
            touched, inverse = np.unique(used, return_inverse=True)
            g = np.bincount(inverse.reshape(-1), np.repeat(grad_e[:, :, None], N_FEATURES, axis=2).reshape(-1), len(touched)) - decay * k * weights[touched]
            seen[touched] += g * g
            weights[touched] += rate * g / np.sqrt(seen[touched])
            weights[DIM] = 0
            moved += grad_m**2
            moves += rate * grad_m / np.sqrt(moved)
    return weights[:DIM], moves


def train_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps on standardised features, clean documents weighing three times as much."""
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - centre) / spread])
    weight = np.where(y == 1, 0.25 / max(1, (y == 1).sum()), 0.75 / max(1, (y == 0).sum())) * len(y)
    c = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        g = z.T @ (weight * (y - p)) - ridge * c
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(c))
        c = c + np.clip(np.linalg.solve(h, g), -2, 2)
    return c, centre, spread


def indicators(sample: DataFrame, n_toxic: int, n_clean: int, least: float = 14.0, ratio: float = 4.0) -> tuple[set[str], set[str]]:
    """Words and word beginnings whose toxic documents chance cannot explain: the log-likelihood ratio of their t
    toxic and c clean documents against the classes' shares exceeds `least` (about 1e-6 by chance), and they are
    at least `ratio` times as frequent in toxic documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    worded = sample.select("toxic", F.explode(F.array(words)).alias("words"))

    def starts(k: int):
        return F.transform(F.filter("words", lambda w: F.length(w) >= k), lambda w: F.concat(F.lit("^"), F.substring(w, 1, k)))

    each = worded.select("toxic", F.explode(F.array_distinct(F.concat("words", *[starts(k) for k in STARTS]))).alias("feature"))
    counts = each.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    share, n = n_toxic / (n_toxic + n_clean), F.col("t") + F.col("c")
    gain = F.col("t") * F.log(F.col("t") / n / share) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / n / (1 - share))).otherwise(0)
    marked = counts.where((F.col("t") > 1) & (gain > least) & (F.col("t") / n_toxic >= ratio * F.col("c") / n_clean))
    found = [r["feature"] for r in marked.collect()]  # of a sample that the parameters bound
    return {f for f in found if f[0] != "^"}, {f[1:] for f in found if f[0] == "^"}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """docs (doc_id, text), labels (doc_id, toxic): None without documents of both labels."""
    marked = labels.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    drawn = stratified(marked.where(F.col("toxic").isin(0, 1)), "toxic", per_class)  # 2 * per_class rows at most
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn.select("doc_id", "toxic")), "doc_id")
    # copies would count as evidence many times; where their labels differ, toxic holds
    sample = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "text", "toxic")
    sample = materialize(sample, "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    words, starts = indicators(sample, sizes[1], sizes[0])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batch_slices(batches):
            out_w, out_t = [], []
            for text, toxic in zip(text_bytes(batch), batch.column("toxic").to_pylist(), strict=True):
                ws = tokens(text.decode("utf-8", "replace"))
                hits = [i for i, w in enumerate(ws) if w in words or any(w[:k] in starts for k in STARTS if len(w) >= k)]
                ts = [0] * len(ws)
                for i in hits if toxic else ():
                    ts[i] = 1
                rng = np.random.default_rng(zlib.crc32(text))
                centres = list(rng.permutation(hits)[:WINDOWS_PER_DOC]) if hits else []
                if not toxic or centres:  # a toxic text without marks says nothing about its tokens
                    centres += list(rng.integers(0, max(1, len(ws)), 1 if toxic else WINDOWS_PER_DOC))
                for c in centres:
                    a = max(0, int(c) - int(rng.integers(0, 2 * REACH + 1)))
                    out_w.append(ws[a : a + 2 * REACH + 1])
                    out_t.append(ts[a : a + 2 * REACH + 1])
            yield pa.RecordBatch.from_arrays([pa.array(out_w, pa.list_(pa.string())), pa.array(out_t, pa.list_(pa.int32()))], names=["words", "tags"])

    rows = sorted((r for r in sample.mapInArrow(windows, "words array<string>, tags array<int>").collect() if r["words"]), key=lambda r: r["words"])
    weights, moves = train_field([r["words"] for r in rows], [r["tags"] for r in rows])

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(weights)
        for batch in batch_slices(batches):
            odds = marginals([emissions(scores, tokens(t.decode("utf-8", "replace"))) for t in text_bytes(batch)], moves)
            yield pa.RecordBatch.from_arrays([pa.array([summary(o) for o in odds], pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    known = sorted((tuple(r["x"]), r["toxic"]) for r in sample.mapInArrow(figures, "x array<double>, toxic int").collect())
    curve, centre, spread = train_curve(np.array([x for x, _ in known]), np.array([y for _, y in known]))
    return Model(weights.astype(np.float32), moves, curve, centre, spread)


def _scored(model: Model | None, token: str, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    if model is None:
        return np.zeros(len(texts)), [np.zeros(0)] * len(texts)
    scores = kept(("word scores", token), lambda: WordScores(model.weights))
    odds = marginals([emissions(scores, tokens(t)) for t in texts], model.moves)
    x = (np.array([summary(o) for o in odds]).reshape(-1, 3) - model.centre) / model.spread
    cleaner = np.array([np.clip(o.max(), -30, FLOOR) - FLOOR if len(o) else -30 - FLOOR for o in odds])  # orders the clean ones
    return 1 / (1 + np.exp(-np.clip(model.curve[0] + x @ model.curve[1:] + 0.05 * cleaner, -30, 30))), odds


def spans(text: str, odds: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, highest marginal) of runs of tokens more likely toxic than not, as character offsets."""
    if not (odds > 0).any():
        return []
    out: list[tuple[int, int, float]] = []
    open_ = False
    for m, o in zip(_WORD.finditer(lowered(text)), odds, strict=True):
        if o > 0:
            p = float(1 / (1 + np.exp(-min(o, 30))))
            out = [*out[:-1], (out[-1][0], m.end(), max(out[-1][2], p))] if open_ else [*out, (m.start(), m.end(), p)]
        open_ = bool(o > 0)
    return out


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, spans) of whole texts."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), docs.schema["doc_id"].dataType.simpleString()
    token = uuid.uuid4().hex
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, limit=1 << 20):
            texts = [(t or b"").decode("utf-8", "replace") for t in text_bytes(batch)]
            found, odds = _scored(shared.value, token, texts)
            marked = [[{"start": a, "end": b, "marginal": p} for a, b, p in spans(t, o)] for t, o in zip(texts, odds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64()), pa.array(marked, kind)], names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(compute, f"doc_id {key}, score double, spans array<struct<start:int,end:int,marginal:double>>")


def reject(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns kept, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = uuid.uuid4().hex

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, limit=1 << 20):
            texts = [(t or b"").decode("utf-8", "replace") for t in text_bytes(batch)]
            yield batch.filter(pa.array(_scored(shared.value, token, texts)[0] < threshold))

    return docs.mapInArrow(keep, docs.schema)
