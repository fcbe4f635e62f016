"""Operator 10: language identification with a byte convolutional network.

Windows of WINDOW lower-cased bytes pass filters of two, three and four bytes' width; each filter keeps its
maximum over the window (after a ReLU), and a softmax layer reads the pooled values. A document's distribution is the
mean of its windows', weighted by their letters. Training is plain numpy: only the winning position of a
filter gets a gradient. For application the first layer folds into tables over pairs of bytes.

The fit uses at most PER_LANGUAGE documents of each language and SLICE characters of each, cut at a
hashed place; predictions read whole texts.

Defined cases: texts that are null or hold no letter are `und` with score 0; documents without a language
or with a null doc_id are never learned from; with no labelled documents at all every text is `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.llm.common import batch_slices, stratified, text_bytes

WINDOW, FILTERS, WIDTHS = 128, 16, (2, 3, 4)
PER_LANGUAGE, SLICE = 600, 4096
CLASSES = 128


def _classes() -> np.ndarray:
    """Byte classes: 0 is padding; letters, blanks, digits, other ASCII, continuation bytes, lead bytes."""
    table = np.full(256, 29, dtype=np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[[9, 10, 11, 12, 13, 32]] = 27
    table[ord("0") : ord("9") + 1] = 28
    table[0x80:0xC0] = np.arange(30, 94)
    table[0xC0:0xE0] = np.arange(94, 126)
    table[0xE0:0xF0], table[0xF0:] = 126, 127
    return table


TABLE = _classes()
_WORDLIKE = np.isin(np.arange(CLASSES), [*range(1, 27), *range(94, 128)])  # a letter starts here


@dataclass
class Model:
    languages: list[str]
    tables: dict[int, np.ndarray]  # width: (width, CLASSES, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def folded(self) -> "Folded":
        pair = {w: (t[0][:, None, :] + t[1][None, :, :]).reshape(-1, FILTERS) for w, t in self.tables.items()}
        last = self.tables[4]
        tail = (last[2][:, None, :] + last[3][None, :, :]).reshape(-1, FILTERS)
        as32 = lambda x: np.ascontiguousarray(x, dtype=np.float32)
        return Folded(self.languages, as32(pair[2]), as32(pair[3]), as32(self.tables[3][2]), as32(pair[4]), as32(tail), as32(self.bias), as32(self.dense), as32(self.offset))


@dataclass
class Folded:
    languages: list[str]
    two: np.ndarray
    three: np.ndarray
    three_end: np.ndarray
    four: np.ndarray
    four_end: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def probabilities(self, windows: np.ndarray, block: int = 128) -> np.ndarray:
        """(n, WINDOW) byte classes to (n, languages)."""
        out = np.empty((len(windows), len(self.languages)), dtype=np.float32)
        for a in range(0, len(windows), block):
            c = windows[a : a + block]
            pairs = (c[:, :-1].astype(np.int32) << 7) | c[:, 1:]
            pooled = [
                self.two.take(pairs, axis=0).max(axis=1),
                (self.three.take(pairs[:, :-1], axis=0) + self.three_end.take(c[:, 2:], axis=0)).max(axis=1),
                (self.four.take(pairs[:, :-2], axis=0) + self.four_end.take(pairs[:, 2:], axis=0)).max(axis=1),
            ]
            logits = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.dense + self.offset
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[a : a + block] = e / e.sum(axis=1, keepdims=True)
        return out


def encode(text: str) -> np.ndarray:
    """Byte classes of the whole lower-cased text, padded to windows."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    out = np.zeros(-(-max(1, len(data)) // WINDOW) * WINDOW, dtype=np.uint8)
    out[: len(data)] = TABLE[data]
    return out.reshape(-1, WINDOW)


def train(texts: list[str], labels: list[str], steps: int = 700, batch: int = 96, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on windows cut at random places and to random lengths, languages drawn equally often."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    streams = [[encode(t).reshape(-1)[: len(t.lower().encode())] for t, x in zip(texts, labels, strict=True) if x == lang] for lang in languages]
    k, n_pooled = len(languages), FILTERS * len(WIDTHS)
    p = {f"t{w}": rng.normal(0, 0.3, (w, CLASSES, FILTERS)) for w in WIDTHS}
    p |= {"bias": np.zeros(n_pooled), "dense": rng.normal(0, 0.1, (n_pooled, k)), "offset": np.zeros(k)}
    m1, m2 = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(0, k, batch)
        c = np.zeros((batch, WINDOW), dtype=np.int64)
        for i, lang in enumerate(y):
            stream = streams[lang][rng.integers(len(streams[lang]))]
            want = WINDOW if rng.random() < 0.5 else int(rng.integers(6, WINDOW))
            at = int(rng.integers(0, max(1, len(stream) - want + 1)))
            cut = stream[at : at + want]
            c[i, : len(cut)] = cut
        pooled, where = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            z = sum(p[f"t{w}"][j][c[:, j : j + n]] for j in range(w))
            where.append(z.argmax(axis=1))
            pooled.append(np.take_along_axis(z, where[-1][:, None], axis=1)[:, 0])
        raw = np.concatenate(pooled, axis=1) + p["bias"]
        h = np.maximum(raw, 0)
        logits = h @ p["dense"] + p["offset"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        d = e / e.sum(axis=1, keepdims=True)
        d[np.arange(batch), y] -= 1
        d /= batch
        g = {"dense": h.T @ d, "offset": d.sum(axis=0)}
        back = (d @ p["dense"].T) * (raw > 0)
        g["bias"] = back.sum(axis=0)
        for i, w in enumerate(WIDTHS):
            grad, part = np.zeros_like(p[f"t{w}"]), back[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(w):
                np.add.at(grad[j], (np.take_along_axis(c, where[i] + j, axis=1), np.arange(FILTERS)[None, :]), part)
            g[f"t{w}"] = grad
        now = rate * (1 - step / (steps + 1)) + 1e-4
        for n in p:
            m1[n] = 0.9 * m1[n] + 0.1 * g[n]
            m2[n] = 0.999 * m2[n] + 0.001 * g[n] ** 2
            p[n] -= now * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8)
    return Model(languages, {w: p[f"t{w}"] for w in WIDTHS}, p["bias"], p["dense"], p["offset"])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """labelled (doc_id, text, lang): a model of its languages, or None without any."""
    place = F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.greatest(F.length("text") - SLICE, F.lit(1))).cast("int") + 1
    letters = labelled.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", F.substring("text", place, F.lit(SLICE)).alias("text"))
    rows = stratified(letters, "lang", per_language).select("doc_id", "text", "lang").collect()  # bounded by the sample's parameters
    rows.sort(key=lambda r: (r["lang"], str(r["doc_id"]), r["text"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model and model.folded())
    key = docs.schema["doc_id"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batch_slices(batches, limit=1 << 20):
            texts = [(t or b"").decode("utf-8", "replace") for t in text_bytes(batch)]
            read = [i for i, t in enumerate(texts) if net is not None and any(map(str.isalpha, t))]  # letters as the fit means them: neither digits nor fractions
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if read:
                windows = [encode(texts[i]) for i in read]
                flat = np.concatenate(windows)
                p = net.probabilities(flat).astype(float)
                weight = _WORDLIKE[flat].sum(axis=1) + 1e-3
                starts = np.cumsum([0, *map(len, windows)][:-1])
                mean = np.add.reduceat(p * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
                for i, best, row in zip(read, mean.argmax(axis=1), mean, strict=True):
                    names[i], scores[i] = net.languages[best], min(1.0, float(row[best]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(compute, f"doc_id {key}, lang_pred string, score double")
