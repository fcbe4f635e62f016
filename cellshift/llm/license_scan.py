"""Operator 4: license scans as an exact set-similarity join of text blocks with notice templates.

A text is cut into overlapping blocks of words; a block matches a template when it contains at least
`threshold` of the template's distinct words, and all of those that tell its license from others worded alike. All template words are ordered by their document frequency
over the whole corpus, rarest first. A block that meets the threshold must hold one of a template's first
|T| - need + 1 words (prefix filter), so only blocks with such a word become rows; these are hash-joined to
the prefix words, cut down by size (length filter) and by what can still follow both positions (positional
filter), and the overlap of the rest is counted exactly.

Base phrases are counted beside it, at every place where their words stand in a row.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows are scanned each
time; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.llm.common import batch_slices, materialize, text_bytes

# The phrases asked for and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Parts of well-known notices, the labels of their licenses, and the words that tell a license from others in the same frame.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted charge"),
    ("mit", "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "merge sublicense sell"),
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "compliance obtain"),
    ("apache", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "basis warranties conditions"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute gnu"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability", "hope useful merchantability"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary permitted"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "redistributions reproduce disclaimer"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
]
BLOCK_WORDS, STRIDE, THRESHOLD = 64, 32, 0.8

# Bytes up to 0x7F that are no letter or digit separate words; A-Z are lower-cased, all other bytes stay.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def places(found: list[bytes], phrase: tuple[bytes, ...]) -> list[int]:
    """Every word position at which the phrase starts."""
    out, at, n = [], -1, len(phrase)
    while True:
        try:
            at = found.index(phrase[-1], at + 1)
        except ValueError:
            return out
        if at + 1 >= n and tuple(found[at + 1 - n : at + 1]) == phrase:
            out.append(at + 1 - n)


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[str, int]:
    """Documents that hold each template word, over the whole corpus; as many rows as the templates have words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batch_slices(batches):
            for text in text_bytes(batch):
                seen.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, base: dict[str, str] = BASE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks): score is the highest
    containment among matching blocks, 1 where a base phrase stands; n_blocks counts block-template matches."""
    spark = docs.sparkSession
    sets = [frozenset(t.encode().split()) for _, t, _ in templates]
    vocabulary = frozenset().union(*sets)
    seen = frequencies(docs, vocabulary)
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w.decode(), 0), w)))}
    ranked = [sorted(order[w] for w in s) for s in sets]
    need = [math.ceil(threshold * len(r) - 1e-9) for r in ranked]
    prefix = frozenset(w for s, r, n in zip(sets, ranked, need, strict=True) for w in s if order[w] in r[: len(r) - n + 1])
    phrases = [(tuple(p.encode().split()), label) for p, label in base.items()]
    ends = frozenset(p[-1] for p, _ in phrases)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches):
            out: list[tuple] = []
            for text in text_bytes(batch):
                found = words(text)
                starts, labels, blocks = [], set(), []
                rare = [i for i, w in enumerate(found) if w in prefix]
                if rare:
                    for phrase, label in phrases:
                        if at := places(found, phrase):
                            starts += at
                            labels.add(label)
                    near = sorted({b for i in rare for b in range(max(0, (i - BLOCK_WORDS) // STRIDE + 1), i // STRIDE + 1)})
                    for b in near:
                        held = sorted({order[w] for w in found[b * STRIDE : b * STRIDE + BLOCK_WORDS] if w in order})
                        blocks.append({"block": b, "held": held})
                out.append((len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), blocks))
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("block", pa.int32()), ("held", pa.list_(pa.int32()))])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("same"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "same", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"],
            )

    if not ends <= prefix:  # a base phrase must not hide behind the prefix filter
        prefix |= ends
    key = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {key}, same long, n_words long, n_base long, first_word long, last_word long, base_labels string, blocks array<struct<block:int,held:array<int>>>"
    digests = materialize(docs.select("doc_id", "text", F.xxhash64("text").alias("same")).mapInArrow(digest, kinds), "license-digests")
    told = [sorted(order[w] for w in required.encode().split()) for *_, required in templates]
    rows = [(i, templates[i][0], r, n, len(r), told[i], w, p) for i, (r, n) in enumerate(zip(ranked, need, strict=True)) for p, w in enumerate(r[: len(r) - n + 1])]
    index = spark.createDataFrame(rows, "template int, label string, words array<int>, need int, size int, required array<int>, word int, place int")
    blocks = digests.where(F.size("blocks") > 0).select("doc_id", "same", F.explode("blocks").alias("b")).select("doc_id", "same", "b.block", "b.held")
    probes = blocks.select("doc_id", "same", "block", "held", F.posexplode("held").alias("at", "probe"))
    after = F.least(F.col("size") - F.col("place"), F.size("held") - F.col("at"))
    near = probes.join(index, F.col("probe") == F.col("word")).where((F.size("held") >= F.col("need")) & (after >= F.col("need")))
    overlap = F.size(F.array_intersect("held", "words"))
    exact = near.withColumn("overlap", overlap).where((F.col("overlap") >= F.col("need")) & (F.size(F.array_except("required", "held")) == 0))
    found = exact.groupBy("doc_id", "same").agg(
        F.collect_set("label").alias("own"), F.max(F.col("overlap") / F.col("size")).alias("share"), F.count_distinct("block", "template").alias("n_blocks"),
    ).select(F.col("doc_id").alias("d"), F.col("same").alias("s"), "own", "share", "n_blocks")
    joined = digests.drop("blocks").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("same") == F.col("s")), "left")
    based = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    every = F.array_sort(F.array_distinct(F.concat(based, F.coalesce("own", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
    )
