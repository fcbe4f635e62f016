"""Operator 13: URL filters as one bit-parallel wildcard automaton.

Every rule is a glob over the canonical URL, `.host/path`: a rule of host and path becomes `*.host/path**`, where `*`
runs inside the host and `**` anywhere, so that it fits the host, its subdomains and every path that starts with its
own. All globs are packed side by side into the words of one Shift-And automaton, a bit per character and one for
each start. A character moves all patterns at once: shift by one, with the carry between words, keep the bits whose
character it is, and keep the bits whose run goes on. URLs of a batch run together, longest first, so that a step
touches only those that have not ended. The bits set at a URL's end are the rules it fits.

The longest rule that fits gives the verdict (of equal ones that of the longer host, then the earlier one). Without any, the
method's own globs decide: those of HOST_WORDS block, all other URLs are allowed.

Defined cases: a null URL and one without `://` have an empty host and path and fit no rule; repeated rows are judged
each; a very long URL stops being read where it can fit nothing else; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellshift.llm.common import batch_slices, text_bytes

# The rules asked for, (verdict, host, path).
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
# The method's own: words that a host must not hold.
HOST_WORDS = ("casino", "free-bets", "cheap-pills", "spam-farm", "ads-track", "adult")
ANY, SEGMENT = -1, -2  # tokens: a run of any bytes, a run without a slash
_PARTS = re.compile(rb"([^/?#]*)([^?#]*)")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host, A-Z lower-cased, and path."""
    at = (url or b"").find(b"://")
    if at < 0:
        return b"", b""
    host, path = _PARTS.match(url, at + 3).groups()
    return host.translate(_LOWER), path


def rule_glob(host: str, path: str) -> list[int]:
    return [SEGMENT, *f".{host}{path}".encode(), ANY]


def word_globs(word: str) -> list[list[int]]:
    """A word anywhere in the host, with a path or without."""
    within = [SEGMENT, *word.encode(), SEGMENT]
    return [within, [*within, ord("/"), ANY]]


@dataclass(frozen=True)
class Automaton:
    """Words of 64 bits: of each byte, the bits it may enter and those whose run it continues; the starts; the ends that any byte
    continues; the end bit of each glob."""

    enter: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    sinks: np.ndarray
    ends: list[tuple[int, int]]

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Row per text, column per glob."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
        flat = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        ended = np.zeros((len(texts), len(self.start)), dtype=np.uint64)
        live, state = np.arange(len(texts)), np.repeat(self.start[None, :], len(texts), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for at in range(int(lengths[0]) if len(texts) else 0):
            going = int(np.searchsorted(-lengths[live], -at))  # longer than `at`
            if going < len(live):
                ended[live[going:]] = state[going:]
                live, state = live[:going], state[:going]
            if at % 32 == 31:  # what only runs on in the ends of globs does not change any more
                settled = ~(state & ~self.sinks).any(axis=1)
                ended[live[settled]] = state[settled]
                live, state = live[~settled], state[~settled]
            if not len(live):
                break
            c = flat[starts[live] + at]
            moved = state << one
            moved[:, 1:] |= state[:, :-1] >> top
            state = (moved & self.enter[c]) | (state & self.stay[c])
        ended[live] = state
        out = np.zeros((len(texts), len(self.ends)), dtype=bool)
        for g, (word, bit) in enumerate(self.ends):
            out[order, g] = ended[:, word] >> np.uint64(bit) & one
        return out


def automaton(globs: list[list[int]]) -> Automaton:
    """A bit for each glob's start, then one for each of its characters; runs stay on the bit before them."""
    size = sum(1 + sum(t >= 0 for t in g) for g in globs)
    n_words = max(1, -(-size // 64))
    enter, stay = (np.zeros((256, n_words), dtype=np.uint64) for _ in range(2))
    start, sinks = (np.zeros(n_words, dtype=np.uint64) for _ in range(2))
    ends, bit = [], 0

    def mark(bits: np.ndarray, at: int) -> None:
        bits[at // 64] |= np.uint64(1 << at % 64)

    for glob in globs:
        mark(start, bit)
        for token in glob:
            if token >= 0:
                bit += 1
                mark(enter[token], bit)
                continue
            for byte in range(256):
                if token == ANY or byte != ord("/"):
                    mark(stay[byte], bit)
        if glob[-1] == ANY:
            mark(sinks, bit)
        ends.append((bit // 64, bit % 64))
        bit += 1
    return Automaton(enter, stay, start, sinks, ends)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, host_words: tuple[str, ...] = HOST_WORDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_word): rule is the one that decided, else null; host_word is the first of the method's own that the host holds."""
    words = [(w, g) for w in host_words for g in word_globs(w)]
    machine = automaton([rule_glob(h, p) for _, h, p in rules] + [g for _, g in words])
    best_first = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), -len(rules[i][1]), i))
    names = [h + p for _, h, p in rules]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, "url", 1 << 20):
            parts = [split_url(u) for u in text_bytes(batch, "url")]
            fits = machine.matches([b"." + host + path if host or path else b"" for host, path in parts])
            rule, verdict, word = [], [], []
            for row in fits:
                first = next((i for i in best_first if row[i]), None)
                own = next((w for (w, _), yes in zip(words, row[len(rules) :], strict=True) if yes), None)
                rule.append(None if first is None else names[first])
                verdict.append(rules[first][0] if first is not None else "block" if own else "allow")
                word.append(own)
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), pa.array([h.decode("utf-8", "replace") for h, _ in parts], pa.string()), pa.array([p.decode("utf-8", "replace") for _, p in parts], pa.string()),
                pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(word, pa.string()),
            ], names=["page_id", "host", "path", "rule", "verdict", "host_word"])

    key = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(compute, f"page_id {key}, host string, path string, rule string, verdict string, host_word string")
