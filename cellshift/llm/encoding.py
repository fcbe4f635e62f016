"""Exact tokenizer ids of whole texts, white-space piece by white-space piece.

word_bpe_49k.json never joins characters across white space (its splitter matches no white space and
canonical composition does not reach over a blank), so the ids of a text are those of its pieces in a
row. Frequent pieces are encoded once per Python worker.
"""

from __future__ import annotations

import array
import os

from cellshift.llm.common import kept

MAX_CACHED = 600_000  # pieces kept by a worker, about 120 MB

_PUNCTUATION = b".,;:!?*#&%$"
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")  # letters that no normalisation changes


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class PieceEncoder:
    """Texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, max_cached: int = MAX_CACHED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_cached = max_cached
        self.known: dict[bytes, bytes] = {b"": b""}
        self.alphabet = dict(enumerate(_byte_alphabet()))

    def _whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        """A piece not seen before: a word of plain letters goes straight to the vocabulary, with punctuation behind
        it apart (the splitter cuts between the two); all else takes the tokenizer's whole way."""
        low = piece.lower()
        stem = low.rstrip(_PUNCTUATION)
        word = stem.decode("utf-8", "replace")
        if not word or not _PLAIN.issuperset(word):
            return self._whole(piece.decode("utf-8", "replace"))
        ids = self.known.get(stem)
        if ids is None:
            mapped = word if word.isascii() else stem.decode("latin-1").translate(self.alphabet)
            ids = array.array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
        if len(stem) == len(low):
            return ids
        tail = low[len(stem):]
        end = self.known.get(tail)
        if end is None:
            end = self.known[tail] = self._whole(tail.decode())
        return ids + end

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        out, get = [], self.known.get
        fresh = self.known if len(self.known) < self.max_cached else {}  # once full, pieces are kept for these texts only
        for text in texts:
            pieces = (text or b"").replace(b"\n", b" ").split(b" ")
            ids = list(map(get, pieces))
            if None in ids:
                for i, known in enumerate(ids):
                    if known is None:
                        piece = pieces[i]
                        ids[i] = fresh.get(piece)
                        if ids[i] is None:
                            ids[i] = fresh[piece] = self._piece(piece)
            out.append(b"".join(ids))
        return out


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker and file, until the worker keeps something else."""
    return kept(("encoder", path), lambda: PieceEncoder(path))
