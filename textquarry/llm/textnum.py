"""Words of many texts at once, as numpy arrays.

A word's hash is a polynomial over its bytes modulo 2^64, read off one running sum:
sum(b[i] * R^i) over a span, times R^-start, does not depend on where the span lies
(R is odd and so has an inverse).  A finishing mix spreads it over all 64 bits.
Texts are handled in pieces of about ``PIECE`` bytes, so memory does not follow a
text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 18
_R = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1


def byte_map(separators: bytes) -> bytes:
    """Lower-case A-Z, and every separator as a blank."""
    out = bytearray(range(256))
    for b in range(65, 91):
        out[b] = b + 32
    for b in separators:
        out[b] = 32
    return bytes(out)


BLANKS = byte_map(b"\x20\x09\x0a\x0b\x0c\x0d")
#: letters, digits and all bytes beyond ASCII belong to words
NON_WORD = byte_map(bytes(b for b in range(128) if not chr(b).isalnum()))

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, 2 * PIECE)
        for name, base in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _tables[name] = np.multiply.accumulate(a)
    return _tables["up"], _tables["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of a run of texts: ``doc`` (index of the text), ``hash``, and prefix hashes on demand."""

    def __init__(self, blob: np.ndarray, first: int, lengths: np.ndarray):
        self.ends_of_docs = np.cumsum(lengths + 1)
        word = blob != 32
        edge = np.diff(word.view(np.int8), prepend=0, append=0)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.doc = first + np.searchsorted(self.ends_of_docs, self.start, "right")
        up, self._down = _powers(len(blob) + 1)
        self._run = np.zeros(len(blob) + 1, np.uint64)
        np.cumsum((blob.astype(np.uint64) + np.uint64(1)) * up[: len(blob)], out=self._run[1:])
        self.hash = self.prefix(None)

    def prefix(self, n: int | None) -> np.ndarray:
        """Hashes of the words' first n bytes (None: of all); a shorter word counts whole."""
        end = self.end if n is None else np.minimum(self.end, self.start + n)
        h = (self._run[end] - self._run[self.start]) * self._down[self.start]
        return mix64(h + (end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _cuts(data: bytes) -> list[bytes]:
    """One long text in pieces of about PIECE bytes, cut at blanks."""
    out, at = [], 0
    while len(data) - at > 2 * PIECE:
        cut = data.find(b" ", at + PIECE)
        if cut < 0:
            break
        out.append(data[at:cut])
        at = cut
    out.append(data[at:])
    return out


def word_runs(texts, mapping: bytes) -> Iterator[Words]:
    """Words of ``texts`` (None: no words) in order, in runs of about PIECE bytes."""
    pend: list[bytes] = []
    first = size = 0

    def run() -> Words:
        return Words(np.frombuffer(b" ".join(pend) + b" ", np.uint8), first, np.array([len(p) for p in pend]))

    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass").translate(mapping) if isinstance(text, str) else b""
        if len(data) > 2 * PIECE:
            if pend:
                yield run()
            for piece in _cuts(data):
                yield Words(np.frombuffer(piece + b" ", np.uint8), i, np.array([len(piece)]))
            pend, first, size = [], i + 1, 0
            continue
        pend.append(data)
        size += len(data)
        if size >= PIECE:
            yield run()
            pend, first, size = [], i + 1, 0
    if pend:
        yield run()


def words_by_doc(texts, mapping: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, hashes of its words in order), for every text."""
    held: list[np.ndarray] = []
    at = 0
    empty = np.zeros(0, np.uint64)
    for w in word_runs(texts, mapping):
        bounds = np.flatnonzero(np.diff(w.doc)) + 1
        for part in np.split(np.arange(len(w.doc)), bounds) if len(w.doc) else []:
            d = int(w.doc[part[0]])
            while at < d:
                yield at, np.concatenate(held) if held else empty
                held, at = [], at + 1
            held.append(w.hash[part[0] : part[-1] + 1])
    while at < len(texts):
        yield at, np.concatenate(held) if held else empty
        held, at = [], at + 1


_ODD = [np.uint64(x) for x in (0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x87C37B91114253D5)]


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Distinct n-word shingles as sorted hashes; fewer than n words count as one shingle."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = h + words[k : k + len(h)] * _ODD[k % 5] + np.uint64(k)
        h = h ^ (h >> np.uint64(29)) if k % 5 == 4 else h
    return np.unique(mix64(h))
