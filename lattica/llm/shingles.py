"""Vectorised word and shingle hashes of many texts at once."""

from __future__ import annotations

import numpy as np

from lattica.llm.base import mix

#: An odd base has an inverse modulo 2**64, so any word's hash comes from two prefix sums.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 20
#: Words end at these; A-Z become lower case.
SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_blank = np.zeros(256, bool)
_blank[list(SPACES)] = True
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, INVERSE))
    return _powers


def pieces(texts: list[bytes]):
    """(text number, bytes) with long texts cut at a blank."""
    for i, x in enumerate(texts):
        at = 0
        while len(x) - at > PIECE:
            cut = max(x.rfind(bytes([b]), at + 1, at + PIECE) for b in SPACES)
            if cut < 0:
                cut = min([c for c in (x.find(bytes([b]), at + PIECE) for b in SPACES) if c >= 0], default=len(x))
            yield i, x[at:cut]
            at = cut
        yield i, x[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more entry for the end)."""
    counts, found, batch, of, size = np.zeros(len(texts), np.int64), [], [], [], 0

    def flush() -> None:
        raw = b" ".join(batch).translate(LOWER)
        b = np.frombuffer(raw, np.uint8)
        blank = _blank[b]
        edge = np.diff(blank.astype(np.int8), prepend=1, append=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = powers(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
        found.append(mix((total[end] - total[start]) * inverse[start] ^ (end - start).astype(np.uint64)))
        begins = np.cumsum([0] + [len(x) + 1 for x in batch])
        np.add.at(counts, of, np.diff(np.searchsorted(start, begins)))
        batch.clear()
        of.clear()

    for i, x in pieces(texts):
        batch.append(x)
        of.append(i)
        size += len(x)
        if size > PIECE:
            flush()
            size = 0
    if batch:
        flush()
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; those that cross texts are for the caller to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ words[j : j + n]) * np.uint64(BASE) + np.uint64(j + 1)
    return mix(out)


def shingle_sets(texts: list[bytes], k: int):
    """Per text the sorted distinct hashes of its k-word shingles; with fewer words its whole sequence is
    one; without words there are none."""
    words, at = word_hashes(texts)
    every = shingle_hashes(words, k)
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s >= k:
            yield np.unique(every[s : e - k + 1])
        elif e > s:
            yield shingle_hashes(words[s:e], int(e - s))
        else:
            yield np.zeros(0, np.uint64)
