"""Vectorised hashes of words and word shingles, for Python workers."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_word = partial(xxhash.xxh3_64_intdigest, seed=7)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * _M2
    x = (x ^ (x >> U(27))) * _M3
    return x ^ (x >> U(31))


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column in UTF-8; null counts as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def split_words(text: bytes, lower: bool = True) -> list[bytes]:
    """Words between runs of space and control blanks 9-13; A-Z lower-cased on demand. Bytes do just that."""
    return (text.lower() if lower else text).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word, words), U, len(words))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, in order."""
    count = len(h) - n + 1
    if count <= 0:
        return np.empty(0, U)
    x = h[:count].copy()
    for k in range(1, n):
        x = (x ^ (x >> U(29))) * _M1 + h[k : k + count]
    return mix(x)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; the whole sequence is one where it is shorter."""
    if not len(h):
        return np.empty(0, U)
    if len(h) < n:
        return mix(rolling(h, len(h)) + U(len(h)) * _M3)
    return np.unique(rolling(h, n))


def long_runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, by doubling: log n steps."""
    count = len(h) - n + 1
    if count <= 0:
        return np.empty(0, U)
    out, done, part, length, rest = None, 0, h, 1, n
    while rest:
        if rest & 1:  # append a run of ``length`` words at ``done``
            piece = part[done : done + count]
            out = mix(piece + U(length)) if out is None else mix(out * _M1 + piece)
            done += length
        rest >>= 1
        if rest:
            part = mix(part[:-length] * _M3 + part[length:])
            length *= 2
    return out


def winnowed(grams: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` n-grams the place of its smallest (the first of equal ones)."""
    if len(grams) < span:
        return np.empty(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1)
