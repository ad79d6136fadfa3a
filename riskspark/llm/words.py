"""Vectorised words and shingles: 64-bit hashes straight from an Arrow text buffer.

A word's hash is a polynomial over table-mixed bytes, taken as a difference of running sums, so a
whole batch is hashed by a handful of array operations. Arithmetic wraps modulo 2**64 throughout.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=8)
def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(seed * 7919 + 1)) | U64(1)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.full(n, b, dtype=U64), dtype=U64) for b in (_BASE, inverse))


@lru_cache(maxsize=4)
def _tables(lower: bool, alnum_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: its mixed value and whether it belongs to a word."""
    byte = np.arange(256)
    folded = np.where((byte >= 65) & (byte <= 90) & lower, byte + 32, byte)
    if alnum_only:
        is_word = (byte >= 128) | ((byte >= 48) & (byte <= 57)) | ((folded >= 97) & (folded <= 122))
    else:
        is_word = ~((byte == 32) | ((byte >= 9) & (byte <= 13)))
    return mix(folded.astype(U64) + U64(1000)), is_word


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, last row + 1) slices of about ``limit`` bytes, one row at least."""
    _, offsets = _flat(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end
        at = end


def word_hashes(texts: pa.Array, lower: bool = True, alnum_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows in order, and each row's first word position (n + 1 entries).

    NULL counts as empty. ``lower`` folds A-Z; words are runs without ASCII white space or, with
    ``alnum_only``, runs of ASCII letters, digits and non-ASCII bytes.
    """
    flat, offsets = _flat(texts)
    if not len(flat):
        return np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    values, is_word = _tables(lower, alnum_only)
    inside = is_word[flat]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    head = edge[edge < len(flat)]
    first[head] |= inside[head]
    tail = edge[edge > 0] - 1
    last[tail] |= inside[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = 1 << max(CHUNK_BYTES.bit_length(), len(flat).bit_length())
    up, down = _powers(size)
    running = np.cumsum(values[flat] * up[: len(flat)], dtype=U64)
    before = np.where(starts > 0, running[starts - 1], U64(0))
    hashes = mix((running[ends - 1] - before) * down[starts])
    return hashes, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` words; a shorter text is a single shingle, an empty one has none."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    weights = odd_numbers(size, 17)  # a shorter shingle has a prefix of them and its width as salt
    total = np.full(n - width + 1, (width * _BASE) % (1 << 64), dtype=U64)
    for j in range(width):
        total += words[j : n - width + 1 + j] * weights[j]
    return mix(total)
