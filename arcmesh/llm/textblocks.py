"""Vectorised word splitting over Arrow text columns.

A column of texts is one byte buffer with offsets, so splitting, lower-casing and counting are numpy
operations over that buffer and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; the numpy temporaries are a few times as large.
CHUNK = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]`
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`: digits, a-z and everything above ASCII
WORD_CHAR = np.zeros(256, dtype=bool)
WORD_CHAR[0x30:0x3A] = True
WORD_CHAR[0x61:0x7B] = True
WORD_CHAR[0x80:] = True


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string or binary array; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def chunks(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` bytes each; a longer text stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(off: np.ndarray, raw: np.ndarray, chars: np.ndarray = NOT_SPACE, lower: bool = True) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The maximal runs of `chars` of each text as one binary array, and each text's number of them."""
    low = LOWER[raw] if lower else raw
    keep = chars[low]
    if not keep.any():
        return pa.array([], pa.large_binary()), np.zeros(len(off) - 1, np.int64)
    start, end = keep.copy(), keep.copy()
    start[1:] &= ~keep[:-1]
    end[:-1] &= ~keep[1:]
    first, last = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]] - 1
    start[first] = keep[first]
    end[last] = keep[last]
    at, to = np.flatnonzero(start), np.flatnonzero(end)
    ends = np.zeros(len(at) + 1, np.int64)
    np.cumsum(to - at + 1, out=ends[1:])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low[keep]))])
    return found, np.diff(np.searchsorted(at, off))


def word_counts(texts: pa.Array) -> np.ndarray:
    """Number of `[^\\x20\\x09-\\x0D]+` runs in each text."""
    off, raw = buffers(texts)
    out = [words(off[a : b + 1] - off[a], raw[off[a] : off[b]], lower=False)[1] for a, b in chunks(off)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(found: pa.LargeBinaryArray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    import xxhash

    if not len(found):
        return np.zeros(0, np.uint64)
    coded = found.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes of a stream."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mix64(out + h[j : j + n] * np.uint64(2 * j + 3) + np.uint64(0x9E3779B97F4A7C15))
    return out
