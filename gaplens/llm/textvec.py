"""Vectorised word, line and shingle hashing over Arrow string columns.

Texts arrive as Arrow batches inside `mapInArrow`; everything here works on the
UTF-8 bytes of a whole batch with numpy, so that cost is tens of nanoseconds a
byte and memory is bounded by `CHUNK_BYTES` (or by one text where it is longer).

White space is the ASCII set `[\\x20\\x09-\\x0D]`; all of it is below 0x80, so
splitting bytes is the same as splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1024)
        step = np.full(size, _BASE, np.uint64)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
    return _powers[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64)."""
    h = (h + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) % 2**64)).astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows holding about `limit` bytes; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, body[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that do not cross a row: starts, ends and row of each."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1]
    heads = heads[heads < len(inside)]
    first[heads] |= inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:] - 1
    tails = tails[tails >= 0]
    last[tails] |= inside[tails]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span; spans must be sorted and must not overlap."""
    sizes = ends - starts
    out = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(sizes > 0)
    if len(full):
        size = sizes[full]
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        pos = np.arange(int(size.sum())) - np.repeat(at, size)
        took = body[pos + np.repeat(starts[full], size)]
        out[full] = np.add.reduceat(_BYTE[took] * powers(int(size.max()))[pos], at)
    return mix(out + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), salt)


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(~WHITE[body], offsets)


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in a sorted row index (n + 1 bounds)."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one text; all words as one if there are fewer, none if there are none."""
    n = len(words)
    if not n:
        return words
    w = min(n, k)
    pw = powers(w)
    out = np.zeros(n - w + 1, np.uint64)
    for j in range(w):
        out += words[j : n - w + 1 + j] * pw[j]
    return mix(out, w)


def line_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All \\n-split lines, empty ones included: an empty text has one. Starts, ends, row."""
    n = len(offsets) - 1
    cut = np.flatnonzero(body == 10)
    row = np.searchsorted(offsets, cut, "right") - 1
    starts = np.concatenate([offsets[:-1], cut + 1])
    rows = np.concatenate([np.arange(n), row])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.concatenate([cut, offsets[1:]])
    ends = ends[np.lexsort((ends, np.concatenate([row, np.arange(n)])))]
    return starts, ends, rows


def stripped(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without white space at their ends."""
    solid = np.flatnonzero(~WHITE[body])
    lo = np.searchsorted(solid, starts)
    hi = np.searchsorted(solid, ends)
    some = hi > lo
    a, b = starts.copy(), starts.copy()
    a[some] = solid[lo[some]]
    b[some] = solid[hi[some] - 1] + 1
    return a, b


def code_points(body: np.ndarray) -> np.ndarray:
    """Prefix counts of code points, one longer than the bytes."""
    out = np.zeros(len(body) + 1, np.int64)
    np.cumsum((body & 0xC0) != 0x80, out=out[1:])
    return out
