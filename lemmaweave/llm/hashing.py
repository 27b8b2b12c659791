"""Vectorised hashing of words, shingles and windows over Arrow text columns.

A polynomial hash modulo 2**64 over a chunk of concatenated texts gives the hash
of any run of symbols (bytes or word hashes) by two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
CHUNK = 1 << 20
#: symbols that are hashed at once; longer texts go by blocks
BLOCK = 1 << 22
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = np.asarray(x, np.uint64)
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse; callers hash in blocks, so the tables never exceed a block."""
    up, down = _POWERS.get(which, (np.empty(0, np.uint64),) * 2)
    if len(up) < n:
        base = int(_BASES[which]) | 1
        inverse = pow(base, -1, 1 << 64)
        size = max(n, CHUNK + 1)

        def run(b: int) -> np.ndarray:
            x = np.full(size, b, np.uint64)
            x[0] = 1
            return np.multiply.accumulate(x)

        up, down = run(base), run(inverse)
        if size <= 2 * BLOCK:
            _POWERS[which] = up, down
    return up, down


class Runs:
    """Hashes of runs of symbols: at(start, end) for arrays of positions."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        n = len(symbols)
        up, self._down = _powers(which, n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sum[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start])

    def sliding(self, k: int) -> np.ndarray:
        n = len(self._sum) - k
        return mix((self._sum[k:] - self._sum[:n]) * self._down[:n]) if n > 0 else np.empty(0, np.uint64)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and offsets of each text's words."""
    blank = BLANK[data]
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = ~blank
    first = solid.copy()
    first[1:] &= blank[:-1] | edge[1:-1]
    last = solid
    last[:-1] &= blank[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, block: int | None = None) -> np.ndarray:
    """Hashes of the runs data[start:end], for ascending starts and ends, by blocks of the data."""
    out, at, block = np.empty(len(starts), np.uint64), 0, block or BLOCK
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, side="right")))
        base = starts[at]
        out[at:to] = Runs(data[base : ends[to - 1]], which).at(starts[at:to] - base, ends[at:to] - base)
        at = to
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, at = words(data, offsets)
    return span_hashes(data, starts, ends, which) ^ (ends - starts).astype(np.uint64), starts, ends, at


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, in two passes of running minima over blocks."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    front = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], front[w - 1 : n])


_PLACE = np.uint64(24)  # bits for the positions of a chunk; the same in every chunk, so that choices agree
_PLACES = (np.uint64(1) << _PLACE) - np.uint64(1)
NONE = np.uint64(2**64 - 1)


def ranked(grams: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Grams by hash, then position: the least of a window is its anchor."""
    return (mix(grams) >> _PLACE << _PLACE) | positions.astype(np.uint64)


def picks(rank: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows inside one text with the same least gram.

    rank has one entry per position of a gram, NONE where there is no gram to pick.
    Returns per run: text, position of the gram, first and last window.
    """
    n = len(rank) + k - 1
    empty = (np.empty(0, np.int64),) * 4
    starts, ends = offsets[:-1], offsets[1:]
    long = ends - starts >= window
    if n < window or not long.any():
        return empty
    if n >> int(_PLACE):
        raise ValueError("a chunk has too many symbols")
    least = sliding_min(rank, window - k + 1)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - window + 1, -1)
    valid = np.flatnonzero((np.cumsum(inside)[: len(least)] > 0) & (least != NONE))
    if not len(valid):
        return empty
    pick = (least[valid] & _PLACES).astype(np.int64)
    text = np.searchsorted(offsets, valid, side="right") - 1
    new = np.ones(len(valid), bool)
    new[1:] = (valid[1:] != valid[:-1] + 1) | (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], pick[at], valid[at], valid[np.append(at[1:], len(valid)) - 1]


def anchors(symbols: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Content-defined anchors of all windows of `window` symbols inside one text.

    Each window picks the k-gram in it with the least hash, the leftmost of equals;
    equal windows pick alike.  Returns per anchor: text, position, first and last
    window that pick it, and the k-gram's hash.  Windows of an anchor are neighbours.
    """
    if len(symbols) < window:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    grams = Runs(symbols).sliding(k)
    text, q, first, last = picks(ranked(grams, np.arange(len(grams))), offsets, window, k)
    return text, q, first, last, grams[q]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
