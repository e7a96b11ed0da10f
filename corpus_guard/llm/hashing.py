"""Vectorised hashing of words and word windows over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. A word's hash
is a polynomial over its bytes, read off a running sum; a window's hash is a
polynomial over its words. All hashes are 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: As above, and ASCII punctuation and digits part words too.
LETTERS_ONLY = _SPACE.copy()
LETTERS_ONLY[[c for c in range(128) if not chr(c).isalpha()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
P_BYTE = 0x9E3779B97F4A7C15
P_WORD = (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def powers(p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n (at least)."""
    got = _POWERS.get(p)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (p, pow(p, -1, 1 << 64)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        got = _POWERS[p] = (out[0], out[1])
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _running(values: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(p, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return total, down


def windows(words: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """The hash of each run of k consecutive words; empty when there are fewer."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    total, down = _running(words, P_WORD[lane])
    n = len(words) - k + 1
    return mix((total[k:] - total[:n]) * down[:n] + np.uint64(k))


def whole(words: np.ndarray, lane: int = 0) -> np.uint64:
    """The hash of a whole sequence, its length included."""
    up, _ = powers(P_WORD[lane], len(words) + 1)
    return mix(np.array([(words * up[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], np.uint64))[0]


class Words:
    """Words of the documents of one slice: byte starts and ends, hashes, and first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, space: np.ndarray = _SPACE):
        self.data, self.offsets = data, offsets
        black = ~space[data]
        before = np.empty_like(black)
        before[1:], before[:1] = black[:-1], False
        after = np.empty_like(black)
        after[:-1], after[-1:] = black[1:], False
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        before[edge] = False
        after[edge - 1] = False
        self.starts = np.flatnonzero(black & ~before)
        self.ends = np.flatnonzero(black & ~after) + 1
        total, down = _running(_BYTE[_LOWER[data] if lower else data], P_BYTE)
        self.total, self.down = total, down
        length = (self.ends - self.starts).astype(np.uint64)
        self.hash = mix((total[self.ends] - total[self.starts]) * down[self.starts] + length)
        self.first = np.searchsorted(self.starts, offsets)

    def prefix_hash(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words of at least k bytes, and the hashes of their first k bytes."""
        long = np.flatnonzero(self.ends - self.starts >= k)
        at = self.starts[long]
        return long, mix((self.total[at + k] - self.total[at]) * self.down[at] + np.uint64(k + 1000))


def slices(column: pa.Array, lower: bool = False, space: np.ndarray = _SPACE):
    """(first row, Words) for runs of rows of about SLICE_BYTES; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        end = min(end, n)
        lo, hi = offsets[row], offsets[end]
        yield row, Words(raw[lo:hi], offsets[row : end + 1] - lo, lower, space)
        row = end


def signed(a: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return a.view(np.int64)
