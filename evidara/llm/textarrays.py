"""Words and word hashes of Arrow text columns as NumPy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text makes a slice of its own.
SLICE = 1 << 19
#: Bytes whose hashes are summed at once.
STEP = 1 << 20


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, row offsets into them) over a string column; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, payload = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(payload, np.uint8) if payload is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true for bytes within the inclusive ranges."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside` bytes that no row boundary crosses, and each row's first word (rows + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    at = inside[data]
    begin = at.copy()
    begin[1:] &= ~at[:-1]
    edge = off[(off < n)]
    begin[edge] = at[edge]
    stop = np.empty(n + 1, bool)
    stop[1:] = at
    stop[0] = False
    stop[1:n] &= ~at[1:]
    inner = edge[edge > 0]
    stop[inner] = at[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop), np.searchsorted(starts, off)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Hasher:
    """64-bit hashes of words; the same on every machine."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.byte = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each word, from sum(byte * BASE ** place) mod 2 ** 64 within it; starts and ends ascend.

        A long text is taken in steps, so memory follows its longest word at most.
        """
        if len(data) <= STEP:
            return self._of(data, starts, ends)
        out, lo = np.empty(len(starts), np.uint64), 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + STEP, "right")))
            out[lo:hi] = self._of(data[starts[lo] : ends[hi - 1]], starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo])
            lo = hi
        return out

    def _of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.runs(data)(starts, ends)

    def runs(self, data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """What hashes runs of `data` by their starts and ends; memory follows `data`."""
        n = len(data) + 1
        if len(self.up) < n:
            grow = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))])
            self.up, self.down = grow(np.uint64(self.BASE)), grow(np.uint64(pow(self.BASE, -1, 1 << 64)))
        total = np.zeros(n, np.uint64)
        np.cumsum(self.byte[data] * self.up[: n - 1], out=total[1:])
        return lambda starts, ends: mixed((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word shingles, in order, and each row's first shingle; a row of fewer words has one shingle, its whole sequence."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    at = first[row] + (np.arange(begin[-1]) - begin[row])
    length = np.minimum(n, size)[row]
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    out = length.astype(np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(k < length, padded[at + k], np.uint64(0))
        out = mixed(out) if k % 2 else out
    return mixed(out), begin
