"""Words, hashes and shingles of many texts at once, in numpy.

The executors' Python workers get texts as Arrow binary columns.  A *slab* is
some whole rows of such a column, about ``SLAB`` bytes of text at a time, so
memory stays bounded whatever the batch holds; a single longer text makes one
larger slab.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

SLAB = 1 << 20

# The odd multipliers of the hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WHITE = b"\x09\x0a\x0b\x0c\x0d\x20"
TO_BLANK = bytes(32 if x in WHITE else x for x in range(256))
LOWER_TO_BLANK = ASCII_LOWER.translate(TO_BLANK)

_powers = np.ones(1, np.uint64)


def give_back() -> None:
    """Free memory goes back to the system, where the C library offers that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidied(run):
    """run over batches; afterwards the idle worker keeps no memory that it does not use.

    Workers stay for later tasks, several to an executor, so what one keeps the
    others lack.
    """

    @functools.wraps(run)
    def out(batches):
        yield from run(batches)
        give_back()

    return out


def powers(n: int) -> np.ndarray:
    """BASE to the power 0..n, modulo 2**64; the longest asked for so far is kept."""
    global _powers
    if len(_powers) <= n:
        p = np.full(max(n, SLAB) + 1, BASE, np.uint64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def binary(column) -> pa.Array:
    """The column as one binary array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    return column


def slabs(column, most: int = SLAB):
    """Yield (first row, row after the last, bytes, offsets from 0) for whole rows of a binary column."""
    column = binary(column)
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = memoryview(data) if data is not None else memoryview(b"")
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, bytes(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words of a slab: maximal runs of bytes other than a blank, never across texts.

    start, end: byte places; first: for each text the number of its first word,
    and one more entry; hashes: 64 bits a word.
    """

    def __init__(self, data: bytes, offsets: np.ndarray, table: bytes = LOWER_TO_BLANK, hashed: bool = True):
        self.bytes = data.translate(table)
        b = np.frombuffer(self.bytes, np.uint8)
        n = len(b)
        word = b != 32
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        before[offsets[offsets < n]] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        last = offsets - 1
        after[last[last >= 0]] = False
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        if hashed:
            p = powers(n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[n:0:-1], out=sums[1:])
            back = np.uint64(pow(int(BASE), -n, 1 << 64))
            self.hashes = mix((sums[self.end] - sums[self.start]) * p[self.start] * back + (self.end - self.start).astype(np.uint64))

    def shingles(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of w successive words, and for each text the number of its first one, and one more entry."""
        n = len(self.hashes)
        owner = np.repeat(np.arange(len(self.count)), self.count)
        if n < w:
            return np.zeros(0, np.uint64), np.zeros(len(self.first), np.int64)
        m = n - w + 1
        s = np.zeros(m, np.uint64)
        for k in range(w):
            s *= BASE
            s += self.hashes[k : k + m]
        whole = owner[:m] == owner[w - 1 :]
        s = mix(s[whole])
        first = np.zeros(len(self.first), np.int64)
        np.cumsum(np.maximum(self.count - w + 1, 0), out=first[1:])
        return s, first
