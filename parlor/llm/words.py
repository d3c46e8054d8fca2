"""Words of many texts at once: spans and 64-bit hashes by numpy over the Arrow buffers of a column.

A word is a run of ``[^\x20\x09-\x0D]`` in UTF-8. Hashes are polynomials over bytes mixed by a random table, modulo 2**64, so
that the hash of a run of words is a difference of two prefix sums. Equal runs have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(11)).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_P, _Q = 0x9E3779B97F4A7C17, 0xC2B2AE3D27D4EB57  # odd multipliers; P-1 and Q-1 are twice an odd number
SLICE_BYTES = 4 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            both = []
            for base in (self.base, self.inverse):
                x = np.full(self.n, base, np.uint64)
                x[0] = 1
                both.append(np.multiply.accumulate(x))
            self.up, self.down = both
        return self.up, self.down


_BYTES, _RUNS = _Powers(_P), _Powers(_Q)


@dataclass
class Words:
    """buf: UTF-8 of all texts; starts, ends: byte spans of the words; first: index of each text's first word, one more at the end."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        n = len(self.buf)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = _BYTES.of(n + 1)
        table = _BYTE[LOWER] if lower else _BYTE
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[self.buf] * up[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def run_sums(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``run_hashes`` takes the hash of any run of words."""
    up, _ = _RUNS.of(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, at: np.ndarray, length) -> np.ndarray:
    """Hash of the words at ... at + length - 1."""
    _, down = _RUNS.of(len(sums))
    return mix((sums[at + length] - sums[at]) * down[at] + np.asarray(length).astype(np.uint64))


def words_of(texts: pa.Array) -> Words:
    """Words of each text; null counts as empty."""
    texts = pc.fill_null(texts, "")
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None or offsets is None:
        return Words(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    n = len(buf)
    if n == 0:
        return Words(buf, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    solid = ~SPACE[buf]
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    before[off[1:-1][off[1:-1] < n]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    inner = off[1:-1]
    after[inner[(inner > 0) & (inner <= n)] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return Words(buf, starts, ends, np.searchsorted(starts, off))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts take about ``limit`` bytes at most (or one row), which bounds the memory of a task."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), np.int64)
        total, at = np.concatenate([[0], np.cumsum(sizes)]), 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
