"""Arrays of words for Arrow batches: what the numpy kernels of this subpackage share.

A word is a run of bytes other than `\\x20` and `\\x09-\\x0D`, which is what bytes.split() gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
CACHE = 200_000


class Hashes(dict):
    """64-bit hashes of words; forgets all when full, so that its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of at most that many bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, ends = 0, np.cumsum(sizes)
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # a worker lives on beyond its task


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chain(key: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The key of a sequence from the key of all but its last member, and that member."""
    return mix64(key * np.uint64(0x9E3779B97F4A7C15) + new.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
