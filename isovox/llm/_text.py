"""Vectorised words and hashes over the bytes of Arrow string columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D, which is the same in UTF-8 bytes and in
code points. Every hash is a function of the bytes alone, so it is the same in any task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isovox.store import partitions

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK = 2 << 20

_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(int(_random.integers(1, 2**62)) * 4 + 1)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and STEP**-i modulo 2**64 for i under n."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n else 1 << 16
        up, down = np.full(size, _STEP), np.full(size, _BACK)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= CHUNK * 2:
            _powers[0] = have
    return have[0][:n], have[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published splitmix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(ends, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offs - offs[0]


def chunks(batches: Iterable[pa.RecordBatch], name: str = "text", limit: int = CHUNK, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of at most ``limit`` bytes of text and ``rows`` rows, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offs = views(batch.column(name))[1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
            to = min(batch.num_rows, at + rows, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """The words of some texts, in order; ``first[d]`` is the number of words before text ``d``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        up, down = powers(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up, out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * down[self.start] if len(self.start) else np.zeros(0, np.uint64)
        return mixed(h)


def words(column: pa.Array, lower: bool = False) -> Words:
    data, offs = views(column)
    if lower:
        data = LOWER[data]
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offs))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive entries of ``h``; those over a text's end are the caller's to skip."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[:n])


def inside_doc(first: np.ndarray, k: int) -> np.ndarray:
    """The places at which ``k`` consecutive words of one text begin."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int64)
    counts = np.diff(first)
    full = counts >= k
    np.add.at(ok, first[:-1][full], 1)
    np.add.at(ok, first[1:][full] - k + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:n]) > 0)


def parts_of(docs: DataFrame, size: int, name: str = "text") -> int:
    """The session's shuffle partitions, or more, so that a part has about ``size`` bytes of the texts."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(name)), F.lit(0))).first()[0]
    return max(partitions(docs.sparkSession), -(-int(total) // size))
