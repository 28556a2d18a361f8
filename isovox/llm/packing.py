"""Best-fit packing by patterns: non-negative least squares fits repeat counts of patterns to the lengths' histogram.

A pattern is a few binned lengths that fill a sequence. Repeat counts are fitted to the histogram of bins by an
active set, rounded, and dealt the pieces that are there; what is left is fitted again until nothing more is placed,
and then goes by best fit. Only the histogram (at most one count per length up to the
sequence's) is on the driver; pieces find their place from their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isovox.llm import _text
from isovox.store import partitions, written

LENGTH = 2048
#: Steps that lengths are binned to, the shortest of them that no pattern has, and pieces in a pattern at most.
BINS, FILL, PIECES = 64, 3, 6
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker keeps; it begins anew beyond.
CACHE = 2_500_000
#: Words the tokenizer gets at once.
BATCH = 8192


class Ids:
    """Token ids of whole texts, from the ids of their words: the tokenizer never joins across white space.

    Words are known by their 64-bit hashes, in sorted arrays: a large one and one of the latest.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.old, self.new = none, none
        self.flat, self.ends, self.n = np.zeros(1 << 20, np.uint32), np.zeros(1 << 16, np.int64), 0

    @staticmethod
    def _find(known: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        """The numbers of sorted hashes, -1 where unknown."""
        if not len(known[0]):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
        return np.where(known[0][at] == h, known[1][at], -1)

    @staticmethod
    def _merged(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(one[0], other[0])
        return np.insert(one[0], at, other[0]), np.insert(one[1], at, other[1])

    def _learn(self, h: np.ndarray, new: list[str]) -> None:
        first = self.n
        for at in range(0, len(new), BATCH):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(new[at : at + BATCH], add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            ids = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
            begin = int(self.ends[self.n])
            while begin + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
            while self.n + len(got) + 1 > len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
            self.flat[begin : begin + len(ids)] = ids
            self.ends[self.n + 1 : self.n + 1 + len(got)] = begin + np.cumsum(sizes)
            self.n += len(got)
        self.new = self._merged(self.new, (h, np.arange(first, self.n)))
        if len(self.new[0]) > 200_000:
            self.old, self.new = self._merged(self.old, self.new), (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def of(self, column: pa.Array, last: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text followed by ``last``, end to end, and the n + 1 offsets."""
        w = _text.words(column)
        h, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if self.n + len(h) > CACHE:
            self._clear()
        number = np.maximum(self._find(self.old, h), self._find(self.new, h))
        lacking = np.flatnonzero(number < 0)
        if len(lacking):
            raw, i = w.data.tobytes(), first[lacking]
            number[lacking] = self.n + np.arange(len(lacking))
            self._learn(h[lacking], [raw[a:b].decode() for a, b in zip(w.start[i].tolist(), w.end[i].tolist(), strict=True)])
        number = number[back]
        begin, size = self.ends[number], self.ends[number + 1] - self.ends[number]
        before = np.concatenate([[0], np.cumsum(size)])
        # Each text's ids move on by one place for every text before it, whose last id stands there.
        total = int(before[-1])
        out = np.full(total + len(column), last, np.uint32)
        within = np.arange(total) - np.repeat(before[:-1], size)
        out[np.repeat(before[:-1] + w.doc(), size) + within] = self.flat[np.repeat(begin, size) + within]
        return out, before[w.first] + np.arange(len(column) + 1)


_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """This worker's own, kept from task to task."""
    if path not in _ids:
        _ids.clear()
        _ids[path] = Ids(path)
    return _ids[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each text's ids, the last id 0, cut at ``length``.

    A null or empty text is the last id alone. Repeated rows are packed each alone; rows without an id keep none. A text
    of any length is cut whole; other columns are left out. An empty table gives none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer)
        for part in _text.chunks(batches):
            flat, offs = ids.of(part.column("text"))
            n = -(-np.diff(offs) // length)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * length
            size = np.minimum(length, np.diff(offs)[row] - start)
            at = offs[:-1][row] + start
            raw = flat.astype("<u4", copy=False)
            crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)), np.int64, len(row))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def patterns(there: np.ndarray, total: int, most: int = PIECES) -> np.ndarray:
    """Rows of up to ``most`` of the bins ``there`` (rising, over 0) with a sum of ``total``, the largest first, 0: none."""
    rows, left, out = np.zeros((1, 0), np.int64), np.array([total]), [np.zeros((0, most), np.int64)]
    for k in range(most):
        last = rows[:, -1] if k else left
        i, j = np.nonzero((there[None] <= np.minimum(last, left)[:, None]) & (there[None] * (most - k) >= left[:, None]))
        rows, left = np.concatenate([rows[i], there[j][:, None]], axis=1), left[i] - there[j]
        whole = left == 0
        out.append(np.pad(rows[whole], ((0, 0), (0, most - k - 1))))
        rows, left = rows[~whole], left[~whole]
    return np.concatenate(out)


def fitted(rows: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares: which patterns repeat, and how often, to come closest to the histogram of bins.

    Lawson and Hanson's active set, to its end: the pattern that helps most joins, those that fall to zero leave. So
    no more patterns repeat than there are bins. Bins are scaled by 1 / sqrt(count) and weighted by their length, so
    that long texts, which are hardest to place, are fitted best.
    """
    size = len(have)
    scale = np.where(have > 0, np.sqrt(np.arange(size)) / np.sqrt(np.maximum(have, 1)), 0.0)
    goal = have * scale
    active, x, basis = np.zeros(0, np.int64), np.zeros(0), np.zeros((size, 0))
    if not len(rows):
        return active, x
    norm = np.sqrt((scale * scale)[rows].sum(axis=1))
    rest, least, out = goal, None, np.zeros(len(rows), bool)
    while True:
        gain = (rest * scale)[rows].sum(axis=1) / norm
        least = 1e-9 * np.abs(gain).max() if least is None else least
        gain[active] = gain[out] = 0
        new = int(gain.argmax())
        if gain[new] <= least:
            return active, x
        active, x = np.append(active, new), np.append(x, 0.0)
        basis = np.concatenate([basis, (np.bincount(rows[new], minlength=size) * scale)[:, None]], axis=1)
        while len(active):
            z = np.linalg.lstsq(basis, goal, rcond=None)[0]
            low = z <= 1e-10
            if not low.any():
                x = z
                break
            # As far towards z as all stay non-negative; what gets to zero leaves.
            at = x[low] / np.maximum(x[low] - z[low], 1e-300)
            x = x + at.min() * (z - x)
            stay = x > 1e-10
            stay[np.flatnonzero(low)[at.argmin()]] = False
            active, x, basis = active[stay], x[stay], basis[:, stay]
        rest = goal - basis @ x
        # A pattern that left at once, by rounding, has to wait until another has joined.
        out = out | (np.arange(len(rows)) == new) if new not in active else np.zeros(len(rows), bool)


def _taken(left: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` pieces of the given lengths, the most frequent first, and their running count; ``left`` loses them."""
    order = lengths[np.argsort(-left[lengths], kind="stable")]
    ends = np.minimum(np.cumsum(left[order]), most)
    left[order] -= np.diff(ends, prepend=0)
    return order, ends


def repeated(bins: list[int], times: int, left: np.ndarray, width: int, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Up to ``times`` sequences of a pattern of bins, as (lengths, repeats) rows; ``left`` loses their pieces.

    All lengths but the last come from their bins; the last is what fills the sequence to its end, in its bin or next
    to it. Where there is none, the pieces stay. Work follows the number of lengths in the bins, not of repeats.
    """
    made, slots = [], []
    for b in bins[:-1]:
        slots.append(_taken(left, np.arange(max(1, b * width - width // 2), min(length - 1, b * width + (width - 1) // 2) + 1), times))
    n = min([times, *(int(ends[-1]) for _, ends in slots)])
    cuts = np.unique(np.concatenate([[0, n], *(ends for _, ends in slots)]))
    for order, ends in slots:
        left[order] += np.diff(ends - np.minimum(ends, n), prepend=0)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a >= n:
            break
        head = [int(order[np.searchsorted(ends, a, side="right")]) for order, ends in slots]
        last = length - sum(head)
        n_whole = min(b - a, int(left[last])) if last > 0 else 0
        if n_whole:
            left[last] -= n_whole
            made.append(((*head, last), n_whole))
        np.add.at(left, head, b - a - n_whole)
    return made


def best_fit(have: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs a histogram, longest first, each into the fullest open sequence it fits; (lengths, repeats) rows.

    Sequences with the same room are one heap of (lengths, number); a whole run of equal lengths moves at once.
    """
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(length + 1)]
    spare = np.zeros(length + 1, bool)
    for size in range(length, 0, -1):
        left = int(have[size])
        while left:
            fits = np.flatnonzero(spare[size:])
            if len(fits):
                r = int(fits[0]) + size
                made, n = room[r].pop()
                spare[r] = bool(room[r])
            else:
                r, made, n = length, (), left
            # As many of this length as one sequence of this kind takes, on as many of them as there are.
            per = min(r // size, left)
            many = min(n, left // per)
            if n > many:
                room[r].append((made, n - many))
                spare[r] = r > 0 and bool(made)
            to = r - per * size
            room[to].append(((*made, *[size] * per), many))
            spare[to] = to > 0
            left -= per * many
    return [x for kind in room for x in kind if x[0] and x[1]]


def by_patterns(have: np.ndarray, length: int = LENGTH) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(lengths, repeats) rows of fitted patterns, and the histogram of the pieces left over.

    Lengths are binned to the nearest of ``BINS`` equal steps; those of the shortest ``FILL`` stay for the rooms that
    are left at the end. Repeats are rounded, and held down to the pieces that are there and fill a sequence exactly;
    what is left is fitted again, until a fit places nothing. A piece as long as a sequence is a pattern by itself.
    """
    left = have.astype(np.int64).copy()
    made = [((length,), int(left[length]))] if left[length] else []
    left[length] = 0
    width = max(1, length // BINS)
    total, fill = length // width, FILL if width > 1 else 1
    while True:
        bins = np.bincount((np.arange(length) + width // 2) // width, left[:length], minlength=total + 1)[: total + 1]
        bins[:fill] = bins[total] = 0
        rows = patterns(np.flatnonzero(bins), total)
        active, x = fitted(rows, bins)
        before = len(made)
        for i in np.argsort(-x, kind="stable"):
            if times := int(np.rint(x[i])):
                made += repeated([b for b in rows[active[i]].tolist() if b], times, left, width, length)
        if len(made) == before:
            return made, left


def plan(have: np.ndarray, length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) rows that use up the histogram ``have`` (its index: the length): patterns, then best fit."""
    made, left = by_patterns(have, length)
    return made + best_fit(left, length)


def packed(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """``found`` (a written table with doc_id, piece and length) with sequence_id and offset.

    The rank of a piece among those of its length comes from buckets by hash of the id, so the pieces of a
    frequent length are never in one task; ties in the order are between equal rows.
    """
    spark = found.sparkSession
    have = np.zeros(length + 1, np.int64)
    for r in found.groupBy("length").count().collect():
        have[r["length"]] = r["count"]
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    used = np.zeros(length + 1, np.int64)
    for sizes, n in plan(have, length):
        at = 0
        for size in sizes:
            slots.setdefault(size, []).append((int(used[size]), sequence, at))
            used[size] += n
            at += size
        sequence += n
    table = {k: np.array(v, np.int64) for k, v in slots.items()}
    n_buckets = 4 * partitions(spark)
    dealt = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)).cast("int"))
    cells = dealt.groupBy("length", "_bucket").count()
    cells = cells.select("length", "_bucket", (F.sum("count").over(W.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(cells, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).select(*found.columns, "_rank")

    columns = list(found.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence_id, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for k in np.unique(size):
                mine = np.flatnonzero(size == k)
                low, first, at = table[int(k)].T
                i = np.searchsorted(low, rank[mine], side="right") - 1
                sequence_id[mine], offset[mine] = first[i] + rank[mine] - low[i], at[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence_id), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema), "sequence_id bigint, offset bigint"])
    return ranked.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    return packed(written(pieces(docs, tokenizer, length), "pieces"), length)


def op2_pack(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
