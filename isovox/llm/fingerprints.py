"""Improbable-feature fingerprints of documents.

Every 64-byte window gets a rank from its byte entropy: windows of unusual entropy are improbable, those of the
lowest entropy say nothing and have no rank. In every run of 64 windows the most improbable one (the first of
equals) gains a point; windows with enough points are the text's features, kept in order. Features go, five bits
each, into Bloom filters of 2048 bits chained one after another, 160 distinct features to a filter.

Likeness compares filters by the overlap of their bits, less what chance would give, over the most there could be;
each filter of the shorter chain takes its best match, and the mean is weighted by features.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isovox.llm import _text

WINDOW = 64
#: Points that make a window a feature.
POINTS = 16
BITS = 2048
HASHES = 5
FILTER = 160
#: Entropy of a window in thousandths of the most there can be; below, windows are repetitive and say nothing.
FLOOR = 100
#: Bytes of text to a block.
BLOCK = 32 << 20
#: What stands for a null id, and the least hash.
LEAST = -(2**63)

_N = np.arange(WINDOW + 1, dtype=np.float64)
_PART = np.where(_N > 0, _N * np.log2(np.maximum(_N, 1)), 0.0)
#: n log2 n in 2**-20ths, so that sliding sums are exact.
_WHOLE = np.round(_PART * (1 << 20)).astype(np.int64)


def entropies(data: np.ndarray) -> np.ndarray:
    """Byte entropy of each 64-byte window, in thousandths of six bits, by sliding sums of n log2 n.

    A window's sum changes with the count of the byte that leaves and of the one that comes. Both counts are
    differences of places in the sorted list of (byte, position).
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (n + WINDOW + 1) + order
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # How many of the same byte stand in the 64 bytes from each position on, itself included.
    reach = np.searchsorted(key, key + WINDOW)
    ahead = np.empty(n, np.int64)
    ahead[order] = reach - np.arange(n)
    # How many stand in the 63 bytes before each position.
    low = np.searchsorted(key, key - (WINDOW - 1))
    behind = np.empty(n, np.int64)
    behind[order] = np.arange(n) - low
    counts = np.bincount(data[:WINDOW], minlength=256)
    first = int(_WHOLE[counts].sum())
    out = ahead[: n - WINDOW]  # of the byte that leaves, in the window it leaves
    new = behind[WINDOW:]  # of the byte that comes, in the 63 that stay
    steps = _WHOLE[out - 1] - _WHOLE[out] + _WHOLE[new + 1] - _WHOLE[new]
    sums = first + np.concatenate([[0], np.cumsum(steps)])
    return ((6 * WINDOW * (1 << 20) - sums) * 1000) // (6 * WINDOW * (1 << 20))


#: Entropy around which windows of prose lie; the further from it, the more improbable.
USUAL = 660


def features(data: np.ndarray) -> np.ndarray:
    """The hashes of a text's features, in order; texts under one window have themselves as a feature."""
    n = len(data)
    if n < WINDOW:
        return np.array([int.from_bytes(hashlib.blake2b(data.tobytes(), digest_size=8).digest(), "little")], np.uint64) if n else np.zeros(0, np.uint64)
    return _features(data, entropies(data))


def _features(data: np.ndarray, entropy: np.ndarray) -> np.ndarray:
    # A fixed mixing of the first bytes breaks ties between windows of equal entropy.
    rank = 1000 - np.abs(entropy - USUAL)
    lead = data[: len(entropy)].astype(np.int64) * 31 + data[7 : 7 + len(entropy)].astype(np.int64) * 17 + data[23 : 23 + len(entropy)]
    rank = rank * 256 + (lead * 167) % 256
    rank[entropy < FLOOR] = 1 << 20
    m = len(rank)
    width = min(WINDOW, m)
    # The least (rank, place) of each run of windows, by prefix and suffix minima of blocks.
    pad = -m % width
    key = np.concatenate([(rank << 32) | np.arange(m), np.full(pad, np.iinfo(np.int64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: m - width + 1], ahead[width - 1 : m])
    points = np.bincount(least & 0xFFFFFFFF, minlength=m)
    points[entropy < FLOOR] = 0
    at = np.flatnonzero(points >= POINTS)
    if not len(at):
        at = np.array([int((least & 0xFFFFFFFF)[0])])
    cells = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at]
    lanes = np.ascontiguousarray(cells).view("<u8").astype(np.uint64)
    h = np.zeros(len(at), np.uint64)
    for j in range(lanes.shape[1]):
        h = _text.mixed((h ^ lanes[:, j]) + np.uint64(j + 1))
    return h


def chain(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters (rows of bytes) and the number of distinct features in each."""
    if not len(h):
        return np.zeros((0, BITS // 8), np.uint8), np.zeros(0, np.int64)
    _, first = np.unique(h, return_index=True)
    h = h[np.sort(first)]
    link = np.arange(len(h)) // FILTER
    bits = np.zeros((int(link[-1]) + 1, BITS), np.uint8)
    for j in range(HASHES):
        bits[link, ((h >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1), np.bincount(link)


def encode(made: tuple[np.ndarray, np.ndarray]) -> str:
    """Each link as its number of features, a colon and its bits in base 64; links parted by full stops."""
    return ".".join(f"{n}:{base64.b64encode(row.tobytes()).decode()}" for row, n in zip(*made, strict=True))


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [x.split(":") for x in fingerprint.split(".")] if fingerprint else []
    rows = [np.frombuffer(base64.b64decode(b), np.uint8) for _, b in parts]
    return np.array(rows, np.uint8).reshape(-1, BITS // 8), np.array([int(n) for n, _ in parts], np.int64)


def likeness(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; two chains without a feature are alike, one without and one with are not."""
    (a, n), (b, m) = one, other
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or (len(a) == len(b) and n.sum() > m.sum()):
        a, n, b, m = b, m, a, n
    x = np.unpackbits(a, axis=1).astype(np.float32)
    y = np.unpackbits(b, axis=1).astype(np.float32)
    p, q = x.sum(axis=1), y.sum(axis=1)
    both = x @ y.T
    most = np.minimum(p[:, None], q[None])
    chance = p[:, None] * q[None] / BITS
    score = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    # A filter with fewer features than its match can only be found in it in part.
    return float(np.clip((score.max(axis=1) * n).sum() / n.sum(), 0, 1))


def of_text(text: str | None) -> str:
    return encode(chain(features(np.frombuffer((text or "").encode(), np.uint8))))


def in_line(docs: DataFrame) -> DataFrame:
    """Blocks of rows in order of (doc_id, a hash of the text), each with the first rows of the next (``guest``).

    The last block's guests are the first rows of all; ids are null first. Bounds come from the ids alone, and each
    text is shuffled once, to the task of its block. There are as many blocks as the texts' bytes ask for; an id that
    would fill several (all rows without one, say) is split among them by the hash.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("id"))
    n = _text.parts_of(docs, BLOCK)
    at = ids.approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    # A bound that comes m times is an id of m blocks or more: m equal ranges of the hash.
    cuts = [(int(i), LEAST + j * (2**64 // m)) for i, m in sorted(Counter(at).items()) for j in range(m)]
    placed = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(LEAST)), "_hash": F.xxhash64("text")})
    placed = placed.withColumn("_block", _search(F.col("_id"), F.col("_hash"), cuts))
    firsts = sorted(tuple(r) for r in placed.groupBy("_block").agg(F.min(F.struct("_id", "_hash")).alias("f")).select("_block", "f._id", "f._hash").collect())
    if not firsts:
        return placed.withColumn("guest", F.lit(False))
    # Of each block: its first row, and the block before it, whose guest that is.
    first_id, first_hash, host = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for i, (block, id_, hash_) in enumerate(firsts):
        first_id[block], first_hash[block], host[block] = id_, hash_, firsts[i - 1][0]
    of = lambda values: F.element_at(_array(values), F.col("_block") + 1)
    leads = (F.col("_id") == of(first_id)) & (F.col("_hash") == of(first_hash))
    seat = lambda block, guest: F.struct(block.cast("int").alias("block"), F.lit(guest).alias("guest"))
    own = seat(F.col("_block"), False)
    seats = F.when(leads, F.array(own, seat(of(host), True))).otherwise(F.array(own))
    line = placed.select(*docs.columns, "_id", "_hash", F.explode(seats).alias("_seat")).select(*docs.columns, "_id", "_hash", F.col("_seat.block").alias("_block"), F.col("_seat.guest").alias("guest"))
    return line.repartitionById(len(cuts) + 1, F.col("_block")).sortWithinPartitions("_block", "guest", "_id", "_hash", "text")


def _array(values: list[int]) -> Column:
    """One literal, however many values."""
    return F.lit(np.array(values, np.int64))


def _search(key: Column, more: Column, cuts: list[tuple[int, int]]) -> Column:
    """The number of cuts at or below (key, more), by halving: work and size of the expression follow the log of the cuts."""
    if not cuts:
        return F.lit(0)
    ids, hashes = (_array(list(c)) for c in zip(*cuts, strict=True))
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]

    def on(below: Column, step: Column) -> Column:
        to = below + step
        at, sub = F.try_element_at(ids, to), F.try_element_at(hashes, to)
        return F.when((to <= len(cuts)) & ((at < key) | ((at == key) & (sub <= more))), to).otherwise(below)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), on)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of (doc_id, text).

    The next row is that of the next id, of the same id next in order of a hash of the text, or after the last the
    first; a single row is its own next. A null text is empty, its fingerprint the empty string. Whole texts are
    read, however long; repeated rows give as many rows; other columns are left out, whatever their names; an empty
    table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for part in _text.chunks(batches):
            rows: list[tuple] = []
            ids, blocks, guests = (part.column(c).to_pylist() for c in ("doc_id", "_block", "guest"))
            for doc_id, text, block, guest in zip(ids, part.column("text").to_pylist(), blocks, guests, strict=True):
                text = text or ""
                if held is not None and held[0] == block:
                    rows.append(_row(held, text, (own := None if guest else _own(text))))
                else:
                    own = None if guest else _own(text)
                # After the first guest a block is over; further guests are equal ids.
                held = None if guest else [block, doc_id, text, own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    docs = docs.select("doc_id", "text")
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_line(docs).select("doc_id", "text", "_block", "guest").mapInArrow(run, schema)


def _own(text: str) -> tuple:
    data = np.frombuffer(text.encode(), np.uint8)
    entropy = entropies(data)
    return data, entropy, chain(_features(data, entropy) if len(data) >= WINDOW else features(data))


def _row(held: list, following: str, own: tuple | None) -> tuple:
    _, doc_id, text, (data, entropy, mine) = held
    n = len(text)
    k = n // 4
    tail = following[:k]
    edited = (text[: n - k] + tail).encode()
    new = np.frombuffer(edited, np.uint8)
    if len(new) < WINDOW:
        theirs = chain(features(new))
    else:
        # Windows that end before the edit keep their entropy.
        same = max(0, len(edited) - len(tail.encode()) - WINDOW + 1)
        same = min(same, len(entropy))
        theirs = chain(_features(new, np.concatenate([entropy[:same], entropies(new[same:])])))
    after = own[2] if own else chain(features(np.frombuffer(following.encode(), np.uint8)))
    return doc_id, n, hashlib.sha256(edited).hexdigest(), encode(mine), encode(theirs), likeness(mine, theirs), likeness(mine, after)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprinted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
