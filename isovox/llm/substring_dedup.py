"""Removal of repeated passages, found by anchors on a difference cover.

{0, 1, 3, 9} is a perfect difference cover modulo 13: for any two starts i and j there is a d under 13 with i + d
and j + d both in it, modulo 13. So two equal windows of 20 words share an aligned anchor of 8 words at a place of
the cover, and hashes of 4 in 13 places find every candidate. A shared anchor is then extended: the 20-word windows
around it are compared by 80 bits of hash, and all but the first in (doc_id, start) are covered words to remove.

What is compared goes to buckets by hash, one packed blob for each task and bucket; a task sends an anchor or a
window once, however often it has it, so a passage that every document holds is no hot bucket. Parts and buckets are
as many as the texts' bytes ask for.

A document is a pair of an id and a text, known by a 64-bit key of both; in order they go by id, then by a hash of the
text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isovox.llm import _text

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Anchors a task holds before it packs them.
HELD = 3_000_000
#: What stands for a null id, which comes before all others.
LEAST = -(2**63)
#: Bytes of text to a part.
PART = 64 << 20

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_BLOBS = "bucket bigint, known boolean, blob binary"
_TOLD = "part bigint, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one blob; bytes of the same place stand together, so that small numbers take little."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blobs: list[bytes], *kinds: type) -> list[np.ndarray]:
    """The arrays of all blobs, end to end."""
    free, width = zstandard.ZstdDecompressor(), sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for blob in blobs:
        raw = np.frombuffer(free.decompress(blob), np.uint8).reshape(width, -1)
        at = 0
        for k, arrays in zip(kinds, out, strict=True):
            size = np.dtype(k).itemsize
            arrays.append(np.ascontiguousarray(raw[at : at + size].T).view(k).ravel())
            at += size
    return [np.concatenate(a) for a in out]


def key_of(doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The keys of documents, from their ids and the hashes of their texts."""
    return _text.mixed(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _text.mixed(text))


def text_hashes(column: pa.Array) -> np.ndarray:
    data, offs = _text.views(column)
    raw = memoryview(np.ascontiguousarray(data))
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)), np.uint64, len(column))


def short(key: np.ndarray) -> np.ndarray:
    """40 bits of a key: enough for anchors, where two documents with the same only get each other's to look at."""
    return key >> np.uint64(24)


def part_of(key: np.ndarray, n: int) -> np.ndarray:
    """The part of a document, by its short key."""
    return (key % np.uint64(n)).astype(np.int64)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets by the upper half of a hash: in order of the hash, so that sorted hashes are sorted by bucket."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _split(key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One blob for each value of the sorted ``key``."""
    if len(key):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(key[a]), pack(*(x[a:b] for x in arrays))


def _told(key: np.ndarray, pos: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort((pos, key, part))
    yield from _split(part[order], key[order], pos[order])


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, ["bucket", "known", "blob"], [pa.int64(), pa.bool_(), pa.binary()])


def anchors(n: int):
    """Packed (hash, key, place) of the anchors of all texts, each hash once for a task; the rest are known to be shared."""

    def pour(held: list[tuple]) -> pa.RecordBatch:
        h, key, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, key, pos = h[order], key[order], pos[order]
        again = np.concatenate([[False], h[1:] == h[:-1]])
        shared = again | np.append(again[1:], False)
        one = ~again
        rows = [(b, False, x) for b, x in _split(bucket_of(h[one], n), h[one] & np.uint64(0xFFFFFFFFFFFF), key[one], pos[one])]
        return _blobs(rows + [(p, True, x) for p, x in _told(key[shared], pos[shared], part_of(key[shared], n))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in _text.chunks(batches):
            w = _text.words(part.column("text"))
            place = np.arange(len(w.start)) - np.repeat(w.first[:-1], w.counts)
            at = _text.inside_doc(w.first, ANCHOR)
            at = at[_IN_COVER[place[at] % PERIOD]]
            doc = w.doc()[at]
            long = w.counts[doc] >= WINDOW
            at, doc = at[long], doc[long]
            if len(at):
                key = short(key_of(part.column("doc_id").to_numpy(), text_hashes(part.column("text"))))
                held.append((_text.runs(w.hashes(), ANCHOR)[at], key[doc], place[at].astype(np.uint32)))
                size += len(at)
            if size > HELD:
                yield pour(held)
                held, size = [], 0
        if held:
            yield pour(held)

    return run


def _shared(n: int):
    """Of one bucket: the places of anchors that more than one task has."""

    def run(table: pa.Table) -> pa.Table:
        known = table.column("known").to_numpy()
        blobs = table.column("blob").to_pylist()
        h, key, pos = unpack([b for b, k in zip(blobs, known, strict=True) if not k], np.uint64, np.uint64, np.uint32)
        order = np.argsort(h, kind="stable")
        h = h[order]
        again = np.concatenate([[False], h[1:] == h[:-1]])[: len(h)]
        mine = order[again | np.append(again[1:], False)[: len(h)]]
        rows = list(_told(key[mine], pos[mine], part_of(key[mine], n)))
        rows += [(b, x) for b, x, k in zip(table.column("bucket").to_pylist(), blobs, known, strict=True) if k]
        return pa.Table.from_batches([_batch(rows, ["part", "blob"], [pa.int64(), pa.binary()])])

    return run


def _marks(keys: np.ndarray, told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted places told of documents, and for each of ``keys`` where its own begin and end."""
    key, pos = unpack(told.column("blob").to_pylist(), np.uint64, np.uint32)
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order].astype(np.int64)
    return pos, np.searchsorted(key, keys), np.searchsorted(key, keys, side="right")


def _covered(first: np.ndarray, owner: np.ndarray, pos: np.ndarray, before: int, after: int) -> np.ndarray:
    """The words from ``before`` words before each place to ``after`` words after it, cut at the text's ends."""
    begin, end = first[:-1][owner], first[1:][owner]
    steps = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(steps, np.maximum(begin, begin + pos - before), 1)
    np.add.at(steps, np.minimum(end, begin + pos + after), -1)
    return np.cumsum(steps[:-1]) > 0


def _extend(n: int):
    """Around shared anchors: packed (hash, more hash, id, text hash, start) of the windows, each hash once; the rest are known to repeat."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        docs, sums = texts.column("doc_id").to_numpy(), texts.column("hash").to_numpy().view(np.uint64)
        pos, lo, hi = _marks(short(key_of(docs, sums)), told)
        rows, held = np.flatnonzero(hi > lo), []
        free, blobs = zstandard.ZstdDecompressor(), texts.column("blob")
        for k in range(0, len(rows), 512):
            own = rows[k : k + 512]
            w = _text.words(pa.array([free.decompress(blobs[int(i)].as_py()).decode() for i in own], pa.string()))
            marks = hi[own] - lo[own]
            each = np.repeat(lo[own] - np.cumsum(marks) + marks, marks) + np.arange(marks.sum())
            near = _covered(w.first, np.repeat(np.arange(len(own)), marks), pos[each], PERIOD - 1, 1)
            at = _text.inside_doc(w.first, WINDOW)
            at = at[near[at]]
            if len(at):
                h, doc = w.hashes(), w.doc()[at]
                held.append((_text.runs(h, WINDOW)[at], (_text.runs(_text.mixed(h), WINDOW)[at] & np.uint64(0xFFFF)).astype(np.uint16), docs[own][doc], sums[own][doc], (at - w.first[doc]).astype(np.uint32)))
        if not held:
            return pa.Table.from_batches([_blobs([])])
        *window, again = _in_order(*(np.concatenate(x) for x in zip(*held, strict=True)))
        one, key = ~again, key_of(window[2], window[3])[again]
        rows = [(b, False, x) for b, x in _split(bucket_of(window[0][one], n), *(x[one] for x in window))]
        return pa.Table.from_batches([_blobs(rows + [(p, True, x) for p, x in _told(key, window[4][again], part_of(short(key), n))])])

    return run


def _in_order(h: np.ndarray, more: np.ndarray, doc: np.ndarray, text: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows in order, and which of them have an earlier equal one. Repeats of one place are one window."""
    order = np.lexsort((pos, text, doc, more, h))
    h, more, doc, text, pos = (x[order] for x in (h, more, doc, text, pos))
    if not len(h):
        return h, more, doc, text, pos, np.zeros(0, bool)
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (more[1:] == more[:-1])])
    one = ~(same & np.concatenate([[False], (doc[1:] == doc[:-1]) & (text[1:] == text[:-1]) & (pos[1:] == pos[:-1])]))
    return h[one], more[one], doc[one], text[one], pos[one], same[one]


def _later(n: int):
    """Of one bucket: the windows that have an earlier equal one."""

    def run(table: pa.Table) -> pa.Table:
        known = table.column("known").to_numpy()
        blobs = table.column("blob").to_pylist()
        _, _, doc, text, pos, again = _in_order(*unpack([b for b, k in zip(blobs, known, strict=True) if not k], np.uint64, np.uint16, np.int64, np.uint64, np.uint32))
        key = key_of(doc, text)[again]
        rows = list(_told(key, pos[again], part_of(short(key), n)))
        rows += [(b, x) for b, x, k in zip(table.column("bucket").to_pylist(), blobs, known, strict=True) if k]
        return pa.Table.from_batches([_batch(rows, ["part", "blob"], [pa.int64(), pa.binary()])])

    return run


def _remove(texts: pa.Table, told: pa.Table) -> pa.Table:
    docs = texts.column("doc_id").to_numpy()
    pos, lo, hi = _marks(key_of(docs, texts.column("hash").to_numpy().view(np.uint64)), told)
    free, rows = zstandard.ZstdDecompressor(), []
    for i, blob in enumerate(texts.column("blob")):
        # bytes.split() parts at 0x20 and 0x09-0x0D, just as words are.
        kept = free.decompress(blob.as_py()).split()
        n = len(kept)
        if hi[i] > lo[i]:
            gone = _covered(np.array([0, n]), np.zeros(hi[i] - lo[i], np.int64), pos[lo[i] : hi[i]], 0, WINDOW)
            kept = list(compress(kept, (~gone).tolist()))
        rows.append((int(docs[i]), n, n - len(kept), b" ".join(kept)))
    return pa.Table.from_batches([_batch(rows, ["doc_id", "n_words", "n_removed", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()])])


def _digest(texts: pa.Table, told: pa.Table) -> pa.Table:
    made = _remove(texts, told)
    return made.set_column(3, "kept", pa.array([hashlib.sha256(x.as_py()).digest() for x in made.column("kept")], pa.binary()))


def _press(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for part in _text.chunks(batches):
            data, offs = _text.views(part.column("text"))
            raw = data.tobytes()
            blobs = [press.compress(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            ids, sums = part.column("doc_id").to_numpy(), text_hashes(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(part_of(short(key_of(ids, sums)), n)), pa.array(ids), pa.array(sums.view(np.int64)), pa.array(blobs, pa.binary())], ["part", "doc_id", "hash", "blob"])

    return run


def without_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words of each text less those in a repeat of an earlier window, as bytes.

    The words are joined by one space (``digest``: the SHA-256 of that). Null and empty texts have no words; texts
    under 20 words lose none; texts of any length are read whole. A null id counts as the least. Rows of one id, or
    without any, and one text are one document, and none is a repeat of the other; with other texts they are documents
    of their own, in order of a hash of the text. The first of overlapping repeats within a text stays. Other columns
    are left out; an empty table gives none.
    """
    docs = docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("doc_id"), "text")
    n = _text.parts_of(docs, PART)
    texts = docs.mapInArrow(_press(n), "part bigint, doc_id bigint, hash bigint, blob binary")
    shared = docs.mapInArrow(anchors(n), _BLOBS).groupBy("bucket").applyInArrow(_shared(n), _TOLD)
    windows = texts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_extend(n), _BLOBS)
    later = windows.groupBy("bucket").applyInArrow(_later(n), _TOLD)
    made = texts.groupBy("part").cogroup(later.groupBy("part")).applyInArrow(_digest if digest else _remove, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")
    return made.withColumn("doc_id", F.nullif("doc_id", F.lit(LEAST)))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    made = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return made.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS seq FROM x),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS k FROM g WHERE i <= n - 19),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE k > 1),
k AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN c USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
