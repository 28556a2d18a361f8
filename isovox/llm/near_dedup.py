"""MinHash near-deduplication with tensored banding.

Two small collections of ``bands`` half keys, each from two minhashes, make bands * bands table keys by pairing
a half of one with a half of the other: 4 * bands minhashes serve bands ** 2 tables of four. Documents with equal
shingle sets are one class. In every bucket the classes are compared with one leader on their full sets; where a
bucket's classes are then still in more than one component, those outside its main one are compared with all of
the bucket, in blocks, and only links leave a block. So no bucket is capped, and none is expanded into rows of all
its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isovox.llm import _text
from isovox.operators.components import components
from isovox.store import columns, dropped, fresh, written

#: Half keys in each of the two collections: a pair at the threshold shares no table with a chance of about 1e-5.
BANDS = 10
#: Classes in a block, where a bucket is compared in blocks, and shingles in one of long texts.
BLOCK, SHINGLES = 256, 1 << 20


def key_of() -> Column:
    """What names a row: its id and its text."""
    return F.xxhash64("doc_id", "text")


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and the n + 1 offsets.

    Words are lower-cased over A-Z; a text of fewer than ``k`` words has its whole sequence as one shingle.
    """
    w = _text.words(column, lower=True)
    h, counts = w.hashes(), w.counts
    hashed = _text.runs(h, k)
    sets, sizes = [], np.zeros(len(counts), np.int64)
    short = {n: _text.runs(h, n) for n in range(1, k) if (counts == n).any()}
    for d, (at, n) in enumerate(zip(w.first.tolist(), counts.tolist(), strict=False)):
        if n >= k:
            s = np.unique(hashed[at : at + n - k + 1])
        elif n:
            s = short[n][at : at + 1] + np.uint64(n)
        else:
            continue
        sets.append(s)
        sizes[d] = len(s)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def minhashes(sets: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """``n`` minhashes of each set that isn't empty, one row per set."""
    rng = np.random.default_rng(11)
    by = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 2**63, n, dtype=np.uint64)
    starts = offs[:-1][np.diff(offs) > 0]
    out = np.empty((len(starts), n), np.uint64)
    for j in range(n):
        out[:, j] = np.minimum.reduceat(sets * by[j] + plus[j], starts) if len(starts) else 0
    return out


def signatures(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """(key, doc_id, n_shingles, node, check, halves): ``node`` and ``check`` name the set; ``halves`` are none if it is empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.chunks(batches):
            sets, offs = shingle_sets(part.column("text"), k)
            sizes = np.diff(offs)
            full = sizes > 0
            starts = offs[:-1][full]
            node, check = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            if len(starts):
                node[full] = _text.mixed(np.add.reduceat(_text.mixed(sets), starts) + sizes[full].astype(np.uint64))
                check[full] = np.bitwise_xor.reduceat(_text.mixed(sets + np.uint64(1)), starts)
            m = minhashes(sets, offs, 4 * bands)
            half = _text.mixed(m[:, 0::2] * _text._STEP + _text.mixed(m[:, 1::2])).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(full, 2 * bands, 0))]).astype(np.int32)
            halves = pa.ListArray.from_arrays(pa.array(ends), pa.array(half.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(sizes), pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), halves], ["key", "doc_id", "n_shingles", "node", "check", "halves"])

    return docs.select(key_of().alias("key"), "doc_id", "text").mapInArrow(sign, "key bigint, doc_id bigint, n_shingles bigint, node bigint, check bigint, halves array<bigint>")


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard blobs: what goes on is less than half as large."""
    press = zstandard.ZstdCompressor(level=1)
    for part in _text.chunks(batches):
        data, offs = _text.views(part.column("text"))
        raw = data.tobytes()
        blobs = [press.compress(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(blobs, pa.binary())], ["key", "blob"])


def _sets(blobs: list[bytes], k: int) -> list[np.ndarray]:
    free = zstandard.ZstdDecompressor()
    out: list[np.ndarray] = []
    for at in range(0, len(blobs), 256):
        texts = pa.array([free.decompress(b).decode() for b in blobs[at : at + 256]], pa.string())
        sets, offs = shingle_sets(texts, k)
        out += [sets[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    return out


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                u, v = part.column("u").to_numpy(), part.column("v").to_numpy()
                nodes, first, back = np.unique(u, return_index=True, return_inverse=True)
                left = _sets([part.column("ublob")[int(i)].as_py() for i in first], k)
                right = _sets(part.column("vblob").to_pylist(), k)
                ok = np.array([alike(left[i], r, percent) for i, r in zip(back, right, strict=True)])
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], ["u", "v"])

    return run


def _block(k: int, percent: int):
    """All links of a block between classes of different components."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        node, label, main = (table.column(c).to_numpy() for c in ("node", "label", "main"))
        sets = _sets(table.column("blob").to_pylist(), k)
        size = np.array([len(s) for s in sets])
        who = np.repeat(np.arange(len(sets)), size)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        us, vs = [], []
        for i in np.flatnonzero(label != main):
            # How many shingles every other has in common with this one.
            lo, hi = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], side="right")
            n = hi - lo
            others = who[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            both = np.bincount(others, minlength=len(sets))
            j = np.flatnonzero((100 * both >= percent * (size[i] + size - both)) & (label != label[i]))
            us.append(np.full(len(j), node[i]))
            vs.append(node[j])
        return pa.table({"u": np.concatenate(us) if us else np.zeros(0, np.int64), "v": np.concatenate(vs) if vs else np.zeros(0, np.int64)})

    return run


def _cross_links(members: DataFrame, blobs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different components among the members (main, node, label, size) of each main component's buckets.

    Blocks of those in the main component meet blocks of the others, and blocks of the others each other.
    """
    side = F.col("label") == F.col("main")
    blocks = lambda mine: F.ceil(F.greatest(F.sum(mine.cast("int")) / BLOCK, F.sum(F.when(mine, F.col("size")).otherwise(0)) / SHINGLES)).cast("int")
    n = members.groupBy("main").agg(blocks(side).alias("mains"), blocks(~side).alias("others"))
    # Written, so that the join below has a shuffle of its own, whose large partitions can be split.
    n = written(n, "mains")
    seats = members.join(n, "main").withColumn("own", F.when(side, F.pmod(F.xxhash64("node", F.lit("block")), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("node", F.lit("block")), "others")).cast("int"))
    seats = seats.withColumn("with", F.explode(F.sequence(F.when(side, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)))
    seats = seats.select("main", "node", "label", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")).join(blobs, "node")
    links = written(seats.groupBy("main", "i", "j").applyInArrow(_block(k, percent), "u bigint, v bigint").distinct(), "cross-links")
    dropped(n)
    return links


def _classes(docs: DataFrame, k: int, percent: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (key, doc_id, n_shingles, node, check, ...) of each row, and (node, check, label) of each set.

    ``label`` is that of the set's component. ``key`` names a row by its id and its text, so that rows without an id
    take part as all others do.
    """
    signed = written(signatures(docs, k, bands), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("node", "check").agg(F.min("key").alias("rep"), F.first("halves").alias("halves"), F.first("n_shingles").alias("size"))
    classes = written(classes, "classes")
    # Halves that more than one class has: only they can make a key that is shared.
    halves = classes.select("node", F.posexplode("halves").alias("slot", "half"))
    shared = halves.groupBy("slot", "half").count().where("count > 1").select("slot", "half")
    hit = halves.join(shared, ["slot", "half"]).groupBy("node").agg(F.collect_list(F.struct("slot", "half")).alias("own"))
    ones, others = F.filter("own", lambda x: x["slot"] < bands), F.filter("own", lambda x: x["slot"] >= bands)
    keys = hit.select("node", ones.alias("ones"), others.alias("others"))
    keys = keys.select("node", F.explode(F.flatten(F.transform("ones", lambda x: F.transform("others", lambda y: F.xxhash64(x["slot"], y["slot"], x["half"], y["half"]))))).alias("key"))
    keys = written(keys, "keys")
    lead = keys.groupBy("key").agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = written(keys.join(lead, "key").where("node <> u").select("u", F.col("node").alias("v")).distinct(), "pairs")
    # Texts of the classes that are in a pair, shuffled once, compressed; rows that repeat an id and a text meet there.
    wanted = written(pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "node").join(classes.select("node", F.col("rep").alias("key")), "node"), "wanted")
    squeezed = docs.select(key_of().alias("key"), "text").mapInArrow(_squeeze, "key bigint, blob binary")
    blobs = written(squeezed.join(wanted.hint("merge"), "key").dropDuplicates(["key"]).select("node", "blob"), "blobs")
    u, v = blobs.select(F.col("node").alias("u"), F.col("blob").alias("ublob")), blobs.select(F.col("node").alias("v"), F.col("blob").alias("vblob"))
    links = written(pairs.join(v, "v").join(u, "u").mapInArrow(_verify(k, percent), "u bigint, v bigint"), "links")
    label = written(components(links), "labels")
    # Buckets still in more than one component: all of those with one main component are compared together, once.
    told = keys.join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = told.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(told.join(mixed.select("key", "main"), "key").select("main", "node", "label").distinct().join(classes.select("node", "size"), "node"), "members")
    if not members.isEmpty():
        more = _cross_links(members, blobs, k, percent)
        dropped(label)
        label = written(components(links.union(more)), "labels")
        dropped(more)
    of = written(classes.join(label, "node", "left").select("node", "check", F.coalesce("label", "node").alias("label")), "components")
    for table in (classes, keys, pairs, wanted, blobs, links, label, members):
        dropped(table)
    return signed, of


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text and any others).

    A null, empty or blank text has no shingle and links with nothing; its component is its own id. Equal sets are
    linked, so repeated rows are in one component. Rows without an id link as others do, and a component of such rows
    alone has none; rows of one id with other texts stand each for itself. Texts of any length are compared whole.
    Other columns are left out; an empty table gives none.
    """
    signed, of = _classes(docs, k, percent, bands)
    # The least id of each component, written: a component of a third of all rows is then split in the join.
    least = written(signed.where("n_shingles > 0").groupBy("node", "check").agg(F.min("doc_id").alias("id")).join(of, ["node", "check"]).groupBy("label").agg(F.min("id").alias("component_id")), "least")
    named = written(of.join(least, "label").select("node", "check", "component_id"), "named")
    full = signed.select("doc_id", "n_shingles", "node", "check").join(named, ["node", "check"], "left")
    return full.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 12) -> DataFrame:
    """``docs`` with one row of each component: that of its least id (null last), of several the first by a hash.

    Of rows that repeat both id and text one stays. Null, empty and blank texts are no copies of others and stay. All
    columns stay as they are; an empty table gives none.
    """
    signed, of = _classes(docs, k, percent, bands)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "key")
    chosen = signed.where("n_shingles > 0").groupBy("node", "check").agg(F.min(first).alias("first")).join(of, ["node", "check"]).groupBy("label").agg(F.min("first").alias("first")).select("first.key")
    p = fresh(docs, "dedup")
    kept = written(chosen.union(signed.where("n_shingles = 0").select("key").distinct()).withColumnRenamed("key", p + "key"), "kept")
    rows = docs.withColumn(p + "key", key_of()).join(kept, p + "key", "left_semi")
    return rows.withColumn(p + "n", F.row_number().over(W.partitionBy(p + "key").orderBy("doc_id"))).where(F.col(p + "n") == 1).select(*columns(docs))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s FROM x),
s AS (SELECT DISTINCT doc_id, s FROM g WHERE i <= n - 2 OR (n < 3 AND i = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM c GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""
