"""Language identification by nearest centroid over hashed, normalised TF-IDF character n-grams.

Every language has several centroids, from spherical k-means over its training vectors, which are made and clustered in
tasks: the driver gets document frequencies and centroids alone, 48 KB a language, and no language is left out. A text
gets the language of the centroid with the highest cosine; a text further from it than nearly all training texts are
is rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from isovox.llm import _text
from isovox.store import dropped, spare, written

DIMS = 4096
#: Training texts per language, distinct ones drawn by a hash of id and text: the bound of the sample.
SAMPLE = 800
#: Languages up to which their counts go to every task; more meet their rows in a join.
TOLD = 100_000
CENTROIDS = 3
#: Texts whose vectors a task holds at once.
ROWS = 2048
#: Share of training texts that lie beyond the rejecting distance.
BEYOND = 0.001


def vectors(column: pa.Array, dims: int = DIMS) -> np.ndarray:
    """Damped counts (1 + ln n) of hashed byte bigrams and trigrams over letters, one row per text.

    A-Z count as a-z; digits, signs and white space all count as one blank.
    """
    data, offs = _text.views(column)
    data = _text.LOWER[data]
    data = np.where((data >= 128) | ((data >= 97) & (data <= 122)), data, np.uint8(32)).astype(np.uint32)
    out = np.zeros((len(column), dims), np.float32)
    if len(data) < 3:
        return out
    two = data[:-1] * 257 + data[1:]
    three = two[:-1] * 257 + data[2:]
    ids2 = ((two * np.uint32(2654435769)) >> np.uint32(16)).astype(np.int64) % dims
    ids3 = ((three * np.uint32(2246822519)) >> np.uint32(16)).astype(np.int64) % dims
    ids2[two == 32 * 258] = -1  # blanks alone say nothing
    ids3[three == (32 * 257 + 32) * 257 + 32] = -1
    for d in range(len(column)):
        a, b = int(offs[d]), int(offs[d + 1])
        if b - a >= 2:
            n = np.bincount(ids2[a : b - 1] + 1, minlength=dims + 1)[1:]
            if b - a >= 3:
                n = n + np.bincount(ids3[a : b - 2] + 1, minlength=dims + 1)[1:]
            hit = n > 0
            out[d, hit] = 1 + np.log(n[hit])
    return out


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the number of its language, the cosine to its centroid, whether it is rejected."""
        near = unit(vectors(column) * self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        cosine = np.clip(near[np.arange(len(best)), best], 0, 1).astype(np.float64)
        return self.owner[best], cosine, cosine < self.least[best]


def centroids_of(own: np.ndarray, k: int = CENTROIDS, rounds: int = 12) -> np.ndarray:
    """Up to ``k`` centroids of unit vectors: farthest-first seeds, then spherical k-means."""
    seeds = [unit(own.mean(axis=0, keepdims=True))[0]]
    while len(seeds) < min(k, len(own)):
        seeds.append(own[(own @ np.array(seeds).T).max(axis=1).argmin()])
    c = np.array(seeds)
    for _ in range(rounds):
        at = (own @ c.T).argmax(axis=1)
        c = unit(np.array([own[at == j].sum(axis=0) if (at == j).any() else c[j] for j in range(len(c))]))
    return c


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as numbers and values of what isn't zero: a row's size is bounded, whatever its text's is."""
    for part in _text.chunks(batches, limit=1 << 20, rows=ROWS):
        x = vectors(part.column("text"))
        at = [np.flatnonzero(row).astype(np.uint16) for row in x]
        ids, values = (pa.array([v.tobytes() for v in c], pa.binary()) for c in (at, [row[i] for row, i in zip(x, at, strict=True)]))
        yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("draw"), ids, values], ["lang", "draw", "ids", "values"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(DIMS, np.int64)
    for batch in batches:
        df += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), np.uint16), minlength=DIMS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(df)], ["dim", "n"])


def _learned(idf: np.ndarray, most: int, beyond: float):
    """The centroids of one language, each with its rejecting cosine."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("draw").slice(0, most).combine_chunks()
        own = np.zeros((table.num_rows, DIMS), np.float32)
        for row, i, v in zip(own, table.column("ids").to_pylist(), table.column("values").to_pylist(), strict=True):
            row[np.frombuffer(i, np.uint16)] = np.frombuffer(v, np.float32)
        own = unit(own * idf)
        c = centroids_of(own)
        least = float(np.quantile((own @ c.T).max(axis=1), beyond))
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(c), pa.string()), "centroid": pa.array([x.astype(np.float32).tobytes() for x in c], pa.binary()), "least": pa.array([least] * len(c), pa.float64())})

    return run


def train(labelled: DataFrame, sample: int = SAMPLE, beyond: float = BEYOND) -> Model | None:
    """A model from (doc_id, text, lang) rows: about ``sample`` distinct non-empty texts of each language, of all languages.

    The draw is by a hash of id and text, whatever the order of rows; repeated rows count once. Null languages, null
    and empty texts are left out; of a longest text the whole is read. Without any row there is no model.
    """
    usable = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64(F.lit("language"), "doc_id", "text").alias("draw"))
    share = written(usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count(F.lit(1))).alias("share")), "languages")
    drawn = usable.join(F.broadcast(share) if share.count() <= TOLD else share, "lang").where(F.pmod(F.col("draw"), F.lit(1 << 40)) <= F.col("share") * (1 << 40))
    got = written(drawn.select("lang", "draw", "text").mapInArrow(_sparse, "lang string, draw bigint, ids binary, values binary").dropDuplicates(["lang", "draw"]), "vectors")
    df = np.zeros(DIMS)
    for r in got.mapInArrow(_frequencies, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        df[r["dim"]] = r["n"]
    idf = (np.log((1 + got.count()) / (1 + df)) + 0.1).astype(np.float32)
    rows = got.groupBy("lang").applyInArrow(_learned(idf, 2 * sample, beyond), "lang string, centroid binary, least double").toArrow()
    for table in (share, got):
        dropped(table)
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("lang", "ascending"), ("centroid", "ascending")])
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    number = {lang: i for i, lang in enumerate(languages)}
    centroids = np.frombuffer(b"".join(rows.column("centroid").to_pylist()), np.float32).reshape(-1, DIMS)
    return Model(languages, idf, centroids, np.array([number[n] for n in names]), rows.column("least").to_numpy())


def identified(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without its text, and last the nearest language, the cosine and whether the distance rejects it.

    These are ``lang_pred``, ``score`` and ``rejected``, each with as many underscores before it as keep it apart from
    the columns of ``docs`` in any case of letters; all of those stay. A null text or one without a letter is ``und``
    with score 0, and rejected; so is every text without a model. Ties go to the first language. Whole texts are read,
    however long; repeated rows get equal results; an empty table gives none.
    """
    rest = docs.drop(text)
    keep, added = rest.columns, [spare(rest, c) for c in ("lang_pred", "score", "rejected")]
    schema = StructType([*rest.schema.fields, *(StructField(n, t) for n, t in zip(added, (StringType(), DoubleType(), BooleanType()), strict=True))])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.chunks(batches, text, 1 << 20, ROWS):
            column = part.column(text)
            letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if model is None:
                owner, cosine, out, names = np.zeros(len(column), int), np.zeros(len(column)), np.ones(len(column), bool), ["und"]
            else:
                (owner, cosine, out), names = model.score(column), model.languages
            found = pa.array(np.where(letters, np.array(names, object)[owner], "und"), pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), found, pa.array(np.where(letters, cosine, 0.0)), pa.array(out | ~letters)], [*keep, *added])

    return docs.mapInArrow(label, schema)


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; of a null id, of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def fold_of(doc_id: int, of: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % of


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(fold(F.col("doc_id"), 5) != 0))
    return identified(docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
