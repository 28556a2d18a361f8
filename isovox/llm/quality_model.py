"""A quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

The n-grams are single words, pairs of words and runs of up to three word forms. A form says which kinds of
characters a word has and whether it repeats what came before in the same text. A text's value for an n-gram is
its share of the text's n-grams, so a score is one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from isovox.llm import _text
from isovox.llm.language_id import fold
from isovox.store import spare

BITS = 18
#: Labelled texts that the model is fitted on, drawn by a hash of their ids.
SAMPLE = 5000
EPOCHS = 4

_KIND = np.zeros(256, np.uint8)
_KIND[48:58] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[128:] = 3
_KIND[list(b"#*$%&|<>")] = 4
_KIND[list(b"!?")] = 5


def forms(w: _text.Words, h: np.ndarray) -> np.ndarray:
    """A small number for each word: its kinds of characters, two or more capitals, and what it repeats."""
    kind = _KIND[w.data]
    out = np.zeros(len(h), np.int64)
    for k in range(6):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        n = sums[w.end] - sums[w.start]
        out = out * 3 + np.minimum(n, 2)
    doc = w.doc()
    for back in (1, 2):
        same = np.zeros(len(h), bool)
        same[back:] = (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
        out = out * 2 + same
    # Whether this word and the two before it have stood together before in the text.
    seen = np.zeros(len(h), bool)
    at = _text.inside_doc(w.first, 3)
    if len(at):
        key = _text.runs(h, 3)[at] ^ _text.mixed(doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(at), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        seen[at + 2] = again
    return out * 2 + seen


def ngrams(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the text of each n-gram and its hashed number; and each text's number of n-grams."""
    w = _text.words(column)
    low = _text.Words(_text.LOWER[w.data], w.start, w.end, w.first)
    h = low.hashes()
    form = _text.mixed(forms(w, h).astype(np.uint64) + np.uint64(77))
    doc = w.doc()
    ids, docs = [h, form], [doc, doc]
    for base, k in ((h, 2), (form, 2), (form, 3)):
        at = _text.inside_doc(w.first, k)
        ids.append(_text.runs(base, k)[at] + np.uint64(k))
        docs.append(doc[at])
    flat = (_text.mixed(np.concatenate(ids)) >> np.uint64(64 - bits)).astype(np.int64)
    docs = np.concatenate(docs)
    return docs, flat, np.bincount(docs, minlength=len(column))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        doc, ids, n = ngrams(column)
        dot = np.bincount(doc, self.weights[ids], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(dot / np.maximum(n, 1) * SCALE + self.bias, -35, 35)))


#: What shares are multiplied by, so that weights stay near 1.
SCALE = 20.0


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0, epochs: int = EPOCHS) -> Model:
    """Follow-the-regularised-leader (proximal, one rate per coordinate) over (ids, values) rows in turn."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def leader(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) > l1, w, 0.0)

    for _ in range(epochs):
        for (ids, values), y in zip(rows, labels, strict=True):
            i, x = np.append(ids, bias), np.append(values, 1.0)
            w = leader(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = leader(np.arange(bias + 1))
    return Model(w[:bias].astype(np.float32), float(w[bias]))


def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _text.chunks(batches):
        doc, ids, n = ngrams(part.column("text"))
        key, times = np.unique((doc << BITS) | ids, return_counts=True)
        ends = np.searchsorted(key >> BITS, np.arange(part.num_rows + 1)).astype(np.int32)
        share = (times / np.maximum(n, 1)[key >> BITS] * SCALE).astype(np.float32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((key & ((1 << BITS) - 1)).astype(np.int32), share)]
        yield pa.RecordBatch.from_arrays([part.column("quality"), part.column("draw"), *lists], ["quality", "draw", "ids", "shares"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from texts (doc_id, text) and labels (doc_id, quality), on about ``sample`` rows drawn by hash.

    Rows without a label, with a null id or a null label are left out; of labels that disagree on an id the
    highest holds; a null text is empty. Rows that repeat an id all count, in order of draw and n-grams up to
    2 * ``sample``, which bounds what the driver gets: a row has 2**18 n-grams at most, however long its text. Without
    labelled rows there is no model.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.withColumn("draw", F.xxhash64(F.lit("quality"), "doc_id"))
    share = sample / max(1, known.count())
    drawn = known.where(F.pmod("draw", F.lit(1 << 40)) <= min(1.0, share) * (1 << 40)).limit(2 * sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", F.col("quality").cast("int").alias("quality"), "draw")
    made = rows.mapInArrow(sparse, "quality int, draw bigint, ids array<int>, shares array<float>")
    # Rows of equal draw go by what they hold, so that a fit is the same again.
    got = made.orderBy("draw", F.xxhash64("ids", "shares")).limit(2 * sample).toArrow().combine_chunks()
    if not got.num_rows:
        return None
    vectors = list(zip(*([x.values.to_numpy()[a:b] for a, b in zip(x.offsets.to_numpy()[:-1], x.offsets.to_numpy()[1:])] for x in (got.column(c).combine_chunks() for c in ("ids", "shares"))), strict=True))
    return ftrl(vectors, got.column("quality").to_numpy())


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without its text, and last the probability of label 1 (0.5 for all without a model).

    That is ``score``, with as many underscores before it as keep it apart from the columns of ``docs`` in any case of
    letters; all of those stay. Null and empty texts have no n-gram and get the model's bias. Equal texts get equal
    scores; texts of any length are read whole; an empty table gives none.
    """
    rest = docs.drop("text")
    keep, score = rest.columns, spare(rest, "score")
    schema = StructType([*rest.schema.fields, StructField(score, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.chunks(batches):
            p = model.score(part.column("text")) if model else np.full(part.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(p.astype(np.float64))], [*keep, score])

    return docs.mapInArrow(run, schema)


def op3_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = fold(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held))
    return scored(docs.select("doc_id", held.alias("held_out"), "text"), model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
