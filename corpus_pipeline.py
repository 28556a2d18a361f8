"""From a table of documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns
of ``documents``; further columns, whatever their names and types, stay too. Every stage makes of an empty table an empty
one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isovox.llm.mixing import mixed_documents
from isovox.llm.near_dedup import deduplicated
from isovox.llm.packing import packed_documents
from isovox.llm.quality_rules import quality_filter
from isovox.llm.surrogates import checked, key_of
from isovox.store import columns, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null, empty and short texts go; repeated rows are judged each alone; whole texts are read, however long.
    """
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words to a shingle, a similarity of 0.8 or more.

    Of a group the least id stays; rows without an id are told apart by their texts; of repeated rows one stays. Null and
    empty texts are no copies and stay.
    """
    return deduplicated(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates that collide in no text, by the session's key; ``n_chars`` follows the new text.

    Null and empty texts stay; repeated rows stay equal; whole texts are searched, in any script.
    """
    made = checked(docs, key_of(spark)).select(*columns(docs))
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their targets: documents go, stay or stand twice.

    A null source is one source, the last; a text without words counts as nothing and goes.
    """
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place; a null or empty text is one token."""
    return packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL has no MinHash, keyed permutation or tokenizer: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
