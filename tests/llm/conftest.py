from __future__ import annotations

import re

import pytest

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    found = WORD.findall(text or "")
    return [w.translate(LOWER) for w in found] if lower else found


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="session")
def plain(docs):
    return docs.orderBy("doc_id").toPandas()


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, ties, and columns whose names clash."""
    long = " ".join(f"word{i % 7001} and{i % 13}" for i in range(40_000))
    line = "The quick brown fox, with a lazy dog in the long grass of the wide field by the river and the old mill."
    rows = [
        (None, "a text without an id", "en", "a", 20), (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \t\n\x0b ", "en", "b", 5), (4, long, "en", "a", len(long)), (5, long, "en", "b", len(long)),
        (6, line * 3, "en", None, 0), (6, line * 3, "en", None, 0), (7, "Üöß ñ 日本語 \U0001f600 été", None, "b", 3), (8, "12345 !!! ###", "en", "", 0), (9, "x", "de", "c", 1), (10, "one two", "en", "c", 7), (2**62, line, "en", "a", 1), (-5, line, "fr", "a", 1),
    ]
    names = ["score", "size", "rank", "target", "shards", "kept", "node", "label", "part", "guest", "_block", "quota", "tokens", "entity_kinds", "draw", "_copy_", "_quality_kept", "n_words", "lang_pred", "hash"]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)]).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0).cache()
