"""A session with the settings the library is made for; anything can be set otherwise."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "isovox", **conf: str) -> SparkSession:
    """Adaptive plans, Arrow and UTC; the master, memory and number of partitions are the cluster's to set.

    Batches that go to Python are bounded by bytes, as a row can be a whole slice or a very long text.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.sql.session.timeZone": "UTC",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
