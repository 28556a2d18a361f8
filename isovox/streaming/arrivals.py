"""Files that arrive in a folder, decoded as a stream; a series is worked on in each batch that brings files of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from isovox.sources.dicom import decoded

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_slices(spark: SparkSession, folder: str, pixels: bool = True, per_trigger: int = 1000) -> DataFrame:
    """A stream of decoded files (PERMISSIVE) as they come below ``folder``."""
    found = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return decoded(found.select("path", "content", F.lit(0).alias("given")), "PERMISSIVE", pixels)


def keep_slices(stream: DataFrame, table: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends a stream's slices to Parquet at ``table``, each batch under its number, so that a batch done again replaces itself."""

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{table}/batch={n}")
        if then:
            then(df.sparkSession.read.parquet(f"{table}/batch={n}"), n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
