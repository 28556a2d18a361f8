"""Tables written to the folder all executors share, to cut lineage and to read a result twice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in a local session that names none."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="isovox-")
    context.setCheckpointDir(own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: lost executors don't lose it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_path = path
    return made


def saved(df: DataFrame, name: str) -> str:
    """A folder of its own in the shared one, with the files (name, content) of ``df``, written by the tasks that have them."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    folder = fs.makeQualified(path).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = folder if "://" in folder else folder.replace("file:", "file://", 1)
        target, base = pa.fs.FileSystem.from_uri(quote(uri, safe=":/"))
        for batch in batches:
            for file, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with target.open_output_stream(f"{base}/{file}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])

    df.select("name", "content").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def dropped(df: DataFrame) -> None:
    """Deletes a table that ``written`` made and nothing reads any more."""
    _delete(df.sparkSession, df.written_path)


def release(spark: SparkSession) -> None:
    """Deletes all tables this application wrote; results that still read them must have been saved."""
    _delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def fresh(df: DataFrame, stem: str) -> str:
    """A column prefix that no column of ``df`` begins with."""
    names = [c.lower() for c in df.columns]
    prefix, n = f"_{stem}_", 0
    while any(c.startswith(prefix) for c in names):
        n += 1
        prefix = f"_{stem}{n}_"
    return prefix


def spare(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns of ``df`` in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def columns(df: DataFrame, *but: str) -> list[Column]:
    """The columns of ``df`` other than those named, whatever signs their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in but]


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which is set with the data's size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
