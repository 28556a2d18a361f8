"""``spark.read.format("dicom")``: the decoder as a Python data source, with mode and pixels as options."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from isovox.sources.dicom import SLICE_COLUMNS, SLICE_SCHEMA, ParseError, parse, slice_of


#: Bytes of files that one partition reads.
PART = 64 << 20


class _Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        root = Path(self.options["path"])
        found = sorted(p for p in root.rglob("*") if p.is_file()) if root.is_dir() else [root]
        parts, size = [[]], 0
        for i, p in enumerate(found):
            n = p.stat().st_size
            if parts[-1] and size + n > PART:
                parts.append([])
                size = 0
            parts[-1].append((i, str(p)))
            size += n
        return [_Files(x) for x in parts]

    def read(self, partition):
        """Arrow batches, a file each; pixels stay arrays."""
        pixels, fast = self.options.get("pixels", "true").lower() == "true", self.options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        for ordinal, path in partition.files:
            row = dict.fromkeys(SLICE_SCHEMA.names) | {"path": path, "ordinal": ordinal, "series_id": Path(path).parent.name}
            try:
                row |= slice_of(parse(Path(path).read_bytes(), path), path, pixels)
            except ParseError as e:
                if fast:
                    raise
                row["error"] = str(e)
            yield pa.RecordBatch.from_pylist([row], schema=SLICE_SCHEMA)


class DicomSource(DataSource):
    """Files below a folder that every executor sees under one path; other stores go through ``read_slices``."""

    @classmethod
    def name(cls):
        return "dicom"

    def schema(self):
        return SLICE_COLUMNS

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DicomSource)
