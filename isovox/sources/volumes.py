"""Volumes from tables and from rules. Two layouts:

* voxels: (volume_id, z, y, x, v), one row a voxel, for masks, statistics and labels;
* blocks: (volume_id, z, width, height, data), one row an axial slice, for what stays within a slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOXELS = "volume_id string, z int, y int, x int, v float"
BLOCKS = "volume_id string, z int, width int, height int, data array<float>"


def embedding_pixels(spark: SparkSession, sf_dir: str, height: int = 50) -> DataFrame:
    """(z, y, x, pixel) of the grid that the embeddings are: x along the vector, y and z along the ids."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return rows.select(F.floor(F.col("vec_id") / height).cast("int").alias("z"), (F.col("vec_id") % height).cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.floor(F.col("e").cast("double") * 2048).cast("int").alias("pixel"))


def embedding_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pixels(spark, sf_dir).select(F.lit("embeddings").alias("volume_id"), "z", "y", "x", F.col("pixel").cast("float").alias("v"))


def to_blocks(voxels: DataFrame) -> DataFrame:
    """One row a slice; a slice must be a full grid, which is checked."""
    rows = voxels.groupBy("volume_id", "z").agg(F.max("x").alias("mx"), F.max("y").alias("my"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("all"))
    width, height = F.col("mx") + 1, F.col("my") + 1
    whole = F.when(F.col("n") == width * height, F.transform("all", lambda s: s["v"])).otherwise(F.raise_error(F.lit("a slice of the volume isn't a full grid")).cast("array<float>"))
    return rows.select("volume_id", "z", width.alias("width"), height.alias("height"), whole.alias("data"))


def framed(blocks: DataFrame, width: int, height: int, fill: Column | float | None = None) -> DataFrame:
    """Blocks on one grid: the places that a smaller slice lacks at the ends of its axes are ``fill`` (null: unknown)."""
    w, h = F.col("width"), F.col("height")
    missing = lambda n: F.array_repeat((fill if isinstance(fill, Column) else F.lit(fill)).cast("float"), n)
    lines = F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.concat(F.slice("data", y * w + 1, w), missing(width - w))))
    data = F.concat(F.when(w == width, F.col("data")).otherwise(lines), missing((height - h) * width))
    checked = F.when((w > width) | (h > height), F.raise_error(F.lit(f"a slice is larger than {width}x{height}")).cast("array<float>")).otherwise(data)
    return blocks.withColumn("data", checked).withColumns({"width": F.lit(width), "height": F.lit(height)})


def to_voxels(blocks: DataFrame) -> DataFrame:
    flat = blocks.select("volume_id", "z", "width", F.posexplode("data").alias("i", "v"))
    return flat.select("volume_id", "z", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), "v")


def grid(spark: SparkSession, volume_id: str, width: int, height: int, depth: int, value) -> DataFrame:
    """A volume from a rule: ``value(z, y, x)`` is a column."""
    cells = spark.range(width * height * depth)
    z, y, x = (F.floor(F.col("id") / (width * height)).cast("int"), (F.floor(F.col("id") / width) % height).cast("int"), (F.col("id") % width).cast("int"))
    cells = cells.select(z.alias("z"), y.alias("y"), x.alias("x"))
    return cells.select(F.lit(volume_id).alias("volume_id"), "z", "y", "x", value(F.col("z"), F.col("y"), F.col("x")).cast("float").alias("v"))


def spheres(spark: SparkSession, size: int, planted: list[tuple[int, int, int, float]], inside: float = 300.0, outside: float = -1000.0, volume_id: str = "spheres") -> DataFrame:
    """A cube of ``size`` with balls (x, y, z, radius) of one value in another."""

    def value(z, y, x):
        ball = F.lit(False)
        for cx, cy, cz, r in planted:
            ball = ball | ((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) <= r * r)
        return F.when(ball, inside).otherwise(outside)

    return grid(spark, volume_id, size, size, size, value)


def nodules(spark: SparkSession, size: int = 128, step: int = 32, radius: int = 5, volume_id: str = "nodules") -> DataFrame:
    """Balls at all multiples of ``step`` inside the cube."""
    at = [i for i in range(step, size, step)]
    return spheres(spark, size, [(x, y, z, radius) for z in at for y in at for x in at], 300.0, -800.0, volume_id)


def noise(*parts, amplitude: float = 50.0, seed: int = 42):
    """Uniform noise that depends on its arguments alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1_000_001)) / 1_000_000.0 * 2 - 1) * amplitude


def gradient(spark: SparkSession, width: int = 256, height: int = 256, depth: int = 32, volume_id: str = "gradient") -> DataFrame:
    return grid(spark, volume_id, width, height, depth, lambda z, y, x: F.lit(-1000.0) + F.lit(2000.0) * x / width + noise(z, y, x))


def series(spark: SparkSession, n: int = 60, rows: int = 256, columns: int = 256, row_mm: float = 0.75, col_mm: float = 0.75, step_mm: float = 1.0, series_id: str = "series") -> DataFrame:
    """Slices of a noisy slope, one row each, in the schema of decoded files."""

    def make(batches):
        for batch in batches:
            for z in batch.column("id").to_pylist():
                y, x = np.mgrid[:rows, :columns]
                rng = np.random.default_rng(z + 7)
                pixels = (x + y + z + rng.uniform(-100, 100, x.shape)).astype(np.int32).ravel()
                yield pa.RecordBatch.from_pydict({"series_id": [series_id], "ordinal": pa.array([z], pa.int32()), "modality": ["CT"], "rows": pa.array([rows], pa.int32()), "columns": pa.array([columns], pa.int32()), "rescale_slope": [1.0], "rescale_intercept": [-1024.0], "image_position_z": [z * step_mm], "pixel_spacing_row_mm": [row_mm], "pixel_spacing_col_mm": [col_mm], "slice_thickness_mm": [step_mm], "pixels": pa.array([pixels], pa.list_(pa.int32()))})

    schema = "series_id string, ordinal int, modality string, rows int, columns int, rescale_slope double, rescale_intercept double, image_position_z double, pixel_spacing_row_mm double, pixel_spacing_col_mm double, slice_thickness_mm double, pixels array<int>"
    return spark.range(n).mapInArrow(make, schema)
