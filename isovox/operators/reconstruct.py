"""Stacking a series of slices into an isotropic volume.

Geometry is one aggregate row a series. Slices are ordered by height, resampled along x and y, and blended with the one
before along z. The three passes do what sampling at eight corners does, in the same order, in doubles, with one cast to
float at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isovox.functions.values import modality
from isovox.sources.volumes import BLOCKS


NO_SLICES = "Cannot reconstruct a volume from zero slices"


class ReconstructionError(ValueError):
    """The slices don't make a volume."""


def input_order(slices: DataFrame) -> Column:
    """What slices are ordered by as they were given: their place, then their path if they have one."""
    return F.struct("ordinal", "path") if "path" in slices.columns else F.struct("ordinal")


def positive(c: Column) -> Column:
    return F.when(c > 0, c).otherwise(F.lit(1.0))


def geometry(slices: DataFrame, target_mm: float = -1.0) -> DataFrame:
    """One row a series: native grid and spacing, output spacing and size, the modality of the lowest slice."""
    order = input_order(slices)
    low = lambda c: F.min_by(c, F.struct("image_position_z", order))
    rows = slices.groupBy("series_id").agg(
        F.count(F.lit(1)).cast("int").alias("depth"),
        F.min_by("rows", order).alias("height"),
        F.min_by("columns", order).alias("width"),
        F.min(F.struct("rows", "columns")).alias("least"),
        F.max(F.struct("rows", "columns")).alias("most"),
        low("pixel_spacing_col_mm").alias("col_mm"),
        low("pixel_spacing_row_mm").alias("row_mm"),
        low("slice_thickness_mm").alias("thickness"),
        low("modality").alias("modality"),
        (F.max("image_position_z") - F.min("image_position_z")).alias("span"),
    )
    odd = F.when(F.col("least") != F.struct(F.col("height").alias("rows"), F.col("width").alias("columns")), F.col("least")).otherwise(F.col("most"))
    size = lambda r, c: F.concat(r.cast("string"), F.lit("x"), c.cast("string"))
    message = F.concat(F.lit("Inconsistent slice dimensions: expected "), size(F.col("height"), F.col("width")), F.lit(" but found "), size(odd["rows"], odd["columns"]), F.lit(" -- all slices in a series must share the same in-plane grid"))
    checked = F.when(F.col("least") != F.col("most"), F.raise_error(message).cast("int")).when((F.col("width") <= 0) | (F.col("height") <= 0), F.raise_error(F.lit("A slice without rows or columns cannot be stacked")).cast("int")).otherwise(F.col("depth"))
    rows = rows.select("series_id", "width", "height", checked.alias("depth"), modality(F.col("modality")).alias("modality"), positive(F.col("col_mm")).alias("dx"), positive(F.col("row_mm")).alias("dy"), "thickness", "span")
    rows = rows.withColumn("dz", F.when((F.col("depth") > 1) & (F.col("span") > 1e-6), F.col("span") / (F.col("depth") - 1)).otherwise(positive(F.col("thickness")))).drop("thickness", "span")
    rows = rows.withColumn("voxel_spacing_mm", F.lit(float(target_mm)) if target_mm > 0 else F.least("dx", "dy", "dz"))
    out = lambda n, d: F.greatest(F.lit(1), F.round((F.col(n) - 1) * F.col(d) / F.col("voxel_spacing_mm")).cast("int") + 1)
    return rows.select("*", out("width", "dx").alias("out_width"), out("height", "dy").alias("out_height"), out("depth", "dz").alias("out_depth"))


def stacked(slices: DataFrame) -> DataFrame:
    """``slices`` with z_index, their place from the lowest; of equal heights the earlier in the input is first."""
    return slices.withColumn("z_index", F.row_number().over(W.partitionBy("series_id").orderBy("image_position_z", input_order(slices))) - 1)


def corners(n_out: int, spacing: float, native: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of an output axis: the two native places it lies between, and how far along."""
    f = (np.arange(n_out) * spacing) / native
    a = np.clip(np.floor(f).astype(np.int64), 0, n - 1)
    b = np.clip(a + 1, 0, n - 1)
    return a, b, np.where(a == b, 0.0, f - a)


def _resampled(r: dict, pixels: np.ndarray) -> np.ndarray:
    """A slice in Hounsfield units (32-bit floats), resampled along x, then y, in doubles."""
    w, h = r["width"], r["height"]
    if len(pixels) != w * h:
        raise ReconstructionError(f"a slice of {h}x{w} has {len(pixels)} pixels")
    grid = (pixels.astype(np.float64) * r["rescale_slope"] + r["rescale_intercept"]).astype(np.float32).reshape(h, w).astype(np.float64)
    # Rows and columns that are where they were stay as they are: a share of 0 of what follows adds nothing.
    a, b, t = corners(r["out_width"], r["voxel_spacing_mm"], r["dx"], w)
    if t.any() or not np.array_equal(a, np.arange(w)):
        grid = grid[:, a] * (1 - t) + grid[:, b] * t
    a, b, t = corners(r["out_height"], r["voxel_spacing_mm"], r["dy"], h)
    if t.any() or not np.array_equal(a, np.arange(h)):
        grid = grid[a] * (1 - t)[:, None] + grid[b] * t[:, None]
    return grid


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    for batch in batches:
        small = batch.drop_columns(["pixels"]).to_pylist()
        # A null is unknown: not a number, as is all that is blended of it.
        flat, offs = batch.column("pixels").values.to_numpy(zero_copy_only=False), batch.column("pixels").offsets.to_numpy()
        for i, r in enumerate(small):
            yield r, flat[offs[i] : offs[i + 1]]


def _planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r, pixels in _slices(batches):
        yield pa.RecordBatch.from_pydict({"series_id": [r["series_id"]], "z_index": pa.array([r["z_index"]], pa.int32()), "plane": pa.array([_resampled(r, pixels).ravel()], pa.list_(pa.float64()))})


def _stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each series from its slices, which come in order of height: two planes are held at a time."""
    series, z, plane, low = None, 0, None, None
    for r, pixels in _slices(batches):
        if r["z_index"] == 0:
            series, z, plane = r["series_id"], 0, None
            at, above, t = corners(r["out_depth"], r["voxel_spacing_mm"], r["dz"], r["depth"])
        elif r["series_id"] != series or r["z_index"] != k + 1:
            raise ReconstructionError(f"slices of {r['series_id']} out of order")
        k, low, plane = r["z_index"], plane, _resampled(r, pixels)
        # All output slices whose upper plane is this one.
        out = []
        while z < len(at) and above[z] <= k:
            out.append((plane if at[z] == k else low * (1 - t[z]) + plane * t[z]).astype(np.float32).ravel())
            z += 1
        if out:
            n, size = len(out), r["out_width"] * r["out_height"]
            data = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(np.concatenate(out)))
            same = lambda x: pa.array(np.full(n, x, np.int32))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array([series] * n, pa.string()), pa.array(np.arange(z - n, z, dtype=np.int32)), same(r["out_width"]), same(r["out_height"]), data], ["volume_id", "z", "width", "height", "data"])


def _blend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            low, high = (batch.column(c)[i].values.to_numpy() for c in ("low", "high"))
            t = batch.column("t")[i].as_py()
            data = (low * (1 - t) + high * t).astype(np.float32)
            part = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("volume_id", "z", "width", "height")), pa.array([data], pa.list_(pa.float32()))], ["volume_id", "z", "width", "height", "data"])


def _in_order(slices: DataFrame, geo: DataFrame) -> DataFrame:
    """Slices with their series' geometry, those of a series in one task and in order of z_index.

    The window comes last, as it is what sorts them.
    """
    names = [c for c in ("series_id", "ordinal", "path", "image_position_z", "rescale_slope", "rescale_intercept", "pixels") if c in slices.columns]
    rows = stacked(slices.select(*names).join(geo.drop("modality"), "series_id"))
    return rows.select("series_id", "z_index", "rescale_slope", "rescale_intercept", "width", "height", "depth", "dx", "dy", "dz", "voxel_spacing_mm", "out_width", "out_height", "out_depth", "pixels")


def planes(slices: DataFrame, target_mm: float = -1.0) -> DataFrame:
    """(series_id, z_index, plane): native slices on the output's x and y."""
    return _in_order(slices, geometry(slices, target_mm)).mapInArrow(_planes, "series_id string, z_index int, plane array<double>")


def output_slices(geo: DataFrame) -> DataFrame:
    """(volume_id, z, z0, z1, t, width, height) of every output slice."""
    rows = geo.select("*", F.explode(F.sequence(F.lit(0), F.col("out_depth") - 1)).alias("z"))
    rows = rows.withColumn("f", F.col("z") * F.col("voxel_spacing_mm") / F.col("dz"))
    rows = rows.withColumn("z0", F.least(F.greatest(F.floor("f"), F.lit(0)), F.col("depth") - 1).cast("int"))
    rows = rows.withColumn("z1", F.least(F.col("z0") + 1, F.col("depth") - 1).cast("int"))
    return rows.select(F.col("series_id").alias("volume_id"), "z", "z0", "z1", F.when(F.col("z0") == F.col("z1"), 0.0).otherwise(F.col("f") - F.col("z0")).alias("t"), F.col("out_width").alias("width"), F.col("out_height").alias("height"))


def reconstruct(slices: DataFrame, target_mm: float = -1.0, by_slice: bool = False) -> DataFrame:
    """Blocks of the isotropic volume of each series. Without any slice at all the job fails.

    Slices: (series_id, ordinal, modality, rows, columns, rescale_slope, rescale_intercept, image_position_z,
    pixel_spacing_row_mm, pixel_spacing_col_mm, slice_thickness_mm, pixels). Voxels that a null pixel takes part in are
    not a number.

    A series is stacked in one task, as its slices come in order, with one shuffle and two planes in memory.
    ``by_slice`` spreads the output slices of each series instead, which meet their planes in two joins: for a few very
    large series. Both give the same voxels.
    """
    geo = geometry(slices, target_mm)
    if by_slice:
        flat, out = planes(slices, target_mm), output_slices(geo)
        low = flat.select(F.col("series_id").alias("volume_id"), F.col("z_index").alias("z0"), F.col("plane").alias("low"))
        high = flat.select(F.col("series_id").alias("volume_id"), F.col("z_index").alias("z1"), F.col("plane").alias("high"))
        rows = out.join(low, ["volume_id", "z0"]).join(high, ["volume_id", "z1"]).select("volume_id", "z", "width", "height", "t", "low", "high")
        made = rows.mapInArrow(_blend, BLOCKS)
    else:
        made = _in_order(slices, geo).mapInArrow(_stack, BLOCKS)
    # A condition that fails the job where there is no series; it never has a row.
    none = geo.agg(F.count(F.lit(1)).alias("n")).where(F.when(F.col("n") == 0, F.raise_error(F.lit(NO_SLICES)).cast("boolean")).otherwise(False))
    return made.union(none.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in made.schema.fields)))


def require_slices(slices: DataFrame) -> DataFrame:
    """``slices``, or an error at once if there is none."""
    if slices.isEmpty():
        raise ReconstructionError(NO_SLICES)
    return slices


def volume_summary(blocks: DataFrame) -> DataFrame:
    """(volume_id, width, height, depth, voxels, low, high) of each volume."""
    return blocks.groupBy("volume_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.count(F.lit(1)).cast("int").alias("depth"), F.sum(F.size("data")).cast("bigint").alias("voxels"), F.min(F.array_min("data")).alias("low"), F.max(F.array_max("data")).alias("high"))
