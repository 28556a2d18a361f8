"""Filters of axial slices, with edges repeated. On blocks they need no shuffle; on voxels they are windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isovox.sources.volumes import BLOCKS


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights of a Gaussian to three sigmas, with a sum of one."""
    if not sigma > 0:
        raise ValueError("sigma must be over 0")
    radius = max(1, math.ceil(3 * sigma))
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def _each(blocks: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                w, h = part.column("width")[0].as_py(), part.column("height")[0].as_py()
                plane = part.column("data")[0].values.to_numpy().reshape(h, w)
                data = f(plane).astype(np.float32).ravel()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("volume_id", "z", "width", "height")), pa.array([data], pa.list_(pa.float32()))], ["volume_id", "z", "width", "height", "data"])

    return blocks.select("volume_id", "z", "width", "height", "data").mapInArrow(run, BLOCKS)


def blur_plane(plane: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Along x, then along y, in 32-bit floats, weights in rising order."""
    radius = len(kernel) // 2
    for axis in (1, 0):
        wide = np.pad(plane, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = plane.shape[axis]
        out = np.zeros_like(plane, dtype=np.float32)
        for k, weight in enumerate(kernel):
            out += weight * (wide[:, k : k + n] if axis else wide[k : k + n])
        plane = out
    return plane


def gaussian_blur(blocks: DataFrame, sigma: float) -> DataFrame:
    kernel = np.array(gaussian_kernel(sigma), np.float32)
    return _each(blocks, lambda plane: blur_plane(plane, kernel))


def sobel_plane(plane: np.ndarray) -> np.ndarray:
    p = np.pad(plane, 1, mode="edge")
    gx = (p[:-2, 2:] - p[:-2, :-2]) + 2 * (p[1:-1, 2:] - p[1:-1, :-2]) + (p[2:, 2:] - p[2:, :-2])
    gy = (p[2:, :-2] - p[:-2, :-2]) + 2 * (p[2:, 1:-1] - p[:-2, 1:-1]) + (p[2:, 2:] - p[:-2, 2:])
    return np.sqrt(gx * gx + gy * gy)


def sobel_edge(blocks: DataFrame) -> DataFrame:
    return _each(blocks, sobel_plane)


def equalize_plane(plane: np.ndarray, bins: int) -> np.ndarray:
    low, high = plane.min(), plane.max()
    span = high - low if high > low else np.float32(1)
    at = np.clip(((plane - low) * (np.float32(1) / span) * np.float32(bins - 1)).astype(np.int64), 0, bins - 1)
    share = (np.cumsum(np.bincount(at.ravel(), minlength=bins)) / np.float32(plane.size)).astype(np.float32)
    return low + share[at] * span


def histogram_equalize(blocks: DataFrame, bins: int = 256) -> DataFrame:
    """Each slice by its own histogram; a slice of one value has span 1, so it goes up by 1."""
    if bins < 1:
        raise ValueError("there must be a bin")
    return _each(blocks, lambda plane: equalize_plane(plane, bins))


def max_abs_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """The largest difference of two volumes' voxels, by volume."""
    other = b.select("volume_id", "z", "y", "x", F.col("v").alias("w")).hint("merge")
    return a.join(other, ["volume_id", "z", "y", "x"]).groupBy("volume_id").agg(F.max(F.abs(F.col("v") - F.col("w"))).alias("max_abs_diff"))


# The same on voxels, in doubles: windows over full rows and columns of a dense grid.


def _shifted(v: Column, k: int, line: W) -> Column:
    """The value ``k`` places on along a line, the line's end beyond it."""
    every = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    if k == 0:
        return v
    return F.coalesce(F.lead(v, k).over(line), F.last(v).over(every)) if k > 0 else F.coalesce(F.lag(v, -k).over(line), F.first(v).over(every))


def row() -> W:
    return W.partitionBy("volume_id", "z", "y").orderBy("x")


def column() -> W:
    return W.partitionBy("volume_id", "z", "x").orderBy("y")


def _weighted(v: Column, kernel: list[float], line: W) -> Column:
    radius = len(kernel) // 2
    total = F.lit(0.0)
    for k, weight in enumerate(kernel):
        total = total + F.lit(weight) * _shifted(v, k - radius, line)
    return total


def gaussian_x_voxels(voxels: DataFrame, sigma: float) -> DataFrame:
    return voxels.withColumn("v", _weighted(F.col("v").cast("double"), gaussian_kernel(sigma), row()))


def gaussian_blur_voxels(voxels: DataFrame, sigma: float) -> DataFrame:
    return gaussian_x_voxels(voxels, sigma).withColumn("v", _weighted(F.col("v"), gaussian_kernel(sigma), column()))


def sobel_edge_voxels(voxels: DataFrame) -> DataFrame:
    v = F.col("v").cast("double")
    rows = voxels.select("volume_id", "z", "y", "x", v.alias("c"), _shifted(v, -1, row()).alias("l"), _shifted(v, 1, row()).alias("r"))
    up = {c: _shifted(F.col(c), -1, column()) for c in "lcr"}
    down = {c: _shifted(F.col(c), 1, column()) for c in "lcr"}
    gx = (up["r"] - up["l"]) + 2 * (F.col("r") - F.col("l")) + (down["r"] - down["l"])
    gy = (down["l"] - up["l"]) + 2 * (down["c"] - up["c"]) + (down["r"] - up["r"])
    return rows.select("volume_id", "z", "y", "x", gx.alias("gx"), gy.alias("gy")).select("volume_id", "z", "y", "x", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("v"))


def histogram_bins(voxels: DataFrame, bins: int = 256) -> DataFrame:
    """Voxels with their slice's low, span and count, and their bin."""
    # Windows, not joins: Spark takes written voxels for a few bytes and would broadcast all of them.
    whole = W.partitionBy("volume_id", "z")
    low, high = F.min("v").over(whole).cast("double"), F.max("v").over(whole).cast("double")
    rows = voxels.select("*", low.alias("low"), F.when(high > low, high - low).otherwise(1.0).alias("span"), F.count(F.lit(1)).over(whole).alias("n"))
    at = F.least(F.greatest(F.floor((F.col("v").cast("double") - F.col("low")) / F.col("span") * (bins - 1)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.withColumn("bin", at)


def histogram_cdf(voxels: DataFrame, bins: int = 256) -> DataFrame:
    counts = histogram_bins(voxels, bins).groupBy("volume_id", "z", "low", "span", "n", "bin").count()
    below = W.partitionBy("volume_id", "z").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.withColumn("cdf", F.sum("count").over(below) / F.col("n"))


def histogram_equalize_voxels(voxels: DataFrame, bins: int = 256) -> DataFrame:
    below = W.partitionBy("volume_id", "z").orderBy("bin").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = histogram_bins(voxels, bins).withColumn("cdf", F.count(F.lit(1)).over(below) / F.col("n"))
    return rows.select("volume_id", "z", "y", "x", (F.col("low") + F.col("cdf") * F.col("span")).alias("v"))
