"""Dense regions of a volume: 26-connected components of the voxels in a range, with statistics of each.

Masked voxels are packed into runs along x; runs in neighbouring rows touch if their ends are at most one apart.
Statistics are additive, so runs carry them. A component's label is its least linear index, which puts findings in
raster order of their first voxels.

Two ways to join runs give the same labels: one task a volume over its runs (the default; a scanner bounds them), or
slabs of slices labelled side by side and joined at their boundaries by a distributed closure, for volumes whose
runs are too many for one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isovox.functions.values import in_range, linear_index
from isovox.operators.components import components
from isovox.store import written


@dataclass(frozen=True)
class Thresholds:
    hu_min: float
    hu_max: float
    min_voxels: int = 10
    max_voxels: int | None = None


#: Forward neighbours (dz, dy) of a row.
FORWARD = ((0, 1), (1, -1), (1, 0), (1, 1))


def masked(voxels: DataFrame, hu_min: float, hu_max: float) -> DataFrame:
    return voxels.where(in_range(F.col("v"), hu_min, hu_max))


def runs(mask: DataFrame, size: DataFrame) -> DataFrame:
    """Maximal runs along x with their sums; ``size`` is (volume_id, width, height)."""
    line = W.partitionBy("volume_id", "z", "y").orderBy("x")
    v = F.col("v").cast("double")
    rows = mask.withColumn("island", F.col("x") - F.row_number().over(line)).groupBy("volume_id", "z", "y", "island").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("bigint")).alias("sx"), F.sum(v).alias("sv"), F.sum(v * v).alias("svv")
    )
    rows = rows.join(size, "volume_id").withColumn("run", linear_index(F.col("z"), F.col("y"), F.col("x0"), F.col("width"), F.col("height")))
    return rows.select("volume_id", "run", "z", "y", "x0", "x1", "n", "sx", "sv", "svv")


RUNS = "volume_id string, run bigint, z int, y int, x0 int, x1 int, n bigint, sx bigint, sv double, svv double"


def _plane_runs(v: np.ndarray, low: np.float32, high: np.float32) -> list[np.ndarray]:
    """y, x0, x1, sum and sum of squares of the runs of a slice."""
    h, w = v.shape
    inside = np.zeros((h, w + 2), np.int8)
    np.logical_and(v >= low, v <= high, out=inside[:, 1:-1].view(bool))
    if not inside.any():
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0)] * 2
    # Where a run begins or ends in the slice laid flat, in turn: every row has a place before and after it.
    y, x = np.divmod(np.flatnonzero(np.diff(inside.ravel())), w + 2)
    y, x0, x1 = y[::2], x[::2], x[1::2] - 1
    # Sums of each run: those over [start, end) pairs of the slice laid flat, every second of them.
    edges = np.stack([y * w + x0, y * w + x1 + 1], axis=1).ravel()
    flat = np.append(np.where(np.isnan(v), 0, v).ravel().astype(np.float64), 0.0)
    return [y, x0, x1, np.add.reduceat(flat, edges)[::2], np.add.reduceat(flat * flat, edges)[::2]]


def runs_of_blocks(blocks: DataFrame, hu_min: float, hu_max: float) -> DataFrame:
    """The same runs from whole slices: voxels never become rows.

    The slices of a volume are on one grid (``volumes.framed`` puts them there), as runs are told apart by their places
    in it. What isn't a number is in no run.
    """
    low, high = np.float32(hu_min), np.float32(hu_max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, z = (batch.column(c).to_numpy().astype(np.int64) for c in ("width", "height", "z"))
            flat, offs = batch.column("data").values.to_numpy(), batch.column("data").offsets.to_numpy()
            found = [_plane_runs(flat[offs[i] : offs[i + 1]].reshape(h[i], w[i]), low, high) for i in range(batch.num_rows)]
            at = np.repeat(np.arange(batch.num_rows), [len(f[0]) for f in found])
            if not len(at):
                continue
            y, x0, x1, sv, svv = (np.concatenate(c) for c in zip(*found, strict=True))
            n = x1 - x0 + 1
            small = lambda a: pa.array(a.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("volume_id").take(pa.array(at)), pa.array((z[at] * h[at] + y) * w[at] + x0), small(z[at]), small(y), small(x0), small(x1), *map(pa.array, (n, (x0 + x1) * n // 2, sv, svv))],
                [c.split()[0] for c in RUNS.split(", ")],
            )

    return blocks.select("volume_id", "z", "width", "height", "data").mapInArrow(run, RUNS)


def links(found: DataFrame, which: Column | None = None) -> DataFrame:
    """(volume_id, a, b) for every two runs that touch; each run looks at the four rows ahead of its own.

    ``which``: a condition on the steps ``s`` (dz, dy), where not all of them count.
    """
    steps = F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for dz, dy in FORWARD])
    a = found.select("volume_id", F.col("run").alias("a"), "z", "y", "x0", "x1", F.explode(steps).alias("s"))
    a = a if which is None else a.where(which)
    a = a.select("volume_id", "a", (F.col("z") + F.col("s.dz")).alias("z"), (F.col("y") + F.col("s.dy")).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = found.select("volume_id", F.col("run").alias("b"), "z", "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    return a.join(b, ["volume_id", "z", "y"]).where((F.col("a0") <= F.col("b1") + 1) & (F.col("a1") >= F.col("b0") - 1)).select("volume_id", "a", "b")


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the least node of each one's component, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def touching(z: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of every two runs that touch, of runs sorted by (z, y, x0): ``links`` for those of one task."""
    if not len(z):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Two rows of slack for neighbours outside, two places for ends one beyond.
    high, wide = int(y.max()) + 3, int(x1.max()) + 4
    row = z.astype(np.int64) * high + y + 1
    begin, end = row * wide + x0 + 1, row * wide + x1 + 1
    us, vs = [], []
    for dz, dy in FORWARD:
        other = (row + dz * high + dy) * wide + 1
        lo, hi = np.searchsorted(end, other + x0 - 1), np.searchsorted(begin, other + x1 + 1, side="right")
        n = np.maximum(hi - lo, 0)
        us.append(np.repeat(np.arange(len(z)), n))
        vs.append(np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
    return np.concatenate(us), np.concatenate(vs)


def _labelled(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The runs of one group in order, and the label of each among them."""
    table = table.sort_by([("z", "ascending"), ("y", "ascending"), ("x0", "ascending")]).combine_chunks()
    run = table.column("run").to_numpy()
    a, b = touching(*(table.column(c).to_numpy() for c in ("z", "y", "x0", "x1")))
    label = run.copy()
    if len(a):
        nodes, least = least_labels(a, b)
        label[nodes] = run[least]
    return table, label


def _closed(table: pa.Table) -> pa.Table:
    table, label = _labelled(table)
    return table.select(["volume_id", "run"]).append_column("label", pa.array(label))


def _counted(table: pa.Table) -> pa.Table:
    """The statistics of a volume's components, from its runs."""
    table, label = _labelled(table)
    names, at = np.unique(label, return_inverse=True)
    z, y, x0, x1, n, sx, sv, svv = (table.column(c).to_numpy() for c in ("z", "y", "x0", "x1", "n", "sx", "sv", "svv"))
    whole = lambda x: np.bincount(at, x, len(names)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    begin = np.searchsorted(at[order], np.arange(len(names)))
    least, most = (lambda x: np.minimum.reduceat(x[order], begin)), (lambda x: np.maximum.reduceat(x[order], begin))
    made = [names, whole(n), whole(sx), whole(n * y), whole(n * z), np.bincount(at, sv, len(names)), np.bincount(at, svv, len(names)), least(x0), least(y), least(z), most(x1), most(y), most(z)]
    return pa.Table.from_arrays([pa.array([table.column("volume_id")[0].as_py()] * len(names), pa.string()), *map(pa.array, made)], [c.split()[0] for c in STATS.split(", ")])


STATS = "volume_id string, label bigint, voxel_count bigint, sx bigint, sy bigint, sz bigint, sv double, svv double, min_x int, min_y int, min_z int, max_x int, max_y int, max_z int"


def stats_by_volume(found: DataFrame) -> DataFrame:
    """``component_stats`` of runs, each volume's in one task: runs are shuffled once, and nothing is written."""
    return found.groupBy("volume_id").applyInArrow(_counted, STATS)


def labels_by_volume(found: DataFrame) -> DataFrame:
    """(volume_id, run, label) of all runs."""
    return found.groupBy("volume_id").applyInArrow(_closed, "volume_id string, run bigint, label bigint")


def slab_of(z, depth, slabs: int):
    """Slices in ``slabs`` ranges as even as can be, the first ones longer by one where they aren't."""
    n = F.least(F.lit(slabs), depth)
    base, rest = F.floor(depth / n), depth % n
    return F.when(z < rest * (base + 1), F.floor(z / (base + 1))).otherwise(rest + F.floor((z - rest * (base + 1)) / F.greatest(base, F.lit(1)))).cast("int")


def labels_by_slab(found: DataFrame, slabs: int = 8) -> DataFrame:
    """The same labels from slabs: each is closed in its task, and only runs beside another slab are joined.

    ``found`` is read twice, so it should be a written table.
    """
    depth = found.groupBy("volume_id").agg((F.max("z") + 1).alias("depth"))
    placed = found.join(depth, "volume_id").withColumn("slab", slab_of(F.col("z"), F.col("depth"), slabs))
    # The first and last slice with runs of each slab, whose runs alone can touch another slab.
    ends = placed.groupBy("volume_id", "slab").agg(F.min("z").alias("top"), F.max("z").alias("bottom"))
    placed = placed.join(ends, ["volume_id", "slab"])

    def close(table: pa.Table) -> pa.Table:
        table, label = _labelled(table)
        z = table.column("z").to_numpy()
        edge = (z == table.column("top").to_numpy()) | (z == table.column("bottom").to_numpy())
        return table.select(["volume_id", "slab", "run", "z", "y", "x0", "x1"]).append_column("part", pa.array(label)).append_column("edge", pa.array(edge))

    local = placed.groupBy("volume_id", "slab").applyInArrow(close, "volume_id string, slab int, run bigint, z int, y int, x0 int, x1 int, part bigint, edge boolean")
    local = written(local, "slab-labels")
    edges = local.where("edge")
    own = lambda c: edges.select("volume_id", F.col("run").alias(c), F.col("part").alias("p" + c), F.col("slab").alias("s" + c))
    cross = links(edges, F.col("s.dz") == 1).join(own("a"), ["volume_id", "a"]).join(own("b"), ["volume_id", "b"]).where("sa <> sb")
    # Nodes of all volumes in one table of links: a hash of volume and label, told apart again by a join.
    node = lambda c: F.xxhash64("volume_id", c)
    cross = written(cross.select("volume_id", "pa", "pb", node("pa").alias("u"), node("pb").alias("v")).distinct(), "slab-links")
    if cross.isEmpty():
        return local.select("volume_id", "run", F.col("part").alias("label"))
    names = cross.select("volume_id", F.col("pa").alias("part"), F.col("u").alias("node")).union(cross.select("volume_id", "pb", "v")).distinct()
    joined = names.join(components(cross.select("u", "v")), "node")
    least = joined.groupBy("volume_id", F.col("label").alias("whole")).agg(F.min("part").alias("label"))
    parts = joined.withColumnRenamed("label", "whole").join(least, ["volume_id", "whole"]).select("volume_id", "part", "label")
    return local.select("volume_id", "run", "part").join(parts, ["volume_id", "part"], "left").select("volume_id", "run", F.coalesce("label", "part").alias("label"))


def volume_sizes(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("volume_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def labelled_runs(voxels: DataFrame, hu_min: float, hu_max: float, slabs: int | None = None, size: DataFrame | None = None) -> DataFrame:
    return labelled(runs(masked(voxels, hu_min, hu_max), volume_sizes(voxels) if size is None else size), slabs)


def labelled(found: DataFrame, slabs: int | None = None) -> DataFrame:
    """Runs with their component's label."""
    found = written(found, "runs")
    label = labels_by_volume(found) if slabs is None else labels_by_slab(found, slabs)
    return found.join(label, ["volume_id", "run"])


def component_stats(labelled: DataFrame) -> DataFrame:
    """Count, sums and box of each component; Spark merges partial ones before it shuffles."""
    n = lambda c: (F.col(c) * F.col("n")).cast("bigint")
    return labelled.groupBy("volume_id", "label").agg(
        F.sum("n").alias("voxel_count"), F.sum("sx").alias("sx"), F.sum(n("y")).alias("sy"), F.sum(n("z")).alias("sz"), F.sum("sv").alias("sv"), F.sum("svv").alias("svv"),
        F.min("x0").alias("min_x"), F.min("y").alias("min_y"), F.min("z").alias("min_z"), F.max("x1").alias("max_x"), F.max("y").alias("max_y"), F.max("z").alias("max_z"),
    )


def sized(stats: DataFrame, min_voxels: int, max_voxels: int | None = None) -> DataFrame:
    kept = stats.where(F.col("voxel_count") >= min_voxels)
    return kept if max_voxels is None else kept.where(F.col("voxel_count") <= max_voxels)


def finished(stats: DataFrame) -> DataFrame:
    """Findings, numbered from 1 in order of label within their volume."""
    n = F.col("voxel_count")
    mean = F.col("sv") / n
    centre = lambda c: F.round(F.col(c) / n).cast("int")
    return stats.select(
        "volume_id", F.row_number().over(W.partitionBy("volume_id").orderBy("label")).alias("id"), F.array(centre("sx"), centre("sy"), centre("sz")).alias("centroid"),
        F.array("min_x", "min_y", "min_z").alias("bbox_min"), F.array("max_x", "max_y", "max_z").alias("bbox_max"), n.alias("voxel_count"),
        mean.alias("mean_hu"), F.sqrt(F.greatest(F.lit(0.0), F.col("svv") / n - mean * mean)).alias("stddev_hu"),
    )


def detect(voxels: DataFrame, thresholds: Thresholds, slabs: int | None = None, size: DataFrame | None = None) -> DataFrame:
    """Findings of each volume. With ``slabs`` the volume is labelled in slabs; findings are the same."""
    found = runs(masked(voxels, thresholds.hu_min, thresholds.hu_max), volume_sizes(voxels) if size is None else size)
    stats = stats_by_volume(found) if slabs is None else component_stats(labelled(found, slabs))
    return finished(sized(stats, thresholds.min_voxels, thresholds.max_voxels))


def detect_blocks(blocks: DataFrame, thresholds: Thresholds, slabs: int | None = None) -> DataFrame:
    """Findings of volumes in blocks: the way for large volumes, as only runs are rows."""
    found = runs_of_blocks(blocks, thresholds.hu_min, thresholds.hu_max)
    stats = stats_by_volume(found) if slabs is None else component_stats(labelled(found, slabs))
    return finished(sized(stats, thresholds.min_voxels, thresholds.max_voxels))


def voxel_labels(voxels: DataFrame, hu_min: float, hu_max: float, slabs: int | None = None) -> DataFrame:
    """(volume_id, z, y, x, label) of every voxel in the range."""
    rows = labelled_runs(voxels, hu_min, hu_max, slabs)
    return rows.select("volume_id", "z", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def overlays(blocks: DataFrame, findings: DataFrame) -> DataFrame:
    """Which findings' boxes each slice shows: the slices of a box are written out, and meet slices by equality."""
    spans = findings.select("volume_id", F.explode(F.sequence(F.col("bbox_min")[2], F.col("bbox_max")[2])).alias("z"), "id", "bbox_min", "bbox_max")
    return blocks.join(spans, ["volume_id", "z"])
