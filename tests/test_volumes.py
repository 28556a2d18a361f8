import math

import numpy as np
import pytest
from isovox.operators import detect, filters, reconstruct
from isovox.sources import volumes
from pyspark.sql import functions as F


def rows(df):
    return [r.asDict() for r in df.orderBy("volume_id", "id").collect()]


def test_sphere(spark):
    found = rows(detect.detect(volumes.spheres(spark, 40, [(20, 20, 20, 5)]), detect.Thresholds(100, 500, 5)))
    assert len(found) == 1
    f = found[0]
    assert max(abs(c - 20) for c in f["centroid"]) <= 1 and abs(f["voxel_count"] / (4 / 3 * math.pi * 125) - 1) < 0.3
    assert abs(f["mean_hu"] - 300) < 1 and f["stddev_hu"] < 1


def test_none_and_single(spark):
    assert not rows(detect.detect(volumes.spheres(spark, 20, []), detect.Thresholds(100, 500)))
    one = volumes.spheres(spark, 10, [(5, 5, 5, 0)])
    assert not rows(detect.detect(one, detect.Thresholds(100, 500, 5)))
    assert len(rows(detect.detect(one, detect.Thresholds(100, 500, 1, 1)))) == 1


def test_two_and_slabs(spark):
    assert len(rows(detect.detect(volumes.spheres(spark, 40, [(10, 10, 10, 4), (30, 30, 30, 4)]), detect.Thresholds(100, 500, 5)))) == 2
    three = volumes.spheres(spark, 50, [(10, 10, 10, 4), (25, 25, 25, 8), (40, 40, 45, 3)]).cache()
    want = rows(detect.detect(three, detect.Thresholds(100, 500, 5)))
    assert len(want) == 3
    for slabs in (1, 3, 7, 16):
        assert rows(detect.detect(three, detect.Thresholds(100, 500, 5), slabs)) == want


def test_diagonal_bounds_and_volumes(spark):
    cells = [("a", 0, 0, 0, 100.0), ("a", 1, 1, 1, 500.0), ("a", 2, 2, 2, 500.5), ("b", 0, 0, 0, 300.0), ("a", 4, 4, 4, 0.0), ("b", 4, 4, 4, 0.0)]
    df = spark.createDataFrame(cells, volumes.VOXELS)
    found = rows(detect.detect(df, detect.Thresholds(100, 500, 1)))
    assert [(f["volume_id"], f["voxel_count"]) for f in found] == [("a", 2), ("b", 1)]
    assert rows(detect.detect(df, detect.Thresholds(100, 500, 1), slabs=3)) == found


def slices(spark, n=5, order=None, rows_=4, cols=3, z=lambda i: 2.0 * i):
    order = order or range(n)
    data = [("s", k, "CT", rows_, cols, 1.0, 0.0, z(i), 1.0, 1.0, 1.0, [10 * i + x for y in range(rows_) for x in range(cols)]) for k, i in enumerate(order)]
    return spark.createDataFrame(data, "series_id string, ordinal int, modality string, rows int, columns int, rescale_slope double, rescale_intercept double, image_position_z double, pixel_spacing_row_mm double, pixel_spacing_col_mm double, slice_thickness_mm double, pixels array<int>")


def test_reconstruct_linear(spark):
    made = reconstruct.reconstruct(slices(spark, order=[3, 0, 4, 2, 1])).orderBy("z").collect()
    assert len(made) == 9 and (made[0]["width"], made[0]["height"]) == (3, 4)
    for r in made:
        assert np.allclose(np.array(r["data"]).reshape(4, 3), 5 * r["z"] + np.arange(3))


def test_reconstruct_target_and_edges(spark):
    fine = reconstruct.reconstruct(slices(spark), 0.5).orderBy("z").collect()
    assert (len(fine), fine[0]["width"], fine[0]["height"]) == (17, 5, 7)
    assert np.allclose(np.array(fine[1]["data"]).reshape(7, 5)[0], 2.5 + 0.5 * np.arange(5))
    single = reconstruct.reconstruct(slices(spark, n=1)).collect()
    assert len(single) == 1 and single[0]["data"] == [0.0, 1.0, 2.0] * 4
    assert reconstruct.geometry(slices(spark, z=lambda i: 5.0)).first()["dz"] == 1.0
    uneven = reconstruct.geometry(slices(spark, n=3, z=lambda i: [0.0, 1.0, 10.0][i])).first()
    assert uneven["dz"] == 5.0


def test_reconstruct_errors(spark):
    with pytest.raises(Exception, match="Inconsistent slice dimensions: expected 4x3 but found 2x3"):
        other = slices(spark, n=1, rows_=2).withColumn("ordinal", F.lit(9))
        reconstruct.reconstruct(slices(spark).union(other)).collect()
    with pytest.raises(reconstruct.ReconstructionError, match="zero slices"):
        reconstruct.require_slices(slices(spark).limit(0))
    for by_slice in (False, True):
        with pytest.raises(Exception, match="zero slices"):
            reconstruct.reconstruct(slices(spark).limit(0), by_slice=by_slice).count()


def test_partition_counts_agree(spark):
    s = volumes.series(spark, 8, 16, 12, 0.8, 0.8, 1.5)
    want = [(r["z"], r["data"]) for r in reconstruct.reconstruct(s).orderBy("z").collect()]
    for n in (1, 2, 8):
        assert [(r["z"], r["data"]) for r in reconstruct.reconstruct(s.repartition(n)).orderBy("z").collect()] == want
    both = s.union(s.withColumn("series_id", F.lit("other")).where("ordinal < 5"))
    for target in (-1.0, 0.5, 2.9):
        made = [sorted(map(tuple, reconstruct.reconstruct(both.repartition(3), target, by_slice).collect())) for by_slice in (False, True)]
        assert made[0] == made[1] and len({r[0] for r in made[0]}) == 2


def brute_blur(p, sigma):
    k = filters.gaussian_kernel(sigma)
    r = len(k) // 2
    for axis in (1, 0):
        p = sum(w * np.take(p, np.clip(np.arange(p.shape[axis]) + i - r, 0, p.shape[axis] - 1), axis=axis) for i, w in enumerate(k))
    return p


def test_filters(spark):
    p = np.random.default_rng(0).normal(0, 100, (9, 11)).astype(np.float32)
    assert np.abs(filters.blur_plane(p, np.array(filters.gaussian_kernel(1.0), np.float32)) - brute_blur(p.astype(float), 1.0)).max() < 1e-3
    impulse = np.zeros((9, 9), np.float32)
    impulse[4, 4] = 1
    k = filters.gaussian_kernel(1.0)
    assert np.allclose(filters.blur_plane(impulse, np.array(k, np.float32))[4, 1:8], k[3] * np.array(k), atol=1e-6)
    flat = np.full((5, 5), 7, np.float32)
    assert not filters.sobel_plane(flat).any() and (filters.equalize_plane(flat, 256) == 8).all()
    ramp = np.tile(np.arange(6, dtype=np.float32), (5, 1))
    assert (filters.sobel_plane(ramp)[:, 1:-1] == 8).all()
    with pytest.raises(ValueError):
        filters.gaussian_kernel(0)
    cube = volumes.gradient(spark, 10, 6, 2)
    assert volumes.to_voxels(volumes.to_blocks(cube)).exceptAll(cube).isEmpty()
    with pytest.raises(Exception, match="full grid"):
        volumes.to_blocks(cube.where("x > 0 or y > 0")).collect()


def test_generators(spark):
    assert len(rows(detect.detect(volumes.nodules(spark, 48, 16, 3), detect.Thresholds(100, 500, 5)))) == 8


def test_runs_of_blocks(spark):
    rng = np.random.default_rng(2)
    cells = [("v", z, y, x, float(rng.integers(0, 5) * 100)) for z in range(3) for y in range(5) for x in range(7)]
    df = spark.createDataFrame(cells, volumes.VOXELS)
    a = detect.runs(detect.masked(df, 100, 300), detect.volume_sizes(df))
    b = detect.runs_of_blocks(volumes.to_blocks(df), 100, 300)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() > 10
    assert rows(detect.detect(df, detect.Thresholds(100, 300, 1))) == rows(detect.detect_blocks(volumes.to_blocks(df), detect.Thresholds(100, 300, 1), slabs=2))


def test_store(spark):
    from isovox import store

    df = store.written(spark.range(3), "t")
    assert df.count() == 3
    odd = spark.range(1).select(F.col("id").alias("Score"), F.col("id").alias("_score"), F.col("id").alias("a.b"))
    assert store.spare(odd, "score") == "__score" and store.spare(odd, "other") == "other" and store.fresh(odd, "x") == "_x_"
    assert odd.select(*store.columns(odd, "Score")).columns == ["_score", "a.b"]
    files = store.saved(spark.createDataFrame([("x y.bin", b"one"), ("z.bin", b"two")], "name string, content binary"), "files")
    assert {r["path"].rpartition("/")[2]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(files).collect()} == {"x y.bin": b"one", "z.bin": b"two"}
    store.dropped(df)
    with pytest.raises(Exception):
        spark.read.parquet(df.written_path)
