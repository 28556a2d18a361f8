"""Command line: inspect, reconstruct, detect and export files, and time filters and parallel runs."""

from __future__ import annotations

import argparse
import re
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from isovox.operators import detect, filters, reconstruct
from isovox.plans import export
from isovox.session import session
from isovox.sources import dicom, volumes
from isovox.store import written


def _inspect(spark, args) -> int:
    rows = export.slice_summary(dicom.read_slices(spark, args.files)).orderBy("path").collect()
    failed = 0
    for r in rows:
        if r["error"]:
            failed += 1
            print(f"Failed to parse {r['path']}: {r['error']}", file=sys.stderr)
            continue
        print(f"=== {r['path']} ===")
        for name in r.asDict():
            if name not in ("path", "error") and r[name] is not None:
                print(f"{name}: {r[name]}")
        print()
    return int(failed > 0)


def _volume(spark, args):
    slices = reconstruct.require_slices(written(export.one_series(dicom.read_slices(spark, args.files, "FAILFAST")), "slices"))
    return slices, written(reconstruct.reconstruct(slices), "blocks")


def _reconstruct(spark, args) -> int:
    slices, blocks = _volume(spark, args)
    v, s = export.volumes_of(slices).first(), reconstruct.volume_summary(blocks).first()
    unit = " HU" if v["modality"] == "CT" else ""
    print(f"Input slices: {slices.count()}\nModality: {v['modality']}\nDimensions (WxHxD): {v['width']} x {v['height']} x {v['depth']}")
    print(f"Voxel spacing: {v['voxel_spacing_mm']:.6g} mm (isotropic)\nTotal voxels: {s['voxels']}\nValue range: [{s['low']:.6g}, {s['high']:.6g}]{unit}")
    return 0


def _thresholds(args) -> detect.Thresholds:
    return detect.Thresholds(args.hu_min, args.hu_max, args.min_voxels)


def _detect(spark, args) -> int:
    _, blocks = _volume(spark, args)
    rows = export.findings_of(blocks, _thresholds(args)).orderBy("id").collect()
    print(f"HU threshold: [{args.hu_min:.6g}, {args.hu_max:.6g}]\nMin voxel count: {args.min_voxels}\nFindings: {len(rows)} anomal{'y' if len(rows) == 1 else 'ies'}")
    for r in rows:
        print(f"\n  [{r['id']}] Centroid: {tuple(r['centroid'])}\n      Bounding box: {tuple(r['bbox_min'])} - {tuple(r['bbox_max'])}")
        print(f"      Voxel count: {r['voxel_count']}\n      Mean HU: {r['mean_hu']:.6g}\n      Stddev HU: {r['stddev_hu']:.6g}")
    return 0


def _export(spark, args) -> int:
    found = export.export(spark, args.files, args.out, _thresholds(args), args.fhir)
    print(f"{found.count()} findings, written to {args.out}")
    return 0


def _filters(spark, args) -> int:
    """Times the block filters once their results agree with the window forms on a smaller volume."""
    small = written(volumes.gradient(spark, 24, 16, 2), "small")
    blocks = volumes.to_blocks(small)
    for a, b in ((filters.gaussian_blur(blocks, 2.0), filters.gaussian_blur_voxels(small, 2.0)), (filters.sobel_edge(blocks), filters.sobel_edge_voxels(small)), (filters.histogram_equalize(blocks), filters.histogram_equalize_voxels(small))):
        if filters.max_abs_diff(volumes.to_voxels(a), b).first()["max_abs_diff"] >= 0.1:
            print("results differ: no times", file=sys.stderr)
            return 1
    blocks = written(volumes.to_blocks(volumes.gradient(spark, args.size, args.size, args.depth)), "gradient")
    for name, made in (("gaussian", filters.gaussian_blur(blocks, 2.0)), ("sobel", filters.sobel_edge(blocks)), ("equalize", filters.histogram_equalize(blocks))):
        t = time.time()
        made.write.format("noop").mode("overwrite").save()
        print(f"{name}: {time.time() - t:.3f} s")
    return 0


def _parallel(spark, args) -> int:
    """Times stacking in 1 to 16 partitions and detection in one piece and in slabs, once results are the same."""
    limits = detect.Thresholds(100, 500, 5)
    series = written(volumes.series(spark, args.depth, 2 * args.size, 2 * args.size), "series")
    cube = written(volumes.to_blocks(volumes.nodules(spark, args.size, args.size // 4, max(1, args.size // 25))), "nodules")
    digest = lambda blocks: blocks.select("z", "width", "height", F.hash("data").alias("data")).orderBy("z").collect()
    runs = [
        ("reconstruction, partitions", (1, 2, 4, 8, 16), lambda n: digest(reconstruct.reconstruct(series.repartition(n)))),
        ("detection, slabs", (None, 1, 2, 4, 8, 16), lambda n: detect.detect_blocks(cube, limits, n).orderBy("id").collect()),
    ]
    for name, ways, make in runs:
        want = None
        for n in ways:
            t = time.time()
            rows = make(n)
            want = want or rows
            if rows != want:
                print("results differ: no times", file=sys.stderr)
                return 1
            print(f"{name} {n}: {time.time() - t:.3f} s, {len(rows)} rows")
    return 0


def _message(e: Exception) -> str:
    """What went wrong, without the stack: of a failed task its own message."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    own = [m[1] for x in lines if (m := re.match(r"isovox[\w.]*(?:Error|Exception): (.+)", x))]
    return own[0] if own else lines[0] if lines else type(e).__name__


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command and returns its exit code; ``spark``: a session to use as it is."""
    parser = argparse.ArgumentParser(prog="isovox", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(name: str, run, files: bool = True, limits: bool = False):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        if limits:
            p.add_argument("--hu-min", type=float, default=100.0)
            p.add_argument("--hu-max", type=float, default=1500.0)
            p.add_argument("--min-voxels", type=int, default=10)
        if files:
            p.add_argument("files", nargs="+")
        return p

    command("inspect", _inspect)
    command("reconstruct", _reconstruct)
    command("detect", _detect, limits=True)
    p = command("export", _export, limits=True)
    p.add_argument("--out", required=True)
    p.add_argument("--fhir", action="store_true")
    for name, run, size, depth in (("time-filters", _filters, 256, 32), ("time-parallel", _parallel, 128, 60)):
        p = command(name, run, files=False)
        p.add_argument("--size", type=int, default=size)
        p.add_argument("--depth", type=int, default=depth)
    args = parser.parse_args(argv)
    try:
        return args.run(spark or session(), args)
    except Exception as e:  # a failed job's own message is what the user needs
        print(f"error: {_message(e)}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
