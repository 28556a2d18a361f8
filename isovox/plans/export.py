"""From files to findings and exports: the whole path as one plan, and what the command line calls."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isovox.operators import detect, reconstruct
from isovox.sinks import png, report
from isovox.sources import dicom
from isovox.store import written


def series_info(slices: DataFrame) -> DataFrame:
    """(volume_id, patient_id, modality, study_date, slice_count) of each series.

    Patient and date come from the first file in input order whose patient id isn't blank; while all are blank the
    latest counts. A series without any patient id is ANONYMOUS.
    """
    named = F.col("patient_id").isNotNull()
    blank, order = F.col("patient_id") == "", reconstruct.input_order(slices)
    picked = slices.where(named).groupBy("series_id").agg(
        F.coalesce(F.min_by(F.struct("patient_id", "study_date"), F.when(~blank, order)), F.max_by(F.struct("patient_id", "study_date"), order)).alias("who")
    )
    counts = slices.groupBy("series_id").agg(F.count(F.lit(1)).cast("int").alias("slice_count"))
    kinds = reconstruct.geometry(slices).select("series_id", "modality")
    rows = counts.join(kinds, "series_id").join(picked, "series_id", "left")
    return rows.select(F.col("series_id").alias("volume_id"), F.coalesce("who.patient_id", F.lit("ANONYMOUS")).alias("patient_id"), "modality", F.coalesce("who.study_date", F.lit("")).alias("study_date"), "slice_count")


def one_series(slices: DataFrame, series_id: str = "series") -> DataFrame:
    """All files as one series, as when they are named on a command line."""
    return slices.withColumn("series_id", F.lit(series_id))


def volumes_of(slices: DataFrame, target_mm: float = -1.0) -> DataFrame:
    geo = reconstruct.geometry(slices, target_mm)
    return geo.select(F.col("series_id").alias("volume_id"), F.col("out_width").alias("width"), F.col("out_height").alias("height"), F.col("out_depth").alias("depth"), "voxel_spacing_mm", "modality")


def findings_of(blocks: DataFrame, thresholds: detect.Thresholds) -> DataFrame:
    return detect.detect_blocks(blocks, thresholds)


def export(spark: SparkSession, paths: list[str], out: str, thresholds: detect.Thresholds, fhir: bool = False) -> DataFrame:
    """Reads the files as one series and writes findings.json, annotated slices, annotated.dcm and the FHIR bundle."""
    if not paths:
        raise ValueError("no files")
    os.makedirs(os.path.join(out, "slices"), exist_ok=True)
    slices = reconstruct.require_slices(written(one_series(dicom.read_slices(spark, paths, "FAILFAST")), "slices"))
    volumes, series = volumes_of(slices), series_info(slices)
    blocks = written(reconstruct.reconstruct(slices), "blocks")
    findings = written(findings_of(blocks, thresholds), "findings")
    png.write(png.annotated(blocks, findings), os.path.abspath(out), by_volume=False).count()
    report.write_file(os.path.join(out, "findings.json"), report.findings_json(findings, volumes, series).first()["json"])
    if fhir:
        report.write_file(os.path.join(out, "findings_fhir.json"), report.fhir_bundle(findings, series).first()["json"])
    first = slices.orderBy(reconstruct.input_order(slices)).limit(1).collect()[0].asDict()
    rows = [r.asDict() for r in findings.orderBy("id").collect()]
    report.write_file(os.path.join(out, "annotated.dcm"), dicom.annotated(first, report.brief_json(rows)))
    return findings


def slice_summary(slices: DataFrame) -> DataFrame:
    """What a file says of itself: fields, raw range, Hounsfield range where the modality is just CT, and a corner."""
    low, high = F.array_min("pixels"), F.array_max("pixels")
    hu = lambda c: F.when(F.col("modality") == "CT", c.cast("double") * F.col("rescale_slope") + F.col("rescale_intercept"))
    side = F.least(F.lit(5), F.col("rows"), F.col("columns"))
    patch = F.when(side > 0, F.transform(F.sequence(F.lit(0), side - 1), lambda y: F.slice("pixels", (y * F.col("columns") + 1).cast("int"), side)))
    return slices.select(
        "path", "modality", "rows", "columns", "bits_allocated", "pixel_signed", "rescale_slope", "rescale_intercept", "image_position_z", "pixel_spacing_row_mm", "pixel_spacing_col_mm", "slice_thickness_mm",
        F.size("pixels").alias("pixel_count"), low.alias("raw_min"), high.alias("raw_max"), hu(low).alias("hu_min"), hu(high).alias("hu_max"), patch.alias("patch"), "error",
    )
