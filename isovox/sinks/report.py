"""Findings as JSON and as a FHIR bundle: one row a volume, built by expressions, and writers for single files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isovox.functions.values import json_text, six_digits


def _object(*fields: tuple[str, Column]) -> Column:
    parts: list[Column] = []
    for i, (name, value) in enumerate(fields):
        parts += [F.lit(("," if i else "{") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def _text(value: str) -> Column:
    return F.lit(json.dumps(value))


def _ints(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: v.cast("string")), ","), F.lit("]"))


def _joined(made: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", made.alias("text")))), lambda s: s["text"]), ",")


def findings_json(findings: DataFrame, volumes: DataFrame, series: DataFrame) -> DataFrame:
    """(volume_id, json) for each volume (volume_id, width, height, depth, voxel_spacing_mm) of a series
    (volume_id, patient_id, modality, study_date, slice_count); volumes without findings have an empty list.
    """
    one = _object(
        ("id", F.col("id").cast("string")), ("centroid", _ints(F.col("centroid"))), ("boundingBox", _object(("min", _ints(F.col("bbox_min"))), ("max", _ints(F.col("bbox_max"))))),
        ("voxelCount", F.col("voxel_count").cast("string")), ("meanHU", six_digits(F.col("mean_hu"))), ("stddevHU", six_digits(F.col("stddev_hu"))),
    )
    lists = findings.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"), _joined(one).alias("list"))
    rows = volumes.select("volume_id", "width", "height", "depth", "voxel_spacing_mm").join(series, "volume_id").join(lists, "volume_id", "left")
    size = _object(("width", F.col("width").cast("string")), ("height", F.col("height").cast("string")), ("depth", F.col("depth").cast("string")), ("voxelSpacingMM", six_digits(F.col("voxel_spacing_mm"))))
    whole = _object(
        ("patientId", json_text(F.col("patient_id"))), ("modality", json_text(F.col("modality"))), ("studyDate", json_text(F.col("study_date"))), ("sliceCount", F.col("slice_count").cast("string")),
        ("volumeDimensions", size), ("findingCount", F.coalesce("n", F.lit(0)).cast("string")), ("findings", F.concat(F.lit("["), F.coalesce("list", F.lit("")), F.lit("]"))),
    )
    return rows.select("volume_id", whole.alias("json"))


def fhir_bundle(findings: DataFrame, series: DataFrame) -> DataFrame:
    """(volume_id, json): a diagnostic report, then an observation for each finding."""
    tied = findings.join(series.select("volume_id", "patient_id"), "volume_id")
    patient = _object(("reference", json_text(F.concat(F.lit("Patient/"), F.col("patient_id")))))
    coded = lambda text: _object(("text", _text(text)))
    parts = F.concat(
        F.lit("["), _object(("code", coded("voxelCount")), ("valueInteger", F.col("voxel_count").cast("string"))), F.lit(","),
        _object(("code", coded("stddevHU")), ("valueQuantity", _object(("value", six_digits(F.col("stddev_hu")))))), F.lit("]"),
    )
    one = _object((
        "resource", _object(
            ("resourceType", _text("Observation")), ("id", F.concat(F.lit('"finding-'), F.col("id").cast("string"), F.lit('"'))), ("status", _text("preliminary")), ("code", coded("Density anomaly (region growing)")),
            ("subject", patient), ("valueQuantity", _object(("value", six_digits(F.col("mean_hu"))), ("unit", _text("HU")))), ("component", parts),
        ),
    ))
    lists = tied.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"), _joined(one).alias("list"))
    rows = series.join(lists, "volume_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    said = F.concat(F.lit("Detected "), F.col("n").cast("string"), F.lit(" candidate density anomal"), F.when(F.col("n") == 1, "y").otherwise("ies"), F.lit(" on "), F.col("modality"), F.lit(" series."))
    report = _object((
        "resource", _object(
            ("resourceType", _text("DiagnosticReport")), ("status", _text("preliminary")), ("code", coded("Automated density anomaly screening")), ("subject", patient),
            ("effectiveDateTime", json_text(F.col("study_date"))), ("conclusion", json_text(said)),
        ),
    ))
    entries = F.concat(F.lit("["), report, F.when(F.col("n") > 0, F.concat(F.lit(","), F.col("list"))).otherwise(""), F.lit("]"))
    return rows.select("volume_id", _object(("resourceType", _text("Bundle")), ("type", _text("collection")), ("entry", entries)).alias("json"))


def brief_json(findings: list[dict]) -> str:
    """What an annotated slice carries of its findings."""
    each = ("{" + f'"centroid":[{",".join(map(str, f["centroid"]))}],"voxelCount":{f["voxel_count"]},"meanHU":{f["mean_hu"]:.6g}' + "}" for f in findings)
    return "[" + ",".join(each) + "]"


def write_file(path: str | Path, content: str | bytes) -> None:
    try:
        Path(path).write_bytes(content.encode() if isinstance(content, str) else content)
    except OSError as e:
        raise RuntimeError(f"Could not open output file: {path}") from e
