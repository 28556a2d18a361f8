import json

import numpy as np
import pytest
from isovox import cli
from isovox.functions import values
from isovox.operators import detect
from isovox.plans import export
from isovox.sinks import png, report
from isovox.sources import dicom, volumes
from isovox.streaming import arrivals
from pyspark.sql import functions as F


@pytest.fixture
def cube(spark):
    value = lambda z, y, x: F.when(F.greatest(F.abs(x - 5), F.abs(y - 5), F.abs(z - 5)) <= 1, 300).otherwise(-800)
    return volumes.grid(spark, "cube", 10, 10, 10, value)


def _series(spark, patient="TEST001"):
    return spark.createDataFrame([("cube", patient, "CT", "20260101", 10)], "volume_id string, patient_id string, modality string, study_date string, slice_count int")


def _size(spark):
    return spark.createDataFrame([("cube", 10, 10, 10, 0.902344)], "volume_id string, width int, height int, depth int, voxel_spacing_mm double")


def test_json(spark, cube):
    findings = detect.detect(cube, detect.Thresholds(100, 500, 5))
    text = report.findings_json(findings, _size(spark), _series(spark, 'a"b\n\x01')).first()["json"]
    made = json.loads(text)
    assert list(made) == ["patientId", "modality", "studyDate", "sliceCount", "volumeDimensions", "findingCount", "findings"]
    assert made["patientId"] == 'a"b\n\x01' and made["findings"] == [{"id": 1, "centroid": [5, 5, 5], "boundingBox": {"min": [4, 4, 4], "max": [6, 6, 6]}, "voxelCount": 27, "meanHU": 300, "stddevHU": 0}]
    assert '"meanHU":300,"stddevHU":0}' in text and '"voxelSpacingMM":0.902344' in text
    none = json.loads(report.findings_json(findings.limit(0), _size(spark), _series(spark)).first()["json"])
    assert none["findingCount"] == 0 and none["findings"] == []


def test_fhir(spark, cube):
    findings = detect.detect(cube, detect.Thresholds(100, 500, 5))
    made = json.loads(report.fhir_bundle(findings, _series(spark)).first()["json"])
    assert made["resourceType"] == "Bundle" and len(made["entry"]) == 2
    assert made["entry"][0]["resource"]["conclusion"] == "Detected 1 candidate density anomaly on CT series."
    assert made["entry"][1]["resource"]["component"][0] == {"code": {"text": "voxelCount"}, "valueInteger": 27}
    none = json.loads(report.fhir_bundle(findings.limit(0), _series(spark)).first()["json"])
    assert none["entry"][0]["resource"]["conclusion"] == "Detected 0 candidate density anomalies on CT series." and len(none["entry"]) == 1


def test_six_digits(spark):
    numbers = [0.0, 161.0, 292.05178, -1024.0, 0.902344, 1e-5, 0.000123456789, 123456.7, 1234567.0, 1e20, -0.5, 90.75149, 999999.5]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select(values.six_digits(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["%.6g" % x for x in numbers]


def test_values(spark):
    df = spark.createDataFrame([(" 1.5abc",), ("x",), ("",), ("-2e2\\7\\",)], "t string")
    assert [r[0] for r in df.select(values.first_double(F.col("t"))).collect()] == [1.5, None, None, -200.0]
    assert [r[0] for r in df.select(values.double_list(F.col("t"))).collect()] == [[1.5], [0.0], [], [-200.0, 7.0, 0.0]]
    raw = spark.createDataFrame([(bytearray(b"  a \0"),), (bytearray(b"   "),), (bytearray(b""),)], "v binary")
    assert [r[0] for r in raw.select(values.trimmed(F.col("v"))).collect()] == ["  a", "", None]
    with pytest.raises(ValueError):
        values.window_byte(F.lit(1), 5, 5)


def test_png(spark, cube):
    plane = np.array([[-2000, -1000, 0, 1000, 2000]], np.float32)
    assert png.window_plane(plane).tolist() == [[0, 0, 128, 255, 255]]
    image = np.zeros((4, 4, 3), np.uint8)
    png.outline(image, -2, 1, 2, 9)
    assert (image[:, :, 0] == 255).astype(int).tolist() == [[0, 0, 0, 0], [1, 1, 1, 0], [0, 0, 1, 0], [0, 0, 1, 0]]
    assert (png.decode(png.encode(image)) == image).all()
    blocks = volumes.to_blocks(cube)
    made = png.annotated(blocks, detect.detect(cube, detect.Thresholds(100, 500, 5))).orderBy("z").collect()
    boxed = [(png.decode(r["png"]) == png.BOX).all(axis=2).sum() for r in made]
    assert boxed == [0, 0, 0, 0, 8, 8, 8, 0, 0, 0]
    assert png.decode(png.gray(png.one(blocks, 3)).first()["png"]).shape == (10, 10)
    with pytest.raises(Exception, match="z out of range"):
        png.one(blocks, 10).collect()


def _files(folder, n=6, patients=None):
    folder.mkdir(exist_ok=True)
    paths = []
    for i in range(n):
        pixels = np.zeros((8, 8), np.int32)
        if 2 <= i <= 4:
            pixels[2:5, 3:6] = 1300
        row = {"modality": "ct", "patient_id": (patients or ["P7"] * n)[i], "study_date": f"2026010{i}", "rows": 8, "columns": 8, "bits_allocated": 16, "pixel_signed": True, "rescale_slope": 1.0, "rescale_intercept": -1024.0, "image_position_z": float(i), "pixel_spacing_row_mm": 1.0, "pixel_spacing_col_mm": 1.0, "slice_thickness_mm": 1.0, "pixels": pixels.ravel()}
        (folder / f"{i}.dcm").write_bytes(dicom.annotated(row, "[]"))
        paths.append(str(folder / f"{i}.dcm"))
    return paths


def test_export(spark, tmp_path):
    paths = _files(tmp_path / "in", patients=["", "", "P2", "P3", "", "P4"])
    export.export(spark, paths[::-1], str(tmp_path / "out"), detect.Thresholds(100, 1500, 10), fhir=True)
    made = json.loads((tmp_path / "out/findings.json").read_text())
    assert (made["patientId"], made["studyDate"], made["modality"], made["findingCount"]) == ("P4", "20260105", "CT", 1)
    assert made["findings"][0]["voxelCount"] == 27 and made["findings"][0]["centroid"] == [4, 3, 3]
    assert len(list((tmp_path / "out/slices").glob("slice_00?.png"))) == 6
    again = dicom.parse((tmp_path / "out/annotated.dcm").read_bytes())
    assert dicom.slice_of(again)["image_position_z"] == 5.0 and b'"voxelCount":27' in again.last()[0x0009, 0x1001]
    assert json.loads((tmp_path / "out/findings_fhir.json").read_text())["entry"][0]["resource"]["subject"]["reference"] == "Patient/P4"


def test_no_slices(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    with pytest.raises(ValueError, match="no files"):
        export.export(spark, [], str(tmp_path / "out"), detect.Thresholds(100, 1500))
    with pytest.raises(ValueError, match="zero slices"):
        export.export(spark, [str(tmp_path / "in")], str(tmp_path / "out"), detect.Thresholds(100, 1500))
    assert cli.main(["reconstruct", str(tmp_path / "in")]) == 1
    assert "zero slices" in capsys.readouterr().err


def test_first_file_given(spark, tmp_path):
    """Patient, date and the annotated slice are those of the first file given, though another's name ends with its."""
    paths = _files(tmp_path / "in", 3, patients=["P0", "P1", "P2"])
    for old, new in ((2, "11"), (1, "1")):
        (tmp_path / f"in/{old}.dcm").rename(tmp_path / f"in/x{new}.dcm")
    paths = [str(tmp_path / "in/x11.dcm"), str(tmp_path / "in/x1.dcm"), str(tmp_path / "in/0.dcm")]
    export.export(spark, paths, str(tmp_path / "out"), detect.Thresholds(100, 1500, 1))
    assert json.loads((tmp_path / "out/findings.json").read_text())["patientId"] == "P2"
    assert dicom.slice_of(dicom.parse((tmp_path / "out/annotated.dcm").read_bytes()))["image_position_z"] == 2.0


def test_pngs_of_two_volumes(spark, cube, tmp_path):
    blocks = volumes.to_blocks(cube)
    both = blocks.union(blocks.withColumn("volume_id", F.lit("a/b")))
    made = png.write(png.gray(both), str(tmp_path)).collect()
    assert len({r["path"] for r in made}) == 20 and len(list(tmp_path.glob("a%2Fb/slices/*.png"))) == 10


def test_cli(spark, tmp_path, capsys):
    paths = _files(tmp_path / "in")
    assert cli.main(["detect", "--min-voxels", "5", *paths]) == 0
    assert "Findings: 1 anomaly" in capsys.readouterr().out
    assert cli.main(["reconstruct", *paths]) == 0
    assert "Dimensions (WxHxD): 8 x 8 x 6" in capsys.readouterr().out
    (tmp_path / "in/bad.dcm").write_bytes(b"x")
    assert cli.main(["inspect", *paths, str(tmp_path / "in/bad.dcm")]) == 1
    said = capsys.readouterr()
    assert "raw_max: 1300" in said.out and "magic" in said.err
    assert cli.main(["reconstruct", str(tmp_path / "in/bad.dcm")]) == 1


def test_stream(spark, tmp_path):
    _files(tmp_path / "in")
    seen = []
    for _ in range(2):
        q = arrivals.keep_slices(arrivals.arriving_slices(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "ck"), lambda df, n: seen.append(df.count()))
        q.awaitTermination()
        (tmp_path / "in/late.dcm").write_bytes((tmp_path / "in/0.dcm").read_bytes())
    assert seen == [6, 1]
    assert spark.read.parquet(str(tmp_path / "table")).count() == 7
