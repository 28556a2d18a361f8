import struct

import numpy as np
import pytest
from isovox.sources import dicom
from isovox.sources.dicom import EXPLICIT_BE, EXPLICIT_LE, IMPLICIT_LE, TAGS, ParseError, build, element, even, parse, slice_of

EXTREMES = {(8, True): [-128, 127, 0, 1, -1, 5], (8, False): [0, 255, 1, 2, 3, 4], (16, True): [-32768, 32767, 0, 1, -1, 5], (16, False): [0, 65535, 1, 2, 3, 4]}


def made(syntax=EXPLICIT_LE, bits=16, signed=True, extra=(), drop=(), pixels=None):
    big = syntax == EXPLICIT_BE
    e = ">" if big else "<"
    short = lambda n: struct.pack(e + "H", n)
    values = EXTREMES[bits, signed] if pixels is None else pixels
    rows = [
        ("StudyDate", "DA", even("20260101")), ("Modality", "CS", even("CT")), ("PatientID", "LO", even("P1")), ("SliceThickness", "DS", even("2.5")), ("ImagePositionPatient", "DS", even("1\\2\\3.5")),
        ("Rows", "US", short(2)), ("Columns", "US", short(3)), ("PixelSpacing", "DS", even("0.7\\0.9")), ("BitsAllocated", "US", short(bits)), ("PixelRepresentation", "US", short(int(signed))),
        ("RescaleIntercept", "DS", even("-1024")), ("RescaleSlope", "DS", even("2")), ("PixelData", "OW", np.array(values, f"{e}{'i' if signed else 'u'}{bits // 8}").tobytes()),
    ]
    return build([(TAGS[n], c, v) for n, c, v in rows if n not in drop] + list(extra), syntax)


@pytest.mark.parametrize("syntax", [IMPLICIT_LE, EXPLICIT_LE, EXPLICIT_BE])
@pytest.mark.parametrize("bits,signed", list(EXTREMES))
def test_decode(syntax, bits, signed):
    row = slice_of(parse(made(syntax, bits, signed)))
    assert row["pixels"].tolist() == EXTREMES[bits, signed]
    assert (row["modality"], row["rows"], row["columns"], row["image_position_z"], row["rescale_slope"], row["rescale_intercept"]) == ("CT", 2, 3, 3.5, 2.0, -1024.0)
    assert (row["pixel_spacing_row_mm"], row["pixel_spacing_col_mm"], row["slice_thickness_mm"], row["patient_id"]) == (0.7, 0.9, 2.5, "P1")


@pytest.mark.parametrize(
    "data,said",
    [
        (bytes(200), "magic"),
        (b"DICM", "magic"),
        (bytes(128) + b"DICM" + element((2, 0x10), "UI", b"1.2"), "FileMetaGroupLength"),
        (bytes(128) + b"DICM" + element((2, 0), "UL", struct.pack("<I", 0)), "missing TransferSyntaxUID"),
        (build([], "1.2.840.10008.1.2.4.50"), "Unsupported transfer syntax"),
        (made(pixels=[1, 2]), "shorter"),
        (made(bits=8, pixels=[1]), "shorter"),
        (made(drop=("PixelData",)), "No PixelData"),
        (made() + b"\x01\x02\x03", "Truncated"),
        (made(extra=[((0x7FE1, 1), "US", b"")])[:-1], "Truncated"),
    ],
)
def test_errors(data, said):
    with pytest.raises(ParseError, match=said):
        slice_of(parse(data))


def test_odd_bits():
    with pytest.raises(ParseError, match="BitsAllocated"):
        slice_of(parse(made(drop=("BitsAllocated",), extra=[(TAGS["BitsAllocated"], "US", struct.pack("<H", 12))])))


def _sq(body: bytes, length: int) -> bytes:
    return struct.pack("<HH", 8, 0x1140) + b"SQ\0\0" + struct.pack("<I", length) + body


def test_sequences():
    tail = element(TAGS["Rows"], "US", struct.pack("<H", 2)) + element(TAGS["Columns"], "US", struct.pack("<H", 1)) + element(TAGS["PixelData"], "OW", bytes(4))
    head = build([])
    item = struct.pack("<HHI", 0xFFFE, 0xE000, 4) + b"abcd"
    end = struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    assert len(parse(head + _sq(item, len(item)) + tail).elements) == 3
    assert len(parse(head + _sq(item + end, 0xFFFFFFFF) + tail).elements) == 3
    for bad in (struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF), struct.pack("<HHI", 8, 8, 4)):
        with pytest.raises(ParseError):
            parse(head + _sq(bad + end, 0xFFFFFFFF) + tail)


def test_defaults_and_accessors():
    short = lambda n: struct.pack("<H", n)
    bare = [(TAGS["Rows"], "US", short(1)), (TAGS["Columns"], "US", short(1)), (TAGS["PixelData"], "OW", short(7))]
    row = slice_of(parse(build(bare)))
    assert (row["modality"], row["bits_allocated"], row["rescale_slope"], row["rescale_intercept"], row["slice_thickness_mm"], row["image_position_z"], row["patient_id"]) == ("UNKNOWN", 16, 1.0, 0.0, 1.0, 0.0, None)
    odd = [(TAGS["Modality"], "CS", b"  "), (TAGS["RescaleSlope"], "DS", b" 1.5abc "), (TAGS["ImagePositionPatient"], "DS", b"1\\bad\\3\\"), (TAGS["PatientID"], "LO", b"A "), (TAGS["PatientID"], "LO", b" B\0")]
    row = slice_of(parse(build(odd + bare)))
    assert (row["modality"], row["rescale_slope"], row["image_position_z"], row["patient_id"]) == ("", 1.5, 3.0, " B")


def test_reader(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for i in range(3):
        (tmp_path / "s" / f"{i}.dcm").write_bytes(made())
    (tmp_path / "s" / "bad.dcm").write_bytes(b"no")
    rows = dicom.read_slices(spark, str(tmp_path / "s")).orderBy("path").collect()
    assert [r["error"] is None for r in rows] == [True, True, True, False]
    assert rows[0]["pixels"] == EXTREMES[16, True]
    assert dicom.read_slices(spark, str(tmp_path / "s"), pixels=False).where("pixels is null").count() == 4
    with pytest.raises(Exception, match="magic"):
        dicom.read_slices(spark, str(tmp_path / "s"), "FAILFAST").collect()
    elements = dicom.read_elements(spark, str(tmp_path / "s"))
    assert elements.count() == 39
    assert dicom.last_values(elements).where("group = 16").first()["value"] == b"P1"
    from isovox.sources import reader

    reader.register(spark)
    assert spark.read.format("dicom").load(str(tmp_path / "s")).where("error is null").count() == 3


def test_order_of_files(spark, tmp_path):
    """The order of a list is its own, whatever its names end with; in a folder it is that of the paths."""
    for folder, names in (("s", ["1.dcm", "11.dcm", "111.dcm"]), ("t", ["b.dcm", "a.dcm", "c d.dcm"])):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(made())
    at = lambda paths: {r["path"].rpartition("/")[2]: r["ordinal"] for r in dicom.read_slices(spark, paths).select("path", "ordinal").collect()}
    s, t = str(tmp_path / "s"), str(tmp_path / "t")
    assert at([f"{s}/11.dcm", f"{s}/1.dcm", f"{s}/111.dcm"]) == {"11.dcm": 0, "1.dcm": 1, "111.dcm": 2}
    assert at([f"{s}/1.dcm", f"{s}/11.dcm"]) == {"1.dcm": 0, "11.dcm": 1}
    assert at(t) == {"a.dcm": 0, "b.dcm": 1, "c d.dcm": 2}
    assert at([f"{t}/c*.dcm", s, f"{t}/b.dcm"]) == {"c d.dcm": 0, "1.dcm": 1, "11.dcm": 2, "111.dcm": 3, "b.dcm": 4}
    (tmp_path / "none.dcm").write_bytes(b"")
    rows = dicom.read_slices(spark, [f"{s}/1.dcm", str(tmp_path / "none.dcm")]).orderBy("ordinal").collect()
    assert [r["error"] is None for r in rows] == [True, False]
    with pytest.raises(ValueError, match="no files"):
        dicom.read_slices(spark, [])


def test_files_without_the_magic_stay_in_the_jvm(spark, tmp_path):
    (tmp_path / "x.dcm").write_bytes(bytes(5000))
    (tmp_path / "y.dcm").write_bytes(b"short")
    rows = dicom.read_slices(spark, str(tmp_path))
    assert "substring(content" in rows._jdf.queryExecution().executedPlan().toString()
    assert [r["error"].startswith("Not a Part 10 DICOM file") for r in rows.collect()] == [True, True]


def test_annotated():
    for bits in (8, 16):
        for signed in (True, False):
            row = slice_of(parse(made(bits=bits, signed=signed)))
            again = parse(dicom.annotated(row, '[{"a":1}]'))
            assert slice_of(again)["pixels"].tolist() == EXTREMES[bits, signed]
            assert again.last()[0x0009, 0x1001].rstrip() == b'[{"a":1}]'
