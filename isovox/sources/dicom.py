"""DICOM Part 10 files as tables: decoding, encoding, and a reader with permissive and fail-fast modes.

Three transfer syntaxes are read: implicit and explicit little endian, and explicit big endian. Files are whole rows
of Spark's binaryFile source, so a file is parsed where it is read; a reader that asks for no pixels decodes none.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isovox.functions import values

IMPLICIT_LE, EXPLICIT_LE, EXPLICIT_BE = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2"
ITEM, SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE0DD)
UNDEFINED, MAGIC = 0xFFFFFFFF, b"DICM"

# Tags by name, and the codes that implicit files don't carry.
TAGS = {
    "FileMetaGroupLength": (0x0002, 0x0000),
    "TransferSyntaxUID": (0x0002, 0x0010),
    "StudyDate": (0x0008, 0x0020),
    "Modality": (0x0008, 0x0060),
    "PatientID": (0x0010, 0x0020),
    "SliceThickness": (0x0018, 0x0050),
    "ImagePositionPatient": (0x0020, 0x0032),
    "SamplesPerPixel": (0x0028, 0x0002),
    "PhotometricInterpretation": (0x0028, 0x0004),
    "Rows": (0x0028, 0x0010),
    "Columns": (0x0028, 0x0011),
    "PixelSpacing": (0x0028, 0x0030),
    "BitsAllocated": (0x0028, 0x0100),
    "BitsStored": (0x0028, 0x0101),
    "PixelRepresentation": (0x0028, 0x0103),
    "RescaleIntercept": (0x0028, 0x1052),
    "RescaleSlope": (0x0028, 0x1053),
    "PixelData": (0x7FE0, 0x0010),
}
IMPLICIT_CODES = {
    "TransferSyntaxUID": "UI", "Modality": "CS", "StudyDate": "DA", "PatientID": "LO", "SliceThickness": "DS", "ImagePositionPatient": "DS",
    "SamplesPerPixel": "US", "PhotometricInterpretation": "CS", "Rows": "US", "Columns": "US", "PixelSpacing": "DS", "BitsAllocated": "US",
    "BitsStored": "US", "PixelRepresentation": "US", "RescaleIntercept": "DS", "RescaleSlope": "DS", "PixelData": "OW",
}
_CODE_OF = {TAGS[name]: code for name, code in IMPLICIT_CODES.items()}
_LONG, _KNOWN = frozenset(values.LONG_FORM), frozenset(values.CODES)

ELEMENT = "struct<ordinal:int,group:int,element:int,vr:string,value:binary>"
SLICE_COLUMNS = (
    "series_id string, path string, ordinal int, modality string, patient_id string, study_date string, rows int, columns int, bits_allocated int, pixel_signed boolean, "
    "rescale_slope double, rescale_intercept double, image_position_z double, pixel_spacing_row_mm double, pixel_spacing_col_mm double, slice_thickness_mm double, pixels array<int>, error string"
)
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
#: SLICE_COLUMNS for Arrow, made without a session, so that data sources can use it too.
SLICE_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in SLICE_COLUMNS.split(", "))])


class ParseError(ValueError):
    """The bytes aren't a file that can be read."""


class Cursor:
    """A place in bytes; whatever would go over their end is an error that says where."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int, what: str) -> bytes:
        if len(self.data) - self.at < n:
            raise ParseError(f"Truncated file while reading {what} at offset {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str, what: str, big: bool) -> int:
        return struct.unpack((">" if big else "<") + kind, self.take(struct.calcsize(kind), what))[0]

    def tag(self, big: bool) -> tuple[int, int]:
        return self.number("H", "tag group", big), self.number("H", "tag element", big)

    @property
    def ended(self) -> bool:
        return self.at >= len(self.data)


def _header(c: Cursor, explicit: bool, big: bool) -> tuple[tuple[int, int], str, int]:
    tag = c.tag(big)
    if not explicit:
        return tag, _CODE_OF.get(tag, "??"), c.number("I", "element length", big)
    code = c.take(2, "value representation").decode("latin-1")
    if code in _LONG:
        c.take(2, "reserved bytes")
        return tag, code, c.number("I", "element length", big)
    return tag, code if code in _KNOWN else "??", c.number("H", "element length", big)


def _skip_sequence(c: Cursor, length: int, big: bool) -> None:
    if length != UNDEFINED:
        c.take(length, "sequence")
        return
    while True:
        tag, size = c.tag(big), c.number("I", "item length", big)
        if tag == SEQUENCE_END:
            return
        if tag != ITEM:
            raise ParseError("Malformed sequence: expected Item or SequenceDelimitation tag")
        if size == UNDEFINED:
            raise ParseError("Items of undefined length are not supported")
        c.take(size, "sequence item")


@dataclass
class Parsed:
    explicit: bool
    big: bool
    elements: list[tuple[int, int, str, bytes]] = field(default_factory=list)

    def last(self) -> dict[tuple[int, int], bytes]:
        """The last value of each tag."""
        return {(g, e): v for g, e, _, v in self.elements}


def parse(data: bytes, name: str = "") -> Parsed:
    """The elements of a file's data set, in order; sequences are left out."""
    if len(data) < 132 or data[128:132] != MAGIC:
        raise ParseError(f"Not a Part 10 DICOM file (missing 'DICM' magic) in: {name}")
    c = Cursor(data, 132)
    tag, _, length = _header(c, True, False)
    if tag != TAGS["FileMetaGroupLength"]:
        raise ParseError("Expected FileMetaGroupLength (0002,0000) as first element")
    value = c.take(length, "group length")
    if len(value) < 4:
        raise ParseError(f"Truncated file while reading group length at offset {c.at}")
    end = c.at + struct.unpack("<I", value[:4])[0]
    syntax = None
    while c.at < end:
        tag, code, length = _header(c, True, False)
        if code == "SQ":
            _skip_sequence(c, length, False)
            continue
        value = c.take(length, "file meta element")
        if tag == TAGS["TransferSyntaxUID"]:
            syntax = value.decode("latin-1").rstrip(" \0")
    if not syntax:
        raise ParseError("File Meta Info is missing TransferSyntaxUID (0002,0010)")
    if syntax not in (IMPLICIT_LE, EXPLICIT_LE, EXPLICIT_BE):
        raise ParseError(f"Unsupported transfer syntax: {syntax}")
    made = Parsed(syntax != IMPLICIT_LE, syntax == EXPLICIT_BE)
    while not c.ended:
        tag, code, length = _header(c, made.explicit, made.big)
        if code == "SQ":
            _skip_sequence(c, length, made.big)
            continue
        if length == UNDEFINED:
            raise ParseError("Unexpected undefined length on a non-sequence element")
        made.elements.append((*tag, code, c.take(length, "element value")))
    return made


def _string(value: bytes | None) -> str | None:
    return value.decode("latin-1").rstrip(" \0") if value else None


def _prefix(text: str) -> float | None:
    import re

    m = re.match(values.NUMBER, text)
    return float(m[1]) if m else None


def _numbers(value: bytes | None) -> list[float]:
    text = _string(value)
    return [n if (n := _prefix(t)) is not None else 0.0 for t in text.split("\\")] if text else []


def slice_of(parsed: Parsed, name: str = "", pixels: bool = True) -> dict:
    """The promoted fields of a file, with defaults where it has none."""
    of = parsed.last()
    get = lambda tag: of.get(TAGS[tag])

    def short(tag: str, default: int) -> int:
        value = get(tag)
        return struct.unpack((">" if parsed.big else "<") + "H", value[:2])[0] if value and len(value) >= 2 else default

    def real(tag: str, default: float) -> float:
        text = _string(get(tag))
        number = _prefix(text.split("\\")[0]) if text is not None else None
        return default if number is None else number

    position, spacing = _numbers(get("ImagePositionPatient")), _numbers(get("PixelSpacing"))
    modality = _string(get("Modality"))
    row = {
        "modality": "UNKNOWN" if modality is None else modality, "patient_id": _string(get("PatientID")), "study_date": _string(get("StudyDate")), "rows": short("Rows", 0), "columns": short("Columns", 0),
        "bits_allocated": short("BitsAllocated", 16), "pixel_signed": short("PixelRepresentation", 0) != 0, "rescale_slope": real("RescaleSlope", 1.0), "rescale_intercept": real("RescaleIntercept", 0.0),
        "image_position_z": position[2] if len(position) >= 3 else 0.0, "pixel_spacing_row_mm": spacing[0] if len(spacing) >= 2 else 1.0, "pixel_spacing_col_mm": spacing[1] if len(spacing) >= 2 else 1.0,
        "slice_thickness_mm": real("SliceThickness", 1.0), "pixels": None,
    }
    raw = get("PixelData")
    if raw is None:
        raise ParseError(f"No PixelData (7FE0,0010) element found in: {name}")
    bits, n = row["bits_allocated"], row["rows"] * row["columns"]
    if bits not in (8, 16):
        raise ParseError("Unsupported BitsAllocated value (only 8 and 16 are handled)")
    if len(raw) < n * bits // 8:
        raise ParseError("PixelData shorter than Rows*Columns" + ("*2 bytes implies for 16-bit data" if bits == 16 else " bytes implies for 8-bit data"))
    if pixels:
        kind = (">" if parsed.big else "<") + ("i" if row["pixel_signed"] else "u") + str(bits // 8)
        row["pixels"] = np.frombuffer(raw, kind, n).astype(np.int32)
    return row


#: Files up to which their places go to every task; more meet their rows in a join.
TOLD = 1_000_000


def _given(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, bool]]:
    """(path, place, empty) of what is there of the paths given (files, folders or patterns), under the names Spark reads them by."""
    context = spark.sparkContext
    out: dict[str, tuple[int, bool]] = {}
    for i, p in enumerate(paths):
        path = context._jvm.org.apache.hadoop.fs.Path(p)
        for status in path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path) or []:
            out.setdefault(status.getPath().toString(), (i, status.isFile() and status.getLen() == 0))
    return [(p, *x) for p, x in out.items()]


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content, given): ``given`` is a file's place from 0.

    Files given in a list go in its order, those of one folder in it by path. Files below a single path go by path
    within their folder. Places are found from the paths alone; contents are not shuffled for them. Spark's source
    leaves out files of no bytes; those given in a list are there all the same, for the decoder to tell.
    """
    if not paths:
        raise ValueError("no files")
    found = spark.read.format("binaryFile").load(paths)
    names = found.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    if isinstance(paths, str):
        place = F.row_number().over(W.partitionBy("folder").orderBy("path"))
    else:
        told = _given(spark, paths)
        empty = [(p, b"") for p, _, none in told if none]
        if empty:
            found = found.select("path", "content").union(spark.createDataFrame(empty, "path string, content binary"))
            names = names.union(spark.createDataFrame([(p, p.rpartition("/")[0]) for p, _ in empty], "path string, folder string"))
        given = spark.createDataFrame([(p, i) for p, i, _ in told], "name string, at int")
        own, above = (F.broadcast(given.select(F.col("name").alias(c), F.col("at").alias(f"at_{c}"))) for c in ("path", "folder"))
        names = names.join(own, "path", "left").join(above, "folder", "left")
        place = F.row_number().over(W.orderBy(F.coalesce("at_path", "at_folder", F.lit(len(paths))), "path"))
    places = names.select("path", (place - 1).alias("given"))
    return found.select("path", "content").join(F.broadcast(places) if names.count() <= TOLD else places, "path")


def decoded(found: DataFrame, mode: str = "PERMISSIVE", pixels: bool = True) -> DataFrame:
    """One row a file (path, content, given). PERMISSIVE: a file that can't be read has its error; FAILFAST: it fails the job.

    A file without the magic is told by an expression: its bytes are not handed on to be decoded.
    """
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError(f"no such mode: {mode}")
    found = found.select("path", F.when(F.substring("content", 129, 4) == F.lit(MAGIC), F.col("content")).alias("content"), "given")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, given in zip(*(batch.column(c) for c in ("path", "content", "given")), strict=True):
                row = dict.fromkeys(SLICE_SCHEMA.names) | {"path": path.as_py(), "ordinal": given.as_py()}
                row["series_id"] = row["path"].rpartition("/")[0].rpartition("/")[2]
                try:
                    row |= slice_of(parse(content.as_py() or b"", row["path"]), row["path"], pixels)
                except ParseError as e:
                    if mode == "FAILFAST":
                        raise
                    row["error"] = str(e)
                yield pa.RecordBatch.from_pylist([row], schema=SLICE_SCHEMA)

    return found.mapInArrow(run, SLICE_COLUMNS)


def read_slices(spark: SparkSession, paths: str | list[str], mode: str = "PERMISSIVE", pixels: bool = True) -> DataFrame:
    return decoded(files(spark, paths), mode, pixels)


def read_elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return elements_of(files(spark, paths))


def elements_of(found: DataFrame) -> DataFrame:
    """(path, ordinal, group, element, vr, value) of every element of every readable file (path, content), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                try:
                    found = parse(content.as_py(), path.as_py()).elements
                except ParseError:
                    continue
                if found:
                    g, e, vr, v = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(g)), pa.array(range(len(g)), pa.int32()), pa.array(g, pa.int32()), pa.array(e, pa.int32()), pa.array(vr), pa.array(v, pa.binary())], ["path", "ordinal", "group", "element", "vr", "value"])

    return found.select("path", "content").mapInArrow(run, "path string, ordinal int, group int, element int, vr string, value binary")


def last_values(elements: DataFrame) -> DataFrame:
    """One row a file and tag: of repeated tags the last."""
    return elements.groupBy("path", "group", "element").agg(F.max_by("vr", "ordinal").alias("vr"), F.max_by("value", "ordinal").alias("value"))


def dictionary(spark: SparkSession) -> DataFrame:
    """(group, element, name, vr): 17 rows, the same for all data."""
    return spark.createDataFrame([(*TAGS[n], n, c) for n, c in IMPLICIT_CODES.items()], "group int, element int, name string, vr string")


def with_implicit_codes(elements: DataFrame) -> DataFrame:
    codes = dictionary(elements.sparkSession).select("group", "element", F.col("vr").alias("_vr"))
    return elements.join(F.broadcast(codes), ["group", "element"], "left").withColumn("vr", F.coalesce("_vr", F.lit("??"))).drop("_vr")


# Writing


def element(tag: tuple[int, int], code: str, value: bytes, explicit: bool = True, big: bool = False) -> bytes:
    e = ">" if big else "<"
    head = struct.pack(e + "HH", *tag)
    if not explicit:
        return head + struct.pack(e + "I", len(value)) + value
    if code in _LONG:
        return head + code.encode() + b"\0\0" + struct.pack(e + "I", len(value)) + value
    return head + code.encode() + struct.pack(e + "H", len(value)) + value


def even(value: str | bytes, pad: bytes = b" ") -> bytes:
    raw = value.encode("utf-8") if isinstance(value, str) else value
    return raw + pad if len(raw) % 2 else raw


def build(elements: list[tuple[tuple[int, int], str, bytes]], syntax: str = EXPLICIT_LE) -> bytes:
    """A whole file from elements in order; its meta group is the transfer syntax alone."""
    meta = element(TAGS["TransferSyntaxUID"], "UI", even(syntax, b"\0"))
    head = element(TAGS["FileMetaGroupLength"], "UL", struct.pack("<I", len(meta)))
    return bytes(128) + MAGIC + head + meta + b"".join(element(t, c, v, syntax != IMPLICIT_LE, syntax == EXPLICIT_BE) for t, c, v in elements)


def annotated(row: dict, findings_json: str, creator: str = "ISOVOX") -> bytes:
    """A slice with its findings in a private block; pixels have as many bits as the slice says."""
    text = lambda x: even(x or "")
    short = lambda n: struct.pack("<H", n & 0xFFFF)
    ds = lambda x: even("%.6g" % x)
    bits = row["bits_allocated"]
    pixels = (np.asarray(row["pixels"]) & (1 << bits) - 1).astype(f"<u{bits // 8}").tobytes()
    return build([
        (TAGS["StudyDate"], "DA", text(row.get("study_date"))), (TAGS["Modality"], "CS", text(row["modality"])),
        ((0x0009, 0x0010), "LO", even(creator)), ((0x0009, 0x1001), "UT", even(findings_json)),
        (TAGS["PatientID"], "LO", text(row.get("patient_id"))), (TAGS["SliceThickness"], "DS", ds(row["slice_thickness_mm"])),
        (TAGS["ImagePositionPatient"], "DS", even("0\\0\\%.6g" % row["image_position_z"])),
        (TAGS["SamplesPerPixel"], "US", short(1)), (TAGS["PhotometricInterpretation"], "CS", even("MONOCHROME2")),
        (TAGS["Rows"], "US", short(row["rows"])), (TAGS["Columns"], "US", short(row["columns"])),
        (TAGS["PixelSpacing"], "DS", even("%.6g\\%.6g" % (row["pixel_spacing_row_mm"], row["pixel_spacing_col_mm"]))),
        (TAGS["BitsAllocated"], "US", short(bits)), (TAGS["BitsStored"], "US", short(bits)), (TAGS["PixelRepresentation"], "US", short(int(row["pixel_signed"]))),
        (TAGS["RescaleIntercept"], "DS", ds(row["rescale_intercept"])), (TAGS["RescaleSlope"], "DS", ds(row["rescale_slope"])),
        (TAGS["PixelData"], "OW", even(pixels, b"\0")),
    ])
