"""Slices as PNG images, made where the slices are."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isovox.operators.detect import overlays

BOX = (255, 40, 40)


def window_plane(plane: np.ndarray, low: float = -1000.0, high: float = 1000.0) -> np.ndarray:
    if not high > low:
        raise ValueError("the window's end must be above its start")
    return (np.clip((plane.astype(np.float64) - low) / (high - low), 0, 1) * 255 + 0.5).astype(np.uint8)


def outline(image: np.ndarray, x0: int, y0: int, x1: int, y1: int, colour: tuple[int, int, int] = BOX) -> None:
    """A rectangle's edge, corners included, as far as it lies in the image."""
    h, w = image.shape[:2]
    xs, ys = slice(max(0, x0), max(0, min(w - 1, x1) + 1)), slice(max(0, y0), max(0, min(h - 1, y1) + 1))
    for y in (y0, y1):
        if 0 <= y < h:
            image[y, xs] = colour
    for x in (x0, x1):
        if 0 <= x < w:
            image[ys, x] = colour


def encode(image: np.ndarray) -> bytes:
    """An 8-bit gray (h, w) or RGB (h, w, 3) image."""
    h, w = image.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """What ``encode`` made."""
    w, h, _, kind = struct.unpack(">IIBB", data[16:26])
    at, raw = 8, b""
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IDAT":
            raw += data[at + 8 : at + 8 + n]
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(h, -1)[:, 1:]
    return lines.reshape(h, w, 3) if kind == 2 else lines


def _images(low: float, high: float, boxes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, h = batch.column("width")[i].as_py(), batch.column("height")[i].as_py()
                image = window_plane(batch.column("data")[i].values.to_numpy().reshape(h, w), low, high)
                if boxes:
                    image = np.repeat(image[:, :, None], 3, axis=2)
                    for b in batch.column("boxes")[i].as_py() or []:
                        outline(image, b["x0"], b["y0"], b["x1"], b["y1"])
                part = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([part.column("volume_id"), part.column("z"), pa.array([encode(image)], pa.binary())], ["volume_id", "z", "png"])

    return run


def gray(blocks: DataFrame, low: float = -1000.0, high: float = 1000.0) -> DataFrame:
    """(volume_id, z, png) of each slice."""
    return blocks.mapInArrow(_images(low, high, False), "volume_id string, z int, png binary")


def annotated(blocks: DataFrame, findings: DataFrame, low: float = -1000.0, high: float = 1000.0) -> DataFrame:
    """(volume_id, z, png) in colour, with the boxes of the findings that a slice shows."""
    spans = overlays(blocks.select("volume_id", "z"), findings)
    box = F.struct("id", F.col("bbox_min")[0].alias("x0"), F.col("bbox_min")[1].alias("y0"), F.col("bbox_max")[0].alias("x1"), F.col("bbox_max")[1].alias("y1"))
    boxes = spans.groupBy("volume_id", "z").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return blocks.join(boxes, ["volume_id", "z"], "left").mapInArrow(_images(low, high, True), "volume_id string, z int, png binary")


def one(blocks: DataFrame, z: int) -> DataFrame:
    """The slice ``z`` of each volume, or an error where a volume doesn't have it."""
    depth = blocks.groupBy("volume_id").agg(F.max("z").alias("last"))
    fine = F.when((F.lit(z) < 0) | (F.lit(z) > F.col("last")), F.raise_error(F.lit("z out of range")).cast("int")).otherwise(z)
    return blocks.join(depth.select("volume_id", fine.alias("z")), ["volume_id", "z"])


def write(images: DataFrame, folder: str, by_volume: bool = True) -> DataFrame:
    """Writes slices/slice_%03d.png below a folder that all executors reach; (volume_id, z, path) of what was written.

    Each volume has a folder of its own, by its quoted id; without ``by_volume`` the images must be of one volume.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pathlib import Path
        from urllib.parse import quote

        for batch in batches:
            paths = []
            for volume, z, data in zip(*(batch.column(c).to_pylist() for c in ("volume_id", "z", "png")), strict=True):
                to = Path(folder, *([quote(volume, safe="")] if by_volume else []), "slices", "slice_%03d.png" % z)
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_bytes(data)
                paths.append(str(to))
            yield pa.RecordBatch.from_arrays([batch.column("volume_id"), batch.column("z"), pa.array(paths, pa.string())], ["volume_id", "z", "path"])

    return images.mapInArrow(run, "volume_id string, z int, path string")
