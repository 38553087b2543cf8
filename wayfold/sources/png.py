"""PNG files of 8 bits a channel: pixels as rows, and rows as files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_HEAD = b"\x89PNG\r\n\x1a\n"  # fixed value: the format's signature
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # fixed values: samples of each colour type


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels, unsigned bytes; grey becomes three equal channels."""
    if data[:8] != _HEAD:
        raise ValueError("not a PNG file")
    at, body, shape = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    width, height, depth, kind, _, _, interlaced = shape
    if depth != 8 or kind not in _CHANNELS or interlaced:
        raise ValueError("only PNG files of 8 bits a channel, without palette and interlacing")
    n = _CHANNELS[kind]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width, n), np.uint8)
    above = np.zeros((width, n), np.int16)
    for y in range(height):
        line, how = lines[y, 1:].reshape(width, n).astype(np.int16), lines[y, 0]
        if how == 0:
            row = line
        elif how == 1:
            row = np.cumsum(line, 0, dtype=np.int64) & 255
        elif how == 2:
            row = (line + above) & 255
        else:  # each pixel depends on the one before
            row, left, corner = np.zeros_like(line), np.zeros(n, np.int16), np.zeros(n, np.int16)
            for x in range(width):
                if how == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    a, b, c = abs(p - left), abs(p - above[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                row[x] = (line[x] + guess) & 255
                left, corner = row[x], above[x]
        above = row.astype(np.int16)
        out[y] = above
    return np.repeat(out[:, :, :1], 3, 2) if n == 1 else np.dstack([out[:, :, :1]] * 3 + [out[:, :, 1:]]) if n == 2 else out


def encode(pixels: np.ndarray) -> bytes:
    """The file of height x width x 3 or 4 bytes."""
    height, width, n = pixels.shape
    raw = b"".join(b"\0" + line.tobytes() for line in np.ascontiguousarray(pixels, np.uint8))
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    head = struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[n], 0, 0, 0)
    return _HEAD + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, c, y, x, v) of every sample, v from 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = decode(data)
                for c in range(image.shape[2]):
                    y, x = (a.ravel().astype(np.int32) for a in np.indices(image.shape[:2]))
                    yield pa.RecordBatch.from_arrays([pa.array([source] * len(y)), pa.array(np.full(len(y), c, np.int32)), pa.array(y), pa.array(x), pa.array(image[:, :, c].ravel() / 255.0)], ["path", "c", "y", "x", "v"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, c int, y int, x int, v double")


def files(pixels: DataFrame) -> DataFrame:
    """(img, content): a PNG file for each image of (img, c, y, x, v); one image is encoded by one task."""

    def run(pdf):
        import pandas as pd

        image = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1, int(pdf["c"].max()) + 1), np.uint8)
        image[pdf["y"], pdf["x"], pdf["c"]] = np.clip(np.rint(pdf["v"] * 255), 0, 255)
        return pd.DataFrame({"img": [str(pdf["img"].iloc[0])], "content": [encode(image)]})

    return pixels.selectExpr("cast(img as string) as img", "c", "y", "x", "v").groupBy("img").applyInPandas(run, "img string, content binary")
