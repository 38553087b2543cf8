"""Scene packages: zip files whose entries come in a fixed order, with volume payloads of packed arrays.

A payload is MessagePack in gzip without compression and with a fixed time, so equal scenes give equal bytes. Only the
kinds of values that payloads have are packed: maps, lists, strings, bytes, whole numbers, floats, booleans and null.
"""

from __future__ import annotations

import functools
import gzip
import hashlib
import io
import math
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: MessagePack's type bytes for lengths of 8, 16 and 32 bits.
_SIZED = {str: (0xD9, 0xDA, 0xDB), bytes: (0xC4, 0xC5, 0xC6), list: (None, 0xDC, 0xDD), dict: (None, 0xDE, 0xDF)}
_SHORT = {str: (0xA0, 32), list: (0x90, 16), dict: (0x80, 16)}


def _head(kind: type, n: int) -> bytes:
    if kind in _SHORT and n < _SHORT[kind][1]:
        return bytes([_SHORT[kind][0] | n])
    one, two, four = _SIZED[kind]
    if one is not None and n < 1 << 8:
        return struct.pack(">BB", one, n)
    return struct.pack(">BH", two, n) if n < 1 << 16 else struct.pack(">BI", four, n)


def pack(v) -> bytes:
    if v is None or isinstance(v, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[v]
    if isinstance(v, int):
        return bytes([v & 0xFF]) if -32 <= v < 128 else struct.pack(">Bq", 0xD3, v)
    if isinstance(v, float):
        return struct.pack(">Bd", 0xCB, v)
    if isinstance(v, str):
        raw = v.encode()
        return _head(str, len(raw)) + raw
    if isinstance(v, bytes):
        return _head(bytes, len(v)) + v
    if isinstance(v, list):
        return _head(list, len(v)) + b"".join(map(pack, v))
    return _head(dict, len(v)) + b"".join(pack(k) + pack(x) for k, x in v.items())


def unpack(raw: bytes):
    return _unpack(io.BytesIO(raw))


def _unpack(f: io.BytesIO):
    b = f.read(1)[0]
    number = lambda form: struct.unpack(form, f.read(struct.calcsize(form)))[0]
    if b < 0x80 or b >= 0xE0:
        return b if b < 0x80 else b - 256
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b]
    if b in (0xCA, 0xCB):
        return number(">f" if b == 0xCA else ">d")
    if 0xCC <= b <= 0xD3:
        return number({0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}[b])
    kind, n = next(((k, b - low) for k, (low, most) in _SHORT.items() if low <= b < low + most), (None, 0))
    if kind is None:
        kind, form = next(((k, ">" + c) for k, heads in _SIZED.items() for h, c in zip(heads, "BHI", strict=True) if h == b), (None, ""))
        if kind is None:
            raise ValueError(f"unknown type byte {b:#x}")
        n = number(form)
    if kind is str:
        return f.read(n).decode()
    if kind is bytes:
        return f.read(n)
    return [_unpack(f) for _ in range(n)] if kind is list else {_unpack(f): _unpack(f) for _ in range(n)}


def payload(fields: dict) -> bytes:
    """Fields in their order; arrays become half floats with their shape."""
    plain = {k: {"dtype": "<f2", "shape": list(v.shape), "data": v.astype("<f2").tobytes()} if isinstance(v, np.ndarray) else v for k, v in fields.items()}
    return gzip.compress(pack(plain), 0, mtime=0)


def fields(raw: bytes) -> dict:
    """What :func:`payload` packed; arrays are half floats."""
    return {k: np.frombuffer(v["data"], v["dtype"]).reshape(v["shape"]) if isinstance(v, dict) and "dtype" in v else v for k, v in unpack(gzip.decompress(raw)).items()}


#: The opening of a gzip stream without a name and a time.
GZIP = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
#: Sizes of entries and of a whole package lie below this.
MOST = 1 << 32
_TURNED = 0xEDB88320  # fixed value: the polynomial of zip's and gzip's check sums, lowest power in the highest bit
crc = zlib.crc32


def opened(n: int) -> bytes:
    """The opening of a map of ``n`` fields."""
    return _head(dict, n)


def array_head(shape: list[int]) -> bytes:
    """What lies before an array's half floats; they follow as they are."""
    size = 2 * math.prod(shape)
    if size >= MOST:
        raise ValueError("an array of a payload holds less than 4 GiB")
    return _head(dict, 3) + pack("dtype") + pack("<f2") + pack("shape") + pack(shape) + pack("data") + _head(bytes, size)


def stored(data: bytes, last: bool = False) -> bytes:
    """A block of a deflate stream without compression: at most 65,535 bytes after five others."""
    return struct.pack("<BHH", last, len(data), len(data) ^ 0xFFFF) + data


def _product(a: int, b: int) -> int:
    """Of two remainders of the check sum's polynomial."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_TURNED if b & 1 else 0)
    return out


@functools.lru_cache(maxsize=4096)
def _shift(n: int) -> int:
    """The remainder that moves a check sum over ``n`` more bytes."""
    out, square = 1 << 31, 1 << 23
    while n:
        out = _product(out, square) if n & 1 else out
        square, n = _product(square, square), n >> 1
    return out


def joined(sums: list[tuple[int, int]]) -> tuple[int, int]:
    """(length, check sum) of parts one after another, from each one's own."""
    size, value = 0, 0
    for n, own in sums:
        size, value = size + n, _product(_shift(n), value) ^ own
    return size, value


def layout(entries: list[tuple[str, int, int]]) -> tuple[list[bytes], bytes]:
    """What lies before the data of each entry (name, size, check sum) and what ends the package.

    Entries are stored as they are, in their order, each at a multiple of 64 bytes, all at one fixed time.
    """
    heads, central, at = [], b"", 0
    for name, size, check in entries:
        raw = name.encode()
        pad = -(at + 30 + len(raw)) % 64
        pad += 64 if 0 < pad < 4 else 0
        extra = struct.pack("<HH", 0x1986, pad - 4) + b"\0" * (pad - 4) if pad else b""  # a field of zeros moves the data
        shared = struct.pack("<HHHHHIIIHH", 20, 0 if name.isascii() else 0x800, 0, 0, 0x21, check, size % MOST, size % MOST, len(raw), len(extra))
        heads.append(b"PK\x03\x04" + shared + raw + extra)
        central += b"PK\x01\x02" + struct.pack("<H", 20) + shared + struct.pack("<HHHII", 0, 0, 0, 0, at % MOST) + raw + extra
        at += len(heads[-1]) + size
    if at + len(central) >= MOST:
        raise ValueError("a package holds less than 4 GiB")
    return heads, central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(entries), len(entries), len(central), at, 0)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(source, place, name, at, size, sha256, content) of every entry of the packages, in their order; ``at`` is where its data begins. One package is opened by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for place, info in enumerate(z.infolist()):
                        raw = z.read(info)
                        names, extra = struct.unpack("<HH", data[info.header_offset + 26 : info.header_offset + 30])
                        at = info.header_offset + 30 + names + extra
                        yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([place], pa.int32()), pa.array([info.filename]), pa.array([at], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([hashlib.sha256(raw).hexdigest()]), pa.array([raw], pa.binary())], ["source", "place", "name", "at", "size", "sha256", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "source string, place int, name string, at long, size long, sha256 string, content binary")


def values(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """(source, field, row, value: the row's numbers) of the arrays in a package's payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, v in fields(raw).items():
                    if isinstance(v, np.ndarray):
                        rows = v.reshape(len(v), -1).astype(np.float64)
                        for i in range(0, len(rows), 50_000):
                            part = rows[i : i + 50_000]
                            n = len(part)
                            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
                            yield pa.RecordBatch.from_arrays([pa.array([source] * n), pa.array([name] * n), pa.array(np.arange(i, i + n)), lists], ["source", "field", "row", "value"])

    return entries(spark, path).where(f"name = '{entry}'").select("source", "content").mapInArrow(run, "source string, field string, row long, value array<double>")
