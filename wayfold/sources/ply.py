"""PLY files, binary little-endian or ASCII, parsed from Spark's binaryFile source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources.store import length, part

TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}


def _opened(data: bytes) -> tuple[bytes, bool, list[tuple[str, int, list]]]:
    """(header, whether the body is text, elements with their properties) of a file's first bytes."""
    mark = re.search(rb"end_header\r?\n", data)
    head = data[: mark.end()] if mark else data
    lines = head.decode("ascii", "replace").splitlines()
    plain = "format ascii 1.0" in lines
    if not lines or lines[0] != "ply" or not mark or not (plain or "format binary_little_endian 1.0" in lines):
        raise ValueError("not an ASCII or binary little-endian PLY file")
    elements: list[tuple[str, int, list]] = []
    for line in lines:
        word = line.split()
        if word[:1] == ["element"]:
            elements.append((word[1], int(word[2]), []))
        elif word[:2] == ["property", "list"]:
            elements[-1][2].append((word[4], TYPES[word[2]], TYPES[word[3]]))
        elif word[:1] == ["property"]:
            elements[-1][2].append((word[2], TYPES[word[1]]))
    return head, plain, elements


def parse(data: bytes) -> dict[str, np.ndarray]:
    """Elements by name, as structured arrays; lists must have the same length in all rows (triangles do)."""
    head, plain, elements = _opened(data)
    body = memoryview(data)[len(head) :]
    if plain:
        return _plain(elements, bytes(body))
    out, at = {}, 0
    for name, n, fields in elements:
        shape = []
        for f in fields:
            if len(f) == 3:
                offset = at + np.dtype(shape).itemsize
                size = int(np.frombuffer(body, f[1], 1, offset)[0]) if n else 3
                shape += [(f"{f[0]}_n", f[1]), (f[0], f[2], (size,))]
            else:
                shape.append(f)
        kind = np.dtype(shape)
        rows = np.frombuffer(body, kind, n, at)
        for f in fields:
            if len(f) == 3 and n and (rows[f"{f[0]}_n"] != rows[f"{f[0]}_n"][0]).any():
                raise ValueError(f"lists of {f[0]} differ in length")
        out[name] = rows
        at += n * kind.itemsize
    return out


def _plain(elements: list[tuple[str, int, list]], body: bytes) -> dict[str, np.ndarray]:
    """Elements of an ASCII body: a line for each row, a list as its length and its values."""
    lines, at, out = body.decode("ascii").splitlines(), 0, {}
    for name, n, fields in elements:
        rows, shape = [x.split() for x in lines[at : at + n]], []
        at += n
        place = 0
        for f in fields:
            if len(f) == 3:
                size = int(rows[0][place]) if n else 3
                shape += [(f"{f[0]}_n", f[1]), (f[0], f[2], (size,))]
                place += 1 + size
            else:
                shape.append(f)
                place += 1
        if any(len(r) != place for r in rows):
            raise ValueError(f"rows of {name} differ in length")
        made = np.zeros(n, shape)
        place = 0
        for f in np.dtype(shape).names:
            size = int(np.prod(made.dtype[f].shape, dtype=int))
            values = np.array([r[place : place + size] for r in rows], float).reshape(made[f].shape)
            made[f] = values.astype(made.dtype[f].base)
            place += size
        out[name] = made
    return out


def opening(path: str) -> tuple[bytes, list[tuple[str, int, list]], int]:
    """(header, elements, where the rows begin) of a binary file with vertices, from its first bytes."""
    head, plain, elements = _opened(part(path, 0, min(length(path), 1 << 20)))
    if plain or "vertex" not in [e[0] for e in elements]:
        raise ValueError("not a binary PLY file with vertices")
    return head, elements, len(head)


def header(elements: list[tuple[str, np.dtype, int]]) -> bytes:
    """The lines before the rows; a field with a shape is a list."""
    names = {"i1": "char", "u1": "uchar", "i2": "short", "u2": "ushort", "i4": "int", "u4": "uint", "f4": "float", "f8": "double"}
    lines = ["ply", "format binary_little_endian 1.0"]
    for name, fields, n in elements:
        lines.append(f"element {name} {n}")
        for f in fields.names:
            kind = fields[f]
            lines.append(f"property list uchar {names[kind.base.str[1:]]} {f}" if kind.shape else f"property {names[kind.str[1:]]} {f}")
    return "\n".join([*lines, "end_header\n"]).encode()


def numbered(names: list[str], prefix: str) -> list[str]:
    """Columns of a prefix by their number: f_rest_2 comes before f_rest_10."""
    found = [n for n in names if re.fullmatch(rf"{re.escape(prefix)}\d+", n)]
    return sorted(found, key=lambda n: int(n[len(prefix) :]))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _read(spark: SparkSession, path: str, make, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for columns in make(parse(data)):
                    n = len(next(iter(columns.values())))
                    arrays = {"source": pa.array([source] * n, pa.string())} | columns
                    yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays.values()], list(arrays))

    return _files(spark, path).mapInArrow(run, f"source string, {schema}")


def _parts(rows: np.ndarray, size: int = 100_000) -> Iterator[tuple[int, np.ndarray]]:
    for i in range(0, len(rows), size):
        yield i, rows[i : i + size]


def _lists(rows: np.ndarray, names: list[str]) -> pa.Array:
    values = np.column_stack([rows[n].astype(np.float32) for n in names]) if names else np.zeros((len(rows), 0), np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(names), pa.int32()), pa.array(values.ravel()))


def cloud(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    """source, id, x, y, z, r, g, b (0 to 1) of every stride-th vertex."""

    def make(e: dict[str, np.ndarray]) -> Iterator[dict]:
        v = e["vertex"]
        for i, part in _parts(v):
            at = np.arange(i, i + len(part))
            part, at = part[at % stride == 0], at[at % stride == 0]
            colour = {n: part[k] / 255.0 if k in v.dtype.names else np.full(len(part), 0.5) for n, k in (("r", "red"), ("g", "green"), ("b", "blue"))}
            if len(part):
                yield {"id": at} | {c: part[c].astype(float) for c in "xyz"} | colour

    return _read(spark, path, make, "id long, x double, y double, z double, r double, g double, b double")


def splats(spark: SparkSession, path: str) -> DataFrame:
    """source, gid, x, y, z, opacity, f_dc, f_rest, scale, rot, color_format, sh_degree; without metadata rgb and 3."""

    def make(e: dict[str, np.ndarray]) -> Iterator[dict]:
        names = list(e["vertex"].dtype.names)
        meta = e.get("metadata")
        degree = int(meta["sh_degree"][0]) if meta is not None and len(meta) else 3
        colours = int(meta["color_format"][0]) if meta is not None and len(meta) and "color_format" in meta.dtype.names else 0
        for i, part in _parts(e["vertex"]):
            lists = {p: _lists(part, numbered(names, f"{p}_")) for p in ("f_dc", "f_rest", "scale", "rot")}
            yield {"gid": np.arange(i, i + len(part))} | {c: part[c].astype(np.float32) for c in ("x", "y", "z", "opacity")} | lists | {"color_format": np.full(len(part), colours, np.int32), "sh_degree": np.full(len(part), degree, np.int32)}

    lists = ", ".join(f"{p} array<float>" for p in ("f_dc", "f_rest", "scale", "rot"))
    return _read(spark, path, make, f"gid long, x float, y float, z float, opacity float, {lists}, color_format int, sh_degree int")


def mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (source, vid, x, y, z) and faces (source, fid, a, b, c); a file without a face list is an error."""

    def corners(e: dict[str, np.ndarray]) -> Iterator[dict]:
        for i, part in _parts(e["vertex"]):
            yield {"vid": np.arange(i, i + len(part))} | {c: part[c].astype(float) for c in "xyz"}

    def faces(e: dict[str, np.ndarray]) -> Iterator[dict]:
        names = [n for n in ("vertex_index", "vertex_indices") if "face" in e and n in e["face"].dtype.names]
        if not names:
            raise ValueError("the file has no face list named vertex_index or vertex_indices")
        for i, part in _parts(e["face"]):
            yield {"fid": np.arange(i, i + len(part))} | {k: part[names[0]][:, j].astype(np.int64) for j, k in enumerate("abc")}

    return _read(spark, path, corners, "vid long, x double, y double, z double"), _read(spark, path, faces, "fid long, a long, b long, c long")


def matching(df: DataFrame, name: str) -> DataFrame:
    """Rows whose file's name ends in ``name``."""
    return df.where(F.substring_index("source", "/", -1) == name)
