"""Writers for other tools: text models, JSON sets, reports, PLY, PNG, visibility files and packages.

Tables of any size are written as parquet. Lines of text models come from Spark's own writer. What other tools read as one file of
another kind is packed by tasks and written by them at places known beforehand (:mod:`wayfold.sinks.pieces`); no row passes the driver.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import spatial
from wayfold.sinks import pieces
from wayfold.sources import package, ply, png, store


def frame_set(frames: DataFrame, path: str, header: list[str]) -> None:
    """JSON files, one for each combination of the header columns, with their frames by timestamp."""
    inner = [c for c in frames.columns if c not in header]
    order = F.array_sort(F.collect_list(F.struct(F.col("timestamp").alias("_t"), F.struct(*inner).alias("f"))))
    sets = frames.groupBy(*header).agg(F.transform(order, lambda x: x["f"]).alias("frames"))
    sets.select(F.to_json(F.struct(*header, "frames"), {"pretty": "true"}).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def sparse_depth(points: DataFrame, path: str) -> None:
    """Long rows, by camera; the way back to arrays for each frame is :func:`depth_arrays`."""
    points.write.mode("overwrite").partitionBy("camera_label").parquet(path)


def depth_arrays(points: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each frame with parallel arrays ordered by uid."""
    names = {"u": "u", "v": "v", "z": "z", "inverse_std": "inverseDistanceStd", "distance_std": "distanceStd", "uid": "uid"}
    rows = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("uid", "u", "v", "z", "inverse_std", "distance_std"))).alias("p"))
    return rows.select(*keys, *(F.col("p")[a].alias(b) for a, b in names.items()))


def depth_files(points: DataFrame, frames: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """A JSON file of parallel arrays for each frame, in a folder of its own below ``path``; ``frames`` with the folder as ``sparse_depth``.

    Executors write the files; frames without points have none and get null.
    """
    rows = depth_arrays(points, keys)
    inner = [c for c in rows.columns if c not in keys]
    rows.select(*keys, F.to_json(F.struct(*inner)).alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)
    there = rows.select(*keys, F.concat_ws("/", F.lit(path), *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys)).alias("sparse_depth"))
    return frames.join(there, keys, "left")


def cameras_by_split(cameras: DataFrame, path: str) -> None:
    """{split: [camera, ...]} by split and id, as the file ``cameras.json`` in the folder ``path``; no cameras are an empty object."""
    inner = [c for c in cameras.columns if c != "split"]
    name = F.expr("substring(to_json(array(split)), 2, length(to_json(array(split))) - 2)")
    rows = spatial.keep(spatial.dense_ids(cameras.select("split", "id", F.to_json(F.struct(*inner)).alias("j")), ["split", "id", "j"], "k"), "files")
    first = rows.groupBy("split").agg(F.min("k").alias("first"))
    lead = F.when(F.col("k") == 0, F.concat(F.lit("{"), name, F.lit(": ["))).when(F.col("k") == F.col("first"), F.concat(F.lit("], "), name, F.lit(": ["))).otherwise(", ")
    lines = rows.join(first, "split").select("k", F.concat(lead, "j").alias("j"))
    ends = b"]}" if rows.take(1) else b"{}"
    pieces.write(*_placed(cameras.sparkSession, [pieces.texts(lines, ["k"], "j", ""), ends], f"{path}/cameras.json"))


def colmap_images(views: DataFrame) -> DataFrame:
    """Lines of an images file: id, quaternion, translation, camera, name; and an empty line for each."""
    line = F.format_string("%d %.10f %.10f %.10f %.10f %.10f %.10f %.10f %d %s", "id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id", "name")
    return views.select("id", F.posexplode(F.array(line, F.lit(""))).alias("k", "value")).orderBy("id", "k").select("value")


def colmap_cameras(cameras: DataFrame) -> DataFrame:
    """Lines of a cameras file; pixel centres move by half a pixel."""
    line = F.format_string("%d PINHOLE %d %d %.8f %.8f %.8f %.8f", "id", "w", "h", "fx", "fy", F.col("cx") + 0.5, F.col("cy") + 0.5)
    return cameras.orderBy("id").select(line.alias("value"))


def text(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).write.mode("overwrite").text(path)


def report(row: DataFrame, path: str) -> dict:
    """A one-row report as JSON, in one step: the file is there whole or not at all."""
    value = json.loads(row.select(F.to_json(F.struct(*row.columns)).alias("j")).first()["j"])
    pieces.whole(path, json.dumps(value, indent=2).encode())
    return value


def markdown(value: dict, title: str) -> str:
    """A report as a table; nested names are joined by dots."""
    rows: list[tuple[str, object]] = []

    def walk(prefix: str, v: object) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                walk(f"{prefix}.{k}" if prefix else k, x)
        else:
            rows.append((prefix, v))

    walk("", value)
    return "\n".join([f"# {title}", "", "| metric | value |", "|---|---|", *(f"| {k} | {v:.6g} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in rows), ""])


def metrics_log(long: DataFrame) -> DataFrame:
    """(metric, key, value) as one map for each metric."""
    return long.groupBy("metric").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("values"))


def _placed(spark: SparkSession, parts: list, path: str) -> tuple[DataFrame, str, int]:
    rows, size = pieces.laid(spark, parts)
    return rows, path, size


def _ply(spark: SparkSession, path: str, elements: list[tuple[str, list[tuple], np.dtype, int, DataFrame | bytes]]) -> None:
    """A file of elements (name, numpy fields, packed row, rows, blocks or bytes)."""
    head = ply.header([(name, np.dtype(fields), n) for name, fields, _, n, _ in elements])
    pieces.write(*_placed(spark, [head, *(b if isinstance(b, bytes) else (b, n, row.itemsize) for _, _, row, n, b in elements)], path))


def _blocks(df: DataFrame, order: str, row: np.dtype, pack: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    return pieces.packed(df, [order], lambda batch: [pack(batch).tobytes()], max(1, pieces.BLOCK // row.itemsize))


def _filled(batch: pa.RecordBatch, fields: list[tuple], **columns: np.ndarray) -> np.ndarray:
    rows = np.zeros(len(batch), fields)
    for name, values in columns.items():
        rows[name] = values
    return rows


def cloud(df: DataFrame, path: str) -> None:
    """x, y, z, normals of zero and colours (0 to 1) as bytes."""
    fields = [(n, "<f4") for n in ("x", "y", "z", "nx", "ny", "nz")] + [(n, "u1") for n in ("red", "green", "blue")]

    def pack(batch: pa.RecordBatch) -> np.ndarray:
        c = {n: batch.column(n).to_numpy() for n in batch.schema.names}
        colours = {b: np.clip(np.rint(c[a] * 255), 0, 255) for a, b in (("r", "red"), ("g", "green"), ("b", "blue"))}
        return _filled(batch, fields, **{n: c[n] for n in "xyz"}, **colours)

    df = df.select("id", "x", "y", "z", "r", "g", "b")
    row = np.dtype(fields)
    _ply(df.sparkSession, path, [("vertex", fields, row, df.count(), _blocks(df, "id", row, pack))])


def splats(df: DataFrame, path: str, sh_degree: int = 3) -> None:
    """Splats with their lists spread into numbered columns, and one metadata row."""
    lists = ("f_dc", "f_rest", "scale", "rot")
    sizes = df.agg(*(F.coalesce(F.max(F.size(p)), F.lit(0)).alias(p) for p in lists), F.count("*").alias("n")).first()
    of = {p: [f"{p}_{i}" for i in range(sizes[p])] for p in lists}
    fields = [(n, "<f4") for n in ("x", "y", "z", "nx", "ny", "nz", *of["f_dc"], *of["f_rest"], "opacity", *of["scale"], *of["rot"])]

    def pack(batch: pa.RecordBatch) -> np.ndarray:
        rows = _filled(batch, fields, **{c: batch.column(c).to_numpy() for c in ("x", "y", "z", "opacity")})
        for p, names in of.items():
            values = batch.column(p).flatten().to_numpy().reshape(len(batch), -1)
            for i, n in enumerate(names):
                rows[n] = values[:, i]
        return rows

    meta = np.zeros(1, [("color_format", "u1"), ("color_channel", "u1"), ("sh_degree", "u1")])
    meta["color_channel"], meta["sh_degree"] = 3, sh_degree
    df = df.select("gid", "x", "y", "z", "opacity", *lists)
    row = np.dtype(fields)
    _ply(df.sparkSession, path, [("vertex", fields, row, sizes["n"], _blocks(df, "gid", row, pack)), ("metadata", meta.dtype.descr, meta.dtype, 1, meta.tobytes())])


def volume(df: DataFrame, path: str, root: bytes) -> None:
    """A scene package of a root layer and a payload of half floats: positions, opacities, scales, rotations, colours, in that order.

    The payload is gzip without compression, whose stored blocks tasks pack by a fixed number of rows, so equal scenes give equal
    bytes. Of each block its check sums come to the driver: the formats end at 4 GiB, which bounds their number; more is an error, and
    so are lists of different lengths.
    """
    spark = df.sparkSession
    names = {"positions": ("x", "y", "z"), "opacities": ("opacity",), "scales": "scale", "rotations": "rot", "colours": "f_dc"}
    lists = [c for c in names.values() if isinstance(c, str)]
    found = df.agg(F.count("*").alias("n"), *(f(F.size(c)).alias(f"{c}_{k}") for c in lists for k, f in (("least", F.min), ("most", F.max)))).first()
    n = found["n"]
    if not n:
        return _package(path, [("root.usda", [root]), ("volume.bin", [package.payload({"version": 1})])], spark)
    if any(found[f"{c}_least"] != found[f"{c}_most"] for c in lists):
        raise ValueError("the lists of a volume differ in length")
    width = {name: found[f"{c}_most"] if isinstance(c, str) else len(c) for name, c in names.items()}
    size = pieces.BLOCK // (2 * max(width.values()))

    def pack(batch: pa.RecordBatch) -> list[bytes]:
        out = []
        for columns in names.values():
            flat = batch.column(columns).flatten().to_numpy() if isinstance(columns, str) else np.column_stack([batch.column(c).to_numpy() for c in columns]).ravel()
            out.append(package.stored(flat.astype("<f2").tobytes()))
        return out

    columns = ["gid", "x", "y", "z", "opacity", *lists]
    blocks = spatial.keep(pieces.packed(df.select(*columns), ["gid"], pack, size, tuple(names), aligned=True), "files")
    sums = {name: [(r["n"] * 2 * w, r["crc"]) for r in blocks.orderBy("place").select("n", F.crc32(F.expr(f"substring({name}, 6)")).alias("crc")).collect()] for name, w in width.items()}
    parts: list = [package.GZIP]
    raw: list[tuple[int, int]] = []

    def literal(data: bytes) -> None:
        parts.append(package.stored(data))
        raw.append((len(data), package.crc(data)))

    literal(package.opened(1 + len(names)) + package.pack("version") + package.pack(1))
    for name, w in width.items():
        literal(package.pack(name) + package.array_head([n, w]))
        parts.append(blocks.select("place", F.col(name).alias("content")))
        raw += sums[name]
    parts.append(package.stored(b"", last=True) + struct.pack("<II", package.joined(raw)[1], package.joined(raw)[0] % (1 << 32)))
    _package(path, [("root.usda", [root]), ("volume.bin", parts)], spark)


def _package(path: str, entries: list[tuple[str, list]], spark: SparkSession) -> None:
    """A zip file of entries of parts: bytes, or blocks that are kept. Each block's length and check sum come to the driver; packages end at 4 GiB."""
    listed = []
    for name, parts in entries:
        sums: list[tuple[int, int]] = []
        for part in parts:
            if isinstance(part, bytes):
                sums.append((len(part), package.crc(part)))
            else:
                total = part.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
                if total >= package.MOST:
                    raise ValueError("a package holds less than 4 GiB")
                sums += [(r["n"], r["crc"]) for r in part.orderBy("place").select(F.octet_length("content").alias("n"), F.crc32("content").alias("crc")).collect()]
        listed.append((name, *package.joined(sums)))
    heads, end = package.layout(listed)
    pieces.write(*_placed(spark, [x for head, (_, parts) in zip(heads, entries, strict=True) for x in (head, *parts)] + [end], path))


def usd_mesh(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """A package of a root layer, first, and the mesh as a layer of text, each at a multiple of 64 bytes; tasks write the text."""
    number = lambda c: F.format_string("%.6g", F.col(c).cast("double"))
    point = F.concat(F.lit("("), number("x"), F.lit(", "), number("y"), F.lit(", "), number("z"), F.lit(")"))
    points = pieces.texts(vertices.select("vid", point.alias("t")), ["vid"], "t", ", ")
    corners = pieces.texts(faces.select("fid", F.concat_ws(", ", "a", "b", "c").alias("t")), ["fid"], "t", ", ")
    counts = pieces.texts(faces.select("fid", F.lit("3").alias("t")), ["fid"], "t", ", ")
    root = '#usda 1.0\n(\n    defaultPrim = "World"\n    metersPerUnit = 1\n    upAxis = "Z"\n)\n\ndef Xform "World" (\n    prepend references = @mesh.usda@\n)\n{\n}\n'
    begin = '#usda 1.0\n(\n    defaultPrim = "Mesh"\n)\n\ndef Mesh "Mesh"\n{\n    point3f[] points = ['
    rest = "]\n    int[] faceVertexCounts = [", "]\n    int[] faceVertexIndices = [", ']\n    uniform token subdivisionScheme = "none"\n}\n'
    layer = [begin.encode(), points, rest[0].encode(), counts, rest[1].encode(), corners, rest[2].encode()]
    _package(path, [("root.usda", [root.encode()]), ("mesh.usda", layer)], vertices.sparkSession)


def camera_paths(frames: DataFrame, path: str, by: list[str], header: dict[str, object]) -> None:
    """A JSON file for each path: the header's fields and its frames by ``i``."""
    inner = [c for c in frames.columns if c not in by]
    lists = frames.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", *(c for c in inner if c != "i")))).alias("camera_path"))
    fixed = [F.lit(v).alias(k) for k, v in header.items()]
    lists.select(F.to_json(F.struct(*by, *fixed, "camera_path"), {"pretty": "true"}).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def filtered_splats(kept: DataFrame, source: str, path: str) -> None:
    """The splat file ``source`` with only the vertices ``kept`` (gid), in their order; other elements and all properties stay as they are.

    Tasks read the ranges of the file that hold kept rows, and no others; an id counts once, one that the file lacks is an error.
    The file is binary; its elements before the vertices have rows of one size, as the vertices do.
    """
    spark = kept.sparkSession
    head, elements, first = ply.opening(source)
    names = [e[0] for e in elements]
    before, vertex = elements[: names.index("vertex")], elements[names.index("vertex")]
    if any(len(f) == 3 for e in (*before, vertex) for f in e[2]):
        raise ValueError("the vertices of a splat file, and what lies before them, have no lists")
    row, n = np.dtype(vertex[2]).itemsize, vertex[1]
    start = first + sum(np.dtype(e[2]).itemsize * e[1] for e in before)
    size = max(1, pieces.BLOCK // row)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column("block").to_pylist(), batch.column("ids"), strict=True):
                data = store.part(source, start + block * size * row, min(size, n - block * size) * row)
                at = np.sort(ids.values.to_numpy()) - block * size
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.frombuffer(data, f"V{row}")[at].tobytes()], pa.binary())], ["place", "content"])

    def copied(begin: int, bytes_: int) -> tuple[DataFrame, int, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    data = store.part(source, begin + i * pieces.BLOCK, min(pieces.BLOCK, bytes_ - i * pieces.BLOCK))
                    yield pa.RecordBatch.from_arrays([pa.array([i * pieces.BLOCK]), pa.array([data], pa.binary())], ["place", "content"])

        return spark.range(-(-bytes_ // pieces.BLOCK)).mapInArrow(run, "place long, content binary"), bytes_, 1

    known = F.when((F.col("gid") >= 0) & (F.col("gid") < n), F.col("gid").cast("long")).otherwise(F.raise_error(F.concat(F.lit("the file has no vertex "), F.col("gid").cast("string"))).cast("long"))
    asked = kept.select(known.alias("gid")).groupBy(F.expr(f"gid div {size}").alias("block")).agg(F.collect_set("gid").alias("ids"))  # at most a block's rows
    found = spatial.keep(asked.mapInArrow(rows, "place long, content binary"), "files")
    left = found.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0] // row
    lines = re.sub(rb"^element\s+vertex\s+\d+", b"element vertex %d" % left, head, count=1, flags=re.MULTILINE)
    after = start + n * row
    pieces.write(*_placed(spark, [lines, copied(first, start - first), found, copied(after, store.length(source) - after)], path))


def mesh(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    corner, face = [(n, "<f4") for n in "xyz"], [("vertex_indices", "<i4", (3,))]
    v, f = vertices.select("vid", "x", "y", "z"), faces.select("fid", "a", "b", "c")
    listed = [("n", "u1"), ("vertex_indices", "<i4", (3,))]

    def corners(batch: pa.RecordBatch) -> np.ndarray:
        return _filled(batch, corner, **{n: batch.column(n).to_numpy() for n in "xyz"})

    def triangles(batch: pa.RecordBatch) -> np.ndarray:
        return _filled(batch, listed, n=3, vertex_indices=np.column_stack([batch.column(k).to_numpy() for k in "abc"]))

    rows = np.dtype(corner), np.dtype(listed)
    _ply(v.sparkSession, path, [("vertex", corner, rows[0], v.count(), _blocks(v, "vid", rows[0], corners)), ("face", face, rows[1], f.count(), _blocks(f, "fid", rows[1], triangles))])


def images(pixels: DataFrame, folder: str) -> DataFrame:
    """(img, path): a PNG file in ``folder`` for each image of (img, c, y, x, v from 0 to 1); tasks write the files, each there whole or not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for img, content in zip(*(batch.column(c).to_pylist() for c in ("img", "content")), strict=True):
                pieces.whole(f"{folder}/{img}.png", content)
                yield pa.RecordBatch.from_arrays([pa.array([img]), pa.array([f"{folder}/{img}.png"])], ["img", "path"])

    return spatial.keep(png.files(pixels).mapInArrow(run, "img string, path string"), "files")


def visibility(lists: DataFrame, path: str, n_views: int) -> None:
    """``<views, points>`` as 64-bit numbers, then for each point by id its count and views as 32-bit numbers.

    Tasks pack blocks of points and write them at their places. ``point`` is unique.
    """

    def pack(batch: pa.RecordBatch) -> list[bytes]:
        views = batch.column("views")
        first = views.offsets.to_numpy().astype(np.int64)
        counts = np.diff(first)
        out = np.empty(len(counts) + first[-1] - first[0], "<u4")
        own = first[:-1] - first[0] + np.arange(len(counts))
        out[own] = counts
        rest = np.ones(len(out), bool)
        rest[own] = False
        out[rest] = views.values.to_numpy()[first[0] : first[-1]]
        return [out.tobytes()]

    views = F.coalesce(F.sort_array("views"), F.array()).cast("array<long>").alias("views")
    blocks = spatial.keep(pieces.packed(lists.select("point", views), ["point"], pack, 1_000), "files")
    head = np.array([n_views, lists.count()], "<u8").tobytes()
    pieces.write(*_placed(lists.sparkSession, [head, blocks], path))


def visibility_rows(spark: SparkSession, path: str) -> DataFrame:
    """(place, n, views: their sum, first, list, points: of the file) of every point of the files; one file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                _, lists = _lists(data)
                for i in range(0, len(lists), 10_000):
                    some = lists[i : i + 10_000]
                    cols = [np.arange(i, i + len(some)), [len(x) for x in some], [sum(x) for x in some], [x[0] if x else None for x in some], np.full(len(some), len(lists))]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(some, pa.list_(pa.int64()))], ["place", "n", "views", "first", "points", "list"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "place long, n long, views long, first long, points long, list array<long>")


def read_visibility(path: str) -> tuple[int, list[list[int]]]:
    return _lists(Path(path).read_bytes())


def _lists(data: bytes) -> tuple[int, list[list[int]]]:
    n_views, n = np.frombuffer(data, "<u8", 2).tolist()
    rest, at, out = np.frombuffer(data, "<u4", offset=16), 0, []
    for _ in range(n):
        k = int(rest[at])
        out.append(rest[at + 1 : at + 1 + k].tolist())
        at += 1 + k
    return n_views, out
