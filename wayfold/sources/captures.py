"""Readers of capture files. Every schema is explicit; nothing is inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRAJECTORY = "tracking_timestamp_us LONG, tx_world_device DOUBLE, ty_world_device DOUBLE, tz_world_device DOUBLE, qx_world_device DOUBLE, qy_world_device DOUBLE, qz_world_device DOUBLE, qw_world_device DOUBLE"
POINTS = "uid LONG, px_world DOUBLE, py_world DOUBLE, pz_world DOUBLE, inv_dist_std DOUBLE, dist_std DOUBLE"
OBSERVATIONS = "uid LONG, frame_tracking_timestamp_us LONG, camera_serial STRING"
MATRIX = "ARRAY<ARRAY<DOUBLE>>"
RAW_FRAMES = f"camera_model STRING, camera_label STRING, transform_cpf {MATRIX}, frames ARRAY<STRUCT<fl_x: DOUBLE, fl_y: DOUBLE, cx: DOUBLE, cy: DOUBLE, distortion_params: ARRAY<DOUBLE>, w: INT, h: INT, file_path: STRING, camera_modality: STRING, camera_name: STRING, camera2device: {MATRIX}, transform_matrix: {MATRIX}, transform_matrix_read_start: {MATRIX}, transform_matrix_read_end: {MATRIX}, timestamp: LONG, timestamp_read_start: LONG, timestamp_read_end: LONG, exposure_duration_s: DOUBLE, gain: DOUBLE>>"
RECTIFIED_FRAMES = f"camera_model STRING, camera_label STRING, transform_cpf {MATRIX}, frames ARRAY<STRUCT<fx: DOUBLE, fy: DOUBLE, cx: DOUBLE, cy: DOUBLE, w: INT, h: INT, image_width_raw: INT, image_height_raw: INT, image_path: STRING, image_modality: STRING, mask_path: STRING, camera2device: {MATRIX}, transform_matrix: {MATRIX}, transform_matrix_read_start: {MATRIX}, transform_matrix_read_end: {MATRIX}, timestamp: LONG, timestamp_read_start: LONG, timestamp_read_end: LONG, exposure_duration_s: DOUBLE, gain: DOUBLE, sparse_depth: STRING>>"
DEPTH = "u ARRAY<DOUBLE>, v ARRAY<DOUBLE>, z ARRAY<DOUBLE>, inverseDistanceStd ARRAY<DOUBLE>, distanceStd ARRAY<DOUBLE>, uid ARRAY<LONG>"
CAMERAS = f"id INT, width INT, height INT, img_name STRING, camera_name STRING, camera_modality STRING, c2w {MATRIX}, fov_x DOUBLE, fov_y DOUBLE, fx DOUBLE, fy DOUBLE, exposure_multiplier DOUBLE, radiance_weight DOUBLE"


def _first_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line): the first line of each file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.where("block = 0").withColumn("nth", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "nth").alias("line"))


def _by_header(spark: SparkSession, path: str | list[str], schema: str, keep: list[str] | None) -> DataFrame:
    """CSV by column names: each file is read by its own first line, so files may differ in their columns' order and extras.

    A file without one of the schema's columns is an error. Files of one header are read together.
    """
    from pyspark.sql.types import _parse_datatype_string

    fields = [f for f in _parse_datatype_string(schema).fields if keep is None or f.name in keep]
    headers: dict[str, list[str]] = {}
    for r in _first_lines(spark, path).orderBy("file").toLocalIterator():
        headers.setdefault(r["line"].rstrip("\r"), []).append(r["file"])
    parts = []
    for header, files in headers.items():
        names = [n.strip().strip('"') for n in header.split(",")]
        if missing := [f.name for f in fields if f.name not in names]:
            raise ValueError(f"{files[0]} has no column {', '.join(missing)}")
        raw = spark.read.schema(", ".join(f"`{n}` STRING" for n in names)).csv(path if len(headers) == 1 else files, header=True)
        parts.append(raw.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields)))
    out = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields))
    return out.select(*keep) if keep else out


def trajectory(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    return _by_header(spark, path, TRAJECTORY, columns)


def points(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """Gzip files can't be split: write a large one as parquet before using it again."""
    return _by_header(spark, path, POINTS, columns)


def observations(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    return _by_header(spark, path, OBSERVATIONS, columns)


def calibration(spark: SparkSession, path: str, every_record: bool = False) -> DataFrame:
    """Cameras of a calibration file with one JSON record a line; of the first record, unless asked for all.

    record, label, serial, tx, ty, tz, qw, qx, qy, qz, params, readout_s; the quaternion is [w, [x, y, z]].
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")).alias("at")).where(F.trim("value") != "")
    if every_record:
        lines = lines.select(F.row_number().over(Window.partitionBy("file").orderBy("at")).alias("record"), F.col("value").alias("line")).withColumn("record", F.col("record") - 1)
    else:
        lines = lines.groupBy().agg(F.min_by("value", F.struct("file", "at")).alias("line"), F.lit(0).alias("record")).where("line IS NOT NULL")
    v = lines.select("record", F.parse_json("line").alias("v"))
    cameras = v.select("record", F.explode(F.expr("variant_get(v, '$.CameraCalibrations', 'array<variant>')")).alias("c"), F.expr("try_variant_get(v, '$.ReadoutTimesSec', 'map<string,double>')").alias("readout"))
    get = lambda p, t: F.expr(f"try_variant_get(c, '$.{p}', '{t}')")
    q = lambda p: get(f"T_Device_Camera.UnitQuaternion{p}", "double")
    label = get("Label", "string")
    return cameras.select(
        "record", label.alias("label"), get("SerialNumber", "string").alias("serial"), *(get(f"T_Device_Camera.Translation[{i}]", "double").alias(n) for i, n in enumerate(("tx", "ty", "tz"))),
        q("[0]").alias("qw"), *(q(f"[1][{i}]").alias(n) for i, n in enumerate(("qx", "qy", "qz"))), get("Projection.Params", "array<double>").alias("params"), F.try_element_at("readout", label).alias("readout_s"),
    )


def tracking_cameras(cameras: DataFrame) -> DataFrame:
    """Cameras with a serial whose label begins with slam."""
    return cameras.where(F.col("serial").isNotNull() & F.col("label").startswith("slam"))


def frames(spark: SparkSession, path, rectified: bool = True) -> DataFrame:
    """A row for each frame of the frame sets, with its own file's header. ``uid`` numbers them by path and time within a file."""
    sets = spark.read.schema(RECTIFIED_FRAMES if rectified else RAW_FRAMES).json(path, multiLine=True).withColumn("source", F.input_file_name())
    place = "image_path" if rectified else "file_path"
    ordered = F.array_sort(F.transform("frames", lambda f: F.struct(f[place].alias("p"), f["timestamp"].alias("t"), f.alias("f"))), lambda x, y: F.when(x["p"].eqNullSafe(y["p"]), F.when(x["t"] < y["t"], -1).when(x["t"] > y["t"], 1).otherwise(0)).when(y["p"].isNull() | (x["p"] < y["p"]), -1).otherwise(1))
    return sets.select("source", "camera_model", "camera_label", F.posexplode(ordered).alias("uid", "o")).select("source", "camera_model", "camera_label", "uid", "o.f.*")


def sparse_depth(spark: SparkSession, path) -> DataFrame:
    """A row for each point of the files' parallel arrays; uid is null where a file has none."""
    files = spark.read.schema(DEPTH).json(path, multiLine=True).withColumn("source", F.input_file_name())
    uid = F.coalesce("uid", F.transform("u", lambda _: F.lit(None).cast("long")))
    return files.select("source", F.inline(F.arrays_zip("u", "v", "z", "inverseDistanceStd", "distanceStd", uid.alias("uid"))))


def cameras(spark: SparkSession, path, split: str) -> DataFrame:
    """Cameras of one split of a {split: [camera, ...]} file; a missing split is an error."""
    read = spark.read.schema(f"{split} ARRAY<STRUCT<{', '.join(x.replace(' ', ': ', 1) for x in CAMERAS.split(', '))}>>").json(path, multiLine=True)
    checked = F.when(F.col(split).isNull(), F.raise_error(F.lit(f"no split {split}")).cast(read.schema[split].dataType)).otherwise(F.col(split))
    return read.select(F.explode(checked).alias("c")).select("c.*")


def keyframe_span(spark: SparkSession, path) -> DataFrame:
    """(first, last) of the key frames' times."""
    k = spark.read.schema("keyframe_timestamps_ns ARRAY<LONG>").json(path, multiLine=True)
    return k.select(F.explode("keyframe_timestamps_ns").alias("t")).agg(F.min("t").alias("first"), F.max("t").alias("last"))


def images(spark: SparkSession, path: str, masks: DataFrame | None = None) -> DataFrame:
    """(path, img, c, y, x, v, mask): the pixels of PNG files, from 0 to 1, channel by channel.

    A fourth channel is the mask; else ``masks`` (img, y, x, mask) gives it, or it is 1. ``img`` is the file's name. Other
    image formats need decoders that are not here and are errors.
    """
    from wayfold.sources import png

    pixels = png.read(spark, path)
    alpha = pixels.where("c = 3").select("path", "y", "x", F.col("v").alias("alpha"))
    rows = pixels.where("c < 3").withColumn("img", F.substring_index("path", "/", -1)).join(alpha, ["path", "y", "x"], "left")
    if masks is not None:
        rows = rows.join(masks.withColumnRenamed("mask", "given"), ["img", "y", "x"], "left")
    given = F.col("given").cast("double") if masks is not None else F.lit(None).cast("double")
    return rows.select("path", "img", "c", "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v"))).alias("v"), F.coalesce("alpha", given, F.lit(1.0)).alias("mask"))


def settings(spark: SparkSession, path: str, overrides: list[str] | None = None, unset: float = -1) -> DataFrame:
    """(name, value as JSON) of a settings file of nested objects; ``a.b=value`` overrides a leaf, and numbers equal to ``unset`` are null.

    An override of a leaf that the file doesn't have is an error.
    """
    from wayfold.operators import quality

    text = spark.read.text(path, wholetext=True).select(F.lit(0).alias("k"), F.col("value").alias("j"))
    leaves = quality.flattened(text, ["k"], "j", digest=False).select(F.translate(F.substring("path", 2, 1000), "/", ".").alias("name"), "value")
    given = dict(x.split("=", 1) for x in overrides or [])
    known = {r["name"] for r in leaves.select("name").collect()}  # the leaves of one settings file
    if unknown := sorted(set(given) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    value = F.col("value")
    for name, v in given.items():
        value = F.when(F.col("name") == name, F.lit(v)).otherwise(value)
    return leaves.select("name", F.when(value.try_cast("double") == unset, None).otherwise(value).alias("value"))


def recordings(paths: str) -> list[str]:
    """The folders of ``dir/a+b+c``."""
    root, _, names = paths.rpartition("/")
    return [f"{root}/{n}" if root else n for n in names.split("+") if n]


def latest_iteration(spark: SparkSession, folder: str) -> int | None:
    """The greatest number at the end of the folder's files' paths ``..._<number>/...``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return files.agg(F.max(iteration(F.col("path")))).first()[0]


def iteration(path: Column) -> Column:
    found = F.regexp_extract(path, r"iteration_(\d+)", 1)
    return F.when(found != "", found.cast("int"))
