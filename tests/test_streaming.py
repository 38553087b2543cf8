from pyspark.sql import functions as F

from wayfold.operators import sequence
from wayfold.streaming import live


def stream(spark, df, path, files=1):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(df, name, checkpoint):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_filter_and_keyframes_equal_the_batch(spark, tmp_path):
    points = spark.range(100).select(F.col("id").alias("uid"), (F.col("id") / 10000.0).alias("inv_dist_std"), F.lit(0.001).alias("dist_std"))
    finish(live.confident(stream(spark, points, str(tmp_path / "p"), 3)), "points", str(tmp_path / "c1"))
    assert spark.table("points").count() == live.confident(points).count() == 50
    poses = spark.range(60).select((F.col("id") % 3).alias("rec_id"), F.col("id").alias("t_us"), (F.col("id") * 0.037).alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"), F.lit(1.0).alias("qw"), *(F.lit(0.0).alias(c) for c in ("qx", "qy", "qz")))
    finish(live.keyframes(stream(spark, poses, str(tmp_path / "k")), 0.5, 10.0), "poses", str(tmp_path / "c2"))
    batch = sequence.keyframes(poses, ["rec_id"], ["t_us"], 0.5, 10.0)
    assert {tuple(r) for r in spark.table("poses").select("rec_id", "t_us", "kept").collect()} == {tuple(r) for r in batch.select("rec_id", "t_us", "kept").collect()}


def test_windows_and_pairs(spark, tmp_path):
    at = F.timestamp_seconds(F.col("id") * 600)
    events = spark.range(48).select(at.alias("ts"), (F.col("id") % 2).alias("k"))
    finish(live.counts_by_window(stream(spark, events, str(tmp_path / "e")), "ts", "10 minutes", "1 hour", "k"), "windows", str(tmp_path / "c3"))
    closed = spark.table("windows")
    assert closed.count() >= 12 and {r.n for r in closed.collect()} == {3}
    frames = spark.range(5).select(F.lit(1).alias("rec_id"), F.col("id").alias("frame_id"), F.timestamp_seconds(1_000_000 + F.col("id") * 100).alias("frame_time"))
    seen = spark.range(5).select(F.lit(1).alias("rec_id"), F.col("id").alias("uid"), F.timestamp_seconds(1_000_016 + F.col("id") * 100).alias("obs_time"))
    pairs = live.nearest_pairs(stream(spark, frames, str(tmp_path / "f")), stream(spark, seen, str(tmp_path / "o")), "16 seconds", "1 minute")
    finish(pairs, "pairs", str(tmp_path / "c4"))
    assert sorted((r.frame_id, r.uid) for r in spark.table("pairs").collect()) == [(i, i) for i in range(5)]
