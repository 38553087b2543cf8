"""A linear pipeline of stages with a manifest: what is done is skipped, and every stage is checked after it ran."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import quality


@dataclass
class Stage:
    name: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    inputs: list[str] = field(default_factory=list)
    checks: Callable[[DataFrame], dict[str, DataFrame]] | None = None  #: rules that its output must keep


MANIFEST = "stage string, version string, inputs map<string,string>, finished timestamp"


def run(spark: SparkSession, stages: list[Stage], folder: str, sources: dict[str, DataFrame], force: bool = False, stop_after: str | None = None) -> dict[str, DataFrame]:
    """The outputs by name. A run of a stage writes a table of its own in ``folder``; the manifest table there names the finished runs.

    A run is used again only if it took the versions of its inputs that are used now, so what lies downstream of a new
    output is made anew, also after a break. A stage whose checks fail leaves no row, and its earlier runs stay as they are.
    Inputs that no stage makes and no source has are an error before anything runs.
    """
    known = set(sources)
    for s in stages:
        if missing := set(s.inputs) - known:
            raise ValueError(f"{s.name} needs {', '.join(sorted(missing))}")
        known.add(s.name)
    manifest = f"{folder}/_manifest"
    last = finished(spark, manifest).groupBy("stage").agg(F.max_by(F.struct("version", "inputs"), F.struct("finished", "version")).alias("r")).select("stage", "r.*").collect()  # a row for each stage
    done = {} if force else {r["stage"]: (r["version"], r["inputs"]) for r in last}
    have, versions = dict(sources), dict.fromkeys(sources, "source")
    for s in stages:
        inputs = {k: versions[k] for k in s.inputs}
        version, taken = done.get(s.name, (None, None))
        if version is None or taken != inputs:
            version = uuid.uuid4().hex
            path = f"{folder}/{s.name}/{version}"
            s.make(spark, {k: have[k] for k in s.inputs}).write.parquet(path)
            if s.checks:
                quality.require(quality.checked(s.checks(spark.read.parquet(path))))
            row = spark.createDataFrame([(s.name, version, inputs)], "stage string, version string, inputs map<string,string>").withColumn("finished", F.current_timestamp())
            row.write.mode("append").parquet(manifest)
        have[s.name], versions[s.name] = spark.read.parquet(f"{folder}/{s.name}/{version}"), version
        if s.name == stop_after:
            break
    return {k: v for k, v in have.items() if k not in sources}


def finished(spark: SparkSession, manifest: str) -> DataFrame:
    """(stage, version, inputs, finished), empty before the first run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(manifest)
