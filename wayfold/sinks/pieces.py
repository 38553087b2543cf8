"""Files of one piece, written by many tasks at once.

Rows are numbered in their order and packed in tasks, block by block; a block's place in the file is the sum of all that lies
before it. Tasks put the blocks at their places in a partial file; the commit checks that every byte was written and gives the
file its name, a failure removes it, so the file is there whole or not at all. A task that runs again writes the same bytes to the
same places. A store that has no writes at a place (any but a mounted folder) gets the blocks in order from one task that
holds one batch of them. The driver sees sizes and check sums, never rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from wayfold.operators import spatial
from wayfold.sources.store import store

#: Bytes of a block of rows of one size; stored blocks of the deflate format hold no more.
BLOCK = 65_535


def whole(path: str, data: bytes) -> None:
    """A small file, there whole or not at all."""
    system, name = store(path)
    system.create_dir(os.path.dirname(name))
    with system.open_output_stream(f"{name}.partial") as out:
        out.write(data)
    system.move(f"{name}.partial", name)


def packed(df: DataFrame, order: list[str], pack: Callable[[pa.RecordBatch], list[bytes]], size: int, names: tuple[str, ...] = ("content",), aligned: bool = False) -> DataFrame:
    """(place, n, and a binary column for each of ``names``): runs of at most ``size`` rows in the order of ``order``, which must be total.

    ``pack`` gets rows whose column ``_place`` counts from 0. With ``aligned`` every run but the last has ``size`` rows, so equal
    tables give equal blocks however they are partitioned.
    """
    rows = spatial.dense_ids(df, order, "_place")
    if aligned:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("_block", F.expr(f"_place div {size}")).repartitionByRange(n, "_block").sortWithinPartitions("_place").drop("_block")

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        first = batch.column("_place")[0].as_py()
        return pa.RecordBatch.from_arrays([pa.array([first]), pa.array([len(batch)]), *(pa.array([x], pa.binary()) for x in pack(batch))], ["place", "n", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        after = None
        for batch in batches:
            at = batch.column("_place").to_numpy()
            if not len(at):
                continue
            cuts = np.flatnonzero((np.diff(at) != 1) | (at[1:] % size == 0)) + 1
            if held and (at[0] != after or at[0] % size == 0):
                yield made(held)
                held = []
            for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(at)], strict=True)):
                if i:
                    yield made(held)
                    held = []
                held.append(batch.slice(a, b - a))
            after = at[-1] + 1
        if held:
            yield made(held)

    return rows.mapInArrow(run, ", ".join(["place long", "n long", *(f"{c} binary" for c in names)]))


def texts(df: DataFrame, order: list[str], column: str, between: str, size: int = 1_000) -> DataFrame:
    """(place, n, content): the strings of ``column`` in order, with ``between`` before all but the first; kept."""

    def pack(batch: pa.RecordBatch) -> list[bytes]:
        lead = between if batch.column("_place")[0].as_py() else ""
        return [(lead + between.join(batch.column(column).to_pylist())).encode()]

    return spatial.keep(packed(df.select(*order, column), order, pack, size), "files")


def laid(spark: SparkSession, parts: list, at: int = 0) -> tuple[DataFrame, int]:
    """(offset, content) of the parts one after another from ``at`` on, and where they end.

    A part is bytes, blocks (place, content) of any size that are kept, or (blocks, rows, bytes of a row).
    """
    out: list[DataFrame] = []
    fixed: list[tuple[int, bytearray]] = []
    for part in parts:
        if isinstance(part, bytes):
            fixed.append((at, bytearray(part)))
            at += len(part)
        elif isinstance(part, tuple):
            df, n, size = part
            out.append(df.select((at + F.col("place") * size).alias("offset"), "content"))
            at += n * size
        else:
            sizes = part.select("place", F.octet_length("content").cast("long").alias("bytes"))
            first = spatial.offsets(sizes, "place", "bytes", "before")
            out.append(part.join(first, "place").select((at + F.col("before")).alias("offset"), "content"))
            at += sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    both = spark.createDataFrame(fixed, "offset long, content binary")
    for df in out:
        both = both.unionAll(df)
    return both, at


def write(pieces: DataFrame, path: str, size: int, in_order: bool | None = None) -> None:
    """The file of ``pieces`` (offset, content), which cover ``size`` bytes; ``in_order`` asks for the way of stores without writes at a place."""
    pieces.sparkSession.dataSource.register(PlacedFile)
    system, name = store(path)
    system.create_dir(os.path.dirname(name))
    in_order = not isinstance(system, fs.LocalFileSystem) if in_order is None else in_order
    rows = pieces.select("offset", "content")
    rows = rows.coalesce(1).sortWithinPartitions("offset") if in_order else rows
    options = {"path": path, "size": size, "partial": f"{path}.{uuid.uuid4().hex}.partial", "inOrder": in_order}
    rows.write.format("placed_file").mode("append").options(**options).save()


@dataclass
class Written(WriterCommitMessage):
    size: int


class PlacedFile(DataSource):
    """A sink of rows (offset, content) for one file; its writer commits or leaves nothing."""

    @classmethod
    def name(cls) -> str:
        return "placed_file"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["partial"], int(self.options["size"]), self.options["inOrder"].lower() == "true")


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, partial: str, size: int, in_order: bool) -> None:
        self.path, self.partial, self.size, self.in_order = path, partial, size, in_order

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, name = store(self.partial)
        return Written(self._streamed(system, name, iterator) if self.in_order else self._placed(name, iterator))

    @staticmethod
    def _rows(iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, memoryview]]:
        for batch in iterator:
            for at, content in zip(batch.column("offset"), batch.column("content"), strict=True):
                yield at.as_py(), memoryview(content.as_buffer())

    def _placed(self, name: str, iterator: Iterator[pa.RecordBatch]) -> int:
        done, file = 0, os.open(name, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for at, left in self._rows(iterator):
                while left:
                    n = os.pwrite(file, left, at)
                    at, left, done = at + n, left[n:], done + n
            os.fsync(file)
        finally:
            os.close(file)
        return done

    def _streamed(self, system: fs.FileSystem, name: str, iterator: Iterator[pa.RecordBatch]) -> int:
        done = 0
        with system.open_output_stream(name) as out:
            for at, content in self._rows(iterator):
                if at != done:
                    raise ValueError(f"a piece at {at} follows {done} bytes")
                out.write(content)
                done += len(content)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, name = store(self.partial)
        done = sum(m.size for m in messages if m is not None)
        if done != self.size or system.get_file_info(name).size != self.size:
            raise ValueError(f"{done} bytes were written of {self.size}")
        system.move(name, store(self.path)[1])

    def abort(self, messages: list[Written | None]) -> None:
        system, name = store(self.partial)
        if system.get_file_info(name).type != fs.FileType.NotFound:
            system.delete_file(name)
