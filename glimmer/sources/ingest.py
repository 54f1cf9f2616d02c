"""Streamed ingest: stacks as a data source of frame ranges, a store that is appended to, and conversion with crop and binning.

``spark.dataSource.register(FrameSource)`` makes ``format("frames")`` known, for
``read`` and for ``readStream``: a stream's offset is the number of whole frames that
the file has, so a file that still grows is read as it does. A batch of a stream is
written under its own number, which makes a repeated batch replace itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..operators.linalg import weighted_sums
from .stacks import FRAME, _open, directories

#: Frames that one task reads.
FRAMES_A_TASK = 64


class FrameRange(InputPartition):
    def __init__(self, path: str, first: int, places: list[tuple]):
        self.path, self.first, self.places = path, first, places


class Frames:
    """Frames of one file: TIFF by its directories, else raw of ``rows``, ``columns`` and ``dtype``."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.block = int(options.get("framespertask", FRAMES_A_TASK))  # keys come in lower case
        self.tiff = self.path.lower().endswith((".tif", ".tiff", ".btf"))
        if not self.tiff:
            self.rows, self.columns, self.dtype = int(options["rows"]), int(options["columns"]), options.get("dtype", "<u2")

    def places(self, first: int, last: int | None = None) -> list[tuple]:
        """(rows, columns, type, offsets, sizes) of the frames from ``first`` on."""
        file = _open(self.path)
        if self.tiff:
            return directories(file)[first:last]
        size = self.rows * self.columns * np.dtype(self.dtype).itemsize
        count = file.size() // size  # whole frames only
        return [(self.rows, self.columns, self.dtype, [t * size], [size]) for t in range(first, count if last is None else min(last, count))]

    def ranges(self, first: int, last: int | None = None) -> list[FrameRange]:
        found = self.places(first, last)
        return [FrameRange(self.path, first + i, found[i : i + self.block]) for i in range(0, len(found), self.block)]

    def read(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        file = _open(part.path)
        for t, (rows, columns, dtype, offsets, sizes) in enumerate(part.places, part.first):
            raw = b"".join(file.read_at(n, at) for at, n in zip(offsets, sizes, strict=True))
            pixels = np.frombuffer(raw, dtype, rows * columns).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([part.path]), *(pa.array([x], pa.int32()) for x in (t, rows, columns)), pa.array([pixels], pa.list_(pa.float64()))], ["path", "t", "rows", "columns", "pixels"])


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.frames = Frames(options)

    def partitions(self):
        return self.frames.ranges(0)

    def read(self, partition):
        return self.frames.read(partition)


class FrameStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.frames = Frames(options)

    def initialOffset(self) -> dict:
        return {"frames": 0}

    def latestOffset(self) -> dict:
        return {"frames": len(self.frames.places(0))}

    def partitions(self, start: dict, end: dict):
        return self.frames.ranges(start["frames"], end["frames"])

    def read(self, partition):
        return self.frames.read(partition)


class FrameSource(DataSource):
    """Options: ``path``; ``framesPerTask``; for raw files ``rows``, ``columns``, ``dtype``."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FrameStream(dict(self.options))


def append_frames(frames: DataFrame, folder: str, batch: int) -> None:
    """Write ``frames`` as one batch of a store, beside its number of frames and least value; a batch of that number is replaced."""
    frames.write.mode("overwrite").parquet(f"{folder}/frames/batch={batch}")
    written = frames.sparkSession.read.parquet(f"{folder}/frames/batch={batch}")
    least = written.agg(F.count("*").alias("frames"), F.min(F.array_min("pixels")).alias("least"))
    least.write.mode("overwrite").parquet(f"{folder}/least/batch={batch}")


def ingest(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of frames to a store, batch by batch; ``once``: what is there now, then end."""
    writer = stream.writeStream.foreachBatch(lambda d, batch: append_frames(d, folder, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored_frames(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/frames").drop("batch")


def running_least(spark: SparkSession, folder: str) -> tuple[int, float | None]:
    """(frames, least value) of a store, from one row a batch."""
    row = spark.read.parquet(f"{folder}/least").agg(F.sum("frames"), F.min("least")).first()
    return row[0] or 0, row[1]


def converted(frames: DataFrame, by: int = 1, top: int = 0, bottom: int = 0, left: int = 0, right: int = 0) -> DataFrame:
    """Frames of one movie cropped by so many pixels at each side, and means of each ``by`` of them; a last bin of fewer is dropped.

    Times of the bins count from 0. A crop of all pixels leaves empty frames.
    """

    def crop(batches):
        for batch in batches:
            pixels, sizes = [], []
            for rows, columns, y in zip(batch.column("rows").to_pylist(), batch.column("columns").to_pylist(), batch.column("pixels"), strict=True):
                image = y.values.to_numpy(zero_copy_only=False).reshape(rows, columns)[top : max(rows - bottom, top), left : max(columns - right, left)]
                pixels.append(image.ravel())
                sizes.append(image.shape)
            kinds = [pa.array([s[i] for s in sizes], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("t"), *kinds, pa.array(pixels, pa.list_(pa.float64()))], ["path", "t", "rows", "columns", "pixels"])

    d = frames.select("path", "t", "rows", "columns", "pixels").mapInArrow(crop, FRAME)
    if by == 1:
        return d
    bins = d.withColumn("k", F.floor(F.col("t") / by).cast("long"))
    shape = bins.groupBy("k").agg(F.min("path").alias("path"), F.min("rows").alias("rows"), F.min("columns").alias("columns"), F.count("*").alias("n")).where(F.col("n") == by)
    means = weighted_sums(bins.select("k", F.lit(1.0 / by).alias("w"), F.col("pixels").alias("x")))
    return means.join(shape, "k").select("path", F.col("k").cast("int").alias("t"), "rows", "columns", F.col("x").alias("pixels"))
