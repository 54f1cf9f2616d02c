"""Image stacks as tables of frames: uncompressed TIFF (also of more than 4 GB) and headerless raw files.

Directories are read first, one row a frame with the places of its strips; frames
are then dealt to tasks and read by range, so a file of any size is split, and a
frame range is a filter on ``t`` before anything but directories is read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN = "path string, t int, rows int, columns int, dtype string, offsets array<long>, sizes array<long>"
FRAME = "path string, t int, rows int, columns int, pixels array<double>"
#: TIFF tags and field types (fixed by the format).
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, COUNTS, KIND = 256, 257, 258, 259, 273, 279, 339
FIELD = {1: "B", 3: "H", 4: "I", 16: "Q"}


def _open(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)
    return system.open_input_file(place)


def directories(file) -> list[tuple[int, int, str, list[int], list[int]]]:
    """(rows, columns, numpy type, strip offsets, strip sizes) of every frame of a TIFF file, classic or with 64-bit places."""
    head = file.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    # letters of: the number of fields, a field's count, a place
    many, place = ("H", "I") if magic == 42 else ("Q", "Q")
    width, first = struct.calcsize("=" + place), struct.calcsize("=" + many)
    entry = 4 + 2 * width
    at, out = struct.unpack(order + place, head[4 : 4 + width] if magic == 42 else head[8:16])[0], []
    while at:
        n = struct.unpack(order + many, file.read_at(first, at))[0]
        raw = file.read_at(entry * n + width, at + first)
        tags: dict[int, list[int]] = {}
        for i in range(n):
            own = raw[entry * i : entry * (i + 1)]
            tag, kind, count = struct.unpack(order + "HH" + place, own[: 4 + width])
            if kind in FIELD:
                size = struct.calcsize("=" + FIELD[kind]) * count
                value = own[4 + width :]
                value = value[:size] if size <= width else file.read_at(size, struct.unpack(order + place, value)[0])
                tags[tag] = list(struct.unpack(order + FIELD[kind] * count, value))
        if tags.get(COMPRESSION, [1]) != [1]:
            raise ValueError("compressed TIFF files are not supported")
        letter = {1: "u", 2: "i", 3: "f"}[tags.get(KIND, [1])[0]]
        dtype = f"{order}{letter}{tags[BITS][0] // 8}"
        rows, columns = tags[HEIGHT][0], tags[WIDTH][0]
        counts = tags.get(COUNTS) or [rows * columns * np.dtype(dtype).itemsize]
        out.append((rows, columns, dtype, tags[OFFSETS], counts))
        at = struct.unpack(order + place, raw[entry * n :])[0]
    return out


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Paths of the files under ``folder``, at any depth, whose names match; in order."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return sorted(r["path"].removeprefix("file:") if r["path"].startswith("file:/") and not r["path"].startswith("file://") else r["path"] for r in d.select("path").collect())


def read_stack(spark: SparkSession, path: str | list[str], tasks: int, rows: int | None = None, columns: int | None = None, frames: int | None = None, dtype: str = "<u2") -> DataFrame:
    """Frames by what the name says: ``.tif``, ``.tiff`` or ``.btf`` files (several are one movie, in name order), else raw with the shape given."""
    paths = [path] if isinstance(path, str) else sorted(path)
    if all(p.lower().endswith((".tif", ".tiff", ".btf")) for p in paths):
        return concatenated(read_frames(tiff_plan(spark, paths), tasks))
    if None in (rows, columns, frames) or len(paths) > 1:
        raise ValueError("a raw file is read by itself, and needs rows, columns and frames")
    return read_frames(raw_plan(spark, paths[0], rows, columns, frames, dtype), tasks)


def tiff_plan(spark: SparkSession, paths: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = [{"path": path, "t": t, "rows": r, "columns": c, "dtype": d, "offsets": o, "sizes": n} for t, (r, c, d, o, n) in enumerate(directories(_open(path)))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("t", pa.int32()), ("rows", pa.int32()), ("columns", pa.int32()), ("dtype", pa.string()), ("offsets", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]))

    named = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return named.mapInArrow(run, PLAN)


def raw_plan(spark: SparkSession, path: str, rows: int, columns: int, frames: int, dtype: str = "<u2") -> DataFrame:
    """Frames of a headerless file, one behind the other."""
    size = rows * columns * np.dtype(dtype).itemsize
    return spark.range(frames).select(
        F.lit(path).alias("path"), F.col("id").cast("int").alias("t"), F.lit(rows).alias("rows"), F.lit(columns).alias("columns"), F.lit(dtype).alias("dtype"),
        F.array(F.col("id") * size).alias("offsets"), F.array(F.lit(size).cast("long")).alias("sizes"),
    )


def read_frames(plan: DataFrame, tasks: int) -> DataFrame:
    """Pixels of the planned frames, row by row, dealt to ``tasks`` tasks."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = _open(row["path"])
                raw = b"".join(file.read_at(n, at) for at, n in zip(row["offsets"], row["sizes"], strict=True))
                own = {k: [row[k]] for k in ("path", "t", "rows", "columns")}
                pixels = np.frombuffer(raw, row["dtype"], row["rows"] * row["columns"]).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(own["path"]), *(pa.array(own[k], pa.int32()) for k in ("t", "rows", "columns")), pa.array([pixels], pa.list_(pa.float64()))], ["path", "t", "rows", "columns", "pixels"])

    return plan.repartition(tasks, "path", "t").mapInArrow(run, FRAME)


def movie(frames: DataFrame) -> DataFrame:
    """Long movie ``px, r, c, t, y`` of one stack; pixels are numbered down the columns."""
    d = frames.select("t", "rows", "columns", F.posexplode_outer("pixels").alias("i", "y")).where("i is not null")
    r, c = F.floor(F.col("i") / F.col("columns")).cast("int"), (F.col("i") % F.col("columns")).cast("int")
    return d.select((r + c * F.col("rows")).cast("long").alias("px"), r.alias("r"), c.alias("c"), "t", "y")


def concatenated(frames: DataFrame) -> DataFrame:
    """Frames of several files as one movie: files in name order, each file's times behind the ones before."""
    from pyspark.sql import Window

    count = frames.groupBy("path").agg(F.max("t").alias("last"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offset = count.select("path", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).cast("int").alias("offset"))
    return frames.join(offset, "path").withColumn("t", (F.col("t") + F.col("offset")).cast("int")).drop("offset")


def packed(frames: DataFrame, side: int = 32) -> DataFrame:
    """``px, r, c, trace`` of one stack: frames are cut into tiles, and each tile's frames turned by one grouped task.

    A task holds ``side`` x ``side`` pixels of all frames. Pixels are numbered along rows.
    """

    def cut_up(batches):
        for batch in batches:
            for t, rows, columns, y in zip(*(batch.column(x).to_pylist() for x in ("t", "rows", "columns")), batch.column("pixels"), strict=True):
                image = y.values.to_numpy(zero_copy_only=False).reshape(rows, columns)
                parts = [(i, j, t, columns, image[i : i + side, j : j + side]) for i in range(0, rows, side) for j in range(0, columns, side)]
                kinds = [pa.int32()] * 4
                yield pa.RecordBatch.from_arrays([*(pa.array([p[k] for p in parts], kinds[k]) for k in range(4)), pa.array([p[4].shape[1] for p in parts], pa.int32()), pa.array([p[4].ravel() for p in parts], pa.list_(pa.float64()))], ["r0", "c0", "t", "columns", "width", "y"])

    def turn(key, table):
        r0, c0 = key[0].as_py(), key[1].as_py()
        order = np.argsort(table.column("t").to_numpy(), kind="stable")
        width, columns = table.column("width")[0].as_py(), table.column("columns")[0].as_py()
        y = table.column("y").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order]
        at = np.arange(y.shape[1])
        r, c = (r0 + at // width).astype(np.int32), (c0 + at % width).astype(np.int32)
        lists = pa.ListArray.from_arrays((np.arange(y.shape[1] + 1) * len(order)).astype(np.int32), np.ascontiguousarray(y.T).ravel())
        return pa.table({"px": r.astype(np.int64) * columns + c, "r": r, "c": c, "trace": lists})

    d = frames.select("t", "rows", "columns", "pixels").mapInArrow(cut_up, "r0 int, c0 int, t int, columns int, width int, y array<double>")
    return d.groupBy("r0", "c0").applyInArrow(turn, "px long, r int, c int, trace array<double>")
