"""Shared folder, intermediate tables and connected components.

Intermediate results go to the folder in ``spark.checkpoint.dir``, which every
executor and the driver can read, so a lost executor never takes them along.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many bytes; larger sides are joined by shuffle.
BROADCAST_BYTES = 32 << 20
_rows: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a local temporary one only in local mode where none is set."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="glimmer-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/glimmer/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here. Its rows are counted on the way."""
    spark, schema = df.sparkSession, df.schema
    path, seen = new_path(spark, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    n = seen.get.get("n")
    if n is not None:
        _rows[out] = n
    _paths[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that only tables read which are written themselves by now."""
    if df in _paths:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_count(df: DataFrame) -> int:
    """Rows of a materialised table, known from its writing."""
    return _rows[df] if df in _rows else df.count()


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the counted rows fit ``limit``, else leave a shuffle join.

    ``df`` has to be a materialised table, as its rows are counted.
    """
    return F.broadcast(df) if row_count(df) * row_bytes <= limit else df


def union_sides(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def contents(pairs: DataFrame) -> tuple:
    """Count and two independent sums that tell whether two sets of pairs are the same."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a", F.lit(1)).cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; component is the least node reachable.

    Alternates large-star and small-star rounds (each a grouped minimum, so hubs
    are pre-aggregated), written to the shared folder after every pair of rounds.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = contents(now)
    for _ in range(max_rounds):
        both = union_sides(now)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour points to the least of the neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: smaller neighbours and the node itself point to the least one
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = materialize(small, "small-star")
        now, before, seen = small, seen, contents(small)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
