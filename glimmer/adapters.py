"""Views that read a table as a movie, as traces, or as footprints.

Packed forms are the working forms: one row a pixel (``px, r, c, trace``) or a
component (``k, c``), so per-pixel and per-trace work needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the pixel grid that vectors are laid out on.
GRID_COLUMNS = 25


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doubles(column: str):
    return F.transform(column, lambda x: x.cast("double"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "embeddings")
    return d.select(F.col("vec_id").alias("px"), F.floor(F.col("vec_id") / GRID_COLUMNS).cast("int").alias("r"), (F.col("vec_id") % GRID_COLUMNS).cast("int").alias("c"), doubles("embedding").alias("trace"))


def unpack(packed: DataFrame, *keys: str, values: str = "trace") -> DataFrame:
    """One row a sample: keys, ``t`` and ``y``.

    The outer form: for the inner one Spark first tests the array's size, and would
    compute the array twice for that.
    """
    return packed.select(*keys, F.posexplode_outer(values).alias("t", "y")).where("t is not null")


def movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack(pixels(spark, sf_dir), "px", "r", "c")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), doubles("embedding").alias("c"))


def footprints(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    """``k, px, w`` (w > 0) from order lines; ``keep`` restricts the lines (a session). Dealt by pixels: what groups by them needs no further shuffle."""
    d = read(spark, sf_dir, "lineitem")
    d = d.where(keep) if keep is not None else d
    return d.select("l_suppkey", "l_partkey", "l_quantity").repartition("l_partkey").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("px")).agg(F.sum("l_quantity").alias("w"))


MOVIE_SQL = "movie as (select vec_id as px, vec_id // 25 as r, vec_id % 25 as c, unnest(range(64)) as t, unnest(embedding)::double as y from embeddings)"
TRACE_SQL = "trace as (select vec_id as k, unnest(range(64)) as t, unnest(embedding)::double as y from embeddings)"
FOOT_SQL = "foot as (select l_suppkey as k, l_partkey as px, sum(l_quantity) as w from lineitem group by 1, 2)"
