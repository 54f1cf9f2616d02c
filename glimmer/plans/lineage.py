"""Cutting lineage in loops through the shared checkpoint folder, and ranks over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: that of ``spark.checkpoint.dir``, or a temporary one only in local mode where the session names none."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="glimmer-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here.

    ``checkpoint`` would hand on the size that Spark estimates: that of a join is the product of its sides, so in a loop its digits,
    and the driver's time and memory for them, grow by a factor each round. Files have the size they have.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked_by(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``rank`` 1, 2, ... in ``order`` (a total one): a range-partitioned sort, and the sizes of its partitions."""
    d = cut(df.orderBy(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sizes = d.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return d.join(starts, "part").withColumn("rank", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("part", "at", "start")
