"""Movies and results as Parquet: pixel-major stores that patches read by range, and named result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels on a side of the squares that a store's files are laid out by.
SQUARE = 64


def save_movie(pixels: DataFrame, folder: str, files: int, overwrite: bool = False) -> None:
    """Write packed ``pixels`` so that near pixels lie together: a filter on ``r`` and ``c`` skips files by their bounds.

    An existing store is refused unless ``overwrite``.
    """
    near = [F.floor(F.col(x) / SQUARE) for x in ("r", "c")]
    d = pixels.repartitionByRange(files, *near, "r", "c").sortWithinPartitions(*near, "r", "c")
    d.write.mode("overwrite" if overwrite else "errorifexists").parquet(folder)


def load_movie(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def load_patch(spark: SparkSession, folder: str, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Pixels of one patch (bounds included); the filter reaches the scan."""
    return load_movie(spark, folder).where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))


def save_results(tables: dict[str, DataFrame], folder: str, overwrite: bool = False) -> None:
    """Each table under its name; existing ones are refused unless ``overwrite``."""
    for name, d in tables.items():
        d.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{folder}/{name}")


def load_results(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
