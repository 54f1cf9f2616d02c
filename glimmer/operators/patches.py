"""Overlapping patches: geometry, pixel membership, averaging over coverage, grouped execution."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def axis_spans(length: int, size: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Inclusive spans along one axis; a last span shorter than ``least`` is merged into the one before."""
    if size <= overlap:
        raise ValueError("a patch has to be longer than its overlap")
    starts = list(range(0, max(1, length - overlap), size - overlap))
    spans = [(a, min(a + size, length) - 1) for a in starts]
    if len(spans) > 1 and spans[-1][1] - spans[-1][0] + 1 < least:
        spans[-2:] = [(spans[-2][0], length - 1)]
    return spans


def patch_grid(spark: SparkSession, rows: int, columns: int, size: int, overlap: int, least: int) -> DataFrame:
    """``patch, r0, r1, c0, c1``: one row a patch, numbered down the columns."""
    across, down = axis_spans(columns, size, overlap, least), axis_spans(rows, size, overlap, least)
    spans = [(a, b, c, d) for c, d in across for a, b in down]
    return spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "patch int, r0 int, r1 int, c0 int, c1 int")


def patch_boxes(spark: SparkSession, **axes: tuple[int, int, int, int]) -> DataFrame:
    """``patch`` and first and last place on each axis (``r0, r1, c0, ...``) of patches in a plane or a volume.

    Each axis is given by its length, size, overlap and least size (``r=(128, 32, 6, 16), c=..., z=...``); the first one varies fastest.
    """
    spans = [axis_spans(*a) for a in reversed(axes.values())]
    rows = [(i, *(x for span in reversed(box) for x in span)) for i, box in enumerate(itertools.product(*spans))]
    return spark.createDataFrame(rows, "patch int, " + ", ".join(f"{a}0 int, {a}1 int" for a in axes))


def axes_of(grid: DataFrame) -> list[str]:
    return [c[:-1] for c in grid.columns if c.endswith("0")]


def patch_pixels(grid: DataFrame) -> DataFrame:
    """``patch`` and place on every axis of every pixel of every patch, unrolled from the bounds (no range join)."""
    for a in axes_of(grid):
        grid = grid.withColumn(a, F.explode(F.sequence(f"{a}0", f"{a}1"))).drop(f"{a}0", f"{a}1")
    return grid


def coverage_mean(results: DataFrame, *axes: str) -> DataFrame:
    """Place, ``n, value``: patch results (``patch``, place, ``value``) averaged over the patches that hold a pixel; axes ``r, c`` unless named."""
    return results.groupBy(*(axes or ("r", "c"))).agg(F.count("*").alias("n"), F.avg("value").alias("value"))


def by_patch(pixels: DataFrame, grid: DataFrame, fit: Callable, schema: str) -> DataFrame:
    """``fit`` on each patch's pixels (pandas in and out): a patch, flat or of a volume, bounds what one task holds."""
    return pixels.join(patch_pixels(grid), axes_of(grid)).groupBy("patch").applyInPandas(fit, schema)
