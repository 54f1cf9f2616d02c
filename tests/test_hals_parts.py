"""Sweeps over whole footprints, in one task and in parts of the update order, against dense matrices."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from glimmer.operators import updates

DATA = "/root/testdata/sf0.001"


def dense_sweeps(spark, a, y, c, sweeps):
    """Gauss-Seidel in the greedy order of ranks by hash."""
    v, u, c = a.T @ a, a.T @ y, c.copy()
    keys = [r["k"] for r in spark.range(len(c)).select(F.col("id").alias("k")).orderBy(F.xxhash64("k"), "k").collect()]
    step = {}
    for k in keys:
        taken = {step[j] for j in step if v[k, j]}
        step[k] = next(s for s in range(len(keys) + 1) if s not in taken)
    for _ in range(sweeps):
        for k in sorted(keys, key=lambda k: step[k]):
            if v[k, k]:
                c[k] = np.maximum(0.0, c[k] + (u[k] - v[k] @ c) / v[k, k])
    return c


@pytest.mark.parametrize("steps, edges", [(64, 1 << 21), (1, 40)])
def test_parts_equal_one_task(spark, monkeypatch, steps, edges):
    """F2 temporal_hals: a block that no task holds is swept in parts; steps of joins over all pairs did not end."""
    rng = np.random.default_rng(4)
    a = np.where(rng.random((60, 40)) < 0.1, rng.integers(1, 9, (60, 40)), 0).astype(float)
    y, c = rng.normal(size=(60, 6)), rng.normal(size=(40, 6))
    monkeypatch.setattr(updates, "BLOCK_BYTES", 100)
    monkeypatch.setattr(updates, "PART_STEPS", steps)
    monkeypatch.setattr(updates, "ORDER_EDGES", edges)
    foot = spark.createDataFrame([(int(k), int(p), float(a[p, k])) for p, k in np.argwhere(a)] + [(50, 1, 2.0), (3, 99, 1.0)], "k long, px long, w double")
    pixels = spark.createDataFrame([(p, y[p].tolist()) for p in range(60)], "px long, trace array<double>")
    tr = spark.createDataFrame([(k, c[k].tolist()) for k in range(40)], "k long, c array<double>")
    got = {r["k"]: r["c"] for r in updates.temporal_hals(foot, pixels, tr, 2, 0.0).collect()}
    assert sorted(got) == list(range(40)) and np.allclose([got[k] for k in range(40)], dense_sweeps(spark, a, y, c, 2))


def test_the_query_takes_whole_footprints(spark):
    """F14 temporal_hals: footprints were cut to pixels of 0.8 of their maximum."""
    d = duckdb.connect()
    e = d.execute(f"select vec_id, embedding from '{DATA}/embeddings.parquet' order by 1").fetchall()
    y = np.array([x for _, x in e], float)
    assert [k for k, _ in e] == list(range(len(e)))
    a = np.zeros((len(e), len(e)))
    for k, px, w in d.execute(f"select l_suppkey, l_partkey, sum(l_quantity) from '{DATA}/lineitem.parquet' group by 1, 2").fetchall():
        if k < len(e) and px < len(e):
            a[px, k] = w
    got = {r["k"]: r["c"] for r in driver.queries()["temporal_hals"](spark, DATA).collect()}
    assert np.allclose([got[k] for k in range(len(e))], dense_sweeps(spark, a, y, y, 1), atol=2e-6)
