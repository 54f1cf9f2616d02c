"""Orders of updates of dense overlaps: no round a link of the longest chain."""

import numpy as np
from pyspark.sql import functions as F

from glimmer.operators import updates


def test_dense_overlaps_are_put_in_order(spark):
    """F4 update_order, F3, F8: 300 components that all overlap need 300 steps; before, more rounds than were allowed."""
    d = spark.range(300).select(F.col("id").alias("k"))
    pairs = d.select(F.col("k").alias("k1")).crossJoin(d.select(F.col("k").alias("k2"))).where("k1 <> k2")
    for edges in (updates.ORDER_EDGES, 5000):  # in one range, and in three
        got = [r["step"] for r in updates.update_order(pairs, d, edges).orderBy(F.xxhash64("k"), "k").collect()]
        assert got == list(range(300))


def test_ranges_give_the_greedy_order(spark):
    rng = np.random.default_rng(2)
    near = np.triu(rng.random((120, 120)) < 0.2, 1)
    near |= near.T
    d = spark.range(121).select(F.col("id").alias("k"))
    pairs = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True)], "k1 long, k2 long")
    step = {}
    for k in [r["k"] for r in d.orderBy(F.xxhash64("k"), "k").collect()]:
        taken = {step[j] for j in step if k < 120 and j < 120 and near[k, j]}
        step[k] = next(s for s in range(122) if s not in taken)
    for edges in (1 << 20, 200):
        assert {r["k"]: r["step"] for r in updates.update_order(pairs, d, edges).collect()} == step
