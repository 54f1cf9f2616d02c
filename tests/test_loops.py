"""Loops over cut tables: what the driver plans does not grow with the rounds, and rounds not with the length of a chain."""

import random

from pyspark.sql import functions as F

from glimmer.operators.graphs import merge_groups
from glimmer.plans.lineage import cut


def test_sizes_do_not_multiply(spark):
    """F1 fit_refined: a checkpoint hands on the estimated size of a join, the product of its sides; its digits tripled each round."""
    d = spark.range(4).select(F.col("id").alias("k"), F.lit(1).alias("x"))
    for _ in range(3):
        d = cut(d.join(d.select("k", F.col("x").alias("y")), "k").select("k", F.col("x") + F.col("y").alias("x")).toDF("k", "x"))
    assert d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 32
    assert [tuple(r) for r in d.orderBy("k").collect()] == [(k, 8) for k in range(4)]


def test_a_long_chain_settles(spark):
    """components along a strip of patches; a chain of 400 in random order did not settle in the 40 rounds that were allowed."""
    p = list(range(400))
    random.Random(1).shuffle(p)
    chain = [(min(x), max(x)) for x in zip(p, p[1:], strict=False)]
    edges = spark.createDataFrame([*chain, (500, 502), (502, 501), (501, 500), (600, 600)], "k1 long, k2 long")
    got = {r["k"]: r["component"] for r in merge_groups(edges).collect()}
    assert got == {k: 0 for k in range(400)} | {k: 500 for k in (500, 501, 502)}
    assert merge_groups(edges.limit(0)).collect() == []
