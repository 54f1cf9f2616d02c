"""Every query with an SQL twin against DuckDB on the smallest tables; the others for their invariants."""

import pytest
from conftest import DATA

from glimmer import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (p is not None and q is not None and abs(float(p) - float(q)) < 2e-5) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", ["oasis_ar1", "onnls", "nnls_spatial", "event_exceptionality", "kde_mode", "fit_patches", "oasis_ar2", "thresholded_nnls", "detrend_bspline"])
def test_rows(spark, name):
    d = QUERIES[name](spark, DATA)
    assert d.count() > 0


def test_pipeline(spark):
    got = QUERIES["fit_pipeline"](spark, DATA).toPandas()
    assert len(got) and got.k.is_unique and got.g.between(0, 1).all() and (got.members >= 1).all()


def test_patches_cover_larger_tables(spark, tmp_path):
    """60 rows of pixels: each patch of 12 by 12 starts components, not only those of the first 20 rows."""
    import numpy as np
    from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

    from glimmer.operators.patches import axis_spans

    rng = np.random.default_rng(3)
    rows = [(i, rng.random(64).tolist()) for i in range(60 * 25)]
    schema = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType()))])
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = len(axis_spans(60, 12, 4, 3)) * len(axis_spans(25, 12, 4, 3))
    assert QUERIES["greedy_init_patch"](spark, str(tmp_path)).select("patch").distinct().count() == want


@pytest.mark.parametrize("name", ["nnls_spatial", "lasso_spatial"])
def test_spatial_has_every_component_of_a_pixel(spark, duck, name):
    got = {r["px"]: r for r in QUERIES[name](spark, DATA).collect()}
    want = duck.execute("select vec_id, list(distinct l_suppkey) filter (l_suppkey in (select vec_id from embeddings)) from embeddings left join lineitem on l_partkey = vec_id group by 1").fetchall()
    assert len(got) == len(want) and max(k for r in got.values() for k in r["k"]) >= 8
    for px, k in want:
        assert got[px]["k"] == sorted(k or []) and len(got[px]["w"]) == len(got[px]["k"]) and all(w >= 0 for w in got[px]["w"])
