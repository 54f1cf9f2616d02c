"""Ordinal regression on graded ratings with hashed words.

Cumulative link: P(grade >= j) = sigmoid(w . x - t_j) with one weight vector for all
grades and ordered thresholds t_1 < t_2 < ..., so the tail probabilities of a text
are ordered too. x holds one entry for each distinct word (lower case) of the whole
text, hashed to BUCKETS, and for each of a few bins of its length and variety. The
model is fitted in one task on a sample of at most SAMPLE labelled rows, the least
by a hash of doc_id; every row is scored where it lies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, table
from .words import mix, slices, words_of

BUCKETS = 1 << 22
#: Bound of the labelled sample.
SAMPLE = 20_000
EPOCHS, RATE, DECAY, BATCH = 12, 0.15, 1e-6, 256
#: Steps at least, for small samples.
STEPS = 600


def features(texts: pa.Array):
    """(first row, bounds, buckets) of each slice: the sorted distinct buckets of each row."""
    for part in slices(texts):
        found = words_of(part, lower=True)
        rows = np.repeat(np.arange(part.n), np.diff(found.bounds))
        n_words = np.diff(found.bounds)
        keys = np.unique((rows.astype(np.uint64) << np.uint64(22)) | (found.hashes & np.uint64(BUCKETS - 1)))
        distinct = np.bincount((keys >> np.uint64(22)).astype(np.int64), minlength=part.n)
        size = np.log2(n_words + 1).astype(np.int64)
        variety = (10 * distinct / np.maximum(n_words, 1)).astype(np.int64)
        extra = [mix(np.uint64(k << 32) + v.astype(np.uint64)) & np.uint64(BUCKETS - 1) for k, v in ((1, size), (2, variety))]
        own = np.arange(part.n, dtype=np.uint64) << np.uint64(22)
        keys = np.unique(np.concatenate([keys, *(own | x for x in extra)]))
        bounds = np.searchsorted(keys, np.arange(part.n + 1, dtype=np.uint64) << np.uint64(22))
        yield part.first, bounds, (keys & np.uint64(BUCKETS - 1)).astype(np.int32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, their weights, thresholds) by adaptive gradient steps; thresholds are a start and positive gaps."""
    seen, flat = np.unique(np.concatenate(rows), return_inverse=True) if rows else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    above = np.array([(grades >= j).mean() for j in range(1, n_grades)]).clip(1e-3, 1 - 1e-3)
    t = np.maximum.accumulate(-np.log(above / (1 - above)))
    gaps = np.log(np.maximum(np.diff(t), 0.05))
    start = float(t[0])
    w, g2, s2, d2 = np.zeros(len(seen)), np.full(len(seen), 1e-6), 1e-6, np.full(len(gaps), 1e-6)
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(1, len(rows)))) if rows else 0):
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            own = shuffled[at : at + BATCH]
            lengths = np.diff(bounds)[own]
            index = np.concatenate([flat[bounds[i] : bounds[i + 1]] for i in own])
            sample = np.repeat(np.arange(len(own)), lengths)
            score = np.bincount(sample, w[index], len(own))
            t = start + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            q = np.concatenate([np.ones((len(own), 1)), sigmoid(score[:, None] - t), np.zeros((len(own), 1))], axis=1)
            y = grades[own]
            r = np.arange(len(own))
            p = np.maximum(q[r, y] - q[r, y + 1], 1e-9)
            slope = q * (1 - q)
            up, down = slope[r, y] / p, slope[r, y + 1] / p  # d log p / d score is up - down
            dscore = (up - down) / len(own)
            dt = np.zeros(n_grades + 1)
            np.add.at(dt, y, -up / len(own))
            np.add.at(dt, y + 1, down / len(own))
            dt = dt[1:n_grades]
            grad = np.bincount(index, dscore[sample], len(seen)) - DECAY * w
            g2 += grad * grad
            w += RATE * grad / np.sqrt(g2)
            dstart, dgaps = dt.sum(), np.cumsum(dt[::-1])[::-1][1:] * np.exp(gaps)
            s2 += dstart * dstart
            d2 += dgaps * dgaps
            start += 0.05 * dstart / np.sqrt(s2)
            gaps = gaps + 0.05 * dgaps / np.sqrt(d2)
    return seen, w.astype(np.float32), start + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, grades: DataFrame, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights of all buckets, thresholds) from ``grades (doc_id, grade)``, at most SAMPLE rows of it.

    Repeated labels count once, by their least grade; without any, weights are zero.
    """
    sample = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    sample = materialize(sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "grade-sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "grade")  # at most SAMPLE rows of 16 bytes

    def hashed(batches):
        for batch in batches:
            rows: list = []
            for _, bounds, buckets in features(batch.column("text")):
                rows += [buckets[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), batch.column("grade").cast(pa.int32())], ["buckets", "grade"])

    def train(table: pa.Table) -> pa.Table:
        raw, y = table.column("buckets").to_pylist(), table.column("grade").to_numpy()
        order = sorted(range(len(raw)), key=lambda i: (raw[i], y[i]))  # the same model whatever the rows' order
        seen, w, t = fit_ordinal([np.frombuffer(raw[i], np.int32) for i in order], y[order].astype(np.int64), n_grades)
        return pa.table({"seen": [seen.astype(np.int32).tobytes()], "w": [w.tobytes()], "t": [t.tolist()]})

    rows = texts.mapInArrow(hashed, "buckets binary, grade int").withColumn("all", F.lit(True)).groupBy("all").applyInArrow(train, "seen binary, w binary, t array<double>").collect()
    weights = np.zeros(BUCKETS, np.float32)
    if not rows:
        return weights, np.arange(n_grades - 1, dtype=float)
    weights[np.frombuffer(rows[0]["seen"], np.int32)] = np.frombuffer(rows[0]["w"], np.float32)
    return weights, np.array(rows[0]["t"])


def score(docs: DataFrame, weights: np.ndarray, thresholds: np.ndarray) -> DataFrame:
    """``doc_id, expected_grade, tails`` of every row; ``tails[j]`` is P(grade >= j + 1). Null text is empty."""
    model = docs.sparkSession.sparkContext.broadcast((weights, thresholds))  # BUCKETS floats, whatever the corpus

    def run(batches):
        w, t = model.value
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for first, bounds, buckets in features(batch.column("text")):
                sums = np.concatenate([[0.0], np.cumsum(w[buckets], dtype=float)])
                total[first : first + len(bounds) - 1] = sums[bounds[1:]] - sums[bounds[:-1]]
            tails = sigmoid(total[:, None] - t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tails.sum(axis=1)), pa.ListArray.from_arrays(np.arange(0, tails.size + 1, len(t), dtype=np.int32), tails.ravel())], ["doc_id", "expected_grade", "tails"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_grade double, tails array<double>")


def graded(labels: DataFrame) -> DataFrame:
    """Three grades of the labels: 0 toxic, 1 of low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, *fit(docs, graded(table(spark, sf_dir, "labels")), 3))
    return scored.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round(F.col("tails")[0], 6).alias("p_not_toxic"), F.round(F.col("tails")[1], 6).alias("p_good"), (F.col("tails")[1] >= 0.5).alias("kept"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
