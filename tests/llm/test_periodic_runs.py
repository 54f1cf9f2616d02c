"""Periodic runs against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from glimmer.llm import periodic_runs as pr

SCHEMA = "doc_id long, text string, start long, length long, period long, runs string, n_runs int"


def smallest_period(w):
    fail = [0] * len(w)
    for i in range(1, len(w)):
        k = fail[i - 1]
        while k and w[i] != w[k]:
            k = fail[k - 1]
        fail[i] = k + (w[i] == w[k])
    return len(w) - fail[-1]


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and smallest_period(w[i : i + n]) == q:
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, cycle=True):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if cycle and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(kept))


def corpus():
    rng = np.random.default_rng(8)
    word = lambda n, k=30: list(rng.choice([f"w{i}" for i in range(k)], n))
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a b a b a b", "a b a b a b a b", "la\x0bla la\x0cla la\rla la", "é é é é é é ß", "x\x1cx " * 9]
    texts += [" ".join(word(30)) for _ in range(40)]
    texts += [" ".join(rng.choice(["a", "b"], 60)) for _ in range(30)]
    for q in (1, 2, 3, 6, 7, 12, 25):
        block = word(q)
        texts += [" ".join([*word(9), *(block * 5), *word(4)]), " ".join(block * 4), " ".join((block * 4)[:-1]), " ".join(([*block, "z"] * 4 + block) * 4)]
    texts += [" ".join(["the"] * 700 + word(50) + ["the", "of"] * 300), " ".join(word(900, 3)), "so it " * 3000]
    return [*enumerate(texts), *((i, t) for i, t in enumerate(texts[11:60], 1000)), (5, "a a a a a a"), (None, "b b b b b b"), (None, None)]


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("heavy", [2, 20, pr.HEAVY])
def test_counting_is_exact(heavy, monkeypatch):
    monkeypatch.setattr(pr, "HEAVY", heavy)
    rng = np.random.default_rng(3)
    sizes = [0, 1, 7, 40, 0, 200, 90]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ids = rng.integers(0, 5, bounds[-1])
    counts, base = pr.lag_counts(ids, bounds)
    for k, n in enumerate(sizes):
        own = ids[bounds[k] : bounds[k + 1]]
        assert counts[base[k] + 1 : base[k] + n // 4 + 1].tolist() == [int((own[q:] == own[:-q]).sum()) for q in range(1, n // 4 + 1)]


@pytest.mark.parametrize("places", [None, pr.cycled])
def test_periodic_runs(spark, places):
    data = corpus()
    frame = spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in data], SCHEMA).repartition(3)
    got = pr.periodic_runs(frame, places)
    assert rows(got.drop("runs")) == sorted((brute(i, t, places is not None) for i, t in data), key=str)
    listed = next(r for r in got.collect() if r.doc_id == 7)
    assert [tuple(x) for x in listed.runs] == brute_runs("a b a b a b a b".split())


def test_empty(spark):
    assert pr.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
