"""Collocations against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import re
from collections import Counter, defaultdict

import numpy as np

from glimmer.llm import collocations

SCHEMA = "lang string, text string, w1 long, word string, n long, a long, score long, rank long"


def brute(rows):
    words, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            own = [w for w in re.split("[\x20\x09]+", piece) if w]
            words[lang] += len(own)
            for k in range(1, 5):
                for i in range(len(own) - k + 1):
                    f[lang, tuple(own[i : i + k])] += 1
    often = {key: n for key, n in f.items() if n >= collocations.LEAST}
    out = defaultdict(list)
    for (lang, w), a in often.items():
        if len(w) < 2:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        longer = [n for (other, v), n in often.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * n >= 80 * a for n in longer):
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, rank, p.decode(), -a, l, r, words[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[: collocations.TOP], 1)}


def corpus():
    rng = np.random.default_rng(5)
    names = ["the", "of", "New", "York", "city", "hall", "é", "ß", "x" * 90, "a-b"]
    rows = []
    for lang in ("en", "de", None, ""):
        for _ in range(60):
            rows.append((lang, "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b"], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]) for w in rng.choice(names, 60))))
    rows += [("en", "New york city hall ") for _ in range(35)] + [("und", "the of the of the of")] * 20
    return rows + [("en", None), ("en", ""), (None, None), ("fr", " \t\n"), ("it", "one two"), ("de", "so it goes " * 20_000)]


def test_collocations(spark):
    rows = corpus()
    frame = spark.createDataFrame([(a, b, 1, "x", 2, 3, 4, 5) for a, b in rows], SCHEMA).repartition(5)
    got = collocations.collocations(frame).collect()
    assert {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_top_and_parts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TOP", 7)
    monkeypatch.setattr(collocations, "PARTS", 2)
    monkeypatch.setattr(collocations, "HELD", 50)
    rows = corpus()[:200]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(2)).collect()
    assert {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == brute(rows)


def test_counts_beyond_64_bits(spark):
    big = 10**18
    level = lambda rows, k: spark.createDataFrame(rows, "lang string, " + ", ".join(f"w{i} long" for i in range(1, k + 1)) + ", n long")
    levels = [level([("x", 1, big), ("x", 2, big + 8)], 1), level([("x", 1, 2, big - 3)], 2), level([], 3), level([], 4)]
    row = collocations.scored(levels).collect()[0]
    assert row.score == 2_000_000 * (big - 3) // (2 * big + 8)


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(frame).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []


def test_last_pass_emits_no_row_a_phrase_and_partition(spark):
    """Rows before the shuffle: phrases times twice the cores at most, in however many parts the input comes."""
    frame = spark.createDataFrame([("x", "a b c d e")] * 80, "lang string, text string").repartition(40)
    known = [collocations.vocabulary(frame, 0).select("lang", "w1", "n")]
    for k in (2, 3):
        known.append(collocations.phrases(frame, k, 0, known[-1]))
    emitted = collocations.partial_counts(frame, 4, 0, known[-1])
    assert emitted.count() <= 2 * 2 * spark.sparkContext.defaultParallelism
    assert sorted(r["n"] for r in emitted.groupBy("w1", "w2", "w3", "w4").agg({"n": "sum"}).toDF("w1", "w2", "w3", "w4", "n").collect()) == [80, 80]
