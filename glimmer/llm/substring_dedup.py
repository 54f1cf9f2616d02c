"""Removal of word windows that occur twice, by recompression.

Words are named by hashes, and each of ROUNDS names what stands side by side: the
first names runs of two equal words (longer runs stay as they are, since their ends
may lie outside of a window), the others name pairs, a symbol of the left class
followed by one of the right class, classes being drawn from the names themselves.
Names depend on content alone, so they are the same in every text and on every
executor without being exchanged, and equal windows get equal symbols but for EDGE
words at either end. Consecutive symbols of PHRASE words or more form the symbols of
the highest level, the phrases; those inside a window are known to be the same in
every equal window, and the one with the least name stands for it.

Spark counts the phrases of all texts: phrases found twice reveal repeats. Windows
under such a phrase are extended from it to both ends and compared, first whole runs
of windows, then word by word in buckets of bounded size (``repeats``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .shared import table
from .words import IS_SPACE, Ranges, Slice, mix, runs_of, words_of

WIDTH = 35
#: What the rounds name, and the words at a window's ends whose symbols may depend on what lies outside: 2, then 2 more, then 4 more.
ROUNDS = ("runs", "pairs", "pairs")
EDGE = 8
#: Least and greatest number of words of a phrase: one symbol of eight words may follow PHRASE - 1 others.
PHRASE, LONGEST = 5, 12
_U = np.uint64


def symbols(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, name) of the symbols after all rounds; ``first`` marks the first word of each text."""
    at, own = np.arange(len(names)), names
    for k, what in enumerate(ROUNDS):
        if len(own) < 2:
            break
        inner = ~first[at[1:]]
        if what == "runs":
            same = (own[1:] == own[:-1]) & inner
            joins = same.copy()
            joins[1:] &= ~same[:-1]
            joins[:-1] &= ~same[1:]
        else:
            left = (mix(own + _U(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) & _U(1)).astype(bool)
            joins = left[:-1] & ~left[1:] & inner
        merged = own.copy()
        merged[:-1][joins] = mix(own[:-1][joins] * _U(3) + own[1:][joins] * _U(0x9FB21C651E98DF25) + _U(k))
        keep = np.concatenate([[True], ~joins])
        at, own = at[keep], merged[keep]
    return at, own


def phrases(at: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, name) of the phrase that begins with each symbol; those that a text's end cuts are left out."""
    ends = np.append(at[1:], bounds[-1])
    last = np.searchsorted(ends, at + PHRASE)  # the symbol that completes the phrase
    inside = last < len(at)
    inside[inside] &= ends[last[inside]] <= bounds[np.searchsorted(bounds, at[inside], "right")]
    first, last = np.flatnonzero(inside), last[inside]
    return at[first], ends[last] - at[first], Ranges(own).hashes(first, last + 1)


class WordUnits:
    width, reach = WIDTH, WIDTH - EDGE - PHRASE + 1

    def runs(self, part: Slice) -> repeats.Runs:
        found = words_of(part)
        names, bounds = found.hashes, found.bounds
        n = len(names)
        if n < WIDTH:
            return repeats.no_runs(bounds)
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        at, length, name = phrases(*symbols(names, first[:n]), bounds)
        bits = 24 if n < 1 << 24 else 40  # of the place, below the name's high bits
        value = (name >> _U(bits) << _U(bits)) | at.astype(np.uint64)
        least = np.full(n - WIDTH + 1, ~_U(0))
        for size in range(PHRASE, LONGEST + 1):  # phrases of this size end inside if they begin at EDGE ... WIDTH - EDGE - size
            of = np.full(n, ~_U(0))
            of[at[length == size]] = value[length == size]
            low = repeats.sliding_min(of, WIDTH - 2 * EDGE - size + 1)
            np.minimum(least, low[EDGE : EDGE + len(least)], out=least)
        rows = np.repeat(np.arange(part.n), np.diff(bounds))
        last = bounds[1:][rows] - WIDTH  # last window of each word's row
        valid = np.flatnonzero(np.arange(n) <= last)
        if not len(valid):
            return repeats.no_runs(bounds)
        anchors = np.zeros(n, np.int64)
        anchors[: len(least)] = (least & _U((1 << bits) - 1)).astype(np.int64)
        begin = repeats.run_starts(anchors, valid)
        count = np.diff(np.append(begin, len(valid)))
        start = valid[begin]
        digest = Ranges(mix(names ^ _U(0x2545F4914F6CDD1D))).hashes(start, start + count - 1 + WIDTH)
        own = name[np.searchsorted(at, anchors[start])]
        return repeats.Runs(rows[start], start - bounds[rows[start]], anchors[start] - start, count, own, digest, bounds)

    def bounds(self, part: Slice) -> np.ndarray:
        starts, _ = runs_of(~IS_SPACE[part.buf], part.offsets)
        return np.searchsorted(starts, part.offsets)

    def sequence(self, text: bytes) -> list[bytes]:
        return text.split()  # bytes: the same six characters

    def joined(self, units: list[bytes]) -> bytes:
        return b" ".join(units)

    def kept(self, text: bytes, removed: np.ndarray | None) -> bytes:
        own = text.split()
        return b" ".join(own if removed is None else [w for w, gone in zip(own, removed.tolist(), strict=True) if not gone])


def _compare(table: pa.Table) -> pa.Table:
    """Windows of one bucket that another one equals, word by word; those of copied fragments count twice, and are gone already."""
    place = table.column("place").to_numpy()
    copied = table.column("copied").to_numpy(zero_copy_only=False)
    count = place & 255
    words = b" ".join(table.column("bytes").to_pylist()).split(b" ")
    ids = pd.factorize(np.array(words, object))[0].astype(np.int32)
    begin = np.cumsum(count + WIDTH - 1) - (count + WIDTH - 1)
    fragment = np.repeat(np.arange(len(place)), count)
    offset = np.arange(len(fragment)) - np.repeat(np.cumsum(count) - count, count)
    rows = np.lib.stride_tricks.sliding_window_view(ids, WIDTH)[begin[fragment] + offset]
    order = np.lexsort(rows.T)
    other = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    group = np.empty(len(order), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(other)])
    weight = np.bincount(group, 1 + copied[fragment])
    gone = np.flatnonzero((weight[group] > 1) & ~copied[fragment])
    return repeats.spans_by_row(table, fragment[gone], (place >> repeats.START)[fragment[gone]] + offset[gone])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, n_spans, kept_sha256`` of every row of ``docs (doc_id, text)``.

    A word goes if a window of WIDTH words that covers it occurs anywhere else, in
    the same text or another. Null text has no words; see ``repeats`` for keys.
    """
    units = WordUnits()
    found = repeats.find(docs, units, keep_first=False)
    spans = repeats.compare(found, units, False, _compare)
    return repeats.finish(found, units, spans, keep_first=False).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "n_spans", F.col("sha").alias("kept_sha256"))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
