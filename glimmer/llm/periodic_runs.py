"""Periodic runs of words, by heavy/light lag counting.

A run of period q and length l holds l - q pairs of equal words q apart. For every
lag the pairs are counted exactly: a word that a text has often (HEAVY times) by the
autocorrelation of its places, all such words sharing one inverse Fourier transform,
a rare one by the differences of its places. Only lags with as many pairs as the
shortest run of that period needs are scanned for islands of consecutive pairs, and
an island counts if no divisor of the lag is a period of it as well (a smaller
period of a stretch of four periods has to divide the lag).

Texts are handled where they lie, nothing is shuffled; a task holds a slice of about
a megabyte, or one longer text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .tokens import distinct, ragged
from .words import IS_SPACE, Slice, runs_of, segment_hashes, slices

#: Shortest run in words and in periods.
LEAST, PERIODS = 6, 4
#: Times from which a word of a text is counted by Fourier transform.
HEAVY = 96
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"
Runs = list[tuple[int, int, int]]


def pairs_needed(lag):
    return np.maximum(LEAST - lag, (PERIODS - 1) * lag)


def lag_counts(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal words of each text at each lag up to a fourth of its length, and where each text's lag 0 stands."""
    sizes = np.diff(bounds)
    longest = sizes // PERIODS
    base = np.cumsum(longest + 1) - (longest + 1)
    counts = np.zeros(int((longest + 1).sum()), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    key = row * (int(ids.max()) + 1) + ids
    place = np.argsort(key, kind="stable")
    key = key[place]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(heads, len(key)))
    each = np.repeat(times, times)
    at = np.flatnonzero((each > 1) & (each < HEAVY))  # light: differences of the places of one word
    for step in range(1, HEAVY):
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
        lag = place[at + step] - place[at]
        near = lag <= longest[row[place[at]]]
        at, lag = at[near], lag[near]  # places grow, so what is too far stays so
        if not len(at):
            break
        counts += np.bincount(base[row[place[at]]] + lag, minlength=len(counts))
    heavy = np.flatnonzero(times >= HEAVY)
    of = row[place[heads[heavy]]]
    for text in np.unique(of).tolist():
        n, most = int(sizes[text]), int(longest[text])
        size = 1 << (n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        for k in heavy[of == text].tolist():
            mark = np.zeros(n)
            mark[place[heads[k] : heads[k] + times[k]] - bounds[text]] = 1
            f = np.fft.rfft(mark, size)
            power += f.real**2 + f.imag**2
        counts[base[text] : base[text] + most + 1] += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    return counts, base


def primes_of(q: int) -> list[int]:
    out, d = [], 2
    while d * d <= q:
        if q % d == 0:
            out.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return [*out, q] if q > 1 else out


def runs_by_text(ids: np.ndarray, bounds: np.ndarray) -> dict[int, Runs]:
    """(start, length, period) of the runs of each text that has any, sorted by start and period."""
    out: dict[int, Runs] = {}
    if not len(ids):
        return out
    counts, base = lag_counts(ids, bounds)
    text = np.repeat(np.arange(len(base)), np.diff(np.append(base, len(counts))))
    lag = np.arange(len(counts)) - base[text]
    wanted = np.flatnonzero((lag > 0) & (counts >= pairs_needed(lag)))
    wanted = wanted[np.argsort(lag[wanted], kind="stable")]
    cuts = np.flatnonzero(np.diff(lag[wanted])) + 1
    for group in np.split(wanted, cuts) if len(wanted) else []:
        q, rows = int(lag[group[0]]), text[group]
        sizes = bounds[rows + 1] - bounds[rows] - q
        index = ragged(bounds[rows], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        first, last = runs_of(ids[index] == ids[index + q], ends)
        long = last - first >= pairs_needed(q)
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            start = index[a]
            if not any((ids[start : start + q] == ids[start + d : start + d + q]).all() for d in (q // p for p in primes_of(q))):
                row = int(np.searchsorted(bounds, start, "right")) - 1
                out.setdefault(row, []).append((int(start - bounds[row]), b - a + q, q))
    return {row: sorted(found, key=lambda r: (r[0], r[2])) for row, found in out.items()}


def best_run(found: Runs) -> tuple[int, int, int]:
    """The run of the greatest length by period; ties: least start, then period."""
    best = found[0]
    for run in found[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], found: Runs) -> list[bytes]:
    """``words`` without those that a run repeats."""
    gone = np.zeros(len(words), bool)
    for start, length, period in found:
        gone[start + period : start + length] = True
    return [w for w, drop in zip(words, gone.tolist(), strict=True) if not drop]


def slice_rows(part: Slice, doc_ids: list, places: Callable | None) -> list[tuple]:
    starts, ends = runs_of(~IS_SPACE[part.buf], part.offsets)
    bounds = np.searchsorted(starts, part.offsets)
    ids = np.zeros(0, np.int64)
    if len(starts):
        ids, _ = distinct(np.stack([segment_hashes(part.buf, starts, ends, seed) for seed in (0, 1)]))
    changed = {}
    if places is not None:
        ids = ids.copy()
        for i, doc_id in enumerate(doc_ids):
            n = int(bounds[i + 1] - bounds[i])
            moved = places(doc_id, n) if n else None
            if moved is not None:
                changed[i] = moved
                ids[bounds[i] : bounds[i + 1]] = ids[bounds[i] : bounds[i + 1]][moved]
    runs, raw, at, out = runs_by_text(ids, bounds), part.buf.tobytes(), part.offsets.tolist(), []
    for i, doc_id in enumerate(doc_ids):
        words, found = raw[at[i] : at[i + 1]].split(), runs.get(i, [])  # bytes: the same six characters
        if i in changed:
            words = [words[k] for k in changed[i].tolist()]
        start, length, period = best_run(found) if found else (None, None, None)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in found).encode()
        kept = collapsed(words, found) if found else words
        milli = 1000 * length // period if found else None
        spans = [{"start": a, "length": n, "period": q} for a, n, q in found]
        out.append((doc_id, len(found), start, length, period, milli, sha256(lines).hexdigest(), sha256(b" ".join(kept)).hexdigest(), spans))
    return out


def periodic_runs(docs: DataFrame, places: Callable | None = None) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs`` of every row of ``docs (doc_id, text)``.

    ``runs`` lists all runs by start and period, the single columns hold the one of
    the greatest length by period (null without runs). ``places(doc_id, n)`` may name
    for a text of ``n`` words which of them stands at each place (null: as they are).
    Null and empty texts have no words; each row is judged by itself, repeated rows
    and null doc_ids too; other columns of ``docs`` play no part.
    """

    def run(batches):
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        types = [pa.int64()] * 6 + [pa.string()] * 2 + [run_type]
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for part in slices(batch.column("text")):
                rows = slice_rows(part, doc_ids[part.first : part.first + part.n], places)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def cycled(doc_id: int | None, n: int) -> np.ndarray | None:
    """A tenth of the documents, by the checksum of their number, repeat some of their words from some place on; a null doc_id never does."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), cycled).drop("runs")


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
