"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

Every run of 20 or more characters of ``[A-Za-z0-9+/_-]``, with the ``=`` that pad its
end, is a candidate, less what a pattern covers. Its encoding is the smallest of digits, hexadecimal, base 32, lower
case with digits, base 62 and base 64 that has all its characters. Against that
alphabet stand the tests of the battery: chi-squared uniformity of its characters, runs
above and below its middle and of one kind of character, and serial correlation.
What they give is simulated for each encoding and length, for random strings and for
words and numbers in that encoding. A candidate that is farther from the random
strings' mean than nearly all of them is rejected; its p-value is the share of
simulated text that is as far in the direction of random strings (by the linear
discriminant of the two). These p-values are counted over all documents by length
class, and in each class the Benjamini-Hochberg threshold keeps the expected share
of false finds under RATE, so short strings need stronger evidence.
"""

from __future__ import annotations

import functools
import itertools
import math
import re

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, table
from .words import runs_of, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/=_-]))?")
KINDS = ["assign", "access", "hex", "random"]
#: What a text has to hold (in lower case) for a pattern to be worth a try.
_HINTS = [b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey", b"akia"]
LEAST = 20
ALPHABETS = ["0123456789", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz"]
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS += [_UP + _LOW + "0123456789", _UP + _LOW + "0123456789+/", _UP + _LOW + "0123456789-_", _UP + _LOW + "0123456789+/-_"]
_PLACE = [{c: i for i, c in enumerate(a)} for a in ALPHABETS]
_KIND = [np.array([c.isdigit() + 2 * c.islower() + 3 * c.isupper() for c in a]) for a in ALPHABETS]
#: Least share of random strings that are as far off; false-discovery rate.
BATTERY, RATE = 0.01, 0.01
#: Simulated characters of each kind, and strings at least.
SIMULATED, STRINGS = 80_000, 500
#: Lengths that are simulated: a candidate between two takes the lower one.
SIZES = [20, 24, 28, 32, 36, 40, 48, 64, 96, 128, 256]
# Shares (per cent) of a ... z in English text.
LETTERS = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074]
#: Chance that a word or number of simulated text ends after a character.
TURN = 0.16
#: Length classes begin here; p-values are counted in bins of a tenth of a power of ten, up to 10**-30.
LENGTHS = [20, 28, 40, 64]
BINS = 301
_CODED = np.zeros(256, bool)
_CODED[[ord(c) for c in ALPHABETS[-1] + "="]] = True
SPAN = "struct<start:int,kind:int,end:int>"
FOUND = "doc_id long, base array<struct<start:int,kind:int,end:int>>, others array<struct<start:int,kind:int,end:int,bin:int,random:boolean>>"


def statistics(at: np.ndarray, which: int) -> np.ndarray:
    """The battery's four statistics of each row of ``at``, places in alphabet ``which``.

    Chi-squared over the alphabet, runs above and below its middle, runs of one kind
    of character (upper case, lower case, digits, others), and serial correlation.
    """
    (rows, n), size = at.shape, len(ALPHABETS[which])
    counts = np.bincount((np.arange(rows)[:, None] * size + at).ravel(), minlength=rows * size).reshape(rows, size).astype(float)
    chi = np.log((counts**2).sum(axis=1) * size / n**2)  # of 1 + chi-squared / n
    high, kind = at >= size // 2, _KIND[which][at]
    own = at - at.mean(axis=1, keepdims=True)
    power = (own**2).sum(axis=1)
    serial = np.where(power > 0, (own[:, 1:] * own[:, :-1]).sum(axis=1) / np.maximum(power, 1e-9), 1.0)
    return np.stack([chi, (high[:, 1:] != high[:, :-1]).sum(axis=1), (kind[:, 1:] != kind[:, :-1]).sum(axis=1), serial], axis=1)


def text_like(rng: np.random.Generator, alphabet: str, n: int) -> np.ndarray:
    """Rows of ``n`` places: words by LETTERS and numbers with first digits by Benford's law, in turns, as far as the alphabet has them.

    In alphabets with both cases a word begins with a capital.
    """
    place = {c: i for i, c in enumerate(alphabet)}
    shape = (max(STRINGS, SIMULATED // n), n)
    has = [set(alphabet) >= set(x) for x in ("0123456789", "abcdef", "ABCDEF")]
    letters = [c for c in (_LOW if has[1] else _UP) if c in place]
    weight = np.array([LETTERS[ord(c.lower()) - 97] for c in letters])
    begins = rng.random(shape) < TURN
    begins[:, 0] = True
    if letters:
        out = np.array([place[c] for c in letters])[rng.choice(len(letters), shape, p=weight / weight.sum())]
        if has[1] and "Z" in place:
            out = np.where(begins, np.array([place[alphabet[i].upper()] if alphabet[i] in _LOW else i for i in range(len(alphabet))])[out], out)
    if has[0]:
        benford = np.log10(1 + 1 / np.arange(1, 10))
        digits = np.array([place[c] for c in "0123456789"])
        first = digits[1 + rng.choice(9, shape, p=benford)]
        numbers = np.where(begins | (rng.random(shape) < 0.7), first, digits[0])  # and zeros, as in dates and round numbers
        if not letters:
            return numbers
        # words and numbers in turns; numbers are as frequent as words only where few letters are left
        kind = np.maximum.accumulate(np.where(begins, np.arange(n), 0), axis=1)
        chance = 0.5 if len(letters) < 10 else 0.2
        number = np.take_along_axis(rng.random(shape) < chance, kind, axis=1)
        out = np.where(number, numbers, out)
    return out


class Null(NamedTuple):
    """What simulated strings of one encoding and length show."""

    mean: np.ndarray  # of random strings' statistics
    inverse: np.ndarray  # of their covariance
    distances: np.ndarray  # of random strings, sorted
    direction: np.ndarray  # that tells random strings from text best
    scores: np.ndarray  # of text in that direction, sorted


@functools.lru_cache(maxsize=None)
def simulated(which: int, n: int) -> Null:
    rng = np.random.Generator(np.random.PCG64(which * 1000 + n))
    random = statistics(rng.integers(0, len(ALPHABETS[which]), (max(STRINGS, SIMULATED // n), n)), which)
    text = statistics(text_like(rng, ALPHABETS[which], n), which)
    mean = random.mean(axis=0)
    inverse = np.linalg.pinv(np.cov(random.T))
    direction = np.linalg.pinv(np.cov(random.T) + np.cov(text.T)) @ (mean - text.mean(axis=0))
    distances = np.sort(np.einsum("ij,jk,ik->i", random - mean, inverse, random - mean))
    return Null(mean, inverse, distances, direction, np.sort(text @ direction))


def battery(text: str) -> tuple[float, float]:
    """(p-value of randomness in the inferred encoding, p-value of being text).

    Beyond the simulated text the second one follows a normal tail.
    """
    text = text.rstrip("=") or text
    which = next((i for i, p in enumerate(_PLACE) if all(c in p for c in text)), None)
    if which is None or len(text) < LEAST:
        return 0.0, 1.0
    n = max(x for x in SIZES if x <= len(text))
    null = simulated(which, n)
    at = np.array([[_PLACE[which][c] for c in text]])
    # a longer text than the simulated ones: the mean over its parts of that length, which cover all of it
    cuts = sorted({*range(0, len(text) - n + 1, n), len(text) - n})
    own = statistics(np.concatenate([at[:, i : i + n] for i in cuts]), which).mean(axis=0)
    score, off = float(own @ null.direction), own - null.mean
    above = int((null.scores >= score).sum())
    p = (above + 1) / (len(null.scores) + 1)
    if not above:
        p = min(p, 0.5 * math.erfc((score - float(null.scores.mean())) / float(null.scores.std()) / math.sqrt(2)))
    return float((null.distances >= off @ null.inverse @ off).mean()), p


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out)


def other_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """(start, kind, end, bin, random) of the candidates outside the patterns' matches."""
    out, i = [], 0
    for m in CANDIDATE.finditer(text):
        while i < len(base) and base[i][2] <= m.start():  # spans of one kind never overlap, and three kinds at most are open
            i += 1
        pieces, at = [], m.start()
        for a, _, b in itertools.takewhile(lambda x: x[0] < m.end(), itertools.islice(base, i, None)):
            if b > m.start():
                pieces.append((at, a))
                at = max(at, b)
        for a, b in [*pieces, (at, m.end())]:
            if b - a < LEAST:
                continue
            uniform, like_text = battery(text[a:b])
            length = sum(b - a >= x for x in LENGTHS) - 1
            strength = min(BINS - 1, int(-10 * math.log10(max(like_text, 1e-300))))
            out.append((a, 3, b, length * BINS + strength, uniform >= BATTERY))
    return out


def _suspects(part) -> np.ndarray:
    """Rows of a slice that hold a hint or a long enough run: the others match nothing."""
    raw = part.buf.tobytes().lower()
    at = []
    for hint in _HINTS:
        i = raw.find(hint)
        while i >= 0:
            at.append(i)
            i = raw.find(hint, i + 1)
    first, last = runs_of(_CODED[part.buf], part.offsets)
    at = np.concatenate([np.array(at, np.int64), first[last - first >= LEAST]])
    return np.unique(np.searchsorted(part.offsets, at, "right") - 1)


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, others``: pattern matches and tested candidates of every row (null text: none).

    Repeated rows and doc_ids stay, each judged by itself; an empty table gives none.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            base: list = [[] for _ in range(len(texts))]
            others: list = [[] for _ in range(len(texts))]
            for part in slices(texts):
                for r in _suspects(part).tolist():
                    text = part.buf[part.offsets[r] : part.offsets[r + 1]].tobytes().decode("utf-8")
                    own = base_spans(text)
                    base[part.first + r] = [dict(zip(("start", "kind", "end"), x, strict=True)) for x in own]
                    others[part.first + r] = [dict(zip(("start", "kind", "end", "bin", "random"), x, strict=True)) for x in other_spans(text, own)]
            i32 = pa.int32()
            span = [("start", i32), ("kind", i32), ("end", i32)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(base, pa.list_(pa.struct(span))), pa.array(others, pa.list_(pa.struct([*span, ("bin", i32), ("random", pa.bool_())])))],
                ["doc_id", "base", "others"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def accepted_bins(found: DataFrame) -> list[int]:
    """Bins under the Benjamini-Hochberg threshold of their length class, from counts over all rows."""
    counts = {r["bin"]: r["n"] for r in found.select(F.explode("others.bin").alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).collect()}
    out = []
    for length in range(len(LENGTHS)):
        total = sum(n for b, n in counts.items() if b // BINS == length)
        so_far, least = 0, None
        for strength in reversed(range(BINS)):
            so_far += counts.get(length * BINS + strength, 0)
            if so_far and 10 ** (-strength / 10) * total <= RATE * so_far:
                least = strength
        if least is not None:
            out += range(length * BINS + least, (length + 1) * BINS)
    return out


def secrets(found: DataFrame, bins: list[int]) -> DataFrame:
    """``found`` with ``spans``: base spans and accepted random strings, by start and kind; rows stay as they are."""
    added = F.filter("others", lambda x: x["random"] & (x["bin"].isin(bins) if bins else F.lit(False)))
    added = F.transform(added, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return found.withColumn("spans", F.array_sort(F.concat("base", added)))


def digest(spans: str):
    """``kind:start:end`` of an array of spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret's span replaced by ``mark``, and ``n_chars`` where there counted anew.

    Rows without a secret stay as they are; null text stays null.
    """
    bins = set(accepted_bins(materialize(find_spans(docs), "secret-spans")))
    schema = docs.schema

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            new = texts.to_pylist()
            changed = False
            for part in slices(texts):
                for r in _suspects(part).tolist():
                    text = new[part.first + r]
                    base = base_spans(text)
                    spans = sorted([*base, *(x[:3] for x in other_spans(text, base) if x[4] and x[3] in bins)])
                    out, at = [], 0
                    for a, _, b in spans:
                        if b > at:
                            out += [text[at:a], mark] if a >= at else []
                            at = b
                    if spans:
                        new[part.first + r], changed = "".join(out) + text[at:], True
            if not changed:
                yield batch
                continue
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["text"] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_pydict(columns, schema=batch.schema)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = materialize(find_spans(table(spark, sf_dir, "documents")), "secret-spans")
    d = secrets(found, accepted_bins(found))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return d.select("doc_id", *(count(k) for k in range(3)), F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans"))


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE_SQL: dict[str, str] = {}
