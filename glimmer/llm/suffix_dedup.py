"""Removal of repeated byte strings by interval expansion on Burrows-Wheeler transforms.

Texts are cut by content (``repeats``): each WIDTH-byte window belongs to the least
GRAM-byte string in it, so equal windows meet under equal anchors, and runs of
windows that are equal as a whole are collapsed to one. The distinct runs of an
anchor go to one bucket; there, one transform is built over all of them, and
breadth-first backward extension from the empty string derives the common-prefix
array by increasing value: an interval of suffixes that share w is extended by each
character before it to the interval of cw, whose right bound gets the current value
if it has none yet, and is expanded again at the next value; a bound that has a
value already ends the branch. At WIDTH the expansion stops: bounds without a value
separate suffixes that share WIDTH bytes or more, so what lies between bounds with
one are the classes of equal windows. Each keeps its first occurrence.

A bucket holds a bounded number of bytes: crowded anchors are split by the bytes
around them until they fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .shared import table
from .words import Ranges, Slice

WIDTH = 100
GRAM = 40
_U = np.uint64


class ByteUnits:
    width, reach = WIDTH, WIDTH - GRAM + 1

    def runs(self, part: Slice) -> repeats.Runs:
        buf, bounds = part.buf, part.offsets
        n = len(buf)
        if n < WIDTH:
            return repeats.no_runs(bounds)
        hashed = Ranges(buf.astype(np.uint64) + _U(1))
        grams = hashed.hashes(np.arange(n + 1 - GRAM), np.arange(GRAM, n + 1))
        bits = max(20, n.bit_length())  # of the place, below the name's high bits
        value = (grams >> _U(bits) << _U(bits)) | np.arange(len(grams), dtype=np.uint64)
        anchors = (repeats.sliding_min(value, WIDTH - GRAM + 1) & _U((1 << bits) - 1)).astype(np.int64)
        sizes = np.diff(bounds)
        rows = np.flatnonzero(sizes >= WIDTH)
        windows = sizes[rows] - WIDTH + 1
        valid = np.repeat(bounds[rows] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        begin = repeats.run_starts(anchors, valid)
        count = np.diff(np.append(begin, len(valid)))
        start = valid[begin]
        row = np.searchsorted(bounds, start, "right") - 1
        end = start + count - 1 + WIDTH
        digest = hashed.hashes(start, end)
        return repeats.Runs(row, start - bounds[row], anchors[start] - start, count, grams[anchors[start]], digest, bounds)

    def bounds(self, part: Slice) -> np.ndarray:
        return part.offsets

    def sequence(self, text: bytes) -> bytes:
        return text

    def joined(self, units: bytes) -> bytes:
        return units

    def kept(self, text: bytes, removed: np.ndarray | None) -> bytes:
        return text if removed is None else np.frombuffer(text, np.uint8)[~removed].tobytes()


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order, by doubling; no two are equal, as each fragment ends in a separator of its own."""
    n, base = len(text), int(text.max()) + 2
    rank, span = text.astype(np.int64), 1
    while span < 8 and base ** (2 * span) < 2**62:  # some doublings need no sorting
        rank[:-span] = rank[:-span] * base**span + rank[span:] + 1
        rank[-span:] *= base**span
        span *= 2
    if span > 1:
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (max(n, base) + 2)
        key[:-span] += rank[span:] + 1
        order = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        span *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, least: int, alphabet: int) -> np.ndarray:
    """``lcp[i]`` of suffixes i - 1 and i in order where it is below ``least``, else ``least``.

    Characters from ``alphabet`` on are separators: all differ, and none is extended by.
    """
    n = len(text)
    before = text[order - 1]
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    step = rank[order - 1]  # place of the suffix that begins one character earlier
    lcp = np.full(n + 1, least, np.int16)
    ends = np.arange(n - int((text >= alphabet).sum()), n)  # separators come last, and share nothing
    lcp[ends + 1] = 0
    lcp[0] = 0
    low, high = np.array([0]), np.array([n])  # intervals of suffixes that share the current value
    for value in range(least):
        size = high - low
        each = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + low[each]
        c = before[at]
        inner = c < alphabet
        at, key = at[inner], each[inner] * np.int64(alphabet) + c[inner]
        if not len(at):
            break
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        new = key[1:] != key[:-1]
        low, high = step[at[np.concatenate([[True], new])]], step[at[np.concatenate([new, [True]])]] + 1
        fresh = lcp[high] == least
        low, high = low[fresh], high[fresh]
        lcp[high] = value
        if value == 0:
            low, high = np.concatenate([low, ends]), np.concatenate([high, ends + 1])
    return lcp[:n]


def repeated_windows(fragments: list[bytes], order_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, offset) of each window that an earlier one equals; ``order_key[i]`` is the place of fragment i's first byte."""
    sizes = np.array([len(f) for f in fragments])
    ends = np.cumsum(sizes + 1)
    text = np.empty(int(ends[-1]), np.int32)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = np.frombuffer(b"".join(fragments), np.uint8)
    text[ends - 1] = 256 + np.arange(len(fragments))
    order = suffix_order(text)
    lcp = common_prefixes(text, order, WIDTH, 256)
    group = np.cumsum(lcp < WIDTH) - 1
    kept = np.flatnonzero(np.bincount(group)[group] > 1)
    place = order[kept]
    fragment = np.searchsorted(ends, place, "right")
    offset = place - (ends[fragment] - sizes[fragment] - 1)
    own = order_key[fragment] + offset
    group = group[kept]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    first = np.minimum.reduceat(own, heads) if len(heads) else own
    later = own > np.repeat(first, np.diff(np.append(heads, len(group))))
    return fragment[later], offset[later]


def _expand(table: pa.Table) -> pa.Table:
    """Windows of one bucket that an earlier one equals, by document."""
    keys = [table.column(c).to_numpy() for c in repeats.KEY]
    start = table.column("place").to_numpy() >> repeats.START
    by = np.lexsort((keys[1], keys[0]))
    doc = np.empty(len(by), np.int64)
    doc[by] = np.concatenate([[0], np.cumsum((np.diff(keys[0][by]) != 0) | (np.diff(keys[1][by]) != 0))])
    fragment, offset = repeated_windows(table.column("bytes").to_pylist(), (doc << 36) + start)
    return repeats.spans_by_row(table, fragment, start[fragment] + offset)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs (doc_id, text)``.

    A byte goes if a WIDTH-byte string that covers it also starts earlier, in a
    lower doc_id or before it in the same text. Null text is empty; see ``repeats``.
    """
    units = ByteUnits()
    found = repeats.find(docs, units, keep_first=True)
    spans = repeats.compare(found, units, True, _expand)
    return repeats.finish(found, units, spans, keep_first=True).select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.col("sha").alias("kept_sha256"))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
