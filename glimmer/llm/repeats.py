"""Exact repeats of fixed-width windows across a corpus, by content-chosen anchors.

Every window of a text belongs to the anchor that its own content chooses, so equal
windows have equal anchors at equal places. Neighbouring windows with one anchor
form a run. Only anchors that occur twice can hold repeats. Runs that are equal as a
whole are collapsed to their first one (its anchor's hash and that of all of it name a run, 61 bits each);
the distinct runs of an anchor, its fragments, meet in a bucket and are compared
there unit by unit. Texts that are equal as a whole (SHA-256) stand for one another
from the start, however many they are.

An anchor with more than CROWD fragments, such as the edge of a passage that a large
share of all texts has, is split by further content: its windows are halved by the
anchor's place in them, each half is named by the units that all its windows have in
common, and equal pieces are collapsed again, by their bytes. Windows with the anchor
at one place and one name are equal, so this ends; a fragment makes at most two
pieces a round.

Rows are known by ``doc_id`` and a hash of their text: repeated rows count as one,
rows with one doc_id and different texts are different documents. A null doc_id
counts as the least one.
"""

from __future__ import annotations

import functools
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, row_count, small_side
from .words import Slice, slices

KEY = ["doc_id", "tkey"]
#: What to do with a run: 8 place + REMOVE, or 8 place + OPEN (compare it), the latter + COPIED if an equal run exists.
REMOVE, OPEN, COPIED = 1, 2, 4
#: Bits of a run's place: first window above 16 bits, then 8 bits of the anchor's place in it, then 8 bits of the number of windows.
START, AHEAD = 16, 8
#: Bytes of fragments of a bucket, on average, and the fragments of an anchor from which it is split: about a third of a bucket.
BUCKET_BYTES, CROWD = 1 << 20, 2048
FRAGMENTS = "name long, doc_id long, tkey long, place long, copied boolean, bytes binary"
SPANS = "doc_id long, tkey long, starts array<long>"


class Runs(NamedTuple):
    """Runs of a slice: their row, first window (in the row), the anchor's place in that, number of windows, anchor and content hash."""

    row: np.ndarray
    start: np.ndarray
    ahead: np.ndarray
    count: np.ndarray
    name: np.ndarray
    digest: np.ndarray
    #: Place of each row's first unit (byte, word) among the slice's units.
    bounds: np.ndarray


def no_runs(bounds: np.ndarray) -> Runs:
    none = np.zeros(0, np.int64)
    return Runs(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), bounds)


class Units(Protocol):
    """What texts consist of, and how anchors are chosen."""

    width: int
    #: One more than the greatest place of an anchor in its window.
    reach: int

    def runs(self, part: Slice) -> Runs: ...

    def bounds(self, part: Slice) -> np.ndarray:
        """Place of each row's first unit among the slice's units."""

    def sequence(self, text: bytes):
        """The units of a text, to be sliced."""

    def joined(self, units) -> bytes:
        """A slice of units as bytes; equal slices give equal bytes."""

    def kept(self, text: bytes, removed: np.ndarray | None) -> bytes: ...


def run_starts(anchors: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Where among the valid windows a new run begins."""
    own = anchors[valid]
    return np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1)])) if len(own) else np.zeros(0, np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values (shorter by width - 1)."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id`` (null: the least), ``tkey`` and ``text`` (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))


def scan(docs: DataFrame, units: Units) -> DataFrame:
    """Key, unit count, digest of the whole, and the anchors and digests of the runs of each text."""
    from hashlib import sha256

    def run(batches):
        for batch in batches:
            for part in slices(batch.column("text")):
                r = units.runs(part)
                bounds = np.searchsorted(r.row, np.arange(part.n + 1)).astype(np.int32)
                raw, at = part.buf.tobytes(), part.offsets.tolist()
                sha = [sha256(units.kept(raw[a:b], None)).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                place = (r.start << START) | (r.ahead << AHEAD) | r.count
                lists = [pa.ListArray.from_arrays(bounds, x.view(np.int64)) for x in (r.name, r.digest, place)]
                ids = [batch.column(c).slice(part.first, part.n) for c in KEY]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(np.diff(r.bounds), pa.int64()), pa.array(sha), *lists], [*KEY, "n_units", "sha", "names", "digests", "places"])

    found = keyed(docs).mapInArrow(run, "doc_id long, tkey long, n_units long, sha string, names array<long>, digests array<long>, places array<long>")
    return materialize(found, "repeat-runs")


class Found(NamedTuple):
    """``texts``: every text with its group of copies; ``involved``: texts with repeats, and what to do with their runs."""

    texts: DataFrame
    involved: DataFrame


def find(docs: DataFrame, units: Units, keep_first: bool) -> Found:
    """Repeated runs of all texts. ``keep_first``: a repeat's first occurrence stays."""
    scanned = scan(docs, units)
    rows = scanned.select(*KEY, "n_units", "sha").distinct()
    copies = rows.groupBy("sha").agg(F.count("*").alias("copies"), F.min(F.struct(*KEY)).alias("first"))
    texts = materialize(rows.join(copies, "sha"), "repeat-texts")
    alone = small_side(texts.where((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.tkey") == F.col("tkey")) & (F.col("n_units") >= units.width)).select(*KEY), 24)
    runs = scanned.join(alone, KEY, "left_semi")
    again = runs.select(F.explode_outer("names").alias("name")).groupBy("name").count().where("name is not null and count > 1").select("name")
    names = materialize(again, "repeat-names")
    again = small_side(names, 16)
    runs = runs.select(*KEY, F.explode_outer(F.arrays_zip("names", "digests", "places")).alias("x")).select(*KEY, F.col("x.names").alias("name"), F.col("x.digests").alias("digest"), F.col("x.places").alias("place"))
    hits = runs.join(again, "name")
    hits = materialize(hits if row_count(scanned) == row_count(texts) else hits.distinct(), "repeat-hits")
    discard(scanned)
    discard(names)
    equal = hits.groupBy("digest", "name").agg(F.count("*").alias("copies"), F.min(F.struct(*KEY, "place")).alias("first"))
    equal = materialize(equal, "repeat-equal")
    differ = equal.groupBy("name").count().where("count > 1").select("name")
    opened = equal.join(differ, "name", "left_semi").select(F.col("first.doc_id").alias("doc_id"), F.col("first.tkey").alias("tkey"), (F.col("first.place") * 8 + OPEN + F.when(F.col("copies") > 1, COPIED).otherwise(0)).alias("act"), "name")
    removed = hits.join(equal.where("copies > 1").select("digest", "name", "first"), ["digest", "name"])
    if keep_first:
        removed = removed.where(F.struct(*KEY, "place") != F.col("first"))
    acts = opened.union(removed.select(*KEY, (F.col("place") * 8 + REMOVE).alias("act"), "name")).groupBy(*KEY).agg(F.collect_list(F.struct("act", "name")).alias("a"))
    acts = acts.select(*KEY, F.col("a.act").alias("acts"), F.filter("a", lambda x: x["act"].bitwiseAND(OPEN) > 0)["name"].alias("names"))
    acts = materialize(acts, "repeat-acts")
    discard(hits)
    discard(equal)
    involved = materialize(keyed(docs).join(acts, KEY), "repeat-involved")
    single = row_count(involved) == row_count(acts)
    discard(acts)
    return Found(texts, involved if single else involved.dropDuplicates(KEY))


def flags(batch: pa.RecordBatch, column: str, part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(row in the slice, value) of a list column's entries; null lists have none."""
    lists = batch.column(column).slice(part.first, part.n)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(part.n), sizes), lists.flatten().to_numpy(zero_copy_only=False)


def fragments(found: Found, units: Units) -> DataFrame:
    """FRAGMENTS: every run that is to be compared with others of its anchor, named by the anchor's hash."""

    def run(batches):
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in KEY]
            for part in slices(batch.column("text")):
                row, acts = flags(batch, "acts", part)
                wanted = (acts & OPEN) > 0
                row, acts, names = row[wanted], acts[wanted], flags(batch, "names", part)[1]
                raw, at, held, data = part.buf.tobytes(), part.offsets.tolist(), -1, []
                place = acts >> 3
                first, last = place >> START, (place >> START) + (place & 255) + units.width - 1
                for i, a, b in zip(row.tolist(), first.tolist(), last.tolist(), strict=True):
                    if i != held:
                        own, held = units.sequence(raw[at[i] : at[i + 1]]), i
                    data.append(units.joined(own[a:b]))
                ids = [pa.array(k[part.first + row]) for k in keys]
                copied = pa.array((acts & COPIED) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(names), *ids, pa.array(place), copied, pa.array(data, pa.binary())], ["name", *KEY, "place", "copied", "bytes"])

    return materialize(found.involved.select(*KEY, "text", "acts", "names").mapInArrow(run, FRAGMENTS), "repeat-fragments")


def halves(pieces: DataFrame, units: Units, size: int) -> DataFrame:
    """``pieces`` cut at multiples of ``size`` of the anchor's place in a window, and named by what the windows of a part have in common."""
    from hashlib import blake2b

    def run(batches):
        for batch in batches:
            rows = []
            for name, doc_id, tkey, place, copied, raw in zip(*(batch.column(c).to_pylist() for c in ("name", *KEY, "place", "copied", "bytes")), strict=True):
                own = units.sequence(raw)
                start, ahead, count = place >> START, place >> AHEAD & 255, place & 255
                for low in range((ahead - count + 1) // size * size, ahead + 1, size):
                    top = low + size - 1  # of the anchor's places in this part
                    a, b = max(0, ahead - top), min(count - 1, ahead - low)
                    core = units.joined(own[ahead - low : ahead + units.width - top])
                    new = int.from_bytes(blake2b(b"%d %d " % (name, low) + core, digest_size=8).digest(), "little", signed=True)
                    at = (start + a) << START | (ahead - a) << AHEAD | (b - a + 1)
                    rows.append((new, doc_id, tkey, at, copied, units.joined(own[a : b + units.width])))
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["name", *KEY, "place", "copied", "bytes"])

    return pieces.mapInArrow(run, FRAGMENTS)


def windows_of(pieces: DataFrame) -> DataFrame:
    """KEY and ``starts`` of all windows of ``pieces``."""
    first = F.shiftright("place", START)
    return pieces.select(*KEY, F.sequence(first, first + F.col("place").bitwiseAND(255) - 1).alias("starts"))


def compare(found: Found, units: Units, keep_first: bool, expand) -> DataFrame:
    """SPANS: the repeated windows that whole runs do not show; ``expand`` takes one bucket's fragments to SPANS."""
    open_pieces = fragments(found, units)
    size = 1 << (units.reach - 1).bit_length()
    usual, spans = [], []
    while True:
        crowded = materialize(open_pieces.groupBy("name").count().where(F.col("count") > CROWD).select("name"), "repeat-crowded")
        if not row_count(crowded):
            usual.append(open_pieces)
            break
        crowded = small_side(crowded, 8)
        usual.append(open_pieces.join(crowded, "name", "left_anti"))
        size //= 2
        cut = materialize(halves(open_pieces.join(crowded, "name", "left_semi"), units, size), "repeat-halves")
        place = F.struct(*KEY, "place")
        equal = materialize(cut.groupBy("name", "bytes").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.max("copied").alias("copied")), "repeat-pieces")
        again = cut.join(equal.where("copies > 1").select("name", "bytes", "first"), ["name", "bytes"])
        spans.append(windows_of(again.where(place != F.col("first")) if keep_first else again))
        several = equal.groupBy("name").count().where("count > 1").select("name")
        open_pieces = materialize(equal.join(several, "name", "left_semi").select("name", "first.*", (F.col("copied") | (F.col("copies") > 1)).alias("copied"), "bytes"), "repeat-open")
    pieces = functools.reduce(DataFrame.union, usual)
    total = sum(x.agg(F.sum(F.length("bytes"))).first()[0] or 0 for x in usual)
    buckets = max(1, -(-total // BUCKET_BYTES))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets))).repartition(int(min(buckets, 20_000)), "bucket")
    spans.append(dealt.groupBy("bucket").applyInArrow(expand, SPANS))
    return functools.reduce(DataFrame.union, spans).groupBy(*KEY).agg(F.flatten(F.collect_list("starts")).alias("starts"))


def spans_by_row(table: pa.Table, fragment: np.ndarray, start: np.ndarray) -> pa.Table:
    """SPANS of the windows that begin at ``start`` in the row of ``fragment`` (a row number of ``table``)."""
    keys = [table.column(c).to_numpy() for c in KEY]
    order = np.lexsort((start, keys[1][fragment], keys[0][fragment]))
    fragment, start = fragment[order], start[order]
    own = [k[fragment] for k in keys]
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(own[0]) != 0) | (np.diff(own[1]) != 0)])) if len(start) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(start)), pa.int32()), pa.array(start, pa.int64()))
    return pa.Table.from_arrays([pa.array(own[0][heads], pa.int64()), pa.array(own[1][heads], pa.int64()), lists], ["doc_id", "tkey", "starts"])


def finish(found: Found, units: Units, spans: DataFrame, keep_first: bool) -> DataFrame:
    """``doc_id, n_units, n_removed, n_spans, sha`` of every row; ``spans``: key and array ``starts`` of removed windows."""
    from hashlib import sha256

    def run(batches):
        for batch in batches:
            for part in slices(batch.column("text")):
                bounds = units.bounds(part)
                row, acts = flags(batch, "acts", part)
                whole = (acts & REMOVE) > 0
                row, place = row[whole], acts[whole] >> 3
                at, single = flags(batch, "starts", part)
                base = bounds[:-1]
                begin = np.concatenate([base[row] + (place >> START), base[at] + single]).astype(np.int64)
                end = np.concatenate([base[row] + (place >> START) + (place & 255) - 1, base[at] + single]).astype(np.int64) + units.width
                size = int(bounds[-1])
                gone = np.cumsum(np.bincount(begin, minlength=size + 1)[:size] - np.bincount(end, minlength=size + 1)[:size]) > 0
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                inner = base[base < size]
                head[inner] = gone[inner]
                removed, heads = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, head))
                removed, heads = (np.diff(x[bounds]) for x in (removed, heads))
                raw, offsets, bounds = part.buf.tobytes(), part.offsets.tolist(), bounds.tolist()
                sha = [sha256(units.kept(raw[offsets[i] : offsets[i + 1]], gone[bounds[i] : bounds[i + 1]])).hexdigest() for i in range(part.n)]
                ids = [batch.column(c).slice(part.first, part.n) for c in KEY]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(removed, pa.int64()), pa.array(heads, pa.int64()), pa.array(sha)], [*KEY, "n_removed", "n_spans", "own_sha"])

    changed = found.involved.join(spans, KEY, "left").select(*KEY, "text", "acts", "starts").mapInArrow(run, "doc_id long, tkey long, n_removed long, n_spans long, own_sha string")
    first = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.tkey") == F.col("tkey"))
    copied: Column = (F.col("n_units") >= units.width) & (~first if keep_first else F.col("copies") > 1)
    empty = F.sha2(F.lit(""), 256)
    out = found.texts.join(changed, KEY, "left")
    return out.select(
        F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id"), "n_units",
        F.when(copied, F.col("n_units")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, empty).otherwise(F.coalesce("own_sha", "sha")).alias("sha"),
    )
