"""Phrase collocations by Apriori passes.

Pass k counts phrases of k words, and emits a phrase only if both phrases of k - 1
words in it are frequent; a phrase that is frequent itself always is, so counts lose
nothing. What is known of the pass before goes to the tasks as a bitmap of fixed
size, FILTER_BITS bits over hashes of the frequent phrases: a false hit costs a row
that the exact count drops again. Tasks add up what they emit before the shuffle.
The last pass meets so few phrases that a task holds the sums of any amount of text;
it runs in a fixed number of tasks a core, as otherwise the rows that it emits would
be those phrases times the tasks, and both grow with the input.

Words travel as 64-bit hashes. Pass 1 shuffles the words themselves with their
hashes, so it sees whether two words of a language share one, and then takes the
next of SEEDS hashes; phrases are counted by the hashes of all their words, so counts
are exact. Cuts are scored from the tables of the passes, and only phrases that can
still be among the first TOP are written out as words again.
"""

from __future__ import annotations

import functools
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, small_side, table
from .words import LOWER, Slice, mix, runs_of, segment_hashes, slices

#: Least count of a phrase, most words of one, phrases reported a language, and percentage of its count at which a longer candidate stands for it.
LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
FILTER_BITS = 1 << 27
#: Hashes to try, and parts of a language that are ranked on their own first.
SEEDS, PARTS = 8, 128
#: Rows that a task holds before it adds them up, and tasks a core of the last pass, at most.
HELD, LAST_TASKS = 500_000, 2
_U = np.uint64
_CUT = np.zeros(256, bool)
_CUT[[10, 11, 12, 13, *b".,;:!?"]] = True
_BETWEEN = _CUT.copy()
_BETWEEN[[9, 32]] = True


def piece_words(part: Slice, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end, row and piece (a number that grows) of each word; A-Z count as a-z."""
    buf = LOWER[part.buf]
    starts, ends = runs_of(~_BETWEEN[buf], part.offsets)
    row = np.searchsorted(part.offsets, starts, "right") - 1
    return segment_hashes(buf, starts, ends, seed), starts, ends, row, np.cumsum(_CUT[buf])[starts] + row


def slots(language: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Bit of the filter for each phrase."""
    out = language
    for w in words:
        out = mix(out * _U(0xD6E8FEB86659FD93) + w)
    return out % _U(FILTER_BITS)


def language_hash(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


def added_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct columns of ``keys``, the sums of ``n``, and where one of them stands; a column may come twice if hashes of columns collide."""
    if not len(n):
        return keys, n, n
    order = np.argsort(functools.reduce(lambda h, c: mix(h * _U(0xD6E8FEB86659FD93) + c), keys))
    new = np.zeros(len(n), bool)
    new[0] = True
    for column in keys:  # one at a time: no sorted copy of all
        column = column[order]
        new[1:] |= column[1:] != column[:-1]
    heads = np.flatnonzero(new)
    first = order[heads]
    return keys[:, first], np.add.reduceat(n[order], heads), first


class Languages:
    """Numbers of the languages that a task meets."""

    def __init__(self):
        self.names: list[str] = []
        self.hashes = np.zeros(0, np.uint64)

    def codes(self, column: pa.Array) -> np.ndarray:
        d = column.dictionary_encode()
        own = []
        for name in d.dictionary.to_pylist():
            if name not in self.names:
                self.names.append(name)
                self.hashes = np.append(self.hashes, _U(language_hash(name)))
            own.append(self.names.index(name))
        return np.array(own, np.uint64)[d.indices.to_numpy(zero_copy_only=False)]

    def column(self, codes: np.ndarray) -> pa.Array:
        return pa.array(self.names, pa.string()).take(pa.array(codes.astype(np.int64)))


def by_language(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """``lang, w1, word, n`` of every word."""

    def run(batches):
        languages = Languages()
        for batch in batches:
            codes = languages.codes(batch.column("lang"))
            for part in slices(batch.column("text")):
                w, starts, ends, row, _ = piece_words(part, seed)
                if not len(w):
                    continue
                buf = LOWER[part.buf]
                other = segment_hashes(buf, starts, ends, seed + SEEDS)  # so that words of one hash stay apart
                keys, n, first = added_up(np.stack([codes[part.first + row], w, other]), np.ones(len(w), np.int64))
                raw = buf.tobytes()
                texts = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([languages.column(keys[0]), pa.array(keys[1].view(np.int64)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n)], ["lang", "w1", "word", "n"])

    found = by_language(docs).mapInArrow(run, "lang string, w1 long, word string, n long")
    return materialize(found.groupBy("lang", "w1", "word").agg(F.sum("n").alias("n")), "collocation-words")


def frequent_filter(level: DataFrame, k: int) -> np.ndarray:
    """Bytes of the bitmap of all phrases of ``level``; its parts are put together by Spark and bounded by FILTER_BITS."""

    def run(batches):
        for batch in batches:
            d = batch.column("lang").dictionary_encode()
            own = np.array([language_hash(x) for x in d.dictionary.to_pylist()], np.uint64)[d.indices.to_numpy(zero_copy_only=False)]
            words = [batch.column(f"w{i}").to_numpy().view(np.uint64) for i in range(1, k + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(slots(own, words).astype(np.int64) + 1)], ["slot"])

    found = level.mapInArrow(run, "slot long").groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in found.toLocalIterator():  # FILTER_BITS / 32768 rows at most
        out[(r["bucket"] - 1) * len(r["bits"]) : r["bucket"] * len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def partial_counts(docs: DataFrame, k: int, seed: int, known: DataFrame) -> DataFrame:
    """``lang, w1, ..., wk, n`` as the tasks add them up: phrases of ``k`` words with both inner phrases in ``known``, or by a false hit."""
    context = docs.sparkSession.sparkContext
    bits = context.broadcast(frequent_filter(known, k - 1))
    names = [f"w{i}" for i in range(1, k + 1)]

    def run(batches):
        languages, held, rows = Languages(), [], 0
        filtered = bits.value

        def out(keys, n):
            for at in range(0, len(n), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([languages.column(keys[0, part]), *(pa.array(x[part].view(np.int64)) for x in keys[1:]), pa.array(n[part])], ["lang", *names, "n"])

        for batch in batches:
            codes = languages.codes(batch.column("lang"))
            for part in slices(batch.column("text")):
                w, _, _, row, piece = piece_words(part, seed)
                count = len(w) - k + 1
                if count <= 0:
                    continue
                code = codes[part.first + row]
                slot = slots(languages.hashes[code[: count + 1].astype(np.int64)], [w[i : i + count + 1] for i in range(k - 1)])
                hit = (filtered[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1
                at = np.flatnonzero((hit[:-1] & hit[1:]).astype(bool) & (piece[:count] == piece[k - 1 :]))
                held.append(added_up(np.stack([code[at], *(w[at + i] for i in range(k))]), np.ones(len(at), np.int64))[:2])
                rows += len(held[-1][1])
                if rows > HELD:
                    keys, n = added_up(*(np.concatenate(x, axis=-1) for x in zip(*held, strict=True)))[:2]
                    held, rows = [(keys, n)], len(n)
                    if rows > HELD // 2:
                        yield from out(keys, n)
                        held, rows = [], 0
        if held:
            yield from out(*added_up(*(np.concatenate(x, axis=-1) for x in zip(*held, strict=True)))[:2])

    texts = by_language(docs)
    if k == LONGEST:
        texts = texts.coalesce(LAST_TASKS * context.defaultParallelism)
    return texts.mapInArrow(run, "lang string, " + ", ".join(f"{c} long" for c in names) + ", n long")


def phrases(docs: DataFrame, k: int, seed: int, known: DataFrame) -> DataFrame:
    """``lang, w1, ..., wk, n`` of the frequent phrases of ``k`` words, ``known`` being those of one word less."""
    names = [f"w{i}" for i in range(1, k + 1)]
    found = partial_counts(docs, k, seed, known)
    return materialize(found.groupBy("lang", *names).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST), f"collocation-level{k}")


def scored(levels: list[DataFrame]) -> DataFrame:
    """``lang, w, a, l, r, score`` of the candidates that no longer one stands for; ``w``: the words' hashes."""
    all_levels = [d.select("lang", F.array(*(f"w{i}" for i in range(1, k + 1))).alias("w"), "n") for k, d in enumerate(levels, 1)]
    counts = small_side(materialize(functools.reduce(DataFrame.union, all_levels), "collocation-counts"), 80)
    candidates = functools.reduce(DataFrame.union, all_levels[1:])
    cuts = candidates.select("lang", "w", F.col("n").alias("a"), F.explode_outer(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("w", F.lit(1), F.col("k")), "rest": F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))})
    cuts = cuts.join(counts.select("lang", F.col("w").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("w").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("two", wide("a") * F.lit(2_000_000).cast("decimal(7,0)")).withColumn("parts", wide("l") + wide("r"))
    cuts = cuts.withColumn("score", F.expr("two div parts"))
    best = cuts.groupBy("lang", "w", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = []
    for k in range(3, LONGEST + 1):
        inside = [F.array(*(f"w{i}" for i in range(a, a + size))) for size in range(2, k) for a in range(1, k - size + 2)]
        inner.append(levels[k - 1].select("lang", F.explode_outer(F.array(*inside)).alias("w"), F.col("n").alias("longer")))
    longer = functools.reduce(DataFrame.union, inner).groupBy("lang", "w").agg(F.max("longer").alias("longer"))
    best = best.join(longer, ["lang", "w"], "left")
    covered = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * COVER
    return best.where(F.coalesce(~covered, F.lit(True))).select("lang", "w", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first TOP phrases of each language of ``docs (lang, text)``.

    Null text is empty, null lang ``und``; repeated rows count each time; without a
    frequent phrase a language has no rows. Equal scores go by count, then phrase.
    """
    for seed in range(SEEDS):
        words = vocabulary(docs, seed)
        if words.groupBy("lang", "w1").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("words of equal hashes under every seed")
    levels = [words.where(F.col("n") >= LEAST).select("lang", "w1", "n")]
    for k in range(2, LONGEST + 1):
        levels.append(phrases(docs, k, seed, levels[-1]))
    found = materialize(scored(levels), "collocation-scores")
    order = [F.desc("score"), F.desc("a")]
    # no phrase behind TOP better ones of its part can be among the first TOP of all; ties stay until words are known
    part = F.pmod(F.xxhash64("w"), F.lit(PARTS))
    kept = found.withColumn("place", F.rank().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= TOP)
    kept = kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= TOP).drop("place")
    kept = materialize(kept, "collocation-first")
    spelled = kept.select("lang", "w", F.posexplode_outer("w").alias("i", "w1")).join(words.select("lang", "w1", "word"), ["lang", "w1"])
    spelled = spelled.groupBy("lang", "w").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "word")))["word"], " ").alias("phrase"))  # LONGEST words
    out = kept.join(spelled, ["lang", "w"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= TOP)
    totals = small_side(materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "collocation-totals"), 40)
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = f"""
with piece as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p from documents),
 cut as (select lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') as ws from piece),
 place as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from cut),
 gram as (select lang, k, ws[i:i + k - 1] as w, count(*) as f from place cross join (select unnest([1, 2, 3, 4]) as k) where i + k - 1 <= len(ws) group by 1, 2, 3),
 total as (select lang, sum(f)::bigint as n from gram where k = 1 group by 1),
 often as (select * from gram where f >= {LEAST}),
 cand as (select * from often where k >= 2),
 cuts as (select c.lang, c.w, c.f as a, x.k, x.f as l, y.f as r, (2000000::hugeint * c.f) // (x.f + y.f) as score
   from cand c join often x on x.lang = c.lang and x.k < c.k and x.w = c.w[1:x.k] join often y on y.lang = c.lang and y.w = c.w[x.k + 1:]),
 best as (select lang, w, a, l, r, score from cuts qualify row_number() over (partition by lang, w order by score, k) = 1),
 inside as (select lang, w[i:i + s - 1] as w, max(f) as longer from cand, (select unnest([2, 3]) as s), (select unnest([1, 2, 3]) as i) where s < k and i + s - 1 <= k group by 1, 2),
 kept as (select b.*, array_to_string(b.w, ' ') as phrase from best b left join inside i on i.lang = b.lang and i.w = b.w where i.longer is null or 100::hugeint * i.longer < {COVER} * b.a::hugeint)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a, l, r, n, score::bigint as score
from kept join total using (lang) qualify rank <= {TOP}
"""
QUERIES = {"op11_collocations": op11_collocations}
ORACLE_SQL = {"op11_collocations": SQL}
