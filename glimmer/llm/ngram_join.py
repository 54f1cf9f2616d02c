"""Jaccard join of texts on word shingles, by grouped prefixes.

A text's set holds the hashes of its distinct shingles of WIDTH words (A-Z lowered).
All sets are sorted in one global order, frequent shingles last; two sets whose
Jaccard similarity reaches PERCENT share a token among their first
n - ceil(PERCENT n / 100) + 1 ones, their prefixes. Texts with equal sets are one
node, nodes with equal prefixes and sizes are one group. A group is listed under
those of its prefix tokens that another group has; pairs of groups are filtered by
size and by the number of prefix tokens they can share, and only then expanded to
their members, which are verified. The members of a group of several nodes are
listed one by one under the group's own key, so pairs inside it are candidates too.

Components are found without all pairs of a token's list: in each round the lists
that still span several components pick a leader, and the members of every other
group are verified against it, which settles the large families of near copies in
time linear in their size. Last, the pairs of groups across components that a list
still holds go through the filters, so no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, components, materialize, small_side, table
from .words import Slice, mix, slices, window_sums, words_of

WIDTH, PERCENT = 5, 80
#: Most frequent shingles that the global order puts last (only speed depends on them), and how often a task has to see one.
FREQUENT, SEEN = 1 << 16, 2
#: Rounds of leaders before the remaining pairs, and members that one verification task compares with a leader.
LEADER_ROUNDS, CHUNK = 2, 64
#: Steps in which the share of a prefix that no other group lists counts when leaders are picked.
PREFIX_PARTS = 8
#: Bits of the maps that bound how many elements two sets can share.
BITS = 1024
_U = np.uint64


def shingle_sets(part: Slice) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer than WIDTH words make one shingle, none an empty set."""
    found = words_of(part, lower=True)
    sums = window_sums(found.hashes, WIDTH)
    out, bounds = [], found.bounds.tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WIDTH:
            own = np.sort(sums[a : b - WIDTH + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            out.append(mix(window_sums(found.hashes[a:b], b - a) + _U(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def digests(own: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return tuple(int(mix(own ^ _U(k)).sum(dtype=np.uint64).view(np.int64)) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted most frequent shingles and the power of two that their counts have: FREQUENT at most."""

    def run(batches):
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def counts():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens[n >= SEEN].view(np.int64)), pa.array(n[n >= SEEN])], ["token", "n"])

        for batch in batches:
            for part in slices(batch.column("text")):
                for own in shingle_sets(part):
                    key = (len(own), int(own[0]), int(own[-1])) if len(own) else None
                    if key and key not in seen:  # copies count once
                        seen.add(key)
                        held.append(own)
                        size += len(own)
                if size > 6_000_000:
                    yield counts()
                    held, size, seen = [], 0, set()
        if held:
            yield counts()

    found = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 16")
    rows = found.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([int(r["n"]).bit_length() for r in rows], np.int64)[order]


def bitmap(own: np.ndarray) -> np.ndarray:
    """BITS bits, those at the elements' hashes set: two sets differ in at least as many elements as their bitmaps in bits."""
    flags = np.zeros(BITS, np.uint8)
    flags[(own >> _U(20)) % _U(BITS)] = 1
    return np.packbits(flags).view(np.int64)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def prefix_size(n):
    """The same of a column."""
    return n - F.ceil(n * PERCENT / 100) + 1


def prefixes(docs: DataFrame) -> DataFrame:
    """``doc_id, n, d1, d2, prefix, pkey, bits`` of every row: set size, set digest, prefix tokens, their digest, bitmap."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))  # 16 bytes each

    def run(batches):
        tokens, power = frequent.value
        for batch in batches:
            for part in slices(batch.column("text")):
                rows, none = [], np.zeros(BITS // 64, np.int64)
                for own in shingle_sets(part):
                    n = len(own)
                    if not n:
                        rows.append((0, 0, 0, [], 0, none))
                        continue
                    k = prefix_length(n)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                        late = np.where(tokens[at] == own, power[at], 0)
                        first = own[np.argsort(late, kind="stable")[:k]] if late.any() else own[:k]
                    else:
                        first = own[:k]
                    rows.append((n, *digests(own), first.view(np.int64), digests(np.sort(first))[0], bitmap(own)))
                n, d1, d2, first, pkey, bits = zip(*rows, strict=True)
                flat = pa.array(np.concatenate([np.asarray(x, np.int64) for x in first]))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in first])]), pa.int32()), flat)
                maps = pa.ListArray.from_arrays(np.arange(0, len(rows) * BITS // 64 + 1, BITS // 64, dtype=np.int32), np.concatenate(bits))
                ids = batch.column("doc_id").slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n, d1, d2)), lists, pa.array(pkey, pa.int64()), maps], ["doc_id", "n", "d1", "d2", "prefix", "pkey", "bits"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, prefix array<long>, pkey long, bits array<long>")
    return materialize(found, "join-prefixes")


def similar_sizes(a, b):
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def needed(both, more):
    """Prefix tokens that two linked sets share, from the sum and the larger of their sizes.

    Tokens behind the prefixes add at most ceil(PERCENT n / 100) - 1 of the larger set.
    """
    return F.ceil(both * PERCENT / (100 + PERCENT)) - (F.ceil(more * PERCENT / 100) - 1)


def verify(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs (a, b)`` that reach the similarity.

    Each set goes once to each chunk of at most about CHUNK pairs of its leader ``a``,
    where rows come sorted, the leader's first. ``nodes (doc_id, d1)`` tells which of
    the rows of a doc_id stands for it.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = materialize(pairs.join(size, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks"))).select("a", "b", "chunk"), "join-pairs")
    wanted = dealt.select(F.col("b").alias("doc_id"), "a", "chunk", F.lit(True).alias("member")).union(dealt.select(F.col("a").alias("doc_id"), "a", "chunk", F.lit(False)).distinct())
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("a", "chunk", "member")).alias("to")).join(nodes.select("doc_id", "d1"), "doc_id")
    wanted = materialize(wanted, "join-wanted")
    held = wanted.agg(F.sum(48 + 40 * F.size("to"))).first()[0] or 0
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(wanted) if held <= BROADCAST_BYTES else wanted, "doc_id")

    def sets(batches):
        for batch in batches:
            keys, d1, to = (batch.column(c).to_pylist() for c in ("doc_id", "d1", "to"))
            for part in slices(batch.column("text")):
                out: list[tuple] = []
                for i, own in enumerate(shingle_sets(part), part.first):
                    if len(own) and digests(own)[0] == d1[i]:
                        raw = own.tobytes()
                        out += [(x["a"], x["chunk"], x["member"], keys[i], raw) for x in to[i]]
                    if len(out) > 500:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    def _rows(out):
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["a", "chunk", "member", "b", "own"])

    def compare(batches):
        leader, own, last = None, None, None
        for batch in batches:
            left, right = [], []
            for a, chunk, member, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "member", "b", "own")), strict=True):
                other = np.frombuffer(raw, np.uint64)
                if not member:
                    leader, own = (a, chunk), other
                elif leader == (a, chunk) and (a, chunk, b) != last:
                    at = np.searchsorted(own, other)
                    both = int((own[np.minimum(at, len(own) - 1)] == other).sum())
                    if 100 * both >= PERCENT * (len(own) + len(other) - both):
                        left.append(a)
                        right.append(b)
                    last = (a, chunk, b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select("doc_id", "text", "d1", "to").mapInArrow(sets, "a long, chunk long, member boolean, b long, own binary")
    rows = rows.repartition(n, "a", "chunk").sortWithinPartitions("a", "chunk", "member", "b")
    return materialize(rows.mapInArrow(compare, "a long, b long"), "join-links")


def group_lists(found: DataFrame, members: DataFrame) -> DataFrame:
    """``token, unit, n, i, cap``: each group under the tokens of its prefix that another group has as well.

    ``i`` counts these tokens in the global order, ``cap`` is how many there are: two
    groups whose first common token is number i of one have at most cap - i in common.
    """
    heads = small_side(materialize(members.where("`group` = node").select(F.col("group").alias("doc_id"), "d1"), "join-heads"), 24)
    listed = found.join(heads, ["doc_id", "d1"], "left_semi").select(F.col("doc_id").alias("unit"), "n", F.posexplode_outer("prefix").alias("pos", "token")).where("token is not null")
    shared = listed.groupBy("token").agg(F.min("unit").alias("x"), F.max("unit").alias("y")).where("x <> y").select("token")
    own = listed.join(small_side(materialize(shared, "join-shared"), 12), "token", "left_semi")
    own = own.groupBy("unit", "n").agg(F.array_sort(F.collect_set(F.struct("pos", "token"))).alias("p"))  # at most a text's prefix
    own = own.select("unit", "n", F.col("p.token").alias("p"), F.size("p").alias("cap"))
    return own.select(F.posexplode("p").alias("i", "token"), "unit", "n", "cap").select("token", "unit", "n", "i", "cap", F.lit(False).alias("single"))


def labelled(lists: DataFrame, members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lists`` with the least and the greatest component (``low, high``) of each unit so far, only of tokens that span several; and every member's component."""
    known = small_side(materialize(components(links), "join-components"), 24)
    of = materialize(members.join(known, "node", "left").select("group", "node", "n", F.coalesce("component", "node").alias("component")), "join-labels")
    by_group = of.groupBy(F.col("group").alias("unit")).agg(F.min("component").alias("low"), F.max("component").alias("high")).select("unit", F.lit(False).alias("single"), "low", "high")
    by_node = of.where("`group` <> node").select("group").distinct()
    by_node = of.join(by_node, "group", "left_semi").select(F.col("node").alias("unit"), F.lit(True), "component", "component")
    ends = small_side(materialize(by_group.union(by_node), "join-units"), 32)
    d = lists.join(ends, ["unit", "single"])
    mixed = d.groupBy("token").agg(F.min("low").alias("x"), F.max("high").alias("y")).where("x <> y").select("token")
    return materialize(d.join(small_side(materialize(mixed, "join-mixed"), 12), "token", "left_semi"), "join-open"), of


def similar_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs (doc_id, text)``.

    Null text or no words: an empty set, linked with nothing. Rows of one doc_id are
    one node, for which the row with the least digest stands; rows without doc_id
    are linked with nothing and have no component.
    """
    found = prefixes(docs)
    rows = found.where("doc_id is not null and n > 0").select("doc_id", "n", "d1", "d2", "pkey")
    nodes = materialize(rows.groupBy("doc_id").agg(F.min(F.struct("n", "d1", "d2", "pkey")).alias("s")).select("doc_id", "s.*"), "join-nodes")
    equal = nodes.groupBy("n", "d1", "d2", "pkey").agg(F.min("doc_id").alias("node"))
    # groups of equal prefixes and sizes: the least node lists for all of them
    groups = equal.groupBy("n", "pkey").agg(F.min("node").alias("group"))
    members = materialize(equal.join(groups, ["n", "pkey"]).select("group", "node", "n", "d1"), "join-members")
    several = materialize(members.where("`group` <> node").select("group").distinct(), "join-several")
    inside = materialize(members.join(small_side(several, 12), "group", "left_semi").select("group", "node", "n"), "join-inside")
    # a group's members share their whole prefixes, so they are listed one by one under the group's own key
    by_key = inside.select(F.xxhash64("group", F.lit("group")).alias("token"), F.col("node").alias("unit"), "n", F.lit(0).alias("i"), F.col("n").cast("int").alias("cap"), F.lit(True).alias("single"))
    lists = materialize(group_lists(found, members).union(by_key), "join-buckets")
    sizes = small_side(nodes.select("doc_id", "n"), 24)
    expansion = small_side(inside.select(F.col("group").alias("x"), "node"), 24)

    def expanded(pairs: DataFrame, side: str) -> DataFrame:
        """Every member of the group ``side`` in its place; units listed one by one stand for themselves."""
        d = pairs.join(expansion, (F.col(side) == F.col("x")) & ~F.col("single"), "left")
        return d.withColumn(side, F.coalesce("node", side)).drop("x", "node")

    def to_leaders(open_lists: DataFrame, rank, across) -> DataFrame:
        """Pairs of each list's leader with the members of its other units that share half of the prefix tokens a link needs: others can wait."""
        lead = open_lists.groupBy("token").agg(F.min(rank).alias("l"))
        weight = F.when(F.col("single"), F.col("n")).otherwise(1)
        d = open_lists.join(lead, "token").where(across).select(F.col("l.unit").alias("a"), F.col("unit").alias("b"), "single", weight.alias("shared"))
        d = d.where("a <> b").groupBy("a", "b", "single").agg(F.sum("shared").alias("shared"))
        a, b = sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"))
        d = d.join(a, "a").join(b, "b").where(similar_sizes(F.col("na"), F.col("nb")) & (2 * F.col("shared") >= needed(F.col("na") + F.col("nb"), F.greatest("na", "nb"))))
        return expanded(d.select("a", "b", "single"), "b").select("a", "b").distinct()

    # one order of units for all tokens, so a family's first unit leads every token that it is listed under; units of few tokens
    # of their own come first, as they are central in their family
    own = F.floor((PREFIX_PARTS * (prefix_size(F.col("n")) - F.least("cap", prefix_size(F.col("n"))))) / prefix_size(F.col("n")))
    links = verify(docs, to_leaders(lists, F.struct(own.alias("own"), "unit"), F.lit(True)), nodes)
    left, of = labelled(lists, members, links)
    for k in range(1, LEADER_ROUNDS):
        rank = F.struct(own.alias("own"), F.xxhash64("unit", F.lit(k)).alias("h"), "unit", "low", "high")
        links = links.union(verify(docs, to_leaders(left, rank, (F.col("low") != F.col("l.low")) | (F.col("high") != F.col("l.high")) | (F.col("low") != F.col("high"))), nodes))
        left, of = labelled(left.drop("low", "high"), members, links)
    links = links.union(verify(docs, across_components(found, nodes, left, of, expanded), nodes))
    same = nodes.join(equal.select("n", "d1", "d2", "node"), ["n", "d1", "d2"]).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    known = components(links.union(same.where("a <> b"))).withColumnRenamed("node", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles")).join(known, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def too_different(x, y, both):
    """Whether two bitmaps differ in more bits than linked sets of ``both`` elements together can; null bitmaps do not."""
    bits = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    return F.coalesce(both - bits < 2 * F.ceil(both * PERCENT / (100 + PERCENT)), F.lit(False))


def across_components(found: DataFrame, nodes: DataFrame, left: DataFrame, of: DataFrame, expanded) -> DataFrame:
    """All pairs of nodes of different components that a list still holds and the filters let through.

    Pairs of units come first: sizes, the place of the common token in both prefixes,
    and for groups of one the bitmaps, all inside the join, so families of almost
    similar texts make no rows. Then groups are expanded to their members.
    """
    bits = found.join(nodes.select("doc_id", "d1"), ["doc_id", "d1"]).select(F.col("doc_id").alias("node"), "bits").dropDuplicates(["node"])
    alone = of.groupBy("group").agg(F.count("*").alias("members")).where("members = 1").select(F.col("group").alias("node"))
    own = bits.join(alone, "node", "left_semi").select(F.col("node").alias("unit"), F.lit(False).alias("single"), "bits")
    largest = left.where("low = high").groupBy("token", "low").count().groupBy("token").agg(F.max(F.struct("count", "low")).alias("l")).select("token", F.col("l.low").alias("main"))
    left = left.join(largest, "token", "left").join(own, ["unit", "single"], "left").withColumn("inner", F.coalesce((F.col("low") == F.col("main")) & (F.col("high") == F.col("main")), F.lit(False)))
    x, y = left.where("not `inner`").alias("x"), left.alias("y")
    both, more = F.col("x.n") + F.col("y.n"), F.greatest("x.n", "y.n")
    # a unit outside the main component against the list: those inside, and those outside that come later
    on = (F.col("x.token") == F.col("y.token")) & (F.col("y.inner") | (F.col("x.unit") < F.col("y.unit")))
    on = on & ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low")))
    on = on & similar_sizes(F.col("x.n"), F.col("y.n")) & (F.least(F.col("x.cap") - F.col("x.i"), F.col("y.cap") - F.col("y.i")) >= needed(both, more))
    on = on & ~too_different(F.col("x.bits"), F.col("y.bits"), both)
    units = x.join(y, on).select(F.col("x.unit").alias("a"), F.col("y.unit").alias("b"), F.col("x.single").alias("single")).distinct()
    pairs = expanded(expanded(materialize(units, "join-unit-pairs"), "a"), "b").select("a", "b", "single")
    a, b = (of.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"), F.col("n").alias(f"n{k}")).join(bits.select(F.col("node").alias(k), F.col("bits").alias(f"bits{k}")), k) for k in "ab")
    d = pairs.select("a", "b").where("a <> b").join(a, "a").join(b, "b").where("ca <> cb").where(~too_different(F.col("bitsa"), F.col("bitsb"), F.col("na") + F.col("nb")))
    return d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component has a lower doc_id; rows without doc_id stay."""
    found = similar_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(small_side(materialize(found, "join-copies"), 8), "doc_id", "left_anti").select(*docs.columns)


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


SQL = """
with recursive word as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
 shingle as (select distinct doc_id, w[i:i+4] as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from word where len(w) > 0)),
 size as (select doc_id, count(*) as n from shingle group by doc_id),
 shared as (select x.doc_id as a, y.doc_id as b, count(*) as k from shingle x join shingle y using (s) where x.doc_id <> y.doc_id group by 1, 2),
 link as (select a, b from shared join size p on p.doc_id = a join size q on q.doc_id = b where 100 * k >= 80 * (p.n + q.n - k)),
 reach as (select a as doc_id, a as r from link union select r.doc_id, l.b from reach r join link l on l.a = r.r),
 least as (select doc_id, min(r) as c from reach group by doc_id)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(l.c, d.doc_id) as component_id
from documents d left join size s using (doc_id) left join least l using (doc_id)
"""
QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLE_SQL = {"op1_ngram_join": SQL}
