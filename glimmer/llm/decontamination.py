"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

A test item's set holds its distinct five-word shingles (lower case). Items are
partitioned by set size (powers of two); within a partition each item is sketched
by its k least shingle hashes, k being one more than the shingles that an item of
the partition's largest size may miss at the threshold. A text that holds enough
of an item therefore holds one of its sketch values, however long the text is, so
the search loses nothing; texts with fewer distinct shingles than an item needs are
left out before. Candidates are verified by counting the item's shingles in the text.

Items of fewer than five words have no such shingle: their whole word sequence is one
of its own length, looked for among the texts' windows of that length and compared word by word.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .native import windows, words
from .shared import materialize, small_side, table

WIDTH = 5
#: Least percentage of an item's shingles that a contaminated text holds.
PERCENT = 80


def shingles(texts: DataFrame, key: str) -> DataFrame:
    """``key`` and the array ``h`` of distinct shingle hashes of each row.

    ``h`` is to be exploded by ``explode_outer``: for ``explode`` Spark would test the
    array's size before, which computes it a second time for each of its elements.
    """
    d = texts.select(key, words(F.lower("text")).alias("w"))
    return d.select(key, F.array_distinct(windows("w", WIDTH)).alias("h"))


def item_shingles(items: DataFrame) -> DataFrame:
    """``item_id, h, need, sketched``: an item's shingles, how many a text needs, and which form the sketch."""
    d = shingles(items.where("item_id is not null"), "item_id").select("item_id", F.explode_outer("h").alias("h")).where("h is not null").distinct()
    d = d.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1  # of the partition
    k = F.floor(largest * (100 - PERCENT) / 100) + 1
    d = d.withColumn("sketched", F.row_number().over(Window.partitionBy("item_id").orderBy("h")) <= k)
    return d.select("item_id", "h", F.ceil(F.col("n") * PERCENT / 100).cast("long").alias("need"), "n", "sketched")


def short_hits(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """``doc_id, item_id, n_shared, n_item`` (1 of 1) of the items of fewer than WIDTH words whose words a text holds in a row; None without such items."""
    plain = lambda d, key: d.where(F.col(key).isNotNull()).select(key, words(F.lower("text")).alias("w"))
    short = materialize(plain(items, "item_id").where(F.size("w").between(1, WIDTH - 1)).distinct(), "short-items")
    sizes = sorted(r["n"] for r in short.select(F.size("w").alias("n")).distinct().collect())  # WIDTH - 1 at most
    if not sizes:
        return None
    parts = lambda d, key, n: d.where(F.size("w") >= n).select(key, F.lit(n).alias("n"), F.explode_outer(F.array_distinct(windows("w", n))).alias("h"))
    known = functools.reduce(DataFrame.union, (parts(short.where(F.size("w") == n), "item_id", n) for n in sizes))
    found = functools.reduce(DataFrame.union, (parts(plain(docs, "doc_id"), "doc_id", n) for n in sizes))
    pairs = materialize(found.join(small_side(materialize(known, "short-known"), 24), ["n", "h"]).select("doc_id", "item_id").distinct(), "short-candidates")
    spaced = lambda d, key, to: d.select(key, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias(to))
    d = spaced(plain(docs, "doc_id"), "doc_id", "t").join(pairs, "doc_id").join(spaced(short, "item_id", "i"), "item_id").where(F.contains("t", "i"))
    return d.select("doc_id", "item_id", F.lit(1).cast("long").alias("n_shared"), F.lit(1).cast("long").alias("n_item")).distinct()


def contaminated(docs: DataFrame, items: DataFrame, short: bool = True) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item``: each item of which a text holds PERCENT of the shingles.

    Rows without text or doc_id are never reported; rows that share a doc_id count as
    one text (of short items one of them has to hold all words), rows that share an item_id as one item. Items of no words are
    never found, those of fewer than WIDTH words only with ``short``. Other columns play no part.
    """
    known = materialize(item_shingles(items), "item-shingles")
    sketch = small_side(known.where("sketched").select("h", "item_id", "need"), 24)
    own = shingles(docs.where("doc_id is not null"), "doc_id")
    found = own.select("doc_id", F.size("h").alias("size"), F.explode_outer("h").alias("h")).join(sketch, "h").where("size >= need")
    candidates = materialize(found.select("doc_id", "item_id").distinct(), "leak-candidates")
    texts = docs.join(small_side(materialize(candidates.select("doc_id").distinct(), "leak-texts"), 8), "doc_id", "left_semi")
    hits = shingles(texts, "doc_id").select("doc_id", F.explode_outer("h").alias("h")).join(small_side(known.select("h", "item_id", "need", "n"), 32), "h")
    counts = hits.groupBy("doc_id", "item_id").agg(F.countDistinct("h").alias("n_shared"), F.first("need").alias("need"), F.first("n").alias("n_item")).where("n_shared >= need")
    out = counts.join(candidates, ["doc_id", "item_id"], "left_semi").select("doc_id", "item_id", "n_shared", "n_item")
    more = short_hits(docs, items) if short else None
    if more is None:
        return out
    return out.union(more.join(known.select("item_id").distinct(), "item_id", "left_anti").select(*out.columns))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = """
 select {key}, w[i:i+4] as s from (select {key}, w, unnest(range(1, len(w) - 3)) as i from (
   select {key}, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from {table} where {key} is not null and text is not null) where len(w) >= 5)"""
SQL = f"""
with item as (select distinct item_id, s from ({_SHINGLES.format(key="item_id", table="benchmark")})),
 sizes as (select item_id, count(*) as n_item from item group by item_id),
 doc as (select distinct doc_id, s from ({_SHINGLES.format(key="doc_id", table="documents")})),
 shared as (select doc_id, item_id, count(*) as n_shared from doc join item using (s) group by doc_id, item_id)
select doc_id, item_id, n_shared, n_item from shared join sizes using (item_id) where 100 * n_shared >= {PERCENT} * n_item
union all select distinct doc_id, item_id, 1::bigint, 1::bigint from
 (select doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), ' ') || ' ' as t from documents where doc_id is not null) join
 (select item_id, ' ' || array_to_string(w, ' ') || ' ' as i from (select item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from benchmark where item_id is not null)
  where len(w) between 1 and {WIDTH - 1} and item_id not in (select item_id from item)) on contains(t, i)
"""
QUERIES = {"op6_decontamination": op6_decontamination}
ORACLE_SQL = {"op6_decontamination": SQL}
