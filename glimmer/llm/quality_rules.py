"""Quality rules: a decision list learned from labelled statistics, as Spark conditionals.

Every text gets a few counts by built-in functions. The labelled ones are put into
a table of cells (one bin of each ratio, part, label), which has a fixed size at
most whatever the corpus; sequential covering works on these counts. A rule grows
by the threshold with the best information gain on the growing part, is cut back
where that raises (p - n) / (p + n) on the pruning part, and is taken if it is
precise there; what it covers is removed before the next one. The list becomes
``when(rule 1, 1).when(rule 2, 2)...``; a text that no rule matches is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import windows, words
from .shared import materialize, table

#: Percentiles of the labelled rows to keep, and of those to reject, that become candidate thresholds of each ratio (condition: ratio < t
#: or ratio >= t); they bound the number of cells.
KEEP_AT, REJECT_AT = (0.01, 0.05, 0.5, 0.95, 0.99), (0.1, 0.25, 0.5, 0.75, 0.9)
MAX_RULES, MAX_CONDITIONS = 8, 3
#: A rule's least precision on the pruning part, and its least share of that part's rejects.
PRECISION, SUPPORT = 0.95, 0.005
STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct"]


def statistics(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the counts in STATS of every row (null text: zeros); repeated rows stay."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    d = docs.select(*keys, text.alias("text"))
    d = d.select(*keys, words(F.col("text")).alias("w"), lines.alias("l"), F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).alias("word_chars"), (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).alias("n_symbols"))
    d = d.select(*keys, "word_chars", "n_symbols", F.size("l").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    d = d.withColumn("w5", windows("h", 5))
    # windows found twice: equal neighbours in sorted order; only texts that have any are sorted
    d = d.withColumn("s", F.when(F.size("w5") > F.size(F.array_distinct("w5")), F.array_sort(F.transform("w5", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("s")
    same = lambda e, k: F.get(s, k).getField("h") == e.getField("h")
    d = d.withColumn("p", F.array_sort(F.transform(F.filter(s, lambda e, k: F.coalesce(same(e, k - 1), F.lit(False)) | F.coalesce(same(e, k + 1), F.lit(False))), lambda e: e.getField("i"))))
    p = F.col("p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    d = d.select(*keys, F.size("h").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).alias("n_repeat_words"), F.size(F.array_distinct("h")).alias("n_distinct"))
    return d.select(*keys, *(F.col(c).cast("long") for c in STATS))


def ratios() -> dict[str, Column]:
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return {
        "words": F.col("n_words").cast("double"), "word_length": part("word_chars", "n_words"), "symbols": part("n_symbols", "word_chars"),
        "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words"), "distinct": part("n_distinct", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


Condition = tuple[str, bool, float]  # ratio, whether >= (else <), threshold
Cell = tuple[tuple[int, ...], bool, bool, int]  # bins, pruning part, reject, rows
Thresholds = dict[str, list[float]]


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that pass the base rule and have a label ``q``, the least one of their doc_id."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    return stats.where(~base_failed()).join(known, "doc_id")


def thresholds(known: DataFrame) -> Thresholds:
    """Of each ratio, its distinct percentiles in either class of the labelled rows; none where there are none."""
    at = lambda c, test, p: F.percentile_approx(F.when(test, c), F.array(*map(F.lit, p)), F.lit(10_000))
    row = known.agg(*(F.concat(*(F.coalesce(x, F.array().cast("array<double>")) for x in (at(c, F.col("q") != 0, KEEP_AT), at(c, F.col("q") == 0, REJECT_AT)))).alias(k) for k, c in ratios().items())).first()
    return {k: sorted(set(row[k])) for k in ratios()}


def cells(known: DataFrame, limits: Thresholds) -> list[Cell]:
    """Counts of labelled rows by bin of each ratio, part and label: the bins bound how many."""
    bins = [sum(((c >= t).cast("int") for t in limits[k]), F.lit(0)) for k, c in ratios().items()]
    d = known.groupBy(*(b.alias(f"b{i}") for i, b in enumerate(bins)), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), (F.col("q") == 0).alias("reject")).count()
    return sorted((tuple(r[: len(bins)]), r["prune"], r["reject"], r["count"]) for r in d.collect())


def learn(found: list[Cell], limits: Thresholds) -> tuple[list[list[Condition]], str]:
    """The ordered rules, each a conjunction of thresholds that rejects, and what ended learning: nothing left, an imprecise or a rare rule, or MAX_RULES."""
    names = list(limits)

    def holds(bins: tuple[int, ...], c: Condition) -> bool:
        at = limits[c[0]].index(c[2])
        return (bins[names.index(c[0])] > at) == c[1]

    def score(left: list[Cell], rule: list[Condition]) -> tuple[int, int]:
        hit = [x for x in left if all(holds(x[0], c) for c in rule)]
        return sum(x[3] for x in hit if x[2]), sum(x[3] for x in hit if not x[2])

    rules: list[list[Condition]] = []
    left = found
    rejects = sum(x[3] for x in found if x[1] and x[2])
    while len(rules) < MAX_RULES:
        grow, prune = [x for x in left if not x[1]], [x for x in left if x[1]]
        rule: list[Condition] = []
        inside = grow
        while len(rule) < MAX_CONDITIONS:
            p0, n0 = score(inside, [])
            if not p0 or not n0:
                break
            best, best_gain = None, 0.0
            for f, name in enumerate(names):
                size = len(limits[name]) + 1
                pos, neg = [0] * size, [0] * size
                for bins, _, reject, n in inside:
                    (pos if reject else neg)[bins[f]] += n
                for at, t in enumerate(limits[name]):
                    for up in (False, True):
                        p = sum(pos[at + 1 :] if up else pos[: at + 1])
                        n = sum(neg[at + 1 :] if up else neg[: at + 1])
                        if p and (gain := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > best_gain + 1e-9:
                            best, best_gain = (name, up, t), gain
            if best is None:
                break
            rule.append(best)
            inside = [x for x in inside if holds(x[0], best)]
        if not rule:
            return rules, "nothing left"

        def worth(k: int, rule=rule, prune=prune) -> float:
            p, n = score(prune, rule[:k])
            return (p - n) / (p + n) if p + n else -1.0

        rule = rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]
        p, n = score(prune, rule)
        if p < PRECISION * (p + n):
            return rules, "imprecise"
        if p < max(1, SUPPORT * rejects):
            return rules, "rare"
        rules.append(rule)
        left = [x for x in left if not all(holds(x[0], c) for c in rule)]
    return rules, "most rules"


def expression(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that matches, null where none does."""
    own = ratios()
    out = None
    for i, rule in enumerate(rules, 1):
        test = None
        for name, up, t in rule:
            one = own[name] >= t if up else own[name] < t
            test = one if test is None else test & one
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(None).cast("int") if out is None else out


def learned(stats: DataFrame, labels: DataFrame) -> tuple[list[list[Condition]], str]:
    """Rules from the labelled rows of written ``stats``, and what ended learning."""
    known = materialize(labelled(stats, labels), "quality-labelled")
    limits = thresholds(known)
    return learn(cells(known, limits), limits)


def judge(docs: DataFrame, labels: DataFrame, keys: tuple[str, ...] | list[str] = ("doc_id",)) -> DataFrame:
    """``keys`` (with ``doc_id``), STATS, ``base_failed``, ``rule`` (int, null: none), ``kept`` and ``ended`` (what ended learning) of every row.

    ``labels (doc_id, quality)``: 0 is to be rejected; of repeated labels the least
    counts. Without labels, or where no rule is precise, only the base rule rejects.
    Each row is judged by itself, repeated ones too, over its whole text.
    """
    stats = materialize(statistics(docs, list(keys)), "quality-statistics")
    rules, ended = learned(stats, labels)
    d = stats.select(*keys, *STATS, base_failed().alias("base_failed"), expression(rules).alias("rule"), F.lit(ended).alias("ended"))
    return d.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLE_SQL: dict[str, str] = {}
