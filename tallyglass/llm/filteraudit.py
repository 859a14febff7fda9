"""Filter interaction audit: what each of five filters removes in every order, from a histogram of failure masks.

SQL expressions give each document a mask of the filters that it fails; which rows repeat an earlier
text comes from the smallest id of each text. Masks have 32 values, so 32 cells a part hold all that
the 120 orders need, and no document is looked at again.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import stored

#: A letter a filter; the k-th letter is bit k of a mask.
FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
SYMBOLS = "[#$%&*|]"
WORD_GAP = "[ \\t\\n\\x0B\\f\\r]+"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that ``text`` (not NULL) fails.

    A: fewer than ``MIN_WORDS`` words; B: less than ``MIN_DISTINCT_PERCENT`` of the words are distinct;
    C: more than ``MAX_CAPITAL_PERCENT`` of the code points are A to Z; D: one of ``SYMBOLS``. A text
    without a word fails A alone of the first two; an empty one has no capitals.
    """
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")

    def by_words(w: Column) -> Column:
        n, distinct = F.size(w).cast("long"), F.size(F.array_distinct(w)).cast("long")
        return F.when(n < MIN_WORDS, 1).otherwise(0) + F.when(100 * distinct < MIN_DISTINCT_PERCENT * n, 2).otherwise(0)

    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    shouts = F.when(100 * capitals > MAX_CAPITAL_PERCENT * F.length(text).cast("long"), 4).otherwise(0)
    once = F.element_at(F.transform(F.array(words), by_words), 1)  # the words are split once
    return once + shouts + F.when(text.rlike(SYMBOLS), 8).otherwise(0)


def masked(docs: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) for every row of ``docs``: all five bits.

    E fails where a smaller doc_id holds the same text anywhere in the table. Texts are the same if their
    SHA-256 is. A row passes E if it is the first of its text, which is asked by (doc_id, text): that
    key repeats with repeated rows only, so a text that a third of all rows hold is no hot key.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        text_mask(t).alias("mask"),
        F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"),
    )
    own = stored(own, "masks")
    first = own.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("is_first", F.lit(True))
    known = own.where("doc_id is not null").join(first, ["doc_id", "digest"], "left")
    repeat = F.when(F.col("is_first"), 0).otherwise(1 << FILTERS.index("E"))
    known = known.select("doc_id", "part", (F.col("mask") + repeat).alias("mask"))
    return known.unionByName(own.where("doc_id is null").select("doc_id", "part", "mask"))


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask, and those that ``labels`` mark.

    A document is good if any of its label rows has quality 1, and toxic alike.
    """
    said = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"is_{a}") for a, c in (("good", "quality"), ("toxic", "toxic"))]
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*said)
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left").drop("doc_id")
    none = rows.where("doc_id is null").select("part", "mask", F.lit(None).cast("int").alias("is_good"), F.lit(None).cast("int").alias("is_toxic"))
    sums = [F.coalesce(F.sum(f"is_{a}"), F.lit(0)).alias(a) for a in ("good", "toxic")]
    return known.unionByName(none).groupBy("part", "mask").agg(F.count("*").alias("n"), *sums)


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step; counts as below, zeros included.

    ``kept`` after the step, ``removed`` in it, ``redundant`` (fail this filter, removed before),
    ``unique_fails`` (fail this filter only), ``good_lost`` and ``toxic_lost`` (removed here, so
    labelled), and ``shapley``: removed by this filter, summed over all orders. A document that fails
    k filters is removed by each of them in 120 / k orders.

    A NULL text counts as empty, a NULL part as an empty string. Rows without a doc_id have no smaller id
    and no label; repeated rows count as often as they occur, and equal ids are not smaller than each
    other. Very long texts are judged whole, each in one task. An empty table gives no rows. Only doc_id,
    the text and the part are read, so other columns may have any name.
    """
    found = cells(masked(docs, text, part), labels)
    counts = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # at most 32
    wide = found.groupBy("part").agg(counts.alias("cells"))
    every = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = wide.select("part", "cells", F.explode(every).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bit(step: Column) -> Column:
        at = F.instr(F.lit(FILTERS), F.substring("filter_order", step, F.lit(1))) - 1
        return F.call_function("shiftleft", F.lit(1), at)

    earlier = F.slice(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(1), F.col("step") - 1)
    steps = steps.select("*", bit(F.col("step")).alias("bit"), F.aggregate(earlier, F.lit(0), lambda a, s: a + bit(s)).alias("before"))

    def total(which, what: str = "n", times=None) -> Column:
        chosen = F.filter(F.map_entries("cells"), lambda c: which(c["key"]))
        share = times or (lambda mask: F.lit(1))
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, c: a + c["value"][what] * share(c["key"]))

    fails = lambda mask: mask.bitwiseAND(F.col("bit")) != 0
    gone = lambda mask: mask.bitwiseAND(F.col("before")) != 0
    here = lambda mask: fails(mask) & ~gone(mask)
    orders = 120
    share = lambda mask: (F.lit(orders) / F.bit_count(mask)).cast("long")
    return steps.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m == F.col("bit")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        total(fails, times=share).alias("shapley"),
    )
