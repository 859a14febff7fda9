"""Mixing sources to target weights, from SQL functions only.

Sizes are added up by source, targets follow from the weights, and a source's rate is its target over
its size. Each document is then emitted floor(rate) times, and once more if its own draw, a hash of
its id and text, lies under the rate's fraction. Nothing but one row a source is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.llm.common import stored

#: Weights of the sources in code point order, again from the first where they run out.
WEIGHTS = (3, 1, 2)
#: The mix's size as a share of all sizes, and the most of a source's size that it may take.
TOTAL_SHARE = 1.5
MOST_TIMES = 2
#: Another seed gives other draws.
SEED = "mix"
#: Hexadecimal digits of a draw; 13 of them fit a double without loss.
DIGITS = 13
WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE, most_times: float = MOST_TIMES
) -> DataFrame:
    """(source, source_size, weight, target) from (source, size), one row a source.

    Sources share ``total_share`` of all sizes by weight; a target stops at ``most_times`` its source's
    size, and what lies above goes to the others by weight until none is above. That ends where
    target = min(limit, level * weight). Sources are taken by limit / weight; a source stops if its limit is
    at most its share of what those before it leave, and the first that does not stop has the level,
    which is the greatest of those that do not. The windows hold one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights) + 1
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = one.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int")))
    one = one.withColumn("limit", most_times * F.col("source_size").cast("double"))
    order = [F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    left = F.lit(total_share) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    one = one.withColumn("level", left / rest).withColumn("stopped", F.col("limit") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("stopped"), F.col("level"))).over(every)
    target = F.when(F.col("stopped"), F.col("limit")).otherwise(level * F.col("weight"))
    return one.select("source", "source_size", "weight", target.alias("target"))


def _draw(seed: str, doc_id: Column, text: Column) -> Column:
    """0 to 1 from a hash of the id and the text."""
    key = F.concat(F.lit(f"{seed}\n"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), text)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def _copies(rate: Column, draw: Column) -> Column:
    return F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)


def plan_mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    most_times: float = MOST_TIMES,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, source, size, draw, source_size, target, rate, copies) for every row of ``docs``.

    A size is the number of words; a NULL or blank text has none. A NULL source is a source of its own,
    after all others. ``copies`` is the whole part of the rate, and one more where ``draw`` (0 to 1,
    from doc_id and text) is under its fraction; a source without a word has rate 0 and emits nothing.
    Rows of one doc_id and text draw alike, so repeated rows are emitted equally often; rows without an
    id draw by text. Reruns agree, whatever the partitioning. Very long texts are measured whole. An
    empty table gives no rows. Only the three named columns are read, so others may have any name.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = F.regexp_count(t, F.lit(WORD)).cast("long")
    own = stored(docs.select("doc_id", F.col(f"`{source}`").alias("source"), size.alias("size"), _draw(seed, F.col("doc_id"), t).alias("draw")), "sizes")
    aims = targets(own, weights, total_share, most_times).withColumnRenamed("source", "_of").drop("weight")
    both = own.join(aims, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    both = both.withColumn("rate", rate)
    return both.withColumn("copies", _copies(F.col("rate"), F.col("draw")).cast("long"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The rows of the mix: every column of ``docs``, and ``mix_copy`` from 1 for each time a row is taken.

    Rates come from ``plan_mix`` and its edge cases hold; an input column named ``mix_copy`` is replaced.
    A row's draw is computed from the row itself; the rates are one stored row a source, which Spark joins
    without moving texts as long as its own broadcast limit allows.
    """
    plan = plan_mix(docs, text, source, seed=seed, **how).groupBy("source").agg(F.min("rate").alias("_rate"))
    plan = stored(plan.withColumnRenamed("source", "_of"), "rates")
    t = F.coalesce(F.col(f"_in.`{text}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"))
    rows = rows.join(plan, F.col(f"_in.`{source}`").eqNullSafe(F.col("_of")))
    copies = _copies(F.col("_rate"), _draw(seed, F.col("_in.doc_id"), t)).cast("int")
    rows = rows.withColumn("_copies", copies).where("_copies > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.select(*[F.col(f"_in.`{c}`").alias(c) for c in docs.columns if c != "mix_copy"], F.col("_copy").alias("mix_copy"))
