"""Generated summaries of all keys at once (A11, R7, R9, R12): one for each source, one over both, one of promotion.

Sources are never averaged: each has a summary of its own material, and the integrated one is made from
the two summaries and the counts of who said what, where both sources have something to say.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import lexicon as L
from tallyglass.operators import consolidate, hooks, merge

INTEGRATED, SUPPORTER = "integrated", "supporter"


def prompts(rows: DataFrame, fields: list[str], keys: list[str], stats: DataFrame | None = None, order: str = "id") -> DataFrame:
    """(keys, prompt, n_reviews): the filled material of each key, a line a criterion, and the counts of its polarities.

    ``stats`` is (keys, criterion, pos, neg). Keys without any material have no row, so nothing is asked for them.
    """
    material = consolidate.source_material(rows, fields, keys, order)
    if stats is not None:
        material = material.join(stats.select(*keys, "criterion", "pos", "neg"), [*keys, "criterion"], "left")
        said = F.concat(F.lit(" (for "), F.col("pos"), F.lit(", against "), F.col("neg"), F.lit(")"))
    else:
        said = F.lit("")
    line = F.concat(F.col("criterion"), F.coalesce(said, F.lit("")), F.lit(": "), F.array_join("material", " | "))
    listed = F.sort_array(F.collect_list(F.struct("criterion", line.alias("line"))))
    text = F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("prompt")
    return material.groupBy(*keys).agg(text, F.sum("n").alias("n_reviews"))


def axis_summaries(
    genuine: DataFrame, promo: DataFrame, fields: list[str], keys: list[str], fn: Callable[[str], dict], platforms: tuple[str, str] = ("instagram", "dcinside"),
    polarities: DataFrame | None = None, order: str = "id",
) -> DataFrame:
    """(keys, card, fields, n_reviews, n_asked): cards are the two platforms, ``integrated`` and ``supporter``.

    ``genuine`` and ``promo`` are rows with keys, ``platform`` and the fields' texts; ``polarities`` is (keys,
    platform, criterion, value), whose counts go into the prompts. A platform without material, and a key
    for which only one platform answered, cost no call. Promoted rows are summed up apart. Other platforms
    have no card. No evidence at all gives no rows.
    """
    own = [*keys, "platform"]
    stats = every = None
    if polarities is not None:
        stats = _counts(polarities, [*own, "criterion"])
        every = _counts(polarities, [*keys, "criterion"])
    asked = prompts(genuine.where(F.col("platform").isin(*platforms)), fields, own, stats, order)
    sources = hooks.sectionize(asked, [*own, "n_reviews"], fn, fields).withColumnRenamed("platform", "card")
    said = F.when(F.coalesce(*fields).isNotNull(), F.to_json(F.struct(*fields)))
    pick = lambda p, c: F.max(F.when(F.col("card") == p, c))
    both = sources.groupBy(*keys).agg(*[pick(p, said).alias(f"_{i}") for i, p in enumerate(platforms)], F.sum("n_reviews").alias("n_reviews"))
    both = both.where("_0 is not null and _1 is not null")
    parts = [F.lit(f"{platforms[0]}: "), F.col("_0"), F.lit(f"\n{platforms[1]}: "), F.col("_1")]
    if every is not None:
        count = F.concat("criterion", F.lit(" "), "pos", F.lit(":"), "neg")
        counts = every.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(count)), ", ").alias("_counts"))
        both = both.join(counts, keys, "left")
        parts += [F.lit("\ncounts: "), F.coalesce("_counts", F.lit(""))]
    integrated = hooks.sectionize(both.select(*keys, "n_reviews", F.concat(*parts).alias("prompt")), [*keys, "n_reviews"], fn, fields)
    supporter = hooks.sectionize(prompts(promo, fields, keys, None, order), [*keys, "n_reviews"], fn, fields)
    out = sources
    for name, part in ((INTEGRATED, integrated), (SUPPORTER, supporter)):
        out = out.unionByName(part.withColumn("card", F.lit(name)))
    return out.select(*keys, "card", *fields, "n_reviews", "n_asked")


def _counts(polarities: DataFrame, keys: list[str]) -> DataFrame:
    return polarities.groupBy(*keys).agg(F.count_if(F.col("value") == "pos").alias("pos"), F.count_if(F.col("value") == "neg").alias("neg"))


def cards(summaries: DataFrame, markets: DataFrame, keys: list[str], fields: list[str], market: list[str]) -> DataFrame:
    """(keys, card, criterion, scope, verdict, place): the lines of every card of every key, in the criteria's order.

    ``summaries`` are rows of ``axis_summaries`` for the product axis and ``markets`` for the market's orders,
    whose keys are ``market``; a criterion of market scope shows the market's line where there is one. Blank
    lines are left out; a card that only the market has is there as well.
    """
    cells = lambda df, by: consolidate.unpivoted(df, {f: F.col(f) for f in fields if f in df.columns}, [*by, "card"]).withColumnRenamed("value", "verdict")
    product = cells(summaries, keys)
    scope = F.when(F.col("criterion").isin(*L.MARKET_CRITERIA), "market").otherwise("product")
    shared = cells(markets, market).where(F.col("criterion").isin(*L.MARKET_CRITERIA)).withColumnRenamed("verdict", "_market")
    known = summaries.select(*keys).distinct()
    shared = known.join(shared, market)
    both = product.join(shared, [*keys, "card", "criterion"], "full")
    verdict = F.when(F.trim("_market") != "", F.col("_market")).otherwise(F.col("verdict"))
    place = F.array_position(F.array(*map(F.lit, fields)), F.col("criterion"))
    lines = both.select(*keys, "card", "criterion", scope.alias("scope"), verdict.alias("verdict"), place.alias("place"))
    return lines.where(F.trim("verdict") != "")


@dataclass
class Refresh:
    """What is stale, what it costs, and the next summaries (None in a dry run)."""

    stale: DataFrame
    n: int
    cost: float
    summaries: DataFrame | None


def refresh(
    summaries: DataFrame, current: DataFrame, keys: list[str], generate: Callable[[DataFrame], DataFrame], usd_per_call: float, calls: float = 3.3,
    model: str | None = None, before: Column | None = None, min_delta: int = 3, min_evidence: int = 3, dry_run: bool = True,
) -> Refresh:
    """Only summaries whose evidence has moved are made again; finding them is free, making them is not.

    ``current`` is (keys, n_reviews) of what there is now: products of the official list only, and orders
    counted by folded pieces. A dry run, the default, says what is stale and what it would cost. Otherwise
    ``generate`` gets the stale keys and returns their new rows, which replace the old ones.
    """
    stale = merge.stale_summaries(summaries.select(*keys, *[c for c in ("n_reviews", "model", "generated_at") if c in summaries.columns]).distinct(),
                                  current, keys, model, before, min_delta, min_evidence)
    n = stale.count()
    cost = round(n * calls * usd_per_call, 4)
    if dry_run or not n:
        return Refresh(stale, n, cost, None if dry_run else summaries)
    return Refresh(stale, n, cost, merge.replace_by_key(summaries, generate(stale.select(*keys)), keys))
