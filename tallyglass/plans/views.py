"""Read queries and composites over the three tables of the review domain.

``specs``, ``reviews`` and ``summaries`` are DataFrames in the shapes of ``schema``; every function
returns DataFrames, so a caller decides what to collect.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import lexicon as L
from tallyglass.functions.numbers import clean_url, embed_url, piece_key
from tallyglass.functions.text import display_evidence, excerpt, trimmed
from tallyglass.operators import consolidate, hooks, linking, merge

PIECE = ["platform", "url", "piece"]


def platform_of(source: str = "source") -> Column:
    """The analytic platform of a storage source; unknown sources are their own."""
    names = F.create_map(*[F.lit(x) for pair in L.PLATFORM_OF.items() for x in pair])
    return F.coalesce(names[F.col(source)], F.col(source), F.lit("unknown"))


def records(reviews: DataFrame, market: str | None, product: str | None = None) -> DataFrame:
    """A market's (and product's) reviews with platform and piece key parts; without a market, of all."""
    rows = reviews if market is None else reviews.where(F.col("market") == market)
    if product is not None:
        rows = rows.where(F.col("product") == product)
    return rows.withColumns(
        {
            "platform": platform_of(), "url": F.col("source_ref.url"),
            "piece": F.coalesce("source_ref.comment_no", "source_ref.shortcode"),
        }
    )


def attribute_rows(rows: DataFrame) -> DataFrame:
    """Sentiment of every criterion: product criteria as they are, order criteria folded to pieces first."""
    product = {c: f"{a}_sentiment" for c, a in L.CRITERIA.items() if c not in L.MARKET_CRITERIA and f"{a}_sentiment" in rows.columns}
    market = {c: f"{a}_sentiment" for c, a in L.CRITERIA.items() if c in L.MARKET_CRITERIA and f"{a}_sentiment" in rows.columns}
    long = consolidate.unpivoted(rows, product, ["id", "platform"])
    if market:
        folded = consolidate.fold_first(rows, PIECE, ["id"])
        long = long.unionByName(consolidate.unpivoted(folded, market, ["id", "platform"]))
    return long


@dataclass
class View:
    """A consolidated view: sources apart, with the gap between them."""

    spec: DataFrame
    sentiment: DataFrame
    gap: DataFrame
    stats: DataFrame
    pros: DataFrame
    cons: DataFrame
    divergence: DataFrame
    evidence: DataFrame
    promo: DataFrame
    summaries: DataFrame | None = None


def consolidated_for(specs: DataFrame, reviews: DataFrame, summaries: DataFrame, market: str, product: str | None = None) -> View:
    """The view of a product, or of a whole market when ``product`` is None."""
    spec = specs.where(F.col("market") == market)
    if product is not None:
        spec = spec.where(F.col("product") == product)
    genuine, promo = consolidate.consolidated(records(reviews, market, product))
    long = attribute_rows(genuine)
    overall = genuine.withColumn("sentiment", F.col("overall_sentiment"))
    perceived = genuine.join(spec.select("market", "product", F.col("scent").alias("official")), ["market", "product"])
    groups = genuine.withColumn("is_comment", F.col("source_ref.comment_no").isNotNull())
    own = summaries.where((F.col("market") == market) & F.col("product").eqNullSafe(F.lit(product)))
    return View(
        spec=spec,
        sentiment=consolidate.per_source_sentiment(overall),
        gap=consolidate.sentiment_gap(overall, "instagram", "dcinside"),
        stats=consolidate.criterion_stats(long),
        pros=consolidate.top_points(long, "pos"),
        cons=consolidate.top_points(long, "neg"),
        divergence=consolidate.divergence(perceived, "official", "perceived_scent", ["market"]),
        evidence=consolidate.evidence_groups(groups),
        promo=promo,
        summaries=own,
    )


def order_view_for(reviews: DataFrame, market: str) -> DataFrame:
    """Orders of a market, each piece once."""
    rows = records(reviews, market).withColumn("sentiment", F.col("shipping_cs_sentiment"))
    genuine, _ = consolidate.consolidated(rows)
    return consolidate.order_view(genuine, market, PIECE, ["id"])


def list_reviews(reviews: DataFrame, market: str | None, product: str | None, sort: str = "", limit: int = 100) -> DataFrame:
    """Display rows of the review list: each piece once, then the limit over all platforms together."""
    rows = records(reviews, market, product).withColumns(
        {"sentiment": F.col("overall_sentiment"), "key": F.to_json(piece_key(F.col("platform"), F.col("url"), F.col("piece")))}
    )
    top = merge.review_list(rows, "key", merge.review_order(sort), limit)
    return top.select(
        "id", "platform", "product", clean_url(F.col("url")).alias("url"), embed_url(F.col("url")).alias("embed"),
        display_evidence(F.col("evidence")).alias("evidence"), excerpt(F.col("body")).alias("excerpt"), "sentiment", "likes", "views",
    )


@dataclass
class Page:
    market: str | None
    view: View | None
    rows: DataFrame | None
    reviews: DataFrame
    counts: DataFrame
    meta: DataFrame | None


def resolve_market(kb: DataFrame, mention: str | None) -> str | None:
    """The canonical word of an unambiguous mention; any other text as it is; None for a blank one."""
    if not (mention or "").strip():
        return None
    spark = kb.sparkSession
    one = spark.createDataFrame([(mention,)], "m string")
    found = linking.resolve(one, F.col("m"), kb, "x").first()  # one row
    return found["x_market"] or mention


def page(kb: DataFrame, specs: DataFrame, reviews: DataFrame, summaries: DataFrame, market: str | None = None, product: str | None = None, limit: int = 100) -> Page:
    """What a product page shows; without market and product there is nothing to show.

    The product view needs both; the market's order criteria come from its own summary where it has one.
    ``counts`` are the listed reviews per platform; ``meta`` says by what and from how many rows the
    product's and the market's summaries were made, which are different populations.
    """
    if not (market or "").strip() and not (product or "").strip():
        raise ValueError("market or product is needed")
    word = resolve_market(kb, market)
    view = consolidated_for(specs, reviews, summaries, word, product) if word and product else None
    rows = meta = None
    if word:
        cells = lambda p: summaries.where((F.col("market") == word) & F.col("product").eqNullSafe(F.lit(p))).select(
            F.explode("cells").alias("criterion", "verdict")
        )
        scope = F.when(F.col("criterion").isin(*L.MARKET_CRITERIA), "market").otherwise("product")
        rows = consolidate.summary_rows(consolidate.axis_payload(cells(product), cells(None), ["criterion"], scope))
    listed = list_reviews(reviews, word, (product or "").strip() or None, limit=limit)
    if word:
        own = summaries.where((F.col("market") == word) & (F.col("product").isNull() | F.col("product").eqNullSafe(F.lit(product))))
        meta = own.select(F.when(F.col("product").isNull(), "market").otherwise("product").alias("scope"), "generated_at", "model", "n_reviews")
    return Page(word, view, rows, listed, listed.groupBy("platform").agg(F.count("*").alias("n")), meta)


def generate_summaries(reviews: DataFrame, market: str, products: bool, fn: Callable[[str], dict], min_rows: int = 1) -> DataFrame:
    """One summary per product (or one of the market's orders) and platform, from its material alone.

    Raises if there is no evidence at all, as an empty summary must not be stored.
    """
    fields = L.PRODUCT_ATTRIBUTES if products else L.ORDER_ATTRIBUTES
    genuine, _ = consolidate.consolidated(records(reviews, market))
    keys = ["market", "product", "platform"] if products else ["market", "platform"]
    material = consolidate.source_material(genuine, [f for f in fields if f in genuine.columns], keys, "id")
    if material.limit(min_rows).count() < min_rows:
        raise ValueError(f"no evidence for {market}")
    line = F.concat(F.col("criterion"), F.lit(": "), F.array_join("material", " | "))
    prompts = material.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("criterion", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"),
        F.sum("n").alias("n_reviews"),
    )
    return hooks.sectionize(prompts, [*keys, "n_reviews"], fn, fields).drop("n_asked")


def review_queue(specs: DataFrame, overlay: DataFrame) -> DataFrame:
    """Specs with open fields, by market and product."""
    fields = ["scent", "base_combo", "slime_type", "official_texture"]
    return merge.review_queue(specs, overlay, ["market", "product"], fields).orderBy("market", "product")


def label(word: str = "market") -> Column:
    """Display form of a market name."""
    return trimmed(F.col(word))
