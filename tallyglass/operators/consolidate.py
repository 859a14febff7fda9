"""Per-source aggregation that never averages sources together.

Counts come back unrounded, as numerators and denominators.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.functions import lexicon as L
from tallyglass.functions.numbers import clean_url

SENTIMENT_COUNTS = ("pos", "neu", "neg")


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def per_source_sentiment(df: DataFrame, platform: str = "platform", sentiment: str = "sentiment") -> DataFrame:
    """A1: pos, neu, neg, n and pos - neg of each platform; rows without a known sentiment do not count."""
    known = df.where(F.col(sentiment).isin(*SENTIMENT_COUNTS))
    counts = [count_if(F.col(sentiment) == s).alias(s) for s in SENTIMENT_COUNTS]
    out = known.groupBy(F.col(platform).alias("platform")).agg(*counts, F.count("*").alias("n"))
    return out.withColumn("balance", F.col("pos") - F.col("neg"))


def sentiment_gap(df: DataFrame, left: str, right: str, keys: list[str] = (), **columns: str) -> DataFrame:
    """A2: net of ``left`` less net of ``right``; NULL unless both sources have rows."""
    platform, sentiment = columns.get("platform", "platform"), columns.get("sentiment", "sentiment")
    known = df.where(F.col(sentiment).isin(*SENTIMENT_COUNTS))
    score = F.when(F.col(sentiment) == "pos", 1).when(F.col(sentiment) == "neg", -1).otherwise(0)

    def net(name: str) -> Column:
        here = F.col(platform) == name
        return F.sum(F.when(here, score)).cast("double") / F.sum(F.when(here, 1)).cast("double")

    out = known.groupBy(*keys).agg(net(left).alias("left_net"), net(right).alias("right_net"))
    return out.withColumn("gap", F.col("left_net") - F.col("right_net"))


def unpivoted(df: DataFrame, fields: Mapping[str, str | Column], ids: list[str], name: str = "criterion") -> DataFrame:
    """One row per id and named value."""
    pairs = F.array(*[F.struct(F.lit(k).alias(name), (F.col(v) if isinstance(v, str) else v).alias("value")) for k, v in fields.items()])
    return df.select(*ids, F.posexplode(pairs).alias("place", "_p")).select(*ids, "place", f"_p.{name}", "_p.value")


def top_points(long: DataFrame, polarity: str, k: int = 3, platform: str = "platform", point: str = "criterion") -> DataFrame:
    """A3: the k most frequent points of a polarity on each platform; ties in order of first appearance, then name."""
    hits = long.where(F.col("value") == polarity)
    counts = hits.groupBy(platform, point).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    order = Window.partitionBy(platform).orderBy(F.desc("n"), "first", point)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first")


def divergence(df: DataFrame, official: str, perceived: str, keys: list[str]) -> DataFrame:
    """A4: rows with a perceived value in which no word of the official one occurs, per key: n_divergent, n."""
    words = F.filter(F.split(F.col(official), r"[\s/]+"), lambda w: w != "")
    apart = ~F.exists(words, lambda w: F.contains(F.col(perceived), w))
    usable = df.where((F.size(words) > 0) & (F.trim(perceived) != ""))
    return usable.groupBy(*keys).agg(count_if(apart).alias("n_divergent"), F.count("*").alias("n"))


def fold_first(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """A5: the first row of each piece; a row with a NULL in its key never folds."""
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    first = df.where(whole).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return first.unionByName(df.where(~whole))


def criterion_stats(long: DataFrame, platform: str = "platform", criterion: str = "criterion") -> DataFrame:
    """Counts per criterion and platform, with a total row (platform NULL) per criterion.

    ``only_source`` names the platform if just one has the criterion; ``split`` says that the total
    holds both polarities. Market-scope criteria are to be folded (A5) before.
    """
    known = long.where(F.col("value").isin(*SENTIMENT_COUNTS)).select(
        F.col(criterion).alias("criterion"), F.col(platform).alias("platform"), "value"
    )
    c, p = F.col("criterion"), F.col("platform")
    stats = known.groupingSets([[c, p], [c]], c, p).agg(
        F.grouping("platform").alias("is_total"), *[count_if(F.col("value") == s).alias(s) for s in SENTIMENT_COUNTS],
        F.count("*").alias("n"), F.count_distinct("platform").alias("n_sources"), F.min("platform").alias("any_source"),
    )
    total = F.col("is_total") == 1
    return stats.select(
        "criterion", "platform", F.col("is_total").cast("int").alias("is_total"), *SENTIMENT_COUNTS, "n",
        F.when(total & (F.col("n_sources") == 1), F.col("any_source")).alias("only_source"),
        F.when(total, (F.col("pos") > 0) & (F.col("neg") > 0)).alias("split"),
    )


def counts_material(stats: DataFrame, platform: str | None = None) -> DataFrame:
    """Criterion, pos, neg where mentioned: of one platform, or in total."""
    own = stats.where("is_total = 1") if platform is None else stats.where((F.col("platform") == platform) & (F.col("is_total") == 0))
    return own.where("n > 0").select("criterion", "pos", "neg")


def source_material(df: DataFrame, fields: list[str], keys: list[str], order: str = "id") -> DataFrame:
    """Per key and attribute, the filled blocks in order; attributes without any are left out."""
    long = unpivoted(df, {f: F.col(f).cast("string") for f in fields}, [*keys, order])
    filled = long.where(F.trim("value") != "")
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, "value"))), lambda x: x["value"])
    return filled.groupBy(*keys, "criterion").agg(listed.alias("material"), F.count("*").alias("n"))


def consolidated(reviews: DataFrame, review_class: str = "review_class") -> tuple[DataFrame, DataFrame]:
    """Genuine and promoted reviews apart; only the genuine ones are aggregated."""
    promo = F.col(review_class).eqNullSafe("promo")
    return reviews.where(~promo), reviews.where(promo)


def order_view(reviews: DataFrame, market: str, key: list[str], order: list[str]) -> DataFrame:
    """A10: order criteria of a market over folded pieces: n_orders and the polarity counts per platform."""
    folded = fold_first(reviews.where(F.col("market") == market), key, order)
    stats = per_source_sentiment(folded)
    n = folded.groupBy("platform").agg(F.count("*").alias("n_orders"))
    return n.join(stats, "platform", "left")


def evidence_groups(df: DataFrame, url: str = "url", piece: str = "piece", is_comment: str = "is_comment", order: str = "id") -> DataFrame:
    """Evidence by address: pieces (each once), posts, comments, in order of first appearance."""
    usable = df.withColumn("_url", clean_url(F.col(url))).where("_url is not null")
    per_piece = usable.groupBy("_url", piece).agg(
        F.min(order).alias("first"), F.max(F.col(is_comment).cast("int")).alias("comment")
    )
    return per_piece.groupBy(F.col("_url").alias("url")).agg(
        F.count("*").alias("n_pieces"),
        count_if(F.col("comment") == 0).alias("n_posts"),
        count_if(F.col("comment") == 1).alias("n_comments"),
        F.min("first").alias("first"),
    )


def axis_payload(products: DataFrame, markets: DataFrame, keys: list[str], scope: Column) -> DataFrame:
    """A market-scope criterion shows the market's verdict if there is one, else the product's."""
    both = products.join(markets.withColumnRenamed("verdict", "market_verdict"), keys, "left")
    picked = F.when((scope == "market") & F.col("market_verdict").isNotNull(), F.col("market_verdict"))
    return both.withColumn("verdict", picked.otherwise(F.col("verdict"))).drop("market_verdict")


def summary_rows(payload: DataFrame) -> DataFrame:
    """Criteria in their fixed order; rows with a blank verdict are left out."""
    place = F.array_position(F.array(*map(F.lit, L.CRITERIA)), F.col("criterion"))
    return payload.where(F.trim("verdict") != "").withColumn("place", place).orderBy("place")


def by_criterion(stats: DataFrame, left: str, right: str) -> DataFrame:
    """A criterion's n on two platforms and in all, with its scope."""
    own = lambda p: F.sum(F.when((F.col("platform") == p) & (F.col("is_total") == 0), F.col("n")))
    all_ = F.sum(F.when(F.col("is_total") == 1, F.col("n")))
    zero = F.lit(0).cast("long")
    scope = F.when(F.col("criterion").isin(*L.MARKET_CRITERIA), "market").otherwise("product")
    return stats.groupBy("criterion").agg(
        F.coalesce(own(left), zero).alias("n_left"), F.coalesce(own(right), zero).alias("n_right"),
        F.coalesce(all_, zero).alias("n_all"),
    ).withColumn("scope", scope)
