"""Social posts (S6 to S11, S20, R19) and fixtures as DataFrames of pieces."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions.rules import first_marker, is_low_quality
from tallyglass.functions.text import hashtag_key, hashtags, owner_from_url
from tallyglass.operators.merge import latest_items
from tallyglass.storage import stored

log = logging.getLogger(__name__)

ITEM = (
    "id string, shortCode string, url string, caption string, ownerUsername string, hashtags array<string>, "
    "timestamp string, likesCount int, commentsCount int, inputUrl string"
)
PROFILE = f"username string, latestPosts array<struct<{ITEM.replace(' string', ': string').replace(' int', ': int').replace(' array', ': array')}>>"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Scraper output, a JSON array per file, with an explicit schema."""
    return spark.read.schema(ITEM).option("multiLine", True).json(path)


def to_pieces(items: DataFrame, hashtag: str | None = None) -> DataFrame:
    """Social items as pieces: text, url, platform, posted_at and the known meta keys; short captions go.

    An item is known by its shortCode, else by its address; of equal ones the newest stays (by time, then
    caption and owner), and items with neither are all kept.
    """
    marker = first_marker(F.col("caption"))
    key = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("shortCode", "url")])
    rows = items.where(~is_low_quality(F.col("caption"))).withColumn("_item", key)
    rows = latest_items(rows, "_item", ["timestamp", "caption", "ownerUsername", "url", "likesCount", "commentsCount"])
    return rows.select(
        F.col("caption").alias("text"), "url", F.lit("instagram").alias("platform"), F.col("timestamp").alias("posted_at"),
        F.col("ownerUsername").alias("owner_username"), F.coalesce("hashtags", hashtags(F.col("caption"))).alias("hashtags"),
        F.lit(hashtag).cast("string").alias("hashtag"), F.col("likesCount").alias("likes"), F.col("commentsCount").alias("comments"),
        F.col("shortCode").alias("shortcode"), F.when(marker.isNotNull(), "promo").otherwise("genuine").alias("review_class"),
        marker.alias("promo_marker"),
    )


def matching(items: DataFrame, tags: list[str]) -> DataFrame:
    """Items that carry one of the tags, compared by their keys."""
    wanted = F.array(*[hashtag_key(F.lit(t)) for t in tags])
    return items.where(F.arrays_overlap(F.transform(F.coalesce("hashtags", hashtags(F.col("caption"))), hashtag_key), wanted))


def profile_posts(items: DataFrame) -> DataFrame:
    """Posts of a profile object, or the item itself if it is a post; owner from the post or the profile."""
    own = F.struct(*[c for c in items.columns if c not in ("username", "latestPosts")])
    posts = F.when(F.size("latestPosts") > 0, F.col("latestPosts")).otherwise(F.array(own))
    out = items.select("username", F.explode(posts).alias("p")).select("username", "p.*")
    return out.withColumn("ownerUsername", F.coalesce("ownerUsername", "username")).drop("username")


def seller_posts(items: DataFrame, handle: Column | None = None, per_handle: int | None = None) -> DataFrame:
    """Posts of sellers: owner is the item's, else the handle, else the account of the input address."""
    owner = F.coalesce("ownerUsername", handle if handle is not None else F.lit(None), owner_from_url(F.col("inputUrl")))
    rows = items.where(~is_low_quality(F.col("caption"))).withColumn("owner_username", owner)
    if per_handle is not None:
        from pyspark.sql.window import Window

        r = F.row_number().over(Window.partitionBy("owner_username").orderBy(F.desc("timestamp"), "shortCode", "url", "id"))
        rows = rows.withColumn("_r", r).where(F.col("_r") <= per_handle).drop("_r")
    return rows


def layer1_specs(fixture: DataFrame, kb: DataFrame) -> DataFrame:
    """Official products of a fixture (handle, products) joined to the market of its handle."""
    handles = kb.select("market_word", F.explode(F.array_compact(F.concat(F.array("handle"), F.coalesce("handles_alt", F.array())))).alias("_h"))
    dim = handles.groupBy(F.lower("_h").alias("_h")).agg(F.min("market_word").alias("market"))
    rows = fixture.select(F.lower("handle").alias("_h"), F.explode("products").alias("p")).join(dim, "_h")
    return rows.select("market", "p.*").withColumnRenamed("product_name", "product")


def collect_all(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, DataFrame]:
    """The union of all sources, and a report (source, n_rows, error) with a row for each of them.

    Each source runs as a job of its own into a stored part, so one that fails, as its plan is made or as a
    task reads it, leaves nothing of itself behind and stops no other; its error is in the report. A
    source that returns None is not written yet and is skipped without an error. No part gives None.
    """
    out: DataFrame | None = None
    report: list[tuple[str, int | None, str | None]] = []
    for name, make in sources.items():
        try:
            made = make()
            part = None if made is None else stored(made.withColumn("collected_from", F.lit(name)), "source")
        except Exception as error:  # noqa: BLE001  one source must not stop the others
            log.warning("source %s failed: %s", name, error)
            report.append((name, None, str(error).strip().splitlines()[0][:300] if str(error).strip() else type(error).__name__))
            continue
        report.append((name, 0 if part is None else part.count(), None))
        if part is not None:
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, spark.createDataFrame(report, "source string, n_rows long, error string")
