"""Threads: grouping, batching and inheritance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.functions import lexicon as L
from tallyglass.functions.rules import is_low_quality


def thread_groups(pieces: DataFrame, thread: str, is_post: str, batch: int = L.THREAD_BATCH) -> DataFrame:
    """Per thread ('' for orphans): n_pieces, n_posts and how many model calls it takes."""
    key = F.coalesce(F.col(thread).cast("string"), F.lit("")).alias("thread")
    out = pieces.groupBy(key).agg(F.count("*").alias("n_pieces"), F.sum(F.col(is_post).cast("int")).cast("long").alias("n_posts"))
    return out.withColumn("n_calls", F.ceil(F.col("n_pieces") / batch).cast("long"))


def thread_chunks(pieces: DataFrame, thread: str, order: str, is_post: str, batch: int = L.THREAD_BATCH) -> DataFrame:
    """Every piece with its chunk (from 0) and place in it; from the second chunk on the post comes first
    again as context (is_context), and what is made of it there is thrown away."""
    rank = F.row_number().over(Window.partitionBy(thread).orderBy(order)) - 1
    rows = pieces.withColumn("chunk", F.floor(rank / batch).cast("long")).withColumn("place", (rank % batch + 1).cast("long"))
    rows = rows.withColumn("is_context", F.lit(False))
    later = rows.where("chunk > 0").select(thread, "chunk").distinct()
    posts = rows.where(F.col(is_post)).drop("chunk", "place", "is_context")
    again = posts.join(later, thread).withColumn("place", F.lit(0).cast("long")).withColumn("is_context", F.lit(True))
    return rows.unionByName(again.select(*rows.columns))


def inherit_market(pieces: DataFrame, thread: str, is_post: str, market: str, order: str) -> DataFrame:
    """A piece without a market takes the post's (never a comment's); ``inherited`` says so."""
    w = Window.partitionBy(thread).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.first(F.when(F.col(is_post), F.col(market)), ignorenulls=True).over(w)
    fill = F.col(market).isNull() & own.isNotNull()
    return pieces.withColumn("inherited", fill).withColumn(market, F.coalesce(F.col(market), own))


def candidates(posts: DataFrame, comments: DataFrame, min_len: int = 8) -> DataFrame:
    """Posts and their comments (array of (no, text)) as pieces; ``ordinal`` is the place before filtering."""
    p = posts.select("thread_no", F.lit("post").alias("type"), F.lit(None).cast("string").alias("comment_no"),
                     F.lit(0).alias("ordinal"), "text")
    c = comments.select("thread_no", F.posexplode("comments").alias("pos", "c"))
    c = c.select("thread_no", F.lit("comment").alias("type"), F.col("c.no").alias("comment_no"), (F.col("pos") + 1).alias("ordinal"), F.col("c.text").alias("text"))
    return p.unionByName(c).where(~is_low_quality(F.col("text"), min_len))


def prompt_blocks(chunks: DataFrame, thread: str, text: str) -> DataFrame:
    """The numbered block of each chunk."""
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.coalesce(F.col(text), F.lit("")))
    items = F.sort_array(F.collect_list(F.struct("place", line.alias("line"))))
    return chunks.groupBy(thread, "chunk").agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("block"))
