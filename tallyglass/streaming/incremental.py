"""Incremental cuts and micro-batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyglass.functions import lexicon as L
from tallyglass.functions.rules import above_watermark
from tallyglass.operators.merge import insert_ignore
from tallyglass.storage import stored
from tallyglass.streaming.sink import BatchTable


def fresh(pieces: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Pieces whose key was not seen; pieces with a NULL in the key are always fresh."""
    return pieces.join(seen.select(*key).distinct(), key, "left_anti")


def fresh_with_context(pieces: DataFrame, seen: DataFrame, key: list[str], thread: str, is_post: str) -> DataFrame:
    """Fresh pieces, and the seen posts of threads that still have fresh pieces (is_context)."""
    new = fresh(pieces, seen, key)
    old_posts = pieces.where(F.col(is_post)).join(seen.select(*key).distinct(), key, "left_semi")
    context = old_posts.join(new.select(thread).distinct(), thread, "left_semi")
    return new.withColumn("is_context", F.lit(False)).unionByName(context.withColumn("is_context", F.lit(True)).select(*new.columns, "is_context"))


def missing_markets(kb: DataFrame, specs: DataFrame) -> DataFrame:
    """Markets of the knowledge base without any specs row."""
    return kb.join(specs.select(F.col("market").alias("market_word")).distinct(), "market_word", "left_anti")


def watermarks(seen: DataFrame, anchor: list[str], no: str, slack: int = L.WATERMARK_SLACK) -> DataFrame:
    """Per anchor the largest numeric thread number less the slack."""
    value = F.when(F.col(no).rlike("^[0-9]+$"), F.col(no).cast("long"))
    return seen.groupBy(*anchor).agg((F.max(value) - slack).alias("watermark"))


def above(pieces: DataFrame, marks: DataFrame, anchor: list[str], no: Column, revisit: DataFrame | None = None, thread: str = "thread_no") -> DataFrame:
    """Pieces above their anchor's mark; an anchor without history passes whole; threads to revisit pass too."""
    rows = pieces.join(marks, anchor, "left").withColumn("_above", above_watermark(no, F.col("watermark")))
    if revisit is not None:
        back = revisit.select(thread).distinct().withColumn("_back", F.lit(True))
        rows = rows.join(back, thread, "left").withColumn("_above", F.col("_above") | F.coalesce("_back", F.lit(False))).drop("_back")
    return rows.where("_above").drop("_above", "watermark")


def fresh_marked(pieces: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """``pieces`` with ``is_seen``: whether the key was seen; a key with a NULL never was."""
    old = seen.select(*key).distinct().withColumn("_old", F.lit(True))
    return pieces.join(old, key, "left").withColumn("is_seen", F.coalesce("_old", F.lit(False))).drop("_old")


def with_context(marked: DataFrame, thread: str, is_post: str) -> DataFrame:
    """J10b over marked pieces: the fresh ones, and the seen posts of threads that have fresh ones."""
    new = marked.where(~F.col("is_seen"))
    posts = marked.where(F.col("is_seen") & F.col(is_post))
    return new.unionByName(posts.join(new.select(thread).distinct(), thread, "left_semi").select(*new.columns))


def ingest_stream(stream: DataFrame, table: str, key: list[str], order: list[str], checkpoint: str,
                  prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """What is new of each micro-batch becomes a batch of the ``BatchTable`` at ``table``, exactly once.

    A batch is named by the checkpoint and its number. ``prepare`` may cost money: its rows are stored before
    they are used, and a batch that is committed already is not prepared again. A batch that is replayed
    because it was not committed is compared with the other batches, not with itself, and takes its own
    place: rows with a NULL in the key, which are always new, come once.
    """
    stem = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def commit(batch: DataFrame, n: int) -> None:
        name = f"{stem}-{n}"
        if name in BatchTable(batch.sparkSession, table, batch.schema).commits():
            return
        rows = stored(prepare(batch), "prepared")
        into = BatchTable(batch.sparkSession, table, rows.schema)
        into.write(insert_ignore(into.read(without=name), rows, key, order), name)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
