"""Append-only raw log (S12 to S14, S17, A19, T11, G2, G5): one row per item of a run, latest capture wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.functions.text import hashtag_key, safe_key
from tallyglass.operators.merge import latest_items

#: A run and its items; an empty run is one row with item NULL, so that it is on record.
SCHEMA = "actor string, requested string, scraped_at string, usage_usd double, note string, pos int, item string"


def save_run(items: DataFrame, root: str, kind: str, key: str, actor: str, scraped_at: str, requested: str = "{}",
             usage_usd: float | None = None, note: str | None = None) -> None:
    """Append a run. ``items`` has (pos, item as JSON text)."""
    spark = items.sparkSession
    head = [F.lit(x).cast(t).alias(n) for n, t, x in (
        ("actor", "string", actor), ("requested", "string", requested), ("scraped_at", "string", scraped_at),
        ("usage_usd", "double", usage_usd), ("note", "string", note))]
    run = spark.range(1).select(*head)
    rows = F.broadcast(run).join(items.select("pos", "item"), F.lit(True), "left")  # the run is one row
    out = rows.withColumns({"kind": F.lit(kind), "key": F.lit(safe_key(key))})
    out.write.mode("append").partitionBy("kind", "key").option("ignoreNullFields", "false").json(root)


def load_runs(spark: SparkSession, root: str, kind: str | None = None, key: str | None = None) -> DataFrame:
    """All rows of the log, or of one kind and key (pruned by folder); unreadable lines are left in ``_corrupt``."""
    df = spark.read.schema(SCHEMA + ", kind string, key string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(root)
    df = df.withColumn("path", F.col("_metadata.file_path"))
    if kind is not None:
        df = df.where(F.col("kind") == kind)
    if key is not None:
        df = df.where(F.col("key") == safe_key(key))
    return df


def latest(runs: DataFrame, per_key: bool = True) -> DataFrame:
    """Newest capture of each item (by its own id); per kind and key, or over all."""
    id = F.coalesce(*[F.nullif(F.get_json_object("item", f"$.{c}"), F.lit("")) for c in ("shortCode", "shortcode", "id", "url")])
    rows = runs.where("item is not null and _corrupt is null").withColumn("item_id", id)
    return latest_items(rows, "item_id", ["scraped_at", "path", "pos"], ["kind", "key"] if per_key else [])


def newest(runs: DataFrame, path: str = "$.timestamp") -> DataFrame:
    """Newest item time of each kind and key; ISO texts compare in time order."""
    return runs.groupBy("kind", "key").agg(F.max(F.get_json_object("item", path)).alias("newest"))


def split_by_tag(items: DataFrame, requested: list[str]) -> DataFrame:
    """Items under each requested tag they carry, the rest under ``_unmatched``; cost shared by rows.

    ``items`` has (pos, item, tags, usage_usd) with usage_usd that of the whole run.
    """
    keys = F.array_distinct(F.transform("tags", hashtag_key))
    wanted = F.array(*[hashtag_key(F.lit(t)) for t in requested])
    hit = F.array_intersect(keys, wanted)
    out = items.withColumn("key", F.explode(F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit("_unmatched")))))
    per_key = out.groupBy("key").agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())  # one row per requested tag
    cost = per_key.select("key", (F.col("_n") / total).alias("cost_share"))
    return out.join(F.broadcast(cost), "key").withColumn("key_usage_usd", F.col("usage_usd") * F.col("cost_share"))
