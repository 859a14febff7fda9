"""Relevance gate: signals, verdicts, ranking and the budget in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.functions import lexicon as L
from tallyglass.functions.numbers import dot, normalised
from tallyglass.functions.rules import has_firsthand, is_meta, is_negative, is_question
from tallyglass.functions.text import trimmed, text_of
from tallyglass.operators.running import running


def max_cosine(chunks: DataFrame, anchor: list[float], id: str = "id", vector: str = "embedding") -> DataFrame:
    """V3: (id, topic_score): the best cosine of a document's chunks with the anchor; no chunk gives 0 later."""
    a = normalised(F.array(*[F.lit(float(x)) for x in anchor]))
    score = dot(normalised(F.col(vector)), a)
    return chunks.groupBy(F.col(id).alias("id")).agg(F.max(score).alias("topic_score"))


def mean_vectors(chunks: DataFrame, id: str, vector: str = "embedding") -> DataFrame:
    """V4, V5: per id and dimension, the mean of the unit vectors: (id, dim, mean). Partial sums before the shuffle."""
    parts = chunks.select(F.col(id).alias("id"), F.posexplode(normalised(F.col(vector))).alias("dim", "x"))
    return parts.groupBy("id", "dim").agg(F.avg("x").alias("mean"))


def centroids(labelled: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """V5: (label, centroid) with the dimensions in order."""
    means = mean_vectors(labelled, label, vector)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda x: x["mean"])
    return means.groupBy(F.col("id").alias("label")).agg(listed.alias("centroid"))


def nearest_centroid(df: DataFrame, cents: DataFrame, id: str = "id", vector: str = "embedding") -> DataFrame:
    """V5: (id, label, score) of the nearest centroid; the smaller label wins ties.

    All centroids, one per label, go to each row as one array, so rows are neither multiplied nor shuffled.
    """
    unit = cents.select("label", normalised(F.col("centroid")).alias("c"))
    table = unit.agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("all"))  # one row
    rows = df.select(F.col(id).alias("id"), normalised(F.col(vector)).alias("v")).crossJoin(F.broadcast(table))
    scored = F.transform("all", lambda x: F.struct(dot(F.col("v"), x["c"]).alias("score"), x["label"].alias("label")))
    rows = rows.select("id", F.filter(scored, lambda x: x["score"].isNotNull()).alias("s")).where(F.size("s") > 0)
    top = F.reduce(F.slice("s", F.lit(2), F.size("s")), F.get("s", F.lit(0)), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    return rows.select("id", top.alias("top")).select("id", F.col("top.label").alias("label"), F.col("top.score").alias("score"))


def signals(df: DataFrame, text: str, probe: Column | None = None, probe_at: float = 0.5) -> DataFrame:
    """V6: adds M, Q, e_rule, e_probe, e_bucket (2: both, 1: one, 0: none), bias_hold and candidate."""
    t = F.col(text)
    meta = is_meta(t)
    prob = F.when(meta, 0.0).otherwise(F.lit(0.0) if probe is None else probe)
    df = df.withColumns({"M": meta, "Q": is_question(t), "e_rule": has_firsthand(t), "e_probe": prob,
                         "bias_hold": is_negative(t)})
    bucket = F.col("e_rule").cast("int") + (F.col("e_probe") >= probe_at).cast("int")
    return df.withColumn("e_bucket", bucket).withColumn("candidate", (F.col("e_bucket") > 0) | F.col("bias_hold"))


def verdicts(df: DataFrame, platform: str, text: str, domain_ok: Column | None = None, centroid_gate: bool = False) -> DataFrame:
    """adds keep and axis (why not) from signals and topic_score, in the fixed order of the axes."""
    conf = L.RELEVANCE[platform]
    axes = conf["drop_axes"]
    no = F.lit(False)
    low = F.coalesce("topic_score", F.lit(0.0)) < conf["tau_topic"]
    axis = (
        F.when(trimmed(text_of(F.col(text))) == "", "empty")
        .when(low if "topic" in axes else no, "topic")
        .when(~domain_ok if centroid_gate and domain_ok is not None else no, "domain")
        .when(F.col("M") if "meta" in axes and conf["mqe_axis"] else no, "meta")
        .when(~F.col("candidate") if "e_union" in axes and conf["mqe_axis"] else no, "e_union")
    )
    return df.withColumn("axis", axis).withColumn("keep", axis.isNull()).withColumn("below_tau", low)


def budget(df: DataFrame, limit: int, batch: str = "batch", pos: str = "pos", keep: str = "keep", rank: list[Column] = (), run: list[str] = ()) -> DataFrame:
    """Which rows a sequential gate would examine, keep and emit, as windows.

    Batches come in order; a batch is started while fewer than ``limit`` rows were kept before it and
    fewer than 3 x limit examined; within a batch kept rows are ranked by ``rank`` (ties by position)
    and emitted until the budget is used up. Adds examined, kept, rank, started, emitted, unprocessed.
    ``run`` names the columns of independent runs. Batches are counted first and their counts summed up in
    two passes over ranges of them, so neither one run nor a run that holds most batches is one task.
    """
    cap = L.EXAMINE_FACTOR * limit
    per_batch = df.groupBy(*run, batch).agg(F.count("*").alias("_size"))
    per_batch = running(per_batch, [batch], {"_seen": F.col("_size")}, list(run))
    own = Window.partitionBy(*run, batch)
    df = df.join(per_batch.drop("_size"), [*run, batch])
    df = df.withColumn("_e", F.col("_seen") + F.row_number().over(own.orderBy(pos)))
    df = df.withColumn("kept", F.col(keep) & (F.col("_e") <= cap))
    kept = df.groupBy(*run, batch).agg(F.sum(F.col("kept").cast("int")).alias("_k"))
    kept = running(kept, [batch], {"_prior": F.col("_k")}, list(run)).drop("_k")
    df = df.join(kept, [*run, batch])
    order = own.orderBy(F.desc("kept"), *rank, pos)
    df = df.withColumn("rank", F.when(F.col("kept"), F.row_number().over(order)))
    started = (F.col("_prior") < limit) & (F.col("_seen") < cap)
    df = df.withColumn("started", started).withColumn("examined", F.col("started") & (F.col("_e") <= cap))
    df = df.withColumn("emitted", F.col("started") & F.col("kept") & (F.col("_prior") + F.col("rank") <= limit))
    df = df.withColumn("unprocessed", F.col("started") & F.col("kept") & ~F.col("emitted"))
    return df.drop("_e", "_seen", "_prior")


def gate_counters(df: DataFrame, limit: int) -> DataFrame:
    """One row of counters of a finished gate."""
    n = lambda c: F.sum(c.cast("int")).cast("long")
    out = df.agg(
        n(F.col("examined")).alias("examined"), n(F.col("emitted")).alias("relevant"),
        n(F.col("unprocessed")).alias("unprocessed"),
        *[n(F.col("examined") & (F.col("axis") == a)).alias(f"dropped_{a}") for a in ("topic", "domain", "meta", "e_union")],
        n(F.col("kept") & F.col("below_tau")).alias("kept_below_tau"),
        n(F.col("kept") & (F.col("e_bucket") == 0)).alias("kept_low_e"),
    )
    return out.withColumn("shortfall", F.when(F.col("examined") > 0, F.greatest(limit - F.col("relevant"), F.lit(0))))
