"""Ingestion as one plan (section 3.1, R20, R21): collect, gate, cut, extract, link, render, append."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyglass import schema
from tallyglass.functions import rules
from tallyglass.functions.lexicon import THREAD_BATCH
from tallyglass.functions.numbers import dc_post_id, filled_score, held_fingerprint, source_ref, thread_no
from tallyglass.functions.text import hashtags, is_all_jamo, product_hashtags, render_review, squeezed, tag_key, tokens
from tallyglass.operators import gate, hooks, linking, maintenance, merge, threads
from tallyglass.storage import stored
from tallyglass.streaming import incremental


def item_type() -> T.StructType:
    """One extracted item."""
    return schema.EXTRACTION["reviews"].dataType.elementType


@dataclass
class Ingested:
    """Rows to append, the gate's rows, and counters."""

    rows: DataFrame
    gated: DataFrame
    counters: DataFrame


def keep_items(items: DataFrame, text: str, known: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """F14, F16, F17 in this order on extracted items (one row each): hearsay goes; sale labels and names that
    the piece does not hold, and no canonical name either, become NULL. An empty vocabulary changes nothing."""
    items = items.where(rules.keeps_evidence(F.col("firsthand_evidence"), F.col(text), F.col("mentioned_product")))
    items, some = maintenance.with_known(items, "mentioned_product", known)
    label = rules.is_sale_label(F.col("mentioned_product"), F.col("is_known"), F.lit(some))
    items = items.withColumn("mentioned_product", F.when(~label, F.col("mentioned_product"))).drop("is_known")
    if vocabulary is None or not vocabulary.limit(1).count():
        return items
    names = vocabulary.select(tag_key(F.col("canonical")).alias("_k"), F.lit(True).alias("_known")).distinct()
    items = items.withColumn("_k", tag_key(F.col("mentioned_product"))).join(names, "_k", "left")
    ok = F.coalesce("_known", F.lit(False)) | F.contains(F.col(text), F.col("mentioned_product"))
    return items.withColumn("mentioned_product", F.when(ok, F.col("mentioned_product"))).drop("_k", "_known")


def ingest(
    pieces: DataFrame, seen: DataFrame, kb: DataFrame, specs: DataFrame, extract: Callable[[str], list[dict]], source: str, platform: str,
    budget: int, rank: DataFrame | None = None, known: DataFrame | None = None, vocabulary: DataFrame | None = None,
) -> Ingested:
    """Pieces (batch, pos, thread_no, comment_no, url, text, market, topic_score) to review rows.

    The seen cut comes before the paid step, and its answers are stored, so no call is made twice. Rows of a
    NULL post id are never treated as seen.
    """
    spark = pieces.sparkSession
    rows = gate.verdicts(gate.signals(pieces, "text"), platform, "text")
    order = [F.desc("e_bucket"), F.desc("bias_hold"), F.desc("topic_score")]
    gated = gate.budget(rows, budget, rank=order)
    chosen = gated.where("emitted").withColumn("post_id", dc_post_id(F.col("url"), F.col("comment_no"))).withColumn("source", F.lit(source))
    new = stored(incremental.fresh(chosen, seen, ["source", "post_id"]), "new")
    items = hooks.extract_items(new, "post_id", "text", extract, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in item_type().fields))
    items = stored(items, "answers").withColumnRenamed("id", "post_id").join(new.select("post_id", "text", F.col("market").alias("doc_market"), "source"), "post_id")
    names = known if known is not None else spark.createDataFrame([], "name string")
    items = keep_items(items, "text", names, vocabulary)
    linked = linking.link(
        items.withColumns({"item_market": F.col("mentioned_market"), "product": F.col("mentioned_product")}), kb, spec_owners(specs)
    )
    counters = gate.gate_counters(gated, budget)
    return Ingested(rendered(linked), gated, counters)


def spec_owners(specs: DataFrame) -> DataFrame:
    """A15 over the specs' product names, by the key that links look up."""
    return linking.owners(specs, linking.product_key(F.col("product")), "market")


def rendered(linked: DataFrame) -> DataFrame:
    """Adds the evidence line of each linked item and its tokens."""
    notes = [F.col(f"{a}.notes").alias(a) for a in ("scent", "texture", "sound", "longevity")]
    line = render_review(F.struct("market", "product", *notes, "summary", F.col("firsthand_evidence").alias("evidence"), "sentiment"))
    return linked.withColumn("evidence", line).withColumn("tokens", tokens(F.col("evidence")))


def answered(extract: Callable[[str], list[dict]]) -> Callable[[str], list[dict]]:
    """``extract`` whose failure on a batch loses that batch alone: one item at place -1 stands for it."""

    def call(block: str) -> list[dict]:
        try:
            return extract(block)
        except Exception:  # noqa: BLE001  any failure of an injected model; counted, and tried again by the next run
            return [{"place": -1}]

    return call


def ingest_threads(
    pieces: DataFrame, seen: DataFrame, kb: DataFrame, specs: DataFrame, extract: Callable[[str], list[dict]] | None, budget: int,
    source: str = "amos", platform: str = "dcinside", revisit: DataFrame | None = None, registry: DataFrame | None = None,
    known: DataFrame | None = None, vocabulary: DataFrame | None = None,
) -> Ingested:
    """One run over thread pieces (anchor, batch, pos, thread_no, type, comment_no, ordinal, url, text, topic_score).

    In this order: the anchors' watermarks (G1), the gate and its budget, the seen cut that leaves a seen
    post as context of new comments (J10b), batches of a thread with the post in front (W8), one call a
    batch, the post's market for pieces that name none (J20), evidence and name rules, the fold by
    product (W7), linking, rendering. ``seen`` is (source, post_id, anchor, thread_no) of the rows there are.

    ``extract`` gets a block of numbered pieces and returns items with ``place``, ``doc_market`` and an
    item's fields, a piece with a market and no review as an item without evidence; without it the run
    is dry: no rows, and the counters that need no call. Every step is stored, so no call is made twice, and
    counters are observed as the steps are written: they cost no job. A piece without a thread number is a
    thread of its own; a comment without a number is context only, as its id would not be stable.
    Counters are long: (counter, n).
    """
    notes = Notes()
    marks = incremental.watermarks(seen.where(F.col("source") == source), ["anchor"], "thread_no")
    rows = incremental.above(notes.of(pieces, collected=F.count(F.lit(1))), marks, ["anchor"], F.col("thread_no").cast("long"), revisit)
    rows = stored(gate.verdicts(gate.signals(rows, "text"), platform, "text"), "judged")
    gated = gate.budget(rows, budget, rank=[F.desc("e_bucket"), F.desc("bias_hold"), F.desc("topic_score")])
    gated = stored(notes.of(gated, above_mark=F.count(F.lit(1)), emitted=F.count_if("emitted"), gate_unprocessed=F.count_if("unprocessed")), "gated")
    is_post = F.col("type") == "post"
    number = F.when(~is_post, F.col("comment_no"))
    post_id = F.when(is_post | number.isNotNull(), dc_post_id(F.col("url"), number))
    own = F.concat_ws(":", F.lit("piece"), "batch", "pos")
    chosen = gated.where("emitted").select(
        F.lit(source).alias("source"), post_id.alias("post_id"), F.coalesce(thread_no(F.col("thread_no"), F.lit(None), F.col("url")), own).alias("thread"),
        is_post.alias("is_post"), F.struct(~is_post, "ordinal", "comment_no", "batch", "pos").alias("place_key"), "text",
        source_ref(platform, F.col("url"), F.col("thread_no"), number, F.when(~is_post, F.col("ordinal"))).alias("source_ref"), "anchor",
    )
    chosen = incremental.fresh_marked(chosen, seen, ["source", "post_id"])
    chosen = stored(notes.of(chosen, skipped_seen=F.count_if("is_seen")), "chosen")
    asked = chosen.groupBy("thread").agg(
        F.count("*").alias("n"), F.count_if(~F.col("is_seen")).alias("n_new"), F.count_if(F.col("is_seen") & F.col("is_post")).alias("n_posts")
    )
    calls = lambda n: F.coalesce(F.sum(F.ceil(n / THREAD_BATCH)), F.lit(0)).cast("long")
    given_n = F.when(F.col("n_new") > 0, F.col("n_new") + F.col("n_posts")).otherwise(0)
    asked = stored(notes.of(asked, calls=calls(given_n), calls_without_cut=calls(F.col("n"))), "threads").where("n_new > 0")
    context = chosen.where("is_seen and is_post").join(asked.select("thread"), "thread", "left_semi").select(*chosen.columns)
    given = chosen.where("not is_seen").unionByName(context)
    given = stored(notes.of(given, context_posts=F.count_if("is_seen"), skipped_no_comment_no=F.count_if(F.col("post_id").isNull())), "given")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in item_type().fields)
    if extract is None:
        empty = pieces.sparkSession.createDataFrame([], f"post_id string, {fields}")
        return Ingested(empty, gated, notes.table(pieces.sparkSession))
    chunks = threads.thread_chunks(given, "thread", "place_key", "is_post")
    blocks = threads.prompt_blocks(chunks, "thread", "text").withColumn("at", F.struct("thread", "chunk"))
    answers = hooks.extract_items(blocks, "at", "block", answered(extract), f"place long, doc_market string, {fields}")
    answers = stored(notes.of(answers, failed_calls=F.count_if(F.col("place") == -1)), "answers")
    items = answers.select("id.thread", "id.chunk", *[c for c in answers.columns if c != "id"])
    items = items.join(chunks.where("not is_context"), ["thread", "chunk", "place"])
    items = threads.inherit_market(items, "thread", "is_post", "doc_market", "place_key")
    items = items.where("post_id is not null and not is_seen")
    heir = F.row_number().over(Window.partitionBy("post_id").orderBy(F.desc("inherited"), "pos"))  # each heir once
    items = items.withColumn("_heir", F.col("inherited") & (heir == 1))
    items = stored(notes.of(items, market_inherited=F.count_if("_heir")), "items").drop("_heir")
    names = known if known is not None else pieces.sparkSession.createDataFrame([], "name string")
    items = keep_items(items, "text", names, vocabulary)
    held = [F.col(f.name) for f in item_type().fields if f.name != "mentioned_product"]
    parts = [F.col(a) for a in ("scent", "texture", "sound", "longevity")]
    items = items.withColumns({"score": filled_score(parts, F.col("summary"), F.col("stated_rating")), "_print": held_fingerprint(F.struct(*held))})
    items = merge.fold_by_product(items, "post_id", "mentioned_product", "_print", "score", "pos").drop("_print")
    items = items.withColumns({"item_market": F.col("mentioned_market"), "product": F.col("mentioned_product")})
    linked = linking.link(items, kb, spec_owners(specs), registry)
    return Ingested(rendered(linked).drop("place_key", "is_context", "is_seen"), gated, notes.table(pieces.sparkSession))


class Notes:
    """Counters that are observed while the rows they count are written."""

    def __init__(self) -> None:
        self.taken: list[Observation] = []

    def of(self, df: DataFrame, **counts: Column) -> DataFrame:
        """``df``, whose aggregates ``counts`` are noted as it is written; it has to be written once."""
        self.taken.append(Observation())
        return df.observe(self.taken[-1], *[c.alias(k) for k, c in counts.items()])

    def table(self, spark: SparkSession) -> DataFrame:
        """(counter, n) of what has been written."""
        rows = [(k, n or 0) for o in self.taken for k, n in o.get.items()]
        return spark.createDataFrame(rows, "counter string, n long")


def seller_specs(posts: DataFrame, extract: Callable[[str], list[dict]], fields: list[str]) -> DataFrame:
    """Official facts from sellers' captions; kept are items with an attribute and a hashtag as name."""
    schema = "product string, " + ", ".join(f"{f} string" for f in fields)
    items = hooks.extract_items(posts, "id", "text", extract, schema)
    rows = items.join(posts.select("id", F.col("seller_market").alias("market"), hashtags(F.col("text")).alias("tags"), "posted_at"), "id")
    c = [F.col(f) for f in fields]
    return rows.where(rules.is_product_post(*(c + [F.lit(None)] * 4)[:4], F.col("product"), F.col("tags"))).where(~is_all_jamo(squeezed(F.col("product"))))


def route(posts: DataFrame, kb: DataFrame, detector: Callable[[str], tuple[bool, str | None]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(sellers, users) of social posts; promo is judged for users only after the gate."""
    judged = hooks.promo_verdicts(posts, "text", detector)
    routed = linking.partition_sellers(judged.drop("review_class", "promo_marker") if "review_class" in judged.columns else judged, kb, "owner_username", F.col("is_promo"))
    return routed.where("review_class = 'seller'"), routed.where("review_class <> 'seller'").withColumn("product_tags", product_hashtags(F.col("text")))


def commit(old: DataFrame, rows: DataFrame) -> DataFrame:
    """What of ``rows`` goes into the reviews table."""
    return merge.insert_ignore(old, rows, ["source", "post_id", "product"], ["pos"])
