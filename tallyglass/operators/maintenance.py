"""Maintenance as plans (U7 to U17): a plan is a DataFrame of changes, applying it makes a new snapshot.

Every ``plan_*`` only reads; ``apply_plan`` is the only step that changes rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions import lexicon as L
from tallyglass.functions.rules import has_any, is_non_product_word, is_sale_label
from tallyglass.functions.text import excerpt, hashtags, product_hashtags, render_review, squeezed, tag_key, text_of, tokens
from tallyglass.operators import linking, merge
from tallyglass.storage import stored

C = L.CONFIDENCE


def apply_plan(rows: DataFrame, plan: DataFrame, id: str = "id", rendered: Column | None = None) -> DataFrame:
    """Drop the plan's ``dropped`` ids and take its new values (columns ``new_<name>``, guarded by ``set_<name>``).

    Where the market or product changes, evidence and tokens are derived again.
    """
    names = [c[4:] for c in plan.columns if c.startswith("new_")]
    out = rows.join(plan.where("dropped").select(id), id, "left_anti") if "dropped" in plan.columns else rows
    live = plan.where("not dropped") if "dropped" in plan.columns else plan
    out = out.join(live.select(id, *[c for c in plan.columns if c.startswith(("new_", "set_"))], F.lit(True).alias("_hit")), id, "left")
    for c in names:
        hit = F.coalesce(F.col(f"set_{c}") if f"set_{c}" in plan.columns else F.col("_hit"), F.lit(False))
        out = out.withColumn(c, F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)))
    if rendered is not None and {"market", "product"} & set(names):
        fresh = F.col("_hit").isNotNull()
        out = out.withColumn("evidence", F.when(fresh, rendered).otherwise(F.col("evidence")))
        out = out.withColumn("tokens", F.when(fresh, tokens(F.col("evidence"))).otherwise(F.col("tokens")))
    return out.select(*rows.columns)


def apply_in_place(spark: SparkSession, path: str, partition: str, plan: DataFrame, id: str = "id", rendered: Column | None = None) -> list:
    """Apply a plan to the Parquet table at ``path``, rewriting only the partitions that hold one of its ids; their values.

    The partitions are found by one scan of the ids, their new content is stored in the shared folder, and
    then replaces theirs alone (dynamic overwrite); files of other partitions are not touched. A partition that
    loses all its rows goes. Rows stay in their partition: a plan may not change
    the partition column. The values of touched partitions reach the driver, as a report.
    """
    if f"new_{partition}" in plan.columns:
        raise ValueError(f"a plan cannot move rows to another {partition}")
    plan = stored(plan, "plan")
    rows = spark.read.parquet(path)
    hit = stored(rows.join(plan.select(id).distinct(), id, "left_semi").select(partition).distinct(), "hit")
    values = sorted((r[0] for r in hit.collect()), key=lambda v: (v is not None, v))
    if not values:
        return []
    touched = rows.join(F.broadcast(hit.withColumnRenamed(partition, "_hit")), F.col(partition).eqNullSafe(F.col("_hit")), "left_semi")
    changed = stored(apply_plan(touched, plan, id, rendered), "changed")
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    left = {r[0] for r in changed.select(partition).distinct().collect()}
    for value in set(values) - left:  # dynamic overwrite leaves partitions without new rows as they were
        folder = changed.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(partition, None if value is None else str(value))
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{folder}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return values


def rendered_row() -> Column:
    """X12 over the promoted columns of a review row."""
    null = F.lit(None).cast("string")
    parts = {"market": "market", "product": "product", "scent": "scent", "texture": "texture", "sound": "sound",
             "longevity": None, "summary": "summary", "evidence": None, "sentiment": "sentiment"}
    return render_review(F.struct(*[(F.col(c) if c else null).alias(k) for k, c in parts.items()]))


def plan_offtopic(reviews: DataFrame, specs: DataFrame, topic_terms: list[str], source: str = "instagram") -> DataFrame:
    """Rows of a source whose body holds no topic term and whose product is not in the specs."""
    rows = reviews.where((F.col("source") == source) & F.col("body").isNotNull() & ~has_any(F.col("body"), topic_terms))
    rest = rows.join(specs.select("product").where("product is not null").distinct(), "product", "left_anti")
    return rest.select("id", "product", F.lit(True).alias("dropped"))


def plan_instagram_names(
    reviews: DataFrame, posts: DataFrame, layer1: Column, registry: Column, excluded: Column, own_tags: str | None = None
) -> DataFrame:
    """U8: new product names from a post's product hashtags; rows that land on one name fold to the richest.

    Generic tags name no product (X6), nor do the market's own (X7), the keys in the posts' array column ``own_tags``.
    """
    own = F.coalesce(F.col(own_tags), F.array().cast("array<string>")) if own_tags else ()
    tags = posts.select("post_id", product_hashtags(F.col("caption"), own).alias("tags"))
    rows = reviews.join(tags, "post_id")
    keep = F.exists("tags", lambda t: tag_key(t) == tag_key(F.col("product")))
    claimed = rows.where(keep).groupBy("post_id").agg(F.collect_set("product").alias("claimed"))
    rows = rows.join(claimed, "post_id", "left").withColumn("claimed", F.coalesce("claimed", F.array().cast("array<string>")))
    made = linking.resolved_product_name(F.col("product"), F.col("tags"), F.col("claimed"), excluded, layer1, registry)
    rows = rows.withColumn("_d", made).withColumn("target", F.col("_d.product"))
    fold = merge.richest_fold(rows.where("target is not null"), ["post_id", "target"], "score", "id")
    held = rows.where("target is null").withColumn("dropped", F.lit(False))
    out = fold.unionByName(held)
    changed = F.col("dropped") | ~F.col("target").eqNullSafe(F.col("product"))
    return out.where(changed).select("id", "dropped", F.col("target").alias("new_product"), F.col("_d.decision").alias("decision"))


def plan_attribution(reviews: DataFrame, kb: DataFrame) -> DataFrame:
    """Market prefixes and non-product words out of stored product names; equal results fold."""
    rows = linking.split_prefix(reviews, "product", kb)
    rows = linking.resolve(rows, F.col("hint"), kb, "h")
    target = F.when(~is_non_product_word(F.col("rest")), F.col("rest"))
    moved = F.col("h_market").isNotNull() & ~F.col("h_market").eqNullSafe(F.col("market"))
    conf = F.when(F.col("hint_how") == "surface", C["prefix_surface"]).otherwise(C["prefix_choseong"])
    rows = rows.withColumns({"target": target, "new_market": F.when(moved, F.col("h_market")).otherwise(F.col("market")),
                             "new_market_confidence": F.when(moved, F.lit(conf)).otherwise(F.col("market_confidence"))})
    named = merge.richest_fold(rows.where("target is not null"), ["post_id", "target"], "score", "id")
    alone = rows.where("target is null and score = 0").withColumn("dropped", F.lit(False))
    held = merge.richest_fold(rows.where("target is null and score > 0"), ["post_id", "fingerprint"], "score", "id")
    out = named.unionByName(held).unionByName(alone)
    changed = F.col("dropped") | moved | ~F.col("target").eqNullSafe(F.col("product"))
    return out.where(changed).select("id", "dropped", F.col("target").alias("new_product"), "new_market", "new_market_confidence")


def plan_backfill_market(reviews: DataFrame, specs: DataFrame, captions: DataFrame) -> DataFrame:
    """Markets of rows with a product and no market: the specs' only owner, else the caption's; conflicts are kept apart."""
    return _two_sources(reviews.where("market is null and product is not null"), specs, captions).withColumn(
        "conflict", F.col("spec_market") != F.col("caption_market")
    )


def _two_sources(rows: DataFrame, specs: DataFrame, captions: DataFrame) -> DataFrame:
    own = linking.owners(specs, tag_key(F.col("product")), "market").select(F.col("key").alias("_p"), F.col("owner").alias("spec_market"))
    cap = captions.select(F.col("id").alias("post_id"), "caption_market")
    out = rows.withColumn("_p", tag_key(F.col("product"))).join(own, "_p", "left").join(cap, "post_id", "left")
    found = F.coalesce("spec_market", "caption_market")
    clash = F.coalesce(F.col("spec_market") != F.col("caption_market"), F.lit(False))
    conf = F.when(F.col("spec_market").isNotNull(), C["backfill_spec"]).otherwise(C["backfill_caption"])
    return out.select(
        "id", "market", "spec_market", "caption_market", F.when(~clash, found).alias("new_market"), (~clash & found.isNotNull()).alias("set_market"),
        F.when(~clash & found.isNotNull(), conf).alias("new_market_confidence"), (~clash & found.isNotNull()).alias("set_market_confidence"),
    )


def plan_backfill_confidence(reviews: DataFrame, specs: DataFrame, captions: DataFrame) -> DataFrame:
    """Confidence of rows that have a market and none; only where the evidence equals the stored market."""
    rows = _two_sources(reviews.where("market is not null and market_confidence = 0"), specs, captions)
    by_spec, by_caption = (F.coalesce(F.col(c) == F.col("market"), F.lit(False)) for c in ("spec_market", "caption_market"))
    some = F.col("spec_market").isNotNull() | F.col("caption_market").isNotNull()
    state = F.when(by_spec, "spec").when(by_caption, "caption").when(some, "conflict").otherwise("no_evidence")
    conf = F.when(by_spec, C["backfill_spec"]).when(by_caption, C["backfill_caption"])
    return rows.select("id", state.alias("state"), conf.alias("new_market_confidence"), conf.isNotNull().alias("set_market_confidence"))


def plan_evidence_headers(reviews: DataFrame) -> DataFrame:
    """Rows with a market whose evidence still says that it is unknown."""
    return reviews.where("market is not null and evidence like '[마켓미상%'").select("id", F.col("market").alias("new_market"))


def plan_inversion(reviews: DataFrame, specs: DataFrame, registry: DataFrame, captions: DataFrame, sources: list[str], tier: str | None = None, excluded: list[str] = ()) -> DataFrame:
    """Markets from the only owner of a product, in two tiers; a caption that disagrees is a conflict."""
    known = {"spec": "inversion_spec", "registry": "inversion_registry", None: None}
    if tier not in known:
        raise ValueError(f"unknown tier: {tier}")
    rows = reviews.where("market is null and product is not null and coalesce(market_confidence, 0) = 0").where(F.col("source").isin(*sources))
    own = lambda df: linking.owners(df, linking.product_key(F.col("product")), "market")
    rows = linking.inverted(rows, "product", own(specs), own(registry), list(excluded))
    rows = rows.join(captions.select(F.col("id").alias("post_id"), "caption_market"), "post_id", "left").where("inverted_market is not null")
    if tier:
        rows = rows.where(F.col("inverted_how") == known[tier])
    clash = F.coalesce(F.col("caption_market") != F.col("inverted_market"), F.lit(False))
    conf = F.when(F.col("inverted_how") == "inversion_spec", C["inversion_spec"]).otherwise(C["inversion_registry"])
    return rows.select("id", F.col("inverted_market").alias("new_market"), (~clash).alias("set_market"), conf.alias("new_market_confidence"),
                       (~clash).alias("set_market_confidence"), F.col("inverted_how").alias("provenance"), clash.alias("conflict"))


def plan_revert_inversion(reviews: DataFrame, tier: str) -> DataFrame:
    """Rows whose market came from a tier lose it; the tier is told by the provenance column."""
    known = {"spec": ["inversion_spec"], "registry": ["inversion_registry"], "all": ["inversion_spec", "inversion_registry"]}
    if tier not in known:
        raise ValueError(f"unknown tier: {tier}")
    rows = reviews.where(F.col("market_provenance").isin(*known[tier]))
    return rows.select("id", F.lit(None).cast("string").alias("new_market"), F.lit(0.0).alias("new_market_confidence"))


def inversion_material(reviews: DataFrame, posts: DataFrame) -> DataFrame:
    """For products with an inferred market: seller posts of that market and of others that name it, and excerpts."""
    own = reviews.where("market_provenance like 'inversion%'")
    tags = posts.select(F.col("market").alias("post_market"), F.explode(hashtags(F.col("caption"))).alias("tag"))
    tags = tags.withColumn("_p", tag_key(F.col("tag"))).groupBy("_p", "post_market").agg(F.count("*").alias("n"))
    per = own.groupBy(tag_key(F.col("product")).alias("_p"), "market").agg(
        F.min("product").alias("product"), F.sort_array(F.collect_list(excerpt(text_of(F.col("body"))))).alias("excerpts")
    )
    both = per.join(tags, "_p", "left")
    same = F.col("post_market") == F.col("market")
    zero = F.lit(0).cast("long")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), zero)
    return both.groupBy("product", "market", "excerpts").agg(n(same).alias("own_posts"), n(~same).alias("other_posts"))


def with_known(rows: DataFrame, product: str, known: DataFrame) -> tuple[DataFrame, bool]:
    """F16: ``rows`` with ``is_known``, whether the product's key is among the names, and whether there are any."""
    keys = known.where("name is not null").select(tag_key(F.col("name")).alias("_k"), F.lit(True).alias("_known")).distinct()
    out = rows.withColumn("_k", tag_key(squeezed(F.col(product)))).join(linking.lookup(keys), "_k", "left")
    return out.withColumn("is_known", F.coalesce("_known", F.lit(False))).drop("_k", "_known"), bool(keys.limit(1).count())


def plan_non_products(reviews: DataFrame, known: DataFrame) -> DataFrame:
    """U16: sale labels out of product names; the row stays. ``known`` has the known product names (name)."""
    rows, some = with_known(reviews.where("product is not null"), "product", known)
    hit = is_sale_label(F.col("product"), F.col("is_known"), F.lit(some))
    return rows.where(hit).select("id", F.lit(None).cast("string").alias("new_product"))


def reload_snapshot(specs: DataFrame, overlay: DataFrame, old: DataFrame, gold: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Specs with the overlay applied, and reviews with the gold rows that are new, joined to specs."""
    key = ["market", "product"]
    applied = merge.overlay_apply(specs, overlay, key, fields)
    new = gold.join(old.select("post_id").where("post_id is not null").distinct(), "post_id", "left_anti")
    return applied, merge.spec_join(old.unionByName(new), applied)


def migrated(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Missing columns are added as NULL; running it again changes nothing."""
    for c, kind in columns.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    return df
