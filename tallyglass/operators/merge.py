"""Snapshot merges, overlays and folds.

A merge takes the old and the incoming rows and returns the next snapshot; nothing is updated in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.functions.text import tag_key


def all_set(key: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Incoming rows that are inserted: the first of each new key, and every row with a NULL in its key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    keyed = new.where(all_set(key)).withColumn("_r", rank).where("_r = 1").drop("_r")
    return keyed.join(old.where(all_set(key)).select(*key).distinct(), key, "left_anti").unionByName(new.where(~all_set(key)))


def coalesce_upsert(old: DataFrame, new: DataFrame, key: list[str], order: str, arrays: list[str] = ()) -> DataFrame:
    """The last non-NULL incoming value of each column wins, NULL never overwrites; an empty array does not either."""
    values = [c for c in old.columns if c not in key]
    usable = {c: F.when(F.size(c) > 0, F.col(c)) if c in arrays else F.col(c) for c in values}
    last = [F.max(F.when(v.isNotNull(), F.struct(F.col(order).alias("at"), v.alias("v"))))["v"].alias(f"_new_{c}") for c, v in usable.items()]
    folded = new.groupBy(*key).agg(*last)
    both = old.join(folded, key, "full_outer")
    return both.select(*key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in values])


def replace_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows replace old ones of the same key; NULL key parts are equal to each other."""
    same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key])
    kept = old.alias("o").join(new.select(*key).distinct().alias("n"), same, "left_anti")
    return kept.unionByName(new.select(*old.columns))


def spec_join(reviews: DataFrame, specs: DataFrame, key: list[str] = ("market", "product"), target: str = "spec_id") -> DataFrame:
    """Fills ``target`` where it is NULL from the specs row of the same key; NULL keys match nothing."""
    dim = specs.select(*key, F.col("id").alias("_id"))
    return reviews.join(dim, list(key), "left").withColumn(target, F.coalesce(target, "_id")).drop("_id")


def latest_items(items: DataFrame, id: str, order: list[str], partition: list[str] = ()) -> DataFrame:
    """The newest row of each item over all runs; rows without an id are all kept."""
    rank = F.row_number().over(Window.partitionBy(*partition, id).orderBy(*[F.desc(c) for c in order]))
    newest = items.where(F.col(id).isNotNull()).withColumn("_r", rank).where("_r = 1").drop("_r")
    return newest.unionByName(items.where(F.col(id).isNull()))


def item_id(item: Column) -> Column:
    """First filled of shortCode, shortcode, id and url."""
    return F.coalesce(*[F.nullif(item[c], F.lit("")) for c in ("shortCode", "shortcode", "id", "url")])


def richest_fold(rows: DataFrame, key: list[str], score: str, id: str) -> DataFrame:
    """Adds ``dropped``: true for all but the richest row of each key (ties: smaller id)."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), id))
    return rows.withColumn("dropped", rank > 1)


def fold_by_product(items: DataFrame, doc: str, name: str, fingerprint: str, score: str, pos: str) -> DataFrame:
    """One item per document and product (names compared without white space, ``_``, ``.`` and case), the
    richest, at the place of the first; items without a product fold only with an equal fingerprint and a
    score above zero."""
    named = F.col(name).isNotNull() & (F.col(name) != "")
    key = F.when(named, F.concat(F.lit("n:"), tag_key(F.col(name)))).when(F.col(score) > 0, F.concat(F.lit("h:"), F.col(fingerprint)))
    key = F.coalesce(key, F.concat(F.lit("p:"), F.col(pos).cast("string")))
    w = Window.partitionBy(doc, "_key")
    rows = items.withColumn("_key", key).withColumn("_first", F.min(pos).over(w))
    rows = rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc(score), pos))).where("_r = 1")
    return rows.withColumn(pos, F.col("_first")).drop("_key", "_first", "_r")


def overlay_apply(specs: DataFrame, overlay: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Human values beat extracted ones, NULL included; ``unknown`` entries change nothing.

    ``overlay`` is long: key, field, value, unknown.
    """
    own = overlay.where(~F.coalesce("unknown", F.lit(False)))
    wide = own.groupBy(*key).agg(
        *[F.max(F.when(F.col("field") == f, F.struct(F.col("value").alias("v")))).alias(f"_o_{f}") for f in fields]
    )
    out = specs.join(wide, key, "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col(f"_o_{f}").isNotNull(), F.col(f"_o_{f}.v")).otherwise(F.col(f))).drop(f"_o_{f}")
    return out


def overlay_orphans(specs: DataFrame, overlay: DataFrame, key: list[str]) -> DataFrame:
    """Overlay keys without a specs row."""
    return overlay.select(*key).distinct().join(specs.select(*key), key, "left_anti")


def review_queue(specs: DataFrame, overlay: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Rows with fields that are blank and not marked unknown: key, missing."""
    unknown = overlay.where("unknown").groupBy(*key).agg(F.collect_set("field").alias("_unknown"))
    open_ = lambda f: (F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "") & ~F.array_contains(
        F.coalesce("_unknown", F.array().cast("array<string>")), f
    )
    missing = F.array_compact(F.array(*[F.when(open_(f), F.lit(f)) for f in fields]))
    return specs.join(unknown, key, "left").select(*key, missing.alias("missing")).where(F.size("missing") > 0)


def clear_blanks(specs: DataFrame, overlay: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Cells that a human blanked on purpose become NULL."""
    return overlay_apply(specs, overlay.where("value is null or trim(value) = ''").withColumn("value", F.lit(None).cast("string")), key, fields)


def overlay_changes(specs: DataFrame, overlay: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """U4: what re-applying the overlay would change: key, field, was, now."""
    new = overlay_apply(specs, overlay, key, fields).select(*key, *[F.col(f).alias(f"_n_{f}") for f in fields])
    both = specs.join(new, key)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("was"), F.col(f"_n_{f}").cast("string").alias("now")) for f in fields])
    return both.select(*key, F.explode(rows).alias("c")).select(*key, "c.*").where(~F.col("was").eqNullSafe(F.col("now")))


def overlay_entry(specs: DataFrame, key: dict, field: str, value: str | None, at: str, fields: list[str]) -> DataFrame:
    """The overlay row of one human edit, with the value it replaces; unknown fields raise."""
    if field not in fields:
        raise ValueError(f"not an editable field: {field}")
    same = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in key.items()])
    new = F.nullif(F.trim(F.lit(value).cast("string")), F.lit(""))
    return specs.where(same).select(*key, F.lit(field).alias("field"), new.alias("value"), F.col(field).cast("string").alias("was"),
                                    F.lit(at).alias("at"), F.lit(False).alias("unknown"))


def review_list(rows: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """The best row of each piece in the given order, then the first ``limit`` of these."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    best = rows.where(F.col(key).isNotNull()).withColumn("_r", rank).where("_r = 1").drop("_r")
    return best.unionByName(rows.where(F.col(key).isNull())).orderBy(*order).limit(limit)


def review_order(name: str) -> list[Column]:
    """T4: the three sort keys of the review list; an unknown one is the default."""
    sentiment = lambda first: F.when(F.col("sentiment") == first, 0).when(F.col("sentiment") == "neu", 1).otherwise(2)
    menu = {"positive": [sentiment("pos"), F.desc("id")], "negative": [sentiment("neg"), F.desc("id")]}
    return menu.get(name, [F.desc_nulls_last("created_at"), F.desc("id")])


def client_page(rows: DataFrame, by: str, page: int, size: int = 5, id: str = "id") -> DataFrame:
    """One page of a list sorted by a count or date; negative counts are unknown and come last."""
    value = F.when(F.col(by) >= 0, F.col(by)) if dict(rows.dtypes)[by] in ("int", "bigint") else F.col(by)
    return rows.orderBy(value.desc_nulls_last(), id).offset(page * size).limit(size)


def stale_summaries(summaries: DataFrame, current: DataFrame, key: list[str], model: str | None = None, before: Column | None = None, min_delta: int = 3, min_evidence: int = 3) -> DataFrame:
    """Keys with enough evidence whose summary is missing, too far behind, by another model, or too old."""
    both = current.select(*key, F.col("n_reviews").alias("n_now")).join(summaries, key, "left")
    stale = F.col("n_reviews").isNull() | (F.abs(F.col("n_now") - F.col("n_reviews")) >= min_delta)
    if model is not None:
        stale = stale | ~F.col("model").eqNullSafe(F.lit(model))
    if before is not None:
        stale = stale | (F.col("generated_at") < before)
    return both.where((F.col("n_now") >= min_evidence) & stale).select(*key, "n_now", F.col("n_reviews").alias("n_then"))
