"""From documents to packed training sequences, stage by stage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written and read again as the next one's ``docs``. All but the last return the columns of
``documents``. No SQL states every stage (language ID is fitted, packing is planned), so ``ORACLE_SQL``
is None; the tests hold every stage against brute force on its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.llm import langid, neardup, packing, rules
from tallyglass.llm.common import stored

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without the lines that fail; n_chars is that of what is left.

    NULL and empty texts go, as they have too few words; very long texts are judged whole. Repeated
    rows are judged alike and all stay or go; nothing depends on an order, so there are no ties. An empty
    table gives an empty one. All columns come back; one named ``quality_rules`` does not, as in the operator.
    """
    judged = rules.quality_rules(docs).where("quality_rules.kept")
    clean = F.col("quality_rules.clean_text")
    made = {"text": clean, "n_chars": F.length(clean).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return judged.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns if c != "quality_rules"])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language.

    The model is learned from this stage's own input, outside the held-out fold. NULL and empty
    texts, texts without a letter and texts that no learned language explains as its own go; very
    long texts are read whole; repeated rows are judged alike; equal votes are settled by margins and
    then by name. Where no row has a lang nothing can be learned: then all documents with a letter
    stay. An empty table gives an empty one. All columns come back, clashing names included.
    """
    model = langid.fit(docs, langid.fold(F.col("doc_id")) != 0)
    if not model.families:
        return docs.where(F.col("text").rlike(langid.LETTER))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"), F.col("text").alias("_text"))
    left = langid.with_language(own, model, "_text").where((F.col("lang_pred") != langid.UNKNOWN) & F.col("lang_known"))
    return left.select(*[F.col(f"_in.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (five words, 0.8), once.

    NULL, empty and wordless texts are nothing's duplicates and stay, as do rows without an id. Of rows
    that repeat doc_id and text one stays, that of the smallest hash over all columns; rows of one
    doc_id with different texts are judged apart. Very long texts are compared whole. An empty table
    gives an empty one. All columns come back, clashing names included.
    """
    verdict = neardup.near_duplicates(docs.select("doc_id", "text"), with_hash=True)
    kept = verdict.where("kept and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"))
    same = (F.col("_in.doc_id") == F.col("_id")) & (F.xxhash64("_in.text") == F.col("_hash"))
    left = rows.join(kept, same, "left_semi").withColumns({"_id": F.col("_in.doc_id"), "_hash": F.xxhash64("_in.text")})
    first = Window.partitionBy("_id", "_hash", F.col("_in.text")).orderBy(F.xxhash64(*[f"_in.`{c}`" for c in docs.columns]))
    left = left.withColumn("_place", F.row_number().over(first)).where("_place = 1").select("_in")
    every = left.unionByName(rows.where("_in.doc_id is null"))
    return every.select(*[F.col(f"_in.`{c}`").alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes; see ``packing.pack_documents`` for NULLs, long texts, ties,
    repeated rows, empty tables and clashing names."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
