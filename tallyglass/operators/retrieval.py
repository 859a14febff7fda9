"""Dense, sparse and fused retrieval.

Every ranking ends in the id, so equal scores have one order. A top list is a report of its k rows;
nothing else is cut except by ``cap``, a parameter of sparse search that is off by default.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.functions import lexicon as L
from tallyglass.functions.numbers import cosine, permalink
from tallyglass.functions.rules import metafilter


def filtered(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    return df.where(metafilter(filters)) if filters else df


def ranked(top: DataFrame, score: str, id: str, name: str) -> DataFrame:
    """Rank from 0 over a list of a few rows that is already cut to k."""
    return top.withColumn(name, (F.row_number().over(Window.orderBy(F.desc(score), id)) - 1).cast("long"))


def dense_topk(df: DataFrame, query: list[float], k: int = L.TOP_K, id: str = "id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows by cosine: id, score, dense_rank (from 0). Exact, one scan, no shuffle of vectors."""
    score = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    top = df.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), score.alias("score"))
    return ranked(top.orderBy(F.desc("score"), "id").limit(k), "score", "id", "dense_rank")


def bm25(df: DataFrame, query: list[str], id: str = "id", tokens: str = "tokens", cap: int | None = None) -> DataFrame:
    """V9: BM25 score of every row: id, score (0 without a query token).

    Query tokens count with multiplicity; a token in more than half of the rows gets BM25_EPSILON
    times the mean weight of all tokens, as its own would be negative. NULL tokens are an empty
    document. One aggregation gives lengths and document frequencies.
    """
    src = df.select(F.col(id).alias("id"), F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("tokens"))
    if cap is not None:
        src = src.orderBy("id").limit(cap)
    times: dict[str, int] = {}
    for q in query:
        times[q] = times.get(q, 0) + 1
    terms = list(times)
    if not terms:
        return src.select("id", F.lit(0.0).alias("score"))
    scored = src.crossJoin(F.broadcast(term_weights(src, terms)))  # one row
    score = F.lit(0.0)
    for t in terms:
        tf = F.size(F.filter("tokens", lambda x: x == t)).cast("double")
        length = L.BM25_K1 * (1 - L.BM25_B + L.BM25_B * F.size("tokens") / F.col("avgdl"))
        part = F.coalesce(F.element_at("idf", F.lit(t)), F.lit(0.0)) * tf * (L.BM25_K1 + 1) / (tf + length)
        score = score + times[t] * F.when(tf > 0, part).otherwise(0.0)
    return scored.select("id", score.alias("score"))


def term_weights(src: DataFrame, terms: list[str]) -> DataFrame:
    """V9: one row: avgdl, and ``idf``, the weights of those ``terms`` that occur in ``src`` (tokens).

    Rows, lengths and document frequencies are counted by one aggregation; its result is small beside
    the texts, and both passes over it read one shuffle.
    """
    one = F.lit(1).cast("long")
    own = F.transform(F.array_distinct("tokens"), lambda t: F.struct(F.lit("token").alias("kind"), t.alias("token"), one.alias("n")))
    row = [F.struct(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("token"), n.alias("n")) for k, n in (("rows", one), ("length", F.size("tokens").cast("long")))]
    counts = src.select(F.inline(F.concat(F.array(*row), own))).groupBy("kind", "token").agg(F.sum("n").alias("df"))
    only = lambda k: F.max(F.when(F.col("kind") == k, F.col("df")))
    size = counts.agg(only("rows").alias("n_rows"), (only("length") / only("rows")).alias("avgdl"))
    raw = F.when(F.col("kind") == "token", F.log(F.col("n_rows") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    rated = counts.crossJoin(F.broadcast(size)).withColumn("raw", raw)  # ``size`` is one row
    asked = F.collect_list(F.when(F.col("token").isin(*terms), F.struct("token", "raw")))
    found = rated.agg(F.first("avgdl").alias("avgdl"), F.avg("raw").alias("mean"), asked.alias("asked"))
    idf = lambda x: F.when(x["raw"] < 0, L.BM25_EPSILON * F.col("mean")).otherwise(x["raw"])
    return found.select("avgdl", F.map_from_entries(F.transform("asked", lambda x: F.struct(x["token"].alias("token"), idf(x).alias("idf")))).alias("idf"))


def bm25_topk(df: DataFrame, query: list[str], k: int = L.TOP_K, **options) -> DataFrame:
    """The k best rows by BM25: id, score, sparse_rank (from 0); rows with score 0 fill up the list."""
    top = bm25(df, query, **options).orderBy(F.desc("score"), "id").limit(k)
    return ranked(top, "score", "id", "sparse_rank")


def rrf(dense: DataFrame, sparse: DataFrame, k: int = L.TOP_K, constant: int = L.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two short lists; ties by dense, then sparse rank."""
    both = dense.select("id", "dense_rank").join(sparse.select("id", "sparse_rank"), "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    fused = both.withColumn("rrf", part("dense_rank") + part("sparse_rank"))
    order = (F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc("id"))
    top = fused.orderBy(*order).limit(k)
    return top.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def search(df: DataFrame, query_vector: list[float], query_tokens: list[str], filters=None, k: int = L.TOP_K, **options) -> DataFrame:
    """Both lists over the same filtered rows, fused."""
    rows = filtered(df, filters)
    return rrf(dense_topk(rows, query_vector, k), bm25_topk(rows, query_tokens, k, **options), k)


def context(hits: DataFrame, text: str = "evidence") -> DataFrame:
    """The hits as one numbered block for a model, and their ids as citations."""
    line = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] "), F.coalesce(F.col(text), F.lit("")))
    items = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"), "id")))
    return hits.agg(items.alias("items")).select(
        F.array_join(F.transform("items", lambda x: x["line"]), "\n").alias("context"),
        F.transform("items", lambda x: x["id"]).alias("citations"),
    )


def hits(df: DataFrame, fused: DataFrame, id: str = "id") -> DataFrame:
    """The rows of a fused list with their rank and score; the list has at most k rows."""
    return df.join(F.broadcast(fused.select(F.col("id").alias(id), "rank", "rrf")), id)


def answer(found: DataFrame, question: str, complete: Callable[[str], str]) -> DataFrame:
    """One row (answer, citations) from the hits alone (rank, source, market, product, evidence, source_ref).

    The model gets the question and one numbered line per hit that names its source, so that sources can be told
    apart; citations carry the same numbers and an address, NULL where there is none. Without hits it is not asked.
    """

    @F.pandas_udf("string")
    def call(prompts: pd.Series) -> pd.Series:
        return prompts.map(complete)

    said = lambda c: F.coalesce(F.col(c), F.lit("None"))
    n = (F.col("rank") + 1).cast("int")
    head = F.concat(F.lit("["), n.cast("string"), F.lit("] (source="), said("source"), F.lit(", market="), said("market"), F.lit(", product="), said("product"), F.lit(") "))
    cited = F.struct(n.alias("n"), "source", "market", "product", "evidence", permalink(F.col("source_ref")).alias("url"))
    rows = found.select(F.struct(n.alias("n"), F.concat(head, said("evidence")).alias("line"), cited.alias("cited")).alias("hit"))
    one = rows.agg(F.sort_array(F.collect_list("hit")).alias("hits"))  # at most k hits
    prompt = F.concat(F.lit(question + "\n\n"), F.array_join(F.transform("hits", lambda h: h["line"]), "\n"))
    one = one.select(prompt.alias("prompt"), F.transform("hits", lambda h: h["cited"]).alias("citations"))
    some = F.size("citations") > 0
    asked = one.where(some).select(call.asNondeterministic()(F.col("prompt")).alias("answer"), "citations")
    return asked.unionByName(one.where(~some).select(F.lit(L.NO_EVIDENCE).alias("answer"), "citations"))
