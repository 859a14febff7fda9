"""Queries of the mechanisms that Spark's own operators do not give, over the driver's tables, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions.numbers import dc_post_id
from tallyglass.operators import alignment, ann, extraction, maintenance, probe, running
from tallyglass.operators.merge import latest_items
from tallyglass.plans import ingest, summaries
from tallyglass.sources import pieceslog, rowgroups, social
from tallyglass.storage import new_path, stored
from tallyglass.streaming import incremental, latest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


GOLD = """raw AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS r FROM conversations),
  gold AS (SELECT CASE WHEN turn % 5 = 3 THEN text || '?' ELSE text END AS text, row_number() OVER (ORDER BY conv_id, turn DESC) - 1 AS g FROM conversations)"""


@query(f"""WITH RECURSIVE {GOLD}, walk AS (SELECT -1::BIGINT AS g, -1::BIGINT AS c, NULL::BIGINT AS hit
    UNION ALL SELECT w.g + 1, coalesce(n.r, w.c), n.r FROM walk w JOIN gold ON gold.g = w.g + 1
      LEFT JOIN LATERAL (SELECT min(r) AS r FROM raw WHERE raw.text = gold.text AND raw.r > w.c) n ON true)
  SELECT g AS gold_place, hit AS raw_place FROM walk WHERE hit IS NOT NULL""")  # fmt: skip
def positional_join(spark, sf):
    """Turns against themselves in another order (each conversation from its end), some with texts that nothing holds."""
    raw = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    gold = raw.withColumns({"text": F.when(F.col("turn") % 5 == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text")), "back": -F.col("turn")})
    return alignment.positional_join(gold, raw, "text", ["conv_id", "back"], ["conv_id", "turn"])


@query("""SELECT event_id, CAST(coalesce(sum(user_id) OVER w, 0) AS BIGINT) AS before, row_number() OVER (ORDER BY ts, event_id) - 1 AS place
  FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")  # fmt: skip
def running_totals(spark, sf):
    """Sums and places over all rows, from ranges."""
    rows = table(spark, sf, "events").select("ts", "event_id", "user_id")
    return running.running(rows, ["ts", "event_id"], {"before": F.col("user_id"), "place": F.lit(1)}).select("event_id", "before", "place")


@query("""WITH e AS (SELECT event_id, event_type, CASE WHEN user_id % 5 <> 0 THEN user_id END AS user_id FROM events)
  SELECT event_id, event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM e WHERE user_id IS NOT NULL) WHERE r = 1
  UNION ALL SELECT event_id, event_type, user_id FROM e WHERE user_id IS NULL""")  # fmt: skip
def streamed_ingestion(spark, sf):
    """Events as a stream into a table of batches; a fifth of the users stand for NULL keys."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")
    rows = stream.select("event_id", "event_type", F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("user_id"))
    into, at = new_path(spark, "events"), new_path(spark, "checkpoint")
    incremental.ingest_stream(rows, into, ["user_id", "event_type"], ["event_id"], at).awaitTermination()
    return incremental.BatchTable(spark, into, rows.schema).read()


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def streamed_latest(spark, sf):
    """The newest event of each user from a stream with keyed state."""
    own = latest.session_for_state(spark)
    stream = own.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")
    items = stream.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    into, at = new_path(spark, "latest"), new_path(spark, "checkpoint")
    log = latest.latest_stream(items, "user_id")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{into}/batch={n}")
    log.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return latest_items(spark.read.schema(items.schema).parquet(into), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query()
def nearest_by_cells(spark, sf):
    """The eight nearest vectors of every twentieth one, from cells and codes; tests hold it against the exact list."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = ann.fit(rows)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query"), "embedding")
    return ann.search(asked, rows, stored(ann.index(rows, q), "index"), q, 8)


@query()
def probe_weights(spark, sf):
    """A probe of even labels after 25 steps over all vectors, and one without each of three folds; tests hold it against brute force."""
    rows = table(spark, sf, "embeddings")
    probes = probe.fit(rows, (F.col("label") % 2 == 0).cast("double"), fold=F.col("vec_id") % 3, folds=3, rounds=25)
    flat = [(k, i, float(w)) for k, p in probes.items() for i, w in enumerate([*p.weights, p.bias])]
    return spark.createDataFrame(flat, "fold int, dim int, weight double")


@query("SELECT page_id, url, md5(html) AS html_md5, NULL::VARCHAR AS _corrupt FROM pages")
def pages_by_row_group(spark, sf):
    """The pages through the registered source, a task a row group."""
    pages = rowgroups.session(spark).read.format(rowgroups.NAME).load(f"{sf}/pages.parquet")
    return pages.select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("html_md5"), "_corrupt")


def answer_lengths(prompt: str) -> str:
    """A stand-in for a model: says how many words each piece has, and nothing about pieces that end with a question mark."""
    docs = []
    for part in prompt.split("[S")[1:]:
        number, _, piece = part.partition("]\n")
        if number.isdigit() and piece.strip() and not piece.strip().endswith("?"):
            docs.append({"source_id": f"S{number}", "n_words": len(piece.split())})
    return json.dumps({"docs": docs})


@query(r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations)
  SELECT conv_id, turn, CAST(p // 12 AS INTEGER) AS call, t = '' OR ends_with(t, '?') AS is_padded, false AS is_failed,
    CASE WHEN t <> '' AND NOT ends_with(t, '?') THEN CAST(len(string_split(t, ' ')) AS BIGINT) END AS n_words FROM c""")  # fmt: skip
def thread_extraction(spark, sf):
    """H4, H6: a call for every twelve turns of a conversation; turns that the answer leaves out are padded."""
    pieces = table(spark, sf, "conversations")
    answers = extraction.extract(pieces, answer_lengths, "conv_id", "turn", "text")
    return extraction.fields_of(answers, "n_words long")


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= '1996-01-01' AND o_orderdate < '1996-03-01' AND o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
    date_trunc('month', o_orderdate)::DATE AS month FROM orders
  WHERE NOT (o_orderdate >= '1996-01-01' AND o_orderdate < '1996-03-01' AND o_custkey % 4 = 0)""")  # fmt: skip
def months_in_place(spark, sf):
    """A plan for two months of orders, applied to a table by month; the files of other months stay."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.trunc("o_orderdate", "month").alias("month"))
    path = new_path(spark, "orders")
    orders.repartition("month").write.partitionBy("month").parquet(path)
    due = orders.where("month in (date'1996-01-01', date'1996-02-01') and (o_orderstatus = 'P' or o_custkey % 4 = 0)")
    plan = due.select("o_orderkey", (F.col("o_custkey") % 4 == 0).alias("dropped"), F.lit("F").alias("new_o_orderstatus"))
    maintenance.apply_in_place(spark, path, "month", plan, "o_orderkey")
    return spark.read.parquet(path)


@query("""SELECT 'documents' AS source, count(*) AS n_rows, false AS failed FROM documents UNION ALL SELECT 'pages', count(*), false FROM pages
  UNION ALL SELECT 'broken', NULL, true""")  # fmt: skip
def collected_sources(spark, sf):
    """Three sources, of which one fails as its rows are read; the report says so and the others are whole."""
    broken = table(spark, sf, "events").select(F.raise_error(F.lit("the source is down")).cast("string").alias("text"))
    sources = {"documents": lambda: table(spark, sf, "documents").select("text"), "broken": lambda: broken,
               "pages": lambda: table(spark, sf, "pages").select(F.col("html").alias("text"))}
    union, report = social.collect_all(spark, sources)
    seen = union.groupBy(F.col("collected_from").alias("source")).agg(F.count("text").alias("n_rows"))
    return report.select("source", F.col("error").isNotNull().alias("failed")).join(seen, "source", "left")


def conversation_log(spark: SparkSession, sf: str, root: str, parts: int = 2) -> DataFrame:
    """The turns as a log of pieces: a key a role, items numbered in the order of conversations, ``parts`` files a role."""
    rows = running.numbered(table(spark, sf, "conversations"), ["conv_id", "turn", "role"], "no")
    last = rows.agg(F.max("no")).first()[0] or 0
    step = -(-(last + 1) // parts)
    for role in [r[0] for r in rows.select("role").distinct().collect()]:
        for k in range(parts):
            own = rows.where((F.col("role") == role) & F.col("no").between(k * step, (k + 1) * step - 1))
            name = pieceslog.file_name(role, k * step, (k + 1) * step - 1)
            own.coalesce(1).write.parquet(f"{root}/_new")
            _only_file(spark, f"{root}/_new", f"{root}/{name}")
    return rows


def _only_file(spark: SparkSession, folder: str, to: str) -> None:
    """The one Parquet file of ``folder`` under the name ``to``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().endswith(".parquet")]
    files.mkdirs(path(to).getParent())
    if not files.rename(part, path(to)):
        raise OSError(f"{to} could not be written")
    files.delete(at, True)


@query("SELECT conv_id, turn, role, md5(text) AS text_md5, row_number() OVER (ORDER BY conv_id, turn, role) - 1 AS no FROM conversations")
def pieces_log_stream(spark, sf):
    """The turns through a stream reader whose offset is the newest item of each role."""
    root, into, at = new_path(spark, "log"), new_path(spark, "pieces"), new_path(spark, "checkpoint")
    rows = conversation_log(spark, sf, root)
    pieceslog.register(spark)
    stream = spark.readStream.format(pieceslog.NAME).schema(rows.schema).option("item", "no").load(root)
    stream.writeStream.format("parquet").option("path", into).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(rows.schema).parquet(into)
    return got.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), "no")


@query("""WITH c AS (SELECT conv_id, turn = 0 AS post, CASE WHEN turn > 0 AND turn % 4 <> 3 THEN turn END AS no, conv_id % 3 = 0 AND turn < 2 AS old FROM conversations WHERE trim(text) <> ''),
  t AS (SELECT count(*) AS n, count(*) FILTER (NOT old) AS fresh, count(*) FILTER (old AND post) AS posts FROM c GROUP BY conv_id), every AS (SELECT count(*) AS n FROM conversations)
  SELECT 'collected' AS counter, n FROM every UNION ALL SELECT 'above_mark', n FROM every UNION ALL SELECT 'gate_unprocessed', 0
  UNION ALL SELECT 'emitted', count(*) FROM c UNION ALL SELECT 'skipped_seen', count(*) FROM c WHERE old
  UNION ALL SELECT 'context_posts', coalesce(sum(posts) FILTER (fresh > 0), 0)::BIGINT FROM t UNION ALL SELECT 'skipped_no_comment_no', count(*) FROM c WHERE NOT post AND no IS NULL
  UNION ALL SELECT 'calls', coalesce(sum(ceil((fresh + posts) / 12.0)) FILTER (fresh > 0), 0)::BIGINT FROM t UNION ALL SELECT 'calls_without_cut', coalesce(sum(ceil(n / 12.0)), 0)::BIGINT FROM t""")  # fmt: skip
def thread_run_counters(spark, sf):
    """A dry run over conversations as threads, a third of them seen in part; counters are observed while the steps are written."""
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    url = F.concat(F.lit("https://g/?no="), conv)
    pieces = table(spark, sf, "conversations").select(
        (F.col("conv_id") % 5).cast("string").alias("anchor"), F.col("conv_id").alias("batch"), turn.alias("pos"), conv.alias("thread_no"),
        F.when(turn == 0, "post").otherwise("comment").alias("type"), F.when((turn > 0) & (turn % 4 != 3), turn.cast("string")).alias("comment_no"),
        turn.cast("int").alias("ordinal"), url.alias("url"), "text", F.lit(0.9).alias("topic_score"),
    )
    old = pieces.where("batch % 3 = 0 and pos < 2")
    # seen under thread 0, so that the watermark cuts nothing
    seen = old.select(F.lit("amos").alias("source"), dc_post_id(F.col("url"), F.when(F.col("type") != "post", F.col("comment_no"))).alias("post_id"), "anchor", F.lit("0").alias("thread_no"))
    empty = lambda ddl: spark.createDataFrame([], ddl)
    run = ingest.ingest_threads(pieces, seen, empty("market_word string"), empty("market string, product string"), None, 10**9)
    return run.counters


def values_said(prompt: str) -> dict:
    """A stand-in for a model: how many values each line of the material has."""
    if "\nb: " in prompt:
        return {"p_name": "both"}
    return {line.split(" (", 1)[0].split(":", 1)[0]: f"{line.count(' | ') + 1} values" for line in prompt.split("\n")}


@query("""WITH p AS (SELECT p_brand, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS platform, p_retailprice > 1400 AS promo FROM part),
  s AS (SELECT p_brand, platform AS card, count(*) AS n FROM p WHERE NOT promo GROUP BY ALL UNION ALL SELECT p_brand, 'supporter', count(*) FROM p WHERE promo GROUP BY ALL)
  SELECT p_brand, card, n || ' values' AS p_name, n || ' values' AS p_type, 2 * n AS n_reviews, 1 AS n_asked FROM s
  UNION ALL SELECT p_brand, 'integrated', 'both', NULL, 2 * sum(n)::BIGINT, 1 FROM s WHERE card <> 'supporter' GROUP BY p_brand HAVING count(*) = 2""")  # fmt: skip
def axis_summaries(spark, sf):
    """A summary of each brand's parts from two sources, one over both, and one of promoted parts."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_name", "p_type", "p_retailprice", F.when(F.col("p_size") % 2 == 0, "a").otherwise("b").alias("platform"))
    promo = F.col("p_retailprice") > 1400
    tone = F.when(F.col("p_retailprice") > 1000, "pos").otherwise("neg")
    polarities = rows.where(~promo).select("p_brand", "platform", F.explode(F.array(F.lit("p_name"), F.lit("p_type"))).alias("criterion"), tone.alias("value"))
    return summaries.axis_summaries(rows.where(~promo), rows.where(promo), ["p_name", "p_type"], ["p_brand"], values_said, ("a", "b"), polarities)
