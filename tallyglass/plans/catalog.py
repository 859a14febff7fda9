"""One query per operator over the driver's tables, each with the SQL that DuckDB runs beside it.

The tables hold no reviews, so operators run on analogous columns: ``documents`` with ``labels`` as
reviews (language as platform, source as market), ``conversations`` as threads, ``lineitem`` as the
fan-out of orders, ``part`` as products of brands. Ratios come back as numerators and denominators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions import numbers, rules, text
from tallyglass.operators import consolidate, evaluate, gate, linking, merge, registry, retrieval, threads
from tallyglass.plans import mechanisms, tables
from tallyglass.sources import pages
from tallyglass.streaming import incremental, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """documents with labels, read as reviews."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("platform"), F.col("source").alias("market"), "text", "n_chars")
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    s = F.when(F.col("toxic") == 1, "neg").when(F.col("quality") == 1, "pos").when(F.col("quality") == 0, "neu")
    return docs.join(labels, "id", "left").withColumn("sentiment", s)


EV = """WITH ev AS (
  SELECT d.doc_id AS id, lang AS platform, source AS market, text, n_chars, quality, toxic,
    CASE WHEN toxic = 1 THEN 'neg' WHEN quality = 1 THEN 'pos' WHEN quality = 0 THEN 'neu' END AS sentiment
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(EV + """ SELECT platform, count(*) FILTER (WHERE sentiment = 'pos') AS pos,
  count(*) FILTER (WHERE sentiment = 'neu') AS neu, count(*) FILTER (WHERE sentiment = 'neg') AS neg, count(*) AS n,
  count(*) FILTER (WHERE sentiment = 'pos') - count(*) FILTER (WHERE sentiment = 'neg') AS balance
  FROM ev WHERE sentiment IS NOT NULL GROUP BY platform""")  # fmt: skip
def per_source_sentiment(spark, sf):
    """A1."""
    return consolidate.per_source_sentiment(reviews(spark, sf))


@query(EV + """, s AS (SELECT market, platform, CASE sentiment WHEN 'pos' THEN 1 WHEN 'neg' THEN -1 ELSE 0 END AS x FROM ev WHERE sentiment IS NOT NULL),
  n AS (SELECT market, avg(x) FILTER (WHERE platform = 'en') AS l, avg(x) FILTER (WHERE platform = 'de') AS r FROM s GROUP BY market)
  SELECT market, round(l, 6) AS left_net, round(r, 6) AS right_net, round(l - r, 6) AS gap FROM n""")  # fmt: skip
def sentiment_gap(spark, sf):
    """A2: rounded for display only."""
    out = consolidate.sentiment_gap(reviews(spark, sf), "en", "de", ["market"])
    return out.select("market", *[F.round(c, 6).alias(c) for c in ("left_net", "right_net", "gap")])


def _bucketed_events(spark, sf):
    ev = table(spark, sf, "events")
    s = F.when(F.col("value") > 100, "pos").when(F.col("value") < 20, "neg").otherwise("neu")
    return ev.select("event_id", (F.col("user_id") % 3).cast("string").alias("platform"), F.col("event_type").alias("criterion"), s.alias("value"), F.lit(0).alias("place"))


BUCKETED = """WITH r AS (SELECT event_id, CAST(user_id % 3 AS VARCHAR) AS platform, event_type AS criterion,
  CASE WHEN value > 100 THEN 'pos' WHEN value < 20 THEN 'neg' ELSE 'neu' END AS value FROM events)"""


@query(BUCKETED + """, c AS (SELECT platform, criterion, count(*) AS n FROM r WHERE value = 'neg' GROUP BY ALL)
  SELECT platform, criterion, n, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY platform ORDER BY n DESC, criterion) AS INTEGER) AS rank FROM c) WHERE rank <= 3""")  # fmt: skip
def top_points(spark, sf):
    """A3, T5."""
    return consolidate.top_points(_bucketed_events(spark, sf), "neg")


@query("""SELECT p_brand, count(*) FILTER (WHERE NOT (SELECT bool_or(contains(p_name, w)) FROM (
    SELECT unnest(string_split(lower(p_type), ' ')) AS w))) AS n_divergent, count(*) AS n FROM part GROUP BY p_brand""")  # fmt: skip
def divergence_ratio(spark, sf):
    """A4."""
    part = table(spark, sf, "part").withColumn("official", F.lower("p_type"))
    return consolidate.divergence(part, "official", "p_name", ["p_brand"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r = 1""")  # fmt: skip
def fold_fanout(spark, sf):
    """A5."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    out = consolidate.fold_first(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey")


STATS = BUCKETED + """, g AS (SELECT criterion, platform, CAST(grouping(platform) AS INTEGER) AS is_total,
  count(*) FILTER (WHERE value = 'pos') AS pos, count(*) FILTER (WHERE value = 'neu') AS neu,
  count(*) FILTER (WHERE value = 'neg') AS neg, count(*) AS n, count(DISTINCT platform) AS ns, min(platform) AS one
  FROM r GROUP BY GROUPING SETS ((criterion, platform), (criterion)))"""  # fmt: skip


@query(STATS + """ SELECT criterion, platform, is_total, pos, neu, neg, n, CASE WHEN is_total = 1 AND ns = 1 THEN one END AS only_source,
  CASE WHEN is_total = 1 THEN pos > 0 AND neg > 0 END AS split FROM g""")  # fmt: skip
def criterion_stats(spark, sf):
    """A6."""
    return consolidate.criterion_stats(_bucketed_events(spark, sf))


@query(STATS + " SELECT criterion, pos, neg FROM g WHERE is_total = 1 AND n > 0")
def counts_material(spark, sf):
    """A7."""
    return consolidate.counts_material(consolidate.criterion_stats(_bucketed_events(spark, sf)))


@query(STATS + """ SELECT criterion, coalesce(sum(n) FILTER (WHERE platform = '0' AND is_total = 0), 0)::BIGINT AS n_left,
  coalesce(sum(n) FILTER (WHERE platform = '1' AND is_total = 0), 0)::BIGINT AS n_right,
  coalesce(sum(n) FILTER (WHERE is_total = 1), 0)::BIGINT AS n_all, 'product' AS scope FROM g GROUP BY criterion""")  # fmt: skip
def by_criterion(spark, sf):
    """R13."""
    return consolidate.by_criterion(consolidate.criterion_stats(_bucketed_events(spark, sf)), "0", "1")


@query("""SELECT p_brand, criterion, count(*) AS n, md5(string_agg(value, '|' ORDER BY p_partkey)) AS material FROM (
    SELECT p_brand, p_partkey, 'p_name' AS criterion, p_name AS value FROM part
    UNION ALL SELECT p_brand, p_partkey, 'p_type', p_type FROM part) WHERE trim(value) <> '' GROUP BY ALL""")  # fmt: skip
def source_material(spark, sf):
    """A8."""
    out = consolidate.source_material(table(spark, sf, "part"), ["p_name", "p_type"], ["p_brand"], "p_partkey")
    return out.withColumn("material", F.md5(F.array_join("material", "|").cast("binary")))


@query("""WITH o AS (SELECT o_custkey AS piece, o_orderpriority AS platform, o_orderstatus AS s, o_orderkey FROM orders),
  f AS (SELECT platform, CASE s WHEN 'F' THEN 'pos' WHEN 'O' THEN 'neg' ELSE 'neu' END AS sentiment FROM (
    SELECT *, row_number() OVER (PARTITION BY piece ORDER BY o_orderkey) AS r FROM o) WHERE r = 1)
  SELECT platform, count(*) AS n_orders, count(*) FILTER (WHERE sentiment = 'pos') AS pos, count(*) FILTER (WHERE sentiment = 'neu') AS neu,
    count(*) FILTER (WHERE sentiment = 'neg') AS neg, count(*) AS n,
    count(*) FILTER (WHERE sentiment = 'pos') - count(*) FILTER (WHERE sentiment = 'neg') AS balance FROM f GROUP BY platform""")  # fmt: skip
def order_view(spark, sf):
    """A10."""
    s = F.when(F.col("o_orderstatus") == "F", "pos").when(F.col("o_orderstatus") == "O", "neg").otherwise("neu")
    rows = table(spark, sf, "orders").select(F.lit("all").alias("market"), F.col("o_custkey").alias("piece"), F.col("o_orderpriority").alias("platform"),
                                             s.alias("sentiment"), "o_orderkey")
    return consolidate.order_view(rows, "all", ["piece"], ["o_orderkey"])


@query(r"""WITH u AS (SELECT page_id, split_part(trim(url), '#', 1) AS u FROM pages),
  h AS (SELECT page_id, u, regexp_extract(u, '^https?://([^/?]+)', 1) AS host FROM u WHERE regexp_matches(u, '^https?://[^/?]+'))
  SELECT 'http://' || host AS url, count(*) AS n_pieces, count(*) FILTER (WHERE odd = 0) AS n_posts, count(*) FILTER (WHERE odd = 1) AS n_comments, min(first) AS first
  FROM (SELECT host, u, max(page_id % 2) AS odd, min(page_id) AS first FROM h GROUP BY host, u) GROUP BY host""")  # fmt: skip
def evidence_groups(spark, sf):
    """Addresses by host; odd pages stand for comments."""
    clean = numbers.clean_url(F.col("url"))
    rows = table(spark, sf, "pages").select("page_id", clean.alias("piece"), (F.col("page_id") % 2 == 1).alias("is_comment"))
    rows = rows.withColumn("url", F.concat(F.lit("http://"), F.try_parse_url("piece", F.lit("HOST"))))
    return consolidate.evidence_groups(rows, order="page_id")


@query("SELECT p_partkey, p_brand AS market, p_type AS slime_type FROM part WHERE p_brand = 'Brand#12' AND p_type = 'ECONOMY'")
def metafilter(spark, sf):
    """F1."""
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("market"), F.col("p_type").alias("slime_type"))
    return retrieval.filtered(rows, {"market": "Brand#12", "slime_type": "ECONOMY"})


@query("SELECT doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 60 AS low FROM documents")
def quality_filter(spark, sf):
    """F2 with a longer minimum, so that some rows fail."""
    return table(spark, sf, "documents").select("doc_id", rules.is_low_quality(F.col("text"), 60).alias("low"))


MARKERS = ["license", "password", "idiot", "token", "copyright"]


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'password') THEN 'password'
  WHEN contains(lower(text), 'idiot') THEN 'idiot' WHEN contains(lower(text), 'token') THEN 'token'
  WHEN contains(lower(text), 'copyright') THEN 'copyright' END AS marker FROM documents""")  # fmt: skip
def marker_first_match(spark, sf):
    """F4."""
    return table(spark, sf, "documents").select("doc_id", rules.first_marker(F.col("text"), MARKERS).alias("marker"))


@query("""SELECT doc_id, trim(text) <> '' AND (contains(lower(text), 'license') OR contains(lower(text), 'password') OR contains(lower(text), 'idiot')
  OR contains(lower(text), 'token') OR contains(lower(text), 'copyright')) AS gate FROM documents""")  # fmt: skip
def recall_gate(spark, sf):
    """F5."""
    return table(spark, sf, "documents").select("doc_id", rules.promo_gate(F.col("text"), MARKERS).alias("gate"))


@query(r"""SELECT conv_id, turn, CAST(regexp_matches(text, '\d+\s*/\s*\d+\s*이전\s*다음|완장|차단|제보') AS INTEGER) AS M,
  CAST(regexp_matches(text, '[?？]|고민|부탁|궁금') AS INTEGER) AS Q, CAST(regexp_matches(text, '좋|별로|최고|실망') AS INTEGER) AS E FROM conversations""")  # fmt: skip
def axes(spark, sf):
    """F7, F8, F10, F13 with the full lexicons; on these texts the oracle's shorter lists say the same."""
    a = rules.axes(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", *[a[c].alias(c) for c in "MQE"])


@query(r"""SELECT doc_id, regexp_replace(lower(text), '[ \t\n\r]+', '', 'g') AS k FROM documents""".replace("SELECT doc_id,", "SELECT doc_id, md5(").replace("AS k", ") AS k"))
def surface_keys(spark, sf):
    """X2, X4."""
    return table(spark, sf, "documents").select("doc_id", F.md5(text.surface_key(F.col("text")).cast("binary")).alias("k"))


@query(r"""SELECT conv_id, turn, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[\n.!?？,·…]+'), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n
  FROM conversations""")  # fmt: skip
def clause_split(spark, sf):
    """These texts hold no Korean endings, so the oracle needs only the punctuation."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(text.clauses(F.col("text"))).alias("n"))


VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_V = "[" + ", ".join(f"{x}::DOUBLE" for x in VECTOR) + "]"
DENSE = f"""d AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], {_V}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))
  * sqrt(list_dot_product({_V}, {_V}))) AS score FROM embeddings),
  dense AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS dense_rank FROM d ORDER BY score DESC, id LIMIT 8)"""


@query(f"WITH {DENSE} SELECT id, round(score, 6) AS score, dense_rank FROM dense")
def dense_topk(spark, sf):
    """T1, V10."""
    out = retrieval.dense_topk(table(spark, sf, "embeddings"), VECTOR, id="vec_id")
    return out.withColumn("score", F.round("score", 6))


TERMS = ["the", "und", "thand", "de", "the"]
SPARSE = r"""t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS tokens FROM documents),
  size AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM t),
  df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM t) GROUP BY token),
  raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, size),
  idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
  q AS (SELECT * FROM (VALUES ('the', 2), ('und', 1), ('thand', 1), ('de', 1)) AS v(token, m)),
  part AS (SELECT id, m * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)) AS x FROM (
    SELECT t.id, q.m, coalesce(idf.idf, 0) AS idf, len(tokens) AS len, len(list_filter(tokens, lambda x: x = q.token)) AS tf FROM t, q LEFT JOIN idf ON idf.token = q.token), size WHERE tf > 0),
  s AS (SELECT t.id, coalesce(sum(x), 0) AS score FROM t LEFT JOIN part ON part.id = t.id GROUP BY t.id),
  sparse AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS sparse_rank FROM s ORDER BY score DESC, id LIMIT 8)"""


def _tokenised(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.tokens(F.col("text")).alias("tokens"))


@query(f"WITH {SPARSE} SELECT id, round(score, 6) AS score, sparse_rank FROM sparse")
def bm25_topk(spark, sf):
    """T2, V9, X18."""
    return retrieval.bm25_topk(_tokenised(spark, sf), TERMS).withColumn("score", F.round("score", 6))


@query(f"""WITH {DENSE}, {SPARSE}, f AS (SELECT coalesce(dense.id, sparse.id) AS id, dense_rank, sparse_rank,
  coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) AS rrf FROM dense FULL JOIN sparse ON dense.id = sparse.id)
  SELECT id, dense_rank, sparse_rank, round(rrf, 9) AS rrf, row_number() OVER (ORDER BY f.rrf DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, id) - 1 AS rank
  FROM f ORDER BY f.rrf DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, id LIMIT 8""")  # fmt: skip
def hybrid_rrf(spark, sf):
    """T3, W3."""
    dense = retrieval.dense_topk(table(spark, sf, "embeddings"), VECTOR, id="vec_id")
    return retrieval.rrf(dense, retrieval.bm25_topk(_tokenised(spark, sf), TERMS)).withColumn("rrf", F.round("rrf", 9))


@query(f"""WITH a AS (SELECT list_transform({_V}, lambda x: x / (sqrt(list_dot_product({_V}, {_V})) + 1e-12)) AS a),
  v AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12)) AS v FROM embeddings)
  SELECT label AS id, round(max(list_dot_product(v, a)), 6) AS topic_score FROM v, a GROUP BY label""")  # fmt: skip
def max_cosine_gate(spark, sf):
    """V2, V3: embeddings of one label are the chunks of one document."""
    out = gate.max_cosine(table(spark, sf, "embeddings"), VECTOR, "label")
    return out.withColumn("topic_score", F.round("topic_score", 6))


UNIT = """u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12)) AS v FROM embeddings),
  m AS (SELECT label AS id, i - 1 AS dim, avg(v[i]) AS mean FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM u) GROUP BY ALL)"""


@query(f"WITH {UNIT} SELECT id, CAST(dim AS INTEGER) AS dim, round(mean, 6) AS mean FROM m")
def mean_vector(spark, sf):
    """V4."""
    return gate.mean_vectors(table(spark, sf, "embeddings"), "label").withColumn("mean", F.round("mean", 6))


@query(f"""WITH {UNIT}, c AS (SELECT id AS label, list(mean ORDER BY dim) AS c FROM m GROUP BY id),
  s AS (SELECT vec_id, c.label, list_dot_product(v, list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-12))) AS score FROM u, c)
  SELECT vec_id AS id, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s) WHERE r = 1""")  # fmt: skip
def nearest_centroid(spark, sf):
    """V5."""
    vectors = table(spark, sf, "embeddings")
    out = gate.nearest_centroid(vectors, gate.centroids(vectors, "label"), "vec_id")
    return out.withColumn("score", F.round("score", 6))


@query("""WITH c AS (SELECT conv_id AS batch, turn AS pos, length(text) % 3 <> 0 AS keep, length(text) % 7 AS score FROM conversations),
  e AS (SELECT *, row_number() OVER (ORDER BY batch, pos) AS e FROM c),
  k AS (SELECT *, keep AND e <= 120 AS kept FROM e),
  b AS (SELECT batch, count(*) AS size, count(*) FILTER (WHERE kept) AS n FROM k GROUP BY batch),
  p AS (SELECT batch, coalesce(sum(n) OVER w, 0) AS prior, coalesce(sum(size) OVER w, 0) AS seen FROM b WINDOW w AS (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  r AS (SELECT k.*, p.prior, p.seen, row_number() OVER (PARTITION BY batch ORDER BY kept DESC, score DESC, pos) AS r FROM k JOIN p USING (batch))
  SELECT batch, pos, kept, prior < 40 AND seen < 120 AND kept AND prior + r <= 40 AS emitted,
    prior < 40 AND seen < 120 AND kept AND NOT prior + r <= 40 AS unprocessed FROM r""")  # fmt: skip
def gate_budget(spark, sf):
    """Conversations as batches, a limit of 40."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").alias("pos"),
                                                    (F.length("text") % 3 != 0).alias("keep"), (F.length("text") % 7).alias("score"))
    return gate.budget(rows, 40, rank=[F.desc("score")]).select("batch", "pos", "kept", "emitted", "unprocessed")


@query("""SELECT md5(text) AS key, CASE WHEN count(DISTINCT source) = 1 THEN min(source) END AS owner, count(DISTINCT source) AS n_owners FROM documents GROUP BY 1""")
def unique_owner(spark, sf):
    """A15."""
    return linking.owners(table(spark, sf, "documents"), F.md5(F.col("text").cast("binary")), "source")


@query("""WITH a AS (SELECT p_name || '/' || p_size AS k, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS o FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
  b AS (SELECT p_name || '/' || p_size AS k, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS o FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
  SELECT p_partkey, CASE WHEN a.k IS NOT NULL THEN a.o ELSE b.o END AS inverted_market,
    CASE WHEN a.k IS NOT NULL AND a.o IS NOT NULL THEN 'inversion_spec' WHEN a.k IS NULL AND b.o IS NOT NULL THEN 'inversion_registry' END AS inverted_how
  FROM part LEFT JOIN a ON a.k = p_name || '/' || p_size LEFT JOIN b ON b.k = p_name || '/' || p_size""")  # fmt: skip
def market_inversion(spark, sf):
    """Even parts are the specs, odd ones the registry; an ambiguous name in the first hides the second."""
    part = table(spark, sf, "part").withColumn("product", F.concat_ws("/", "p_name", F.col("p_size").cast("string")))
    key = linking.product_key(F.col("product"))
    own = lambda rest: linking.owners(part.where(F.col("p_partkey") % 2 == rest), key, "p_brand")
    return linking.inverted(part, "product", own(0), own(1)).select("p_partkey", "inverted_market", "inverted_how")


def _nation_kb(spark, sf):
    none = F.array().cast("array<string>")
    n = table(spark, sf, "nation").select(F.col("n_name").alias("market"), F.col("n_name").alias("market_word"), F.lit(None).cast("string").alias("handle"), none.alias("handles_alt"),
                                          none.alias("aliases"), F.lit(None).cast("string").alias("choseong"), none.alias("choseong_aliases"))
    return n


@query("""SELECT c_custkey, n_name AS market, CASE WHEN n_name IS NULL THEN 0.0::DOUBLE ELSE 0.95::DOUBLE END AS confidence, n_name IS NULL AS abstained
  FROM customer LEFT JOIN nation ON c_custkey % 3 <> 0 AND c_nationkey = n_nationkey""")  # fmt: skip
def entity_link(spark, sf):
    """Nations as markets, mentioned in changed letter case and spacing by two customers of three."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lower(F.concat(F.lit(" "), "n_name")).alias("mention"))
    rows = table(spark, sf, "customer").join(F.broadcast(nation), "c_nationkey")  # 25 nations
    item = F.when(F.col("c_custkey") % 3 != 0, F.col("mention"))
    null = F.lit(None).cast("string")
    out = linking.link(rows.select("c_custkey", item.alias("item_market"), null.alias("doc_market"), null.alias("product")), _nation_kb(spark, sf))
    return out.select("c_custkey", "market", "confidence", "abstained")


@query("""SELECT p_partkey, CASE WHEN n_name IS NOT NULL AND p_partkey % 2 = 0 THEN n_name END AS hint, p_name AS rest FROM part
  LEFT JOIN nation ON n_nationkey = p_partkey % 25""")  # fmt: skip
def prefix_split(spark, sf):
    """Even parts carry a nation in front of their name."""
    nation = table(spark, sf, "nation").where("n_name not like '% %'").select((F.col("n_nationkey")).alias("k"), "n_name")
    part = table(spark, sf, "part").withColumn("k", (F.col("p_partkey") % 25).cast("int")).join(F.broadcast(nation), "k", "left")  # 25 nations
    name = F.when((F.col("p_partkey") % 2 == 0) & F.col("n_name").isNotNull(), F.concat_ws(" ", "n_name", "p_name")).otherwise(F.col("p_name"))
    out = linking.split_prefix(part.withColumn("product", name), "product", _nation_kb(spark, sf))
    return out.select("p_partkey", "hint", "rest")


@query("""SELECT o_orderkey, CASE WHEN c_custkey % 10 = 0 THEN c_name END AS seller_market,
  CASE WHEN c_custkey % 10 = 0 THEN 'seller' WHEN o_orderpriority = '1-URGENT' THEN 'promo' ELSE 'genuine' END AS review_class
  FROM orders JOIN customer ON o_custkey = c_custkey""")  # fmt: skip
def seller_partition(spark, sf):
    """Every tenth customer is a seller; seller beats promo."""
    cust = table(spark, sf, "customer")
    none = F.array().cast("array<string>")
    kb = cust.where("c_custkey % 10 = 0").select(F.col("c_name").alias("market_word"), F.upper("c_name").alias("handle"), none.alias("handles_alt"))
    posts = table(spark, sf, "orders").join(cust.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    out = linking.partition_sellers(posts, kb, "c_name", F.col("o_orderpriority") == "1-URGENT")
    return out.select("o_orderkey", "seller_market", "review_class")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, p_size AS spec_id FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 2 = 0""")
def spec_join(spark, sf):
    """Fill from the row of the same key; half of the keys have none."""
    dim = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("id"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), F.lit(None).cast("int").alias("spec_id"))
    return merge.spec_join(rows, dim, ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q", "spec_id")


@query("SELECT conv_id, turn FROM conversations WHERE turn % 2 = 1")
def incremental_cut(spark, sf):
    """Even turns were seen."""
    conv = table(spark, sf, "conversations").select("conv_id", "turn")
    return incremental.fresh(conv, conv.where("turn % 2 = 0"), ["conv_id", "turn"])


@query("""SELECT conv_id, turn, false AS is_context FROM conversations WHERE turn >= 4
  UNION ALL SELECT conv_id, turn, true FROM conversations WHERE turn = 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn >= 4)""")  # fmt: skip
def context_keep(spark, sf):
    """Turns below 4 were seen; first turns of conversations with fresh turns stay as context."""
    conv = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") == 0).alias("is_post"))
    out = incremental.fresh_with_context(conv, conv.where("turn < 4"), ["conv_id", "turn"], "conv_id", "is_post")
    return out.select("conv_id", "turn", "is_context")


@query("""WITH m AS (SELECT event_type, max(event_id) - 200 AS w FROM events WHERE event_id % 2 = 0 AND event_type <> 'click' GROUP BY event_type)
  SELECT event_id FROM events LEFT JOIN m USING (event_type) WHERE w IS NULL OR event_id > w""")  # fmt: skip
def watermark_cut(spark, sf):
    """Clicks have no history and pass whole."""
    ev = table(spark, sf, "events").select("event_id", "event_type", F.col("event_id").cast("string").alias("no"))
    marks = incremental.watermarks(ev.where("event_id % 2 = 0 and event_type <> 'click'"), ["event_type"], "no")
    return incremental.above(ev, marks, ["event_type"], F.col("event_id")).select("event_id")


@query("""SELECT CAST(conv_id AS VARCHAR) AS thread, count(*) AS n_pieces, count(*) FILTER (WHERE turn = 0) AS n_posts, CAST(ceil(count(*) / 3.0) AS BIGINT) AS n_calls FROM conversations GROUP BY conv_id""")
def thread_groups(spark, sf):
    """J19 with three pieces per call."""
    conv = table(spark, sf, "conversations").withColumn("is_post", F.col("turn") == 0)
    return threads.thread_groups(conv, "conv_id", "is_post", 3)


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations)
  SELECT conv_id, turn, r // 3 AS chunk, r % 3 + 1 AS place, false AS is_context FROM c
  UNION ALL SELECT c.conv_id, c.turn, k.chunk, 0, true FROM c JOIN (SELECT DISTINCT conv_id, r // 3 AS chunk FROM c WHERE r >= 3) k USING (conv_id) WHERE c.turn = 0""")  # fmt: skip
def thread_chunks(spark, sf):
    """W8 with three pieces per call."""
    conv = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") == 0).alias("is_post"))
    return threads.thread_chunks(conv, "conv_id", "turn", "is_post", 3).drop("is_post")


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN length(text) % 2 = 0 THEN role END AS market FROM conversations),
  p AS (SELECT conv_id, market AS post FROM c WHERE turn = 0)
  SELECT c.conv_id, turn, coalesce(market, post) AS market, market IS NULL AND post IS NOT NULL AS inherited FROM c LEFT JOIN p ON c.conv_id = p.conv_id""")  # fmt: skip
def inherit_market(spark, sf):
    """J20."""
    conv = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") == 0).alias("is_post"), F.when(F.length("text") % 2 == 0, F.col("role")).alias("market"))
    return threads.inherit_market(conv, "conv_id", "is_post", "market", "turn").drop("is_post")


NAMES = "n AS (SELECT DISTINCT name, lower(regexp_replace(name, '\\s+', '', 'g')) AS k FROM (SELECT n_name AS name FROM nation UNION SELECT p_name FROM part UNION SELECT p_type FROM part UNION SELECT p_brand FROM part))"


def _names(spark, sf):
    part = table(spark, sf, "part")
    return registry.known_names((table(spark, sf, "nation"), "n_name"), (part, "p_name"), (part, "p_type"), (part, "p_brand"))


@query(f"WITH {NAMES} SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.k <> b.k AND starts_with(b.k, a.k)")
def prefix_pairs(spark, sf):
    """J14, A16."""
    return registry.prefix_pairs(_names(spark, sf))


@query(f"""WITH {NAMES} SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.k <> b.k AND a.k[1] = b.k[1] AND levenshtein(a.k, b.k) = 1
  AND (length(a.k) < length(b.k) OR (length(a.k) = length(b.k) AND a.name < b.name))""")  # fmt: skip
def edit1_pairs(spark, sf):
    """J15, X15."""
    return registry.edit1_pairs(_names(spark, sf))


@query("""WITH n AS (SELECT DISTINCT p_size AS piece, p_name AS name FROM part UNION SELECT p_size, lower(p_type) FROM part)
  SELECT a.name AS "inner", b.name AS "outer", count(*) AS n_pieces FROM n a JOIN n b ON a.piece = b.piece AND length(a.name) < length(b.name) AND contains(b.name, a.name) GROUP BY ALL""")  # fmt: skip
def containment_pairs(spark, sf):
    """Part names and types of one size."""
    part = table(spark, sf, "part")
    rows = part.select("p_size", F.col("p_name").alias("name")).unionByName(part.select("p_size", F.lower("p_type").alias("name")))
    return registry.containment_pairs(rows, "p_size", "name")


@query("SELECT d.doc_id AS id, b.item_id AS canonical FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def vocabulary_hits(spark, sf):
    """Benchmark passages as vocabulary."""
    vocabulary = table(spark, sf, "benchmark").select(F.col("item_id").alias("canonical"), F.col("text").alias("form"))
    return registry.vocabulary_hits(table(spark, sf, "documents"), vocabulary, "doc_id", "text")


WORDS = "list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) >= 9 AND regexp_matches(w, '^[a-z]+$')))"


@query(f"""WITH d AS (SELECT source, doc_id, {WORDS} AS tags FROM documents), t AS (SELECT source, count(*) AS n FROM d GROUP BY source),
  r AS (SELECT source, doc_id, unnest(tags) AS tag FROM d)
  SELECT r.source AS market, tag, count(*) AS n_posts, n AS n_total, min(doc_id) AS first_seen, max(doc_id) AS last_seen,
    array_to_string(list_slice(list(doc_id ORDER BY doc_id), 1, 3), ',') AS permalinks,
    CASE WHEN n >= 8 AND count(*) >= 0.35 * n THEN 'market_tag' ELSE 'product' END AS class FROM r JOIN t ON r.source = t.source GROUP BY r.source, tag, n""")  # fmt: skip
def product_registry(spark, sf):
    """Long words as tags, source as market."""
    words = F.filter(F.split(F.lower("text"), " "), lambda w: (F.length(w) >= 9) & w.rlike("^[a-z]+$"))
    posts = table(spark, sf, "documents").select("source", "doc_id", words.alias("tags"), F.col("doc_id").cast("string").alias("link"))
    out = registry.product_registry(posts, "source", "tags", "doc_id", "link")
    return out.withColumn("permalinks", F.array_join("permalinks", ","))


@query("SELECT p_name AS product, count(*) AS n_reviews, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS markets FROM part GROUP BY p_name")
def name_stats(spark, sf):
    """A14."""
    out = registry.name_stats(table(spark, sf, "part"), "p_name", "p_brand")
    return out.withColumn("markets", F.array_join("markets", ","))


@query("""SELECT p_brand, array_to_string(list_slice(list(p_name ORDER BY p_name), 1, 24), ',') AS names, greatest(count(*) - 24, 0) AS n_more
  FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY p_brand""")  # fmt: skip
def capped_vocabulary(spark, sf):
    """T8."""
    rows = table(spark, sf, "part").select("p_brand", "p_name").distinct()
    return registry.capped_vocabulary(rows, "p_brand", "p_name").withColumn("names", F.array_join("names", ","))


@query("""WITH n AS (SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 5 <> 0) WHERE r = 1)
  SELECT o_custkey, o_orderkey, o_orderstatus FROM n WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 5 <> 0)
  UNION ALL SELECT NULL, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 5 = 0""")  # fmt: skip
def insert_ignore(spark, sf):
    """Finished orders are there, the others come in; customers divisible by five stand for NULL keys, which never conflict."""
    key = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey"))
    rows = table(spark, sf, "orders").select(key.alias("o_custkey"), "o_orderkey", "o_orderstatus")
    return merge.insert_ignore(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F'"), ["o_custkey"], ["o_orderkey"])


@query("""WITH o AS (SELECT c_custkey AS k, c_mktsegment AS a, c_acctbal AS b FROM customer),
  i AS (SELECT o_custkey AS k, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS a, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS b FROM orders),
  f AS (SELECT k, arg_max(a, seq) FILTER (WHERE a IS NOT NULL) AS a, arg_max(b, seq) FILTER (WHERE b IS NOT NULL) AS b FROM i GROUP BY k)
  SELECT coalesce(o.k, f.k) AS k, coalesce(f.a, o.a) AS a, coalesce(f.b, o.b) AS b FROM o FULL JOIN f ON o.k = f.k""")  # fmt: skip
def coalesce_upsert(spark, sf):
    """The last value that is not NULL, column by column."""
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("a"), F.col("c_acctbal").alias("b"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("a"), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("b"))
    return merge.coalesce_upsert(old, new, ["k"], "at")


@query("""WITH o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS s, c_nationkey AS v FROM customer),
  n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS s, -1 AS v FROM customer WHERE c_acctbal < 0)
  SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k = o.k AND n.s IS NOT DISTINCT FROM o.s) UNION ALL SELECT * FROM n""")  # fmt: skip
def summary_upsert(spark, sf):
    """Half of the keys have a NULL part, which equals itself."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("s"), F.col("c_nationkey").alias("v"), "c_acctbal")
    return merge.replace_by_key(rows.drop("c_acctbal"), rows.where("c_acctbal < 0").drop("c_acctbal").withColumn("v", F.lit(-1)), ["k", "s"])


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_custkey % 5 <> 0) WHERE r = 1
  UNION ALL SELECT NULL, o_orderkey FROM orders WHERE o_custkey % 5 = 0""")  # fmt: skip
def latest_wins(spark, sf):
    """Orders are captures of a customer; rows without an id stay."""
    key = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey"))
    rows = table(spark, sf, "orders").select(key.alias("o_custkey"), "o_orderkey", "o_orderdate")
    return merge.latest_items(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


def _overlay(spark, sf):
    part = table(spark, sf, "part")
    a = part.where("p_partkey % 7 = 0").select("p_partkey", F.lit("p_name").alias("field"), F.when(F.col("p_partkey") % 2 == 0, F.lit("fixed")).alias("value"), (F.col("p_partkey") % 3 == 0).alias("unknown"))
    b = part.where("p_partkey % 11 = 0").select("p_partkey", F.lit("p_type").alias("field"), F.upper("p_name").alias("value"), F.lit(False).alias("unknown"))
    return a.unionByName(b)


OVERLAID = """o AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'fixed' END ELSE p_name END AS p_name,
  CASE WHEN p_partkey % 11 = 0 THEN upper(p_name) ELSE p_type END AS p_type FROM part)"""


@query(f"WITH {OVERLAID} SELECT * FROM o")
def overlay_apply(spark, sf):
    """A human NULL beats a value; unknown entries do nothing."""
    specs = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return merge.overlay_apply(specs, _overlay(spark, sf), ["p_partkey"], ["p_name", "p_type"])


@query(f"""WITH {OVERLAID}, c AS (SELECT p_partkey, 'p_name' AS field, part.p_name AS was, o.p_name AS now FROM part JOIN o USING (p_partkey)
  UNION ALL SELECT p_partkey, 'p_type', part.p_type, o.p_type FROM part JOIN o USING (p_partkey)) SELECT * FROM c WHERE was IS DISTINCT FROM now""")  # fmt: skip
def overlay_changes(spark, sf):
    """U4."""
    specs = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return merge.overlay_changes(specs, _overlay(spark, sf), ["p_partkey"], ["p_name", "p_type"])


@query("SELECT p_partkey FROM part WHERE (p_partkey % 7 = 0 OR p_partkey % 11 = 0) AND p_partkey % 2 = 1")
def overlay_orphans(spark, sf):
    """Specs of even parts only."""
    return merge.overlay_orphans(table(spark, sf, "part").where("p_partkey % 2 = 0"), _overlay(spark, sf), ["p_partkey"])


@query(f"WITH {OVERLAID} SELECT p_partkey, 'p_name' AS missing FROM o WHERE p_name IS NULL")
def review_queue(spark, sf):
    """J23."""
    specs = merge.overlay_apply(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), _overlay(spark, sf), ["p_partkey"], ["p_name", "p_type"])
    out = merge.review_queue(specs, _overlay(spark, sf), ["p_partkey"], ["p_name", "p_type"])
    return out.withColumn("missing", F.array_join("missing", ","))


@query(EV + " SELECT id, row_number() OVER (PARTITION BY md5(text) ORDER BY coalesce(quality, -1) DESC, id) > 1 AS dropped FROM ev")
def richest_fold(spark, sf):
    """W6."""
    rows = reviews(spark, sf).select("id", F.md5(F.col("text").cast("binary")).alias("k"), F.coalesce("quality", F.lit(-1)).alias("score"))
    return merge.richest_fold(rows, ["k"], "score", "id").select("id", "dropped")


@query("""WITH c AS (SELECT conv_id AS doc, turn AS pos, CASE WHEN turn % 3 <> 2 THEN role END AS name, md5(text) AS fp, length(text) % 4 AS score FROM conversations),
  k AS (SELECT *, CASE WHEN name <> '' THEN 'n:' || lower(name) WHEN score > 0 THEN 'h:' || fp ELSE 'p:' || pos END AS k FROM c)
  SELECT doc, first AS pos, name, fp, score FROM (SELECT *, min(pos) OVER (PARTITION BY doc, k) AS first, row_number() OVER (PARTITION BY doc, k ORDER BY score DESC, pos) AS r FROM k) WHERE r = 1""")  # fmt: skip
def fold_by_product(spark, sf):
    """W7."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.when(F.col("turn") % 3 != 2, F.col("role")).alias("name"),
                                                    F.md5(F.col("text").cast("binary")).alias("fp"), (F.length("text") % 4).alias("score"))
    return merge.fold_by_product(rows, "doc", "name", "fp", "score", "pos")


@query("""WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), t AS (SELECT event_type, count(*) AS n FROM events WHERE ts < '2024-01-29' AND event_type <> 'view' GROUP BY event_type)
  SELECT n.event_type, n.n AS n_now, t.n AS n_then FROM n LEFT JOIN t USING (event_type) WHERE n.n >= 3 AND (t.n IS NULL OR abs(n.n - t.n) >= 3)""")  # fmt: skip
def stale_summaries(spark, sf):
    """Summaries were made some days before the end; one kind has none."""
    ev = table(spark, sf, "events")
    now = ev.groupBy("event_type").agg(F.count("*").alias("n_reviews"))
    then = ev.where("ts < '2024-01-29' and event_type <> 'view'").groupBy("event_type").agg(F.count("*").alias("n_reviews"))
    return merge.stale_summaries(then, now, ["event_type"])


@query(EV + """, b AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, id DESC) AS r FROM ev) SELECT id, n_chars FROM b WHERE r = 1 ORDER BY n_chars DESC, id DESC LIMIT 50""")
def review_list(spark, sf):
    """The limit comes after folding equal texts."""
    rows = reviews(spark, sf).select("id", "n_chars", F.md5(F.col("text").cast("binary")).alias("k"))
    return merge.review_list(rows, "k", [F.desc("n_chars"), F.desc("id")], 50).select("id", "n_chars")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 5 OFFSET 10")
def client_page(spark, sf):
    """T7."""
    return merge.client_page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 2, id="o_orderkey")


@query(EV + """, g AS (SELECT 300 + 25 * unnest(range(15)) AS tau), s AS (SELECT (n_chars % 1000) / 1000.0::DOUBLE AS s, quality = 1 AS t FROM ev WHERE quality IS NOT NULL)
  SELECT CAST(tau AS INTEGER) AS tau, count(*) FILTER (WHERE s * 1000 >= tau AND t) AS tp, count(*) FILTER (WHERE s * 1000 >= tau AND NOT t) AS fp,
    count(*) FILTER (WHERE NOT s * 1000 >= tau AND t) AS fn, count(*) FILTER (WHERE NOT s * 1000 >= tau AND NOT t) AS tn FROM g, s GROUP BY tau""")  # fmt: skip
def tau_sweep(spark, sf):
    """A21."""
    rows = reviews(spark, sf).where("quality is not null").select(((F.col("n_chars") % 1000) / 1000.0).alias("s"), (F.col("quality") == 1).alias("t"))
    return evaluate.tau_sweep(rows, "s", "t")


@query("SELECT vec_id, CAST(vec_id % 5 AS INTEGER) AS fold, vec_id % 3 = 0 AS holdout FROM embeddings")
def kfold_split(spark, sf):
    """W9."""
    rows = table(spark, sf, "embeddings").select("vec_id")
    return evaluate.holdout_split(evaluate.kfold(rows, "vec_id"), "vec_id")


@query("SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM conversations GROUP BY role, length(text) % 50) GROUP BY size")
def tie_groups(spark, sf):
    """W12."""
    rows = table(spark, sf, "conversations").withColumn("k", F.length("text") % 50)
    return evaluate.tie_groups(rows, ["role", "k"])


@query("""WITH f AS (SELECT length(text) % 2 = 0 AS keep, row_number() OVER (ORDER BY conv_id, turn) AS r FROM conversations)
  SELECT CAST(b AS INTEGER) AS budget, count(*) FILTER (WHERE keep) AS n_taken FROM f, (SELECT unnest(range(1, 31)) AS b) WHERE r <= b GROUP BY b""")  # fmt: skip
def budget_sweep(spark, sf):
    """W10, W11."""
    rows = table(spark, sf, "conversations").withColumn("keep", F.length("text") % 2 == 0)
    return evaluate.budget_sweep(rows, ["conv_id", "turn"], "keep", 30)


@query("SELECT md5(trim(text)) AS text_md5, count(*) AS n_rows, count(DISTINCT source) AS n_labels FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def integrity_check(spark, sf):
    """A23."""
    return evaluate.integrity_check(table(spark, sf, "documents"), "text", ["source"])


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_passed FROM orders")
def pass_rate(spark, sf):
    """Gold says F for every order; answers exist for all."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    gold = rows.withColumn("o_orderstatus", F.lit("F"))
    return evaluate.pass_rate(rows, gold, "o_orderkey", ["o_orderstatus"])


@query("""SELECT event_type AS kind, CAST(user_id % 4 AS VARCHAR) AS key, count(*) AS n_items, min(ts) AS oldest, max(ts) AS newest, max(ts) AS last_scrape, round(sum(value), 2) AS cost
  FROM events GROUP BY GROUPING SETS ((event_type, CAST(user_id % 4 AS VARCHAR)), (event_type))""")  # fmt: skip
def manifest(spark, sf):
    """A19."""
    ev = table(spark, sf, "events").withColumn("key", (F.col("user_id") % 4).cast("string"))
    return evaluate.manifest(ev, "event_type", "key", "ts", "ts", "value").withColumn("cost", F.round("cost", 2))


@query("""WITH k AS (SELECT o_orderpriority AS source, o_clerk, md5(o_orderstatus) AS t, count(*) AS k FROM (SELECT *, o_custkey % 7 AS o_clerk FROM orders) GROUP BY ALL),
  c AS (SELECT source, count(*) FILTER (WHERE k > 1) AS dup_groups, sum(CASE WHEN k > 1 THEN k - 1 ELSE 0 END)::BIGINT AS surplus FROM k GROUP BY source),
  r AS (SELECT o_orderpriority AS source, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS m, o_custkey % 7 AS p FROM orders)
  SELECT r.source, count(*) AS n_rows, count(m) AS with_market, count(p) AS with_product, count(m) FILTER (WHERE p IS NOT NULL) AS with_both,
    count(*) FILTER (WHERE m IS NULL AND p IS NULL) AS with_neither, count(DISTINCT m) AS n_markets, count(DISTINCT p) AS n_products, any_value(dup_groups) AS dup_groups, any_value(surplus) AS surplus
  FROM r JOIN c ON r.source = c.source GROUP BY r.source""")  # fmt: skip
def attribution_audit(spark, sf):
    """A20."""
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("market"),
                                             (F.col("o_custkey") % 7).alias("product"), F.col("o_orderstatus").alias("text"))
    return evaluate.attribution_audit(rows, "source", "market", "product", "text")


@query("""WITH a AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 0),
  b AS (SELECT o_orderkey AS raw_key, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 1)
  SELECT a.o_custkey, a.o_orderkey, b.raw_key FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.k = b.k""")  # fmt: skip
def occurrence_join(spark, sf):
    """K-th occurrence meets k-th occurrence."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    raw = rows.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "raw_key")
    return evaluate.occurrence_join(rows.where("o_orderkey % 2 = 0"), raw, "o_custkey", "o_orderkey", "raw_key")


@query("SELECT count(*) AS calls, count(*) FILTER (WHERE o_orderstatus = 'P') AS errors, sum(o_custkey)::BIGINT AS n_in, sum(o_custkey // 2)::BIGINT AS n_cached, sum(o_orderkey)::BIGINT AS n_out, round(sum(((o_custkey - o_custkey // 2) * 0.75 + (o_custkey // 2) * 0.075 + o_orderkey * 4.5) / 1e6), 4) AS cost FROM orders")
def ledger_summary(spark, sf):
    """Orders as a ledger of calls at fixed prices."""
    half = F.floor(F.col("o_custkey") / 2).cast("long")
    cost = numbers.call_cost(F.col("o_custkey"), half, F.col("o_orderkey"), F.lit(0.75), F.lit(0.075), F.lit(4.5))
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", "failed").alias("error"), F.col("o_custkey").alias("n_in"),
                                             half.alias("n_cached"), F.col("o_orderkey").alias("n_out"), cost.alias("cost"))
    return evaluate.ledger_summary(rows).withColumn("cost", F.round("cost", 4))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_path(spark, sf):
    """N3."""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT c_custkey, CAST(nullif(regexp_extract(c_name, '-?\\d[\\d,]*'), '') AS INTEGER) AS n FROM customer")
def first_number(spark, sf):
    """N1."""
    return table(spark, sf, "customer").select("c_custkey", numbers.first_int(F.col("c_name")).alias("n"))


@query()
def html_extract(spark, sf):
    """S3: rows only."""
    return pages.extract_text(table(spark, sf, "pages"), "page_id", "html")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf):
    """Tumbling windows, beyond the review domain."""
    out = windows.tumbling(table(spark, sf, "events"), ["event_type"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start, event_type, count(*) AS n
  FROM events, (VALUES (0), (1), (2), (3)) AS v(k) GROUP BY ALL""")  # fmt: skip
def sliding_events(spark, sf):
    """Sliding windows, beyond the review domain."""
    out = windows.sliding(table(spark, sf, "events"), ["event_type"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT l_linenumber AS bucket, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_wanted FROM lineitem GROUP BY 1")
def axis_report(spark, sf):
    """Line numbers as buckets, returns as what is wanted."""
    rows = table(spark, sf, "lineitem").withColumn("wanted", F.col("l_returnflag") == "R")
    return evaluate.axis_report(rows, "l_linenumber", "wanted")


@query("""SELECT md5(text) AS text_md5, CASE WHEN regexp_matches(text, '[!?]') THEN true WHEN regexp_matches(text, '[0-9]') THEN false END AS keep
  FROM (SELECT DISTINCT text FROM documents)""")  # fmt: skip
def weak_labels(spark, sf):
    """The first of two patterns decides; equal texts count once."""
    out = evaluate.weak_labels(table(spark, sf, "documents"), "text", [("[!?]", True), ("[0-9]", False)])
    return out.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "keep")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1) AS s USING (l_orderkey)
  ORDER BY size DESC, l_orderkey, l_linenumber LIMIT 100""")  # fmt: skip
def largest_threads_first(spark, sf):
    """Orders as threads; the first hundred lines are the batch."""
    return evaluate.fill_batch(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", 100).select("l_orderkey", "l_linenumber")


@query("""SELECT source, doc_id, md5(substring(text, 1, 200)) AS shown_md5 FROM documents
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 8 ORDER BY source, doc_id LIMIT 130""")  # fmt: skip
def labelling_sample(spark, sf):
    """The first eight documents of each source, at most 130, cut for display: the sample is the feature."""
    out = evaluate.harvest(table(spark, sf, "documents"), "source", "doc_id", "text")
    return out.select("source", "doc_id", F.md5(F.col("text").cast("binary")).alias("shown_md5"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
  SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, s""")  # fmt: skip
def session_events(spark, sf):
    """Sessions, beyond the review domain."""
    out = windows.sessions(table(spark, sf, "events"), ["user_id"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT DISTINCT p_brand AS market FROM part")
def list_markets(spark, sf):
    """R1."""
    return table(spark, sf, "part").select(F.col("p_brand").alias("market")).distinct().orderBy("market")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#12'")
def list_products(spark, sf):
    """R2, R14."""
    return table(spark, sf, "part").where("p_brand = 'Brand#12'").select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


QUERIES |= tables.QUERIES | mechanisms.QUERIES
ORACLES |= tables.ORACLES | mechanisms.ORACLES
