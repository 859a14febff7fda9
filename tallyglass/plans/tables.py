"""Rules of the review domain over the driver's tables, each with SQL that states the rule in its own way.

The tables hold no Korean reviews, so the rows are derived from theirs: names of ``part`` spelled letter by letter in
Hangul, texts of ``documents`` with a sentence that a rule is about, ``lineitem`` as reviews of parts, ``orders`` as
posts of customers. The SQL knows which rows got which sentence and does not look for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions import lexicon as L
from tallyglass.functions import numbers as N
from tallyglass.functions import rules as R
from tallyglass.functions import text as X
from tallyglass.operators import evaluate, gate, hooks, linking, maintenance, merge, registry, threads
from tallyglass.sources import pages, rawlog, social
from tallyglass.streaming import incremental

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Letters of names and what stands for them in Hangul; the last eight are jamo alone.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SYLLABLES = "가깨냐더떠려모뵤빠수쓰야자쩨초코티파ㄱㄴㄷㄹㅁㅂㅅㅇ"
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㄱㄴㄷㄹㅁㅂㅅㅇ"


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_rest(number: str, n: int, cases: dict[int, Column | str | None], rest: Column | None = None) -> Column:
    """The case of ``number`` modulo ``n``."""
    out = F.lit(rest) if rest is None else rest
    for k, v in cases.items():
        out = F.when(F.col(number) % n == k, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def joined(x: Column) -> Column:
    return F.array_join(x, "|")


def digest(x: Column) -> Column:
    return F.md5(x.cast("binary"))


# --- names


@query(f"""SELECT p_partkey, regexp_replace(translate(p_name, '{LETTERS}', '{INITIALS}'), '[^ㄱ-ㅎ]', '', 'g') AS initials,
  regexp_matches(substr(p_name, 1, 2), '^[s-z]+$') AS alone FROM part""")  # fmt: skip
def hangul_names(spark, sf):
    """Initial consonants of names in Hangul, and names of jamo alone."""
    name = F.translate("p_name", LETTERS, SYLLABLES)
    return table(spark, sf, "part").select("p_partkey", X.choseong(name).alias("initials"), X.is_choseong_only(F.substring(name, 1, 2)).alias("alone"))


@query("SELECT p_partkey, p_partkey % 5 IN (0, 2, 3) AS word FROM part")
def part_words(spark, sf):
    """types with a space inside, names not remembered and jamo alone are no products; names and NULL are not told so."""
    types = F.array(*[F.lit(t[0] + " " + t[1:]) for t in L.TYPES])
    kind = F.get(types, (F.col("p_partkey") % len(L.TYPES)).cast("int"))
    name = by_rest("p_partkey", 5, {0: kind, 1: F.col("p_name"), 2: F.concat(F.lit("어쩌구 "), "p_name"), 3: "ㅇㅉ ㄴ"})
    return table(spark, sf, "part").select("p_partkey", R.is_non_product_word(name).alias("word"))


@query("""SELECT p_partkey, p_partkey % 4 IN (0, 1) AS label, p_partkey % 4 = 3 AS known FROM part""")
def part_sale_labels(spark, sf):
    """F16: a form of sale with or without a count is no product, unless a known product is called so."""
    parts = table(spark, sf, "part")
    name = by_rest("p_partkey", 4, {0: F.concat(F.lit("비매 "), F.col("p_size").cast("string"), F.lit("차")), 1: "랜덤박스", 2: F.col("p_name"), 3: F.concat("p_name", F.lit("비매"))})
    rows = parts.withColumn("name", name)
    known = rows.where("p_partkey % 4 = 3").select("name")
    rows, some = maintenance.with_known(rows, "name", known)
    return rows.select("p_partkey", R.is_sale_label(F.col("name"), F.col("is_known"), F.lit(some)).alias("label"), F.col("is_known").alias("known"))


@query("""SELECT p_partkey, lower(replace(p_name, ' ', '') || replace(p_brand, ' ', '')) AS tag, lower(replace(p_name, ' ', '') || replace(p_brand, ' ', '')) AS hashtag FROM part""")
def part_tag_keys(spark, sf):
    """White space, underscores, dots and letter case do not tell names apart; a hashtag loses its hashes."""
    name = F.concat_ws("_. ", F.initcap("p_name"), "p_brand")
    return table(spark, sf, "part").select("p_partkey", X.tag_key(name).alias("tag"), X.hashtag_key(F.concat(F.lit(" ##"), name)).alias("hashtag"))


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) || '|slime|' || p_brand_key AS tags,
    split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) AS products
  FROM (SELECT *, replace(p_brand, '#', '_') AS p_brand_key FROM part)""")  # fmt: skip
def part_hashtags(spark, sf):
    """Distinct hashtags in order; generic ones and the market's own name no product."""
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    brand = F.translate("p_brand", "#", "_")
    caption = F.concat(F.lit("new #"), word(1), F.lit(" #"), word(2), F.lit("! #slime #"), brand, F.lit(" #"), word(1))
    own = X.market_exclusions(brand, F.lit(None).cast("string"), F.lit(None).cast("string"), F.array().cast("array<string>"))
    return table(spark, sf, "part").select("p_partkey", joined(X.hashtags(caption)).alias("tags"), joined(X.product_hashtags(caption, own)).alias("products"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 2 THEN p_name WHEN 3 THEN '[' || p_brand || '] ' || p_name END AS shown FROM part""")
def part_evidence_shown(spark, sf):
    """the market in front goes only where a slash follows."""
    head = F.concat(F.lit(" ["), "p_brand", F.lit("]"))
    text = by_rest("p_partkey", 4, {0: F.concat(head, F.lit(" / "), "p_name"), 1: F.concat(head, F.lit("/ ")), 2: F.col("p_name"), 3: F.concat(head, F.lit(" "), "p_name")})
    return table(spark, sf, "part").select("p_partkey", X.display_evidence(text).alias("shown"))


@query("""SELECT p_partkey, trim(coalesce(m || ' ', '') || p || CASE WHEN p = '슬라임' THEN '' ELSE ' 슬라임' END) AS product, CASE WHEN m IS NULL THEN '' ELSE m || ' 슬라임' END AS market
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS m, CASE WHEN p_partkey % 3 = 0 THEN '슬라임' ELSE p_name END AS p FROM part)""")  # fmt: skip
def part_anchors(spark, sf):
    """The sentence that texts are compared with; the domain word comes once."""
    market, product = F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")), F.when(F.col("p_partkey") % 3 == 0, F.lit(" 슬라임")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", X.anchor(market, product).alias("product"), X.anchor(market, product, scope="market").alias("market"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_type ELSE p_type || ', ' || p_name END AS types,
  substr(p_name, 1, 1) AS letter, CAST(CAST('0x' || substr(md5(p_name), 1, 8) AS BIGINT) % 8 AS INTEGER) AS colour FROM part""")  # fmt: skip
def part_labels(spark, sf):
    """X19, X20, X21."""
    types = F.slice(F.array("p_type", "p_name"), F.lit(1), F.col("p_size") % 3)
    mark = X.monogram(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", X.join_types(types).alias("types"), mark["char"].alias("letter"), mark["colour"].alias("colour"))


PART_ITEM = """item AS (SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_brand END AS market, CASE WHEN p_size % 3 > 0 THEN p_name END AS scent,
    CASE WHEN p_size % 2 = 0 THEN p_type END AS texture, CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 2 THEN p_brand END AS summary,
    p_name AS evidence, CASE p_partkey % 4 WHEN 0 THEN 'pos' WHEN 1 THEN 'neu' WHEN 2 THEN 'neg' END AS sentiment, p_size % 4 AS rating FROM part)"""  # fmt: skip


def part_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).alias("market"), F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("scent"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("texture"), by_rest("p_partkey", 3, {0: " ", 2: F.col("p_brand")}).alias("summary"),
        F.col("p_name").alias("evidence"), by_rest("p_partkey", 4, {0: "pos", 1: "neu", 2: "neg"}).alias("sentiment"), (F.col("p_size") % 4).cast("double").alias("rating"),
        F.lit(None).cast("string").alias("none"),
    )


@query(f"""WITH {PART_ITEM} SELECT p_partkey, concat_ws(' / ', '[' || coalesce(market, '마켓미상') || ']', '향 ' || scent, '질감 ' || texture,
    CASE WHEN summary IS NULL THEN '총평 ' || evidence WHEN summary <> ' ' THEN '총평 ' || summary END,
    CASE sentiment WHEN 'pos' THEN '긍정' WHEN 'neu' THEN '중립' WHEN 'neg' THEN '부정' END) AS line FROM item""")  # fmt: skip
def part_lines(spark, sf):
    """NULL and blank parts are left out; evidence stands in for a missing summary, not for a blank one."""
    at = {"product": "none", "sound": "none", "longevity": "none"}
    item = F.struct(*[F.col(at.get(c, c)).alias(c) for c in ("market", "product", "scent", "texture", "sound", "longevity", "summary", "evidence", "sentiment")])
    return part_items(spark, sf).select("p_partkey", X.render_review(item).alias("line"))


@query(f"""WITH {PART_ITEM} SELECT p_partkey, CAST(2 * (scent IS NOT NULL)::INT + 2 * (texture IS NOT NULL)::INT + (coalesce(summary, ' ') <> ' ')::INT + (rating <> 0)::INT AS INTEGER) AS score,
    '{{"scent":' || coalesce('"' || scent || '"', 'null') || ',"texture":' || coalesce('"' || texture || '"', 'null') || '}}' AS print FROM item""")  # fmt: skip
def part_scores(spark, sf):
    """N6, N7."""
    score = N.filled_score([F.col("scent"), F.col("texture")], F.col("summary"), F.col("rating"))
    return part_items(spark, sf).select("p_partkey", score.alias("score"), N.held_fingerprint(F.struct("scent", "texture")).alias("print"))


@query("""SELECT p_partkey, p_size % 3 > 0 AND p_partkey % 2 = 0 AS ok FROM part""")
def part_product_posts(spark, sf):
    """an official attribute, and the name among the tags."""
    null = F.lit(None).cast("string")
    scent = by_rest("p_size", 3, {0: " "}, F.col("p_type"))
    tags = F.array(F.lit("new"), F.when(F.col("p_partkey") % 2 == 0, F.translate("p_name", " ", "_")).otherwise(F.lit("other")))
    return table(spark, sf, "part").select("p_partkey", R.is_product_post(scent, null, null, null, F.col("p_name"), tags).alias("ok"))


@query("""SELECT market, tag FROM (SELECT p_brand AS market, p_name || p_partkey AS tag, p_size FROM part) WHERE p_size % 2 = 0""")
def part_registry(spark, sf):
    """Product rows only."""
    kind = by_rest("p_size", 2, {0: "product"}, F.lit("market_tag"))
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("market"), F.concat("p_name", "p_partkey").alias("tag"), F.col("p_size").alias("n_posts"), kind.alias("class"))
    return registry.registry_products(rows).select("market", "tag")


@query("""WITH t AS (SELECT p_name || ' ' || p_size AS tag, p_brand, p_partkey FROM part), one AS (SELECT tag, min(p_brand) AS market FROM t GROUP BY tag HAVING count(DISTINCT p_brand) = 1)
  SELECT tag AS product, market, count(*) AS n_reviews FROM lineitem JOIN t ON l_partkey = p_partkey JOIN one USING (tag) GROUP BY ALL""")  # fmt: skip
def part_aliases(spark, sf):
    """Names of one market alone that reviews use."""
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("market"), F.concat_ws(" ", "p_name", "p_size").alias("tag"))
    used = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("tag").alias("product"))
    return registry.registry_aliases(parts, used).select("product", "market", "n_reviews")


@query("""WITH n AS (SELECT DISTINCT p_name || p_size % 4 * 4 AS name FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT p_name FROM part), f AS (SELECT name, lower(replace(name, ' ', '')) AS k FROM n),
  s AS (SELECT p_name AS product, count(*) AS n, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS m FROM part GROUP BY 1),
  p AS (SELECT 'prefix' AS kind, a.name AS a, b.name AS b FROM f a JOIN f b ON length(a.k) < length(b.k) AND starts_with(b.k, a.k)
    UNION ALL SELECT 'edit1', a.name, b.name FROM f a JOIN f b ON a.k <> b.k AND levenshtein(a.k, b.k) = 1 AND a.k[1] = b.k[1] AND (length(a.k), a.name) < (length(b.k), b.name))
  SELECT kind, a, b, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b, x.m AS markets_a FROM p LEFT JOIN s x ON x.product = a LEFT JOIN s y ON y.product = b""")  # fmt: skip
def part_alias_candidates(spark, sf):
    """Pairs of names, with the review counts and markets of both."""
    parts = table(spark, sf, "part")
    numbered = parts.where("p_size % 2 = 0").select(F.concat("p_name", (F.col("p_size") % 4 * 4).cast("string")).alias("name"))
    names = registry.known_names((numbered, "name"), (parts, "p_name"))
    stats = registry.name_stats(parts.select(F.col("p_name").alias("product"), F.col("p_brand").alias("market")))
    out = registry.alias_candidates(names, stats)
    return out.select("kind", "a", "b", "n_a", "n_b", joined(F.col("markets_a")).alias("markets_a"))


# --- addresses, ids and times


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.instagram.com/p/Ab_' || page_id || '/?x=1' WHEN 1 THEN 'http://m.instagram.com/reel/X-' || page_id
    WHEN 2 THEN regexp_replace(url, '#.*', '') END AS clean,
  CASE page_id % 4 WHEN 0 THEN 'https://www.instagram.com/p/Ab_' || page_id || '/embed' WHEN 1 THEN 'https://www.instagram.com/reel/X-' || page_id || '/embed' END AS embed,
  CASE page_id % 4 WHEN 3 THEN 'user.' || page_id END AS owner FROM pages""")  # fmt: skip
def page_addresses(spark, sf):
    """Clean addresses, embed addresses of posts, and account names of profiles."""
    k = F.col("page_id").cast("string")
    url = by_rest("page_id", 4, {0: F.concat(F.lit(" https://www.instagram.com/p/Ab_"), k, F.lit("/?x=1#top ")), 1: F.concat(F.lit("http://m.instagram.com/reel/X-"), k),
                                 2: F.col("url"), 3: F.concat(F.lit("ftp://instagram.com/user."), k, F.lit("/"))})
    return table(spark, sf, "pages").select("page_id", N.clean_url(url).alias("clean"), N.embed_url(url).alias("embed"), X.owner_from_url(url).alias("owner"))


@query("""SELECT page_id, page_id || CASE WHEN page_id * 7 % 100 = page_id THEN '' ELSE '|' || page_id * 7 % 100 END AS nos FROM pages""")
def page_threads(spark, sf):
    """Thread numbers that a page lists, in order and once."""
    k, other = F.col("page_id").cast("string"), (F.col("page_id") * 7 % 100).cast("string")
    links = F.concat(F.lit('<a href="?id=x&no='), k, F.lit('">a</a><a href="?id=x&amp;no='), other, F.lit('">b</a><a href="?id=x&no='), k, F.lit('">c</a>'))
    return table(spark, sf, "pages").select("page_id", joined(pages.listed_threads(F.concat(links, "html"))).alias("nos"))


@query("""SELECT conv_id, turn, CAST(conv_id AS VARCHAR) AS thread, 'https://g/?id=a&no=' || conv_id || CASE WHEN turn > 0 THEN ':' || turn ELSE '' END AS post,
  'https://g/?id=a&no=' || conv_id || '#cmt:' || turn AS rewritten FROM conversations""")  # fmt: skip
def turn_ids(spark, sf):
    """The thread from its number, its parent or its address; the id of a piece, and of one in the older shape."""
    k, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    url = F.concat(F.lit("https://g/?id=a&no="), k)
    of = lambda r: F.when(F.col("conv_id") % 3 == r, k)
    old = F.concat(url, F.lit("#cmt"), (F.col("turn") + 1).cast("string"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", N.thread_no(of(0), of(1), url).alias("thread"), N.dc_post_id(url, F.when(F.col("turn") > 0, turn)).alias("post"),
        N.rewritten_post_id(old, turn).alias("rewritten"),
    )


@query("""SELECT event_id, CASE event_id % 6 WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN date_trunc('day', ts)::TIMESTAMP WHEN 5 THEN NULL ELSE date_trunc('second', ts) END AS taken FROM events""")
def event_times(spark, sf):
    """Four formats and ISO; a date without a year is NULL."""
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy.MM.dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "MM.dd")
    said = by_rest("event_id", 6, {k: F.date_format("ts", f) for k, f in enumerate(formats)})
    return table(spark, sf, "events").select("event_id", N.timestamp_of(F.concat(F.lit(" "), said)).cast("timestamp_ntz").alias("taken"))


@query("""SELECT 'tag' AS kind, event_type AS key, strftime(max(ts) FILTER (WHERE event_id % 10 > 0), '%Y-%m-%dT%H:%M:%SZ') AS newest FROM events GROUP BY event_type""")
def event_captures(spark, sf):
    """The newest item time of each key; runs without an item have none."""
    item = F.when(F.col("event_id") % 10 > 0, F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))))
    return rawlog.newest(table(spark, sf, "events").select(F.lit("tag").alias("kind"), F.col("event_type").alias("key"), item.alias("item")))


@query("""SELECT vec_id, round(1 / (1 + exp(-(0.25 + list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * ((i - 1) % 5 - 2) / 10))))), 6) AS p FROM embeddings""")
def vector_probabilities(spark, sf):
    """N8."""
    p = N.probability([(i % 5 - 2) / 10 for i in range(64)], 0.25, F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(p, 6).alias("p"))


# --- texts


def texts(spark: SparkSession, sf: str, cases: dict[int, str], n: int) -> DataFrame:
    """doc_id, n_chars and the text with a sentence by the id's rest."""
    said = by_rest("doc_id", n, cases, F.lit(""))
    return table(spark, sf, "documents").select("doc_id", "n_chars", F.concat(F.coalesce("text", F.lit("")), said).alias("text"))


@query("""WITH p AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t,
    list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\\n.!?。…·]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 3) AS good FROM documents),
  q AS (SELECT doc_id, CASE WHEN len(good) > 0 THEN good WHEN t <> '' THEN [t] ELSE [] END AS c FROM p)
  SELECT doc_id, CAST(len(c) AS INTEGER) AS n, md5(array_to_string(c, '|')) AS chunks_md5 FROM q""")  # fmt: skip
def document_chunks(spark, sf):
    """Sentences of three characters or more, else the whole text."""
    c = X.chunks(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(c).alias("n"), digest(joined(c)).alias("chunks_md5"))


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || '.' ELSE text END AS t FROM documents),
  s AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS c FROM p)
  SELECT doc_id, CAST((doc_id % 3 < 2)::INT AS INTEGER) AS n_offending, CASE WHEN len(c) > 0 THEN md5(array_to_string(c, ' ')) END AS left_md5 FROM s""")  # fmt: skip
def document_summaries(spark, sf):
    """Sentences about absence or the display go, all others stay."""
    rows = texts(spark, sf, {0: ". 소리 언급은 없다."}, 3).withColumn("text", F.concat(by_rest("doc_id", 3, {1: "3건이 좋다고 했다. "}, F.lit("")), "text"))
    return rows.select("doc_id", F.size(R.offending_sentences(F.col("text"))).alias("n_offending"), digest(R.scrubbed(F.col("text"))).alias("left_md5"))


@query("""WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT *, substr(t, 1, 150) AS head FROM f),
  a AS (SELECT *, coalesce(list_max(list_filter(range(1, 151), lambda i: substr(head, i, 1) IN ('.', '!', '?', '。', '…'))), 0) AS stop,
    coalesce(list_max(list_filter(range(1, 151), lambda i: substr(head, i, 1) = ' ')), 0) AS space FROM h)
  SELECT doc_id, md5(CASE WHEN length(t) <= 150 THEN t ELSE trim(substr(head, 1, CASE WHEN stop >= 75 THEN stop WHEN space > 1 THEN space - 1 ELSE 150 END)) || '…' END) AS cut_md5 FROM a""")  # fmt: skip
def document_excerpts(spark, sf):
    """150 characters, up to a sentence end in the second half, else a space: the cut is the feature."""
    return table(spark, sf, "documents").select("doc_id", digest(X.excerpt(F.col("text"))).alias("cut_md5"))


@query("""SELECT doc_id, doc_id % 4 IN (0, 2) AS hearsay, doc_id % 4 = 1 AS negative, doc_id % 4 = 2 AS buys FROM documents""")
def document_voices(spark, sf):
    """hearsay, complaints and plans to buy, found in whole texts; a plan to buy is nobody's experience yet."""
    rows = texts(spark, sf, {0: " 좋다고 들었", 1: " 돈 아까움", 2: " 살까 말까"}, 4)
    t = F.col("text")
    return rows.select("doc_id", R.is_hearsay(t).alias("hearsay"), R.is_negative(t).alias("negative"), R.is_purchase_intent(t).alias("buys"))


WORDS = ["AND ", "der", "él", "zzz"]


@query(f"""SELECT doc_id, len(list_filter({sql_list(WORDS)}, lambda w: contains(lower(coalesce(text, '')), lower(w)))) > 0 AS toxic FROM documents""")
def document_words(spark, sf):
    """one of the words is part of the text, in any letter case."""
    return table(spark, sf, "documents").select("doc_id", R.has_any(F.col("text"), WORDS).alias("toxic"))


@query("""WITH e AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS s, regexp_replace(split_part(text, ' ', 1), '\\s+', '', 'g') AS p,
    CASE doc_id % 4 WHEN 0 THEN regexp_replace(substr(text, 5, 40), '\\s+', '', 'g') WHEN 1 THEN regexp_replace(reverse(text), '\\s+', '', 'g') WHEN 2 THEN regexp_replace(split_part(text, ' ', 1), '\\s+', '', 'g') ELSE '' END AS b FROM documents)
  SELECT doc_id, b <> '' AND (s = '' OR contains(s, b)) AND (p = '' OR replace(b, p, '') <> '') AS stands FROM e WHERE s IS NOT NULL""")  # fmt: skip
def document_evidence(spark, sf):
    """evidence has to be part of its text and more than the product's name."""
    first = F.split_part("text", F.lit(" "), F.lit(1))
    evidence = by_rest("doc_id", 4, {0: F.substring("text", 5, 40), 1: F.reverse("text"), 2: first, 3: " "})
    return table(spark, sf, "documents").where("text is not null").select("doc_id", R.keeps_evidence(evidence, F.col("text"), first).alias("stands"))


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' 협찬 받음' WHEN 1 THEN ' 증정 boom' ELSE '' END AS t FROM documents),
  m AS (SELECT *, len(list_filter({sql_list(L.PROMO_GATE)}, lambda w: contains(lower(t), lower(w)))) > 0 AS asked, contains(t, 'boom') AS fails,
    list_filter({sql_list(L.PROMO_MARKERS)}, lambda w: contains(lower(t), lower(w)))[1] AS marker FROM t)
  SELECT doc_id, asked, asked AND CASE WHEN fails THEN marker IS NOT NULL ELSE length(t) % 2 = 0 END AS is_promo,
    CASE WHEN asked AND fails THEN marker WHEN asked THEN 'model' END AS promo_marker FROM m""")  # fmt: skip
def document_promo(spark, sf):
    """Only texts behind the wide gate are asked about; where the model fails, the marker list judges."""

    def detector(t: str) -> tuple[bool, str]:
        if "boom" in t:
            raise RuntimeError("down")
        return len(t) % 2 == 0, "model"

    return hooks.promo_verdicts(texts(spark, sf, {0: " 협찬 받음", 1: " 증정 boom"}, 3), "text", detector).select("doc_id", "asked", "is_promo", "promo_marker")


@query("""SELECT doc_id, coalesce((length(text) - length(replace(text, 'a', ''))) % 2 = 0, false) AS yes FROM documents""")
def document_classes(spark, sf):
    """H1: a classifier hook over whole texts; NULL is no."""
    return table(spark, sf, "documents").select("doc_id", hooks.classify(F.col("text"), lambda t: t.count("a") % 2 == 0).alias("yes"))


@query("""WITH c AS (SELECT conv_id, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS a, (length(t) - length(replace(t, 'n', '')))::DOUBLE AS b FROM (SELECT conv_id, coalesce(text, '') AS t FROM conversations))
  SELECT conv_id AS id, round(max((a + 1) / (sqrt(a * a + b * b + 1) * sqrt(2))), 6) AS topic_score FROM c GROUP BY conv_id""")  # fmt: skip
def conversation_topics(spark, sf):
    """V1, V3, V7: turns of all conversations are embedded, and the best cosine with the anchor is a conversation's."""
    vectors = lambda ts: [[float(t.count("e")), float(t.count("n")), 1.0] for t in ts]
    embedded = hooks.embed(table(spark, sf, "conversations").select("conv_id", "text"), "text", vectors)
    return gate.max_cosine(embedded, [1.0, 0.0, 1.0], "conv_id").withColumn("topic_score", F.round("topic_score", 6))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'empty' WHEN doc_id % 5 = 0 THEN 'meta' END AS dc,
    CASE WHEN doc_id % 5 = 4 THEN 'empty' WHEN n_chars % 100 / 100 < {L.RELEVANCE["instagram"]["tau_topic"]} THEN 'topic' END AS ig,
    CAST((doc_id % 5 IN (1, 2))::INT AS INTEGER) AS bucket, doc_id % 5 = 2 AS bias FROM documents""")  # fmt: skip
def document_verdicts(spark, sf):
    """The axes of two platforms in their fixed order."""
    rows = texts(spark, sf, {0: " 완장 뭐함", 1: ", 쫀득하고 좋음", 2: ", 별로라 실망"}, 5)
    rows = rows.withColumns({"text": F.when(F.col("doc_id") % 5 == 4, " ").otherwise(F.col("text")), "topic_score": F.col("n_chars") % 100 / 100})
    rows = gate.signals(rows, "text")
    both = gate.verdicts(gate.verdicts(rows, "dcinside", "text").withColumnRenamed("axis", "dc"), "instagram", "text")
    return both.select("doc_id", "dc", F.col("axis").alias("ig"), F.col("e_bucket").alias("bucket"), F.col("bias_hold").alias("bias"))


# --- threads, posts and markets


@query("""SELECT CAST(conv_id AS VARCHAR) AS thread_no, 'post' AS type, 0 AS ordinal FROM conversations WHERE turn = 0 AND length(trim(text)) >= 8
  UNION ALL SELECT CAST(conv_id AS VARCHAR), 'comment', CAST(o AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM conversations WHERE turn > 0) WHERE turn % 3 <> 2 AND length(trim(text)) >= 8""")  # fmt: skip
def turn_candidates(spark, sf):
    """A post, and its comments by their place; noise is no candidate but keeps its place."""
    rows = table(spark, sf, "conversations").withColumns({"thread_no": F.col("conv_id").cast("string"), "text": F.when((F.col("turn") > 0) & (F.col("turn") % 3 == 2), "ㅋㅋㅋ").otherwise(F.col("text"))})
    own = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["turn"].cast("string").alias("no"), x["text"].alias("text")))
    comments = rows.where("turn > 0").groupBy("thread_no").agg(own.alias("comments"))
    out = threads.candidates(rows.where("turn = 0").select("thread_no", "text"), comments)
    return out.select("thread_no", "type", F.col("ordinal").cast("int").alias("ordinal"))


def order_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as posts of customers: every fifth names no owner but its address, every seventh is too short."""
    k, who = F.col("o_orderkey").cast("string"), F.concat(F.lit("c."), F.col("o_custkey").cast("string"))
    null = F.lit(None).cast("string")
    return table(spark, sf, "orders").select(
        k.alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("S"), (F.col("o_orderkey") % 1000).cast("string"))).alias("shortCode"), null.alias("url"),
        F.when(F.col("o_orderkey") % 7 == 0, "short").otherwise(F.concat(F.lit("an order of priority #"), F.split_part("o_orderpriority", F.lit("-"), F.lit(2)), F.lit(" no "), k)).alias("caption"),
        F.when(F.col("o_orderkey") % 5 > 0, who).alias("ownerUsername"), F.lit(None).cast("array<string>").alias("hashtags"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"),
        (F.col("o_custkey") % 90).cast("int").alias("likesCount"), F.lit(1).alias("commentsCount"), F.concat(F.lit("https://www.instagram.com/"), who, F.lit("/")).alias("inputUrl"),
    )


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, 'c.' || o_custkey AS owner FROM orders WHERE o_orderkey % 7 > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey
    ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, CASE WHEN o_orderkey % 3 > 0 THEN 'S' || o_orderkey % 1000 END NULLS FIRST, CAST(o_orderkey AS VARCHAR)) <= 2""")  # fmt: skip
def order_seller_posts(spark, sf):
    """The newest two posts of each owner, who is the item's or the input address's; ties by code, address and id."""
    return social.seller_posts(order_posts(spark, sf), per_handle=2).select("id", F.col("owner_username").alias("owner"))


@query("""WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS t, 'an order of priority #' || split_part(o_orderpriority, '-', 2) || ' no ' || o_orderkey AS caption FROM orders WHERE o_orderkey % 7 > 0),
  s AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey % 1000 ORDER BY t DESC, caption DESC) AS r FROM o WHERE o_orderkey % 3 > 0)
  SELECT 'S' || o_orderkey % 1000 AS shortcode, md5(caption) AS text_md5, split_part(split_part(o_orderpriority, '-', 2), ' ', 1) AS tags, t AS posted_at FROM s WHERE r = 1
  UNION ALL SELECT NULL, md5(caption), split_part(split_part(o_orderpriority, '-', 2), ' ', 1), t FROM o WHERE o_orderkey % 3 = 0""")  # fmt: skip
def order_pieces(spark, sf):
    """The newest item of each code, and all without a code or address; tags from the caption."""
    return social.to_pieces(order_posts(spark, sf)).select("shortcode", digest(F.col("text")).alias("text_md5"), joined(F.col("hashtags")).alias("tags"), "posted_at")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 7 > 0 AND split_part(o_orderpriority, '-', 2) IN ('LOW', 'HIGH')""")
def order_posts_of_tags(spark, sf):
    """Posts that carry one of the tags, in any letter case."""
    return social.matching(order_posts(spark, sf), ["#low", "High", "none"]).select("id")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 > 0 THEN 'c.' || o_custkey ELSE 'Customer#' || o_custkey END AS owner FROM orders""")
def customer_profiles(spark, sf):
    """Posts of customers' profiles, with the profile's name where they have no owner."""
    names = [f.split()[0] for f in social.ITEM.split(", ")]
    posts = order_posts(spark, sf).withColumn("who", F.regexp_extract("inputUrl", r"c\.(\d+)", 1))
    profiles = posts.groupBy("who").agg(F.collect_list(F.struct(*names)).alias("latestPosts"))
    null = [F.lit(None).cast("array<string>" if n == "hashtags" else "int" if n.endswith("Count") else "string").alias(n) for n in names]
    items = profiles.select(*null, F.concat(F.lit("Customer#"), "who").alias("username"), "latestPosts")
    return social.profile_posts(items).select("id", F.col("ownerUsername").alias("owner"))


def brands(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as a knowledge base; those of even numbers have a second handle."""
    brand = table(spark, sf, "part").select("p_brand").distinct()
    no = F.regexp_extract("p_brand", r"(\d+)", 1)
    return brand.select(F.col("p_brand").alias("market_word"), F.concat(F.lit("shop"), no).alias("handle"), F.when(no.cast("int") % 2 == 0, F.array(F.concat(F.lit("Alt"), no))).alias("handles_alt"))


@query("""SELECT p_brand AS market, p_name || p_partkey AS product FROM part WHERE p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND CAST(regexp_extract(p_brand, '\\d+') AS INTEGER) % 2 = 0)""")
def part_official_products(spark, sf):
    """Products under the market of their handle or second handle, in any letter case; unknown handles go."""
    no = F.regexp_extract("p_brand", r"(\d+)", 1)
    handle = by_rest("p_partkey", 3, {0: F.concat(F.lit("SHOP"), no), 1: F.concat(F.lit("alt"), no), 2: "nobody"})
    rows = table(spark, sf, "part").select(handle.alias("handle"), F.struct(F.concat("p_name", "p_partkey").alias("product_name")).alias("p"))
    fixture = rows.groupBy("handle").agg(F.collect_list("p").alias("products"))
    return social.layer1_specs(fixture, brands(spark, sf)).select("market", "product")


def nations(spark: SparkSession, sf: str) -> DataFrame:
    null, none = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    handle = F.concat(F.lit("handle"), F.col("n_nationkey").cast("string"))
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("market"), F.col("n_name").alias("market_word"), handle.alias("handle"), none.alias("handles_alt"), none.alias("aliases"),
        null.alias("choseong"), none.alias("choseong_aliases"),
    )


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'handle' || s_nationkey END AS handle FROM supplier""")
def supplier_markets(spark, sf):
    """The row of a market's own word, white space aside; handles and case are not looked at."""
    word = F.concat(F.lit("N ATION _"), F.col("s_nationkey").cast("string"))
    rows = table(spark, sf, "supplier").withColumn("w", by_rest("s_suppkey", 3, {0: F.lower(word)}, word))
    return linking.exact_market(rows, "w", nations(spark, sf)).select("s_suppkey", F.col("kb_handle").alias("handle"))


@query("""SELECT n_name AS market_word FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def nations_without_rows(spark, sf):
    """J12."""
    kb = nations(spark, sf)
    rich = table(spark, sf, "customer").where("c_acctbal > 9900").select(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("market"))
    return incremental.missing_markets(kb, rich).select("market_word")


CAPTION = "'see #nation_' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN ' #NATION_' || (c_nationkey + 1) % 25 ELSE ' #none' END"


@query("""SELECT c_custkey AS id, 'NATION_' || c_nationkey AS caption_market FROM customer WHERE c_custkey % 3 > 0""")
def customer_caption_markets(spark, sf):
    """A caption's market where its tags name exactly one."""
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(CAPTION).alias("caption"))
    return linking.caption_market(rows, nations(spark, sf), "c_custkey", "caption")


@query(f"""SELECT c_custkey AS id, n_name AS market FROM customer JOIN nation ON contains(lower({CAPTION}), lower(n_name))""")
def customer_text_markets(spark, sf):
    """Every market that a text names, also inside a longer word."""
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(CAPTION).alias("caption"))
    return linking.markets_in_text(rows, nations(spark, sf), "c_custkey", "caption")


# --- stored reviews and their maintenance

#: lineitem as reviews: every second one without a market; products are parts.
REVIEWS = """rv AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN 'instagram' ELSE 'amos' END AS source, CAST(l_orderkey AS STRING) AS post_id,
    CASE WHEN l_linenumber % 2 = 1 THEN 'Brand#' || CAST(l_suppkey % 25 + 1 AS STRING) END AS market, CASE WHEN l_linenumber = 3 THEN 0.9 ELSE 0.0 END AS market_confidence,
    'Item ' || CAST(l_partkey AS STRING) AS product, CASE WHEN l_linestatus = 'O' THEN 'a Topic' WHEN l_quantity > 5 THEN 'another' END AS body,
    CASE WHEN l_linenumber < 3 THEN '[마켓미상] / x' ELSE '[y] / x' END AS evidence, CASE WHEN l_linenumber = 1 THEN 'inversion_spec' WHEN l_linenumber = 5 THEN 'inversion_registry' END AS market_provenance, l_partkey FROM lineitem),
  sp AS (SELECT p_brand AS market, 'ITEM ' || CAST(p_partkey AS STRING) AS product, p_partkey AS k FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT 'Brand#99', 'item  ' || CAST(p_partkey AS STRING), p_partkey FROM part WHERE p_partkey % 10 = 0),
  rg AS (SELECT p_brand AS market, 'item' || CAST(p_partkey AS STRING) AS product, p_partkey AS k FROM part WHERE p_partkey % 3 = 0),
  cp AS (SELECT CAST(o_orderkey AS STRING) AS id, 'Brand#' || CAST(o_custkey % 25 + 1 AS STRING) AS caption_market FROM orders WHERE o_orderkey % 2 = 0)"""  # fmt: skip
OWNED = f"""WITH {REVIEWS}, ow AS (SELECT k, min(market) AS spec FROM sp GROUP BY k HAVING count(DISTINCT market) = 1), rw AS (SELECT k, min(market) AS reg FROM rg GROUP BY k),
  j AS (SELECT rv.*, spec, reg, l_partkey IN (SELECT k FROM sp) AS in_specs, caption_market AS cap FROM rv LEFT JOIN ow ON l_partkey = ow.k LEFT JOIN rw ON l_partkey = rw.k LEFT JOIN cp ON post_id = cp.id)"""


def review_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The four tables of ``REVIEWS``: rv, sp, rg and cp."""
    from_ = {t: table(spark, sf, t) for t in ("lineitem", "part", "orders")}
    return {n: spark.sql(f"WITH {REVIEWS.replace(' FROM lineitem', ' FROM {lineitem}').replace(' FROM part', ' FROM {part}').replace(' FROM orders', ' FROM {orders}')} SELECT * FROM {n}", **from_)
            for n in ("rv", "sp", "rg", "cp")}


@query(f"""WITH {REVIEWS} SELECT id, product FROM rv WHERE source = 'instagram' AND body = 'another' AND product NOT IN (SELECT replace(product, 'ITEM', 'Item') FROM sp)""")
def offtopic_reviews(spark, sf):
    """Rows without a topic word go, unless their product is in the specs."""
    t = review_tables(spark, sf)
    specs = t["sp"].withColumn("product", F.replace("product", F.lit("ITEM"), F.lit("Item")))
    return maintenance.plan_offtopic(t["rv"], specs, ["topic"]).select("id", "product")


@query(OWNED + """ SELECT id, CASE WHEN spec <> cap THEN NULL ELSE coalesce(spec, cap) END AS market, coalesce(spec <> cap, false) AS clash,
    CASE WHEN spec <> cap THEN NULL WHEN spec IS NOT NULL THEN 0.9e0 WHEN cap IS NOT NULL THEN 0.7e0 END AS confidence FROM j WHERE market IS NULL""")  # fmt: skip
def backfilled_markets(spark, sf):
    """The specs' only owner before the caption's market; where they differ, neither."""
    t = review_tables(spark, sf)
    plan = maintenance.plan_backfill_market(t["rv"], t["sp"], t["cp"])
    return plan.select("id", F.col("new_market").alias("market"), F.coalesce("conflict", F.lit(False)).alias("clash"), F.col("new_market_confidence").cast("double").alias("confidence"))


@query(OWNED + """ SELECT id, CASE WHEN spec = market THEN 'spec' WHEN cap = market THEN 'caption' WHEN coalesce(spec, cap) IS NOT NULL THEN 'conflict' ELSE 'no_evidence' END AS state
  FROM j WHERE market IS NOT NULL AND market_confidence = 0""")  # fmt: skip
def backfilled_confidence(spark, sf):
    """Confidence only where the evidence equals the stored market."""
    t = review_tables(spark, sf)
    return maintenance.plan_backfill_confidence(t["rv"], t["sp"], t["cp"]).select("id", "state")


@query(f"""WITH {REVIEWS} SELECT id, market FROM rv WHERE id % 10 = 1""")
def stale_headers(spark, sf):
    """Rows with a market whose evidence still says that it is unknown."""
    return maintenance.plan_evidence_headers(review_tables(spark, sf)["rv"]).select("id", F.col("new_market").alias("market"))


@query(OWNED + """ SELECT id, CASE WHEN in_specs THEN spec ELSE reg END AS market, CASE WHEN in_specs THEN 'inversion_spec' ELSE 'inversion_registry' END AS provenance,
    coalesce(cap <> CASE WHEN in_specs THEN spec ELSE reg END, false) AS clash FROM j WHERE market IS NULL AND source = 'amos' AND CASE WHEN in_specs THEN spec ELSE reg END IS NOT NULL""")  # fmt: skip
def inverted_reviews(spark, sf):
    """The only owner of a product; one that the specs know, even ambiguously, is not looked up in the registry."""
    t = review_tables(spark, sf)
    plan = maintenance.plan_inversion(t["rv"], t["sp"], t["rg"], t["cp"], ["amos"])
    return plan.select("id", F.col("new_market").alias("market"), "provenance", F.col("conflict").alias("clash"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 1 THEN 'Brand#' || o_custkey END AS market, CASE WHEN o_orderkey % 5 = 1 THEN 0.0e0 ELSE 0.9e0 END AS confidence FROM orders""")
def reverted_orders(spark, sf):
    """The plan of one tier, applied: rows whose market came from it lose it, all others stay as they were."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Brand#"), F.col("o_custkey").cast("string")).alias("market"), F.lit(0.9).alias("market_confidence"),
        by_rest("o_orderkey", 5, {0: "inversion_spec", 1: "inversion_registry", 2: "surface"}).alias("market_provenance"),
    )
    out = maintenance.apply_plan(rows, maintenance.plan_revert_inversion(rows, "registry"))
    return out.select("id", "market", F.col("market_confidence").alias("confidence"))


@query(f"""WITH {REVIEWS}, own AS (SELECT product, l_partkey, market, count(*) AS n FROM rv WHERE market_provenance IS NOT NULL GROUP BY ALL),
  n AS (SELECT p_partkey, p_brand FROM part UNION ALL SELECT p_partkey, 'Brand#1' FROM part WHERE p_partkey % 4 = 0)
  SELECT product, market, n AS n_excerpts, count(p_brand) FILTER (WHERE p_brand = market) AS own_posts, count(p_brand) FILTER (WHERE p_brand <> market) AS other_posts
  FROM own LEFT JOIN n ON l_partkey = p_partkey GROUP BY ALL""")  # fmt: skip
def inversion_posts(spark, sf):
    """Seller posts of the inferred market and of others that name the product."""
    parts = table(spark, sf, "part")
    caption = F.concat(F.lit("now #ITEM"), F.col("p_partkey").cast("string"))
    posts = parts.select(F.col("p_brand").alias("market"), caption.alias("caption")).unionByName(parts.where("p_partkey % 4 = 0").select(F.lit("Brand#1").alias("market"), caption.alias("caption")))
    out = maintenance.inversion_material(review_tables(spark, sf)["rv"], posts)
    return out.select("product", "market", F.size("excerpts").cast("long").alias("n_excerpts"), "own_posts", "other_posts")


@query("""SELECT p_partkey AS product, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS scent, p_name AS base_combo FROM part""")
def blanked_specs(spark, sf):
    """What an edit blanked becomes NULL; an edit with a value is not applied here."""
    parts = table(spark, sf, "part")
    specs = parts.select(F.col("p_brand").alias("market"), F.col("p_partkey").alias("product"), F.col("p_type").alias("scent"), F.col("p_name").alias("base_combo"))
    edit = by_rest("p_partkey", 7, {0: "scent", 1: "base_combo"}).alias("field"), by_rest("p_partkey", 7, {0: " ", 1: "x"}).alias("value")
    edits = parts.where("p_partkey % 7 < 2").select(F.col("p_brand").alias("market"), F.col("p_partkey").alias("product"), *edit, F.lit(False).alias("unknown"))
    return merge.clear_blanks(specs, edits, ["market", "product"], ["scent", "base_combo"]).select("product", "scent", "base_combo")


# --- evaluation

SCORED = "s AS (SELECT n_chars % 1000 / 1000 AS score, quality = 1 AS keep FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where("quality is not null")
    return both.select((F.col("n_chars") % 1000 / 1000).alias("score"), (F.col("quality") == 1).alias("keep"))


@query(f"""WITH {SCORED}, c AS (SELECT tau, count(*) FILTER (WHERE score * 1000 >= tau AND keep) AS tp, count(*) FILTER (WHERE score * 1000 >= tau AND NOT keep) AS fp, count(*) FILTER (WHERE keep) AS pos
    FROM s, (SELECT 300 + 25 * i AS tau FROM range(15) t(i)) GROUP BY tau),
  r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS p, CASE WHEN pos > 0 THEN tp / pos ELSE 1 END AS r FROM c)
  SELECT CAST(tau AS INTEGER) AS tau, tp, fp FROM r ORDER BY p >= 0.9 DESC, CASE WHEN p >= 0.9 THEN r ELSE p END DESC, r DESC, tau LIMIT 1""")  # fmt: skip
def chosen_threshold(spark, sf):
    """The threshold of best recall among those precise enough, else the most precise one."""
    return evaluate.choose_tau(evaluate.tau_sweep(scored(spark, sf), "score", "keep")).select(F.col("tau").cast("int").alias("tau"), "tp", "fp")


@query(f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND keep) AS tp, count(*) FILTER (WHERE score >= 0.5 AND NOT keep) AS fp, count(*) FILTER (WHERE score < 0.5 AND keep) AS fn,
    count(*) FILTER (WHERE score < 0.5 AND NOT keep) AS tn FROM s)
  SELECT tp, fp, fn, tn, 2 * tp / (2 * tp + fp + fn) >= 2 * (tp + fn) / (2 * (tp + fn) + fp + tn) + 0.05 AND fp < fp + tn AND fp + tn >= 10 AS usable FROM c""")  # fmt: skip
def threshold_guard(spark, sf):
    """A threshold has to beat keeping everything, on enough rows."""
    return evaluate.calibrated(scored(spark, sf), "score", "keep", 0.5).select("tp", "fp", "fn", "tn", "usable")


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 10 < 2 AND doc_id - doc_id % 10 IN (SELECT doc_id FROM labels) THEN 1 ELSE quality END AS "M",
  CASE WHEN doc_id % 10 < 2 AND doc_id - doc_id % 10 IN (SELECT doc_id FROM labels) THEN 0 ELSE toxic END AS "E" FROM labels""")  # fmt: skip
def ruled_labels(spark, sf):
    """A ruling holds for its item and for the one that it also applies to."""
    labels = table(spark, sf, "labels")
    gold = labels.select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("int").alias("M"), F.col("toxic").cast("int").alias("E"))
    rulings = labels.where("doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("id"), F.array((F.col("doc_id") + 1).cast("string")).alias("also_applies"), F.lit(1).alias("M"), F.lit(0).alias("E"))
    return evaluate.gold_with_rulings(gold, rulings).select("id", "M", "E")
