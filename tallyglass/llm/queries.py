"""The thin opN_<name> queries over the driver's tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import (
    chat, collocations, filteraudit, fingerprints, langid, mixing, neardup, packing, quality, rules, sharding, spiece, tokencounts,
)
from tallyglass.llm.common import read

#: The conversation that holds every template's control strings, added to the table by op1.
TRAP_ID, TRAP_TEXT = -7, "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "SELECT :id AS conv_id, turn, role, :text AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS said (turn, role)"
    trap = spark.sql(said, {"id": TRAP_ID, "text": TRAP_TEXT})
    return chat.digests(chat.format_conversations(rows.unionByName(trap)))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"), clean=False)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "lines_removed", "line_chars", "kept_chars")
    return judged.select("doc_id", *[F.col(f"quality_rules.{c}").alias(c) for c in names])


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), words=2)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.digest_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("text", "lang"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: In the order of the operators' numbers.
QUERIES = (
    op1_chat_formatting, op2_document_fingerprints, op3_language_id, op4_packing, op5_quality_classifier,
    op6_quality_rules, op7_minhash_near_dedup, op8_sharding, op9_sentencepiece, op10_token_counts,
    op11_filter_audit, op12_collocations, op13_mixing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP1_SQL = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
rung AS (
  SELECT *, (contains(text, '<turn ') OR contains(text, '</turn>')) AS controls,
    (contains(text, '\l') OR contains(text, '\g') OR contains(text, '\s')) AS escapes FROM src),
raw AS (
  SELECT *, CASE WHEN NOT controls AND NOT escapes THEN text
    ELSE replace(replace(CASE WHEN escapes THEN replace(text, '\', '\s') ELSE text END,
      '<turn ', '\lturn '), '</turn>', '\l/turn>') END AS body,
    replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g') AS tag FROM rung)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('<turn ' || tag || '>' || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
  true AS round_trip
FROM raw GROUP BY conv_id
"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n >= 2),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
ln AS (
  SELECT doc_id, x, length(x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
bad AS (
  SELECT *, (100 * (n - length(translate(x, '{rules.SYMBOLS}', ''))) > {rules.SYMBOL_PERCENT} * n
    OR {rules.SHOUT_CHARS} * (n - length(regexp_replace(x, '[!?]{{2}}', '!', 'g'))) > n
    OR (n < {rules.WRAPPED_CHARS} AND NOT regexp_matches(x, '{rules.SENTENCE_ENDS}'))
    OR n - length(translate(x, '{rules.MENU_MARKS}', '')) >= {rules.MENU_COUNT}
    OR regexp_matches(lower(x), '{"|".join(rules.BOILERPLATE)}')) AS b FROM ln),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines, CAST(sum(n) AS BIGINT) AS line_chars,
    CAST(sum(CASE WHEN b THEN 0 ELSE n END) AS BIGINT) AS kept_chars, count(*) FILTER (WHERE b) AS lines_removed
  FROM bad GROUP BY doc_id),
all_ AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '{rules.SYMBOLS}', '')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(lines_removed, 0) AS lines_removed, coalesce(line_chars, 0) AS line_chars, coalesce(kept_chars, 0) AS kept_chars
  FROM words LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT *, (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  (NOT (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words)
    AND 100 * kept_chars >= {rules.MIN_KEPT_PERCENT} * line_chars) AS kept
FROM all_
"""


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
-- linked sets share one of the first n - ceil(0.8 n) + 1 shingles in any common order
p AS (
  SELECT doc_id, n, g FROM (
    SELECT x.*, row_number() OVER (PARTITION BY doc_id ORDER BY c, x.g) AS r
    FROM x JOIN (SELECT g, count(*) AS c FROM x GROUP BY g) AS f ON x.g = f.g)
  WHERE r <= n - (80 * n + 99) // 100 + 1),
cand AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p AS a JOIN p AS b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
pair AS (
  SELECT a, b FROM cand JOIN s AS sa ON sa.doc_id = a JOIN s AS sb ON sb.doc_id = b
  WHERE 100 * len(list_intersect(sa.s, sb.s)) >=
    80 * (len(sa.s) + len(sb.s) - len(list_intersect(sa.s, sb.s)))),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT a AS doc_id, a AS r FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a),
comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c, s.doc_id) AS component_id,
  s.doc_id = coalesce(c, s.doc_id) AS kept
FROM s LEFT JOIN comp ON comp.doc_id = s.doc_id
"""


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT d.part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
    FROM labels GROUP BY doc_id) AS l ON l.doc_id = d.doc_id),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f AS a, f AS b, f AS c, f AS d, f AS e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (
  SELECT filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS bit,
    list_sum([0] || list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1)))::INT AS gone
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL)
SELECT part, filter_order, step::INT AS step,
  coalesce(sum(n) FILTER (WHERE mask & (gone | bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & gone = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & gone <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & gone = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & gone = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (WHERE mask & bit <> 0), 0)::BIGINT AS shapley
FROM cells, s GROUP BY ALL
"""

OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
occ AS (
  SELECT lang, 1 AS k, unnest(w) AS g FROM w
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w)),
f AS (SELECT lang, k, g, count(*) AS f FROM occ GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS p FROM f WHERE k > 1 AND f >= 10),
cut AS (
  SELECT lang, k, g, a, p, c, array_to_string(p[1:c], ' ') AS g1, array_to_string(p[c + 1:k], ' ') AS g2
  FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
best AS (
  SELECT cut.lang, cut.k, cut.g, cut.a, cut.p, f1.f AS l, f2.f AS r,
    (1000000::HUGEINT * a * a // (f1.f::HUGEINT * f2.f))::BIGINT AS score, c
  FROM cut JOIN f AS f1 ON f1.lang = cut.lang AND f1.g = g1 JOIN f AS f2 ON f2.lang = cut.lang AND f2.g = g2
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.g ORDER BY score, c) = 1),
held AS (
  SELECT lang, g, max(a) AS m FROM (
    SELECT lang, a, unnest([p[1] || ' ' || p[2], p[2] || ' ' || p[3]]) AS g FROM cand WHERE k = 3) GROUP BY ALL)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.g) AS rank,
  best.g AS phrase, a, l, r, n, score
FROM best LEFT JOIN held ON held.lang = best.lang AND held.g = best.g JOIN n ON n.lang = best.lang
WHERE m IS NULL OR 100 * m < 50 * a
QUALIFY rank <= 2000
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || md5('mix' || chr(10) || coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, ''))[1:13])::BIGINT
      / 4503599627370496.0::DOUBLE AS draw FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS most,
    [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
lv AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM s
  WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN most <= level * weight THEN most
    ELSE (max(level) FILTER (WHERE most > level * weight) OVER ()) * weight END AS target FROM lv),
r AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT AS copies,
  size * (floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT AS taken FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": OP1_SQL, "op6_quality_rules": OP6_SQL, "op7_minhash_near_dedup": OP7_SQL,
        "op11_filter_audit": OP11_SQL, "op12_collocations": OP12_SQL, "op13_mixing": OP13_SQL,
    }
