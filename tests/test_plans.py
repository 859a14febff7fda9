"""Composites over a small review table."""

import pytest
from pyspark.sql import functions as F
from tallyglass import schema
from tallyglass.functions import numbers
from tallyglass.plans import ingest, views

KB_ROWS = [("연찌", "연찌", "yeonzzi", [], [], "ㅇㅉ", [], [], None), ("빈짱", "빈짱", "binzzang", [], [], "ㅂㅉ", [], [], None)]


def row(spark, table, **k):
    return tuple(k.get(f.name) for f in table.fields)


@pytest.fixture(scope="module")
def tables(spark):
    ref = lambda p, u, c=None, s=None: (p, u, None, c, None, s)
    base = dict(market="연찌", product="쿠키", review_class="genuine", evidence="[연찌] / 좋음", body="본문", likes=1)
    rows = [
        base | dict(id=1, source="amos", source_ref=ref("dcinside", "http://d/1", "7"), overall_sentiment="pos", scent_sentiment="pos", perceived_scent="레몬", shipping_cs_sentiment="neg", scent="새콤"),
        base | dict(id=2, source="amos", source_ref=ref("dcinside", "http://d/1", "7"), product="빵", overall_sentiment="neg", scent_sentiment="neg", shipping_cs_sentiment="neg"),
        base | dict(id=3, source="instagram", source_ref=ref("instagram", "https://www.instagram.com/p/A/", None, "A"), overall_sentiment="pos", scent_sentiment="pos", perceived_scent="바닐라"),
        base | dict(id=4, source="instagram", source_ref=ref("instagram", "https://www.instagram.com/p/B/", None, "B"), overall_sentiment="pos", review_class="promo"),
    ]
    reviews = spark.createDataFrame([row(spark, schema.REVIEWS, **r) for r in rows], schema.REVIEWS)
    specs = spark.createDataFrame([row(spark, schema.SPECS, id=1, market="연찌", product="쿠키", scent="바닐라 / 크림", beads=[])], schema.SPECS)
    sums = [dict(market="연찌", product="쿠키", cells={"scent": "좋아요", "cs": "옛말"}), dict(market="연찌", product=None, cells={"cs": "친절해요"})]
    summaries = spark.createDataFrame([row(spark, schema.SUMMARIES, **s) for s in sums], schema.SUMMARIES)
    return spark.createDataFrame(KB_ROWS, schema.KNOWLEDGE), specs, reviews, summaries


def test_consolidated_view(tables):
    _, specs, reviews, summaries = tables
    v = views.consolidated_for(specs, reviews, summaries, "연찌", "쿠키")
    assert {(r.platform, r.pos, r.n) for r in v.sentiment.collect()} == {("dcinside", 1, 1), ("instagram", 1, 1)}
    assert v.promo.count() == 1 and v.gap.first().gap == 0
    (d,) = v.divergence.collect()
    assert (d.n_divergent, d.n) == (1, 2)
    cs = {r.criterion: r for r in v.stats.where("is_total = 1").collect()}
    assert cs["scent"].pos == 2 and cs["cs"].neg == 1 and cs["cs"].only_source == "dcinside"
    assert v.evidence.count() == 2 and v.summaries.count() == 1


def test_market_view_folds_orders(tables):
    _, specs, reviews, summaries = tables
    v = views.consolidated_for(specs, reviews, summaries, "연찌")
    total = {r.criterion: r.neg for r in v.stats.where("is_total = 1").collect()}
    assert total["cs"] == 1 and total["scent"] == 1  # one piece, two products
    orders = {r.platform: (r.n_orders, r.neg) for r in views.order_view_for(reviews, "연찌").collect()}
    assert orders["dcinside"] == (1, 1)


def test_page(tables):
    kb, specs, reviews, summaries = tables
    p = views.page(kb, specs, reviews, summaries, "ㅇㅉ", "쿠키")
    assert p.market == "연찌" and [(r.criterion, r.verdict) for r in p.rows.collect()] == [("scent", "좋아요"), ("cs", "친절해요")]
    assert {r.id for r in p.reviews.collect()} == {1, 3, 4}
    assert p.reviews.where("id = 3").first().embed == "https://www.instagram.com/p/A/embed"
    with pytest.raises(ValueError):
        views.page(kb, specs, reviews, summaries)
    assert views.resolve_market(kb, "모르는 곳") == "모르는 곳" and views.resolve_market(kb, " ") is None


def test_summaries(tables):
    _, _, reviews, _ = tables
    out = views.generate_summaries(reviews, "연찌", True, lambda p: {"scent": "새콤해요." if "새콤" in p else "?"}).collect()
    assert [(r.product, r.platform, r.scent) for r in out] == [("쿠키", "dcinside", "새콤해요.")]
    with pytest.raises(ValueError):
        views.generate_summaries(reviews, "없음", True, lambda p: {})


def test_ingest(spark, tables):
    kb, specs, reviews, _ = tables
    rows = [(1, 0, "u1", None, "말랑하고 좋음 쿠키", "연찌", 0.5), (1, 1, "u1", "5", "완장 뭐함", None, 0.5), (1, 2, "u1", "6", "ㅂㅉ 빵 좋음", None, 0.5), (1, 3, "u1", "7", "이미 봤음 좋음", None, 0.5)]
    pieces = spark.createDataFrame(rows, "batch int, pos int, url string, comment_no string, text string, market string, topic_score double")
    seen = spark.createDataFrame([("amos", "u1:7")], "source string, post_id string")

    names = [f.name for f in ingest.item_type().fields]

    def extract(text):
        item = dict.fromkeys(names)
        name = "ㅂㅉ 빵" if "ㅂㅉ" in text else "쿠키"
        return [item | {"mentioned_product": name, "firsthand_evidence": text, "sentiment": "pos"}, item | {"firsthand_evidence": "없는 말"}]

    done = ingest.ingest(pieces, seen, kb, specs, extract, "amos", "dcinside", 10)
    got = {r.post_id: (r.market, r.product, r.provenance) for r in done.rows.collect()}
    assert got == {"u1": ("연찌", "쿠키", "inherit"), "u1:6": ("빈짱", "빵", "prefix_choseong")}
    c = done.counters.first()
    assert (c.examined, c.relevant, c.dropped_meta, c.shortfall) == (4, 3, 1, 7)
    assert ingest.commit(done.rows.select("source", "post_id", "product", "pos").limit(0), done.rows.select("source", "post_id", "product", "pos")).count() == 2
    posts = spark.createDataFrame([("a", "협찬 #쿠키", "fan"), ("b", "x", "binzzang")], "id string, text string, owner_username string")
    sellers, users = ingest.route(posts, kb)
    assert [r.id for r in sellers.collect()] == ["b"] and [(r.review_class, r.product_tags) for r in users.collect()] == [("promo", ["쿠키"])]


def test_schemas_hold_literals(spark):
    for table in (schema.SPECS, schema.REVIEWS, schema.SUMMARIES, schema.PIECES, schema.KNOWLEDGE, schema.EXTRACTION):
        assert spark.createDataFrame([], table).where(F.lit(True)).count() == 0


def test_source_refs(spark):
    rows = [("https://g/?no=7#x", None, "3", 2), ("https://g/?id=a&no=8", None, None, 2), ("ftp://g", "1", "1", 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, "url string, thread string, no string, ordinal int")
    ref = numbers.source_ref("dcinside", *map(F.col, ("url", "thread", "no", "ordinal")))
    got = [r.ref and tuple(r.ref) for r in df.select(ref.alias("ref")).collect()]
    assert got == [("dcinside", "https://g/?no=7", "7", "3", None, None), ("dcinside", "https://g/?id=a&no=8", "8", None, 2, None), None, None]
    code = numbers.source_ref("instagram", F.col("url"), F.lit(None), F.lit(None), F.lit(None), F.lit("S"))
    first = df.select(code.alias("r")).select(numbers.permalink(F.col("r")).alias("link"), "r.shortcode").first()
    assert tuple(first) == ("https://g/?no=7", "S")


def test_page_counts_and_meta(tables):
    page = views.page(*tables, "연찌", "쿠키")
    assert sum(r.n for r in page.counts.collect()) == page.reviews.count()
    assert page.meta.columns == ["scope", "generated_at", "model", "n_reviews"]
    assert views.page(*tables, None, "쿠키").meta is None
