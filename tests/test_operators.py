"""Operators over literal rows: linking, merging, the gate, maintenance, sources and streams."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyglass.functions import lexicon as L
from tallyglass.operators import consolidate, evaluate, gate, hooks, linking, maintenance, merge, registry, retrieval, threads
from tallyglass.sources import dimensions, pages, rawlog, social
from tallyglass.streaming import incremental, windows
from tallyglass.streaming.budget import budget_stream

KB = "market string, market_word string, handle string, handles_alt array<string>, aliases array<string>, choseong string, choseong_aliases array<string>"


@pytest.fixture(scope="module")
def kb(spark):
    rows = [("늪지 슬라임", "늪지", "neupji", ["swamp_slime"], ["늪"], "ㄴㅈ", []), ("연찌", "연찌", "yeonzzi", [], [], "ㅇㅉ", []),
            ("빈짱", "빈짱", "binzzang", None, None, "ㅂㅉ", ["ㅂㅇㅍ"]), ("나지", "나지", "naji", [], [], None, [])]
    return spark.createDataFrame(rows, KB)


LINK = [
    # item_market, doc_market, product -> market, confidence, abstained, product
    (("연 찌", None, "쿠키"), ("연찌", 0.95, False, "쿠키")),
    (("ㅂㅉ", None, "쿠키"), ("빈짱", 0.85, False, "쿠키")),
    (("ㄴㅈ", None, None), (None, 0.5, True, None)),  # two markets share the initials
    (("모름", None, "쿠키"), (None, 0.0, True, "쿠키")),
    ((None, None, "ㅇㅉ 쿠키슈"), ("연찌", 0.82, False, "쿠키슈")),
    ((None, None, "늪지 쿠키"), ("늪지", 0.92, False, "쿠키")),
    ((None, "연찌", "쿠키"), ("연찌", 0.75, False, "쿠키")),
    ((None, "연찌", "ㅂㅇㅍ바나나"), ("빈짱", 0.82, False, "바나나")),
    ((None, None, "ㅂㅇㅍ"), ("빈짱", 0.82, False, None)),
    ((None, None, "디폼"), (None, 0.0, True, None)),
    ((None, None, "말차쿠키"), ("연찌", 0.80, False, "말차쿠키")),  # its only owner in the specs
    ((None, None, "두집쿠키"), (None, 0.0, True, "두집쿠키")),  # two owners: the registry is not asked
    ((None, None, "후보쿠키"), ("빈짱", 0.65, False, "후보쿠키")),
    (("모름", None, "말차쿠키"), (None, 0.0, True, "말차쿠키")),  # something was mentioned: no inversion
    ((None, None, None), (None, 0.0, True, None)),
]


def test_linking(spark, kb):
    rows = [(i, *k) for i, (k, _) in enumerate(LINK)]
    items = spark.createDataFrame(rows, "i int, item_market string, doc_market string, product string")
    specs = linking.owners(spark.createDataFrame([("말차쿠키", "연찌"), ("두집쿠키", "연찌"), ("두집쿠키", "빈짱")], "p string, m string"), "p", "m")
    reg = linking.owners(spark.createDataFrame([("두집쿠키", "늪지"), ("후보쿠키", "빈짱")], "p string, m string"), "p", "m")
    got = {r.i: (r.market, r.confidence, r.abstained, r.product) for r in linking.link(items, kb, specs, reg).collect()}
    assert got == {i: w for i, (_, w) in enumerate(LINK)}


def test_prefix_keeps_syllables(spark, kb):
    names = ["포도", "요아곰 밀키크림", "ㅇㅉ", "ㅇㅉ 쿠키", "ㅂㅇㅍ아몬드", None, " "]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, product string")
    got = {r.i: (r.hint, r.rest) for r in linking.split_prefix(df, "product", kb).collect()}
    assert got == {0: (None, "포도"), 1: (None, "요아곰 밀키크림"), 2: ("ㅇㅉ", None), 3: ("ㅇㅉ", "쿠키"), 4: ("ㅂㅇㅍ", "아몬드"), 5: (None, None), 6: (None, None)}


def test_sellers_captions_and_text_markets(spark, kb):
    posts = spark.createDataFrame([(1, " Neupji ", "#연찌 협찬"), (2, "fan", "#연찌 #늪지"), (3, "fan", "ㅂㅇㅍ 좋음")], "id int, owner string, caption string")
    out = {r.id: (r.seller_market, r.review_class) for r in linking.partition_sellers(posts, kb, "owner", F.col("caption").contains("협찬")).collect()}
    assert out == {1: ("늪지", "seller"), 2: (None, "genuine"), 3: (None, "genuine")}
    assert [tuple(r) for r in linking.caption_market(posts, kb, "id", "caption").collect()] == [(1, "연찌")]
    found = {tuple(r) for r in linking.markets_in_text(posts, kb, "id", "caption").collect()}
    assert found == {(1, "연찌"), (2, "연찌"), (2, "늪지"), (3, "빈짱")}
    (r,) = linking.exact_market(spark.createDataFrame([("연 찌",)], "w string"), "w", kb).collect()
    assert r.kb_handle == "yeonzzi"


def test_product_names(spark):
    arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    cases = [("이름", [], [], [], [], [], "이름", "no_tags"), ("a", ["A"], [], [], [], [], "a", "keep"), ("x", ["a"], ["a"], ["x"], [], [], None, "hold_excluded_name"),
             ("x", ["a"], ["a"], [], [], [], "x", "keep_distinct"), ("x", ["a"], [], [], [], [], "a", "sole_tag"), ("x", ["a", "b"], [], [], ["b"], [], "b", "l1_tiebreak"),
             ("x", ["a", "b"], [], [], [], ["a"], "a", "registry_tiebreak"), ("x", ["a", "b"], [], [], [], [], None, "hold_no_l1_match"), ("x", ["a", "b"], [], [], ["a", "b"], [], None, "hold_ambiguous")]
    for name, tags, claimed, excluded, l1, reg, want, why in cases:
        (r,) = spark.range(1).select(linking.resolved_product_name(F.lit(name), arr(tags), arr(claimed), arr(excluded), arr(l1), arr(reg)).alias("d")).collect()
        assert (r.d.product, r.d.decision) == (want, why)


def sequential_gate(batches, limit):
    """The gate step by step: (batch, pos) of what is emitted and what is left unprocessed."""
    emitted, rest, budget, examined = [], [], limit, 0
    for b, items in batches:
        if budget <= 0 or examined >= 3 * limit:
            break
        kept = []
        for pos, keep, score in items:
            if examined >= 3 * limit:
                break
            examined += 1
            if keep:
                kept.append((pos, score))
        kept.sort(key=lambda x: -x[1])
        emitted += [(b, p) for p, _ in kept[:budget]]
        rest += [(b, p) for p, _ in kept[budget:]]
        budget -= min(budget, len(kept))
    return set(emitted), set(rest)


def test_gate_budget_equals_a_sequential_gate(spark):
    r = random.Random(9)
    runs, rows = {}, []
    for run in range(60):
        limit = 4
        batches = [(b, [(p, r.random() < 0.5, r.randint(0, 2)) for p in range(r.randint(1, 6))]) for b in range(r.randint(1, 6))]
        runs[run] = sequential_gate(batches, limit)
        rows += [(run, b, p, k, s) for b, items in batches for p, k, s in items]
    df = spark.createDataFrame(rows, "run int, batch int, pos int, keep boolean, score int")
    out = gate.budget(df, 4, rank=[F.desc("score")], run=["run"]).collect()
    for run, (emitted, rest) in runs.items():
        assert {(o.batch, o.pos) for o in out if o.run == run and o.emitted} == emitted
        assert {(o.batch, o.pos) for o in out if o.run == run and o.unprocessed} == rest


def test_verdicts_and_counters(spark):
    texts = [("쫀득하고 좋음", 0.9), ("완장 뭐함", 0.9), ("비싸다", 0.1), ("", 0.9), ("별로라 실망", 0.2)]
    df = spark.createDataFrame([(0, i, t, s) for i, (t, s) in enumerate(texts)], "batch int, pos int, text string, topic_score double")
    df = gate.signals(df, "text")
    dc = {r.pos: r.axis for r in gate.verdicts(df, "dcinside", "text").collect()}
    ig = {r.pos: r.axis for r in gate.verdicts(df, "instagram", "text").collect()}
    assert dc == {0: None, 1: "meta", 2: None, 3: "empty", 4: None}
    assert ig == {0: None, 1: None, 2: "topic", 3: "empty", 4: "topic"}
    done = gate.budget(gate.verdicts(df, "dcinside", "text"), 2, rank=[F.desc("e_bucket"), F.desc("bias_hold"), F.desc("topic_score")])
    (c,) = gate.gate_counters(done, 2).collect()
    assert (c.examined, c.relevant, c.unprocessed, c.dropped_meta, c.shortfall) == (5, 2, 1, 1, 0)
    assert {r.pos for r in done.where("emitted").collect()} == {0, 4}


def test_bm25_by_hand(spark):
    docs = [["a", "b", "a"], ["b"], [], None, ["c", "c", "a", "b"]]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, tokens array<string>")
    got = {r.id: r.score for r in retrieval.bm25(df, ["a", "c", "c", "zzz"]).collect()}
    own = [d or [] for d in docs]
    n, avg = len(own), sum(map(len, own)) / len(own)
    df_ = {t: sum(t in d for d in own) for t in "abc"}
    idf = {t: np.log(n - k + 0.5) - np.log(k + 0.5) for t, k in df_.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else L.BM25_EPSILON * mean for t, v in idf.items()}
    for i, d in enumerate(own):
        want = sum(idf.get(q, 0) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for q in ["a", "c", "c", "zzz"])
        assert abs(got[i] - want) < 1e-12
    assert retrieval.bm25_topk(df, ["zzz"], 3).count() == 3
    assert retrieval.bm25_topk(df.limit(0), ["a"]).count() == 0


def test_search_and_context(spark):
    df = spark.createDataFrame([(i, [float(i == 1), 1.0], ["t", f"w{i}"], "m" if i else "n", f"e{i}") for i in range(4)], "id int, embedding array<float>, tokens array<string>, market string, evidence string")
    hits = retrieval.search(df, [1.0, 0.0], ["w2"], {"market": "m"}, k=2)
    assert {r.id for r in hits.collect()} == {1, 2}
    (c,) = retrieval.context(hits.join(df.select("id", "evidence"), "id")).collect()
    assert c.context.startswith("[1] ") and len(c.citations) == 2


def test_fold_and_gap(spark):
    rows = [(1, "a", "u", "1", "pos"), (2, "a", "u", "1", "pos"), (3, "a", "u", "2", "neg"), (4, "b", None, "1", "pos"), (5, "b", None, "1", "neu"), (6, "b", "u", None, None)]
    df = spark.createDataFrame(rows, "id int, platform string, url string, piece string, sentiment string")
    folded = consolidate.fold_first(df, ["platform", "url", "piece"], ["id"])
    assert {r.id for r in folded.collect()} == {1, 3, 4, 5, 6}
    (g,) = consolidate.sentiment_gap(df, "a", "b").collect()
    assert abs(g.gap - (1 / 3 - 1 / 2)) < 1e-12
    (g,) = consolidate.sentiment_gap(df, "a", "zz").collect()
    assert g.gap is None
    genuine, promo = consolidate.consolidated(df.withColumn("review_class", F.when(F.col("id") == 1, "promo")))
    assert genuine.count() == 5 and promo.count() == 1


def test_payload_and_summary_rows(spark):
    p = spark.createDataFrame([("scent", "p1"), ("cs", "p2"), ("shipping", "")], "criterion string, verdict string")
    m = spark.createDataFrame([("cs", "m2"), ("scent", "m1")], "criterion string, verdict string")
    scope = F.when(F.col("criterion").isin(*L.MARKET_CRITERIA), "market").otherwise("product")
    out = consolidate.summary_rows(consolidate.axis_payload(p, m, ["criterion"], scope))
    assert [(r.criterion, r.verdict) for r in out.collect()] == [("scent", "p1"), ("cs", "m2")]


def test_merges(spark):
    s = "market string, product string, v string, beads array<string>"
    old = spark.createDataFrame([("m", "p", "old", ["x"]), ("m", "q", None, [])], s)
    new = spark.createDataFrame([("m", "p", None, [], 1), ("m", "p", "a", ["y"], 2), ("m", "p", None, [], 3), ("n", "r", "b", [], 1)], s + ", at int")
    got = {(r.market, r.product): (r.v, r.beads) for r in merge.coalesce_upsert(old, new, ["market", "product"], "at", ["beads"]).collect()}
    assert got == {("m", "p"): ("a", ["y"]), ("m", "q"): (None, []), ("n", "r"): ("b", None)}
    key = ["market", "product"]
    ins = merge.insert_ignore(old.drop("v", "beads"), spark.createDataFrame([("m", "p", 1), ("z", "z", 2), ("z", "z", 3), ("m", None, 4), ("m", None, 5)], "market string, product string, o int"), key, ["o"])
    assert sorted(r.o for r in ins.collect()) == [2, 4, 5]
    rep = merge.replace_by_key(spark.createDataFrame([("m", None, 1), ("m", "p", 2)], "market string, product string, v int"), spark.createDataFrame([("m", None, 9)], "market string, product string, v int"), key)
    assert sorted((r.product or "", r.v) for r in rep.collect()) == [("", 9), ("p", 2)]
    joined = merge.spec_join(spark.createDataFrame([("m", "p", None), ("m", None, None), ("m", "p", 7)], "market string, product string, spec_id int"), spark.createDataFrame([("m", "p", 1), ("m", None, 2)], "market string, product string, id int"))
    assert sorted(str(r.spec_id) for r in joined.collect()) == ["1", "7", "None"]


def test_overlay(spark):
    specs = spark.createDataFrame([("m", "p", "s", None), ("m", "q", None, "b")], "market string, product string, scent string, base string")
    over = spark.createDataFrame([("m", "p", "scent", None, False), ("m", "q", "scent", None, True), ("x", "y", "scent", "z", False)], "market string, product string, field string, value string, unknown boolean")
    key, fields = ["market", "product"], ["scent", "base"]
    out = {r.product: r.scent for r in merge.overlay_apply(specs, over, key, fields).collect()}
    assert out == {"p": None, "q": None}
    assert [(r.product, r.missing) for r in merge.review_queue(specs, over, key, fields).orderBy("product").collect()] == [("p", ["base"])]
    assert [tuple(r) for r in merge.overlay_orphans(specs, over, key).collect()] == [("x", "y")]
    assert [(r.product, r.was, r.now) for r in merge.overlay_changes(specs, over, key, fields).collect()] == [("p", "s", None)]
    (e,) = merge.overlay_entry(specs, {"market": "m", "product": "p"}, "scent", " new ", "now", fields).collect()
    assert (e.value, e.was) == ("new", "s")
    with pytest.raises(ValueError):
        merge.overlay_entry(specs, {}, "nope", "x", "now", fields)
    assert {r.product: r.scent for r in merge.clear_blanks(specs, over, key, fields).collect()} == {"p": None, "q": None}


REVIEW = ("id int, source string, post_id string, market string, product string, market_confidence double, market_provenance string, body string, evidence string, "
          "tokens array<string>, score int, fingerprint string, scent string, texture string, sound string, summary string, sentiment string")  # fmt: skip


def review(id, **k):
    base = dict(source="amos", post_id=f"p{id}", market=None, product=None, market_confidence=0.0, market_provenance=None, body="슬라임 후기", evidence="[마켓미상] / x",
                tokens=["x"], score=1, fingerprint="f", scent=None, texture=None, sound=None, summary="요약", sentiment="pos")
    return (id, *(base | k).values())


def test_maintenance_plans(spark, kb):
    specs = spark.createDataFrame([("연찌", "말차쿠키"), ("빈짱", "젤리"), ("늪지", "젤리")], "market string, product string")
    reg = spark.createDataFrame([("빈짱", "후보쿠키")], "market string, product string")
    caps = spark.createDataFrame([("p1", "연찌"), ("p2", "빈짱"), ("p3", "늪지"), ("p9", "연찌")], "id string, caption_market string")
    rows = [review(1, product="말차쿠키"), review(2, product="말차쿠키"), review(3, product="젤리"), review(4, product="없는것"), review(5, product="후보쿠키"),
            review(6, product="ㅂㅉ 쿠키"), review(7, product="비매"), review(8, source="instagram", product="딴것", body="저녁 메뉴"), review(9, market="연찌", product="말차쿠키")]
    df = spark.createDataFrame(rows, REVIEW)
    plan = {r.id: (r.new_market, r.conflict) for r in maintenance.plan_backfill_market(df, specs, caps).collect()}
    assert plan[1] == ("연찌", False) and plan[2] == (None, True) and plan[3][0] == "늪지" and plan[4][0] is None
    out = {r.id: r for r in maintenance.apply_plan(df, maintenance.plan_backfill_market(df, specs, caps), rendered=maintenance.rendered_row()).collect()}
    assert out[1].market == "연찌" and out[1].market_confidence == 0.9 and out[1].evidence.startswith("[연찌] / 말차쿠키") and "연찌" in out[1].tokens
    assert out[2].market is None and out[9].evidence == "[마켓미상] / x"
    conf = {r.id: (r.state, r.new_market_confidence) for r in maintenance.plan_backfill_confidence(df, specs, caps).collect()}
    assert conf == {9: ("spec", 0.9)}
    inv = {r.id: (r.new_market, r.provenance, r.conflict) for r in maintenance.plan_inversion(df, specs, reg, caps, ["amos"]).collect()}
    assert inv == {1: ("연찌", "inversion_spec", False), 2: ("연찌", "inversion_spec", True), 5: ("빈짱", "inversion_registry", False)}
    assert [r.id for r in maintenance.plan_inversion(df, specs, reg, caps, ["amos"], "registry").collect()] == [5]
    assert [r.id for r in maintenance.plan_evidence_headers(df).collect()] == [9]
    assert [r.id for r in maintenance.plan_offtopic(df, specs, ["슬라임"]).collect()] == [8]
    known = spark.createDataFrame([("x",)], "name string")
    assert [r.id for r in maintenance.plan_non_products(df, known).collect()] == [7]
    att = {r.id: (r.new_product, r.new_market, r.dropped) for r in maintenance.plan_attribution(df, kb).collect()}
    assert att == {6: ("쿠키", "빈짱", False)}
    back = df.withColumn("market_provenance", F.when(F.col("id") == 9, "inversion_spec"))
    assert [(r.id, r.new_market) for r in maintenance.plan_revert_inversion(back, "spec").collect()] == [(9, None)]
    with pytest.raises(ValueError):
        maintenance.plan_revert_inversion(back, "nope")
    assert maintenance.migrated(maintenance.migrated(df, {"likes": "int"}), {"likes": "int"}).columns.count("likes") == 1
    posts = spark.createDataFrame([("연찌", "#말차쿠키"), ("빈짱", "#말차쿠키 #x")], "market string, caption string")
    (m,) = maintenance.inversion_material(back, posts).collect()
    assert (m.product, m.own_posts, m.other_posts) == ("말차쿠키", 1, 1)


def test_instagram_name_repair(spark):
    rows = [review(1, post_id="a", product="틀린이름", score=1), review(2, post_id="a", product="쿠키", score=3), review(3, post_id="b", product="x", score=1)]
    posts = spark.createDataFrame([("a", "#쿠키"), ("b", "#빵 #떡")], "post_id string, caption string")
    none = F.array().cast("array<string>")
    plan = maintenance.plan_instagram_names(spark.createDataFrame(rows, REVIEW), posts, none, F.array(F.lit("빵")), none)
    got = {r.id: (r.new_product, r.decision, r.dropped) for r in plan.collect()}
    assert got == {3: ("빵", "registry_tiebreak", False)}


def test_registry(spark):
    posts = spark.createDataFrame([("m", ["a", "a", "shop"], f"2024-01-{i:02d}", f"l{i}") for i in range(1, 9)] + [("m", ["폼볼"], "2024-02-01", "l9")], "market string, tags array<string>, at string, link string")
    got = {r.tag: (r.n_posts, r.n_total, r["class"], r.permalinks) for r in registry.product_registry(posts, "market", "tags", "at", "link").collect()}
    assert got["shop"] == (8, 9, "market_tag", ["l1", "l2", "l3"]) and got["폼볼"][2] == "type" and got["a"][0] == 8
    names = spark.createDataFrame([("쿠키",), ("쿠키슈",), ("쿠카",), ("말차",)], "name string")
    assert {tuple(r) for r in registry.prefix_pairs(names).collect()} == {("쿠키", "쿠키슈")}
    assert {tuple(r) for r in registry.edit1_pairs(names).collect()} == {("쿠카", "쿠키"), ("쿠키", "쿠키슈")}
    vocab = spark.createDataFrame([("C", "cookie"), ("D", "cookie dough"), ("E", "zzz")], "canonical string, form string")
    texts = spark.createDataFrame([(1, "a cookie dough"), (2, "cookies"), (3, None)], "id int, text string")
    want = {(1, "C"), (1, "D"), (2, "C")}
    assert {tuple(r) for r in registry.vocabulary_hits(texts, vocab, "id", "text").collect()} == want
    assert {tuple(r) for r in registry.vocabulary_hits(texts, vocab, "id", "text", window=registry.GRAM).collect()} == want


def test_vocabulary_hits_brute_force(spark, monkeypatch):
    import random

    from tallyglass.operators import linking

    rng = random.Random(1)
    said = lambda sizes: "".join(rng.choice("ab가😀 ") for _ in range(rng.choice(sizes)))
    docs = [(i, said([0, 1, 5, 40, 700])) for i in range(40)] + [(98, None), (99, "가" * 300)]
    forms = [(k, said([1, 2, 3, 4, 6, 7, 9])) for k in range(40)] + [(50, ""), (51, None), (52, "가" * 31)]
    forms += [(60 + k, docs[k % 40][1][5 : 5 + n]) for k, n in enumerate([14, 15, 30, 31, 200] * 6)]
    texts, vocab = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(forms, "canonical int, form string")
    want = {(i, k) for i, t in docs if t for k, f in forms if f and f in t}
    assert {tuple(r) for r in registry.vocabulary_hits(texts, vocab, "id", "text").collect()} == want
    assert {tuple(r) for r in registry.vocabulary_hits(texts, vocab, "id", "text", window=registry.GRAM).collect()} == want
    monkeypatch.setattr(linking, "LOOKUP_ROWS", 5)  # joined by key instead of broadcast
    assert {tuple(r) for r in registry.vocabulary_hits(texts, vocab, "id", "text").collect()} == want
    assert registry.vocabulary_hits(texts, vocab.limit(0), "id", "text").count() == 0


def test_threads(spark):
    df = spark.createDataFrame([(None, 1, False)] + [("t", i, i == 0) for i in range(5)], "thread string, n int, is_post boolean")
    assert {(r.thread, r.n_calls) for r in threads.thread_groups(df, "thread", "is_post", 2).collect()} == {("", 1), ("t", 3)}
    out = threads.thread_chunks(df.where("thread = 't'"), "thread", "n", "is_post", 2)
    assert sorted((r.chunk, r.place, r.is_context) for r in out.collect()) == [(0, 1, False), (0, 2, False), (1, 0, True), (1, 1, False), (1, 2, False), (2, 0, True), (2, 1, False)]
    posts = spark.createDataFrame([("1", "충분히 긴 본문입니다")], "thread_no string, text string")
    comments = spark.createDataFrame([("1", [("7", "ㅋㅋ"), ("8", "충분히 긴 댓글입니다")])], "thread_no string, comments array<struct<no:string,text:string>>")
    assert sorted((r.type, r.ordinal) for r in threads.candidates(posts, comments).collect()) == [("comment", 2), ("post", 0)]


def test_raw_log(spark, tmp_path):
    root = str(tmp_path / "raw")
    items = lambda xs: spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(xs)], "pos int, item string")
    rawlog.save_run(items([{"id": "1", "v": "old", "timestamp": "2024-01-01"}, {"v": "no id"}]), root, "feed", "a/b", "actor", "2024-01-01T00")
    rawlog.save_run(items([{"id": "1", "v": "new", "timestamp": "2024-02-01"}]), root, "feed", "a/b", "actor", "2024-01-02T00")
    rawlog.save_run(items([]).limit(0), root, "feed", "c", "actor", "2024-01-03T00")
    runs = rawlog.load_runs(spark, root)
    assert runs.count() == 4 and rawlog.load_runs(spark, root, "feed", "a/b").count() == 3
    got = sorted(json.loads(r.item)["v"] for r in rawlog.latest(runs).collect())
    assert got == ["new", "no id"]
    assert {(r.key, r.newest) for r in rawlog.newest(runs).collect()} == {("a_b", "2024-02-01"), ("c", None)}
    tagged = spark.createDataFrame([(0, "x", ["A", "b"], 1.0), (1, "y", ["z"], 1.0)], "pos int, item string, tags array<string>, usage_usd double")
    split = {(r.key, r.pos): r.key_usage_usd for r in rawlog.split_by_tag(tagged, ["a", "b"]).collect()}
    assert set(split) == {("a", 0), ("b", 0), ("_unmatched", 1)} and abs(sum(split.values()) - 1) < 1e-9


def test_pages(spark):
    assert pages.html_text("<title>T &amp; U</title><p>a<b>b</b></p><script>x</script><div> c\n d</div>") == ("T & U", "ab\nc d")
    html = '<a href="?id=x&no=12">a</a><a href="?id=x&amp;no=9">b</a><a href="?id=x&no=12">c</a>'
    assert spark.range(1).select(pages.listed_threads(F.lit(html))).first()[0] == ["12", "9"]


def test_social(spark, kb, tmp_path):
    item = dict(id="1", shortCode="S", url="u", caption="정말 좋은 슬라임 #연찌", ownerUsername=None, hashtags=None, timestamp="t", likesCount=3, commentsCount=1, inputUrl="https://www.instagram.com/yeonzzi/")
    path = tmp_path / "items.json"
    path.write_text(json.dumps([item, item, item | {"shortCode": "L", "caption": "ㅋㅋ"}], ensure_ascii=False))
    items = social.read_items(spark, str(path))
    (p,) = social.to_pieces(items).collect()
    assert (p.shortcode, p.hashtags, p.review_class, p.likes) == ("S", ["연찌"], "genuine", 3)
    assert social.matching(items, ["#연 찌"]).count() == 2
    assert {r.owner_username for r in social.seller_posts(items).collect()} == {"yeonzzi"}
    both, report = social.collect_all(spark, {"good": lambda: items.select("id"), "bad": lambda: 1 / 0, "more": lambda: items.select("url")})
    assert both.count() == 6 and {r.source for r in report.where("error is not null").collect()} == {"bad"}


def test_incremental(spark, kb):
    seen = spark.createDataFrame([("a", "500"), ("a", "x"), ("b", None)], "anchor string, no string")
    marks = {r.anchor: r.watermark for r in incremental.watermarks(seen, ["anchor"], "no").collect()}
    assert marks == {"a": 300, "b": None}
    new = spark.createDataFrame([("a", "299", "t1"), ("a", "301", "t2"), ("b", "1", "t3"), ("c", "1", "t4"), ("a", None, "t5"), ("a", "1", "t6")], "anchor string, no string, thread_no string")
    back = spark.createDataFrame([("t6",)], "thread_no string")
    out = incremental.above(new, incremental.watermarks(seen, ["anchor"], "no"), ["anchor"], F.col("no").cast("long"), back)
    assert sorted(r.thread_no for r in out.collect()) == ["t2", "t3", "t4", "t5", "t6"]
    assert incremental.missing_markets(kb, spark.createDataFrame([("연찌",)], "market string")).count() == 3


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    rows = [(i % 5, i) for i in range(20)]
    for k in range(2):
        spark.createDataFrame(rows, "k int, v int").coalesce(1).write.mode("append").parquet(str(src))
    for run in range(2):
        stream = spark.readStream.schema("k int, v int").parquet(str(src))
        q = incremental.ingest_stream(stream, table, ["k"], ["v"], str(tmp_path / f"check{run}"))
        q.awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(table).collect()) == [(i, i) for i in range(5)]


def test_stream_windows_equal_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.repartition(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = windows.tumbling(stream, ["event_type"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.table("w").collect()}
    assert got == {(r.start, r.event_type): r.n for r in windows.tumbling(ev, ["event_type"]).collect()}
    assert windows.sliding(ev, ["event_type"]).count() > len(got)


def test_hooks(spark):
    df = spark.createDataFrame([(1, "협찬 받음"), (2, "그냥 후기"), (3, "증정 boom"), (4, None)], "id int, text string")

    def detector(t):
        if "boom" in t:
            raise RuntimeError("down")
        return True, "model"

    got = {r.id: (r.is_promo, r.promo_marker, r.asked) for r in hooks.promo_verdicts(df, "text", detector).collect()}
    assert got == {1: (True, "model", True), 2: (False, None, False), 3: (False, None, True), 4: (False, None, False)}
    assert {r.id for r in df.where(hooks.classify(F.col("text"), lambda t: "후기" in t)).collect()} == {2}
    assert all(len(r.embedding) == 64 for r in hooks.embed(df, "text", hooks.hashed_embedding).collect())
    items = hooks.extract_items(df, "id", "text", lambda t: [{"name": w} for w in t.split()], "name string")
    assert sorted((r.id, r.pos, r.name) for r in items.collect())[:2] == [(1, 0, "협찬"), (1, 1, "받음")]
    material = spark.createDataFrame([("k", "p")], "k string, prompt string")
    (s,) = hooks.sectionize(material, ["k"], lambda p: {"scent": "은은해요. 소리 언급은 없어요."}, ["scent"]).collect()
    assert s.scent == "은은해요."
    answers = iter(["bad", '{"a": 1}'])
    assert hooks.retrying(lambda p: next(answers), json.loads)("x") == {"a": 1}
    assert hooks.retry_after({"retry-after-ms": "500"}, 2) == 2.0 and hooks.retry_after({}, 10) == 60.0


def test_evaluation(spark):
    sweep = spark.createDataFrame([(300, 9, 5, 1, 5), (400, 8, 0, 2, 10), (500, 8, 0, 2, 10)], "tau int, tp long, fp long, fn long, tn long")
    (best,) = evaluate.choose_tau(sweep).collect()
    assert best.tau == 400
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 3))
    c = evaluate.cross_validated(x, (x[:, 0] > 0).astype(float))
    assert c["tp"] + c["tn"] > 52 and sum(c.values()) == 60
    gold = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("c", 1, 1)], "id string, M int, E int")
    rulings = spark.createDataFrame([("a", ["b"], 1, 0)], "id string, also_applies array<string>, M int, E int")
    assert {(x.id, x.M, x.E) for x in evaluate.gold_with_rulings(gold, rulings).collect()} == {("a", 1, 0), ("b", 1, 0), ("c", 1, 1)}
    weak = evaluate.weak_labels(spark.createDataFrame([("좋음",), ("좋음",), ("완장",), ("?",)], "text string"), "text", [("완장", False), ("좋", True)])
    assert sorted(str(x.keep) for x in weak.collect()) == ["False", "None", "True"]


def test_calibration_guards(spark):
    rows = [(0.1, False)] * 12 + [(0.9, True)] * 6 + [(0.2, True)]
    df = spark.createDataFrame(rows, "score double, keep boolean")
    (r,) = evaluate.calibrated(df, "score", "keep", 0.5).collect()
    assert (r.tp, r.fp, r.fn, r.tn, r.usable) == (6, 0, 1, 12, True)
    assert not evaluate.calibrated(df, "score", "keep", 0.0).first().usable
    rates = spark.createDataFrame([(15, 15)], "n int, n_passed int")
    assert evaluate.passes(rates) and not evaluate.passes(spark.createDataFrame([(15, 14)], "n int, n_passed int"))


def test_dimension_files(spark, tmp_path):
    p = tmp_path / "overlay.json"
    dimensions.record(p, "m", "p", "scent", " 레몬 ", None, "t1")
    dimensions.record(p, "m", "p", "base", None, "x", "t2", unknown=True)
    got = {r.field: (r.value, r.unknown) for r in dimensions.overlay(spark, p).collect()}
    assert got == {"scent": ("레몬", False), "base": (None, True)}
    (tmp_path / "bad.json").write_text("{")
    assert dimensions.markers(tmp_path / "bad.json") == L.PROMO_MARKERS and dimensions.markers(tmp_path / "none.json", ["a"]) == ["a"]
    (tmp_path / "m.json").write_text('{"markers": ["_note", "b"]}')
    assert dimensions.markers(tmp_path / "m.json") == ["b"]
    (tmp_path / "kb.json").write_text(json.dumps({"markets": [{"market": "가", "market_word": "가", "handle": "h"}]}))
    (k,) = dimensions.knowledge_base(spark, tmp_path / "kb.json").collect()
    assert k.handle == "h" and k.aliases == []
    assert dimensions.registry(spark, str(tmp_path / "none")).count() == 0


def test_budget_stream_equals_the_batch_gate(spark, tmp_path):
    r = random.Random(3)
    runs, rows = {}, []
    for run in range(12):
        batches = [(b, [(p, r.random() < 0.5, r.randint(0, 2)) for p in range(r.randint(1, 6))]) for b in range(6)]
        runs[str(run)] = sequential_gate(batches, 4)[0]
        rows += [(str(run), b, p, k, float(s)) for b, items in batches for p, k, s in items]
    kind = "run string, batch long, pos long, keep boolean, score double"
    for half in (0, 1):  # batches arrive in two files, in order
        own = [x for x in rows if (x[1] >= 3) == half]
        spark.createDataFrame(own, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = budget_stream(stream, 4).writeStream.format("memory").queryName("taken").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("taken").collect()
    assert {run: {(x.batch, x.pos) for x in got if x.run == run} for run in runs} == runs
