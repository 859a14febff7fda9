"""The pipeline's stages, each on its own input, against brute force."""

import itertools
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tallyglass.llm import langid, neardup, rules
from tallyglass.llm.common import stored
from tests.llm.test_operators import SF, awkward, brute_components, brute_grams, check_packed, documents, empty


def brute_rules(text):
    """The kept text by the rules' definition, or None."""
    words = [w for w in re.split("[ \\t\\n\\x0b\\f\\r]+", text or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    repeat = {p for i, g in enumerate(grams) if many[g] > 1 for p in (i, i + 1, i + 2)}
    if len(words) < rules.MIN_WORDS or 100 * len(repeat) > rules.MAX_REPEAT_PERCENT * len(words):
        return None
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    good = []
    for x in lines:
        fails = (
            100 * sum(c in rules.SYMBOLS for c in x) > rules.SYMBOL_PERCENT * len(x)
            or rules.SHOUT_CHARS * len(re.findall("[!?]{2}", x)) > len(x)
            or (len(x) < rules.WRAPPED_CHARS and not any(c in rules.SENTENCE_ENDS[1:-1] for c in x))
            or sum(c in rules.MENU_MARKS for c in x) >= rules.MENU_COUNT
            or any(p in x.lower() for p in rules.BOILERPLATE)
        )
        if not fails:
            good.append(x)
    kept = 100 * sum(map(len, good)) >= rules.MIN_KEPT_PERCENT * sum(map(len, lines))
    return "\n".join(good) if kept else None


def brute_known(model, text):
    """Whether the language of a text explains it, from the definition of the features and votes."""
    if not any(c.isalpha() for c in text or ""):
        return False
    x = brute_grams(text)
    mean = {g: float((x / x.sum() * shares).sum()) for g, (shares, _) in model.profiles.items()}
    family = max(model.families, key=lambda f: (max(mean[g] for g in model.families[f]), f))
    wins = Counter()
    for a, b in itertools.combinations(model.families[family], 2):
        w = model.between[a, b]
        wins[a if float((w[:-1] * x).sum() + w[-1]) >= 0 else b] += 1
    lang = max(model.families[family], key=lambda g: (wins[g], g))
    return mean[lang] >= model.profiles[lang][1]


def test_stages_in_order(spark):
    docs = documents(spark)
    names = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        model = langid.fit(docs, langid.fold(F.col("doc_id")) != 0) if name == "language_id" else None
        docs = stored(stage(spark, docs, SF), name)
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        assert docs.columns == names and len(rows) == len(after)
        if name == "quality_rules":
            want = {i: brute_rules(t) for i, t in before}
            assert after == {i: t for i, t in want.items() if t is not None}
            assert all(r.n_chars == len(r.text) for r in rows) and not any(labels.get(i) == 0 for i in after)
        if name == "language_id":
            assert after == {i: t for i, t in before if brute_known(model, t)}
            assert len(after) >= 0.99 * len(before)
        if name == "near_dedup":
            assert set(after) == {c for _, c in brute_components(before, neardup.SHINGLE_WORDS).values()}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    check_packed(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), texts)
    whole = corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()
    assert {r.doc_id for r in whole} == {i for i, _ in texts}


@pytest.mark.parametrize("k", range(4))
def test_stages_take_awkward_and_empty_tables(spark, k):
    df, rows = awkward(spark)
    df = df.withColumn("lang", F.lit("en")).select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, df, SF).collect()
    assert all(o.doc_id in {i for i, _ in rows} for o in out)
    assert stage(spark, df.limit(0), SF).count() == 0
    if k == 2:  # repeated rows once, the near copy gone, everything without a twin kept
        assert sorted(str(o.doc_id) for o in out) == sorted(["1", "1", "2", "3", "4", "5", "7", "None"])
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("quality_rules", "lang_pred", "_in", "component_id", "salt")])
    made = stage(spark, clash, SF)
    assert made.count() == len(out)
    assert k == 3 or made.columns == [c for c in clash.columns if k or c != "quality_rules"]


def test_near_dedup_judges_texts_of_one_id_apart(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "b"), (5, text + " more", "x"), (5, "own words of this row", "x"), (1, text, "a")]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF).collect()
    assert sorted((o.doc_id, o.text) for o in out) == [(1, text), (5, "own words of this row")]


def test_language_id_without_labels_rejects_nothing_with_letters(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [o.doc_id for o in corpus_pipeline.language_id(spark, df, SF).collect()] == [1]


UNLEARNED = [
    "La mattina il sole sorge sopra le colline e i contadini escono di casa per lavorare nei campi. Nel villaggio le donne "
    "comprano il pane fresco e parlano delle notizie del giorno. Quando arriva la sera tutti si ritrovano nella piazza, dove "
    "i bambini giocano e gli anziani raccontano storie di tempi lontani.",
    "Rano slonce wschodzi nad wzgorzami i rolnicy wychodza z domu do pracy na polach. We wsi kobiety kupuja swiezy chleb i "
    "rozmawiaja o wiadomosciach dnia. Kiedy nadchodzi wieczor, wszyscy spotykaja sie na rynku, gdzie dzieci sie bawia.",
    "xq zvk wpt jrrg qqlm fzzd bvx kkwq ptrx mnvz lqj hgf dsz xcv bnm qwt zxk vbr plk jhg trw qsd fgh zxc vbn mlk poi uyt.",
]


def test_language_id_rejects_unlearned_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = corpus_pipeline.quality_rules(spark, docs, SF).select("doc_id", "text", "lang")
    planted = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(UNLEARNED)], docs.schema)
    left = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(planted), SF).select("doc_id").collect()}
    assert not any(i < 0 for i in left)
    assert len(left) >= 0.99 * docs.count()


def test_quality_rules_pass_on_the_clean_text(spark):
    prose = "\n".join(" ".join(f"w{k}x{j}" for j in range(8)) + "." for k in range(12))
    text = f"Home | News | About | Contact\n{prose}\nAll rights reserved."
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    (out,) = corpus_pipeline.quality_rules(spark, docs, SF).collect()
    assert out.text == prose and out.n_chars == len(prose)
    assert corpus_pipeline.quality_rules(spark, docs, SF).schema["n_chars"] == docs.schema["n_chars"]
