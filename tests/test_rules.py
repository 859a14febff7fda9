"""Decision tables over literal rows, Korean ones included."""

import pytest
from pyspark.sql import functions as F
from tallyglass.functions import numbers as N
from tallyglass.functions import rules as R
from tallyglass.functions import text as X


def over(spark, fn, values, kind="string"):
    """Values of a Column function over one column, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (X.choseong, {"빈짱ㅂx": "ㅂㅉㅂ", "까마귀 1": "ㄲㅁㄱ", "": "", None: ""}),
        (X.squeezed, {" a　b\tc ": "abc", None: ""}),
        (X.tag_key, {"Slime_Gina.": "slimegina", "a b": "ab"}),
        (X.hashtag_key, {"##Big Tag": "bigtag"}),
        (X.is_choseong_only, {"ㅂㅇㅍ": True, "ㅂ비": False, "": False}),
        (X.display_evidence, {"[연찌] / 좋음": "좋음", "[연찌] / ": None, "그냥": "그냥"}),
        (X.owner_from_url, {"https://www.instagram.com/some.name/": "some.name", "https://www.instagram.com/p/XyZ/": None}),
        (X.strip_chrome, {"제목 3 / 20 이전 다음 본문\n좋아요 - dc official App": "본문\n좋아요", "@글쓴 누구(1.2) 네": "네", "a  b\n\n\n\nc": "a b\n\nc"}),
        (X.hashtags, {"#가나 #가나 #b_1 x": ["가나", "b_1"], "none": []}),
        (X.product_hashtags, {"#슬라임 #말차쿠키 #ASMR": ["말차쿠키"]}),
        (X.clauses, {"좋았음 근데 별로. 끝": ["좋았음", "근데 별로", "끝"], "사고 왔다": ["사고", "왔다"], None: []}),
        (X.chunks, {"ㅋㅋ. 정말 좋은 질감. ㅇㅇ": ["정말 좋은 질감"], "ㅋㅋ": ["ㅋㅋ"], "": []}),
        (X.sentences, {"One. Two! three": ["One.", "Two!", "three"]}),
        (X.tokens, {"The 쿠키-Bun, 2": ["the", "쿠키", "bun", "2"], None: []}),
        (R.is_low_quality, {"ㅋㅋㅋㅋㅋㅋㅋㅋㅋ": True, "짧다": True, "충분히 긴 후기 본문": False, None: True}),
        (R.first_marker, {"협찬 받은 서포터즈": "서포터즈", "PPL 아님": "ppl", "그냥": None}),
        (R.promo_gate, {"나눔 이벤트": True, "비매 할인": False, " ": False}),
        (R.is_meta, {"완장 뭐함": True, "3 / 20 이전 다음": True, "질감 얘기": False}),
        (R.is_question, {"뭐가 나을까 싶음": True, "그러니까 좋음": False, "퀄 좋긴함": False, "추천 좀": True}),
        (R.is_hearsay, {"좋다더라": True, "피드로 봄": True, "내가 만짐": False}),
        (R.has_firsthand, {"쫀득하고 좋음": True, "다들 좋다더라": False, "사진만 봤는데 좋음": False, "비싸다": False}),
        (R.is_negative, {"현타 온다": True, "좋다": False}),
        (R.is_purchase_intent, {"살까 말까": True, "궁금해서 사본": False}),
        (R.is_non_product_word, {"디폼": True, "내리꽃디폼": False, "점토": True, "버블 어쩌구": True, "ㅅㄱㄷ": True, "": False, None: False}),
        (R.label_core, {"비매품 1번": "비매품", "이번비매": "비매", "3차수": "차수", "비매5": "비매", "교동비매": "교동비매"}),
        (R.scrubbed, {"향은 은은해요. 소리 언급은 거의 없어요.": "향은 은은해요.", "건수가 적어요.": None, None: None}),
        (N.first_int, {"조회 1,234회": 1234, "-5": -5, "없음": None, None: None}),
        (N.clean_url, {" https://a.b/c#d ": "https://a.b/c", "ftp://a.b": None, "https://": None, "x": None}),
        (N.embed_url, {"https://www.instagram.com/reel/AbC/?x=1": "https://www.instagram.com/reel/AbC/embed", "https://evilinstagram.com/p/A": None, "https://instagram.com/user": None}),
    ],
)
def test_columns(spark, fn, cases):
    assert over(spark, fn, list(cases)) == list(cases.values())


def test_excerpt(spark):
    long = "첫 문장은 이만큼 길어요. " + "가" * 30
    got = over(spark, lambda c: X.excerpt(c, 20), ["short  one", long, "aaaa bbbb cccc dddd eeee ffff", "x" * 40])
    assert got == ["short one", "첫 문장은 이만큼 길어요.…", "aaaa bbbb cccc dddd…", "x" * 20 + "…"]


@pytest.mark.parametrize(
    ("name", "known", "want"),
    [
        ("비매", ["비매"], True), ("비매품", [], True), ("랜덤박스", ["랜덤박스"], True),
        ("비매품50", ["비매품50"], False), ("비매품 1번", ["x"], True), ("3차수", [], True),
        ("베이퍼비매", ["x"], True), ("푸딩비매품", ["푸딩비매품"], False), ("베이퍼비매", [], False),
        ("나비매듭", ["x"], False), ("", ["x"], False), (None, ["x"], False),
    ],
)
def test_sale_labels(spark, name, known, want):
    arr = F.array(*map(F.lit, known)).cast("array<string>")
    assert over(spark, lambda c: R.is_non_product_label(c, arr), [name]) == [want]


def test_evidence(spark):
    cases = [("쫀득함", "정말 쫀득함", "쿠키", True), ("", "x", "쿠키", False), ("없는 말", "다른 글", "쿠키", False), ("좋다더라", "좋다더라", None, False),
             ("장바구니 담았", "장바구니 담았다", None, False), ("쿠키", "쿠키 좋음", "쿠키", False), ("쿠키 썸", "쿠키 썸", "쿠키", True), ("좋음", None, None, True)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, e string, s string, p string, want boolean")
    for r in df.withColumn("got", R.keeps_evidence(F.col("e"), F.col("s"), F.col("p"))).collect():
        assert r.got == r.want, r


def test_unknown_filter_raises():
    with pytest.raises(ValueError):
        R.metafilter({"review_class": "promo"})


def test_scrubbed_cell_moves_the_minority_up(spark):
    df = spark.createDataFrame([("후기 언급이 없어요.", "일부는 단단해요."), ("좋아요.", "건수 2건.")], "v string, m string")
    got = [(r.c.verdict, r.c.minority) for r in df.select(R.scrubbed_cell(F.col("v"), F.col("m")).alias("c")).collect()]
    assert got == [("일부는 단단해요.", None), ("좋아요.", None)]


def test_dates_and_ids(spark):
    got = over(spark, N.timestamp_of, ["2024-01-02 03:04:05", "2024.01.02", "01.02 03:04", "2024-01-02T03:04:05Z", None])
    assert [None if t is None else t.year for t in got] == [2024, 2024, None, 2024, None]
    df = spark.createDataFrame([("u", None), ("u", "3"), (None, "3")], "url string, no string")
    assert [r[0] for r in df.select(N.dc_post_id(F.col("url"), F.col("no"))).collect()] == ["u", "u:3", None]


def test_query_expansion_and_keys():
    assert X.expand_queries("쿠키", ["cookie", "쿠키"], "ㅇㅉ") == ["쿠키", "cookie", "ㅇㅉ쿠키", "ㅇㅉ"]
    assert X.safe_key(" a/b c ") == "a_b_c" and X.safe_key("") == "_"
