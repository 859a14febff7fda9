"""Rules over literal rows: each case brings its own small table, and its SQL states the rows that the rule gives for it.

A changed word list, pattern or rule changes a row. The registered queries over the driver's tables are in the library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass import schema
from tallyglass.functions import numbers as N
from tallyglass.functions import rules as R
from tallyglass.functions import text as X
from tallyglass.operators import consolidate, evaluate, gate, hooks, linking, maintenance, merge, registry, retrieval, threads
from tallyglass.plans import ingest, views
from tallyglass.sources import pages, rawlog, social
from tallyglass.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def sql_literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def stated(columns: str, rows: Iterable[tuple]) -> str:
    """SQL that gives ``rows``; ``columns`` are names with DuckDB types."""
    names = [c.split() for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join(map(sql_literal, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {kind}) AS {n}" for n, kind in names)
    return f"SELECT {casts} FROM (VALUES {values}) AS v({', '.join(n for n, _ in names)})"


def query(sql: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


def by_text(name: str, doc: str, columns: str, make: Callable[[Column], list[Column]], cases: dict) -> None:
    """A query of ``make`` over the texts that ``cases`` maps to the expected values; NULL is the text None."""
    texts = list(cases)
    rows = [(i, *(cases[t] if isinstance(cases[t], tuple) else (cases[t],))) for i, t in enumerate(texts)]
    names = [c.split()[0] for c in columns.split(", ")]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return df.select("i", *[c.alias(n) for n, c in zip(names, make(F.col("t")))])

    run.__name__, run.__doc__ = name, doc
    query(stated("i INTEGER, " + columns, rows))(run)


def strings(xs: Iterable[str]) -> Column:
    return F.array(*map(F.lit, xs)).cast("array<string>")


def joined(x: Column) -> Column:
    return F.array_join(x, "|")


# --- predicates

by_text("korean_axes", "F7, F8, F10, F13.", "M INTEGER, Q INTEGER, E INTEGER", lambda t: [R.axes(t)[c] for c in "MQE"], {
    "완장이 글 삭했네": (1, 0, 0), "3 / 7 이전 다음 소식": (1, 0, 0), "쫀득하고 좋음": (0, 0, 1), "이거 추천 좀": (0, 1, 0), "이거 맛있을까요": (0, 1, 0),
    "살 만할까 싶어서": (0, 1, 0), "배송이 언제 오니까 ": (0, 0, 0), "색이 좋다더라": (0, 0, 0), "별로였지만 쫄깃함": (0, 0, 1), "사진만 봤는데 최고": (0, 0, 0),
    "무게감 있고 말랑한데 고민됨": (0, 1, 1), "담아 두면 좋겠": (0, 0, 0), "(4/5) 향": (0, 0, 1), "plain words": (0, 0, 0), "": (0, 0, 0), None: (0, 0, 0),
})
by_text("hearsay", "F9, F10: somebody else's experience, and the clauses that are one's own.", "hearsay BOOLEAN, own VARCHAR",
        lambda t: [R.is_hearsay(t), joined(R.firsthand_clauses(t))], {
    "좋다고 들었": (True, ""), "남들 다 쓰는데 나는 쫀득함": (True, "나는 쫀득함"), "향은 별로, 소리는 최고": (False, "향은 별로|소리는 최고"),
    "피드 보고 좋아서": (True, ""), "장바구니": (True, ""), "크리미하다": (False, "크리미하다"), None: (False, ""),
})
by_text("negative_and_intent", "F11, F12.", "neg BOOLEAN, buys BOOLEAN", lambda t: [R.is_negative(t), R.is_purchase_intent(t)], {
    "돈 아까움": (True, False), "살까 말까": (False, True), "실망해서 빼야겠": (True, True), "사고  싶다": (False, True), "추천 좀": (False, True),
    "쫀득": (False, False), "": (False, False), None: (False, False),
})
by_text("non_product_words", "F15.", "word BOOLEAN", lambda t: [R.is_non_product_word(t)], {
    "디폼": True, "촉감류(점토)": True, "화이트 글루": True, "생베": True, "ㅇㅉ": True, "어쩌구 쿠키": True, "쿠키": False, "말차디폼": False, "": False, None: False,
})
by_text("non_product_labels", "F16 with three known names.", "core VARCHAR, label BOOLEAN",
        lambda t: [R.label_core(t), R.is_non_product_label(t, strings(["말차쿠키", "쿠키비매", "이번비매"]))], {
    "비매": ("비매", True), "비매 2차": ("비매", True), "이번 비매": ("비매", False), "저번 비매 3번": ("비매", True), "랜덤박스": ("랜덤박스", True),
    "포도비매": ("포도비매", True), "쿠키 비매": ("쿠키비매", False), "말차쿠키": ("말차쿠키", False), "2차": ("차", False), "12 쿠키": ("쿠키", False), "": ("", False),
})
by_text("offending_sentences", "F21.", "offends BOOLEAN", lambda t: [R.offends(t)], {
    "소리 언급은 없다": True, "향에 대한 평가는 거의 없음": True, "반응이 안 보이네": True, "두 출처가 갈린다": True, "3건이 좋다고 했다": True, "인스타에서 좋다": True,
    "향이 은은하다": False, "쫀득함이 좋다": False,
})
by_text("scrubbed_summaries", "F22, X14.", "left_ VARCHAR, n INTEGER", lambda t: [R.scrubbed(t), F.size(X.sentences(t))], {
    "향이 은은하다. 소리 언급은 없다. 쫀득하다!": ("향이 은은하다. 쫀득하다!", 3), "소리 언급은 없다.": (None, 1), "하나? 둘": ("하나? 둘", 2), "": (None, 0), None: (None, 0),
})
by_text("embed_addresses", "F23, F24.", "clean VARCHAR, embed VARCHAR", lambda t: [N.clean_url(t), N.embed_url(t)], {
    " https://www.instagram.com/p/Ab_1/?x=1#top ": ("https://www.instagram.com/p/Ab_1/?x=1", "https://www.instagram.com/p/Ab_1/embed"),
    "http://instagram.com/reel/Xy-9": ("http://instagram.com/reel/Xy-9", "https://www.instagram.com/reel/Xy-9/embed"),
    "https://notinstagram.com/p/A": ("https://notinstagram.com/p/A", None), "https://www.instagram.com/name/": ("https://www.instagram.com/name/", None),
    "ftp://instagram.com/p/A": (None, None), "no address": (None, None), None: (None, None),
})
by_text("initials_only", "F27, X1.", "alone BOOLEAN, initials VARCHAR", lambda t: [X.is_choseong_only(t), X.choseong(t)], {
    "ㅇㅉ": (True, "ㅇㅉ"), "연찌": (False, "ㅇㅉ"), "늪지 슬라임": (False, "ㄴㅈㅅㄹㅇ"), "ㅂㅇㅍ바나나": (False, "ㅂㅇㅍㅂㄴㄴ"), "까치 힣": (False, "ㄲㅊㅎ"),
    "가": (False, "ㄱ"), "abc 12": (False, ""), "": (False, ""), None: (False, ""),
})

# --- texts

by_text("displayed_evidence", "F31.", "shown VARCHAR", lambda t: [X.display_evidence(t)], {
    "[늪지] / 쿠키 / 향 좋음": "쿠키 / 향 좋음", " [마켓미상] / ": None, "머리말 없음": "머리말 없음", "[a] b": "[a] b", None: None,
})
by_text("name_keys", "X2, X3, X4.", "squeezed VARCHAR, tag VARCHAR, hashtag VARCHAR, alias VARCHAR",
        lambda t: [X.squeezed(t), X.tag_key(t), X.hashtag_key(t), X.alias_key(t)], {
    "Slime_Gina. A": ("Slime_Gina.A", "slimeginaa", "slimeginaa", "slime_gina.a"), "##Big Tag": ("##BigTag", "##bigtag", "bigtag", "##bigtag"),
    "말차　쿠키": ("말차쿠키", "말차쿠키", "말차쿠키", "말차쿠키"), None: ("", "", "", ""),
})
by_text("caption_tags", "X5, X6, X7: the market's own tags do not name a product.", "tags VARCHAR, products VARCHAR",
        lambda t: [joined(X.hashtags(t)), joined(X.product_hashtags(t, X.market_exclusions(F.lit("늪지 슬라임"), F.lit("늪지"), F.lit("Neup.ji"), strings(["swamp_slime"]))))], {
    "#슬라임 #말차쿠키 #말차쿠키 #늪지": ("슬라임|말차쿠키|늪지", "말차쿠키"), "#neupji #Swamp_Slime #ASMR #빵_1": ("neupji|Swamp_Slime|ASMR|빵_1", "빵_1"),
    "태그 없음": ("", ""), "#슬라임": ("슬라임", ""), None: ("", ""),
})
by_text("korean_clauses", "X8.", "parts VARCHAR", lambda t: [joined(X.clauses(t))], {
    "쫀득하고 좋음 소리도 좋은데 비쌈": "쫀득하고|좋음|소리도 좋은데|비쌈", "별로지만 가볍다": "별로지만|가볍다", "하나, 둘…셋·넷？다섯": "하나|둘|셋|넷|다섯",
    "만지면서 봄": "만지면서|봄", "산 것임 맞음": "산 것임|맞음", "고기": "고기", "": "", None: "",
})
by_text("text_chunks", "X9.", "parts VARCHAR", lambda t: [joined(X.chunks(t))], {
    "향이 정말 좋다. ㅋㅋㅋ 쫀득하고 말랑하다": "향이 정말 좋다|ㅋㅋㅋ 쫀득하고 말랑하다", "ㅋㅋ": "ㅋㅋ", "ㅇㅇ. 좋": "ㅇㅇ. 좋", " ": "", None: "",
})
by_text("cleaned_posts", "X10, X11.", "clean VARCHAR", lambda t: [X.clean_post(t)], {
    "제목  글\n\n\n\n끝 https://a.b/c": "제목 글\n\n끝", "본문 @글쓴 누구 말\n- dc official App": "본문 말", "뉴스 3 / 7 이전 다음 본문": "본문", None: "",
})
by_text("excerpts", "X13 with a limit of 12.", "cut VARCHAR", lambda t: [X.excerpt(t, 12)], {
    "짧은 글": "짧은 글", "열두 글자 안쪽. 나머지는 잘린다": "열두 글자 안쪽.…", "앞. 끊을 곳이 없이 이어지는 글": "앞. 끊을 곳이 없이…", "하나둘셋넷다섯여섯일곱여덟아홉": "하나둘셋넷다섯여섯일곱여…",
    "a\n b": "a b", None: "",
})
by_text("word_tokens", "X18.", "words VARCHAR", lambda t: [joined(X.tokens(t))], {
    "Slime, 향이 좋다! x_1": "slime|향이|좋다|x_1", "...": "", None: "",
})
by_text("market_labels", "X20, X21: the colour is that of the name's MD5.", "label VARCHAR, letter VARCHAR",
        lambda t: [X.trimmed(t), X.monogram(t)["char"]], {" 늪지 ": ("늪지", "늪"), "abc": ("abc", "a")})
by_text("account_names", "X23.", "owner VARCHAR", lambda t: [X.owner_from_url(t)], {
    "https://www.instagram.com/yeon.zzi_/": "yeon.zzi_", "https://instagram.com/p/Ab1/": None, "https://instagram.com/explore/tags/x": None, "x": None, None: None,
})
by_text("capture_times", "N2.", "taken TIMESTAMP", lambda t: [N.timestamp_of(t).cast("timestamp_ntz")], {
    "2024-03-05 06:07:08": "2024-03-05 06:07:08", "2024.03.05 06:07:08": "2024-03-05 06:07:08", "2024.03.05 06:07": "2024-03-05 06:07:00",
    " 2024.03.05 ": "2024-03-05 00:00:00", "2024-03-05T06:07:08Z": "2024-03-05 06:07:08", "03.05": None, "soon": None, None: None,
})
by_text("counted_numbers", "N1 over counts with labels.", "n INTEGER", lambda t: [N.first_int(t)], {
    "조회 1,234": 1234, "-5점": -5, "댓글 0": 0, "없음": None, None: None,
})


@query("""SELECT i, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 8 AS INTEGER) AS colour
  FROM (VALUES (0, '늪지'), (1, '연찌'), (2, 'abc'), (3, '')) AS v(i, w)""")  # fmt: skip
def market_colours(spark, sf):
    """X21."""
    df = spark.createDataFrame([(0, "늪지"), (1, "연찌"), (2, "abc"), (3, "")], "i int, w string")
    return df.select("i", X.monogram(F.col("w"))["colour"].alias("colour"))


# --- several columns

KEEPS = [  # evidence, source, product, stands
    ("쫀득하고 좋다", "정말 쫀득하고  좋다 그래요", "쿠키", True), ("다른 말", "정말 쫀득하다", "쿠키", False), ("좋다더라", "좋다더라", None, False),
    ("살까 고민", "살까 고민", None, False), ("쿠키", "쿠키 샀다", "쿠키", False), ("쿠키최고", "쿠키 최고", "쿠키", True), (" ", "무엇", None, False), ("아무 말", None, None, True),
]


@query(stated("i INTEGER, stands BOOLEAN", [(i, r[3]) for i, r in enumerate(KEEPS)]))
def kept_evidence(spark, sf):
    """F14."""
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(KEEPS)], "i int, e string, s string, p string")
    return df.select("i", R.keeps_evidence(F.col("e"), F.col("s"), F.col("p")).alias("stands"))


CELLS = [("향이 좋다.", "소리 언급은 없다.", "향이 좋다.", None), ("평가가 없다.", "쫀득하다는 사람도 있다.", "쫀득하다는 사람도 있다.", None), ("좋다.", "별로다.", "좋다.", "별로다."), (None, None, None, None)]


@query(stated("i INTEGER, verdict VARCHAR, minority VARCHAR", [(i, *r[2:]) for i, r in enumerate(CELLS)]))
def scrubbed_cells(spark, sf):
    """the minority moves up if the verdict is empty."""
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(CELLS)], "i int, v string, m string")
    return df.select("i", R.scrubbed_cell(F.col("v"), F.col("m")).alias("c")).select("i", "c.*")


POSTS = [("레몬", None, None, None, "말차 쿠키", "말차_쿠키", True), (None, None, None, " ", "말차", "말차", False), ("레몬", None, None, None, "말차", "쿠키", False), (None, "x", None, None, "a", "A", True)]


@query(stated("i INTEGER, ok BOOLEAN", [(i, r[6]) for i, r in enumerate(POSTS)]))
def product_posts(spark, sf):
    """F26."""
    df = spark.createDataFrame([(i, *r[:6]) for i, r in enumerate(POSTS)], "i int, a string, b string, c string, d string, n string, g string")
    return df.select("i", R.is_product_post(*map(F.col, "abcdn"), F.array("g")).alias("ok"))


ITEMS = [  # market, product, scent, texture, summary, evidence, sentiment, line
    ("늪지", "쿠키", "레몬", None, "좋다", "근거", "pos", "[늪지] / 쿠키 / 향 레몬 / 총평 좋다 / 긍정"),
    (None, None, None, "쫀득", None, "근거", "neg", "[마켓미상] / 질감 쫀득 / 총평 근거 / 부정"), ("a", "b", " ", None, None, None, None, "[a] / b"),
]


@query(stated("i INTEGER, line VARCHAR", [(i, r[7]) for i, r in enumerate(ITEMS)]))
def rendered_reviews(spark, sf):
    """X12."""
    df = spark.createDataFrame([(i, *r[:7]) for i, r in enumerate(ITEMS)], "i int, market string, product string, scent string, texture string, summary string, evidence string, sentiment string")
    null = F.lit(None).cast("string")
    item = F.struct("market", "product", "scent", "texture", null.alias("sound"), null.alias("longevity"), "summary", "evidence", "sentiment")
    return df.select("i", X.render_review(item).alias("line"))


@query(stated("i INTEGER, product VARCHAR, market VARCHAR", [(0, "늪지 쿠키 슬라임", "늪지 슬라임"), (1, "연찌 슬라임", "연찌 슬라임"), (2, "빵 슬라임", "")]))
def topic_anchors(spark, sf):
    """X17."""
    df = spark.createDataFrame([(0, "늪지", " 쿠키"), (1, "연찌", "슬라임"), (2, None, "빵")], "i int, m string, p string")
    return df.select("i", X.anchor(F.col("m"), F.col("p")).alias("product"), X.anchor(F.col("m"), F.col("p"), scope="market").alias("market"))


@query(stated("i INTEGER, types VARCHAR", [(0, "디폼, 난사"), (1, None)]))
def joined_types(spark, sf):
    """X19."""
    df = spark.createDataFrame([(0, ["디폼", "난사"]), (1, [])], "i int, t array<string>")
    return df.select("i", X.join_types(F.col("t")).alias("types"))


NAMES = [  # name, tags, claimed, excluded, layer 1, registry, product, decision
    ("이름", "", "", "", "", "", "이름", "no_tags"), ("a b", "A_B", "", "", "", "", "a b", "keep"), ("x", "a", "a", "x", "", "", None, "hold_excluded_name"),
    ("x", "a", "a", "", "", "", "x", "keep_distinct"), ("x", "a", "", "", "", "", "a", "sole_tag"), ("x", "a b", "", "", "b", "a", "b", "l1_tiebreak"),
    ("x", "a b", "", "", "", "a", "a", "registry_tiebreak"), ("x", "a b", "", "", "", "", None, "hold_no_l1_match"), ("x", "a b", "", "", "a b", "", None, "hold_ambiguous"),
]


@query(stated("i INTEGER, product VARCHAR, decision VARCHAR", [(i, *r[6:]) for i, r in enumerate(NAMES)]))
def product_name_decisions(spark, sf):
    """X24."""
    df = spark.createDataFrame([(i, *r[:6]) for i, r in enumerate(NAMES)], "i int, name string, tags string, claimed string, excluded string, l1 string, reg string")
    sets = [F.filter(F.split(c, " "), lambda t: t != "") for c in ("tags", "claimed", "excluded", "l1", "reg")]
    return df.select("i", linking.resolved_product_name(F.col("name"), *sets).alias("d")).select("i", "d.*")


IDS = [  # explicit, parent, url, comment, thread, post id
    ("7", "8", "https://g/?no=9", None, "7", "https://g/?no=9"), (None, "8", "https://g/?no=9", "3", "8", "https://g/?no=9:3"), (None, None, "https://g/?id=a&no=9", "4", "9", "https://g/?id=a&no=9:4"),
    (None, None, "https://g/", None, None, "https://g/"), (None, None, None, "4", None, None),
]


@query(stated("i INTEGER, thread VARCHAR, post VARCHAR", [(i, *r[4:]) for i, r in enumerate(IDS)]))
def thread_and_post_ids(spark, sf):
    """N4, N5."""
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(IDS)], "i int, e string, p string, u string, c string")
    return df.select("i", N.thread_no(F.col("e"), F.col("p"), F.col("u")).alias("thread"), N.dc_post_id(F.col("u"), F.col("c")).alias("post"))


@query(stated("i INTEGER, score INTEGER, print VARCHAR", [(0, 6, '{"scent":"a","texture":"b"}'), (1, 2, '{"scent":"a","texture":null}'), (2, 0, '{"scent":null,"texture":null}')]))
def held_items(spark, sf):
    """N6, N7."""
    df = spark.createDataFrame([(0, "a", "b", "s", 4.0), (1, "a", None, " ", 0.0), (2, None, None, None, None)], "i int, scent string, texture string, s string, r double")
    score = N.filled_score([F.col("scent"), F.col("texture")], F.col("s"), F.col("r"))
    return df.select("i", score.alias("score"), N.held_fingerprint(F.struct("scent", "texture")).alias("print"))


@query(stated("i INTEGER, id VARCHAR", [(0, "u#cmt:77"), (1, "u"), (2, None)]))
def rewritten_ids(spark, sf):
    """N11."""
    df = spark.createDataFrame([(0, "u#cmt3", "77"), (1, "u", "5"), (2, None, "5")], "i int, p string, c string")
    return df.select("i", N.rewritten_post_id(F.col("p"), F.col("c")).alias("id"))


@query("SELECT i, round(1 / (1 + exp(-(0.5 * a - 1.5 * b + 0.25))), 9) AS p FROM (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE), (1, -2.0, 3.0), (2, 0.0, 0.0)) AS v(i, a, b)")
def probe_probability(spark, sf):
    """N8."""
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, -2.0, 3.0), (2, 0.0, 0.0)], "i int, a double, b double")
    return df.select("i", F.round(N.probability([0.5, -1.5], 0.25, F.array("a", "b")), 9).alias("p"))


# --- linking

KB = "market string, market_word string, handle string, handles_alt array<string>, aliases array<string>, choseong string, choseong_aliases array<string>"


def knowledge(spark: SparkSession) -> DataFrame:
    rows = [("늪지 슬라임", "늪지", "neupji", ["swamp_slime"], ["늪"], "ㄴㅈ", []), ("연찌", "연찌", "yeonzzi", [], [], "ㅇㅉ", []),
            ("빈짱", "빈짱", "binzzang", None, None, "ㅂㅉ", ["ㅂㅇㅍ"]), ("나지", "나지", "naji", [], [], None, [])]
    return spark.createDataFrame(rows, KB)


LINKS = [  # item market, document market, product -> market, confidence, provenance, product
    ("연 찌", None, "쿠키", "연찌", 0.95, "surface", "쿠키"), ("ㅂㅉ", None, "쿠키", "빈짱", 0.85, "choseong", "쿠키"), ("ㄴㅈ", None, None, None, 0.5, None, None),
    ("모름", None, "쿠키", None, 0.0, None, "쿠키"), (None, None, "ㅇㅉ 쿠키슈", "연찌", 0.82, "prefix_choseong", "쿠키슈"), (None, None, "늪지 쿠키", "늪지", 0.92, "prefix_surface", "쿠키"),
    (None, "연찌", "쿠키", "연찌", 0.75, "inherit", "쿠키"), (None, "연찌", "ㅂㅇㅍ바나나", "빈짱", 0.82, "prefix_choseong", "바나나"), (None, None, "디폼", None, 0.0, None, None),
    (None, None, "말차 쿠키", "연찌", 0.8, "inversion_spec", "말차 쿠키"), (None, None, "두집쿠키", None, 0.0, None, "두집쿠키"), (None, None, "후보쿠키", "빈짱", 0.65, "inversion_registry", "후보쿠키"),
    (None, None, "Foo  Bar", None, 0.0, None, "Foo  Bar"), ("모름", None, "말차쿠키", None, 0.0, None, "말차쿠키"), (None, None, None, None, 0.0, None, None),
]


@query(stated("i INTEGER, market VARCHAR, confidence DOUBLE, provenance VARCHAR, product VARCHAR, abstained BOOLEAN", [(i, *r[3:], r[3] is None) for i, r in enumerate(LINKS)]))
def korean_links(spark, sf):
    """With an excluded name, an ambiguous one and one that only the registry knows."""
    items = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(LINKS)], "i int, item_market string, doc_market string, product string")
    own = lambda rows: linking.owners(spark.createDataFrame(rows, "p string, m string"), linking.product_key(F.col("p")), "m")
    specs = own([("말차쿠키", "연찌"), ("두집 쿠키", "연찌"), ("두집쿠키", "빈짱"), ("foo bar", "연찌")])
    out = linking.link(items, knowledge(spark), specs, own([("두집쿠키", "늪지"), ("후보쿠키", "빈짱")]), excluded=["FOO bar"])
    return out.select("i", "market", "confidence", "provenance", "product", "abstained")


@query(stated("i INTEGER, hint VARCHAR, rest VARCHAR", [(0, None, "포도"), (1, None, "요아곰 밀키크림"), (2, "ㅇㅉ", None), (3, "ㅇㅉ", "쿠키"), (4, "ㅂㅇㅍ", "아몬드"), (5, None, None), (6, None, None)]))
def korean_prefixes(spark, sf):
    """J4."""
    names = ["포도", "요아곰 밀키크림", "ㅇㅉ", "ㅇㅉ 쿠키", "ㅂㅇㅍ아몬드", None, " "]
    df = spark.createDataFrame(list(enumerate(names)), "i int, product string")
    return linking.split_prefix(df, "product", knowledge(spark)).select("i", "hint", "rest")


def captions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, " Neupji ", "#연찌 협찬"), (2, "fan", "#연찌 #늪지"), (3, "fan", "ㅂㅇㅍ 좋음"), (4, "SWAMP_slime", None)], "id int, owner string, caption string")


@query(stated("id INTEGER, seller_market VARCHAR, review_class VARCHAR", [(1, "늪지", "seller"), (2, None, "genuine"), (3, None, "genuine"), (4, "늪지", "seller")]))
def korean_sellers(spark, sf):
    """J8, J9."""
    promo = F.col("caption").contains("협찬")
    return linking.partition_sellers(captions(spark), knowledge(spark), "owner", promo).select("id", "seller_market", "review_class")


@query(stated("id INTEGER, market VARCHAR, via VARCHAR", [(1, "연찌", "tag"), (1, "연찌", "text"), (2, "연찌", "text"), (2, "늪지", "text"), (3, "빈짱", "text")]))
def markets_of_captions(spark, sf):
    """Markets that the hashtags name with certainty, and those that the text names."""
    tags = linking.caption_market(captions(spark), knowledge(spark), "id", "caption").select("id", F.col("caption_market").alias("market"), F.lit("tag").alias("via"))
    return tags.unionByName(linking.markets_in_text(captions(spark), knowledge(spark), "id", "caption").withColumn("via", F.lit("text")))


@query(stated("i INTEGER, handle VARCHAR", [(0, "yeonzzi"), (1, None), (2, None)]))
def exact_markets(spark, sf):
    """J3, J26."""
    df = spark.createDataFrame([(0, "연 찌"), (1, "ㅇㅉ"), (2, None)], "i int, w string")
    return linking.exact_market(df, "w", knowledge(spark)).select("i", F.col("kb_handle").alias("handle"))


# --- review rows

REVIEW = ("id int, source string, post_id string, market string, market_confidence double, product string, body string, evidence string, score int, "
          "fingerprint string, market_provenance string, tokens array<string>")  # fmt: skip
ROWS = [  # id, source, post, market, confidence, product, body, evidence, score
    (1, "amos", "p1", None, 0.0, "말차쿠키", "슬라임", "[마켓미상] / 말차쿠키", 2, None), (2, "amos", "p2", None, 0.0, "말차 쿠키", "슬라임", "[마켓미상] / 말차쿠키", 1, None),
    (3, "amos", "p3", None, 0.0, "모르는쿠키", "슬라임", "x", 1, None), (4, "amos", "p4", None, 0.0, "후보쿠키", "슬라임", "x", 1, None), (5, "instagram", "p5", None, None, "후보쿠키", "음식", "x", 1, None),
    (6, "amos", "p6", None, 0.0, "ㅂㅇㅍ 쿠키", "슬라임", "x", 1, None), (7, "amos", "p7", "연찌", 0.0, "말차쿠키", "슬라임", "[마켓미상] / x", 1, "inversion_spec"),
    (8, "instagram", "p8", "연찌", 0.9, "비매", "일상", "x", 1, None), (9, "instagram", "p9", "연찌", 0.8, "말차쿠키", "일상", "x", 1, "inversion_registry"), (10, "amos", "p10", "늪지", 0.0, "말차쿠키", "슬라임", "x", 1, None),
]


def review_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r[:9], f"f{r[0]}", r[9], []) for r in ROWS], REVIEW)


def spec_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("연찌", "말차쿠키")], "market string, product string")


def caption_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("p2", "빈짱"), ("p3", "늪지"), ("p1", "연찌")], "id string, caption_market string")


@query(stated("id INTEGER, product VARCHAR, dropped BOOLEAN", [(5, "후보쿠키", True), (8, "비매", True)]))
def offtopic_plan(spark, sf):
    """The row of a known product stays."""
    return maintenance.plan_offtopic(review_rows(spark), spec_rows(spark), ["슬라임"])


@query(stated("id INTEGER, product VARCHAR, decision VARCHAR, dropped BOOLEAN", [(1, "말차쿠키", "sole_tag", False), (3, "빵", "registry_tiebreak", False), (6, "말차쿠키", "sole_tag", True)]))
def product_name_plan(spark, sf):
    """Generic tags and the market's own name no product; rows that land on one name fold."""
    rows = [(1, "a", "틀린이름", 3), (6, "a", "다른이름", 1), (2, "c", "그대로", 1), (3, "b", "x", 1), (4, "d", "남는이름", 1)]
    reviews = spark.createDataFrame(rows, "id int, post_id string, product string, score int")
    posts = [("a", "#슬라임 #늪지 #말차쿠키", ["늪지"]), ("b", "#빵 #떡 #asmr", None), ("c", "#슬라임", None), ("d", "#늪지 #슬라임추천", ["늪지"])]
    posts = spark.createDataFrame(posts, "post_id string, caption string, own array<string>")
    plan = maintenance.plan_instagram_names(reviews, posts, strings([]), strings(["빵"]), strings([]), "own")
    return plan.select("id", F.col("new_product").alias("product"), "decision", "dropped")


@query(stated("id INTEGER, product VARCHAR, market VARCHAR, confidence DOUBLE, dropped BOOLEAN", [(6, "쿠키", "빈짱", 0.82, False)]))
def attribution_plan(spark, sf):
    """U9."""
    plan = maintenance.plan_attribution(review_rows(spark).where("id <> 8"), knowledge(spark))
    return plan.select("id", F.col("new_product").alias("product"), F.col("new_market").alias("market"), F.col("new_market_confidence").alias("confidence"), "dropped")


@query(stated("id INTEGER, market VARCHAR, confidence DOUBLE, conflict BOOLEAN", [(1, "연찌", 0.9, False), (2, None, None, True), (3, "늪지", 0.7, None), (4, None, None, None), (5, None, None, None), (6, None, None, None)]))
def market_backfill_plan(spark, sf):
    """Specs before captions; where they differ, neither."""
    plan = maintenance.plan_backfill_market(review_rows(spark), spec_rows(spark), caption_rows(spark))
    return plan.select("id", F.col("new_market").alias("market"), F.col("new_market_confidence").alias("confidence"), "conflict")


@query(stated("id INTEGER, state VARCHAR, confidence DOUBLE", [(7, "spec", 0.9), (10, "conflict", None)]))
def confidence_backfill_plan(spark, sf):
    """U11."""
    plan = maintenance.plan_backfill_confidence(review_rows(spark), spec_rows(spark), caption_rows(spark))
    return plan.select("id", "state", F.col("new_market_confidence").alias("confidence"))


@query(stated("id INTEGER, market VARCHAR", [(7, "연찌")]))
def evidence_header_plan(spark, sf):
    """U12."""
    return maintenance.plan_evidence_headers(review_rows(spark)).select("id", F.col("new_market").alias("market"))


@query(stated("id INTEGER, market VARCHAR, provenance VARCHAR, conflict BOOLEAN", [(1, "연찌", "inversion_spec", False), (2, "연찌", "inversion_spec", True), (4, "빈짱", "inversion_registry", False)]))
def inversion_plan(spark, sf):
    """Names are compared without white space; a caption that disagrees is a conflict."""
    registry = spark.createDataFrame([("빈짱", "후보쿠키"), ("늪지", "말차쿠키")], "market string, product string")
    plan = maintenance.plan_inversion(review_rows(spark), spec_rows(spark), registry, caption_rows(spark), ["amos"])
    return plan.select("id", F.col("new_market").alias("market"), "provenance", "conflict")


@query(stated("id INTEGER, market VARCHAR, confidence DOUBLE", [(7, None, 0.0), (9, None, 0.0)]))
def revert_plan(spark, sf):
    """U14."""
    plan = maintenance.plan_revert_inversion(review_rows(spark), "all")
    return plan.select("id", F.col("new_market").alias("market"), F.col("new_market_confidence").alias("confidence"))


@query(stated("product VARCHAR, market VARCHAR, excerpts VARCHAR, own_posts BIGINT, other_posts BIGINT", [("말차쿠키", "연찌", "슬라임|일상", 1, 2)]))
def inversion_evidence(spark, sf):
    """U15."""
    posts = spark.createDataFrame([("연찌", "#말차쿠키"), ("빈짱", "#말차쿠키 #x"), ("늪지", "#말차쿠키")], "market string, caption string")
    return maintenance.inversion_material(review_rows(spark), posts).withColumn("excerpts", joined(F.col("excerpts")))


@query(stated("id INTEGER, product VARCHAR", [(8, None)]))
def sale_label_plan(spark, sf):
    """U16, F16."""
    known = spark.createDataFrame([("말차쿠키",)], "name string")
    return maintenance.plan_non_products(review_rows(spark), known).select("id", F.col("new_product").alias("product"))


@query(stated("id INTEGER, market VARCHAR, evidence VARCHAR, n_tokens INTEGER", [(r[0], "연찌" if r[0] == 1 else "늪지" if r[0] == 3 else r[3],
       {1: "[연찌] / 말차쿠키", 3: "[늪지] / 모르는쿠키"}.get(r[0], r[7]), 2 if r[0] in (1, 3) else 0) for r in ROWS if r[0] not in (2,)] + [(2, None, "[마켓미상] / 말차쿠키", 0)]))
def applied_backfill(spark, sf):
    """U10 applied, X12: the market and what is rendered from it change together."""
    rows = review_rows(spark)
    plan = maintenance.plan_backfill_market(rows, spec_rows(spark), caption_rows(spark)).where("set_market")
    null = F.lit(None).cast("string")
    fields = ("market", "product", "scent", "texture", "sound", "longevity", "summary", "evidence", "sentiment")
    line = X.render_review(F.struct(*[(F.col(c) if c in ("market", "product") else null).alias(c) for c in fields]))
    return maintenance.apply_plan(rows, plan, rendered=line).select("id", "market", "evidence", F.size("tokens").alias("n_tokens"))


@query(stated("c VARCHAR", [("a",), ("b",)]))
def migrated_columns(spark, sf):
    """Adding a column twice adds it once."""
    df = maintenance.migrated(maintenance.migrated(spark.createDataFrame([(1,)], "a int"), {"b": "string"}), {"b": "string"})
    return spark.createDataFrame([(c,) for c in df.columns], "c string")


@query(stated("doc INTEGER, pos INTEGER, name VARCHAR, score INTEGER", [(1, 0, "말차_쿠키", 3), (1, 2, None, 2), (1, 4, None, 0), (1, 5, None, 0), (2, 0, "말차쿠키", 1)]))
def korean_fold(spark, sf):
    """Names fold by their normal form, held items by their whole content, empty ones never."""
    rows = [(1, 0, "말차 쿠키", "a", 1), (1, 1, "말차_쿠키", "b", 3), (1, 2, None, "c", 2), (1, 3, None, "c", 2), (1, 4, None, "d", 0), (1, 5, None, "d", 0), (2, 0, "말차쿠키", "a", 1)]
    df = spark.createDataFrame(rows, "doc int, pos int, name string, fp string, score int")
    return merge.fold_by_product(df, "doc", "name", "fp", "score", "pos").drop("fp")


PAGE = ("id int, source string, market string, product string, body string, evidence string, overall_sentiment string, likes int, views int, votes_up int, "
        "posted_at timestamp_ntz, created_at timestamp_ntz, review_class string, source_ref struct<url:string,comment_no:string,shortcode:string>")  # fmt: skip


@query(stated("id INTEGER, platform VARCHAR, evidence VARCHAR, url VARCHAR", [(2, "dcinside", "쿠키", "https://g/?no=1"), (3, "instagram", "좋음", "https://www.instagram.com/p/B/")]))
def product_page_reviews(spark, sf):
    """A page of a product alone lists the reviews of all markets, each piece once, the newest row of it."""
    rows = [(1, "amos", "연찌", "쿠키", "본문", "[연찌] / 쿠키", "pos", 1, 1, 1, None, None, "genuine", ("https://g/?no=1#x", None, None)), (2, "amos", "연찌", "쿠키", "본문", "[연찌] / 쿠키", "pos", 1, 1, 1, None, None, "genuine", ("https://g/?no=1#x", None, None)),
            (3, "instagram", "늪지", "쿠키", "본문", "좋음", "neu", 2, 1, 1, None, None, "genuine", ("https://www.instagram.com/p/B/", None, "B")), (4, "amos", "연찌", "빵", "본문", "x", "neg", 1, 1, 1, None, None, "genuine", ("https://g/?no=4", None, None))]
    listed = views.list_reviews(spark.createDataFrame(rows, PAGE), None, "쿠키")
    return listed.select("id", "platform", "evidence", "url")


# --- the gate, threads and evaluation

GATED = [  # text, topic score, axis on dcinside, axis on instagram, bucket, held for its bias
    ("쫀득하고 좋음", 0.9, None, None, 1, False), ("완장 뭐함", 0.9, "meta", None, 0, False), ("비싸다", 0.1, None, "topic", 0, False), ("", 0.9, "empty", "empty", 0, False),
    ("별로라 실망", 0.2, None, "topic", 1, True),
]


@query(stated("pos INTEGER, dc VARCHAR, ig VARCHAR, bucket INTEGER, bias BOOLEAN", [(i, *r[2:]) for i, r in enumerate(GATED)]))
def gate_verdicts(spark, sf):
    """F18, F19, V6."""
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(GATED)], "pos int, text string, topic_score double")
    df = gate.signals(df, "text")
    dc = gate.verdicts(df, "dcinside", "text").select("pos", F.col("axis").alias("dc"), F.col("e_bucket").alias("bucket"), F.col("bias_hold").alias("bias"))
    return dc.join(gate.verdicts(df, "instagram", "text").select("pos", F.col("axis").alias("ig")), "pos")


@query(stated("examined BIGINT, relevant BIGINT, unprocessed BIGINT, dropped_meta BIGINT, shortfall BIGINT", [(5, 2, 1, 1, 0)]))
def gate_counters(spark, sf):
    """R22, W1, W2."""
    df = spark.createDataFrame([(0, i, *r[:2]) for i, r in enumerate(GATED)], "batch int, pos int, text string, topic_score double")
    done = gate.budget(gate.verdicts(gate.signals(df, "text"), "dcinside", "text"), 2, rank=[F.desc("e_bucket"), F.desc("bias_hold"), F.desc("topic_score")])
    return gate.gate_counters(done, 2).select(*[F.col(c).cast("long").alias(c) for c in ("examined", "relevant", "unprocessed", "dropped_meta", "shortfall")])


@query(stated("type VARCHAR, ordinal INTEGER", [("post", 0), ("comment", 2)]))
def thread_candidates(spark, sf):
    """A post, and its comments by their place; noise is no candidate."""
    posts = spark.createDataFrame([("1", "충분히 긴 본문입니다")], "thread_no string, text string")
    comments = spark.createDataFrame([("1", [("7", "ㅋㅋ"), ("8", "충분히 긴 댓글입니다")])], "thread_no string, comments array<struct<no:string,text:string>>")
    return threads.candidates(posts, comments).select("type", F.col("ordinal").cast("int").alias("ordinal"))


@query(stated("i INTEGER, nos VARCHAR", [(0, "12|9"), (1, "")]))
def listed_threads(spark, sf):
    """Thread numbers of a list page, in order and once."""
    df = spark.createDataFrame([(0, '<a href="?id=x&no=12">a</a><a href="?id=x&amp;no=9">b</a><a href="?id=x&no=12">c</a>'), (1, "<p>none</p>")], "i int, html string")
    return df.select("i", joined(pages.listed_threads(F.col("html"))).alias("nos"))


@query(stated("market_word VARCHAR", [("늪지",), ("빈짱",), ("나지",)]))
def markets_without_rows(spark, sf):
    """J12."""
    return incremental.missing_markets(knowledge(spark), spark.createDataFrame([("연찌",)], "market string")).select("market_word")


@query(stated("anchor VARCHAR, no VARCHAR, thread_no VARCHAR", [("a", "301", "t2"), ("b", "1", "t3"), ("c", "1", "t4"), ("a", None, "t5"), ("a", "1", "t6")]))
def rows_above_the_mark(spark, sf):
    """Rows above the mark, without a mark or number, and those of a thread that comes back."""
    seen = spark.createDataFrame([("a", "500"), ("a", "x"), ("b", None)], "anchor string, no string")
    new = spark.createDataFrame([("a", "299", "t1"), ("a", "301", "t2"), ("b", "1", "t3"), ("c", "1", "t4"), ("a", None, "t5"), ("a", "1", "t6")], "anchor string, no string, thread_no string")
    back = spark.createDataFrame([("t6",)], "thread_no string")
    return incremental.above(new, incremental.watermarks(seen, ["anchor"], "no"), ["anchor"], F.col("no").cast("long"), back).select("anchor", "no", "thread_no")


@query(stated("tau INTEGER", [(400,)]))
def chosen_tau(spark, sf):
    """E1."""
    sweep = spark.createDataFrame([(300, 9, 5, 1, 5), (400, 8, 0, 2, 10), (500, 8, 0, 2, 10)], "tau int, tp long, fp long, fn long, tn long")
    return evaluate.choose_tau(sweep).select("tau")


@query(stated("id VARCHAR, M INTEGER, E INTEGER", [("a", 1, 0), ("b", 1, 0), ("c", 1, 1)]))
def ruled_gold(spark, sf):
    """A ruling holds for its item and for those it also applies to."""
    gold = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("c", 1, 1)], "id string, M int, E int")
    rulings = spark.createDataFrame([("a", ["b"], 1, 0)], "id string, also_applies array<string>, M int, E int")
    return evaluate.gold_with_rulings(gold, rulings).select("id", "M", "E")


@query(stated("tp BIGINT, fp BIGINT, fn BIGINT, tn BIGINT, usable BOOLEAN", [(6, 0, 1, 12, True)]))
def calibration_guard(spark, sf):
    """E3, E4."""
    df = spark.createDataFrame([(0.1, False)] * 12 + [(0.9, True)] * 6 + [(0.2, True)], "score double, keep boolean")
    return evaluate.calibrated(df, "score", "keep", 0.5).select("tp", "fp", "fn", "tn", "usable")


@query(stated("id INTEGER, is_promo BOOLEAN, promo_marker VARCHAR, asked BOOLEAN", [(1, True, "model", True), (2, False, None, False), (3, False, None, True), (4, False, None, False)]))
def promo_verdicts(spark, sf):
    """Only texts behind the wide gate are asked about, and a failing model says no."""
    df = spark.createDataFrame([(1, "협찬 받음"), (2, "그냥 후기"), (3, "증정 boom"), (4, None)], "id int, text string")

    def detector(t: str) -> tuple[bool, str]:
        if "boom" in t:
            raise RuntimeError("down")
        return True, "model"

    return hooks.promo_verdicts(df, "text", detector).select("id", "is_promo", "promo_marker", "asked")


@query(stated("i INTEGER, q VARCHAR", [(0, "쿠키|ㅋㅋ슈|ㅇㅉ쿠키|ㅇㅉ"), (1, "쿠키")]))
def search_terms(spark, sf):
    """X16."""
    made = [X.expand_queries("쿠키", ["ㅋㅋ슈", "쿠키", ""], "ㅇㅉ"), X.expand_queries("쿠키")]
    return spark.createDataFrame([(i, "|".join(q)) for i, q in enumerate(made)], "i int, q string")


@query(stated("i INTEGER, k VARCHAR", [(0, "a_b"), (1, "늪지-1.x"), (2, "_"), (3, "_")]))
def path_keys(spark, sf):
    """X22."""
    return spark.createDataFrame([(i, X.safe_key(k)) for i, k in enumerate(["a/b", " 늪지-1.x ", "..", None])], "i int, k string")


# --- social sources, hooks and the views of sources apart

SOCIAL_ITEMS = [  # id, shortCode, url, caption, ownerUsername, hashtags, timestamp, likes, comments, inputUrl
    ("1", "A", "https://www.instagram.com/p/A/", "말차쿠키 정말 쫀득하고 좋아요 #말차쿠키", "fan", ["말차쿠키"], "2026-01-02", 3, 1, None),
    ("2", "A", "https://www.instagram.com/p/A/", "말차쿠키 정말 쫀득하고 좋아요 #말차쿠키", "fan", ["말차쿠키"], "2026-01-02", 3, 1, None),
    ("3", "B", "https://www.instagram.com/p/B/", "오늘 올라온 새 글이에요 #빵 #색", None, None, "2026-01-03", None, None, "https://www.instagram.com/yeonzzi/"),
    ("4", "C", "https://www.instagram.com/p/C/", "짧음", "fan", [], "2026-01-04", 0, 0, None),
    ("5", "D", "https://www.instagram.com/p/D/", "이번에 나온 것도 올려 봐요 #색", "yeonzzi", ["색"], "2026-01-05", 9, 2, None),
]


def posts_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOCIAL_ITEMS, social.ITEM)


@query(stated("shortcode VARCHAR, hashtags VARCHAR, hashtag VARCHAR, likes INTEGER, review_class VARCHAR", [
    ("A", "말차쿠키", "쿠키", 3, "genuine"), ("B", "빵|색", "쿠키", None, "genuine"), ("D", "색", "쿠키", 9, "genuine")]))
def social_pieces(spark, sf):
    """Each post once, short captions go, tags from the caption where the item has none."""
    return social.to_pieces(posts_of(spark), "쿠키").select("shortcode", joined(F.col("hashtags")).alias("hashtags"), "hashtag", "likes", "review_class")


@query(stated("id VARCHAR", [("3",), ("5",)]))
def social_posts_of_tags(spark, sf):
    """Posts that carry one of the tags."""
    return social.matching(posts_of(spark), ["#색", "없음"]).select("id")


@query(stated("id VARCHAR, owner VARCHAR", [("x", "shop"), ("y", "other"), ("z", "flat")]))
def profile_posts(spark, sf):
    """The posts of a profile, with the profile's owner where they name none; a flat post is itself."""
    post = lambda i, o: (i, i, None, "c", o, None, None, None, None, None)
    rows = [(*post("p", None), "shop", [post("x", None), post("y", "other")]), (*post("z", "flat"), None, [])]
    return social.profile_posts(spark.createDataFrame(rows, f"{social.ITEM}, {social.PROFILE}")).select("id", F.col("ownerUsername").alias("owner"))


@query(stated("id VARCHAR, owner VARCHAR", [("1", "fan"), ("5", "yeonzzi")]))
def seller_posts_per_handle(spark, sf):
    """Owner from the item or the input address; the newest post of each, the smaller code first."""
    rows = social.seller_posts(posts_of(spark).where("id <> '2'"), per_handle=1)
    return rows.select("id", F.col("owner_username").alias("owner"))


@query(stated("market VARCHAR, product VARCHAR", [("연찌", "말차쿠키"), ("늪지", "빵")]))
def official_products(spark, sf):
    """A fixture's products under the market of its handle, in any letter case; unknown handles go."""
    kind = "handle string, products array<struct<product_name:string>>"
    fixture = spark.createDataFrame([("YEONZZI", [("말차쿠키",)]), ("swamp_slime", [("빵",)]), ("nobody", [("x",)])], kind)
    return social.layer1_specs(fixture, knowledge(spark)).select("market", "product")


@query(stated("kind VARCHAR, key VARCHAR, newest VARCHAR", [("tag", "a", "2026-02-01T00:00:00Z"), ("tag", "b", None)]))
def newest_captures(spark, sf):
    """The newest item time of each key; an empty run has none."""
    rows = [("tag", "a", '{"timestamp": "2026-01-01T00:00:00Z"}'), ("tag", "a", '{"timestamp": "2026-02-01T00:00:00Z"}'), ("tag", "b", None)]
    return rawlog.newest(spark.createDataFrame(rows, "kind string, key string, item string"))


by_text("toxic_words", "F3: none for an empty list.", "toxic BOOLEAN, never BOOLEAN", lambda t: [R.has_any(t, ["Bad", "나쁜"]), R.has_any(t, [])], {
    "a BAD word": (True, False), "나쁜말": (True, False), "good": (False, False), " ": (False, False), None: (False, False),
})


@query(stated("i INTEGER, name VARCHAR", [(0, "쿠키"), (1, None), (2, "말차쿠키"), (3, None), (4, None)]))
def names_held_to_vocabulary(spark, sf):
    """Names that the piece or the vocabulary holds stay, others and sale labels become NULL."""
    rows = [(0, "쿠키 쫀득하고 좋음", "쿠키"), (1, "쫀득하고 좋음", "없는이름"), (2, "쫀득하고 좋음", "말차쿠키"), (3, "비매 쫀득하고 좋음", "비매"), (4, "쫀득하고 좋음", None)]
    items = spark.createDataFrame([(*r, r[1]) for r in rows], "i int, t string, mentioned_product string, firsthand_evidence string")
    known, words = spark.createDataFrame([], "name string"), spark.createDataFrame([("말차 쿠키",)], "canonical string")
    return ingest.keep_items(items, "t", known, words).select("i", F.col("mentioned_product").alias("name"))


@query(stated("id INTEGER, author VARCHAR, likes INTEGER, comment_count INTEGER, votes_up INTEGER", [(1, "nick", 1200, 7, 3), (2, "owner", None, 4, None)]))
def post_meta_columns(spark, sf):
    """a zero comment count falls through to the next key."""
    names = ["body", "title", "nick", "owner_username", "posted_at", "likes", "views", "comment_count", "comments", "recommend_up", "recommend_down"]
    rows = [(1, (None, None, "nick", "owner", None, "좋아요 1,200", None, "7", "4", "3", None)), (2, (None, None, None, "owner", None, None, None, "0", "4", None, None))]
    df = spark.createDataFrame(rows, f"id int, meta struct<{', '.join(f'{n}: string' for n in names)}>")
    return df.select("id", *pages.post_columns(F.col("meta"))).select("id", "author", "likes", "comment_count", "votes_up")


@query(stated("id INTEGER, topic_score DOUBLE", [(1, 1.0), (2, 0.6)]))
def topic_scores(spark, sf):
    """V1, V3, V7: chunks of all documents are embedded, and the best cosine with the anchor is a document's."""
    vectors = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [3.0, 4.0]}
    chunks = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c")], "id int, chunk string")
    embedded = hooks.embed(chunks, "chunk", lambda ts: [vectors[t] for t in ts])
    return gate.max_cosine(embedded, [1.0, 0.0]).withColumn("topic_score", F.round("topic_score", 6))


@query(stated("i INTEGER, yes BOOLEAN", [(0, True), (1, False), (2, False)]))
def classified(spark, sf):
    """H1: NULL texts are no."""
    df = spark.createDataFrame([(0, "yes"), (1, "no"), (2, None)], "i int, t string")
    return df.select("i", hooks.classify(F.col("t"), lambda t: t == "yes").alias("yes"))


@query(stated("name VARCHAR, market VARCHAR, n_reviews BIGINT", [("쿠키", "연찌", 2)]))
def registry_aliases(spark, sf):
    """Registry names of one market alone that reviews use."""
    tags = spark.createDataFrame([("연찌", "쿠키"), ("연찌", "빵"), ("늪지", "빵"), ("늪지", "색")], "market string, tag string")
    reviews = spark.createDataFrame([("쿠키",), ("쿠키",), ("빵",)], "product string")
    return registry.registry_aliases(tags, reviews).select(F.col("product").alias("name"), "market", "n_reviews")


@query(stated("kind VARCHAR, a VARCHAR, b VARCHAR, n_a BIGINT, n_b BIGINT, markets_a VARCHAR", [
    ("edit1", "쿠카", "쿠키", 0, 2, None), ("edit1", "쿠카", "쿠카슈", 0, 0, None), ("prefix", "쿠카", "쿠카슈", 0, 0, None)]))
def alias_candidates(spark, sf):
    """Pairs with the review counts and markets of both names."""
    names = spark.createDataFrame([("쿠키",), ("쿠카",), ("쿠카슈",), ("말차",)], "name string")
    stats = registry.name_stats(spark.createDataFrame([("쿠키", "연찌"), ("쿠키", "빈짱")], "product string, market string"))
    return registry.alias_candidates(names, stats).select("kind", "a", "b", "n_a", "n_b", joined(F.col("markets_a")).alias("markets_a"))


@query(stated("market VARCHAR, tag VARCHAR", [("연찌", "쿠키"), ("연찌", "빵")]))
def registry_products(spark, sf):
    """Product rows only."""
    rows = spark.createDataFrame([("연찌", "쿠키", 3, "product"), ("연찌", "빵", 1, "product"), ("연찌", "연찌", 9, "market_tag")], "market string, tag string, n_posts int, class string")
    return registry.registry_products(rows).select("market", "tag")


EDITS = "market string, product string, field string, value string, unknown boolean"


@query(stated("product VARCHAR, scent VARCHAR, base_combo VARCHAR", [("빵", "새콤", "b"), ("쿠키", None, "b")]))
def cleared_blanks(spark, sf):
    """What a human blanked becomes NULL; an edit with a value is not applied here."""
    specs = spark.createDataFrame([("연찌", "쿠키", "새콤", "b"), ("연찌", "빵", "새콤", "b")], "market string, product string, scent string, base_combo string")
    edits = spark.createDataFrame([("연찌", "쿠키", "scent", " ", False), ("연찌", "빵", "base_combo", "x", False)], EDITS)
    return merge.clear_blanks(specs, edits, ["market", "product"], ["scent", "base_combo"]).select("product", "scent", "base_combo")


@query(stated("product VARCHAR, field VARCHAR, value VARCHAR, was VARCHAR, \"at\" VARCHAR", [("쿠키", "scent", "달콤", "새콤", "2026-01-01")]))
def override_entry(spark, sf):
    """The edit of one field, trimmed, with the value it replaces."""
    specs = spark.createDataFrame([("연찌", "쿠키", "새콤"), ("연찌", "빵", None)], "market string, product string, scent string")
    out = merge.overlay_entry(specs, {"market": "연찌", "product": "쿠키"}, "scent", " 달콤 ", "2026-01-01", ["scent"])
    return out.select("product", "field", "value", "was", "at")


@query(stated("context VARCHAR, citations VARCHAR", [("[1] 향\n[2] \n[3] 색", "7|9|8")]))
def search_context(spark, sf):
    """Hits in order as one numbered block, and their ids."""
    hits = spark.createDataFrame([(8, 2, "색"), (7, 0, "향"), (9, 1, None)], "id int, rank int, evidence string")
    out = retrieval.context(hits)
    return out.select("context", F.array_join(F.transform("citations", lambda c: c.cast("string")), "|").alias("citations"))


@query(stated("criterion VARCHAR, verdict VARCHAR", [("scent", "좋아요"), ("cs", "친절해요"), ("shipping", "옛말")]))
def axis_verdicts(spark, sf):
    """Order criteria come from the market's own summary where it has one."""
    products = spark.createDataFrame([("scent", "좋아요"), ("cs", "옛말"), ("shipping", "옛말")], "criterion string, verdict string")
    markets = spark.createDataFrame([("cs", "친절해요"), ("scent", "아님")], "criterion string, verdict string")
    scope = F.when(F.col("criterion").isin("cs", "shipping"), "market").otherwise("product")
    return consolidate.axis_payload(products, markets, ["criterion"], scope).select("criterion", "verdict")


def viewed_reviews(spark: SparkSession) -> DataFrame:
    """Two products in one comment, two posts of another platform, of which one is promoted."""
    base = dict.fromkeys(f.name for f in schema.REVIEWS.fields) | {"market": "연찌", "product": "쿠키", "review_class": "genuine", "overall_sentiment": "pos"}
    comment, post = ("dcinside", "http://d/1", None, "7", None, None), lambda s: ("instagram", f"https://www.instagram.com/p/{s}/", None, None, None, s)
    rows = [
        base | {"id": 1, "source": "amos", "source_ref": comment, "scent_sentiment": "pos", "scent": "새콤", "shipping_cs_sentiment": "neg"},
        base | {"id": 2, "source": "amos", "source_ref": comment, "product": "빵", "overall_sentiment": "neg", "scent_sentiment": "neg", "shipping_cs_sentiment": "neg"},
        base | {"id": 3, "source": "instagram", "source_ref": post("A"), "scent_sentiment": "pos"},
        base | {"id": 4, "source": "instagram", "source_ref": post("B"), "review_class": "promo", "scent_sentiment": "pos"},
    ]
    return spark.createDataFrame([tuple(r[f.name] for f in schema.REVIEWS.fields) for r in rows], schema.REVIEWS)


@query(stated("scope VARCHAR, criterion VARCHAR, pos BIGINT, neg BIGINT", [
    ("market", "scent", 2, 1), ("market", "cs", 0, 1), ("market", "shipping", 0, 1), ("product", "scent", 2, 0), ("product", "cs", 0, 1), ("product", "shipping", 0, 1)]))
def consolidated_totals(spark, sf):
    """Promoted reviews are apart; a comment on two products counts once for the order."""
    specs, none = spark.createDataFrame([], schema.SPECS), spark.createDataFrame([], schema.SUMMARIES)
    total = lambda name, p: views.consolidated_for(specs, viewed_reviews(spark), none, "연찌", p).stats.where("is_total = 1 and n > 0").select(
        F.lit(name).alias("scope"), "criterion", "pos", "neg"
    )
    return total("market", None).unionByName(total("product", "쿠키"))


@query(stated("platform VARCHAR, n_orders BIGINT, neg BIGINT", [("dcinside", 1, 1), ("instagram", 1, 0)]))
def orders_of_a_market(spark, sf):
    """Each piece is one order."""
    return views.order_view_for(viewed_reviews(spark), "연찌").select("platform", "n_orders", F.coalesce("neg", F.lit(0).cast("long")).alias("neg"))


@query(stated("product VARCHAR, platform VARCHAR, scent VARCHAR, n_reviews BIGINT", [("쿠키", "dcinside", "새콤해요.", 1)]))
def generated_summaries(spark, sf):
    """One call for each product and platform with material, none without."""
    out = views.generate_summaries(viewed_reviews(spark), "연찌", True, lambda p: {"scent": "새콤해요." if "새콤" in p else "?"})
    return out.select("product", "platform", "scent", "n_reviews")


@query(stated("mention VARCHAR, market VARCHAR", [("ㅇㅉ", "연찌"), ("모르는 곳", "모르는 곳"), (" ", None)]))
def resolved_markets(spark, sf):
    """The canonical word of a mention; unknown text stays, blank text is none."""
    rows = [(m, views.resolve_market(knowledge(spark), m)) for m in ("ㅇㅉ", "모르는 곳", " ")]
    return spark.createDataFrame(rows, "mention string, market string")


# --- whole runs

THREADS = [  # anchor, batch, pos, thread, type, comment, ordinal, url, text
    ("쿠키", 1, 0, "600", "post", None, 0, "https://g/?no=600", "쿠키 옛 글 좋음"), ("쿠키", 1, 1, "900", "post", None, 0, "https://g/?no=900", "연찌 글 쿠키 색이 좋음"),
    ("쿠키", 1, 2, "900", "comment", "5", 1, "https://g/?no=900", "쿠키 쫀득하고 좋음"), ("쿠키", 1, 3, "900", "comment", None, 2, "https://g/?no=900", "쿠키 최고로 좋음"),
    ("쿠키", 1, 4, "900", "comment", "6", 3, "https://g/?no=900", "완장 뭐함"), ("쿠키", 1, 5, "950", "post", None, 0, "https://g/?no=950", "boom 빵 좋음"),
    ("쿠키", 1, 6, "960", "post", None, 0, "https://g/?no=960#top", "ㅂㅉ 빵 말랑하고 좋음"), ("빵", 1, 7, "10", "post", None, 0, "https://g/?no=10", "빵 얘기 없이 좋다고 들었"),
]


def thread_run(spark: SparkSession, dry: bool = False) -> ingest.Ingested:
    pieces = spark.createDataFrame([(*r, 0.9) for r in THREADS], "anchor string, batch int, pos int, thread_no string, type string, comment_no string, ordinal int, url string, text string, topic_score double")
    seen = [("amos", "https://g/?no=600", "쿠키", "600"), ("amos", "https://g/?no=900", "쿠키", "900")]
    seen = spark.createDataFrame(seen, "source string, post_id string, anchor string, thread_no string")
    fields = dict.fromkeys(f.name for f in ingest.item_type().fields)

    def extract(block: str) -> list[dict]:
        if "boom" in block:
            raise RuntimeError("down")
        out = []
        for line in block.split("\n"):
            place, text = line[1:].split("] ", 1)
            at = {"place": int(place), "doc_market": "연찌" if "연찌 글" in text else None}
            name = "쿠키" if "쿠키" in text else "ㅂㅉ 빵"
            out += [fields | at | {"mentioned_product": name, "firsthand_evidence": text}, fields | at | {"mentioned_product": name, "firsthand_evidence": text, "summary": "좋아요"}]
        return out

    return ingest.ingest_threads(pieces, seen, knowledge(spark), spec_rows(spark), None if dry else extract, 10)


@query(stated("post_id VARCHAR, market VARCHAR, confidence DOUBLE, provenance VARCHAR, product VARCHAR, evidence VARCHAR, url VARCHAR, comment_no VARCHAR", [
    ("https://g/?no=900:5", "연찌", 0.75, "inherit", "쿠키", "[연찌] / 쿠키 / 총평 좋아요", "https://g/?no=900", "5"),
    ("https://g/?no=960#top", "빈짱", 0.82, "prefix_choseong", "빵", "[빈짱] / 빵 / 총평 좋아요", "https://g/?no=960", None)]))
def thread_ingestion(spark, sf):
    """R21, with G1, F25, W1, J10b, W8, J20, F14, W7, N4, J5 and X12 in one run."""
    rows = thread_run(spark).rows
    return rows.select("post_id", "market", "confidence", "provenance", "product", "evidence", "source_ref.url", "source_ref.comment_no")


COUNTED = [("collected", 8), ("above_mark", 7), ("emitted", 6), ("gate_unprocessed", 0), ("skipped_seen", 1), ("context_posts", 1), ("skipped_no_comment_no", 1), ("calls", 4), ("calls_without_cut", 4)]


@query(stated("counter VARCHAR, n BIGINT", [*COUNTED, ("failed_calls", 1), ("market_inherited", 1)]))
def thread_ingestion_counters(spark, sf):
    """A failing call loses its batch alone and is counted."""
    return thread_run(spark).counters


@query(stated("counter VARCHAR, n BIGINT", COUNTED))
def dry_ingestion_counters(spark, sf):
    """What a run would do, without a call."""
    return thread_run(spark, dry=True).counters


FOUND = [(1, "amos", "연찌", "쿠키", "향이 좋다", "https://g/?no=1#c", [1.0, 0.0], ["향"]), (2, "instagram", "늪지", None, "색", None, [0.9, 0.1], ["색"]),
         (3, "instagram", None, "빵", "쿠키 맛", "https://www.instagram.com/p/B/", [0.0, 1.0], ["쿠키", "맛"])]


@query(stated("asked VARCHAR, answer VARCHAR, citations VARCHAR", [
    ("all", "Q\n\n[1] (source=amos, market=연찌, product=쿠키) 향이 좋다\n[2] (source=instagram, market=None, product=빵) 쿠키 맛", "1 amos https://g/?no=1|2 instagram https://www.instagram.com/p/B/"),
    ("none", "근거가 될 후기를 찾지 못했어요.", "")]))
def grounded_answer(spark, sf):
    """The model's prompt, told back, and the citations; nothing found is said without a call."""
    ref = "struct<platform:string,url:string,thread_no:string,comment_no:string,ordinal:int,shortcode:string>"
    rows = [(*r[:5], ("p", r[5], None, None, None, None), *r[6:]) for r in FOUND]
    df = spark.createDataFrame(rows, f"id int, source string, market string, product string, evidence string, source_ref {ref}, embedding array<float>, tokens array<string>")

    def asked(name: str, filters: dict | None) -> DataFrame:
        found = retrieval.hits(df, retrieval.search(df, [1.0, 0.0], ["쿠키"], filters, k=2))
        shown = F.transform("citations", lambda c: F.concat_ws(" ", c["n"].cast("string"), c["source"], c["url"]))
        return retrieval.answer(found, "Q", lambda p: p).select(F.lit(name).alias("asked"), "answer", joined(shown).alias("citations"))

    return asked("all", None).unionByName(asked("none", {"market": "없음"}))
