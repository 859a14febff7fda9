"""Text and Hangul functions (X1 to X25) as Column expressions.

``(?U)`` makes Java's ``\\s`` and ``\\d`` cover Unicode, as the rules expect.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions import lexicon as L

SPACE = r"(?U)\s+"
HASHTAG = r"#([0-9A-Za-z_가-힣]+)"


def text_of(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def trimmed(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeezed(x: Column) -> Column:
    """All white space removed, case kept."""
    return F.regexp_replace(text_of(x), SPACE, "")


def surface_key(x: Column) -> Column:
    """The lookup form of a market name: no white space, lower case."""
    return F.lower(squeezed(x))


def tag_key(x: Column) -> Column:
    """No white space, underscores or dots, lower case."""
    return F.lower(F.regexp_replace(text_of(x), r"(?U)[\s_.]+", ""))


def hashtag_key(x: Column) -> Column:
    """``tag_key`` without leading hashes."""
    return tag_key(F.regexp_replace(trimmed(text_of(x)), "^#+", ""))


def alias_key(x: Column) -> Column:
    """Names compared for aliases."""
    return surface_key(x)


def code_point(c: Column) -> Column:
    """Number of a one-character string of the basic plane."""
    return F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")


def choseong(x: Column) -> Column:
    """Initial consonants of syllables; compatibility jamo stay; everything else is dropped."""
    kept = F.regexp_replace(text_of(x), "[^가-힣ㄱ-ㅎ]", "")

    def initial(c: Column) -> Column:
        at = F.floor((code_point(c) - 0xAC00) / 588).cast("int") + 1
        return F.when(c.rlike("^[가-힣]"), F.substr(F.lit(L.CHOSEONG), at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(kept, ""), lambda c: c != ""), initial), "")


def is_all_jamo(x: Column) -> Column:
    return x.rlike(r"(?U)^[ㄱ-ㅎ\s]+$")


def is_choseong_only(x: Column) -> Column:
    """nothing but compatibility jamo."""
    return F.coalesce(x.rlike(r"^[\x{3130}-\x{318F}]+$"), F.lit(False))


def hashtags(x: Column) -> Column:
    """Distinct hashtags in order, without the hash."""
    return F.array_distinct(F.regexp_extract_all(text_of(x), F.lit(HASHTAG), 1))


def product_hashtags(x: Column, excluded: list[str] | Column = ()) -> Column:
    """Hashtags that may name a product: not generic, not a market's own."""
    generic = F.array(*[tag_key(F.lit(t)) for t in L.GENERIC_TAGS])
    own = excluded if isinstance(excluded, Column) else F.array(*[tag_key(F.lit(t)) for t in excluded]).cast("array<string>")
    return F.filter(hashtags(x), lambda t: ~F.array_contains(generic, tag_key(t)) & ~F.array_contains(own, tag_key(t)))


def market_exclusions(market: Column, word: Column, handle: Column, aliases: Column) -> Column:
    """Keys of a market's own tags."""
    alone = F.array(market, word, handle)
    return F.array_distinct(F.transform(F.array_compact(F.concat(alone, aliases)), tag_key))


def clauses(x: Column) -> Column:
    """Clauses, trimmed, empty ones dropped."""
    parts = F.transform(F.split(text_of(x), "(?U)" + L.CLAUSE_END), trimmed)
    return F.filter(parts, lambda c: c != "")


def chunks(x: Column) -> Column:
    """Sentences that are not noise; the whole text if none is left."""
    from tallyglass.functions.rules import is_low_quality

    parts = F.transform(F.split(text_of(x), r"[\n.!?。…·]+"), trimmed)
    good = F.filter(parts, lambda c: (c != "") & ~is_low_quality(c, 3))
    whole = trimmed(text_of(x))
    return F.when(F.size(good) > 0, good).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def strip_chrome(x: Column) -> Column:
    """A post without the site's own furniture."""
    for pattern, new in ((L.NEWS_WIDGET, ""), (L.APP_FOOTER, ""), (L.MENTION, ""), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(text_of(x), pattern, new)
    return trimmed(F.array_join(F.transform(F.split(x, r"\r\n|\n|\r"), trimmed), "\n"))


def clean_post(x: Column) -> Column:
    """X11: ``strip_chrome`` after removing addresses."""
    return strip_chrome(F.regexp_replace(text_of(x), r"https?://\S+", ""))


def sentences(x: Column) -> Column:
    """Sentences after a full stop, exclamation or question mark."""
    parts = F.transform(F.split(trimmed(text_of(x)), r"(?U)(?<=[.!?])\s+"), trimmed)
    return F.filter(parts, lambda s: s != "")


def excerpt(x: Column, limit: int = 150) -> Column:
    """At most ``limit`` characters: up to the last sentence end in the second half, or a space, or cut."""
    flat = trimmed(F.regexp_replace(text_of(x), SPACE, " "))
    head = F.substring(flat, 1, limit)
    stop = F.length(head) - F.length(F.regexp_extract(head, r"(?s)[.!?。…](?=[^.!?。…]*$)(.*)$", 1))
    has_stop = head.rlike("[.!?。…]") & (stop >= limit // 2)
    space = F.length(head) - F.length(F.regexp_extract(head, r" ([^ ]*)$", 1)) - 1
    at = F.when(has_stop, stop).when(head.contains(" ") & (space > 0), space).otherwise(F.lit(limit))
    cut = F.concat(trimmed(F.substr(head, F.lit(1), at)), F.lit("…"))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def render_review(item: Column) -> Column:
    """The labelled parts of a review item as one line; NULL parts are left out."""

    def part(label: str, value: Column) -> Column:
        return F.when(trimmed(value) != "", F.concat(F.lit(label + " "), trimmed(value)))

    words = F.create_map(*[F.lit(x) for pair in (("pos", "긍정"), ("neu", "중립"), ("neg", "부정")) for x in pair])
    return F.concat_ws(
        " / ",
        F.concat(F.lit("["), F.coalesce(item["market"], F.lit("마켓미상")), F.lit("]")),
        item["product"],
        part("향", item["scent"]),
        part("질감", item["texture"]),
        part("소리", item["sound"]),
        part("지속", item["longevity"]),
        part("총평", F.coalesce(item["summary"], item["evidence"])),
        words[item["sentiment"]],
    )


def display_evidence(x: Column) -> Column:
    """without the leading ``[market] /``; NULL if nothing is left."""
    return F.nullif(trimmed(F.regexp_replace(x, r"(?U)^\s*\[[^\]]*\]\s*/\s*", "")), F.lit(""))


def tokens(x: Column) -> Column:
    """The offline stand-in of a morpheme tokenizer: lower-case runs of word characters."""
    return F.filter(F.split(F.lower(text_of(x)), r"(?U)\W+"), lambda t: t != "")


def join_types(x: Column) -> Column:
    """Types joined by commas, NULL for none."""
    return F.nullif(F.array_join(x, ", "), F.lit(""))


def monogram(word: Column) -> Column:
    """First character and one of eight colours from the MD5 of the name."""
    colour = F.pmod(F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(8))
    return F.struct(F.substring(trimmed(word), 1, 1).alias("char"), colour.cast("int").alias("colour"))


def owner_from_url(url: Column) -> Column:
    """Account name of a profile address; NULL for post and explore addresses."""
    name = F.regexp_extract(text_of(url), r"instagram\.com/([A-Za-z0-9_.]+)/?", 1)
    return F.when((name != "") & ~name.isin("p", "reel", "tv", "explore", "stories"), name)


def expand_queries(product: str, aliases: list[str] = (), choseong_form: str | None = None) -> list[str]:
    """Search terms of a product, in order and without repeats."""
    found = [product, *aliases]
    if choseong_form:
        found += [choseong_form + product, choseong_form]
    return list(dict.fromkeys(q for q in found if q))


def anchor(market: Column, product: Column, domain: bool = True, scope: str = "product") -> Column:
    """The sentence that texts are compared with: market, product, and the domain word once."""
    base = F.concat_ws(" ", market, product) if scope == "product" else text_of(market)
    if domain:
        base = F.when((base != "") & ~base.endswith("슬라임"), F.concat(base, F.lit(" 슬라임"))).otherwise(base)
    return trimmed(F.regexp_replace(base, SPACE, " "))


def safe_key(key: str) -> str:
    """A run's key as one path component."""
    kept = "".join(c if c.isalnum() or c in "-_." else "_" for c in (key or "").strip())
    return kept.strip(".") or "_"
