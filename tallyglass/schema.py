"""Tables of the review domain (section 1) as Spark types. Times are TIMESTAMP; confidence is DOUBLE with a provenance beside it."""

from __future__ import annotations

from pyspark.sql import types as T


def __getattr__(name: str) -> T.StructType:
    """``SPECS``, ``REVIEWS`` and so on: parsed when first asked for, as that takes a session."""
    if f"_{name}" not in globals():
        raise AttributeError(name)
    found = globals()[name] = T._parse_datatype_string(globals()[f"_{name}"])
    return found


#: Official facts; one row per market and product.
_SPECS = (
    "id long, market string, product string, scent string, base_combo string, slime_type string, official_texture string, "
    "beads array<string>, source_permalink string"
)
_REF = "struct<platform:string,url:string,thread_no:string,comment_no:string,ordinal:int,shortcode:string>"
#: One extracted item; NULL in (source, post_id, product) never conflicts.
_REVIEWS = (
    "id long, source string, post_id string, market string, market_confidence double, market_provenance string, product string, "
    "spec_id long, slime_type string, scent string, perceived_scent string, texture string, sound string, longevity string, shipping_cs string, "
    "scent_sentiment string, texture_sentiment string, sound_sentiment string, longevity_sentiment string, shipping_cs_sentiment string, "
    "overall_sentiment string, summary string, review_class string, evidence string, tokens array<string>, embedding array<float>, "
    f"source_ref {_REF}, created_at timestamp, body string, title string, author string, posted_at timestamp, likes int, views int, "
    "comment_count int, votes_up int, votes_down int"
)
#: Stored summaries; product NULL is the market's own row.
_SUMMARIES = ("market string, product string, cells map<string,string>, model string, n_reviews long, generated_at timestamp")
#: A collected piece before extraction.
_PIECES = (
    "text string, url string, platform string, posted_at string, raw_title string, type string, thread_no string, parent_no string, "
    "comment_no string, ordinal int, nick string, views int, comment_count int, recommend_up int, recommend_down int, owner_username string, "
    "hashtags array<string>, hashtag string, likes int, comments int, shortcode string, toxic boolean, review_class string, promo_marker string"
)
_KNOWLEDGE = (
    "market string, market_word string, handle string, handles_alt array<string>, aliases array<string>, choseong string, "
    "choseong_aliases array<string>, products array<string>, logo string"
)
_BLOCK = "struct<notes:string,sentiment:string,evidence:string>"
#: What an extractor returns for one piece.
_EXTRACTION = (
    f"market string, shipping_cs {_BLOCK}, reviews array<struct<mentioned_product:string,mentioned_market:string,scent:{_BLOCK},"
    f"texture:{_BLOCK},sound:{_BLOCK},longevity:{_BLOCK},stated_rating:double,sentiment:string,rebuy:string,summary:string,"
    "firsthand_evidence:string>>, flags struct<toxic:boolean>"
)
