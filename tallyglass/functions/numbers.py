"""Numbers, dates, identifiers and vectors as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions.text import text_of, trimmed

TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy.MM.dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy.MM.dd HH:mm", "yyyy.MM.dd")


def first_int(x: Column) -> Column:
    """First signed number, commas removed; NULL without one."""
    found = F.replace(F.regexp_extract(text_of(x.cast("string")), r"-?\d[\d,]*", 0), F.lit(","), F.lit(""))
    return found.try_cast("int")


def timestamp_of(x: Column) -> Column:
    """The first format that fits, then ISO; NULL for dates without a year."""
    tries = [F.try_to_timestamp(trimmed(x), F.lit(f)) for f in TIME_FORMATS]
    iso = F.when(trimmed(x).rlike(r"^\d{4}-\d{2}-\d{2}T"), trimmed(x).try_cast("timestamp"))
    return F.coalesce(*tries, iso)


def dc_post_id(url: Column, comment_no: Column) -> Column:
    """Address of a post; address and number of a comment; NULL without an address."""
    return F.when(url.isNotNull() & (comment_no.isNotNull()), F.concat_ws(":", url, comment_no)).otherwise(url)


def thread_no(explicit: Column, parent: Column, url: Column) -> Column:
    """Thread number from the first source that has one."""
    return F.coalesce(explicit, parent, F.nullif(F.regexp_extract(text_of(url), r"[?&]no=(\d+)", 1), F.lit("")))


def source_ref(platform: str, url: Column, thread: Column, comment_no: Column, ordinal: Column, shortcode: Column | None = None) -> Column:
    """Where a piece can be read again, NULL without a usable address. The place in its thread
    (``ordinal``, NULL for posts) stands in only where a comment has no number."""
    forum = platform == "dcinside"
    null = F.lit(None).cast("string")
    fields = {
        "platform": F.lit(platform), "url": clean_url(url), "thread_no": thread_no(thread, null, clean_url(url)) if forum else null,
        "comment_no": comment_no.cast("string") if forum else null,
        "ordinal": F.when(comment_no.isNull(), ordinal.cast("int")) if forum else null.cast("int"),
        "shortcode": null if forum or shortcode is None else shortcode,
    }
    return F.when(clean_url(url).isNotNull(), F.struct(*[v.alias(k) for k, v in fields.items()]))


def permalink(ref: Column) -> Column:
    """The address to show for a ``source_ref``; NULL where there is none."""
    return clean_url(ref["url"])


def rewritten_post_id(post_id: Column, comment_no: Column) -> Column:
    """Ids of the older ``…#cmt<i>`` shape carry the comment's own number instead."""
    old = post_id.rlike(r"#cmt")
    return F.when(old, F.concat(F.substring_index(post_id, "#cmt", 1), F.lit("#cmt:"), comment_no)).otherwise(post_id)


def piece_key(platform: Column, url: Column, piece: Column) -> Column:
    """Identity of a collected piece; NULL without an address, so that it never folds."""
    return F.when(url.isNotNull(), F.struct(platform.alias("platform"), url.alias("url"), piece.alias("piece")))


def clean_url(url: Column) -> Column:
    """trimmed, without fragment; NULL unless http or https with a host."""
    bare = F.substring_index(trimmed(url), "#", 1)
    fine = F.lower(F.try_parse_url(bare, F.lit("PROTOCOL"))).isin("http", "https")
    return F.when(fine & (F.length(F.try_parse_url(bare, F.lit("HOST"))) > 0), bare)


def embed_url(url: Column) -> Column:
    """embed address of an Instagram post, reel or video; NULL for anything else."""
    bare = clean_url(url)
    host = F.lower(F.try_parse_url(bare, F.lit("HOST")))
    code = F.regexp_extract(F.try_parse_url(bare, F.lit("PATH")), r"^/(p|reel|tv)/([A-Za-z0-9_-]+)", 0)
    ours = (host == "instagram.com") | host.endswith(".instagram.com")
    return F.when(ours & (code != ""), F.concat(F.lit("https://www.instagram.com"), code, F.lit("/embed")))


def filled_score(blocks: list[Column], summary: Column, rating: Column) -> Column:
    """Two for each filled block, one each for a summary and a rating other than zero."""
    filled = reduce(lambda a, b: a + b, [F.when(b.isNotNull(), 2).otherwise(0) for b in blocks], F.lit(0))
    return filled + F.when(trimmed(summary) != "", 1).otherwise(0) + F.when(rating != 0, 1).otherwise(0)


def held_fingerprint(item: Column) -> Column:
    """Canonical JSON of an item without its name; NULL fields stay in it."""
    return F.to_json(item, {"ignoreNullFields": "false"})


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, in the order of the elements."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """One minus cosine distance."""
    return dot(a, b) / (norm(a) * norm(b))


def normalised(a: Column) -> Column:
    """V2: scaled to unit length, safe for zero vectors.

    The norm is bound as the one element of an array, so that it is not found again for each dimension.
    """
    scaled = F.transform(F.array(norm(a) + 1e-12), lambda n: F.transform(a, lambda x: x.cast("double") / n))
    return F.get(scaled, F.lit(0))


def probability(weights: list[float], bias: float, x: Column) -> Column:
    """Logistic probability; 0 without weights."""
    if not weights:
        return F.lit(0.0)
    z = dot(F.array(*map(F.lit, weights)), x) + bias
    return 1 / (1 + F.exp(-z))


def call_cost(n_in: Column, n_cached: Column, n_out: Column, p_in: Column, p_cached: Column, p_out: Column) -> Column:
    """Price of a model call per million tokens; unknown prices cost nothing."""
    zero = F.lit(0.0)
    fresh = (n_in - n_cached) * F.coalesce(p_in, zero)
    return (fresh + n_cached * F.coalesce(p_cached, zero) + n_out * F.coalesce(p_out, zero)) / 1e6
