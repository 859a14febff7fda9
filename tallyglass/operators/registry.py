"""Product registry, name statistics and alias candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.functions import lexicon as L
from tallyglass.functions.text import alias_key, squeezed, tag_key

#: Characters of a text whose places one row holds.
WINDOW = 512
#: Longest gram that forms are looked up by.
GRAM = 16
#: Parts of a tag's posts that look for their first links on their own.
PARTS = 64


def product_registry(posts: DataFrame, market: str, tags: str, seen_at: str, link: str) -> DataFrame:
    """Per market and tag: n_posts, n_total (posts of the market), first_seen, last_seen, permalinks
    (three smallest by time), class.

    A tag counts once per post. A type word is ``type``; a tag on many and most posts is the market's
    own; the rest are products. Coverage is n_posts / n_total, left as two numbers. Posts of a tag are
    ordered in ``PARTS`` parts, so that a tag on most posts is no single task's.
    """
    src = posts.select(F.col(market).alias("market"), F.array_distinct(tags).alias("tags"), F.col(seen_at).alias("at"), F.col(link).alias("link"))
    totals = src.groupBy("market").agg(F.count("*").alias("n_total"))
    rows = src.withColumn("tag", F.explode("tags"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("at", "link"), F.lit(PARTS)))
    order = Window.partitionBy("market", "tag", "_part").orderBy("at", "link")
    top = F.when(F.row_number().over(order) <= 3, F.struct("at", "link"))
    parts = rows.withColumn("_top", top).groupBy("market", "tag", "_part").agg(
        F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.collect_list("_top").alias("tops")
    )
    tops = F.slice(F.sort_array(F.flatten(F.collect_list("tops"))), 1, 3)
    stats = parts.groupBy("market", "tag").agg(
        F.sum("n").alias("n_posts"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
        F.transform(tops, lambda x: x["link"]).alias("permalinks"),
    )
    n, share = L.REGISTRY_MARKET_TAG
    types = [squeezed(F.lit(t)) for t in L.TYPES]
    kind = (
        F.when(tag_key(F.col("tag")).isin(*types), "type")
        .when((F.col("n_total") >= n) & (F.col("n_posts") >= share * F.col("n_total")), "market_tag")
        .otherwise("product")
    )
    return stats.join(totals, "market").withColumn("class", kind)


def registry_products(registry: DataFrame) -> DataFrame:
    """Product rows only, most frequent first."""
    return registry.where(F.col("class") == "product").orderBy("market", F.desc("n_posts"), "tag")


def name_stats(reviews: DataFrame, product: str = "product", market: str = "market") -> DataFrame:
    """Per product name: n_reviews and its distinct markets in order."""
    out = reviews.where(F.col(product).isNotNull()).groupBy(F.col(product).alias("product"))
    return out.agg(F.count("*").alias("n_reviews"), F.sort_array(F.collect_set(market)).alias("markets"))


def known_names(*tables: tuple[DataFrame, str]) -> DataFrame:
    """Distinct names of all tables."""
    parts = [df.select(F.col(c).alias("name")).where("name is not null") for df, c in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _named(names: DataFrame, name: str) -> DataFrame:
    return names.select(F.col(name).alias("name"), alias_key(F.col(name)).alias("norm")).where("norm <> ''").distinct()


def prefix_pairs(names: DataFrame, name: str = "name") -> DataFrame:
    """(a, b) where a's form is a proper prefix of b's.

    An equality on form and length instead of a comparison of all pairs: every b offers its proper
    prefixes, as many rows as it has characters.
    """
    n = _named(names, name)
    b = n.where("length(norm) > 1").select(
        F.col("name").alias("b"), F.explode(F.transform(F.sequence(F.lit(1), F.length("norm") - 1), lambda k: F.substr(F.col("norm"), F.lit(1), k))).alias("norm")
    )
    return n.select(F.col("name").alias("a"), "norm").join(b, "norm").select("a", "b")


def edit1_pairs(names: DataFrame, name: str = "name") -> DataFrame:
    """(a, b) whose forms have edit distance 1 and the same first character; shorter, then smaller, first.

    Blocked by deletion forms: two strings at distance 1 share a form with at most one character
    deleted, so the join is an equality whose rows grow with the length of a name.
    """
    n = _named(names, name)
    cuts = F.transform(
        F.sequence(F.lit(1), F.length("norm")),
        lambda k: F.concat(F.substr(F.col("norm"), F.lit(1), k - 1), F.substr(F.col("norm"), k + 1)),
    )
    forms = n.select("name", "norm", F.explode(F.array_distinct(F.concat(F.array("norm"), cuts))).alias("form"))
    left = forms.select(F.col("name").alias("a"), F.col("norm").alias("na"), "form", F.substring("norm", 1, 1).alias("first"))
    right = forms.select(F.col("name").alias("b"), F.col("norm").alias("nb"), "form", F.substring("norm", 1, 1).alias("first"))
    before = (F.length("na") < F.length("nb")) | ((F.length("na") == F.length("nb")) & (F.col("a") < F.col("b")))
    close = (F.col("na") != F.col("nb")) & (F.levenshtein("na", "nb", 1) == 1)
    return left.join(right, ["form", "first"]).where(before & close).select("a", "b").distinct()


def registry_aliases(registry: DataFrame, reviews: DataFrame) -> DataFrame:
    """Registry names of exactly one market that reviews use: name, market, n_reviews."""
    from tallyglass.operators.linking import owners

    own = owners(registry, "tag", "market").where("owner is not null").select(F.col("key").alias("product"), F.col("owner").alias("market"))
    return own.join(reviews.groupBy("product").agg(F.count("*").alias("n_reviews")), "product")


def alias_candidates(names: DataFrame, stats: DataFrame) -> DataFrame:
    """Prefix and edit-1 pairs with the review counts and markets of both names, in a fixed order."""
    pairs = prefix_pairs(names).withColumn("kind", F.lit("prefix")).unionByName(edit1_pairs(names).withColumn("kind", F.lit("edit1")))
    for side in ("a", "b"):
        own = stats.select(F.col("product").alias(side), F.col("n_reviews").alias(f"n_{side}"), F.col("markets").alias(f"markets_{side}"))
        pairs = pairs.join(own, side, "left")
    return pairs.fillna(0, ["n_a", "n_b"]).orderBy("kind", "a", "b")


def containment_pairs(rows: DataFrame, piece: str, name: str) -> DataFrame:
    """Names inside longer names of the same piece: inner, outer, n_pieces.

    An equality instead of a comparison of all pairs of a piece: every name offers its parts of those
    lengths that names have, one row at a time. An empty name is inside every other.
    """
    n = rows.select(F.col(piece).alias("piece"), F.col(name).alias("name")).where("name is not null").distinct()
    lengths = n.agg(F.collect_set(F.length("name")).alias("lengths"))  # one row, at most as long as the longest name
    sized = n.crossJoin(F.broadcast(lengths)).withColumn("k", F.explode("lengths")).where("k < length(name)")
    last = F.when(F.col("k") > 0, F.length("name") - F.col("k") + 1).otherwise(1)
    parts = sized.withColumn("at", F.explode(F.sequence(F.lit(1), last)))
    parts = parts.select("piece", F.col("name").alias("outer"), F.substr(F.col("name"), F.col("at"), F.col("k")).alias("inner"))
    inside = n.withColumnRenamed("name", "inner").join(parts, ["piece", "inner"]).select("piece", "inner", "outer").distinct()
    return inside.groupBy("inner", "outer").agg(F.count("*").alias("n_pieces"))


def vocabulary_hits(texts: DataFrame, vocabulary: DataFrame, id: str, text: str, window: int = WINDOW) -> DataFrame:
    """(id, canonical) for every vocabulary form that a text contains; NULL and empty forms and NULL texts have none.

    Equalities only, and nothing goes through the driver but the few gram lengths. A form of 2q - 1 characters
    or more holds, wherever it lies, a whole gram of q characters at a multiple of q of the text. So each form offers
    its first q grams of the largest q (a power of two up to ``GRAM``), a text is looked up only at multiples
    of q, and where a gram is known the piece around it is looked up among the forms by its hash and compared.
    Texts are read in overlapping windows (``window``: a multiple of ``GRAM``), so a long one is not searched from its
    start at each place. Grams and forms are broadcast up to ``LOOKUP_ROWS``, which are counted.
    """
    from tallyglass.operators.linking import lookup

    src = texts.select(F.col(id).alias("id"), F.col(text).alias("text")).where("text <> ''")
    forms = vocabulary.select("canonical", "form").where("form <> ''").distinct().withColumn("n", F.length("form"))
    q = F.least(F.pow(F.lit(2), F.floor(F.log2((F.col("n") + 1) / 2))).cast("int"), F.lit(GRAM))
    forms = forms.withColumn("q", q)
    # one row a gram length, with the longest form of each
    sizes = sorted((r["q"], r["most"]) for r in forms.groupBy("q").agg(F.max("n").alias("most")).collect())
    if not sizes:
        return src.select("id").join(forms.select("canonical"), F.lit(False))
    grams = forms.select("form", "q", "n", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("o"))
    grams = grams.select("q", F.substr("form", F.col("o") + 1, F.col("q")).alias("gram"), F.struct("o", "n").alias("lies")).distinct()
    grams = grams.groupBy("q", "gram").agg(F.collect_list("lies").alias("lies"))

    most, lead = max(m for _, m in sizes), GRAM - 1
    begin = lambda k: F.greatest(k * window - lead, F.lit(0))  # noqa: E731  a form may begin before the window
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("text") - 1) / window).cast("int")),
        lambda k: F.struct(F.substr("text", begin(k) + 1, F.lit(window + lead + most)).alias("w"), (k * window - begin(k) + 1).alias("first")),
    )
    rows = src.select("id", F.explode(cut).alias("c")).select("id", "c.*", F.explode(F.array(*[F.lit(n) for n, _ in sizes])).alias("q"))
    last = F.least(F.col("first") + window - 1, F.length("w") - F.col("q") + 1)
    rows = rows.where(last >= F.col("first")).select("id", "w", "q", F.explode(F.sequence("first", last, "q")).alias("at"))
    rows = rows.withColumn("gram", F.substr("w", F.col("at"), F.col("q")))
    found = rows.join(lookup(grams), ["q", "gram"]).select("id", "w", "at", F.explode("lies").alias("l"))
    start, n = F.col("at") - F.col("l.o"), F.col("l.n")
    found = found.where((start >= 1) & (start + n - 1 <= F.length("w"))).select("id", F.substr("w", start, n).alias("form"))
    known = lookup(forms.select("canonical", "form", F.xxhash64("form").alias("_h")))
    return found.withColumn("_h", F.xxhash64("form")).join(known, ["_h", "form"]).select("id", "canonical").distinct()


def capped_vocabulary(names: DataFrame, key: str, name: str, cap: int = L.VOCABULARY_CAP) -> DataFrame:
    """The first ``cap`` names of each key, and how many there are besides."""
    order = Window.partitionBy(key).orderBy(name)
    rows = names.withColumn("_r", F.row_number().over(order))
    listed = F.sort_array(F.collect_list(F.when(F.col("_r") <= cap, F.col(name))))
    return rows.groupBy(key).agg(listed.alias("names"), F.greatest(F.count("*") - cap, F.lit(0)).alias("n_more"))
