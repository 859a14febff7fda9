"""Entity linking that abstains (J2 to J8, J13, J25, A15, F15 order of steps).

The knowledge base is a dimension: one row per market. Forms are aggregated once into lookup tables
whose rows say how many markets share a form; an ambiguous form resolves to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import lexicon as L
from tallyglass.functions.rules import is_non_product_word
from tallyglass.functions.text import choseong, hashtags, is_all_jamo, squeezed, surface_key, tag_key, trimmed
from tallyglass.operators.registry import vocabulary_hits

C = L.CONFIDENCE
#: A lookup table of at most this many rows goes to every task; a larger one is joined by its key.
LOOKUP_ROWS = 200_000


def lookup(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast if it has at most ``LOOKUP_ROWS`` rows, which is counted here."""
    return F.broadcast(table) if table.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS else table


def owners(df: DataFrame, key: str | Column, owner: str | Column) -> DataFrame:
    """Key, owner if exactly one distinct owner has it (else NULL), n_owners; NULL owners do not count."""
    k, o = (F.col(x) if isinstance(x, str) else x for x in (key, owner))
    grouped = df.select(k.alias("key"), o.alias("owner")).where("key is not null").groupBy("key")
    found = grouped.agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.count_distinct("owner").alias("n_owners"))
    return found.select("key", F.when(F.col("low") == F.col("high"), F.col("low")).alias("owner"), "n_owners")


def kb_surface(kb: DataFrame) -> DataFrame:
    """Surface form (no white space, lower case) to its markets."""
    forms = F.concat(F.array("market", "market_word", "handle"), F.coalesce("handles_alt", F.array()), F.coalesce("aliases", F.array()))
    rows = kb.select("market_word", F.explode(F.array_compact(forms)).alias("form")).where("form <> ''")
    return owners(rows.withColumn("form", surface_key(F.col("form"))), "form", "market_word")


def kb_choseong(kb: DataFrame) -> DataFrame:
    """Initial consonants to their markets."""
    forms = F.concat(F.array(F.col("choseong"), choseong(F.col("market_word"))), F.coalesce("choseong_aliases", F.array()))
    rows = kb.select("market_word", F.explode(F.array_compact(forms)).alias("form")).where("form <> ''")
    return owners(rows, "form", "market_word")


def kb_lookups(kb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lookup tables, sized once for all mentions of a plan."""
    return lookup(kb_surface(kb)), lookup(kb_choseong(kb))


def resolve(df: DataFrame, mention: Column, kb: DataFrame | tuple[DataFrame, DataFrame], prefix: str) -> DataFrame:
    """Adds ``<prefix>_market``, ``<prefix>_conf``, ``<prefix>_how`` (surface, choseong or NULL).

    A surface hit, even an ambiguous one, keeps the initial consonants from being tried. ``kb`` is the
    knowledge base or its ``kb_lookups``.
    """
    s, c = kb_lookups(kb) if isinstance(kb, DataFrame) else kb
    df = df.withColumn("_s", surface_key(mention)).withColumn("_c", F.nullif(choseong(mention), F.lit("")))
    df = df.join(s.select(F.col("key").alias("_s"), F.col("owner").alias("_so"), F.col("n_owners").alias("_sn")), "_s", "left")
    df = df.join(c.select(F.col("key").alias("_c"), F.col("owner").alias("_co"), F.col("n_owners").alias("_cn")), "_c", "left")
    by_s, by_c = F.col("_sn").isNotNull(), F.col("_cn").isNotNull()
    conf = (
        F.when(by_s, F.when(F.col("_sn") == 1, C["surface"]).otherwise(1 / F.col("_sn")))
        .when(by_c, F.when(F.col("_cn") == 1, C["choseong"]).otherwise(1 / F.col("_cn")))
        .otherwise(0.0)
    )
    return df.withColumns(
        {
            f"{prefix}_market": F.when(by_s, F.col("_so")).when(by_c, F.col("_co")),
            f"{prefix}_conf": conf,
            f"{prefix}_how": F.when(by_s, "surface").when(by_c, "choseong"),
        }
    ).drop("_s", "_c", "_so", "_sn", "_co", "_cn")


def split_prefix(df: DataFrame, name: str, kb: DataFrame | tuple[DataFrame, DataFrame]) -> DataFrame:
    """Adds ``hint`` (the market part), ``hint_how`` and ``rest`` (the product part) of a product name.

    A token is a market if it is a surface form, or jamo only and known as initial consonants; tried
    are the whole name, the part before the first space, and a leading run of jamo.
    """
    kb = kb_lookups(kb) if isinstance(kb, DataFrame) else kb
    t = trimmed(F.col(name))
    head = F.when(t.contains(" "), F.substring_index(t, " ", 1))
    jamo = F.nullif(F.regexp_extract(t, "^[ㄱ-ㅎ]+", 0), F.lit(""))
    tries = {
        "whole": (t, F.lit(None).cast("string")),
        "head": (head, trimmed(F.substr(t, F.length(head) + 1))),
        "jamo": (jamo, trimmed(F.substr(t, F.length(jamo) + 1))),
    }
    for k, (token, _) in tries.items():
        df = resolve(df, token, kb, f"_{k}")
    hint, how, rest = F.lit(None).cast("string"), F.lit(None).cast("string"), F.nullif(t, F.lit(""))
    for k, (token, tail) in reversed(tries.items()):
        is_market = (F.col(f"_{k}_how") == "surface") | ((F.col(f"_{k}_how") == "choseong") & is_all_jamo(token))
        ok = F.coalesce(is_market & (F.lit(k == "whole") | (tail != "")), F.lit(False))
        hint = F.when(ok, token).otherwise(hint)
        how = F.when(ok, F.col(f"_{k}_how")).otherwise(how)
        rest = F.when(ok, tail).otherwise(rest)
    out = df.withColumns({"hint": hint, "hint_how": how, "rest": rest})
    return out.drop(*[f"_{k}_{x}" for k in tries for x in ("market", "conf", "how")])


def product_key(x: Column) -> Column:
    """The lookup form of a product name on both sides of the inversion: no white space, lower case."""
    return surface_key(x)


def inverted(df: DataFrame, product: str, specs: DataFrame, registry: DataFrame | None = None, excluded: list[str] = ()) -> DataFrame:
    """Adds ``inverted_market`` and ``inverted_how`` from the product's only owner.

    ``specs`` and ``registry`` are (key, owner) tables of A15 over ``product_key``; a product known to
    the first, even ambiguously, is not looked up in the second; excluded names, compared by the same
    key, and blank ones resolve to nothing.
    """
    df = df.withColumn("_p", product_key(F.col(product)))
    first = specs.select(F.col("key").alias("_p"), F.col("owner").alias("_o1"), F.lit(True).alias("_k1"))
    df = df.join(first, "_p", "left")
    if registry is not None:
        second = registry.select(F.col("key").alias("_p"), F.col("owner").alias("_o2"))
        df = df.join(second, "_p", "left")
    else:
        df = df.withColumn("_o2", F.lit(None).cast("string"))
    out = F.coalesce(F.col("_p") == "", F.lit(True))
    if excluded:
        out = out | F.col("_p").isin(*[product_key(F.lit(k)) for k in excluded])
    known = F.coalesce("_k1", F.lit(False))
    market = F.when(~out, F.when(known, F.col("_o1")).otherwise(F.col("_o2")))
    how = F.when(market.isNotNull(), F.when(known, "inversion_spec").otherwise("inversion_registry"))
    return df.withColumns({"inverted_market": market, "inverted_how": how}).drop("_p", "_o1", "_k1", "_o2")


def link(
    items: DataFrame, kb: DataFrame, specs: DataFrame | None = None, registry: DataFrame | None = None,
    aliases: DataFrame | None = None, excluded: list[str] = (),
) -> DataFrame:
    """Items (item_market, doc_market, product, any others) with market, confidence, provenance, abstained.

    The product's market prefix is split off before the word gate; then the item's own market, the
    prefix and the document's market are tried in this order; inversion only where none was given.
    ``aliases`` maps (alias key, canonical) product names; off by default.
    """
    forms = kb_lookups(kb)
    df = split_prefix(items, "product", forms)
    if aliases is not None:
        table = aliases.select(F.col("alias").alias("_a"), F.col("canonical").alias("_canonical"))
        df = df.withColumn("_a", squeezed(F.col("rest"))).join(table, "_a", "left")
        df = df.withColumn("rest", F.coalesce("_canonical", "rest")).drop("_a", "_canonical")
    df = df.withColumn("product", F.when(~is_non_product_word(F.col("rest")), F.col("rest"))).drop("rest")
    blank = lambda c: F.nullif(trimmed(F.col(c)), F.lit(""))
    item, hint, doc = blank("item_market"), F.col("hint"), blank("doc_market")
    df = df.withColumn("_surface", F.coalesce(item, hint, doc))
    from_hint = item.isNull() & hint.isNotNull()
    from_doc = item.isNull() & hint.isNull() & doc.isNotNull()
    df = resolve(df.withColumns({"_from_hint": from_hint, "_from_doc": from_doc}), F.col("_surface"), forms, "_m")
    how = F.concat(F.when(F.col("_from_hint"), "prefix_").otherwise(""), F.col("_m_how"))
    how = F.when(F.col("_from_doc"), "inherit").otherwise(how)
    ladder = F.create_map(*[F.lit(x) for k in C for x in (k, C[k])])
    hit = F.col("_m_market").isNotNull()
    conf = F.when(hit, F.coalesce(ladder[how], F.col("_m_conf"))).otherwise(F.col("_m_conf"))
    accepted = hit & (conf >= L.LINK_THRESHOLD)
    df = df.withColumns({"market": F.when(accepted, F.col("_m_market")), "confidence": conf,
                         "provenance": F.when(accepted, how)})
    if specs is not None:
        df = inverted(df, "product", specs, registry, list(excluded))
        use = F.col("_surface").isNull() & F.col("product").isNotNull() & F.col("inverted_market").isNotNull()
        df = df.withColumns(
            {
                "market": F.when(use, F.col("inverted_market")).otherwise(F.col("market")),
                "confidence": F.when(use, ladder[F.col("inverted_how")]).otherwise(F.col("confidence")),
                "provenance": F.when(use, F.col("inverted_how")).otherwise(F.col("provenance")),
            }
        ).drop("inverted_market", "inverted_how")
    df = df.withColumn("confidence", F.round("confidence", 3)).withColumn("abstained", F.col("market").isNull())
    return df.drop("hint", "hint_how", "_surface", "_from_hint", "_from_doc", "_m_market", "_m_conf", "_m_how")


def exact_market(df: DataFrame, word: str, kb: DataFrame) -> DataFrame:
    """The knowledge base row of a canonical market word, without inference.

    Where words are equal without white space, the row of the least word counts, and of equal words the
    least by its other columns.
    """
    order = F.struct("market_word", *[F.to_json(F.struct(F.col(c))) for c in kb.columns if c != "market_word"])
    rows = kb.select(squeezed(F.col("market_word")).alias("_w"), order.alias("_o"), F.struct(*kb.columns).alias("_row"))
    dim = rows.groupBy("_w").agg(F.min_by("_row", "_o").alias("_row"))
    dim = dim.select("_w", *[F.col(f"_row.{c}").alias(f"kb_{c}") for c in kb.columns])
    return df.withColumn("_w", squeezed(F.col(word))).join(dim, "_w", "left").drop("_w")


def partition_sellers(posts: DataFrame, kb: DataFrame, owner: str, is_promo: Column | None = None) -> DataFrame:
    """Adds seller_market, and review_class (seller before promo before genuine)."""
    handles = kb.select("market_word", F.explode(F.array_compact(F.concat(F.array("handle"), F.coalesce("handles_alt", F.array())))).alias("_h"))
    dim = handles.groupBy(F.lower(F.trim("_h")).alias("_h")).agg(F.min("market_word").alias("seller_market"))
    out = posts.withColumn("_h", F.lower(F.trim(owner))).join(dim, "_h", "left").drop("_h")
    promo = F.lit(False) if is_promo is None else F.coalesce(is_promo, F.lit(False))
    kind = F.when(F.col("seller_market").isNotNull(), "seller").when(promo, "promo").otherwise("genuine")
    return out.withColumn("review_class", kind)


def caption_market(posts: DataFrame, kb: DataFrame, id: str, caption: str) -> DataFrame:
    """(id, caption_market) where the caption's hashtags name exactly one market with certainty."""
    tags = posts.select(F.col(id).alias("id"), F.explode(hashtags(F.col(caption))).alias("tag"))
    hit = resolve(tags, F.col("tag"), kb, "m").where((F.col("m_conf") >= C["choseong"]) & F.col("m_market").isNotNull())
    return owners(hit, "id", "m_market").where("owner is not null").select(F.col("key").alias("id"), F.col("owner").alias("caption_market"))


def markets_in_text(texts: DataFrame, kb: DataFrame, id: str, text: str) -> DataFrame:
    """(id, market) for every market named in a text: a surface form of two characters or more, or a jamo run."""
    forms = kb_surface(kb).where("owner is not null and length(key) >= 2").select(F.col("owner").alias("canonical"), F.col("key").alias("form"))
    src = texts.select(F.col(id).alias("id"), F.col(text).alias("text"))
    direct = vocabulary_hits(src.withColumn("text", surface_key(F.col("text"))), forms, "id", "text").withColumnRenamed("canonical", "market")
    runs = src.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[ㄱ-ㅎ]+"), 0))).alias("run"))
    jamo = runs.join(kb_choseong(kb).where("owner is not null"), F.col("run") == F.col("key")).select("id", F.col("owner").alias("market"))
    return direct.unionByName(jamo).distinct()


def resolved_product_name(name: Column, tags: Column, claimed: Column, excluded: Column, layer1: Column, registry: Column) -> Column:
    """Struct (product, decision) for a name and the product hashtags of its post; NULL product is on hold."""
    has = lambda xs, x: F.exists(xs, lambda y: tag_key(y) == tag_key(x))
    free = F.filter(tags, lambda t: ~has(claimed, t))
    in_l1, in_reg = F.filter(free, lambda t: has(layer1, t)), F.filter(free, lambda t: has(registry, t))
    null = F.lit(None).cast("string")

    def decide(product: Column, why: str) -> Column:
        return F.struct(product.alias("product"), F.lit(why).alias("decision"))

    return (
        F.when(F.size(tags) == 0, decide(name, "no_tags"))
        .when(has(tags, name), decide(name, "keep"))
        .when((F.size(free) == 0) & has(excluded, name), decide(null, "hold_excluded_name"))
        .when(F.size(free) == 0, decide(name, "keep_distinct"))
        .when(F.size(free) == 1, decide(F.get(free, F.lit(0)), "sole_tag"))
        .when(F.size(in_l1) == 1, decide(F.get(in_l1, F.lit(0)), "l1_tiebreak"))
        .when((F.size(in_l1) == 0) & (F.size(in_reg) == 1), decide(F.get(in_reg, F.lit(0)), "registry_tiebreak"))
        .when(F.size(in_l1) == 0, decide(null, "hold_no_l1_match"))
        .otherwise(decide(null, "hold_ambiguous"))
    )
