"""Filters and predicates of the review domain (F2 to F27) as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions import lexicon as L
from tallyglass.functions.text import clauses, is_all_jamo, sentences, squeezed, tag_key, text_of, trimmed


def found(x: Column, patterns: list[str]) -> Column:
    return text_of(x).rlike("(?U)" + L.any_of(patterns))


def metafilter(filters: Mapping[str, object]) -> Column:
    """conjunction of equalities on known columns; NULL matches nothing; unknown columns raise."""
    unknown = set(filters) - set(L.FILTERS)
    if unknown:
        raise ValueError(f"not a filter column: {sorted(unknown)}")
    return reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in filters.items()], F.lit(True))


def is_low_quality(x: Column, min_len: int = 8) -> Column:
    """too short, or nothing but noise."""
    t = trimmed(text_of(x))
    return (F.length(t) < min_len) | t.rlike("(?U)" + L.NOISE)


def has_any(x: Column, words: list[str]) -> Column:
    """one of the words is part of the lower-case text; never true for a blank one."""
    t = F.lower(text_of(x))
    if not words:
        return F.lit(False)
    return (trimmed(t) != "") & F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, F.lower(w)))


def first_marker(x: Column, words: list[str] = L.PROMO_MARKERS) -> Column:
    """the first word in list order that the lower-case text holds, else NULL."""
    t = F.lower(text_of(x))
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(t, F.lower(w))), F.lit(0))


def promo_gate(x: Column, words: list[str] = L.PROMO_GATE) -> Column:
    """wide gate in front of a model's verdict."""
    return has_any(x, words)


def is_meta(x: Column) -> Column:
    return found(x, L.META)


def is_question(x: Column) -> Column:
    return found(x, L.QUESTION)


def is_hearsay(x: Column) -> Column:
    """somebody else's experience, or none."""
    return found(x, L.HEARSAY) | found(x, L.UNUSED) | found(x, L.NONUSE_SOURCE)


def firsthand_clauses(x: Column) -> Column:
    """clauses with an evaluation and without hearsay; none if the text says that it was not used."""
    own = F.filter(clauses(x), lambda c: found(c, L.EVALUATION) & ~is_hearsay(c))
    return F.when(found(x, L.NONUSE_SOURCE), F.array().cast("array<string>")).otherwise(own)


def has_firsthand(x: Column) -> Column:
    return F.size(firsthand_clauses(x)) > 0


def is_negative(x: Column) -> Column:
    return found(x, L.NEGATIVE)


def is_purchase_intent(x: Column) -> Column:
    return found(x, L.PURCHASE_INTENT)


def axes(x: Column) -> Column:
    """the three axes, not exclusive, as 0 or 1."""
    return F.struct(
        is_meta(x).cast("int").alias("M"), is_question(x).cast("int").alias("Q"), has_firsthand(x).cast("int").alias("E")
    )


def keeps_evidence(evidence: Column, source: Column, product: Column) -> Column:
    """evidence of an extracted item that stands: not blank, part of the source, not hearsay, not a plan
    to buy, and more than the product's name."""
    bare, src = squeezed(evidence), squeezed(source)
    quoted = (src == "") | F.contains(src, bare)
    beyond = F.length(F.replace(bare, squeezed(product), F.lit("")))
    named = squeezed(product) != ""
    return (
        (bare != "") & quoted & ~is_hearsay(evidence) & ~is_purchase_intent(evidence) & (~named | (beyond >= 1))
    )


def is_non_product_word(x: Column) -> Column:
    """a type, a material, a name not remembered, or jamo only."""
    core = squeezed(x)
    words = [squeezed(F.lit(t)) for t in L.TYPES] + [F.lit(g) for g in L.GLUE_WORDS]
    marked = F.exists(F.array(*map(F.lit, L.FRAGMENT_MARKERS)), lambda m: F.contains(core, m))
    return (core != "") & (core.isin(*words) | marked | is_all_jamo(text_of(x)))


def once(x: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(x)`` with ``x`` evaluated once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def label_core(x: Column) -> Column:
    """The body of a sale label: without trailing counts (three times at most), one deictic, leading digits."""
    s = squeezed(x)
    for _ in range(3):
        s = once(s, lambda v: once(F.regexp_replace(v, "(?U)" + L.LABEL_TAIL, ""), lambda cut: F.when(cut != "", cut).otherwise(v)))
    deictic = "^(?:" + L.any_of(L.LABEL_DEICTICS) + ")(?=.)"
    s = F.regexp_replace(s, deictic, "")
    return F.regexp_replace(s, r"^\d+\s*(?=.)", "")


def is_non_product_label(x: Column, known: Column) -> Column:
    """F16: a form of sale rather than a product; ``known`` is the array of a few known product names' keys."""
    return is_sale_label(x, F.array_contains(known, tag_key(squeezed(x))), F.size(known) > 0)


def is_sale_label(x: Column, known: Column, any_known: Column) -> Column:
    """F16: a form of sale rather than a product; ``known`` says whether the name's key is that of a known
    product, ``any_known`` whether there are known products at all."""
    missing = ~known

    def judge(core: Column) -> Column:
        is_label = core.isin(*L.SALE_LABELS, *L.SALE_LABELS_EXACT)
        ends = core.rlike("(?:" + L.any_of(L.SALE_LABELS) + ")$")
        return (
            F.when(core == "", False)
            .when(is_label & (squeezed(x) == core), True)
            .when(is_label, missing)
            .when(~ends | ~any_known, False)
            .otherwise(missing)
        )

    return once(label_core(x), judge)


def offends(sentence: Column) -> Column:
    """a sentence about absence or about the display."""
    return sentence.rlike("(?U)" + L.ABSENCE) | sentence.rlike("(?U)" + L.SUMMARY_META)


def offending_sentences(x: Column) -> Column:
    """the sentences that ``scrubbed`` takes out, in order."""
    return F.filter(sentences(x), offends)


def scrubbed(x: Column) -> Column:
    """a summary cell without offending sentences, NULL if none is left."""
    return F.nullif(F.array_join(F.filter(sentences(x), lambda s: ~offends(s)), " "), F.lit(""))


def scrubbed_cell(verdict: Column, minority: Column) -> Column:
    """both slots scrubbed; the minority moves up if the verdict is empty."""
    v, m = scrubbed(verdict), scrubbed(minority)
    return F.struct(F.coalesce(v, m).alias("verdict"), F.when(v.isNotNull(), m).alias("minority"))


def above_watermark(no: Column, watermark: Column) -> Column:
    """above the mark; without a number or a mark it passes."""
    return F.coalesce(no > watermark, F.lit(True))


def is_product_post(scent: Column, base: Column, kind: Column, texture: Column, name: Column, tags: Column) -> Column:
    """a seller's post describes a product: one official attribute, and the name among the hashtags."""
    filled = reduce(lambda a, b: a | b, [F.coalesce(trimmed(c) != "", F.lit(False)) for c in (scent, base, kind, texture)])
    return filled & F.exists(tags, lambda t: tag_key(t) == tag_key(name))
