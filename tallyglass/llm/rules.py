"""Line-first quality rules, built from SQL functions only.

Each line is judged on its own (punctuation, navigation, boilerplate); failing lines are removed,
and a document that loses too large a part of its characters is rejected.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = "[ \\t\\n\\x0B\\f\\r]+"
#: A document keeps its place if at least this share (percent) of its line characters survives.
MIN_KEPT_PERCENT = 60
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Sentence ends of all scripts in ``langid.FAMILIES``, and full-width ones: danda, double danda, Arabic and Urdu marks.
SENTENCE_ENDS = "[.!?…。।॥۔؟！？．｡]"
#: A line of this many characters need not hold a sentence end: it may be a part of wrapped prose.
WRAPPED_CHARS = 60
#: Lines that hold one of these are site furniture, not prose.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "subscribe to our newsletter", "click here to", "lorem ipsum", "powered by ",
)
#: A line fails on symbols if more than this share (percent) of its characters are ``SYMBOLS``.
SYMBOL_PERCENT = 5
SYMBOLS = "#*$%&|<>"
#: Separators of a menu; a line with this many is navigation.
MENU_MARKS = "|»›·•"
MENU_COUNT = 3
#: Runs of two marks; a line with one to every SHOUT_CHARS characters fails.
SHOUTS = ("!!", "!?", "?!", "??")
SHOUT_CHARS = 40
#: Words of a text whose positions fit beside a hash in one number; longer texts are compared as strings at once.
POSITION_BITS = 20


def _len(x: Column) -> Column:
    return F.length(x)


def _without(x: Column, chars: str) -> Column:
    return F.translate(x, chars, "")


def _pairs(xs: Column, f) -> Column:
    """``f`` of each element and the next; empty for fewer than two elements."""
    n = F.greatest(F.size(xs) - 1, F.lit(0))
    return F.zip_with(F.slice(xs, F.lit(1), n), F.slice(xs, F.lit(2), n), f)


def _any(x: Column, parts) -> Column:
    return reduce(or_, [x.contains(p) for p in parts])


def _marks(text: Column) -> dict[str, Column]:
    """Which kinds of marks a text has at all: what it lacks is not looked for in its lines."""
    return {
        "symbols": _any(text, SYMBOLS),
        "shouts": _any(text, SHOUTS),
        "menu": _any(text, MENU_MARKS),
        "boilerplate": _any(F.lower(text), BOILERPLATE),
    }


def line_fails(line: Column, marks: dict[str, Column] | None = None) -> Column:
    """True for a line that breaks a punctuation, navigation or boilerplate rule.

    * punctuation: none of ``SENTENCE_ENDS`` in a line of fewer than ``WRAPPED_CHARS`` characters (longer
      ones may be wrapped prose); runs of two ``!`` or ``?`` (counted without overlap) more than one to
      ``SHOUT_CHARS`` characters; or symbols beyond ``SYMBOL_PERCENT``;
    * navigation: ``MENU_COUNT`` or more menu marks;
    * boilerplate: one of ``BOILERPLATE`` in any letter case.

    ``marks`` are ``_marks`` of the text that holds the line.
    """
    n, marks = _len(line), marks or _marks(line)
    symbols = F.when(marks["symbols"], n - _len(_without(line, SYMBOLS))).otherwise(0)
    shouts = F.when(marks["shouts"], n - _len(F.regexp_replace(line, "[!?]{2}", "!"))).otherwise(0)
    menu = F.when(marks["menu"], n - _len(_without(line, MENU_MARKS))).otherwise(0)
    return (
        (100 * symbols > SYMBOL_PERCENT * n)
        | (SHOUT_CHARS * shouts > n)
        | ((n < WRAPPED_CHARS) & ~line.rlike(SENTENCE_ENDS))
        | (menu >= MENU_COUNT)
        | (marks["boilerplate"] & _any(F.lower(line), BOILERPLATE))
    )


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    min_kept_percent: int = MIN_KEPT_PERCENT,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    clean: bool = True,
) -> DataFrame:
    """``docs`` with one struct column ``quality_rules``; with ``clean`` the cleaned text ``clean_text`` is inside it.

    Fields: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed,
    kept`` (boolean), ``lines_removed`` (long), ``line_chars, kept_chars`` (long), ``clean_text``.
    Every row comes back once, with all its columns; an input column named ``quality_rules`` is
    replaced. A NULL text counts as empty: no words, base failed, not kept, ``clean_text`` NULL.
    Repeated rows are judged alike; there is no shuffle and no state across rows, so ties do not
    arise. Very long texts are judged whole, in one task each. An empty table gives no rows.

    Repeated words are found by sorting a number for each 3-word window, a hash with the position in its
    last bits; strings are compared only where hashes meet, so the count is exact. Texts of more than
    2 ** POSITION_BITS words are compared as strings throughout.
    """
    t = F.coalesce(F.col(f"_in.{text}"), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"))
    trimmed = F.expr(f"btrim(coalesce(_in.`{text}`, ''), ' \\t\\n\\u000B\\u000C\\r')")
    df = df.select(
        "_in",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP)).alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("lines"),
        (_len(t) - _len(_without(t, SYMBOLS))).alias("n_symbols"),
        F.struct(*[c.alias(k) for k, c in _marks(t).items()]).alias("marks"),
    )
    m = F.greatest(F.size("w") - 2, F.lit(0))
    low = F.lit((1 << POSITION_BITS) - 1).cast("long")

    def window_hash(x: Column, i: Column) -> Column:
        return F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))

    marks = {k: F.col(f"marks.{k}") for k in ("symbols", "shouts", "menu", "boilerplate")}
    df = df.select(
        "*",
        F.transform("lines", lambda x: F.struct(x.alias("line"), line_fails(x, marks).alias("bad"))).alias("judged"),
        F.sort_array(F.transform(F.slice("w", F.lit(1), m), window_hash)).alias("s"),
    )

    def met(x: Column, i: Column) -> Column:
        own = F.shiftright(x, POSITION_BITS)
        near = [F.shiftright(F.get("s", i + k), POSITION_BITS) for k in (-1, 1)]
        return own.eqNullSafe(near[0]) | own.eqNullSafe(near[1])

    some = F.transform(F.filter("s", met), lambda x: x.bitwiseAND(low).cast("int"))
    every = F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0)))
    df = df.withColumn("maybe", F.when(F.size("w") <= 1 << POSITION_BITS, some).otherwise(every))
    window = lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    df = df.withColumn("g", F.sort_array(F.transform("maybe", lambda i: F.struct(window(i).alias("g"), i.alias("i")))))
    same = _pairs(F.col("g"), lambda a, b: a["g"] == b["g"])
    df = df.withColumn("same", same)
    edge = F.array(F.lit(False))
    twice = F.zip_with(F.concat(edge, "same"), F.concat("same", edge), lambda a, b: a | b)
    at = F.zip_with("g", twice, lambda x, d: F.when(d, x["i"]))
    df = df.withColumn("at", F.sort_array(F.filter(at, lambda x: x.isNotNull())))
    steps = _pairs(F.col("at"), lambda a, b: F.least(b - a, F.lit(3)))
    zero = F.lit(0).cast("long")
    repeat = F.when(F.size("at") > 0, 3 + F.aggregate(steps, zero, lambda a, x: a + x)).otherwise(zero)

    def chars(keep_all: bool) -> Column:
        return F.aggregate(
            "judged", zero, lambda a, x: a + F.when(F.lit(keep_all) | ~x["bad"], F.length(x["line"])).otherwise(0)
        )

    good = F.filter("judged", lambda x: ~x["bad"])
    text_left = F.when(F.col(f"_in.{text}").isNotNull(), F.array_join(F.transform(good, lambda x: x["line"]), "\n"))
    df = df.select(
        "_in",
        F.size("w").cast("long").alias("n_words"),
        _len(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        chars(True).alias("line_chars"),
        chars(False).alias("kept_chars"),
        (F.size("judged") - F.size(good)).cast("long").alias("lines_removed"),
        *([text_left.alias("clean_text")] if clean else []),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (100 * F.col("kept_chars") >= min_kept_percent * F.col("line_chars"))
    verdict = F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
        "lines_removed", "line_chars", "kept_chars", *(["clean_text"] if clean else []),
    )
    carried = [F.col(f"_in.`{c}`").alias(c) for c in docs.columns if c != "quality_rules"]
    # a generator keeps a caller's filter on the verdict from being pushed down, which would evaluate all this twice
    return df.select(*carried, F.explode(F.array(verdict)).alias("quality_rules"))
