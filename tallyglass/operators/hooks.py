"""Injected functions (H1 to H7): models, embedders and tokenizers, with offline stand-ins.

A hook is called on Arrow batches, and what it returns is to be stored before it is used twice, so
that a paid call is not made again by a recomputation.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions import lexicon as L
from tallyglass.functions.rules import first_marker, offending_sentences, promo_gate, scrubbed
from tallyglass.storage import stored

Verdict = tuple[bool, str | None]


def classify(text: Column, fn: Callable[[str], bool]) -> Column:
    """H1: a boolean classifier over texts; NULL texts are False."""

    @F.pandas_udf(T.BooleanType())
    def call(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(t is not None and fn(t)))

    return call.asNondeterministic()(text)


def promo_verdicts(df: DataFrame, text: str, detector: Callable[[str], Verdict] | None = None) -> DataFrame:
    """Adds is_promo, promo_marker and asked; only suspects of the gate reach the detector.

    A detector that fails on a text falls back to the marker list for it. ``asked`` marks the rows
    that were judged, which is the labelled output.
    """
    marker = first_marker(F.col(text))
    if detector is None:
        return df.withColumns({"is_promo": marker.isNotNull(), "promo_marker": marker, "asked": F.lit(False)})

    @F.pandas_udf("is_promo boolean, marker string, failed boolean")
    def call(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append((*detector(t), False))
            except Exception:  # noqa: BLE001  any failure of an injected model means the fallback
                out.append((None, None, True))
        return pd.DataFrame(out, columns=["is_promo", "marker", "failed"])

    gate = promo_gate(F.col(text))
    asked = df.where(gate).withColumn("_v", call.asNondeterministic()(F.col(text)))
    asked = asked.withColumns(
        {
            "is_promo": F.when(F.col("_v.failed"), marker.isNotNull()).otherwise(F.col("_v.is_promo")),
            "promo_marker": F.when(F.col("_v.failed"), marker).otherwise(F.col("_v.marker")),
            "asked": F.lit(True),
        }
    ).drop("_v")
    rest = df.where(~gate).withColumns({"is_promo": F.lit(False), "promo_marker": F.lit(None).cast("string"), "asked": F.lit(False)})
    return asked.unionByName(rest)


def embed(df: DataFrame, text: str, fn: Callable[[Iterable[str]], list[list[float]]], out: str = "embedding") -> DataFrame:
    """V1, H7: adds a vector per text, a batch at a time."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def call(texts: pd.Series) -> pd.Series:
        return pd.Series(fn([t or "" for t in texts]))

    return df.withColumn(out, call.asNondeterministic()(F.col(text)))


def hashed_embedding(texts: Iterable[str], size: int = 64) -> list[list[float]]:
    """Offline stand-in of an embedder: counts of hashed character pairs."""
    out = []
    for t in texts:
        v = [0.0] * size
        for a, b in zip(t, t[1:]):
            v[hashlib.md5((a + b).encode()).digest()[0] % size] += 1.0
        out.append(v)
    return out


def extract_items(df: DataFrame, id: str, text: str, fn: Callable[[str], list[dict]], schema: str) -> DataFrame:
    """H6: a text to any number of items: (id, pos, item fields); a text without items gives no row."""
    kind = T._parse_datatype_string(f"array<struct<{schema}>>")

    @F.pandas_udf(kind)
    def call(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fn(t) if t else [])

    items = df.select(F.col(id).alias("id"), call.asNondeterministic()(F.col(text)).alias("items"))
    return items.select("id", F.posexplode("items").alias("pos", "item")).select("id", "pos", "item.*")


def sectionize(material: DataFrame, keys: list[str], fn: Callable[[str], dict], fields: list[str]) -> DataFrame:
    """H5: one summary per key from its material (column ``prompt``): each field as a column, and ``n_asked``.

    An answer with offending sentences is asked for once more, with those sentences named; what still
    offends is scrubbed. Both rounds are stored, so no answer is paid for twice, and rows that do
    not offend are not asked again. A NULL prompt is not asked at all.
    """
    schema = ", ".join(f"{f} string" for f in fields)

    @F.pandas_udf(T.StringType())
    def call(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if p is None else json.dumps(fn(p), ensure_ascii=False))

    def asked(df: DataFrame) -> DataFrame:
        return stored(df.withColumn("_p", F.from_json(call.asNondeterministic()(F.col("prompt")), schema)), "answers")

    first = asked(material.select(*keys, "prompt"))
    bad = F.flatten(F.array(*[F.coalesce(offending_sentences(F.col(f"_p.{f}")), F.array().cast("array<string>")) for f in fields]))
    first = first.withColumn("_bad", bad)
    again = first.where(F.size("_bad") > 0)
    why = F.concat("prompt", F.lit("\n\nLeave out sentences such as these:\n- "), F.array_join("_bad", "\n- "))
    second = asked(again.select(*keys, why.alias("prompt")))
    once, twice = F.when(F.col("prompt").isNotNull(), 1).otherwise(0), F.lit(2)
    rows = first.where(F.size("_bad") == 0).select(*keys, "_p", once.alias("n_asked")).unionByName(second.select(*keys, "_p", twice.alias("n_asked")))
    return rows.select(*keys, *[scrubbed(F.col(f"_p.{f}")).alias(f) for f in fields], "n_asked")


def retrying(fn: Callable[[str], str], parse: Callable[[str], dict], tries: int = 2, wait: Callable[[int], None] = lambda n: None) -> Callable[[str], dict]:
    """H4: a completion that is parsed, with one more try on a parse error; other errors go up."""

    def call(prompt: str) -> dict:
        for n in range(tries):
            try:
                return parse(fn(prompt))
            except ValueError:
                if n + 1 == tries:
                    raise
                wait(n)
        raise AssertionError

    return call


def retry_after(headers: dict[str, str], attempt: int, most: float = 60.0) -> float:
    """Seconds to wait: the server's, in seconds or milliseconds, doubled per attempt, at most ``most``."""
    base = 1.0
    for name, scale in (("retry-after-ms", 1000.0), ("retry-after", 1.0)):
        try:
            base = float(headers[name]) / scale
            break
        except (KeyError, ValueError):
            continue
    return min(base * 2**attempt, most)


#: Vocabulary that the stand-in extractor knows.
FEELS = L.FEELS
