"""Hierarchical language identification.

First the language family: that whose languages explain the text's n-grams best. Then one-versus-one
linear support vector machines between the languages of that family. Features are hashed character
n-grams of the whole text, case-folded over ASCII, with all ASCII non-letters read as spaces.

The machines of a family are fitted in one task, families side by side, so the cost grows with the
number of families and not with its square; a fitted language takes 64 kB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.llm.common import fold, map_batches

UNKNOWN = "und"
BITS = 13
#: The classifier is fitted on at most this many labelled rows of each language; there is no limit on languages.
TRAIN_PER_LANG = 300
#: A text is in none of the learned languages if its language explains it worse than the median training row by more
#: than FLOOR_SPREADS times what that row is ahead of the FLOOR_QUANTILE; not judged with fewer rows than FLOOR_ROWS.
FLOOR_QUANTILE, FLOOR_SPREADS, FLOOR_ROWS, UNSEEN = 0.02, 3.0, 20, 1e-6
#: Scale of the family's lead, in mean log share of an n-gram, in its probability.
FAMILY_SCALE = 10.0
#: Families of common languages; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_LETTER = re.compile(r"[^\W\d_]")
#: The same for Spark: rows without a letter teach nothing.
LETTER = r"\p{L}"


def has_letter(text: str | None) -> bool:
    """Whether the text has a character of a letter category, as ``LETTER`` says; number characters such as ½ or Ⅷ are none."""
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    """Unit vector of hashed 2-, 3- and 4-gram counts of the whole text."""
    raw = b" ".join(text.encode().translate(_LETTERS).split())
    b = np.frombuffer(b" " + raw + b" ", dtype=np.uint8).astype(np.uint32)
    out = np.zeros(1 << BITS, dtype=np.float32)
    gram = b
    for n in (2, 3, 4):
        if len(b) < n:
            break
        gram = gram[:-1] * np.uint32(0x9E3779B1) + b[n - 1 :] * np.uint32(0x85EBCA77) + np.uint32(n)
        out += np.bincount(gram >> np.uint32(32 - BITS), minlength=1 << BITS)
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights and bias (last) of a linear SVM by dual coordinate descent; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w, a = np.zeros(x.shape[1], dtype=np.float32), np.zeros(len(x))
    norm = (x * x).sum(axis=1)
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            grad = y[i] * float((w * x[i]).sum()) - 1
            new = min(max(a[i] - grad / norm[i], 0), cost)
            if new != a[i]:
                w += np.float32((new - a[i]) * y[i]) * x[i]
                a[i] = new
    return w


@dataclass
class Hierarchy:
    """Log n-gram shares of each language, and the machines between the languages of each family."""

    families: dict[str, list[str]]
    between: dict[tuple[str, str], np.ndarray]
    #: Of each language: log shares of the n-grams, and the least mean of them that a text needs.
    profiles: dict[str, tuple[np.ndarray, float]] = field(default_factory=dict)

    def __post_init__(self):
        self._langs = sorted(self.profiles)
        self._shares = np.stack([self.profiles[k][0] for k in self._langs]) if self._langs else None
        self._family = {lang: family for family, own in self.families.items() for lang in own}

    def _family_of(self, x: np.ndarray) -> tuple[str, float]:
        """The family with the language that explains ``x`` best, and the probability from its lead."""
        explained = (self._shares * (x / x.sum())).sum(axis=1)
        best: dict[str, float] = {}
        for lang, e in zip(self._langs, explained.tolist()):
            family = self._family[lang]
            best[family] = max(e, best.get(family, e))
        first = max(best, key=lambda f: (best[f], f))
        lead = best[first] - max((e for f, e in best.items() if f != first), default=-np.inf)
        return first, float(1 / (1 + np.exp(-min(FAMILY_SCALE * lead, 35.0))))

    def _choose(self, names: list[str], x: np.ndarray) -> tuple[str, float]:
        """The name with the most one-versus-one wins (margins break ties) and its weakest probability."""
        if len(names) == 1:
            return names[0], 1.0
        wins, margin = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        sure: dict[str, float] = dict.fromkeys(names, 1.0)
        for a, b in combinations(names, 2):
            w = self.between[a, b]
            m = float((w[:-1] * x).sum() + w[-1])
            wins[a if m >= 0 else b] += 1
            margin[a], margin[b] = margin[a] + m, margin[b] - m
            p = 1 / (1 + np.exp(-4 * m))
            sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
        best = max(names, key=lambda n: (wins[n], margin[n], n))
        return best, float(sure[best])

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language and score as of ``predict``, and whether that language explains the text as its own."""
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0, False
        x = features(text)
        if not x.any():  # a single letter that is no n-gram, such as a wide digit
            return UNKNOWN, 0.0, False
        family, p = self._family_of(x)
        lang, q = self._choose(self.families[family], x)
        shares, floor = self.profiles[lang]
        return lang, p * q, bool((x * shares).sum() >= floor * x.sum())


def profile(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Log n-gram shares of a language's rows, and the floor: each half of the rows is explained by the other."""
    shares = x / x.sum(axis=1, keepdims=True)
    own = np.log(shares.mean(axis=0) + UNSEEN)
    if len(x) < FLOOR_ROWS:
        return own, -np.inf
    halves = shares[0::2], shares[1::2]
    means = np.concatenate([(a * np.log(b.mean(axis=0) + UNSEEN)).sum(axis=1) for a, b in (halves, halves[::-1])])
    middle = float(np.median(means))
    return own, middle - FLOOR_SPREADS * (middle - float(np.quantile(means, FLOOR_QUANTILE)))


def train_family(langs: np.ndarray, x: np.ndarray) -> tuple[dict[str, tuple[np.ndarray, float]], dict[tuple[str, str], np.ndarray]]:
    """Profiles of the languages of one family and the machines between them."""
    names = sorted(set(langs.tolist()))
    between = {}
    for a, b in combinations(names, 2):
        at = (langs == a) | (langs == b)
        between[a, b] = train_svm(x[at], np.where(langs[at] == a, 1.0, -1.0))
    return {lang: profile(x[langs == lang]) for lang in names}, between


def fit(docs: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Hierarchy:
    """Learn every language of the rows where ``usable`` holds and lang is not NULL.

    Of each language the TRAIN_PER_LANG rows of the smallest hashes of id and text are taken, or all
    it has. Features are computed where the rows are; those of a family meet in one task. To the
    driver go the fitted languages and pairs, whose number depends on the languages alone.
    """
    hashed = F.xxhash64(F.col(doc_id), F.col(text), F.lit(11))
    known = docs.where(usable & F.col(lang).isNotNull() & F.col(text).rlike(LETTER)).select(
        hashed.alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    scale = 1 << 30
    # half as many again as are wanted, so that a language is not short of rows by chance
    part = F.ceil(F.lit(1.5 * scale * TRAIN_PER_LANG) / F.col("rows"))
    counts = known.groupBy("lang").agg(F.count("*").alias("rows"))
    chosen = known.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(scale)) < part)  # a row a language

    def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(h, g, features(t)) for h, g, t in zip(*map(pa.Array.to_pylist, batch.columns))]
            keep = [k for k in keep if k[2].any()]
            at = [np.flatnonzero(v).astype("<u2") for _, _, v in keep]
            cols = ([k[0] for k in keep], [k[1] for k in keep], [FAMILY_OF.get(k[1], k[1]) for k in keep],
                    [i.tobytes() for i in at], [k[2][i].astype("<f4").tobytes() for k, i in zip(keep, at)])
            types = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["h", "lang", "family", "at", "value"])

    sampled = map_batches(chosen.select("h", "lang", "text"), to_features, "h long, lang string, family string, at binary, value binary")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(scale)), "h", "at", "value"))
    sampled = sampled.withColumn("place", place).where(F.col("place") <= TRAIN_PER_LANG)

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "lang", "at", "value"])
        x = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
        for own, at, value in zip(x, rows["at"], rows["value"]):
            own[np.frombuffer(at, "<u2")] = np.frombuffer(value, "<f4")
        profiles, between = train_family(rows["lang"].to_numpy(), x)
        out = [(rows["family"].iloc[0], lang, None, floor, shares.astype("<f8").tobytes()) for lang, (shares, floor) in profiles.items()]
        out += [(rows["family"].iloc[0], a, b, 0.0, w.astype("<f4").tobytes()) for (a, b), w in between.items()]
        return pd.DataFrame(out, columns=["family", "a", "b", "floor", "weights"])

    made = sampled.select("h", "lang", "family", "at", "value").groupBy("family")
    fitted = made.applyInPandas(train, "family string, a string, b string, floor double, weights binary")
    model = Hierarchy({}, {})
    for r in sorted(fitted.collect(), key=lambda r: (r["a"], r["b"] or "")):  # languages and pairs
        if r["b"] is None:
            model.families.setdefault(r["family"], []).append(r["a"])
            model.profiles[r["a"]] = (np.frombuffer(r["weights"], "<f8"), r["floor"])
        else:
            model.between[r["a"], r["b"]] = np.frombuffer(r["weights"], "<f4")
    return Hierarchy(model.families, model.between, model.profiles)


def identify(docs: DataFrame, model: Hierarchy, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row; the text alone decides.

    NULL or empty texts and texts without a letter are ``und`` with score 0; repeated rows get the
    same answer; an empty table gives no rows; long texts are read whole. Only doc_id and text are
    read, so other columns cannot clash.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(t) for t in batch.column(1).to_pylist()]
            made = (pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "lang_pred", "score"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(src, predict, f"doc_id {dict(src.dtypes)['doc_id']}, lang_pred string, score double")


def with_language(docs: DataFrame, model: Hierarchy, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_known beside its own columns (which they replace if named so).

    lang_known is false for ``und`` and for a text that its nearest language explains worse than its own texts.
    """
    names = ["lang_pred", "lang_score", "lang_known"]

    @F.pandas_udf("lang_pred string, lang_score double, lang_known boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.judge(t) for t in texts], columns=names)

    own = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    made = docs.select(*own, predict(F.col(text)).alias("_made"))
    return made.select(*own, *[f"_made.{c}" for c in names])


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the rows outside the held-out fold and predict all rows: doc_id, held_out, lang_pred, score."""
    model = fit(docs, fold(F.col(doc_id)) != 0, doc_id, text, lang)
    return identify(docs, model, doc_id, text).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score"
    )
