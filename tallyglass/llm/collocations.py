"""Phrase collocation mining by suffix sorting.

Every word starts one suffix of its piece, cut after ``max_n`` words. Suffixes are counted where they
are read, dealt out by language and first word, and sorted in reverse; one stack then counts all
their prefixes, which are all phrases of up to ``max_n`` words. Parts of phrases are joined afterwards.

Texts are read twice: most suffixes of prose are different, so a table of them would be far larger
than the texts, while a count of first words, which says how to deal them out, is small.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.llm.common import map_batches, stored

MAX_N, MIN_COUNT, INSIDE_PERCENT, TOP = 3, 10, 50, 2000
#: Pieces end at these, words at blanks and tabs besides.
ENDS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
#: Words that a task numbers or counts, and suffixes that it holds, before it hands on what it has counted.
MOST_WORDS, MOST_HELD = 1 << 19, 1 << 22
#: Bytes of a text that are split into words at once, and words that are counted at once.
SLICE_BYTES, BLOCK_WORDS = 1 << 18, 1 << 19
OUT_ROWS = 1 << 16
#: A first word with more than one in HOT of all words (so fewer than HOT words) is dealt out to SALTS tasks.
HOT, SALTS = 512, 64
#: Parts in which a language's phrases are ranked before the last ranking, which so gets TOP rows of each.
RANK_PARTS = 256

_FOLD = bytes(10 if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = re.compile(rb"[ \n]")


class _Numbers(dict):
    """Numbers words in the order of their first use; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _slices(data: bytes, size: int) -> Iterator[bytes]:
    """Folded text in slices of about ``size`` bytes that cut no word."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + size)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


class _Counter:
    """Counts suffixes of up to ``max_n`` words by language, in bounded memory.

    What it hands on for a language goes through ``rows``: the numbers of the suffixes' words by place (0 where
    a suffix has ended), their counts, and by number the words with a blank, the heads of first words, and hashes.
    """

    def __init__(self, max_n: int, rows: Callable[..., Iterator[pa.RecordBatch]]) -> None:
        self.max_n, self.bits, self.rows = max_n, 63 // max_n, rows
        self.slice = min(SLICE_BYTES, 1 << (self.bits - 1))
        self.most = min(MOST_WORDS, 1 << self.bits) - self.slice // 2 - 3
        self.reset()

    def reset(self) -> None:
        self.numbers, self.open, self.done = _Numbers({b".": 0}), {}, {}
        self.held = self.waiting = 0

    def add(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        for data in _slices(text.translate(_FOLD), self.slice):
            words = data.replace(b"\n", b" . ").split()  # no word holds a full stop
            if len(self.numbers) > self.most or self.held > MOST_HELD:
                yield from self.drain(lang)
            self.open.setdefault(lang, []).extend(map(self.numbers.__getitem__, words))
            self.waiting += len(words)
            if self.waiting > BLOCK_WORDS:
                for name in self.open:
                    self.take(name)
                self.waiting = 0
        self.open.setdefault(lang, []).append(0)

    def take(self, lang: str, last: bool = False) -> None:
        """Suffixes of the open words; the last ``max_n`` - 1 words wait for what follows, unless ``last``."""
        wait = self.max_n - 1
        words = np.array(self.open[lang] + [0] * (wait if last else 0), dtype=np.int64)
        n = len(words) - wait
        if n <= 0:
            return
        key, alive = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for k in range(self.max_n):
            word = words[k : k + n]
            alive &= word > 0
            key = (key << self.bits) | np.where(alive, word, 0)
        key = key[key > 0]
        self.open[lang] = [] if last else self.open[lang][n:]
        self.done.setdefault(lang, []).append(key)
        self.held += len(key)

    def drain(self, going_on: str | None = None) -> Iterator[pa.RecordBatch]:
        """Hand on all counts and start afresh; the open words of the text ``going_on`` stay open."""
        for lang in list(self.open):
            self.take(lang, last=lang != going_on)
        words = list(self.numbers)  # in the order of their numbers
        words[0] = b""
        left = [words[n] or b"." for n in self.open.get(going_on, [])]
        low = (1 << self.bits) - 1
        table = pa.array([w and w + b" " for w in words], pa.binary())
        for lang in list(self.done):
            keys, counts = np.unique(np.concatenate(self.done.pop(lang)), return_counts=True)
            place = [(keys >> (self.bits * (self.max_n - 1 - k))) & low for k in range(self.max_n)]
            first, used = (np.zeros(len(words), dtype=bool) for _ in range(2))
            first[place[0]] = True
            for word in place:
                used[word] = True
            end = _end(lang)
            heads = pa.array([w + end if u else b"" for w, u in zip(words, first.tolist())], pa.binary())
            hashes = np.fromiter((crc32(w + end) if u else 0 for w, u in zip(words, used.tolist())), dtype=np.int64, count=len(words))
            yield from self.rows(place, counts, table, heads, hashes)
        self.reset()
        if left:
            self.open[going_on] = [self.numbers[w] for w in left]


def _end(lang: str) -> bytes:
    return b"\n" + quote(lang, safe="").encode() + b" "


def _head(lang: str, word: bytes) -> bytes:
    """First word and language as one word without blanks, which ends with one."""
    return word + _end(lang)


def _suffixes(hot: frozenset[int]) -> Callable[..., Iterator[pa.RecordBatch]]:
    spread = np.array(sorted(hot), dtype=np.int64)

    def rows(place, counts, table: pa.Array, heads: pa.Array, hashes) -> Iterator[pa.RecordBatch]:
        is_hot = np.isin(hashes, spread)
        for lo in range(0, len(counts), OUT_ROWS):
            ids = [word[lo : lo + OUT_ROWS] for word in place]
            parts = [heads.take(pa.array(ids[0])), *(table.take(pa.array(word)) for word in ids[1:])]
            key, slot = pc.binary_join_element_wise(*parts, pa.scalar(b"")), hashes[ids[0]]
            salted = np.flatnonzero(is_hot[ids[0]])
            salt = np.zeros(len(salted), dtype=np.int64)
            for word in ids[1:]:
                salt = (salt * 31 + np.where(word[salted] > 0, hashes[word[salted]], 0)) % 1_000_003
            slot[salted] |= (salt % SALTS + 1) << 32
            yield pa.RecordBatch.from_arrays([pa.array(slot), key, pa.array(counts[lo : lo + OUT_ROWS], pa.int64())], ["slot", "key", "n"])

    return rows


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"),
    )


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n): how often a task has met each word, in bounded memory."""
    found: dict[str, Counter[bytes]] = defaultdict(Counter)
    held = 0

    def drain() -> Iterator[pa.RecordBatch]:
        for lang, words in found.items():
            end, n = _end(lang), len(words)
            slot = np.fromiter((crc32(w + end) for w in words), dtype=np.int64, count=n)
            counts = np.fromiter(words.values(), dtype=np.int64, count=n)
            for lo in range(0, n, OUT_ROWS):
                own = slice(lo, lo + OUT_ROWS)
                columns = [pa.array([lang] * len(slot[own]), pa.string()), pa.array(slot[own]), pa.array(counts[own])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "slot", "n"])

    for batch in batches:
        for lang, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = found[lang]
            for data in _slices(t.as_py().translate(_FOLD), SLICE_BYTES):
                before = len(own)
                own.update(data.split())  # ends of pieces are line feeds here
                held += len(own) - before
                if held > MOST_WORDS:
                    yield from drain()
                    found.clear()
                    own, held = found[lang], 0
    yield from drain()


def word_totals(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, slot, n): words by language and a 32-bit hash of both; words that share one are told apart later."""
    counted = map_batches(_texts(docs, text, lang), _total, "lang string, slot long, n long")
    return counted.groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def suffixes(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, hot: frozenset[int] = frozenset()) -> DataFrame:
    """(slot, key, n): suffixes of at most ``max_n`` words with the times a task has met them.

    A key is the head of first word and language and the other words, each with a blank after it, so that
    what begins alike sorts together. Suffixes of one slot meet in one task: those of one first word, or,
    if its hash is in ``hot``, those of one salt, which is a hash of the other words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(max_n, _suffixes(hot))
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from counter.add(name, t.as_py())
        yield from counter.drain()

    return map_batches(_texts(docs, text, lang), count, "slot long, key binary, n long")


def _prefixes(min_count: int, max_n: int, hot: frozenset[int]):
    """Counts of all prefixes of reverse-sorted suffixes.

    The stack holds the prefixes of the last suffix of a batch and what they count so far; inside a batch a
    prefix is a run of rows whose first words stay the same, and its count the sum over the run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Array | None = None  # the suffix at hand, and by depth what its prefixes count so far
        stack = [0] * max_n
        for b in (*batches, None):
            if b is not None and not b.num_rows:
                continue
            if b is None:
                if last is None:
                    return
                keys, n = pa.concat_arrays([last, pa.array([b""], pa.binary())]), np.zeros(2, dtype=np.int64)  # ends every prefix
            else:
                keys, n = b.column(0), np.asarray(b.column(1))
                if last is not None:
                    keys, n = pa.concat_arrays([last, keys]), np.r_[0, n]
            split = pc.split_pattern(keys, b" ")
            at, words = np.asarray(split.offsets).astype(np.int64), split.values
            depth, upto = np.diff(at) - 1, np.r_[0, np.cumsum(n)]
            same, spread, columns, made = np.ones(len(n) - 1, dtype=bool), None, [], []
            for d in range(max_n):
                has = depth > d
                columns.append(words.take(pa.array(np.where(has, at[:-1] + d, 0), mask=~has)))
                equal = pc.equal(columns[d].slice(1), columns[d].slice(0, len(n) - 1))
                same = same & np.asarray(pc.fill_null(equal, False))
                start = np.flatnonzero(np.r_[True, ~same])
                sums = np.diff(np.r_[upto[start], upto[-1]])
                sums[0] += stack[d]
                stack[d] = int(sums[-1])  # the last run may go on
                if d == 0:
                    heads = columns[0].take(pa.array(start)).to_pylist() if hot else []
                    ours = np.array([crc32(h + b" ") in hot if h else False for h in heads]) if hot else np.zeros(len(start), dtype=bool)
                    spread = np.repeat(ours, np.diff(np.r_[start, len(n)]))
                # what a salted first word begins is counted in several tasks, but for whole suffixes
                enough = (sums >= min_count) | (spread[start] & (d + 1 < max_n))
                enough[-1] = False
                chosen = pa.array(start[enough & has[start]])
                if len(chosen):
                    made.append(_phrases([c.take(chosen) for c in columns], sums[enough & has[start]]))
            last = keys.slice(len(keys) - 1)
            yield from made

    return run


def _phrases(words: list[pa.Array], counts: np.ndarray) -> pa.RecordBatch:
    """(lang, phrase, words, f) from heads, further words and counts."""
    parts = pc.split_pattern(words[0], b"\n").values
    first, of = parts.take(pa.array(np.arange(0, len(parts), 2))), parts.take(pa.array(np.arange(1, len(parts), 2))).dictionary_encode()
    lang = pa.array([unquote(x.decode()) for x in of.dictionary.to_pylist()], pa.string()).take(of.indices)
    phrase = pc.binary_join_element_wise(first, *words[1:], pa.scalar(b" ")) if len(words) > 1 else first
    size = pa.array(np.full(len(counts), len(words), dtype=np.int32))
    return pa.RecordBatch.from_arrays([lang, phrase, size, pa.array(counts, pa.int64())], ["lang", "phrase", "words", "f"])


def phrase_counts(docs: DataFrame, hot: frozenset[int], text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, max_n: int = MAX_N) -> DataFrame:
    """(lang, phrase, words, f) of all phrases that occur at least ``min_count`` times."""
    dealt = suffixes(docs, text, lang, max_n, hot).repartition("slot").sortWithinPartitions(F.desc("key")).select("key", "n")
    counted = dealt.mapInArrow(_prefixes(min_count, max_n, hot), "lang string, phrase binary, words int, f long")
    whole = counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    return whole.withColumn("phrase", F.decode("phrase", "UTF-8"))


def hot_slots(totals: DataFrame) -> frozenset[int]:
    """Slots with more than one in ``HOT`` of all words: fewer than ``HOT`` numbers reach the driver."""
    total = totals.agg(F.sum("n")).first()[0] or 0
    slots = totals.groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") * HOT > total)
    return frozenset(r.slot for r in slots.collect())


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exactly for counts of up to 15 digits."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_n: int = MAX_N,
    min_count: int = MIN_COUNT,
    inside_percent: int = INSIDE_PERCENT,
    top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to ``max_n`` words of each language.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` its two parts at the cut of the lowest score (the
    earliest on a tie), ``n`` all words of the language. A phrase goes if a longer one that holds it
    occurs at least ``inside_percent`` as often. Ranks go by score, ``a`` (both from above) and phrase.

    A to Z are lower-cased; pieces end at ``ENDS``, words at blanks and tabs. A NULL text counts as empty,
    a NULL language as ``und``. Repeated rows count each time. Very long texts and words are read whole;
    overlapping occurrences all count. Ties end at the phrase, which is unique. An empty table, or one
    in which no phrase is frequent enough, gives no rows. Only the text and the language are read, so
    other columns may have any name. ``max_n`` may be 2 to 5.
    """
    if not 2 <= max_n <= 5:
        raise ValueError("max_n must be 2 to 5")
    totals = stored(word_totals(docs, text, lang), "words")
    every = stored(phrase_counts(docs, hot_slots(totals), text, lang, min_count, max_n), "phrases")
    n = totals.groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = every.where("words > 1")

    cut = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", F.col("f").alias("a"), "k", F.expr("substring_index(phrase, ' ', k)").alias("head"),
                     F.expr("substring_index(phrase, ' ', k - words)").alias("tail"))
    part = every.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "f")
    for of, as_ in (("head", "l"), ("tail", "r")):
        at = (F.col("lang") == F.col("_lang")) & (F.col(of) == F.col("_phrase"))
        cut = cut.join(part.withColumnRenamed("f", as_), at).drop("_lang", "_phrase", of)
    lowest = F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r"))
    scored = cut.groupBy("lang", "phrase").agg(F.min("a").alias("a"), lowest.alias("cut"))

    within = phrases.where("words > 2").select("lang", "f", F.split("phrase", " ").alias("w"), "words")
    within = within.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    within = within.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    within = within.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "f")
    within = within.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    left = scored.join(within, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longest") < inside_percent * F.col("a"), F.lit(True)))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("_part"))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return left.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
