"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest hash among its s-mers is its first or its
last: whether it is chosen depends on the k-mer alone, so equal passages have equal anchors whatever
stands around them. A fingerprint holds all of them, so it grows with the text: the distinct anchor
hashes with the positions at which they first occur. Two fingerprints are matched by position:
shared anchors count only along the longest run in which they keep their order.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import map_batches

K, S = 20, 5
#: Bytes of fingerprints in one batch that is sent back, about.
BATCH_BYTES = 16 << 20
#: Rows that are put in order together, about; the most groups of them, whose heads are broadcast; and the ids
#: per group that its bounds are estimated from. Bounds only balance the groups: every row is in exactly one.
GROUP_ROWS, MOST_GROUPS, BOUND_IDS = 512, 16384, 64

_P = np.uint32(0x01000193)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def _hashed(c: np.ndarray, at: np.ndarray | None, width: int) -> np.ndarray:
    """Hashes of the ``width`` code points from each position, or from those in ``at``."""
    n = len(c) - width + 1
    h = np.full(n if at is None else len(at), 0x811C9DC5, dtype=np.uint32)
    for j in range(width):
        h = (h ^ (c[j : j + n] if at is None else c[at + j])) * _P
    return _mixed(h)


def syncmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers; a shorter text is one anchor, an empty one has none."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if len(c) < K:
        at = np.zeros(min(len(c), 1), dtype=np.int64)
        return at, _hashed(c, at, len(c))
    h, w = _hashed(c, None, S), K - S + 1
    low, reach = h, 1
    while reach < w:  # minimum over windows of w s-mers, by doubling
        step = min(reach, w - reach)
        low, reach = np.minimum(low[:-step], low[step:]), reach + step
    at = np.flatnonzero((h[: len(low)] == low) | (h[w - 1 :] == low))
    return at, _hashed(c, at, K)


def fingerprint(text: str) -> str:
    """Base64 of the anchors: little-endian pairs (hash, position) by ascending hash; empty for an empty text."""
    at, h = syncmers(text)
    h, first = np.unique(h, return_index=True)
    pairs = np.stack([h, at[first].astype(np.uint32)], axis=1)
    return base64.b64encode(pairs.astype("<u4").tobytes()).decode()


def likeness(a: str, b: str) -> float:
    """0 to 1: of the anchors of both together, the share that both have in the same order."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(base64.b64decode(f), "<u4").reshape(-1, 2) for f in (a, b))
    _, i, j = np.intersect1d(x[:, 0], y[:, 0], assume_unique=True, return_indices=True)
    run: list[int] = []
    for p in y[j[np.argsort(x[i, 1], kind="stable")], 1].tolist():
        if not run or p > run[-1]:
            run.append(p)
        else:
            run[bisect.bisect_left(run, p)] = p
    union = len(x) + len(y) - len(i)
    return len(run) / union if union else 1.0


def edited(text: str, donor: str) -> str:
    """``text`` with its last third replaced by as many code points from the start of ``donor``, or all."""
    n = len(text) // 3
    return text[: len(text) - n] + donor[:n]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is the one with the next smaller doc_id, and the largest after the smallest.
    NULL texts count as empty; NULL ids come after all others; rows with one id, or with none, are
    ordered by a hash of their text, and rows that are equal in both are interchangeable; a single row
    is its own next; an empty table gives no rows. Very long texts are read whole, and a fingerprint
    grows with its text. Only doc_id (an integer) and text are read, so other columns cannot clash.

    Rows are grouped by ranges of doc_id between approximate quantiles, those without an id by ranges
    of their text's hash, so each text is shuffled once; the first row of each group is sent to the
    group above as well. At most 2 x MOST_GROUPS bounds and heads reach the driver and are broadcast.
    Rows that share one id are one group.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n, n_null = src.agg(F.count("key"), F.count_if(F.col("key").isNull())).first()
    groups, null_groups = (min(MOST_GROUPS, max(1, k // GROUP_ROWS)) for k in (n, n_null))
    at = [i / groups for i in range(1, groups)]
    scale = 1 << 20
    some = src.where(F.pmod(F.xxhash64("key"), F.lit(scale)) <= scale * BOUND_IDS * groups // max(n, 1))
    found = some.agg(F.percentile_approx("key", at, 10 * groups)).first()[0] if at else []
    bounds = np.unique(np.array(found or [], dtype=np.int64))

    @F.pandas_udf("int")
    def group_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="left").astype(np.int32))

    # documents follow each other by falling group, falling key and rising hash
    h = F.xxhash64("text")
    part = F.shiftright(h, 16) + (1 << 47)  # 48 bits, rising with the hash
    by_hash = (-1 - F.shiftright(part * null_groups, 48)).cast("int")
    keyed = src.withColumn("h", h).withColumn("grp", F.when(F.col("key").isNull(), by_hash).otherwise(group_of(F.coalesce("key", F.lit(0)))))
    first = F.max(F.struct(F.coalesce("key", F.lit(0)).alias("key"), F.bitwise_not("h").alias("not_h"))).alias("first")
    heads = sorted((r["grp"], r["first"]["key"], ~r["first"]["not_h"]) for r in keyed.groupBy("grp").agg(first).collect())
    table = spark.createDataFrame(
        [(grp, key, h, heads[(i + 1) % len(heads)][0]) for i, (grp, key, h) in enumerate(heads)], "grp int, first long, h long, above int"
    )
    fits = keyed["grp"].eqNullSafe(table["grp"]) & (F.coalesce("key", F.lit(0)) == F.col("first")) & (keyed["h"] == table["h"])
    placed = keyed.join(F.broadcast(table), fits, "left").select(keyed["grp"], "key", keyed["h"], "doc_id", "text", "above")
    own = F.struct("grp", F.lit(False).alias("lent"))
    lent = F.struct(F.col("above").alias("grp"), F.lit(True).alias("lent"))
    to = F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, lent))
    rows = placed.withColumn("to", F.explode(to))
    rows = rows.select(F.col("to.grp").alias("grp"), F.col("to.lent").alias("lent"), "key", "h", "doc_id", "text").repartition("grp")
    rows = rows.sortWithinPartitions("grp", "lent", F.desc("key"), "h").select("grp", "lent", "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        waiting = None  # the row whose next is not known yet

        def flushed(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, (id_type, *types))], names)

        for batch in batches:
            id_type, held = batch.column(2).type, 0
            out: list[list] = [[] for _ in names]
            for group, lent, key, t in zip(*(c.to_pylist() for c in batch.columns)):
                own = None
                if waiting and waiting[0] == group:
                    _, w_key, w_text, w_print = waiting
                    own = fingerprint(t)
                    e = edited(w_text, t)
                    e_print = fingerprint(e)
                    made = (w_key, len(w_text), hashlib.sha256(e.encode()).hexdigest(), w_print, e_print,
                            likeness(w_print, e_print), likeness(w_print, own))
                    for column, value in zip(out, made):
                        column.append(value)
                    held += len(w_print) + len(e_print)
                    if held > BATCH_BYTES:
                        yield flushed(out)
                        out, held = [[] for _ in names], 0
                    waiting = None
                if not lent:
                    waiting = (group, key, t, own if own is not None else fingerprint(t))
            yield flushed(out)

    schema = (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return map_batches(rows, compare, schema)
