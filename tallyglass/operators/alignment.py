"""Monotone positional join (J24): one cursor moves through the raw list while gold items look for their text.

A gold item takes the first raw place of its text after the cursor and moves the cursor there; where
there is none, it stays without a match and the cursor where it is. So an item is a function from the
cursor before it to the cursor after it, which never falls as the cursor rises, and is a step function:
"next place after c", and c itself beyond the text's last place. Functions of neighbours are composed,
block by block and then pair by pair, until the cursor before each block is known; then all blocks
are matched at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.operators.running import numbered
from tallyglass.storage import stored

#: Gold items that one task composes.
BLOCK = 4096


class Steps:
    """A step function of the cursor: ``values[k]`` from ``starts[k]`` up to the next start, and c itself from ``tail``."""

    def __init__(self, starts: np.ndarray | None = None, values: np.ndarray | None = None, tail: int = -1) -> None:
        none = np.zeros(0, dtype=np.int64)
        self.starts, self.values, self.tail = none if starts is None else starts, none if values is None else values, tail

    def then(self, places: np.ndarray) -> Steps:
        """This function, and after it "the next of the sorted ``places``, if there is one"."""
        at = np.searchsorted(places, self.values, side="right")
        moved = np.where(at < len(places), places[np.minimum(at, len(places) - 1)], self.values) if len(places) else self.values
        more = places[places > self.tail]
        if not len(more):
            return Steps(*_thin(self.starts, moved), self.tail)
        starts = np.concatenate([self.starts, [self.tail], more[:-1]])
        return Steps(*_thin(starts, np.concatenate([moved, more])), int(more[-1]))

    def after(self, first: Steps) -> Steps:
        """``first``, and after it this function."""
        own = self.starts[self.starts > first.tail] if len(self.starts) else self.starts
        inside = first.tail < self.tail
        starts = np.concatenate([first.starts, [first.tail], own]) if inside else first.starts
        values = np.concatenate([self(first.values), self(np.array([first.tail])), self(own)]) if inside else self(first.values)
        return Steps(*_thin(starts, values), max(first.tail, self.tail))

    def __call__(self, cursor: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return cursor
        at = np.searchsorted(self.starts, cursor, side="right") - 1
        return np.where(cursor >= self.tail, cursor, self.values[np.maximum(at, 0)])


def _thin(starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps without those that change nothing."""
    if not len(starts):
        return starts, values
    keep = np.r_[True, values[1:] != values[:-1]]
    return starts[keep], values[keep]


def _frame(node: int, f: Steps) -> pd.DataFrame:
    """Steps as rows; the last one is the tail."""
    return pd.DataFrame({"node": node, "start": np.r_[f.starts, f.tail], "value": np.r_[f.values, -1], "is_tail": np.r_[np.zeros(len(f.starts), bool), True]})


def _steps(rows: pd.DataFrame) -> Steps:
    rows = rows.sort_values(["is_tail", "start"])
    body = rows[~rows.is_tail]
    return Steps(body.start.to_numpy(np.int64), body.value.to_numpy(np.int64), int(rows[rows.is_tail].start.iloc[0]))


STEPS = "node long, start long, value long, is_tail boolean"


def _places(rows: pd.DataFrame) -> dict:
    rows = rows.sort_values("_r")
    return {key: own.to_numpy(np.int64) for key, own in rows.groupby("_key", sort=False)._r}


def _compose_block(key: tuple, gold: pd.DataFrame, raw: pd.DataFrame) -> pd.DataFrame:
    places, f = _places(raw), Steps()
    for text in gold.sort_values("_g")._key:
        if text in places:
            f = f.then(places[text])
    return _frame(key[0], f)


def _match_block(key: tuple, gold: pd.DataFrame, raw: pd.DataFrame) -> pd.DataFrame:
    places, out = _places(raw), []
    cursor = int(gold.cursor.iloc[0]) if len(gold) else -1
    for g, text in gold.sort_values("_g")[["_g", "_key"]].itertuples(index=False):
        own = places.get(text)
        at = np.searchsorted(own, cursor, side="right") if own is not None else 0
        if own is not None and at < len(own):
            cursor = int(own[at])
            out.append((g, cursor))
    return pd.DataFrame(out, columns=["_g", "_r"]).astype("int64")


def _compose_pair(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    halves = {n % 2: _steps(own) for n, own in rows.groupby("node")}
    f = halves[1].after(halves[0]) if len(halves) == 2 else halves[0]
    return _frame(key[0], f)


def positional_join(gold: DataFrame, raw: DataFrame, text: str, gold_order: list[str], raw_order: list[str], block: int = BLOCK) -> DataFrame:
    """(gold_place, raw_place) of matched items; both places count from 0 by the given orders.

    Texts are compared by their SHA-256; a NULL text matches nothing. A block's task holds the places of
    its own texts; the last pass needs only those between the cursors before and after its block,
    which cover the raw list once. Where there is one block only, its cursor is the start.
    """
    key = F.sha2(F.col(text).cast("binary"), 256)
    g = numbered(gold.select(*gold_order, key.alias("_key")), gold_order, "_g").select("_g", "_key").withColumn("_b", F.floor(F.col("_g") / block))
    r = numbered(raw.select(*raw_order, key.alias("_key")), raw_order, "_r").select("_r", "_key").where("_key is not null")
    g, r = stored(g, "gold"), stored(r, "raw")
    top = g.agg(F.max("_b")).first()[0]
    places = g.where("_key is not null").select("_b", "_key").distinct().join(r, "_key").select("_b", "_key", "_r").toDF("_b", "_key", "_r")  # columns of their own, for the cogroups
    if not top:
        cursors = g.select("_b").distinct().withColumns({"cursor": F.lit(-1).cast("long"), "upto": F.lit(None).cast("long")})
    else:
        both = g.groupBy("_b").cogroup(places.groupBy("_b"))
        levels = [stored(both.applyInPandas(_compose_block, STEPS), "steps")]
        size = int(top) + 1
        while size > 2:  # the cursor after all blocks is not asked for
            up = levels[-1].withColumn("_up", F.floor(F.col("node") / 2)).groupBy("_up")
            levels.append(stored(up.applyInPandas(_compose_pair, STEPS), "steps"))
            size = (size + 1) // 2
        cursors = g.sparkSession.createDataFrame([(0, -1)], "node long, cursor long")
        for f in reversed(levels):
            left = cursors.select((F.col("node") if f is levels[-1] else 2 * F.col("node")).alias("node"), "cursor")
            step = F.when(~F.col("is_tail") & (F.col("start") <= F.col("cursor")), F.struct("start", "value"))
            own = f.join(left, "node").groupBy("node", "cursor").agg(F.max(F.when(F.col("is_tail"), F.col("start"))).alias("tail"), F.max(step).alias("hit"))
            moved = F.when(F.col("cursor") >= F.col("tail"), F.col("cursor")).otherwise(F.col("hit.value"))
            right = own.select((F.col("node") + 1).alias("node"), moved.alias("cursor"))
            cursors = stored(left.unionByName(right), "cursors")
        cursors = cursors.select(F.col("node").alias("_b"), "cursor")
        after = cursors.select((F.col("_b") - 1).alias("_b"), F.col("cursor").alias("upto"))
        cursors = cursors.join(after, "_b", "left")
    own = g.join(cursors, "_b")
    near = places.join(cursors, "_b").where("_r > cursor and (upto is null or _r <= upto)").select("_b", "_key", "_r").toDF("_b", "_key", "_r")
    matched = own.groupBy("_b").cogroup(near.groupBy("_b")).applyInPandas(_match_block, "_g long, _r long")
    return matched.select(F.col("_g").alias("gold_place"), F.col("_r").alias("raw_place"))
