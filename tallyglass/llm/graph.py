"""Connected components over edge tables that no single task or driver holds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import map_batches, stored

#: Edges that a task contracts at once, before any are shuffled.
BLOCK = 1 << 15


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block of BLOCK edges (u, v), every end but the smallest of its component with that smallest one."""
    parent: dict[int, int] = {}
    held = 0

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, root(x)) for x in parent]
        found = [x for x in found if x[0] != x[1]]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        held += batch.num_rows
        if held >= BLOCK:
            yield stars()
            parent.clear()
            held = 0
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of the edges (a, b): label is the smallest id of its component.

    Blocks of edges are contracted first, each in the task that reads it; what is one block needs nothing
    else. The rest goes through alternating large-star and small-star steps: each reduces per node to a
    minimum and joins it back, so a node with very many edges is pre-aggregated and its rows can be split.
    Each round's edges are written to the shared folder. Rows with a NULL end are ignored.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    blocks = -(-e.count() // BLOCK)
    e, before = stored(map_batches(e.coalesce(max(1, blocks)), contracted, "u long, v long", rows=BLOCK), "edges"), None
    while blocks > 1:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e, before = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges"), now
    ends = e.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return ends.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
