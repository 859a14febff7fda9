"""Running sums and row numbers over all rows, in two passes instead of one task.

Rows are dealt out by ranges of their order and stored with the number of their range. The first pass adds
up each range, the driver adds up the ranges' totals, and the second pass sums inside each range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.storage import stored

#: Ranges at most; so many totals reach the driver, and as many offsets go back.
PARTS = 1024
#: Rows that a range should hold.
PART_ROWS = 200_000


def _ranged(df: DataFrame, order: list[Column], parts: int | None) -> DataFrame:
    if parts is None:
        parts = max(1, min(PARTS, -(-df.count() // PART_ROWS)))
    dealt = df.repartitionByRange(parts, *order) if parts > 1 else df.coalesce(1)
    return stored(dealt.withColumn("_part", F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: list[str], sums: dict[str, Column], keys: list[str] = (), parts: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``sums``: what the rows before this one (by ``order``) add up to.

    The sums are of whole numbers that are not negative; NULL counts as 0. With ``keys`` each group of equal
    keys is summed on its own: all rows are summed in the order of (keys, order), and a group's smallest
    sum is what stood before it, so that a group that holds most rows is spread like any other. ``order``
    has to be total, or rows of equal order get any order among themselves. NULLs come first. Only the
    totals of at most ``PARTS`` ranges reach the driver.
    """
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    values = {c: F.coalesce(v.cast("long"), F.lit(0)) for c, v in sums.items()}
    rows = _ranged(df.withColumns({f"_v_{c}": v for c, v in values.items()}), by, parts)
    names = list(values)
    totals = rows.groupBy("_part").agg(*[F.sum(f"_v_{c}").alias(c) for c in names]).collect()
    totals.sort(key=lambda r: r._part)
    before = {c: [0, *accumulate(r[c] for r in totals)] for c in names}
    heads = [(r._part, *[before[c][i] for c in names]) for i, r in enumerate(totals)]
    offsets = df.sparkSession.createDataFrame(heads, "_part int" + "".join(f", `_o_{c}` long" for c in names))
    own = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(offsets), "_part")  # at most PARTS rows
    rows = rows.withColumns({c: F.col(f"_o_{c}") + F.coalesce(F.sum(f"_v_{c}").over(own), F.lit(0)) for c in names})
    rows = rows.select(*df.columns, *names)
    if keys:
        first = rows.groupBy(*keys).agg(*[F.min(c).alias(f"_b_{c}") for c in names])
        first = first.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_b_{c}" for c in names])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        rows = rows.join(first, same).select(*df.columns, *[(F.col(c) - F.col(f"_b_{c}")).alias(c) for c in names])
    return rows


def numbered(df: DataFrame, order: list[str], name: str, keys: list[str] = (), parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the row's place by ``order``, from 0, without one task that sorts all rows."""
    return running(df, order, {name: F.lit(1)}, keys, parts)
