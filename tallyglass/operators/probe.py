"""Probe training at scale (V8): full-gradient steps whose sums Spark forms, with the weights sent along.

A step's gradient is a sum over rows, so each task adds up its own rows and the sums of all tasks are added
by dimension. Nothing but one vector of the probe's size reaches the driver in a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.storage import stored

RATE, ROUNDS, L2 = 2.0, 4000, 1e-4


@dataclass
class Probe:
    """Weights and bias of a fitted probe, and the mean loss before its last step."""

    weights: np.ndarray
    bias: float
    loss: float = float("nan")

    def probability(self, vector: str = "embedding") -> Column:
        """The probability of a row, inside the JVM; NULL where the vector is."""
        pairs = F.arrays_zip(F.col(vector).alias("x"), F.array(*[F.lit(float(w)) for w in self.weights]).alias("w"))
        z = F.aggregate(pairs, F.lit(float(self.bias)), lambda a, p: a + p["x"].cast("double") * p["w"])
        return F.when(F.col(vector).isNotNull(), 1 / (1 + F.exp(-z)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)


def _sums(probes: dict[int, tuple[np.ndarray, float]], d: int):
    """Per probe of a fold k: rows whose fold is not k; (fold, dim, total), with the error, the loss and the count as last dims."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(d + 3) for k in probes}
        for b in batches:
            if not b.num_rows:
                continue
            x, y, fold = _matrix(b.column(0), d), np.asarray(b.column(1), dtype=np.float64), np.asarray(b.column(2))
            for k, (w, bias) in probes.items():
                use = fold != k
                own, want = x[use], y[use]
                z = own @ w + bias
                miss = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - want
                total[k] += np.r_[own.T @ miss, miss.sum(), (np.logaddexp(0, z) - want * z).sum(), len(want)]
        n = len(probes) * (d + 3)
        fold = np.repeat(np.fromiter(probes, dtype=np.int32), d + 3)
        dim = np.tile(np.arange(d + 3, dtype=np.int32), len(probes))
        yield pa.RecordBatch.from_arrays([pa.array(fold), pa.array(dim), pa.array(np.concatenate(list(total.values())) if n else np.zeros(0))], ["fold", "dim", "total"])

    return run


def fit(
    rows: DataFrame, truth: Column, vector: str = "embedding", fold: Column | None = None, folds: int = 0,
    rate: float = RATE, rounds: int = ROUNDS, l2: float = L2, tolerance: float = 0.0,
) -> dict[int, Probe]:
    """Logistic regression by full gradient steps from zero: probe -1 over all rows, and probe k without fold k.

    All probes take their steps in the same passes. ``tolerance`` ends the steps once no weight moves further;
    0 takes all ``rounds``. Rows without a vector or a truth are left out; vectors have to be of one
    length, which the longest sets, else an error is raised. No rows give probes of zeros.
    """
    own = rows.select(F.col(vector).cast("array<double>").alias("x"), truth.cast("double").alias("y"),
                      (F.lit(-2) if fold is None else fold).cast("int").alias("fold"))
    own = stored(own.where("x is not null and y is not null"), "probe")  # read once a step
    low, d = own.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    names = [-1, *range(folds)]
    if d is None:
        return {k: Probe(np.zeros(0), 0.0) for k in names}
    if low != d:
        raise ValueError(f"vectors of {low} to {d} numbers")
    probes = {k: Probe(np.zeros(d), 0.0) for k in names}
    for _ in range(rounds):
        now = {k: (p.weights, p.bias) for k, p in probes.items()}
        sums = own.mapInArrow(_sums(now, d), "fold int, dim int, total double").groupBy("fold", "dim").agg(F.sum("total").alias("total"))
        total = {k: np.zeros(d + 3) for k in names}
        for r in sums.collect():  # (folds + 1) * (d + 3) numbers
            total[r.fold][r.dim] = r.total
        moved = 0.0
        for k, p in probes.items():
            n = total[k][d + 2]
            if n:
                step = rate * (total[k][:d] / n + l2 * p.weights / n)
                back = rate * total[k][d] / n
                probes[k] = Probe(p.weights - step, p.bias - back, total[k][d + 1] / n)
                moved = max(moved, float(np.abs(step).max()), abs(back))
        if moved <= tolerance:
            break
    return probes


def cross_validated(rows: DataFrame, probes: dict[int, Probe], truth: Column, fold: Column, vector: str = "embedding") -> DataFrame:
    """(fold, tp, fp, fn, tn): each row judged by the probe that has not seen its fold."""
    p = F.lit(None).cast("double")
    for k, probe in probes.items():
        if k >= 0:
            p = F.when(fold == k, probe.probability(vector)).otherwise(p)
    judged = rows.select(fold.alias("fold"), truth.alias("t"), (p >= 0.5).alias("p")).where("p is not null and t is not null")
    n = lambda c: F.count_if(c)
    t, got = F.col("t"), F.col("p")
    return judged.groupBy("fold").agg(n(got & t).alias("tp"), n(got & ~t).alias("fp"), n(~got & t).alias("fn"), n(~got & ~t).alias("tn"))
