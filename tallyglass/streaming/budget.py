"""A budget over a stream (G6): per run, rows are examined and taken until the limits are reached."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyglass.functions import lexicon as L


def budget_stream(stream: DataFrame, limit: int, schema: str = "run string, batch long, pos long, keep boolean, score double") -> DataFrame:
    """Rows (run, batch, pos, keep, score) that a gate lets through, for runs whose batches arrive in order.

    The state of a run is two numbers. Within one micro-batch a run's batches are taken in order.
    """
    cap = L.EXAMINE_FACTOR * limit

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        examined, taken = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["batch", "pos"], kind="stable")
        out = []
        for _, own in rows.groupby("batch", sort=True):
            if taken >= limit or examined >= cap:
                break
            own = own.head(cap - examined)
            examined += len(own)
            kept = own[own["keep"]].sort_values("score", ascending=False, kind="stable").head(limit - taken)
            taken += len(kept)
            out.append(kept)
        state.update((examined, taken))
        yield pd.concat(out) if out else rows.head(0)

    return stream.groupBy("run").applyInPandasWithState(step, schema, "examined int, taken int", "append", GroupStateTimeout.NoTimeout)
