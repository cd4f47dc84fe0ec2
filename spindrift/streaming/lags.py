"""Lag features over a stream, and selections emitted when a series has ended.

Scores depend on percentiles of a whole series, so a stream cannot score rows as they come. What it can do
row by row is what needs one row of state: the value before, and the last value of a found row. Whole
series are chosen in `foreachBatch`, once their end has arrived.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "entity long, pos long, t double, value double, prev_value double, seen_value double"


def lag_features(stream: DataFrame) -> DataFrame:
    """Adds prev_value (row before) and seen_value (last row with found) to (entity, pos, t, value, found).

    Rows of a series arrive in order of t across batches; within one they are sorted.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, seen = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(["t", "pos"])
        out = []
        for r in rows.itertuples():
            out.append((key[0], r.pos, r.t, r.value, before, seen))
            before = r.value
            seen = r.value if r.found else seen
        state.update((before, seen))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    return stream.groupBy("entity").applyInPandasWithState(step, OUTPUT, "before double, seen double", "append", GroupStateTimeout.NoTimeout)


def choose_when_complete(stream: DataFrame, choose: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that runs `choose` over each micro-batch of whole series and hands it to `sink`."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: sink(choose(batch), epoch)).start()
