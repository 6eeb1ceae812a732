"""Sequential estimators on streams, with a typed state that ends: at a mark in the stream, and when a series has been silent.

The step functions are those of the batch form (operators.sequential). A series' state is one row. A sample marked `reset` is the first of a new
run, which knows nothing of the samples before; after one marked `end` the state is cleared; and a state that no sample has renewed for the
time to live is dropped. So ended series leave nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequential import OUT, State, Step
from .stateful import PIECE, sorted_columns

#: The state store that typed state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SequentialProcessor(StatefulProcessor):
    """The samples of a series through a step, in a micro-batch by i."""

    def __init__(self, estimator: tuple[State, Step], ttl_ms: int | None = None):
        self.start, self.step = estimator
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", ", ".join(f"s{k} double" for k in range(len(self.start))), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else self.start
        # marks as numbers: 1 is a reset, 2 an end
        taken = lambda frame: frame.assign(mark=(frame["mark"] == "reset") + 2 * (frame["mark"] == "end"))
        own = sorted_columns(rows, {"i": "i8", "t": "f8", "x": "f8", "mark": "i1"}, taken)
        ends, resets = own["mark"] == 2, own["mark"] == 1
        # a run begins at a reset and after an end; a long one goes on from piece to piece
        cuts = sorted({*range(0, len(ends), PIECE), *np.flatnonzero(resets).tolist(), *(np.flatnonzero(ends) + 1).tolist(), len(ends)})
        for low, high in zip(cuts, cuts[1:]):
            if resets[low] or low and ends[low - 1]:
                state = self.start
            i, t, x = (own[c][low:high] for c in ("i", "t", "x"))
            state, f, rate = self.step(state, t, x)
            yield pd.DataFrame({"series_id": key[0], "i": i, "t": t, "frequency_hz": f, "rocof_hz_s": rate})
        if ends[-1]:
            self.state.clear()
        else:
            self.state.update(state)

    def close(self) -> None:
        pass


def sequential_stream(signal: DataFrame, estimator: tuple[State, Step], ttl_ms: int | None = None) -> DataFrame:
    """OUT of a stream (series_id, i, t, x, and mark, which may be absent: `reset`, `end` or null).

    Over any cut into micro-batches in order, each run equals sequential_trace of its samples. A null series is none here, as state needs a key. Without a time to live a series
    that isn't ended keeps its state.
    """
    if signal.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}")
    mark = F.col("mark") if "mark" in signal.columns else F.lit(None)
    keyed = signal.select("series_id", "i", "t", "x", mark.cast("string").alias("mark")).filter("series_id is not null")
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return keyed.groupBy("series_id").transformWithStateInPandas(SequentialProcessor(estimator, ttl_ms), OUT, "append", mode)
