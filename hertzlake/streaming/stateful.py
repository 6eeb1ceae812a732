"""The estimators on streams: one state for each series, samples in the order in which they come.

Inside a micro-batch a series' rows are sorted by i, as their order there isn't defined. Results over any
cut into micro-batches equal the batch plans' (zcd_trace, ipdft_trace).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import IpdftConfig, ZcdConfig
from ..operators.ipdft import frame_frequencies

OUT = "series_id string, i long, t double, frequency_hz double, rocof_hz_s double"


#: Samples of a piece that is estimated and given out.
PIECE = 1 << 16


def sorted_columns(frames: Iterator[pd.DataFrame], kinds: dict[str, str], taken: Callable[[pd.DataFrame], pd.DataFrame] = lambda rows: rows) -> dict[str, np.ndarray]:
    """The columns of a micro-batch's rows of a series, by i: plain numbers of the given kinds, without the frames that they came in."""
    parts = [{c: np.array(rows[c], kind) for c, kind in kinds.items()} for rows in map(taken, frames)]
    order = np.argsort(np.concatenate([p["i"] for p in parts]), kind="stable")
    return {c: np.concatenate([p.pop(c) for p in parts])[order] for c in kinds}


def pieces(columns: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    for low in range(0, len(columns["i"]), PIECE):
        yield {c: x[low : low + PIECE] for c, x in columns.items()}


def _signs(x: np.ndarray, epsilon: float) -> np.ndarray:
    return (x > epsilon).astype(np.int8) - (x < -epsilon).astype(np.int8)


def _stepped(s0: np.ndarray, s1: np.ndarray, mode: str) -> np.ndarray:
    if mode == "neg_to_pos":
        return (s0 == -1) & (s1 >= 0)
    if mode == "pos_to_neg":
        return (s0 == 1) & (s1 <= 0)
    return (s0 != 0) & (s1 != 0) & (s0 != s1)


def zcd_stream(signal: DataFrame, config: ZcdConfig = ZcdConfig()) -> DataFrame:
    """OUT of a stream (series_id, i, t, x). State: last sample, anchor, frequency and its rate; null until known.

    A null sample is no crossing and is followed by none. A task holds a micro-batch's samples of a series as numbers, 25 bytes each, and gives out a piece at a time.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x0, t0, anchor, f, r = state.get if state.exists else (None,) * 5
        for rows in pieces(sorted_columns(frames, {"i": "i8", "t": "f8", "x": "f8", "gone": "?"})):
            t, x, gone = rows["t"], rows["x"], rows["gone"]
            # the sample before each, the first one's from the state
            t_before, x_before = np.append(math.nan if t0 is None else t0, t[:-1]), np.append(math.nan if x0 is None else x0, x[:-1])
            crossed = ~gone & ~np.append(x0 is None, gone[:-1]) & _stepped(_signs(x_before, config.epsilon), _signs(x, config.epsilon), config.mode)
            found, rates, held = np.empty(len(x)), np.empty(len(x)), 0
            for k in [*np.flatnonzero(crossed).tolist(), len(x)]:
                found[held:k], rates[held:k], held = config.nominal_hz if f is None else f, 0.0 if r is None else r, k
                if k == len(x):
                    break
                a, b = float(x_before[k]), float(x[k])
                time = float(t_before[k]) + (float(t[k]) - float(t_before[k])) * (-a / (b - a))
                gap = math.nan if anchor is None else time - anchor
                if config.min_period_s <= gap <= config.max_period_s:
                    r = None if f is None else (1.0 / gap - f) / gap
                    anchor, f = time, 1.0 / gap
                elif anchor is None:
                    anchor = time
            x0, t0 = None if gone[-1] else float(x[-1]), float(t[-1])
            yield pd.DataFrame({"series_id": key[0], "i": rows["i"], "t": t, "frequency_hz": found, "rocof_hz_s": rates})
        state.update((x0, t0, anchor, f, r))

    return signal.select("series_id", "i", "t", "x", signal["x"].isNull().alias("gone")).groupBy("series_id").applyInPandasWithState(
        step, OUT, "x0 double, t0 double, anchor double, f double, r double", "append", GroupStateTimeout.NoTimeout
    )


def ipdft_stream(signal: DataFrame, config: IpdftConfig) -> DataFrame:
    """OUT of a stream (series_id, i, t, x). State: the last frame_len - 1 samples, and time and frequency of the last one."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, t0, f0 = state.get if state.exists else ([], None, None)
        for rows in pieces(sorted_columns(frames, {"i": "i8", "t": "f8", "x": "f8"})):
            t, x = rows["t"], np.concatenate((held, rows["x"])).astype(float)
            f = np.full(len(t), config.nominal_hz)
            found = frame_frequencies(x, config) if len(x) >= config.frame_len else np.zeros(0)
            if len(found):
                f[-len(found) :] = found
            before_t, before_f = np.append(math.nan if t0 is None else t0, t[:-1]), np.append(math.nan if f0 is None else f0, f[:-1])
            dt = t - before_t
            rate = np.where(dt > 0, (f - before_f) / np.where(dt > 0, dt, 1), 0.0)
            held, t0, f0 = x[len(x) - min(len(x), config.frame_len - 1) :].tolist(), float(t[-1]), float(f[-1])
            yield pd.DataFrame({"series_id": key[0], "i": rows["i"], "t": t, "frequency_hz": f, "rocof_hz_s": rate})
        state.update((held, t0, f0))

    return signal.select("series_id", "i", "t", "x").groupBy("series_id").applyInPandasWithState(
        step, OUT, "held array<double>, t0 double, f0 double", "append", GroupStateTimeout.NoTimeout
    )


def in_order(signal: DataFrame, time_column: str, delay: str) -> DataFrame:
    """series_id, i, t, x of a stream whose samples come out of order: each once, as soon as the watermark has passed its time.

    A sample later than the delay, or a repeated one, is dropped by the watermark. The time column is cast to
    a time with a zone, as watermarks need. In append mode a group is given out when its time is past, so
    the estimators, which sort a micro-batch by i, see samples in order.
    """
    timed = signal.withColumn(time_column, signal[time_column].cast("timestamp")).withWatermark(time_column, delay)
    first = [F.first(c).alias(c) for c in ("t", "x")]
    # the window is one microsecond: it closes when the watermark passes the sample's time
    return timed.groupBy(F.window(time_column, "1 microsecond"), "series_id", "i").agg(*first).select("series_id", "i", "t", "x")


def without_series(signal: DataFrame, ended: DataFrame) -> DataFrame:
    """The stream without the series of a table (series_id): a reset is a new series_id, and the ended one's samples go."""
    return signal.join(ended.select("series_id").distinct(), "series_id", "left_anti")


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is there to Parquet at path, and stop; with the same checkpoint the next call goes on from there."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
