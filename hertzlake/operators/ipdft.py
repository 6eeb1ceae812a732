"""Interpolated DFT: peak of the spectrum of the last frame, refined by a parabola through its neighbours.

All frames of a chunk of samples are transformed at once; chunks overlap by a frame, so that one long series is worked on in
parallel. The spectra are a row a sample, and their peaks columns; the trace finds both in a task and hands on no spectrum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IpdftConfig
from .scan import CHUNK, rated, with_visitors

#: Magnitudes of a chunk of spectra.
MAGNITUDES = 1 << 20


def spectra(signal: DataFrame, config: IpdftConfig, chunk: int | None = None) -> DataFrame:
    """series_id, i, t, m of each sample: the magnitudes of the frame that ends there, in bins below half the frame length; null until a frame is full.

    A null sample counts as 0; in a frame of nulls alone the magnitudes are null. A chunk, if not given, has about MAGNITUDES in a task.
    """
    n, half = config.frame_len, config.frame_len // 2
    chunk = chunk or max(n, min(CHUNK, MAGNITUDES // half))

    def transformed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        gone, m = rows["gone"].to_numpy(bool), [None] * min(n - 1, len(rows))
        if len(rows) >= n:
            frames, unknown = (np.lib.stride_tricks.sliding_window_view(x, n) for x in (rows["x"].mask(gone, 0.0).to_numpy(float), gone))
            for at in range(0, len(frames), 4096):
                m.extend(np.abs(np.fft.rfft(frames[at : at + 4096], axis=1))[:, :half])
            for k in np.flatnonzero(unknown.all(1)).tolist() if gone.any() else ():
                m[k + n - 1] = [None] * half
        own = (rows["i"] >= key[1] * chunk).to_numpy()
        return pd.DataFrame({"series_id": rows["series_id"], "i": rows["i"], "t": rows["t"], "m": pd.Series(m, rows.index, object)})[own]

    near = with_visitors(signal.select("series_id", "i", "t", "x", F.col("x").isNull().alias("gone")), chunk, n)
    return near.groupBy("series_id", "chunk").applyInPandas(transformed, "series_id string, i long, t double, m array<double>")


def spectrum(signal: DataFrame, config: IpdftConfig, chunk: int | None = None) -> DataFrame:
    """series_id, i, k, mag of each full frame, which ends at sample i; bins below half the frame length."""
    bins = spectra(signal, config, chunk).select("series_id", "i", F.posexplode("m").alias("k", "mag"))
    return bins.withColumn("k", F.col("k").cast("long"))


def peaks(found: DataFrame, config: IpdftConfig) -> DataFrame:
    """series_id, i, t, k, delta, frequency_hz of each of the spectra (series_id, i, t, m); of equal peaks the lowest bin. Null where there is no spectrum."""
    half = config.frame_len // 2
    frame = found.withColumn("k", (F.array_position("m", F.array_max("m")) - 1).cast("int"))
    left, middle, right = (F.get("m", F.col("k") + d) for d in (-1, 0, 1))
    bend = left - F.lit(2.0) * middle + right
    delta = F.when((F.col("k") >= 1) & (F.col("k") < half - 1) & (bend != 0), F.lit(0.5) * (left - right) / F.nullif(bend, F.lit(0.0))).otherwise(0.0)
    frame = frame.withColumn("delta", delta)
    width = config.fs / config.frame_len
    return frame.select("series_id", "i", "t", F.col("k").cast("long").alias("k"), "delta", ((F.col("k") + F.col("delta")) * F.lit(width)).alias("frequency_hz"))


def ipdft_trace_sql(signal: DataFrame, config: IpdftConfig, chunk: int | None = None) -> DataFrame:
    """ipdft_trace with peak and rate as columns of the spectra."""
    found = peaks(spectra(signal, config, chunk), config).withColumn("frequency_hz", F.coalesce("frequency_hz", F.lit(config.nominal_hz)))
    return rated(found.select("series_id", "i", "t", "frequency_hz"))


def frame_frequencies(x: np.ndarray, config: IpdftConfig, refined: bool = True) -> np.ndarray:
    """The frequency of each full frame of x; of the peak's bin alone if not refined."""
    n, half = config.frame_len, config.frame_len // 2
    found = []
    frames = np.lib.stride_tricks.sliding_window_view(x, n)
    for at in range(0, len(frames), 4096):
        mag = np.abs(np.fft.rfft(frames[at : at + 4096], axis=1))[:, :half]
        rows, k = np.arange(len(mag)), mag.argmax(1)
        inside = (k >= 1) & (k < half - 1) & refined
        left, middle, right = (mag[rows, np.clip(k + d, 0, half - 1)] for d in (-1, 0, 1))
        bend = left - 2 * middle + right
        delta = np.where(inside & (bend != 0), 0.5 * (left - right) / np.where(bend == 0, 1, bend), 0.0)
        found.append((k + delta) * (config.fs / n))
    return np.concatenate(found) if found else np.zeros(0)


def ipdft_trace(signal: DataFrame, config: IpdftConfig, chunk: int = 1 << 16, keep: tuple[str, ...] = (), refined: bool = True) -> DataFrame:
    """series_id, i, t, frequency_hz, rocof_hz_s of each sample of signal (series_id, i, t, x), and the columns to keep.

    i numbers a series' samples from 0. The nominal frequency holds until the first frame is full. A
    sample goes to its chunk and, near its end, to the next one, which needs frames that begin before it.
    """
    n = config.frame_len
    own, later = F.floor(F.col("i") / F.lit(chunk)), F.floor((F.col("i") + F.lit(n)) / F.lit(chunk))
    more = [c for c in keep if c not in ("series_id", "i", "t", "x")]
    dealt = signal.select("series_id", "i", "t", "x", *more, F.explode(F.sequence(own, later)).alias("chunk"))

    def estimate(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        start, found = key[1] * chunk, np.full(len(rows), np.nan)
        if len(rows) >= n:
            found[n - 1 :] = frame_frequencies(rows["x"].to_numpy(), config, refined)
        f = np.where(rows["i"] >= n - 1, found, config.nominal_hz)
        dt, df = np.diff(rows["t"], prepend=np.nan), np.diff(f, prepend=np.nan)
        rate = np.where(dt > 0, df / np.where(dt > 0, dt, 1), 0.0)
        out = pd.DataFrame({"series_id": rows["series_id"], "i": rows["i"], "t": rows["t"], "frequency_hz": f, "rocof_hz_s": rate, **{c: rows[c] for c in keep}})
        return out[rows["i"] >= start]

    kept = "".join(f", `{c}` {signal.schema[c].dataType.simpleString()}" for c in keep)
    return dealt.groupBy("series_id", "chunk").applyInPandas(estimate, f"series_id string, i long, t double, frequency_hz double, rocof_hz_s double{kept}")
