"""Taylor-Fourier frames: a phasor that is a polynomial of time, fitted to each frame by weighted least squares.

The fit is linear in the samples and the same for all frames, so that it is solved once, as a bank of filters. Chunks of samples overlap by
a frame and are worked on in parallel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TaylorConfig
from .scan import CHUNK, with_visitors


def filter_bank(config: TaylorConfig) -> np.ndarray:
    """Rows of frame_len weights: real and imaginary part of the phasor at the frame's middle, then of each coefficient of higher order."""
    n = config.frame_len
    u = (np.arange(n) - (n - 1) / 2) / config.fs
    turn = 2 * math.pi * config.nominal_hz * u
    basis = np.column_stack([part for k in range(config.order + 1) for part in (u**k * np.cos(turn), -(u**k) * np.sin(turn))])
    weight = np.sin(np.pi * (np.arange(n) + 0.5) / n)
    # columns of like size keep the solution exact
    size = np.abs(basis).max(axis=0)
    return np.linalg.pinv(basis / size * weight[:, None]) * weight / size[:, None]


def taylor_fourier_trace(signal: DataFrame, config: TaylorConfig, chunk: int = CHUNK) -> DataFrame:
    """series_id, i, t, frequency_hz, rocof_hz_s of each sample of signal (series_id, i, t, x), from the frame that ends there.

    i numbers a series' samples from 0. Until the first frame is full, where a frame has a null or NaN, or no phasor, the frequency is nominal and its rate 0.
    """
    n, bank = config.frame_len, filter_bank(config)
    dealt = with_visitors(signal.select("series_id", "i", "t", "x"), chunk, n - 1)

    def estimate(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        found = np.full((len(rows), 2 * (config.order + 1)), np.nan)
        if len(rows) >= n:
            found[n - 1 :] = np.lib.stride_tricks.sliding_window_view(rows["x"].to_numpy(float), n) @ bank.T
        p = [found[:, 2 * k] + 1j * found[:, 2 * k + 1] for k in range(config.order + 1)]
        size = np.where(np.abs(p[0]) > 0, p[0], 1.0)
        slope = p[1] / size
        f = config.nominal_hz + slope.imag / (2 * math.pi)
        rate = (2 * p[2] / size - slope**2).imag / (2 * math.pi) if config.order > 1 else np.zeros(len(rows))
        known = np.isfinite(f) & (np.abs(p[0]) > 0)
        out = {"series_id": rows["series_id"], "i": rows["i"], "t": rows["t"], "frequency_hz": np.where(known, f, config.nominal_hz), "rocof_hz_s": np.where(known, rate, 0.0)}
        return pd.DataFrame(out)[(rows["i"] >= key[1] * chunk).to_numpy()]

    return dealt.groupBy("series_id", "chunk").applyInPandas(estimate, "series_id string, i long, t double, frequency_hz double, rocof_hz_s double")
