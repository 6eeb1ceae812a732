"""Further spectral estimators by moving sums: Goertzel at chosen frequencies, the sliding DFT's phase, ensembles.

A frame's sums over x cos and x sin at a frequency are taken over a chunk of a series' samples, which those of a frame
before it visit: at one frequency by a window, at many in numpy. Which frequencies is a constant of the plan. Until a frame is full, the nominal frequency holds.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import IpdftConfig
from ..storage import Scratch
from .scan import CHUNK, affine_states, carried, chunk_of, composed_powers, rated, started, with_visitors


#: Frames that are summed at a time.
PIECE = 4096


def _order():
    return Window.partitionBy("series_id", "chunk").orderBy("i")


def _frame_sums(turn: Column, n: int) -> tuple[Column, Column]:
    frame = _order().rowsBetween(-(n - 1), 0)
    return F.sum(F.col("x") * F.cos(turn)).over(frame), F.sum(F.col("x") * F.sin(turn)).over(frame)


def _estimated(found: DataFrame, config: IpdftConfig, chunk: int) -> DataFrame:
    """The trace of found (series_id, chunk, i, t, f), visitors among it: nominal until the first frame is full."""
    f = F.when(F.col("i") >= config.frame_len - 1, F.coalesce("f", F.lit(config.nominal_hz))).otherwise(config.nominal_hz)
    own = found.filter(chunk_of(chunk) == F.col("chunk"))
    return rated(own.select("series_id", "i", "t", f.alias("frequency_hz")), chunk)


def moving_sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums over each n values that follow each other in the last axis, by doubling: no value leaves a trace in sums without it."""
    found, at, power, width = None, 0, x, 1
    while True:
        if n & width:
            part = power[..., at : at + x.shape[-1] - n + 1]
            found, at = part if found is None else found + part, at + width
        if 2 * width > n:
            return found
        power, width = power[..., :-width] + power[..., width:], 2 * width


def goertzel_trace(signal: DataFrame, config: IpdftConfig, frequencies: tuple[float, ...], chunk: int = CHUNK) -> DataFrame:
    """series_id, i, t, frequency_hz, rocof_hz_s: of the given frequencies the one with the most power in the frame; of equal ones the first.

    A null sample counts as 0. A chunk's frames are summed by doubling, whose work grows with the logarithm of their length.
    """
    n, turns = config.frame_len, np.array([2 * math.pi * f / config.fs for f in frequencies])[:, None]
    grid = np.array(frequencies, float)

    def strongest(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        i, x = rows["i"].to_numpy(), rows["x"].mask(rows["gone"], 0.0).to_numpy(float)
        f = np.full(len(rows), config.nominal_hz)
        for low in range(0, len(x) - n + 1, PIECE):
            at = slice(low, low + PIECE + n - 1)
            turn = turns * i[at]
            power = moving_sums(x[at] * np.cos(turn), n) ** 2 + moving_sums(x[at] * np.sin(turn), n) ** 2
            f[low + n - 1 : low + n - 1 + power.shape[1]] = grid[power.argmax(0)]
        f[i < n - 1] = config.nominal_hz
        t = rows["t"].to_numpy(float)
        dt, df = np.diff(t, prepend=np.nan), np.diff(f, prepend=np.nan)
        rate = np.where(dt > 0, df / np.where(dt > 0, dt, 1), 0.0)
        out = pd.DataFrame({"series_id": rows["series_id"], "i": i, "t": t, "frequency_hz": f, "rocof_hz_s": rate})
        return out[i >= key[1] * chunk]

    near = with_visitors(signal.select("series_id", "i", "t", "x", F.col("x").isNull().alias("gone")), chunk, n)
    return near.groupBy("series_id", "chunk").applyInPandas(strongest, "series_id string, i long, t double, frequency_hz double, rocof_hz_s double")


def sliding_dft_trace(signal: DataFrame, config: IpdftConfig, chunk: int = CHUNK) -> DataFrame:
    """series_id, i, t, frequency_hz, rocof_hz_s: from how far the phase of the bin next to nominal turns from a frame to the next."""
    k = max(1, round(config.nominal_hz * config.frame_len / config.fs))
    centre = k * config.fs / config.frame_len
    c, s = _frame_sums(F.lit(2 * math.pi * k / config.frame_len) * (F.col("i") % F.lit(config.frame_len)), config.frame_len)
    sums = with_visitors(signal, chunk, config.frame_len).select("series_id", "chunk", "i", "t", c.alias("c"), s.alias("s"))
    before = sums.withColumns({"c0": F.lag("c").over(_order()), "s0": F.lag("s").over(_order())})
    # the sums are those of exp(-iwn): a phase that grows is a frequency over the bin's
    turn = F.atan2(F.col("c") * F.col("s0") - F.col("s") * F.col("c0"), F.col("c") * F.col("c0") + F.col("s") * F.col("s0"))
    f = F.when(F.col("i") >= config.frame_len, F.lit(centre) + turn * F.lit(config.fs / (2 * math.pi)))
    return _estimated(before.select("series_id", "chunk", "i", "t", f.alias("f")), config, chunk)


def prony_trace(signal: DataFrame, config: IpdftConfig, chunk: int = CHUNK) -> DataFrame:
    """series_id, i, t, frequency_hz, rocof_hz_s: Prony's method for one damped tone.

    In each frame x_k = a x_(k-1) + b x_(k-2) is fitted by least squares, from five moving sums; the tone is the complex root of
    z^2 = a z + b, and the frequency its angle. Nominal where the roots are real.
    """
    frame = _order().rowsBetween(-(config.frame_len - 1), 0)
    x0, x1, x2 = F.col("x"), F.lag("x", 1).over(_order()), F.lag("x", 2).over(_order())
    near = with_visitors(signal.select("series_id", "i", "t", "x"), chunk, config.frame_len + 2).withColumns({"x1": x1, "x2": x2})
    pairs = {"s11": ("x1", "x1"), "s12": ("x1", "x2"), "s22": ("x2", "x2"), "s01": ("x", "x1"), "s02": ("x", "x2")}
    sums = near.withColumns({name: F.sum(F.col(u) * F.col(v)).over(frame) for name, (u, v) in pairs.items()})
    # frames of whole products only
    sums = sums.withColumn("n", F.count(x0 * F.col("x2")).over(frame))
    det = F.nullif(F.expr("s11 * s22 - s12 * s12"), F.lit(0.0))
    a, b = F.expr("s01 * s22 - s02 * s12") / det, F.expr("s02 * s11 - s01 * s12") / det
    solved = sums.withColumns({"a": a, "b": b})
    complex_ = (F.col("n") == config.frame_len) & (F.col("a") * F.col("a") + 4 * F.col("b") < 0)
    f = F.when(complex_, F.atan2(F.sqrt(-F.col("a") * F.col("a") - 4 * F.col("b")), F.col("a")) * F.lit(config.fs / (2 * math.pi)))
    return _estimated(solved.select("series_id", "chunk", "i", "t", f.alias("f")), config, chunk)


def rls_trace(signal: DataFrame, config: IpdftConfig, forget: float = 0.99, chunk: int = CHUNK) -> DataFrame:
    """series_id, i, t, frequency_hz, rocof_hz_s: recursive least squares with forgetting, of c in x_k + x_(k-2) = c x_(k-1), which is 2 cos of the turn a sample.

    Both sums of the fit are discounted recursions: they run within a chunk from zero, and the sums at the ends of the chunks before, a row
    each, come discounted by the samples since. Nominal without a tone: where the sum of squares is 0 or the cosine is over 1. A null sample's products count as 0.
    """
    near = with_visitors(signal.select("series_id", "i", "t", "x"), chunk, 2)
    x1, x2 = F.lag("x", 1).over(_order()), F.lag("x", 2).over(_order())
    terms = near.select("series_id", "chunk", "i", "t", F.coalesce(x1 * (F.col("x") + x2), F.lit(0.0)).alias("u"), F.coalesce(F.when((F.col("x") + x2).isNotNull(), x1 * x1), F.lit(0.0)).alias("v"))
    terms = terms.filter(chunk_of(chunk) == F.col("chunk"))

    def discounted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        sums = affine_states(forget * np.eye(2), rows[["u", "v"]].to_numpy(float))
        return pd.DataFrame({"series_id": rows["series_id"], "chunk": rows["chunk"], "i": rows["i"], "t": rows["t"], "u": sums[:, 0], "v": sums[:, 1]})

    scratch = Scratch(signal.sparkSession)
    local = terms.groupBy("series_id", "chunk").applyInPandas(discounted, "series_id string, chunk long, i long, t double, u double, v double")
    local = scratch.stored(local, "sums")
    ends = local.groupBy("series_id", "chunk").agg(F.count("*").alias("n"), F.max_by(F.array("u", "v"), "i").alias("end"))
    starts = scratch.stored(carried(ends, composed_powers(forget * np.eye(2)), np.zeros(2)), "starts")
    scratch.clear(local, starts)
    since = F.pow(F.lit(forget), F.col("i") - F.col("chunk") * F.lit(chunk) + 1)
    whole = started(local, starts).withColumns({c: F.col(c) + since * F.col("start")[k] for k, c in enumerate("uv")})
    cosine = F.col("u") / F.nullif(F.col("v"), F.lit(0.0)) / 2
    f = F.when(F.abs(cosine) <= 1, F.acos(cosine) * F.lit(config.fs / (2 * math.pi)))
    return rated(whole.select("series_id", "i", "t", F.coalesce(f, F.lit(config.nominal_hz)).alias("frequency_hz")), chunk)


def ensemble_trace(traces: list[DataFrame]) -> DataFrame:
    """series_id, i, t, frequency_hz, rocof_hz_s: by sample the median of several traces."""
    every = reduce(DataFrame.union, [x.select("series_id", "i", "t", "frequency_hz", "rocof_hz_s") for x in traces])
    # a sample has as many rows as there are traces, so the median of a group is small work
    return every.groupBy("series_id", "i", "t").agg(F.median("frequency_hz").alias("frequency_hz"), F.median("rocof_hz_s").alias("rocof_hz_s"))
