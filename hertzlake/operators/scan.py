"""Recursive estimators in parallel: a recursion whose steps compose is a scan, by chunk of samples and over the chunks' ends.

A step of a linear recursion is an affine map, one of a Kalman filter a pair of conditional and likelihood elements (after Sarkka and
Garcia-Fernandez); both compose associatively. A chunk composes its steps by doubling, from a start of zero, and hands on a row; a series'
rows give the state that each chunk starts with, and the chunks then have their estimates. Only tables of a row a chunk meet by series.
A null or NaN sample is 0 in the linear loops and no measurement in the filter. i numbers a series' samples from 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KalmanConfig, LoopConfig
from ..storage import Scratch

CHUNK = 1 << 16


def chunk_of(chunk: int) -> Column:
    return F.floor(F.col("i") / F.lit(chunk))


def with_visitors(samples: DataFrame, chunk: int, reach: int) -> DataFrame:
    """samples with their chunk; the last ones of a chunk, so many, visit the next."""
    later = F.floor((F.col("i") + F.lit(reach)) / F.lit(chunk))
    return samples.withColumn("chunk", F.explode(F.sequence(chunk_of(chunk), later)))


def rated(estimates: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """series_id, i, t, frequency_hz with rocof_hz_s, the change since the sample before; 0 at the first, or if time doesn't grow. By chunk."""
    order = Window.partitionBy("series_id", "chunk").orderBy("i")
    dt, df = F.col("t") - F.lag("t").over(order), F.col("frequency_hz") - F.lag("frequency_hz").over(order)
    rate = F.when(dt > 0, df / F.nullif(dt, F.lit(0.0))).otherwise(0.0)
    found = with_visitors(estimates, chunk, 1).select("series_id", "i", "t", "chunk", "frequency_hz", rate.alias("rocof_hz_s"))
    return found.filter(chunk_of(chunk) == F.col("chunk")).drop("chunk")


def affine_states(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The states y_k = a y_(k-1) + b_k from y_(-1) = 0, a row each, by doubling."""
    y, power, step = np.array(b, float), a, 1
    while step < len(y):
        y[step:] += y[:-step] @ power.T
        power, step = power @ power, 2 * step
    return y


def carried(ends: DataFrame, compose: Callable[[np.ndarray, int, np.ndarray], np.ndarray], first: np.ndarray) -> DataFrame:
    """series_id, chunk, start of ends (series_id, chunk, n, end): the state that each chunk starts with, of the chunks before it in order."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        state, starts = first, []
        for n, end in zip(rows["n"], rows["end"]):
            starts.append(state.tolist())
            state = compose(state, n, np.array(end))
        return pd.DataFrame({"series_id": rows["series_id"], "chunk": rows["chunk"], "start": starts})

    return ends.groupBy("series_id").applyInPandas(found, "series_id string, chunk long, start array<double>")


def started(samples: DataFrame, starts: DataFrame) -> DataFrame:
    """samples with chunk's start, a row a chunk."""
    named = starts.select(F.col("series_id").alias("s"), F.col("chunk").alias("c"), "start")
    return samples.join(named, F.col("series_id").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).drop("s", "c")


def _plain(x: pd.Series) -> np.ndarray:
    return np.nan_to_num(x.to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0)


def sogi(config: LoopConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """a, b, g, omega of a second-order generalised integrator by the trapezoidal rule, exact at the nominal frequency.

    With s_k = a s_(k-1) + b v_k, its outputs in phase and a quarter behind are s_(k-1) + g v_k; omega is the angular frequency of the
    continuous one.
    """
    half = 0.5 / config.fs
    omega = math.tan(2 * math.pi * config.nominal_hz * half) / half
    system, one = np.array([[-config.k * omega, -omega], [omega, 0.0]]), np.eye(2)
    inverse = np.linalg.inv(one - half * system)
    a, g = inverse @ (one + half * system), inverse @ np.array([half * config.k * omega, 0.0])
    return a, (a + one) @ g, g, omega


def composed_powers(a: np.ndarray) -> Callable[[np.ndarray, int, np.ndarray], np.ndarray]:
    return lambda state, n, end: np.linalg.matrix_power(a, int(n)) @ state + end


def sogi_fll_trace(signal: DataFrame, config: LoopConfig, chunk: int = CHUNK) -> DataFrame:
    """series_id, i, t, frequency_hz, rocof_hz_s of each sample of signal (series_id, i, t, x): a frequency-locked loop, fed forward.

    The integrator stays at the nominal frequency, so that it is a linear scan. What its loop would feed back, error times quadrature, is
    its square times (1 - (w / nominal)^2) / k at a steady frequency w: two low passes, again scans, have the mean of both, and the gain
    is taken outside of them, from their ratio.
    """
    a, b, g, omega = sogi(config)
    scratch = Scratch(signal.sparkSession)
    keep = math.exp(-1.0 / (config.fs * config.tau_s))
    slow = keep * np.eye(2)
    cut = signal.select("series_id", "i", "t", "x", chunk_of(chunk).alias("chunk"))

    def end(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        states = affine_states(a, np.outer(_plain(rows["x"]), b))
        return pd.DataFrame({"series_id": rows["series_id"][:1], "chunk": rows["chunk"][:1], "n": len(rows), "end": [states[-1].tolist()]})

    ends = scratch.stored(cut.groupBy("series_id", "chunk").applyInPandas(end, "series_id string, chunk long, n long, end array<double>"), "ends")
    starts = scratch.stored(carried(ends, composed_powers(a), np.zeros(2)), "starts")

    def passed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i").reset_index(drop=True)
        v = _plain(rows["x"])
        inputs = np.outer(v, b)
        inputs[0] += a @ np.array(rows["start"][0])
        states = affine_states(a, inputs)
        out = np.vstack((np.array(rows["start"][0]), states[:-1])) + np.outer(v, g)
        error = v - out[:, 0]
        means = affine_states(slow, (1 - keep) * np.column_stack((error * out[:, 1], out[:, 1] ** 2)))
        return pd.DataFrame({"series_id": rows["series_id"], "chunk": rows["chunk"], "i": rows["i"], "t": rows["t"], "at": np.arange(1, len(rows) + 1), "p": means[:, 0], "q": means[:, 1]})

    local = started(cut, starts).groupBy("series_id", "chunk").applyInPandas(passed, "series_id string, chunk long, i long, t double, at long, p double, q double")
    local = scratch.stored(local, "means")
    last = local.groupBy("series_id", "chunk").agg(F.max("at").alias("n"), F.max_by(F.array("p", "q"), "at").alias("end"))
    starts = scratch.stored(carried(last, composed_powers(slow), np.zeros(2)), "starts")
    scratch.clear(local, starts)
    ahead = F.pow(F.lit(keep), F.col("at"))
    p, q = (F.col(c) + ahead * F.col("start")[k] for k, c in enumerate("pq"))
    squared = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(config.k) * p / F.when(q > 0, q))
    found = F.atan(F.lit(omega / (2 * config.fs)) * F.sqrt(squared)) * F.lit(config.fs / math.pi)
    return rated(started(local, starts).select("series_id", "i", "t", F.coalesce(found, F.lit(config.nominal_hz)).alias("frequency_hz")), chunk)


# a Kalman filter's elements: A, b, C, eta, J, as rows of 4 + 2 + 4 + 2 + 4 numbers


def _parts(e: np.ndarray):
    return e[:, :4].reshape(-1, 2, 2), e[:, 4:6], e[:, 6:10].reshape(-1, 2, 2), e[:, 10:12], e[:, 12:].reshape(-1, 2, 2)


def _joined(*parts: np.ndarray) -> np.ndarray:
    return np.concatenate([p.reshape(len(p), -1) for p in parts], axis=1)


def kalman_elements(z: np.ndarray, known: np.ndarray, config: KalmanConfig) -> np.ndarray:
    """An element for each measurement; one that isn't known has a prediction alone."""
    turn = 2 * math.pi * config.nominal_hz / config.fs
    f = np.array([[math.cos(turn), -math.sin(turn)], [math.sin(turn), math.cos(turn)]])
    h, q, n = np.array([1.0, 0.0]), config.q * np.eye(2), len(z)
    spread = config.q + config.r
    gain = q @ h / spread
    left = np.eye(2) - np.outer(gain, h)
    back = f.T @ h / spread
    pick = lambda yes, no: np.where(known[:, None, None], yes, no)
    measured = np.where(known, z, 0.0)[:, None]
    return _joined(pick(left @ f, f), measured * gain, pick(left @ q, q), measured * back, pick(np.outer(back, h @ f), np.zeros((2, 2))) * np.ones((n, 1, 1)))


def composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The elements of first followed by then, row by row."""
    a1, b1, c1, e1, j1 = _parts(first)
    a2, b2, c2, e2, j2 = _parts(then)
    turned = lambda m: np.swapaxes(m, 1, 2)
    times = lambda m, v: np.einsum("nij,nj->ni", m, v)
    ahead = a2 @ np.linalg.inv(np.eye(2) + c1 @ j2)
    back = turned(a1) @ np.linalg.inv(np.eye(2) + j2 @ c1)
    return _joined(
        ahead @ a1, times(ahead, b1 + times(c1, e2)) + b2, ahead @ c1 @ turned(a2) + c2, times(back, e2 - times(j2, b1)) + e1, back @ j2 @ a1 + j1
    )


def prefixes(elements: np.ndarray) -> np.ndarray:
    """Each element composed with all before it, by doubling."""
    found, step = np.array(elements), 1
    while step < len(found):
        found[step:] = composed(found[:-step], found[step:])
        step *= 2
    return found


def whole(elements: np.ndarray) -> np.ndarray:
    """All elements composed, by halves."""
    while len(elements) > 1:
        pairs = composed(elements[: len(elements) // 2 * 2 : 2], elements[1::2])
        elements = np.concatenate((pairs, elements[len(elements) // 2 * 2 :]))
    return elements[0]


def kalman_states(signal: DataFrame, config: KalmanConfig, chunk: int = CHUNK) -> DataFrame:
    """series_id, i, t, re, im of each sample: the mean of a phasor that turns at the nominal frequency and is measured by its real part.

    The phasor starts at 0 with variance p0, and is predicted before each measurement.
    """
    scratch = Scratch(signal.sparkSession)
    cut = signal.select("series_id", "i", "t", "x", chunk_of(chunk).alias("chunk"))
    made = lambda x: kalman_elements(_plain(x), np.isfinite(x.to_numpy(float)), config)

    def end(rows: pd.DataFrame) -> pd.DataFrame:
        element = whole(made(rows.sort_values("i")["x"]))
        return pd.DataFrame({"series_id": rows["series_id"][:1], "chunk": rows["chunk"][:1], "n": len(rows), "end": [element.tolist()]})

    ends = scratch.stored(cut.groupBy("series_id", "chunk").applyInPandas(end, "series_id string, chunk long, n long, end array<double>"), "ends")
    prior = np.concatenate((np.zeros(6), (config.p0 * np.eye(2)).ravel(), np.zeros(6)))
    starts = scratch.stored(carried(ends, lambda state, n, end: composed(state[None], end[None])[0], prior), "starts")

    def passed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i").reset_index(drop=True)
        elements = made(rows["x"])
        elements[0] = composed(np.array(rows["start"][0])[None], elements[:1])[0]
        mean = prefixes(elements)[:, 4:6]
        return pd.DataFrame({"series_id": rows["series_id"], "i": rows["i"], "t": rows["t"], "re": mean[:, 0], "im": mean[:, 1]})

    found = scratch.stored(started(cut, starts).groupBy("series_id", "chunk").applyInPandas(passed, "series_id string, i long, t double, re double, im double"), "states")
    scratch.clear(found)
    return found


def kalman_trace(signal: DataFrame, config: KalmanConfig, chunk: int = CHUNK) -> DataFrame:
    """series_id, i, t, frequency_hz, rocof_hz_s: how far the filtered phasor turns from a sample to the next; nominal at the first."""
    order = Window.partitionBy("series_id", "chunk").orderBy("i")
    states = with_visitors(kalman_states(signal, config, chunk), chunk, 1)
    re, im = F.lag("re").over(order), F.lag("im").over(order)
    turn = F.atan2(F.col("im") * re - F.col("re") * im, F.col("re") * re + F.col("im") * im)
    found = states.withColumn("f", turn * F.lit(config.fs / (2 * math.pi))).filter(chunk_of(chunk) == F.col("chunk"))
    return rated(found.select("series_id", "i", "t", F.coalesce("f", F.lit(config.nominal_hz)).alias("frequency_hz")), chunk)
