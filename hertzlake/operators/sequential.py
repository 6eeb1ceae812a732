"""Estimators that are sequential by nature: a nonlinear state, and a step that takes a piece of a series on to the next state.

One step serves batch and stream. In batch a series' samples go through one task in order, and the state is handed from piece to piece (a piece is an Arrow
batch), so that a task holds a piece of a series and never the whole of it; different series are different tasks' work. In a stream the same state is kept
between micro-batches. A null or NaN sample leaves the loop to coast: time goes on without a measurement.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import KalmanConfig, LoopConfig, ZcdConfig
from .scan import sogi

State = tuple[float, ...]
#: From a state and the times and values of a piece: the next state, and the frequency and its rate at each sample.
Step = Callable[[State, np.ndarray, np.ndarray], tuple[State, list[float], list[float]]]

OUT = "series_id string, i long, t double, frequency_hz double, rocof_hz_s double"


def _wrapped(angle: float) -> float:
    """From -pi on and under pi."""
    return angle - 2 * math.pi * math.floor((angle + math.pi) / (2 * math.pi))


def _rate(f: float, t: float, f0: float, t0: float) -> float:
    return (f - f0) / (t - t0) if t > t0 else 0.0


def srf_pll(config: LoopConfig) -> tuple[State, Step]:
    """A phase-locked loop in the synchronous frame. State: the integrator's two numbers, angle, integral, time and frequency before (NaN: none).

    The integrator makes the quadrature; the part of both outputs across the loop's angle, over their magnitude, is the error, and
    proportional and integral parts of it make the frequency. On samples that are no tone the loop can be chaotic, so that a last bit grows to hertz within
    some ten thousand samples: the operations are those of the SQL twin, one by one.
    """
    a, b, g, _ = (x.tolist() if isinstance(x, np.ndarray) else x for x in sogi(config))
    (a11, a12), (a21, a22) = a
    nominal, period, gain = 2 * math.pi * config.nominal_hz, 1.0 / config.fs, config.ki / config.fs

    def step(state, times, values):
        s1, s2, angle, integral, t0, f0 = state
        out, rates = [], []
        for t, v in zip(times.tolist(), values.tolist()):
            error = 0.0
            if math.isfinite(v):
                x1, x2 = s1 + g[0] * v, s2 + g[1] * v
                s1, s2 = a11 * s1 + a12 * s2 + b[0] * v, a21 * s1 + a22 * s2 + b[1] * v
                size = math.sqrt(x1 * x1 + x2 * x2)
                if size > 0:
                    error = (x2 * math.cos(angle) - x1 * math.sin(angle)) / size
            integral += gain * error
            omega = nominal + config.kp * error + integral
            angle = _wrapped(angle + omega * period)
            f = omega / (2 * math.pi)
            rates.append(_rate(f, t, f0, t0))
            out.append(f)
            t0, f0 = t, f
        return (s1, s2, angle, integral, t0, f0), out, rates

    return (0.0, 0.0, 0.0, 0.0, math.nan, math.nan), step


def ekf_angle(config: KalmanConfig) -> tuple[State, Step]:
    """An extended Kalman filter of amplitude, phase and angular frequency, measured as amplitude times the phase's sine.

    State: the three, the upper triangle of their covariance by rows, time and frequency before (NaN: none).
    """
    period = 1.0 / config.fs

    def step(state, times, values):
        a, phase, omega, p11, p12, p13, p22, p23, p33, t0, f0 = state
        out, rates = [], []
        for t, v in zip(times.tolist(), values.tolist()):
            phase = _wrapped(phase + omega * period)
            p12, p22, p23 = p12 + period * p13, p22 + 2 * period * p23 + period * period * p33 + config.q_phase, p23 + period * p33
            p11, p33 = p11 + config.q, p33 + config.q_omega
            if math.isfinite(v):
                h1, h2 = math.sin(phase), a * math.cos(phase)
                c1, c2, c3 = p11 * h1 + p12 * h2, p12 * h1 + p22 * h2, p13 * h1 + p23 * h2
                spread = h1 * c1 + h2 * c2 + config.r
                gap = (v - a * h1) / spread
                a, phase, omega = a + c1 * gap, _wrapped(phase + c2 * gap), omega + c3 * gap
                p11, p12, p13 = p11 - c1 * c1 / spread, p12 - c1 * c2 / spread, p13 - c1 * c3 / spread
                p22, p23, p33 = p22 - c2 * c2 / spread, p23 - c2 * c3 / spread, p33 - c3 * c3 / spread
            f = omega / (2 * math.pi)
            rates.append(_rate(f, t, f0, t0))
            out.append(f)
            t0, f0 = t, f
        return (a, phase, omega, p11, p12, p13, p22, p23, p33, t0, f0), out, rates

    start = (1.0, 0.0, 2 * math.pi * config.nominal_hz, config.p0, 0.0, 0.0, config.p0, 0.0, config.p_omega, math.nan, math.nan)
    return start, step


def zcd_loop(config: ZcdConfig) -> tuple[State, Step]:
    """Zero crossings, sample by sample. State: value and time before, anchor, frequency, its rate, and whether there is an anchor; NaN: none."""
    low, high, epsilon = config.min_period_s, config.max_period_s, config.epsilon

    def step(state, times, values):
        x0, t0, anchor, f, r, anchored = state
        out, rates = [], []
        signs = (values > epsilon).astype(int) - (values < -epsilon).astype(int)
        before = np.concatenate(([int(x0 > epsilon) - int(x0 < -epsilon)], signs[:-1]))
        rule = {"neg_to_pos": (before == -1) & (signs >= 0), "pos_to_neg": (before == 1) & (signs <= 0)}.get(config.mode, (before != 0) & (signs != 0) & (before != signs))
        known = ~np.isnan(values)
        rule &= known & np.concatenate(([not math.isnan(x0)], known[:-1]))
        held = 0
        for k in np.flatnonzero(rule).tolist():
            out += [f] * (k - held)
            rates += [r] * (k - held)
            held = k
            a, ta = (x0, t0) if k == 0 else (float(values[k - 1]), float(times[k - 1]))
            time = ta + (float(times[k]) - ta) * (-a / (float(values[k]) - a))
            if not anchored:
                anchor, anchored = time, 1.0
            elif low <= time - anchor <= high:
                new = 1.0 / (time - anchor)
                r = math.nan if math.isnan(f) else (new - f) / (time - anchor)
                f, anchor = new, time
        out += [f] * (len(values) - held)
        rates += [r] * (len(values) - held)
        out = [config.nominal_hz if math.isnan(x) else x for x in out]
        rates = [0.0 if math.isnan(x) else x for x in rates]
        if len(values):
            x0, t0 = float(values[-1]), float(times[-1])
        return (x0, t0, anchor, f, r, anchored), out, rates

    return (math.nan, math.nan, math.nan, math.nan, math.nan, 0.0), step


def sequential_trace(signal: DataFrame, estimator: tuple[State, Step]) -> DataFrame:
    """OUT of each sample of signal (series_id, i, t, x), in the order of i."""
    start, step = estimator

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series: object = frames  # no series yet
        state = start
        for rows in frames:
            names = rows["series_id"].to_numpy(object)
            cuts = [0, *(np.flatnonzero([a is not b and a != b for a, b in zip(names[1:], names)]) + 1).tolist(), len(names)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                own = rows.iloc[low:high]
                if series is frames or names[low] != series:
                    series, state = names[low], start
                state, f, rate = step(state, own["t"].to_numpy(float), own["x"].to_numpy(float))
                yield pd.DataFrame({"series_id": own["series_id"], "i": own["i"], "t": own["t"], "frequency_hz": f, "rocof_hz_s": rate})

    ordered = signal.select("series_id", "i", "t", "x").repartition("series_id").sortWithinPartitions("series_id", "i")
    return ordered.mapInPandas(run, OUT)
