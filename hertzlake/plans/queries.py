"""The engine's queries over a data folder, and the same in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import IpdftConfig, KalmanConfig, LoopConfig, MultiConfig, NetworkConfig, RampStep, TaylorConfig, ZcdConfig
from ..functions.columns import angle, complex_of, has_status, magnitude
from ..operators import fusion, ipdft, metrics, pmu, products, scan, sequential, spectral, subspace, tablefunction, taylor, zcd
from ..schema import CHANNELS, RUN_RESULT, STATUS, rounded
from ..sources import signals
from ..sources.tables import STEP, event_signal, read_table
from ..storage import shared_path
from ..streaming import processors, stateful
from . import benchmark

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _out(df: DataFrame, *names: str, **digits: int) -> DataFrame:
    """df's columns, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*(rounded(n, digits.get(n, 6)).alias(n) if kinds[n] == "double" else F.col(n) for n in names))


# Parts of SQL twins. R rounds as schema.rounded does.
def R(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)::DOUBLE"


def _time(n: int, fs: float) -> str:
    return f"SELECT range AS i, range * (1.0::DOUBLE / {fs}::DOUBLE) AS t FROM range({n})"


def _generated(series: str, n: int, fs: float, f: str) -> str:
    return f"""SELECT '{series}' AS series_id, i, t, sin(2 * pi() * sum(f) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) / {fs}::DOUBLE) AS x, f AS f_true
    FROM (SELECT i, t, ({f})::DOUBLE AS f FROM ({_time(n, fs)}))"""


STEP_SQL = _generated("step", 20000, 5000.0, "CASE WHEN t >= 1.0 AND t < 2.0 THEN 59.5::DOUBLE ELSE 60.0::DOUBLE END")
EVENTS_SQL = f"""SELECT series_id, i, i * {STEP}::DOUBLE AS t, x FROM (
    SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i,
           value - avg(value) OVER (PARTITION BY event_type) AS x FROM events)"""
TRUE_SQL = f"SELECT *, 60.0::DOUBLE AS f_true FROM ({EVENTS_SQL})"
SIGNAL_OUT = ("series_id", "i", "t", "x", "f_true")
SIGNAL_SQL = f"series_id::VARCHAR AS series_id, i::BIGINT AS i, {R('t')} AS t, {R('x')} AS x, {R('f_true')} AS f_true"


def _crossed(signal: str, epsilon: float = 0.0, mode: str = "neg_to_pos", by: str = "series_id") -> str:
    """CTEs sig, lagged and marked."""
    sign = lambda x: f"CASE WHEN isnan({x}) THEN 0 WHEN {x} > {epsilon}::DOUBLE THEN 1 WHEN {x} < -{epsilon}::DOUBLE THEN -1 ELSE 0 END"
    rule = {"neg_to_pos": "s0 = -1 AND s1 >= 0", "pos_to_neg": "s0 = 1 AND s1 <= 0"}.get(mode, "s0 <> 0 AND s1 <> 0 AND s1 <> s0")
    return f"""sig AS ({signal}),
    lagged AS (SELECT *, lag(x) OVER w AS x0, lag(t) OVER w AS t0 FROM sig WINDOW w AS (PARTITION BY {by} ORDER BY i)),
    signed AS (SELECT *, {sign('x0')} AS s0, {sign('x')} AS s1 FROM lagged),
    marked AS (SELECT *, x0 IS NOT NULL AND {rule} AS crossed,
               CASE WHEN x0 IS NOT NULL AND {rule} THEN t0 + (t - t0) * (-x0 / nullif(x - x0, 0)) END AS tc FROM signed)"""


def _windowed(signal: str, mode: str = "neg_to_pos", by: str = "series_id", most: float = 1.0) -> str:
    """CTEs up to trace, without deadband."""
    return f"""{_crossed(signal, 0.0, mode, by)},
    gaps AS (SELECT *, tc - last_value(tc IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM marked),
    late AS (SELECT *, coalesce(bool_or(gap > {most}) OVER (PARTITION BY {by} ORDER BY i ROWS UNBOUNDED PRECEDING), false) AS late FROM gaps),
    acc AS (SELECT *, CASE WHEN gap >= 1e-6 AND NOT late THEN 1 / gap END AS f FROM late),
    rate AS (SELECT *, (f - last_value(f IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / gap AS r FROM acc),
    trace AS (SELECT *, coalesce(last_value(f IGNORE NULLS) OVER w, 60.0::DOUBLE) AS frequency_hz, coalesce(last_value(r IGNORE NULLS) OVER w, 0.0::DOUBLE) AS rocof_hz_s
              FROM rate WINDOW w AS (PARTITION BY {by} ORDER BY i ROWS UNBOUNDED PRECEDING))"""


def _stepwise(signal: str, epsilon: float, mode: str, low: float = 1e-6) -> str:
    """CTEs up to trace, by recursion over the crossings."""
    return f"""{_crossed(signal, epsilon, mode)},
    c AS (SELECT series_id, i, tc, row_number() OVER (PARTITION BY series_id ORDER BY i) AS n FROM marked WHERE crossed),
    steps AS (
      SELECT series_id, i, n, tc AS anchor, NULL::DOUBLE AS f, NULL::DOUBLE AS r, false AS ok FROM c WHERE n = 1
      UNION ALL
      SELECT c.series_id, c.i, c.n, CASE WHEN c.tc - s.anchor BETWEEN {low} AND 1.0 THEN c.tc ELSE s.anchor END,
             CASE WHEN c.tc - s.anchor BETWEEN {low} AND 1.0 THEN 1 / (c.tc - s.anchor) ELSE s.f END,
             CASE WHEN c.tc - s.anchor BETWEEN {low} AND 1.0 THEN (1 / (c.tc - s.anchor) - s.f) / (c.tc - s.anchor) ELSE s.r END,
             c.tc - s.anchor BETWEEN {low} AND 1.0
      FROM steps s JOIN c ON c.series_id = s.series_id AND c.n = s.n + 1),
    trace AS (
      SELECT m.series_id, m.i, m.t, coalesce(last_value(s.f IGNORE NULLS) OVER w, 60.0::DOUBLE) AS frequency_hz,
             coalesce(last_value(s.r IGNORE NULLS) OVER w, 0.0::DOUBLE) AS rocof_hz_s
      FROM marked m LEFT JOIN steps s ON s.series_id = m.series_id AND s.i = m.i AND s.ok
      WINDOW w AS (PARTITION BY m.series_id ORDER BY m.i ROWS UNBOUNDED PRECEDING))"""


TRACE_OUT = ("series_id", "i", "t", "frequency_hz", "rocof_hz_s")
TRACE_SQL = f"series_id::VARCHAR AS series_id, i::BIGINT AS i, {R('t')} AS t, {R('frequency_hz')} AS frequency_hz, {R('rocof_hz_s', 3)} AS rocof_hz_s"


def _trace(df: DataFrame) -> DataFrame:
    return _out(df, *TRACE_OUT, rocof_hz_s=3)


def _true(spark: SparkSession, folder: str) -> DataFrame:
    """The event signal with a true frequency, the nominal one."""
    return event_signal(spark, folder).withColumn("f_true", F.lit(60.0))


def _step(spark: SparkSession) -> DataFrame:
    return signals.frequency_step(spark, 60.0, 59.5, 1.0, 2.0, 4.0, 5000.0)


# generators


@query(f"SELECT {SIGNAL_SQL} FROM ({_generated('clean', 25000, 5000.0, '60.0')})")
def gen_clean(spark, folder):
    return _out(signals.clean(spark), *SIGNAL_OUT)


@query(f"SELECT {SIGNAL_SQL} FROM ({_generated('clean', 1000, 5000.0, '60.0::DOUBLE + 0.1::DOUBLE * t / 0.2::DOUBLE')})")
def gen_clean_drift(spark, folder):
    return _out(signals.clean(spark, 60.0, 0.1, 0.2), *SIGNAL_OUT)


@query(f"SELECT {SIGNAL_SQL} FROM ({STEP_SQL})")
def gen_step(spark, folder):
    return _out(_step(spark), *SIGNAL_OUT)


_RAMP = """CASE WHEN t < 2.0 THEN 60.0::DOUBLE WHEN t < 2.5 THEN 60.0::DOUBLE - 1.0::DOUBLE * (t - 2.0::DOUBLE) WHEN t < 4.0 THEN 59.5::DOUBLE
    WHEN t < 4.5 THEN 59.5::DOUBLE + 1.0::DOUBLE * (t - 4.0::DOUBLE) ELSE 60.0::DOUBLE END"""


@query(f"SELECT {SIGNAL_SQL} FROM ({_generated('ramp_step', 30000, 5000.0, _RAMP)})")
def gen_ramp_step(spark, folder):
    return _out(signals.ramp_step(spark, RampStep()), *SIGNAL_OUT)


@query(f"SELECT {SIGNAL_SQL} FROM (SELECT 'sine' AS series_id, i, t, sin(2 * pi() * 60.0 * t) AS x, 60.0::DOUBLE AS f_true FROM ({_time(2000, 10000.0)}))")
def gen_sine(spark, folder):
    return _out(signals.sine(spark), *SIGNAL_OUT)


@query(f"SELECT {SIGNAL_SQL} FROM ({_generated('chirp', 10000, 5000.0, '59.0::DOUBLE + 2.0::DOUBLE * t / 2.0::DOUBLE')})")
def gen_chirp(spark, folder):
    return _out(signals.chirp(spark), *SIGNAL_OUT)


@query(
    f"""SELECT {SIGNAL_SQL} FROM (SELECT series_id, i, t, f_true, CASE WHEN t >= 0.5 AND t < 0.6 THEN h * 0.7::DOUBLE ELSE h END AS x FROM (
    SELECT series_id, i, t, f_true, x + (0.02::DOUBLE + 0.1::DOUBLE * sin(3.0 * p) + 0.05::DOUBLE * sin(2.5 * p)) AS h
    FROM (SELECT *, 2 * pi() * sum(f_true) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) / 5000.0::DOUBLE AS p FROM ({_generated('clean', 5000, 5000.0, '60.0')}))))"""
)
def gen_harmonics_sag(spark, folder):
    tone = signals.clean(spark, duration=1.0)
    return _out(signals.with_sag(signals.with_harmonics(tone, {3.0: 0.1, 2.5: 0.05}, 0.02), 0.5, 0.6, 0.3), *SIGNAL_OUT)


# zero crossings


@query(
    f"""WITH {_crossed(EVENTS_SQL)} SELECT series_id::VARCHAR AS series_id, (row_number() OVER (PARTITION BY series_id ORDER BY i))::BIGINT AS n, i::BIGINT AS i, {R('tc')} AS t_cross
    FROM marked WHERE crossed"""
)
def zcd_crossings(spark, folder):
    return _out(zcd.crossings(event_signal(spark, folder)), "series_id", "n", "i", "t_cross")


_EVENT_STEP = f"SELECT series_id, i, t, CASE WHEN t >= 0.01 AND t < 0.02 THEN x - 20 ELSE x END AS x FROM ({EVENTS_SQL})"


@query(f"WITH {_windowed(_EVENT_STEP)} SELECT {TRACE_SQL} FROM trace")
def zcd_step_trace(spark, folder):
    """Events with a step in their level."""
    stepped = F.when((F.col("t") >= 0.01) & (F.col("t") < 0.02), F.col("x") - 20).otherwise(F.col("x"))
    return _trace(zcd.zcd_trace(event_signal(spark, folder).withColumn("x", stepped)))


@query(f"WITH {_windowed(EVENTS_SQL, 'pos_to_neg')} SELECT {TRACE_SQL} FROM trace")
def zcd_pos_to_neg(spark, folder):
    return _trace(zcd.zcd_trace_chunked(event_signal(spark, folder), ZcdConfig(mode="pos_to_neg")))


@query(f"WITH {_windowed(EVENTS_SQL)} SELECT {TRACE_SQL} FROM trace")
def zcd_rocof(spark, folder):
    return _trace(zcd.zcd_trace_chunked(event_signal(spark, folder)))


@query(f"WITH {_windowed(EVENTS_SQL)} SELECT {TRACE_SQL} FROM trace")
def zcd_chunked(spark, folder):
    return _trace(zcd.zcd_trace_chunked(event_signal(spark, folder), chunk=4096))


@query(f"WITH RECURSIVE {_stepwise(EVENTS_SQL, 0.0, 'either')} SELECT {TRACE_SQL} FROM trace")
def zcd_either(spark, folder):
    return _trace(zcd.zcd_trace_chunked(event_signal(spark, folder), ZcdConfig(mode="either")))


@query(f"WITH RECURSIVE {_stepwise(EVENTS_SQL, 20.0, 'neg_to_pos')} SELECT {TRACE_SQL} FROM trace")
def zcd_deadband(spark, folder):
    return _trace(zcd.zcd_trace_chunked(event_signal(spark, folder), ZcdConfig(epsilon=20.0)))


@query(f"WITH RECURSIVE {_stepwise(EVENTS_SQL, 0.0, 'neg_to_pos', 0.0006)} SELECT {TRACE_SQL} FROM trace")
def zcd_debounce_fold(spark, folder):
    return _trace(zcd.zcd_trace_chunked(event_signal(spark, folder), ZcdConfig(min_period_s=0.0006), fold=True))


_LATCH = f"SELECT series_id, i, t, CASE WHEN t >= 0.01 AND t < 0.025 THEN -1.0::DOUBLE ELSE x END AS x FROM ({EVENTS_SQL})"


@query(f"WITH {_windowed(_LATCH, most=0.01)} SELECT {TRACE_SQL} FROM trace")
def zcd_latch(spark, folder):
    """Events that stay below zero for longer than the longest period, after which the last frequency holds."""
    flat = F.when((F.col("t") >= 0.01) & (F.col("t") < 0.025), F.lit(-1.0)).otherwise(F.col("x"))
    return _trace(zcd.zcd_trace(event_signal(spark, folder).withColumn("x", flat), ZcdConfig(max_period_s=0.01)))


# interpolated DFT

FRAME = IpdftConfig(5000.0, 64)


def _bins(signal: str, n: int) -> str:
    """CTEs sig, parts, bins."""
    turn = f"2 * pi() / {n} * ((k * i) % {n})"
    return f"""sig AS ({signal}),
    parts AS (SELECT series_id, i, k, x * cos({turn}) AS c, x * sin({turn}) AS s FROM sig, (SELECT range AS k FROM range({n // 2}))),
    bins AS (SELECT * FROM (SELECT series_id, i, k, sqrt(pow(sum(c) OVER w, 2) + pow(sum(s) OVER w, 2)) AS mag FROM parts
             WINDOW w AS (PARTITION BY series_id, k ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) WHERE i >= {n - 1})"""


def _peaks(signal: str, n: int, fs: float) -> str:
    return f"""{_bins(signal, n)},
    near AS (SELECT *, lag(mag) OVER w AS l, lead(mag) OVER w AS r, row_number() OVER (PARTITION BY series_id, i ORDER BY mag DESC, k) AS rank
             FROM bins WINDOW w AS (PARTITION BY series_id, i ORDER BY k)),
    peak AS (SELECT series_id, i, k, CASE WHEN k >= 1 AND k < {n // 2 - 1} THEN coalesce(0.5 * (l - r) / nullif(l - 2 * mag + r, 0), 0.0) ELSE 0.0 END AS delta FROM near WHERE rank = 1),
    trace0 AS (SELECT sig.series_id, sig.i, t, coalesce((k + delta) * ({fs}::DOUBLE / {n}), 60.0::DOUBLE) AS frequency_hz FROM sig LEFT JOIN peak ON peak.series_id = sig.series_id AND peak.i = sig.i),
    trace AS (SELECT *, CASE WHEN t - lag(t) OVER w > 0 THEN (frequency_hz - lag(frequency_hz) OVER w) / nullif(t - lag(t) OVER w, 0) ELSE 0.0 END AS rocof_hz_s
              FROM trace0 WINDOW w AS (PARTITION BY series_id ORDER BY i))"""


@query(f"WITH {_bins(EVENTS_SQL, 64)} SELECT series_id::VARCHAR AS series_id, i::BIGINT AS i, k::BIGINT AS k, {R('mag')} AS mag FROM bins")
def ipdft_spectrum(spark, folder):
    return _out(ipdft.spectrum(event_signal(spark, folder), FRAME), "series_id", "i", "k", "mag")


@query(f"WITH {_peaks(EVENTS_SQL, 64, 5000.0)} SELECT series_id::VARCHAR AS series_id, i::BIGINT AS i, k::BIGINT AS k, {R('delta')} AS delta, {R('(k + delta) * (5000.0::DOUBLE / 64)', 4)} AS frequency_hz FROM peak")
def ipdft_peak(spark, folder):
    found = ipdft.peaks(ipdft.spectra(event_signal(spark, folder), FRAME), FRAME).filter(F.col("i") >= FRAME.frame_len - 1)
    return _out(found, "series_id", "i", "k", "delta", "frequency_hz", frequency_hz=4)


_IPDFT_SQL = f"series_id::VARCHAR AS series_id, i::BIGINT AS i, {R('t')} AS t, {R('frequency_hz', 4)} AS frequency_hz, {R('rocof_hz_s', 0)} AS rocof_hz_s"


@query(f"WITH {_peaks(EVENTS_SQL, 64, 5000.0)} SELECT {_IPDFT_SQL} FROM trace")
def ipdft_trace(spark, folder):
    return _out(ipdft.ipdft_trace(event_signal(spark, folder), FRAME), *TRACE_OUT, frequency_hz=4, rocof_hz_s=0)


@query(f"WITH {_peaks(EVENTS_SQL, 32, 5000.0)} SELECT {_IPDFT_SQL} FROM trace")
def ipdft_rocof(spark, folder):
    return _out(ipdft.ipdft_trace_sql(event_signal(spark, folder), IpdftConfig(5000.0, 32)), *TRACE_OUT, frequency_hz=4, rocof_hz_s=0)


def _rated(trace0: str) -> str:
    """CTE trace of CTE trace0 (series_id, i, t, frequency_hz)."""
    return f"""{trace0}, trace AS (SELECT *, CASE WHEN t - lag(t) OVER w > 0 THEN (frequency_hz - lag(frequency_hz) OVER w) / nullif(t - lag(t) OVER w, 0) ELSE 0.0 END AS rocof_hz_s
    FROM trace0 WINDOW w AS (PARTITION BY series_id ORDER BY i))"""


@query(f"WITH {_rated(_peaks(EVENTS_SQL, 64, 5000.0).split('trace0 AS')[0] + 'trace0 AS (SELECT sig.series_id, sig.i, t, coalesce(k * (5000.0::DOUBLE / 64), 60.0::DOUBLE) AS frequency_hz FROM sig LEFT JOIN peak ON peak.series_id = sig.series_id AND peak.i = sig.i)')} SELECT {_IPDFT_SQL} FROM trace")
def fft_peak_trace(spark, folder):
    found = ipdft.ipdft_trace(event_signal(spark, folder), FRAME, refined=False)
    return _out(found, *TRACE_OUT, frequency_hz=4, rocof_hz_s=0)


SHORT = IpdftConfig(5000.0, 100)
GRID = tuple(55.0 + 0.5 * k for k in range(21))
_FRAMES = "(PARTITION BY series_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
_POWERS = f"""sig AS ({EVENTS_SQL}), parts AS (SELECT series_id, i, t, f, x * cos(2 * pi() * f / 5000.0::DOUBLE * i) AS c, x * sin(2 * pi() * f / 5000.0::DOUBLE * i) AS s FROM sig, (SELECT 55.0::DOUBLE + 0.5 * range AS f FROM range(21))),
    powers AS (SELECT series_id, i, t, f, pow(sum(c) OVER w, 2) + pow(sum(s) OVER w, 2) AS p FROM parts WINDOW w AS (PARTITION BY series_id, f ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
    trace0 AS (SELECT series_id, i, any_value(t) AS t, CASE WHEN i >= 99 THEN arg_max(f, p) ELSE 60.0::DOUBLE END AS frequency_hz FROM powers GROUP BY series_id, i)"""


@query(f"WITH {_rated(_POWERS)} SELECT {_IPDFT_SQL} FROM trace")
def goertzel_trace(spark, folder):
    found = spectral.goertzel_trace(event_signal(spark, folder), SHORT, GRID)
    return _out(found, *TRACE_OUT, frequency_hz=4, rocof_hz_s=0)


_TURNS = f"""sig AS ({EVENTS_SQL}), parts AS (SELECT series_id, i, t, x * cos(2 * pi() / 100 * (i % 100)) AS c, x * sin(2 * pi() / 100 * (i % 100)) AS s FROM sig),
    sums AS (SELECT series_id, i, t, sum(c) OVER w AS c, sum(s) OVER w AS s FROM parts WINDOW w AS {_FRAMES}),
    steps AS (SELECT *, lag(c) OVER (PARTITION BY series_id ORDER BY i) AS c0, lag(s) OVER (PARTITION BY series_id ORDER BY i) AS s0 FROM sums),
    trace0 AS (SELECT series_id, i, t, CASE WHEN i >= 100 THEN 50.0::DOUBLE + atan2(c * s0 - s * c0, c * c0 + s * s0) * 5000.0::DOUBLE / (2 * pi()) ELSE 60.0::DOUBLE END AS frequency_hz FROM steps)"""


@query(f"WITH {_rated(_TURNS)} SELECT {_IPDFT_SQL} FROM trace")
def sliding_dft_trace(spark, folder):
    found = spectral.sliding_dft_trace(event_signal(spark, folder), SHORT)
    return _out(found, *TRACE_OUT, frequency_hz=4, rocof_hz_s=0)


@query(
    f"""SELECT series_id::VARCHAR AS series_id, i::BIGINT AS i, {R('any_value(t)')} AS t, {R('median(frequency_hz)', 4)} AS frequency_hz, {R('median(rocof_hz_s)', 0)} AS rocof_hz_s FROM (
    SELECT series_id, i, t, frequency_hz, rocof_hz_s FROM (WITH {_windowed(EVENTS_SQL)} SELECT * FROM trace) UNION ALL
    SELECT series_id, i, t, frequency_hz, rocof_hz_s FROM (WITH {_peaks(EVENTS_SQL, 64, 5000.0)} SELECT * FROM trace) UNION ALL
    SELECT series_id, i, t, frequency_hz, rocof_hz_s FROM (WITH {_rated(_TURNS)} SELECT * FROM trace)) GROUP BY series_id, i"""
)
def ensemble_trace(spark, folder):
    signal = event_signal(spark, folder)
    parts = [zcd.zcd_trace_chunked(signal), ipdft.ipdft_trace(signal, FRAME), spectral.sliding_dft_trace(signal, SHORT)]
    return _out(spectral.ensemble_trace(parts), *TRACE_OUT, frequency_hz=4, rocof_hz_s=0)


_PRONY = f"""sig AS ({EVENTS_SQL}), near AS (SELECT *, lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY i)),
    sums AS (SELECT *, sum(x1 * x1) OVER w AS s11, sum(x1 * x2) OVER w AS s12, sum(x2 * x2) OVER w AS s22, sum(x * x1) OVER w AS s01, sum(x * x2) OVER w AS s02, count(x * x2) OVER w AS n
             FROM near WINDOW w AS {_FRAMES}),
    fit AS (SELECT *, (s01 * s22 - s02 * s12) / nullif(s11 * s22 - s12 * s12, 0) AS a, (s02 * s11 - s01 * s12) / nullif(s11 * s22 - s12 * s12, 0) AS b FROM sums),
    trace0 AS (SELECT series_id, i, t, coalesce(CASE WHEN n = 100 AND a * a + 4 * b < 0 THEN atan2(sqrt(-a * a - 4 * b), a) * 5000.0::DOUBLE / (2 * pi()) END, 60.0::DOUBLE) AS frequency_hz FROM fit)"""


@query(f"WITH {_rated(_PRONY)} SELECT {_IPDFT_SQL} FROM trace")
def prony_trace(spark, folder):
    return _out(spectral.prony_trace(event_signal(spark, folder), SHORT), *TRACE_OUT, frequency_hz=4, rocof_hz_s=0)


_PAIRS = [(a, b) for a in range(4) for b in range(a, 4)]


@query(
    f"""WITH s AS (SELECT series_id, i // 100 AS block, i, x FROM ({EVENTS_SQL})),
    ahead AS (SELECT series_id, block, x AS x0, {', '.join(f'lead(x, {k}) OVER w AS x{k}' for k in range(1, 4))} FROM s WINDOW w AS (PARTITION BY series_id, block ORDER BY i))
    SELECT series_id::VARCHAR AS series_id, block::BIGINT AS block, count(*)::BIGINT AS n, {', '.join(f"{R(f'avg(x{a} * x{b})')} AS r{a}{b}" for a, b in _PAIRS)} FROM ahead WHERE x0 + x1 + x2 + x3 IS NOT NULL GROUP BY 1, 2"""
)
def block_covariances(spark, folder):
    found = subspace.block_covariances(event_signal(spark, folder), SHORT, 4)
    flat = found.select("series_id", F.col("block").cast("long").alias("block"), "n", *(F.col("r")[k].alias(f"r{a}{b}") for k, (a, b) in enumerate(_PAIRS)))
    return _out(flat, *flat.columns)


@query()
def esprit_trace(spark, folder):
    return _out(subspace.subspace_trace(event_signal(spark, folder), SHORT), *TRACE_OUT, frequency_hz=4, rocof_hz_s=0)


@query()
def music_trace(spark, folder):
    return _out(subspace.subspace_trace(event_signal(spark, folder), SHORT, GRID), *TRACE_OUT, frequency_hz=4, rocof_hz_s=0)


# recursive estimators: the twins go from sample to sample


def D(x: float) -> str:
    return f"({float(x)!r}::DOUBLE)"


def _recursion(state: dict[str, float], *steps: dict[str, str]) -> str:
    """CTEs sig and walk (series_id, i, t, the state after the sample). state has its start; each step has the columns that it sets, v is the sample, 0 if there is none, and known whether there is."""
    names = list(state)
    inner = "SELECT sig.series_id, sig.i, sig.t, coalesce(sig.x, 0.0) AS v, sig.x IS NOT NULL AS known, " + ", ".join(f"w.{n}" for n in names) + " FROM walk w JOIN sig ON sig.series_id = w.series_id AND sig.i = w.i + 1"
    for step in steps:
        inner = f"SELECT * REPLACE ({', '.join(f'{x} AS {n}' for n, x in step.items() if n in names)}) FROM ({inner})" if set(step) <= set(names) else f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in step.items())} FROM ({inner})"
    return f"""sig AS MATERIALIZED ({EVENTS_SQL}),
    walk AS (SELECT series_id, -1::BIGINT AS i, 0.0::DOUBLE AS t, {', '.join(f'{D(x)} AS {n}' for n, x in state.items())} FROM (SELECT DISTINCT series_id FROM sig)
             UNION ALL SELECT series_id, i, t, {', '.join(names)} FROM ({inner}))"""


def _walked(frequency: str) -> str:
    return _rated(f"trace0 AS (SELECT series_id, i, t, {frequency} AS frequency_hz FROM walk WHERE i >= 0)")


LOOP = LoopConfig(5000.0)
_A, _B, _G, _OMEGA = scan.sogi(LOOP)
_INTEGRATOR = {"x1": f"s1 + {D(_G[0])} * v", "x2": f"s2 + {D(_G[1])} * v"}
_ADVANCED = {f"s{k + 1}": f"CASE WHEN known THEN {D(_A[k][0])} * s1 + {D(_A[k][1])} * s2 + {D(_B[k])} * v ELSE s{k + 1} END" for k in (0, 1)}
_KEEP = math.exp(-1.0 / (LOOP.fs * LOOP.tau_s))
_SOGI = _recursion(
    {"s1": 0.0, "s2": 0.0, "p": 0.0, "q": 0.0}, _INTEGRATOR,
    {"p": f"{D(_KEEP)} * p + {D(1 - _KEEP)} * (v - x1) * x2", "q": f"{D(_KEEP)} * q + {D(1 - _KEEP)} * x2 * x2", **{k: x.replace("CASE WHEN known THEN", "").split("ELSE")[0] for k, x in _ADVANCED.items()}},
)
_SOGI_HZ = f"coalesce(atan({D(_OMEGA / (2 * LOOP.fs))} * sqrt(greatest(0.0, 1 - {D(LOOP.k)} * p / CASE WHEN q > 0 THEN q END))) * {D(LOOP.fs / math.pi)}, 60.0::DOUBLE)"
_LOOP_SQL = f"series_id::VARCHAR AS series_id, i::BIGINT AS i, {R('t')} AS t, {R('frequency_hz', 4)} AS frequency_hz, {R('rocof_hz_s', 1)} AS rocof_hz_s"


def _loop(df: DataFrame) -> DataFrame:
    return _out(df, *TRACE_OUT, frequency_hz=4, rocof_hz_s=1)


@query(f"WITH RECURSIVE {_SOGI}, {_walked(_SOGI_HZ)} SELECT {_LOOP_SQL} FROM trace")
def sogi_fll_trace(spark, folder):
    return _loop(scan.sogi_fll_trace(event_signal(spark, folder), LOOP))


_RLS = _recursion(
    {"x1": 0.0, "x2": 0.0, "n": 0.0, "num": 0.0, "den": 0.0},
    {"num": "0.99::DOUBLE * num + CASE WHEN n >= 2 AND known THEN x1 * (v + x2) ELSE 0.0 END", "den": "0.99::DOUBLE * den + CASE WHEN n >= 2 AND known THEN x1 * x1 ELSE 0.0 END"},
    {"x2": "x1", "x1": "v", "n": "n + 1"},
)
_RLS_HZ = "CASE WHEN den > 0 AND abs(num / den / 2) <= 1 THEN acos(num / den / 2) * 5000.0::DOUBLE / (2 * pi()) ELSE 60.0::DOUBLE END"


@query(f"WITH RECURSIVE {_RLS}, {_walked(_RLS_HZ)} SELECT {_LOOP_SQL} FROM trace")
def rls_trace(spark, folder):
    return _loop(spectral.rls_trace(event_signal(spark, folder), SHORT))


_WRAP = lambda x: f"({x}) - 2 * pi() * floor((({x}) + pi()) / (2 * pi()))"
_PLL = _recursion(
    {"s1": 0.0, "s2": 0.0, "angle": 0.0, "integral": 0.0, "omega": 0.0}, _INTEGRATOR,
    {"error": "CASE WHEN known AND sqrt(x1 * x1 + x2 * x2) > 0 THEN (x2 * cos(angle) - x1 * sin(angle)) / sqrt(x1 * x1 + x2 * x2) ELSE 0.0 END"},
    {"integral": f"integral + {D(LOOP.ki / LOOP.fs)} * error", **_ADVANCED},
    {"omega": f"{D(2 * math.pi * LOOP.nominal_hz)} + {D(LOOP.kp)} * error + integral"},
    {"angle": _WRAP(f"angle + omega * {D(1 / LOOP.fs)}")},
)


@query(f"WITH RECURSIVE {_PLL}, {_walked('omega / (2 * pi())')} SELECT {_LOOP_SQL} FROM trace")
def srf_pll_trace(spark, folder):
    return _loop(sequential.sequential_trace(event_signal(spark, folder), sequential.srf_pll(LOOP)))


#: Events are far from a tone of amplitude 1.
FILTER = KalmanConfig(5000.0, q=1.0, r=1000.0, p0=100.0)
_C, _S = math.cos(2 * math.pi * 60.0 / 5000.0), math.sin(2 * math.pi * 60.0 / 5000.0)
_KALMAN = _recursion(
    {"m1": 0.0, "m2": 0.0, "p11": FILTER.p0, "p12": 0.0, "p22": FILTER.p0, "turn": 0.0},
    {"m1": f"{D(_C)} * m1 - {D(_S)} * m2", "m2": f"{D(_S)} * m1 + {D(_C)} * m2",
     "p11": f"{D(_C * _C)} * p11 - {D(2 * _C * _S)} * p12 + {D(_S * _S)} * p22 + {D(FILTER.q)}", "p12": f"{D(_C * _S)} * (p11 - p22) + {D(_C * _C - _S * _S)} * p12",
     "p22": f"{D(_S * _S)} * p11 + {D(2 * _C * _S)} * p12 + {D(_C * _C)} * p22 + {D(FILTER.q)}"},
    {"k1": f"CASE WHEN known THEN p11 / (p11 + {D(FILTER.r)}) ELSE 0.0 END", "k2": f"CASE WHEN known THEN p12 / (p11 + {D(FILTER.r)}) ELSE 0.0 END"},
    {"m1": "m1 + k1 * (v - m1)", "m2": "m2 + k2 * (v - m1)", "p11": "p11 - k1 * p11", "p12": "p12 - k1 * p12", "p22": "p22 - k2 * p12"},
)
_TURNED = f"""turned AS (SELECT *, lag(m1) OVER w AS b1, lag(m2) OVER w AS b2 FROM walk WHERE i >= 0 WINDOW w AS (PARTITION BY series_id ORDER BY i)),
    {_rated(f"trace0 AS (SELECT series_id, i, t, coalesce(atan2(m2 * b1 - m1 * b2, m1 * b1 + m2 * b2) * {D(5000.0 / (2 * math.pi))}, 60.0::DOUBLE) AS frequency_hz FROM turned)")}"""


@query(f"WITH RECURSIVE {_KALMAN}, {_TURNED} SELECT {_LOOP_SQL} FROM trace")
def kalman_trace(spark, folder):
    return _loop(scan.kalman_trace(event_signal(spark, folder), FILTER))


_T = 1 / 5000.0
_EKF = _recursion(
    {"a": 1.0, "phase": 0.0, "omega": 2 * math.pi * 60.0, "p11": FILTER.p0, "p12": 0.0, "p13": 0.0, "p22": FILTER.p0, "p23": 0.0, "p33": FILTER.p_omega},
    {"phase": _WRAP(f"phase + omega * {D(_T)}"), "p11": f"p11 + {D(FILTER.q)}", "p12": f"p12 + {D(_T)} * p13", "p22": f"p22 + {D(2 * _T)} * p23 + {D(_T * _T)} * p33 + {D(FILTER.q_phase)}",
     "p23": f"p23 + {D(_T)} * p33", "p33": f"p33 + {D(FILTER.q_omega)}"},
    {"h1": "sin(phase)", "h2": "a * cos(phase)"},
    {"c1": "p11 * h1 + p12 * h2", "c2": "p12 * h1 + p22 * h2", "c3": "p13 * h1 + p23 * h2"},
    {"spread": f"h1 * c1 + h2 * c2 + {D(FILTER.r)}", "gap": f"CASE WHEN known THEN (v - a * h1) / (h1 * c1 + h2 * c2 + {D(FILTER.r)}) ELSE 0.0 END"},
    {"a": "a + c1 * gap", "phase": f"CASE WHEN known THEN {_WRAP('phase + c2 * gap')} ELSE phase END", "omega": "omega + c3 * gap",
     **{f"p{j}{k}": f"p{j}{k} - CASE WHEN known THEN c{j} * c{k} / spread ELSE 0.0 END" for j, k in ((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3))}},
)


@query(f"WITH RECURSIVE {_EKF}, {_walked('omega / (2 * pi())')} SELECT {_LOOP_SQL} FROM trace")
def ekf_trace(spark, folder):
    return _loop(sequential.sequential_trace(event_signal(spark, folder), sequential.ekf_angle(FILTER)))


FITTED = TaylorConfig(5000.0)


def _fitted_sql() -> str:
    """CTEs up to trace: the sums of each frame with the bank's weights."""
    n, bank, names = FITTED.frame_len, taylor.filter_bank(FITTED), ("a0", "b0", "a1", "b1", "a2", "b2")
    weights = ", ".join(f"unnest([{', '.join(repr(float(x)) for x in row)}]::DOUBLE[]) AS {name}" for name, row in zip(names, bank))
    sums = ", ".join(f"sum(x.x * w.{name}) AS {name}" for name in names)
    return f"""sig AS MATERIALIZED ({EVENTS_SQL}), w AS (SELECT unnest(range({n})) AS j, {weights}),
    sums AS (SELECT x.series_id, x.i + {n - 1} - w.j AS i, {sums}, count(x.x) AS n FROM sig x, w GROUP BY ALL),
    power AS (SELECT *, a0 * a0 + b0 * b0 AS z FROM sums WHERE n = {n}),
    slope AS (SELECT *, (a1 * a0 + b1 * b0) / z AS re, (b1 * a0 - a1 * b0) / z AS im, (b2 * a0 - a2 * b0) / z AS bend FROM power WHERE z > 0),
    trace AS (SELECT series_id, i, t, coalesce(60.0::DOUBLE + im / (2 * pi()), 60.0::DOUBLE) AS frequency_hz, coalesce((2 * bend - 2 * re * im) / (2 * pi()), 0.0::DOUBLE) AS rocof_hz_s
              FROM sig LEFT JOIN slope USING (series_id, i))"""


@query(f"WITH {_fitted_sql()} SELECT {_LOOP_SQL} FROM trace")
def taylor_fourier_trace(spark, folder):
    return _loop(taylor.taylor_fourier_trace(event_signal(spark, folder), FITTED))


# several channels

def _event_types(spark: SparkSession, folder: str) -> dict[str, str]:
    """The first five event types in order, as channels."""
    types = read_table(spark, folder, "events").select("event_type").filter("event_type is not null").distinct()
    return dict(zip((x[0] for x in types.orderBy("event_type").limit(5).collect()), CHANNELS))


_TYPES_SQL = "SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)"
_LONG_SQL = f"""SELECT 'pmu/' || k AS series_id, k, g.i, g.t, coalesce(s.x, 0.0) AS x FROM
    (SELECT i, max(t) AS t FROM ({EVENTS_SQL}) GROUP BY i) g CROSS JOIN ({_TYPES_SQL}) y LEFT JOIN ({EVENTS_SQL}) s ON s.series_id = y.event_type AND s.i = g.i WHERE k <= 3"""


def _multi_sql(agg: str) -> str:
    return f"""WITH {_windowed(_LONG_SQL)} SELECT 'pmu' AS series_id, i::BIGINT AS i, {R('any_value(t)')} AS timestamp_utc, {R(f'{agg}(frequency_hz)')} AS frequency_hz,
    {R(f'{agg}(rocof_hz_s)', 3)} AS rocof_hz_s, 0::INTEGER AS status_word FROM trace GROUP BY i"""


#: Samples of a channel or node that a task works on together.
CHUNK = 1 << 20


def _multi(spark: SparkSession, folder: str, agg: str) -> DataFrame:
    wide = pmu.pivoted(event_signal(spark, folder), _event_types(spark, folder))
    found = fusion.multi_channel(wide, MultiConfig(agg=agg), CHUNK)
    return _out(found, "series_id", "i", "timestamp_utc", "frequency_hz", "rocof_hz_s", "status_word", rocof_hz_s=3)


@query(_multi_sql("median"))
def multi_median(spark, folder):
    return _multi(spark, folder, "median")


@query(_multi_sql("avg"))
def multi_mean(spark, folder):
    return _multi(spark, folder, "mean")


@query(
    f"""WITH {_windowed(_LONG_SQL)} SELECT 'pmu' AS series_id, 'V' || k AS channel, i::BIGINT AS i, {R('x')} AS x, {R('frequency_hz')} AS frequency_hz FROM trace"""
)
def multi_channels(spark, folder):
    wide = pmu.pivoted(event_signal(spark, folder), _event_types(spark, folder))
    return _out(fusion.channel_traces(wide, MultiConfig(), CHUNK), "series_id", "channel", "i", "x", "frequency_hz")


# networks


def _ring(spark: SparkSession, folder: str) -> DataFrame:
    """Nations of a region, each with the two before and after it in order, and one edge to nowhere and to itself."""
    nation = read_table(spark, folder, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").cast("string").alias("n"), "n_nationkey")
    order = Window.partitionBy("r").orderBy("n_nationkey")
    placed = nation.select("r", "n", F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy("r")).alias("size"))
    a, b = placed.alias("a"), placed.alias("b")
    near = (F.col("b.k") == F.col("a.k") % F.col("a.size") + 1) | (F.col("a.k") == F.col("b.k") % F.col("b.size") + 1)
    ring = a.join(b, (F.col("a.r") == F.col("b.r")) & near).select(F.col("a.n").alias("src"), F.col("b.n").alias("dst"))
    return ring.union(spark.createDataFrame([("0", "nowhere"), ("1", "1"), ("2", "3"), ("2", "3")], "src string, dst string"))


_RING_SQL = """placed AS (SELECT n_regionkey AS r, n_nationkey::VARCHAR AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, count(*) OVER (PARTITION BY n_regionkey) AS size FROM nation),
    edge AS (SELECT a.n AS src, b.n AS dst FROM placed a JOIN placed b ON a.r = b.r AND (b.k = a.k % a.size + 1 OR a.k = b.k % b.size + 1)
             UNION ALL VALUES ('0', 'nowhere'), ('1', '1'), ('2', '3'), ('2', '3'))"""
_WEIGHTS_SQL = """degree AS (SELECT src, count(*) AS d FROM edge GROUP BY src),
    weighed AS (SELECT p.src, p.dst, n, 1.0::DOUBLE / (1 + greatest(a.d, coalesce(b.d, 1))) AS w FROM (SELECT src, dst, count(*) AS n FROM edge GROUP BY src, dst) p JOIN degree a ON a.src = p.src LEFT JOIN degree b ON b.src = p.dst),
    weight AS (SELECT src, dst, w FROM weighed WHERE src <> dst UNION ALL SELECT src, src, greatest(0.0, 1.0 - sum(n * w)) FROM weighed GROUP BY src)"""


@query(f"WITH {_RING_SQL}, {_WEIGHTS_SQL} SELECT src, dst, {R('w')} AS w FROM weight")
def metropolis_weights(spark, folder):
    return _out(fusion.metropolis_weights(_ring(spark, folder)), "src", "dst", "w")


def _nation_values(spark: SparkSession, folder: str) -> DataFrame:
    customers = read_table(spark, folder, "customer").groupBy(F.col("c_nationkey").cast("string").alias("node"))
    return customers.agg((F.lit(60.0) + F.avg("c_acctbal") / 1e5).alias("f"))


@query(
    f"""WITH {_RING_SQL}, val AS (SELECT c_nationkey::VARCHAR AS node, 60.0::DOUBLE + avg(c_acctbal) / 1e5 AS f FROM customer GROUP BY 1),
    edges AS (SELECT * FROM edge), {_WEIGHTS_SQL.replace('FROM edge', "FROM (SELECT * FROM edge WHERE src IN (SELECT node FROM val))")},
    around AS (SELECT e.src AS node, sum(w.w * coalesce(b.f, a.f)) AS s FROM edge e JOIN weight w ON w.src = e.src AND w.dst = e.dst JOIN val a ON a.node = e.src LEFT JOIN val b ON b.node = e.dst GROUP BY e.src)
    SELECT v.node, {R('0.5 * v.f + 0.5 * (coalesce(o.w, 1.0) * v.f + coalesce(a.s, 0.0))')} AS f
    FROM val v LEFT JOIN weight o ON o.src = v.node AND o.dst = v.node LEFT JOIN around a ON a.node = v.node"""
)
def consensus_step(spark, folder):
    return _out(fusion.consensus_step(_nation_values(spark, folder), _ring(spark, folder), 0.5), "node", "f")


def _nodes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples of all event types as nodes, the edges of a ring of their order, the nodes."""
    types = read_table(spark, folder, "events").filter("event_type is not null").select(F.col("event_type").alias("node")).distinct()
    placed = signals.numbered(types, "node")
    size = placed.count()
    after = placed.select(F.col("node").alias("dst"), F.pmod(F.col("k") - 1, F.lit(max(1, size))).alias("k"))
    ring = placed.join(after, "k").select(F.col("node").alias("src"), "dst")
    samples = event_signal(spark, folder).select("i", "t", F.col("series_id").alias("node"), F.col("x").alias("value"))
    return samples, ring.union(ring.select("dst", "src")), placed.select("node")


def _fused(spark: SparkSession, folder: str, **config) -> DataFrame:
    """A row for each step and node: its own estimate and the fused one."""
    samples, edges, nodes = _nodes(spark, folder)
    found = fusion.fused_nodes(samples, edges, NetworkConfig(nodes, **config), CHUNK)
    return _out(found, "i", "t", "node", "local_hz", "local_rocof_hz_s", "frequency_hz", "rocof_hz_s", rocof_hz_s=3, local_rocof_hz_s=3)


_NODE_TYPES = "SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k, count(*) OVER () AS size FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)"
_NODE_TRACES = _windowed(
    f"""SELECT y.event_type AS series_id, g.i, g.t, coalesce(s.x, 0.0) AS x FROM (SELECT i, max(t) AS t FROM ({EVENTS_SQL}) GROUP BY i) g
    CROSS JOIN ({_NODE_TYPES}) y LEFT JOIN ({EVENTS_SQL}) s ON s.series_id = y.event_type AND s.i = g.i"""
)
_FUSED_OUT = f"""t.i::BIGINT AS i, {R('t.t')} AS t, t.series_id::VARCHAR AS node, {R('t.frequency_hz')} AS local_hz, {R('t.rocof_hz_s', 3)} AS local_rocof_hz_s,
    {R('h.f')} AS frequency_hz, {R('h.r', 3)} AS rocof_hz_s FROM trace t JOIN"""


@query(f"WITH {_NODE_TRACES} SELECT {_FUSED_OUT} (SELECT i, avg(frequency_hz) AS f, avg(rocof_hz_s) AS r FROM trace GROUP BY i) h ON h.i = t.i")
def fused_mean(spark, folder):
    return _fused(spark, folder, fuse="mean")


@query(
    f"""WITH {_NODE_TRACES}, ring AS ({_NODE_TYPES}),
    edge AS (SELECT a.event_type AS src, b.event_type AS dst FROM ring a JOIN ring b ON b.k = (a.k + 1) % a.size
             UNION ALL SELECT a.event_type, b.event_type FROM ring a JOIN ring b ON b.k = (a.k + a.size - 1) % a.size), {_WEIGHTS_SQL},
    around AS (SELECT a.i, a.series_id, sum(w.w * coalesce(b.frequency_hz, a.frequency_hz)) AS s FROM trace a JOIN edge e ON e.src = a.series_id
               JOIN weight w ON w.src = e.src AND w.dst = e.dst LEFT JOIN trace b ON b.i = a.i AND b.series_id = e.dst GROUP BY a.i, a.series_id),
    mixed AS (SELECT v.i, v.rocof_hz_s AS r, 0.5 * v.frequency_hz + 0.5 * (coalesce(o.w, 1.0) * v.frequency_hz + coalesce(a.s, 0.0)) AS f
              FROM trace v LEFT JOIN weight o ON o.src = v.series_id AND o.dst = v.series_id LEFT JOIN around a ON a.i = v.i AND a.series_id = v.series_id)
    SELECT {_FUSED_OUT} (SELECT i, avg(f) AS f, avg(r) AS r FROM mixed GROUP BY i) h ON h.i = t.i"""
)
def fused_consensus(spark, folder):
    return _fused(spark, folder, alpha=0.5)


# PMU records


@query("SELECT event_id::BIGINT AS event_id, round(value, 6)::DOUBLE AS value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND abs(value) < 'inf'::DOUBLE AND event_id % 7 <> 0")
def pmu_validate(spark, folder):
    rows = read_table(spark, folder, "events").select("event_id", F.col("value").alias("V1"))
    broken = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("V1"))
    samples = rows.select("event_id", broken.alias("V1"), *(F.lit(0.0).alias(c) for c in CHANNELS[1:]), F.lit(0.0).alias("timestamp"))
    return _out(pmu.validated(samples), "event_id", "V1").withColumnRenamed("V1", "value")


@query(
    f"""SELECT 'pmu' AS series_id, event_id::BIGINT AS i, {R('event_id * 0.0002::DOUBLE')} AS "TIMESTAMP_UTC", 60.0::DOUBLE AS "FREQUENCY_HZ", 0.0::DOUBLE AS "ROCOF_HZ_S", 0::INTEGER AS "STATUS_WORD",
    {R('sqrt(pow(value - 50, 2) + pow(user_id / 10.0::DOUBLE, 2))')} AS "V1_MAG", {R('atan2(user_id / 10.0::DOUBLE, value - 50)')} AS "V1_ANGLE_RAD" FROM events"""
)
def pmu_standard_row(spark, folder):
    rows = read_table(spark, folder, "events")
    z = complex_of(F.col("value") - 50, F.col("user_id") / F.lit(10.0))
    found = rows.select(
        F.lit("pmu").alias("series_id"), F.col("event_id").alias("i"), (F.col("event_id") * 0.0002).alias("timestamp_utc"), F.lit(60.0).alias("frequency_hz"), F.lit(0.0).alias("rocof_hz_s"),
        F.lit(0).alias("status_word"), F.create_map(F.lit("V1"), z).alias("phasors"),
    )
    flat = pmu.standard_rows(found, ("V1",))
    return _out(flat, *flat.columns)


@query(
    """SELECT event_id::BIGINT AS event_id, (user_id % 16)::INTEGER AS status_word, user_id % 16 = 0 AS ok, (user_id % 16) & 1 <> 0 AS data_error, (user_id % 16) & 2 <> 0 AS clock_not_synced,
    (user_id % 16) & 4 <> 0 AS pll_unlocked, (user_id % 16) & 8 <> 0 AS over_range FROM events"""
)
def pmu_status_flags(spark, folder):
    word = (F.col("user_id") % 16).cast("int")
    rows = read_table(spark, folder, "events").select("event_id", word.alias("status_word"))
    return rows.select("event_id", "status_word", *(has_status(F.col("status_word"), x).alias(x.lower()) for x in STATUS))


@query(f"WITH {_windowed(EVENTS_SQL)} SELECT {TRACE_SQL.replace('AS t,', 'AS timestamp_utc,')}, 0::INTEGER AS status_word FROM trace")
def pmu_zcd_estimates(spark, folder):
    found = pmu.zcd_estimates(pmu.as_samples(event_signal(spark, folder)), chunk=CHUNK)
    return _out(found, "series_id", "i", "timestamp_utc", "frequency_hz", "rocof_hz_s", "status_word", rocof_hz_s=3)


@query(
    f"""WITH {_peaks(EVENTS_SQL, 64, 5000.0)}
    SELECT t.series_id::VARCHAR AS series_id, t.i::BIGINT AS i, {R('t.t')} AS "TIMESTAMP_UTC", {R('t.frequency_hz', 4)} AS "FREQUENCY_HZ", {R('t.rocof_hz_s', 0)} AS "ROCOF_HZ_S", 0::INTEGER AS "STATUS_WORD",
    {R('abs(sig.x)')} AS "V1_MAG", {R('CASE WHEN sig.x < 0 THEN pi() ELSE 0.0 END')} AS "V1_ANGLE_RAD", 0.0::DOUBLE AS "I3_MAG", 0.0::DOUBLE AS "I3_ANGLE_RAD"
    FROM trace t JOIN sig ON sig.series_id = t.series_id AND sig.i = t.i"""
)
def pmu_ipdft_estimates(spark, folder):
    flat = pmu.standard_rows(pmu.ipdft_estimates(pmu.as_samples(event_signal(spark, folder)), FRAME), ("V1", "I3"))
    return _out(flat, *flat.columns, FREQUENCY_HZ=4, ROCOF_HZ_S=0)


# scores


def _scenarios(spark: SparkSession, folder: str) -> dict[str, benchmark.Scenario]:
    """The first five event types in order, a scenario each, with the nominal frequency as the true one."""
    signal = _true(spark, folder)
    return {name: lambda _, name=name: signal.filter(F.col("series_id") == name) for name in _event_types(spark, folder)}


_ESTIMATORS = {"zcd": benchmark.Zcd(), "ipdft": benchmark.Ipdft(FRAME)}
_ESTIMATORS_SQL = {"zcd": _windowed, "ipdft": lambda signal: _peaks(signal, 64, 5000.0)}
_FIRST = "(SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL ORDER BY event_type LIMIT 5)"
_RUN_OUT = ("scenario", "name", "n_samples", "rmse")


def _matrix(spark: SparkSession, folder: str, *names: str, **options) -> DataFrame:
    """run_matrix over the events' scenarios; without events no row."""
    scenarios = _scenarios(spark, folder)
    if not scenarios:
        return spark.createDataFrame([], RUN_RESULT)
    return benchmark.run_matrix(spark, scenarios, {n: _ESTIMATORS[n] for n in names}, **options)


def _scored_sql(name: str, where: str = "true") -> str:
    return f"""SELECT series_id::VARCHAR AS scenario, '{name}' AS name, count(*)::BIGINT AS n_samples, {R('sqrt(avg(pow(frequency_hz - 60.0, 2)))')} AS rmse
    FROM (WITH {_ESTIMATORS_SQL[name](EVENTS_SQL)} SELECT series_id, i, frequency_hz FROM trace) WHERE series_id IN {_FIRST} AND {where} GROUP BY 1"""


@query(_scored_sql("zcd"))
def benchmark_zcd(spark, folder):
    return _out(_matrix(spark, folder, "zcd"), *_RUN_OUT)


@query(" UNION ALL ".join(map(_scored_sql, _ESTIMATORS_SQL)))
def benchmark_matrix(spark, folder):
    return _out(_matrix(spark, folder, "zcd", "ipdft"), *_RUN_OUT)


@query(f"WITH {_windowed(EVENTS_SQL)} SELECT series_id::VARCHAR AS series_id, count(*)::BIGINT AS n_samples, {R('sqrt(avg(pow(frequency_hz - 60.0, 2)))')} AS rmse FROM trace GROUP BY 1")
def rmse_by_series(spark, folder):
    traced = zcd.zcd_trace_chunked(_true(spark, folder), keep=("f_true",))
    return _out(metrics.rmse_by(traced), "series_id", "n_samples", "rmse")


@query(
    f"""WITH {_windowed(TRUE_SQL)}, e AS (SELECT series_id, abs(frequency_hz - f_true) AS fe,
    abs(rocof_hz_s - CASE WHEN t - lag(t) OVER w > 0 THEN (f_true - lag(f_true) OVER w) / (t - lag(t) OVER w) ELSE 0 END) AS rfe FROM trace WINDOW w AS (PARTITION BY series_id ORDER BY i))
    SELECT series_id, {R('quantile_cont(fe, 0.5)')} AS fe_p50, {R('quantile_cont(fe, 0.95)')} AS fe_p95, {R('quantile_cont(rfe, 0.5)', 3)} AS rfe_p50, {R('quantile_cont(rfe, 0.95)', 3)} AS rfe_p95 FROM e GROUP BY 1"""
)
def error_quantiles(spark, folder):
    signal = _true(spark, folder)
    return _out(metrics.error_quantiles(zcd.zcd_trace_chunked(signal), signal), "series_id", "fe_p50", "fe_p95", "rfe_p50", "rfe_p95", rfe_p50=3, rfe_p95=3)


@query(f"SELECT event_id::BIGINT AS event_id, {R('abs(value - 50) / sqrt(pow(value, 2) + 1)')} AS tve, {R('sqrt(pow(value, 2) + 1)')} AS mag, {R('atan2(1.0, value)')} AS ang FROM events")
def phasor_error(spark, folder):
    truth = complex_of(F.col("value"), 1.0)
    rows = read_table(spark, folder, "events").select("event_id", metrics.total_vector_error(complex_of(F.lit(50.0), 1.0), truth).alias("tve"), magnitude(truth).alias("mag"), angle(truth).alias("ang"))
    return _out(rows, "event_id", "tve", "mag", "ang")


@query(
    f"""WITH f AS (SELECT o_custkey::VARCHAR AS series_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderkey / 1000.0::DOUBLE AS arrival, o_totalprice / 1e4 AS service FROM orders),
    c AS (SELECT *, sum(service) OVER w AS c FROM f WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT *, c + max(arrival - (c - service)) OVER (PARTITION BY series_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS finish FROM c)
    SELECT series_id, i::BIGINT AS i, {R('finish - service')} AS start, {R('finish')} AS finish, {R('finish - service - arrival')} AS delay FROM d"""
)
def queue_times(spark, folder):
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    frames = read_table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("series_id"), (F.row_number().over(order) - 1).cast("long").alias("i"), (F.col("o_orderkey") / F.lit(1000.0)).alias("arrival"),
        (F.col("o_totalprice") / 1e4).alias("service"), F.lit(5.0).alias("deadline"),
    )
    return _out(metrics.queue_times(frames), "series_id", "i", "start", "finish", "delay")


@query(
    f"""SELECT o_orderpriority AS name, {R('regr_slope(o_totalprice, o_custkey)')} AS slope, {R('regr_intercept(o_totalprice, o_custkey)', 3)} AS intercept, {R('regr_r2(o_totalprice, o_custkey)')} AS r2
    FROM orders GROUP BY 1"""
)
def cost_regression(spark, folder):
    costs = read_table(spark, folder, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_custkey").cast("double").alias("n"), F.col("o_totalprice").alias("seconds"))
    return _out(metrics.cost_regression(costs), "name", "slope", "intercept", "r2", intercept=3)


# data of plots and reports

TOP, BOTTOM = ((0.01, 0.02), (0.025, 0.03)), (0.005, 0.03)
_ZOOM = "SELECT *, 0 AS window_id FROM s WHERE t BETWEEN 0.01 AND 0.02 UNION ALL SELECT *, 1 FROM s WHERE t BETWEEN 0.025 AND 0.03"
_LIMITS = "SELECT series_id, avg(f_true) AS m FROM s WHERE t BETWEEN 0.005 AND 0.03 GROUP BY 1"
#: A truth that moves with the samples.
MOVING_SQL = f"SELECT *, 60.0::DOUBLE + x / 100 AS f_true FROM ({EVENTS_SQL})"


def _moving(spark: SparkSession, folder: str) -> DataFrame:
    return event_signal(spark, folder).withColumn("f_true", F.lit(60.0) + F.col("x") / 100)


@query(f"WITH s AS ({MOVING_SQL}) SELECT {SIGNAL_SQL}, window_id::INTEGER AS window_id FROM ({_ZOOM})")
def plot_zoom_windows(spark, folder):
    return _out(products.zoom_windows(_moving(spark, folder), TOP), *SIGNAL_OUT, "window_id")


@query(f"WITH s AS ({MOVING_SQL}) SELECT series_id::VARCHAR AS series_id, {R('m * (1 - 0.15::DOUBLE)')} AS y_min, {R('m * (1 + 0.15::DOUBLE)')} AS y_max FROM ({_LIMITS})")
def plot_ylim(spark, folder):
    return _out(products.y_limits(_moving(spark, folder), BOTTOM), "series_id", "y_min", "y_max")


@query(
    f"""SELECT series_id::VARCHAR AS scenario, name, (count(*) OVER w)::BIGINT AS n_samples, {R('sqrt(avg(pow(frequency_hz - 60.0, 2)) OVER w)')} AS rmse, i::BIGINT AS i, {R('frequency_hz', 4)} AS frequency_hz FROM (
    SELECT 'zcd' AS name, series_id, i, frequency_hz FROM (WITH {_windowed(EVENTS_SQL)} SELECT * FROM trace) UNION ALL
    SELECT 'ipdft', series_id, i, frequency_hz FROM (WITH {_peaks(EVENTS_SQL, 64, 5000.0)} SELECT * FROM trace)) WHERE series_id IN {_FIRST} WINDOW w AS (PARTITION BY series_id, name)"""
)
def result_json(spark, folder):
    """The summary in JSON, read back."""
    made = products.summary_json(_matrix(spark, folder, "zcd", "ipdft", with_estimates=True))
    back = made.select("scenario", F.explode(F.from_json("json", "array<struct<name:string,n_samples:bigint,rmse:double,f_hat:array<double>>>")).alias("r"))
    flat = back.select("scenario", "r.name", "r.n_samples", "r.rmse", F.posexplode("r.f_hat").alias("i", "frequency_hz"))
    return _out(flat.withColumn("i", F.col("i").cast("long")), "scenario", "name", "n_samples", "rmse", "i", "frequency_hz", frequency_hz=4)


@query(
    f"""WITH s AS ({MOVING_SQL}), z AS ({_LIMITS}), e AS (WITH {_windowed(EVENTS_SQL)} SELECT series_id, i, frequency_hz FROM trace),
    ends AS (SELECT series_id, max(t) AS t_end, count(*) AS n FROM s GROUP BY 1),
    rows AS (SELECT 'top' AS panel, 'signal' AS line, series_id, window_id, t, x AS y, false AS low FROM ({_ZOOM})
      UNION ALL SELECT 'bottom', 'zcd', series_id, 0, coalesce(i * (t_end / nullif(n - 1, 0)), 0), frequency_hz, true FROM e JOIN ends USING (series_id)
      UNION ALL SELECT 'bottom', 'truth', series_id, 0, t, f_true, true FROM s)
    SELECT panel, line, series_id::VARCHAR AS series_id, window_id::INTEGER AS window_id, {R('t')} AS t, {R('y')} AS y,
      CASE WHEN low THEN {R('m * (1 - 0.15::DOUBLE)')} END AS y_min, CASE WHEN low THEN {R('m * (1 + 0.15::DOUBLE)')} END AS y_max FROM rows LEFT JOIN z USING (series_id)"""
)
def plot_product(spark, folder):
    signal = _moving(spark, folder)
    found = products.plot_series(signal, zcd.zcd_trace_chunked(signal).withColumn("name", F.lit("zcd")), TOP, BOTTOM)
    return _out(found, "panel", "line", "series_id", "window_id", "t", "y", "y_min", "y_max")


@query(
    f"""WITH m AS ({' UNION ALL '.join(map(_scored_sql, _ESTIMATORS_SQL))})
    SELECT scenario, any_value(rmse) FILTER (WHERE name = 'ipdft') AS ipdft, any_value(rmse) FILTER (WHERE name = 'zcd') AS zcd FROM m GROUP BY scenario"""
)
def report_heatmap(spark, folder):
    return _out(products.heatmap(_matrix(spark, folder, "zcd", "ipdft"), "scenario", "name", "rmse", ["ipdft", "zcd"]), "scenario", "ipdft", "zcd")


_COSTS_SQL = "SELECT o_orderpriority AS name, count(*) AS n, avg(o_totalprice) AS cost, stddev_samp(o_totalprice) AS error FROM orders GROUP BY 1"


def _costs(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.avg("o_totalprice").alias("cost"), F.stddev("o_totalprice").alias("error"))


@query(f"WITH c AS ({_COSTS_SQL}) SELECT name, {R('cost', 4)} AS cost, {R('error', 4)} AS error FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.cost <= c.cost AND d.error <= c.error AND (d.cost < c.cost OR d.error < c.error))")
def report_pareto(spark, folder):
    return _out(products.pareto_front(_costs(spark, folder), "cost", "error"), "name", "cost", "error", cost=4, error=4)


@query(f"WITH c AS ({_COSTS_SQL}), m AS (SELECT avg(cost) AS m FROM c) SELECT name, cost <= 100000 AND error <= 40000 AS passed, concat_ws('; ', CASE WHEN cost > 100000 THEN 'cost > 100000' END, CASE WHEN error > 40000 THEN 'error > 40000' END) AS reasons FROM c")
def budget_verdicts(spark, folder):
    return metrics.verdicts(_costs(spark, folder), {"cost": 100000, "error": 40000}).select("name", "passed", "reasons")


_RMSE = "SELECT series_id, sqrt(avg(pow(frequency_hz - 60.0, 2))) AS rmse FROM trace GROUP BY 1"


@query(
    f"""WITH a AS (WITH {_windowed(EVENTS_SQL)} {_RMSE}), b AS (WITH {_windowed(EVENTS_SQL, 'pos_to_neg')} {_RMSE})
    SELECT series_id::VARCHAR AS series_id, {R('a.rmse')} AS found, {R('b.rmse')} AS expected, coalesce(abs(a.rmse - b.rmse) <= 0.05 * abs(b.rmse), false) AS passed FROM a FULL JOIN b USING (series_id)"""
)
def golden_compare(spark, folder):
    """Two runs, stored and compared by their names: rising crossings against falling ones as the golden run."""
    signal, runs = _true(spark, folder), shared_path(spark, "runs")
    for name in ("neg_to_pos", "pos_to_neg"):
        metrics.store_run(metrics.frequency_rmse(zcd.zcd_trace_chunked(signal, ZcdConfig(mode=name)), signal), name, runs)
    found = metrics.compare_runs(spark.read.parquet(runs), "neg_to_pos", "pos_to_neg", ("series_id",), "rmse", 0.05)
    return _out(found, "series_id", "found", "expected", "passed")


@query(
    f"""WITH e AS (SELECT series_id, abs(60.0::DOUBLE + 0.5 * t + CASE WHEN x > 45 THEN x / 1000 ELSE 0.0::DOUBLE END - (60.0::DOUBLE + 0.5 * t)) AS gap FROM ({EVENTS_SQL}))
    SELECT series_id::VARCHAR AS series_id, count(*)::BIGINT AS n_samples, count(*) FILTER (WHERE gap > 1e-6 OR gap IS NULL)::BIGINT AS n_wrong, {R('max(gap)')} AS largest FROM e GROUP BY 1"""
)
def truth_check(spark, folder):
    """A truth that is wrong where a sample is large."""
    wrong = F.lit(60.0) + F.lit(0.5) * F.col("t") + F.when(F.col("x") > 45, F.col("x") / 1000).otherwise(0.0)
    found = metrics.truth_gaps(event_signal(spark, folder).withColumn("f_true", wrong), F.lit(60.0) + F.lit(0.5) * F.col("t"))
    return _out(found, "series_id", "n_samples", "n_wrong", "largest")


_SHA = "sha256(concat_ws(chr(31), event_id::VARCHAR, user_id::VARCHAR))"
_HEX = lambda k: f"list_reduce(list_transform(string_split(substr(h, {8 * k + 1}, 8), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, b: a * 16 + b)"


@query(
    f"""WITH r AS (SELECT event_type, {_SHA} AS h FROM events), s AS (SELECT event_type, count(*) AS n, {', '.join(f'sum({_HEX(k)}) AS s{k}' for k in range(8))} FROM r GROUP BY 1)
    SELECT event_type, n::BIGINT AS n_rows, sha256(concat_ws(',', n::VARCHAR, {', '.join(f's{k}::VARCHAR' for k in range(8))})) AS digest FROM s"""
)
def suite_digests(spark, folder):
    return metrics.multiset_digest(read_table(spark, folder, "events").select("event_type", "user_id", "event_id"), ("event_type",))


@query(_scored_sql("zcd", "i >= 50"))
def benchmark_warm_up(spark, folder):
    return _out(_matrix(spark, folder, "zcd", warm_up=50), *_RUN_OUT)


@query(
    f"""WITH s AS ({EVENTS_SQL}), e AS (SELECT series_id, abs(x) AS e FROM s)
    SELECT series_id::VARCHAR AS series_id, (CASE WHEN e < 0 THEN 0 WHEN e >= 100 THEN 11 ELSE floor(e / 10) + 1 END)::BIGINT AS bin, count(*)::BIGINT AS n FROM e GROUP BY 1, 2"""
)
def error_histogram(spark, folder):
    return products.error_histogram(event_signal(spark, folder).select("series_id", F.abs("x").alias("e")), "e", 0.0, 100.0, 10)


_AROUND = "SELECT i AS window_id, t - 0.0013::DOUBLE AS t0, t + 0.0021::DOUBLE AS t1, series_id FROM s WHERE i % 40 = 7 UNION ALL SELECT -1, 0.004::DOUBLE, 1000.0::DOUBLE, series_id FROM s WHERE i = 3"


@query(f"WITH s AS ({EVENTS_SQL}), w AS ({_AROUND}) SELECT s.series_id::VARCHAR AS series_id, s.i::BIGINT AS i, {R('x')} AS x, window_id::BIGINT AS window_id FROM s JOIN w ON w.series_id = s.series_id AND t >= t0 AND t <= t1")
def windows_around_events(spark, folder):
    """Windows from a table, around some samples, and one of nearly all the time."""
    signal = event_signal(spark, folder)
    marked = signal.filter("i % 40 = 7").select(F.col("i").alias("window_id"), (F.col("t") - 0.0013).alias("t0"), (F.col("t") + 0.0021).alias("t1"), "series_id")
    long = signal.filter("i = 3").select(F.lit(-1).cast("long"), F.lit(0.004), F.lit(1000.0), "series_id")
    return _out(products.in_windows(signal, marked.union(long), 0.005), "series_id", "i", "x", "window_id")


@query(f"WITH RECURSIVE {_PLL}, {_walked('omega / (2 * pi())')} SELECT {_LOOP_SQL} FROM trace")
def frequency_table_function(spark, folder):
    """The phase-locked loop by SQL, over a table argument."""
    tablefunction.register(spark)
    sql = "SELECT * FROM frequency('srf_pll', 5000.0D, TABLE({signal}) PARTITION BY series_id ORDER BY i)"
    return _loop(spark.sql(sql, signal=event_signal(spark, folder)))


# streams


_RUNS_SQL = f"SELECT *, (i + 50) // 150 AS run FROM ({EVENTS_SQL})"


@query(f"WITH {_windowed(_RUNS_SQL, by='series_id, run')} SELECT {TRACE_SQL} FROM trace")
def stream_reset(spark, folder):
    """Crossings of a stream whose series are reset every 150 samples, and begin anew; a session of its own has the state store that this needs."""
    signal, base = event_signal(spark, folder), shared_path(spark, "stream")
    last = signal.agg(F.max("i")).first()[0]
    if last is None:
        return spark.createDataFrame([], stateful.OUT)
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", processors.PROVIDER)
    marked = signal.withColumn("mark", F.when(F.col("i") % 150 == 100, "reset"))
    for part in (F.col("i") <= last // 2, F.col("i") > last // 2):
        marked.filter(part).write.mode("append").parquet(f"{base}/in")
        source = own.readStream.schema("series_id string, i long, t double, x double, mark string").parquet(f"{base}/in")
        stateful.drained(processors.sequential_stream(source, sequential.zcd_loop(ZcdConfig())), f"{base}/out", f"{base}/checkpoint")
    return _trace(spark.read.schema(stateful.OUT).parquet(f"{base}/out"))


def _streamed(spark: SparkSession, folder: str, estimate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The event signal through a stream in two runs, the first half of the samples in the one, the others in the next."""
    signal, base = event_signal(spark, folder), shared_path(spark, "stream")
    last = signal.agg(F.max("i")).first()[0]
    if last is None:
        return spark.createDataFrame([], stateful.OUT)
    for part in (F.col("i") <= last // 2, F.col("i") > last // 2):
        signal.filter(part).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema("series_id string, i long, t double, x double").parquet(f"{base}/in")
        stateful.drained(estimate(source), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stateful.OUT).parquet(f"{base}/out")


@query(f"WITH {_windowed(EVENTS_SQL)} SELECT {TRACE_SQL} FROM trace")
def stream_zcd(spark, folder):
    return _trace(_streamed(spark, folder, lambda s: stateful.zcd_stream(s)))


@query(f"WITH {_peaks(EVENTS_SQL, 64, 5000.0)} SELECT {_IPDFT_SQL} FROM trace")
def stream_ipdft(spark, folder):
    return _out(_streamed(spark, folder, lambda s: stateful.ipdft_stream(s, FRAME)), *TRACE_OUT, frequency_hz=4, rocof_hz_s=0)
