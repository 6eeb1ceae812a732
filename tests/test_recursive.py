"""Recursive, sequential and fitted estimators against loops, tones, and other cuts into chunks and pieces."""

import math

import numpy as np
import pytest

from hertzlake.config import KalmanConfig, LoopConfig, TaylorConfig
from hertzlake.operators import scan, sequential, taylor

FS = 5000.0
SCHEMA = "series_id string, i long, t double, x double"


def tone(f, n=3000, amplitude=1.0, missing=()):
    t = np.arange(n) / FS
    x = amplitude * np.cos(2 * np.pi * f * t + 0.3)
    return [(k, float(a), None if k in missing else float(b)) for k, (a, b) in enumerate(zip(t, x))]


@pytest.fixture(scope="module")
def signal(spark):
    rows = [("a", *r) for r in tone(59.7)] + [("b", *r) for r in tone(60.4, amplitude=3.0)] + [(None, *r) for r in tone(60.1, 900, missing=range(100, 130))] + [("one", 0, 0.0, 1.0)]
    return spark.createDataFrame(rows, SCHEMA).cache()


TRACES = {
    "sogi": lambda s, chunk: scan.sogi_fll_trace(s, LoopConfig(FS), chunk),
    "kalman": lambda s, chunk: scan.kalman_trace(s, KalmanConfig(FS), chunk),
    "taylor": lambda s, chunk: taylor.taylor_fourier_trace(s, TaylorConfig(FS), chunk),
    "pll": lambda s, chunk: sequential.sequential_trace(s, sequential.srf_pll(LoopConfig(FS))),
    "ekf": lambda s, chunk: sequential.sequential_trace(s, sequential.ekf_angle(KalmanConfig(FS))),
}


def by_series(df):
    rows = sorted(map(tuple, df.select("series_id", "i", "t", "frequency_hz", "rocof_hz_s").collect()), key=lambda r: (str(r[0]), r[1]))
    return {name: np.array([r[3:] for r in rows if r[0] == name], float) for name in {r[0] for r in rows}}


@pytest.mark.parametrize("name", sorted(TRACES))
def test_tones_are_found(signal, name):
    found = by_series(TRACES[name](signal, 1 << 16))
    assert {k: len(v) for k, v in found.items()} == {"a": 3000, "b": 3000, None: 900, "one": 1}
    for series, f in (("a", 59.7), ("b", 60.4)):
        assert abs(found[series][-500:, 0].mean() - f) < 5e-3
    assert np.isfinite(np.concatenate(list(found.values()))).all()
    assert found["one"][0, 1] == 0.0


@pytest.mark.parametrize("name", ["kalman", "sogi", "taylor"])
@pytest.mark.parametrize("chunk", [7, 500])
def test_chunks_give_what_a_whole_series_gives(signal, name, chunk):
    short = signal.filter("i < 200") if chunk == 7 else signal
    whole, cut = by_series(TRACES[name](short, 1 << 16)), by_series(TRACES[name](short, chunk))
    assert whole.keys() == cut.keys()
    for series in whole:
        np.testing.assert_allclose(whole[series][:, 0], cut[series][:, 0], rtol=1e-9)
        np.testing.assert_allclose(whole[series][:, 1], cut[series][:, 1], atol=1e-3)


@pytest.mark.parametrize("name", sorted(TRACES))
def test_empty_signals(signal, name):
    assert TRACES[name](signal.limit(0), 100).count() == 0


def test_affine_states_equal_a_loop():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 2)) / 2, rng.normal(size=(77, 2))
    y, expected = np.zeros(2), []
    for row in b:
        y = a @ y + row
        expected.append(y)
    np.testing.assert_allclose(scan.affine_states(a, b), expected, atol=1e-12)


def test_kalman_states_equal_the_filter(spark):
    config = KalmanConfig(FS, q=0.02, r=0.5, p0=2.0)
    rng = np.random.default_rng(2)
    z = [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=400)]
    turn = 2 * np.pi * 60 / FS
    f = np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
    m, p, expected = np.zeros(2), 2.0 * np.eye(2), []
    for v in z:
        m, p = f @ m, f @ p @ f.T + 0.02 * np.eye(2)
        if v is not None:
            gain = p[:, 0] / (p[0, 0] + 0.5)
            m, p = m + gain * (v - m[0]), p - np.outer(gain, p[0])
        expected.append(m)
    signal = spark.createDataFrame([("s", k, k / FS, v) for k, v in enumerate(z)], SCHEMA)
    for chunk in (16, 1 << 16):
        found = scan.kalman_states(signal, config, chunk).toPandas().sort_values("i")
        np.testing.assert_allclose(found[["re", "im"]].to_numpy(), expected, atol=1e-10)


def test_composition_is_associative():
    config, rng = KalmanConfig(FS), np.random.default_rng(3)
    x, y, z = (scan.kalman_elements(rng.normal(size=5), rng.random(5) < 0.7, config) for _ in range(3))
    np.testing.assert_allclose(scan.composed(scan.composed(x, y), z), scan.composed(x, scan.composed(y, z)), atol=1e-9)
    np.testing.assert_allclose(scan.whole(x), scan.prefixes(x)[-1], atol=1e-9)


@pytest.mark.parametrize("make", [lambda: sequential.srf_pll(LoopConfig(FS)), lambda: sequential.ekf_angle(KalmanConfig(FS))])
def test_a_state_is_handed_on(make):
    start, step = make()
    t = np.arange(500) / FS
    x = np.where(np.arange(500) % 50 == 7, np.nan, np.sin(2 * np.pi * 60.3 * t))
    _, whole, rates = step(start, t, x)
    state, pieces, more = start, [], []
    for at in range(0, 500, 37):
        state, f, r = step(state, t[at : at + 37], x[at : at + 37])
        pieces, more = pieces + f, more + r
    assert pieces == whole and more == rates


def test_pieces_of_a_series_in_batch(spark, signal):
    """Arrow batches far smaller than a series, and several series in one."""
    whole = by_series(TRACES["pll"](signal, 0))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        cut = by_series(TRACES["pll"](signal, 0))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for name in whole:
        np.testing.assert_array_equal(whole[name], cut[name])


def test_fitted_frames_equal_least_squares(spark):
    config = TaylorConfig(FS, 90, 2)
    rng = np.random.default_rng(5)
    x = rng.normal(size=200)
    found = taylor.taylor_fourier_trace(spark.createDataFrame([("s", k, k / FS, float(v)) for k, v in enumerate(x)], SCHEMA), config, 64).toPandas().sort_values("i")
    u = (np.arange(90) - 44.5) / FS
    wave = np.exp(2j * np.pi * 60 * u)
    basis = np.column_stack([part for k in range(3) for part in ((u**k * wave).real, -(u**k * wave).imag)])
    weight = np.sin(np.pi * (np.arange(90) + 0.5) / 90)
    for at in range(89, 200, 13):
        c = np.linalg.lstsq(basis * weight[:, None], x[at - 89 : at + 1] * weight, rcond=1e-14)[0]
        p0, p1 = c[0] + 1j * c[1], c[2] + 1j * c[3]
        assert math.isclose(found.frequency_hz.iloc[at], 60 + (p1 / p0).imag / (2 * np.pi), rel_tol=1e-5)
    assert (found.frequency_hz.iloc[:89] == 60).all()


def test_configurations():
    for wrong in (lambda: LoopConfig(100.0), lambda: KalmanConfig(FS, r=0.0), lambda: TaylorConfig(FS, 4, 2), lambda: TaylorConfig(FS, 90, 0)):
        with pytest.raises(ValueError):
            wrong()
