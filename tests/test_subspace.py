"""ESPRIT and MUSIC against covariances and searches without Spark."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hertzlake.config import IpdftConfig
from hertzlake.operators import subspace

SCHEMA = "series_id string, i long, t double, x double"
CONFIG = IpdftConfig(5000.0, 100)


def signal_of(spark, noise=0.0):
    rng, rows = np.random.default_rng(2), []
    for name, n, f in (("a", 450, 61.3), (None, 300, 300.0)):
        x = 2 * np.cos(2 * np.pi * f * np.arange(n) / 5000 + 0.4) + rng.normal(0, noise, n) * (noise > 0)
        rows += [(name, k, k / 5000, None if name == "a" and k == 350 else float(v)) for k, v in enumerate(x)]
    return spark.createDataFrame(rows + [("zero", k, k / 5000, 0.0) for k in range(150)], SCHEMA)


def brute_esprit(x):
    vectors = np.lib.stride_tricks.sliding_window_view(x, 8)
    _, _, right = np.linalg.svd(vectors)
    u = right[:2].T
    return np.abs(np.angle(np.linalg.eigvals(np.linalg.pinv(u[:-1]) @ u[1:]))).max() * 5000 / (2 * np.pi)


@pytest.mark.parametrize("noise", [0.0, 0.02])
def test_blocks_equal_a_decomposition_of_the_samples(spark, noise):
    signal = signal_of(spark, noise)
    found = subspace.subspace_trace(signal, CONFIG).toPandas().sort_values("i")
    rows = signal.toPandas()
    for name, f in (("a", 61.3), (None, 300.0)):
        own = found[found.series_id.isna()] if name is None else found[found.series_id == name]
        x = (rows[rows.series_id.isna()] if name is None else rows[rows.series_id == name]).sort_values("i").x.to_numpy(float)
        assert (own.frequency_hz[:99] == 60).all()
        for block in range(len(x) // 100):
            held = own.frequency_hz.to_numpy()[block * 100 + 99 : block * 100 + 199]
            expected = 60.0 if np.isnan(x[block * 100 : block * 100 + 100]).any() else brute_esprit(x[block * 100 : block * 100 + 100])
            np.testing.assert_allclose(held, expected, rtol=1e-5)
            assert noise or expected == 60.0 or abs(expected - f) < 1e-3
    assert (found.frequency_hz[found.series_id == "zero"] == 60).all()


def test_music_finds_the_nearest_of_the_grid(spark):
    grid = tuple(55.0 + 0.5 * k for k in range(21))
    found = subspace.subspace_trace(signal_of(spark), CONFIG, grid).filter("series_id = 'a' and i between 100 and 290").select("frequency_hz").distinct().collect()
    assert [r.frequency_hz for r in found] == [pytest.approx(61.5)]


def test_covariances(spark):
    found = {r.block: r for r in subspace.block_covariances(signal_of(spark).filter("series_id = 'a'"), CONFIG, 3).collect()}
    x = 2 * np.cos(2 * np.pi * 61.3 * np.arange(450) / 5000 + 0.4)
    part = np.lib.stride_tricks.sliding_window_view(x[100:200], 3)
    np.testing.assert_allclose(found[1].r, [(part[:, a] * part[:, b]).mean() for a in range(3) for b in range(a, 3)], rtol=1e-9)
    assert {k: r.n for k, r in found.items()} == {0: 98, 1: 98, 2: 98, 3: 95, 4: 48}
    assert math.isnan(subspace.esprit(np.zeros(36))) and subspace.subspace_trace(signal_of(spark).limit(0), CONFIG).count() == 0
    assert subspace.block_covariances(signal_of(spark).withColumn("x", F.lit(None).cast("double")), CONFIG).count() == 0
