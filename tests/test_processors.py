"""Streams of sequential estimators: equal to batch, resets, ends and time to live."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hertzlake.config import KalmanConfig, LoopConfig, ZcdConfig
from hertzlake.operators import sequential, zcd
from hertzlake.storage import shared_path
from hertzlake.streaming import processors

FS = 5000.0
SCHEMA = "series_id string, i long, t double, x double, mark string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, processors.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def rows_of(name, n=600, marks={}, seed=1):
    x = np.sin(2 * np.pi * 60.2 * np.arange(n) / FS) + np.random.default_rng(seed).normal(0, 0.1, n)
    return [(name, k, k / FS, None if k == 77 else float(v), marks.get(k)) for k, v in enumerate(x)]


def streamed(spark, rows, estimator, parts=3, ttl_ms=None, pause=0.0):
    """The estimates, and the rows of state after the last micro-batch."""
    base, size, left = shared_path(spark, "stream"), max(r[1] for r in rows) + 1, None
    for k in range(parts):
        own = [r for r in rows if size * k // parts <= r[1] < size * (k + 1) // parts]
        spark.createDataFrame(own, SCHEMA).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
        stream = processors.sequential_stream(source, estimator, ttl_ms)
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        # a time to live keeps a query going, so that it has one micro-batch a run
        query = (query.trigger(availableNow=True) if ttl_ms is None else query.trigger(once=True)).start()
        assert query.awaitTermination(60)
        left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]
        time.sleep(pause)
    found = spark.read.parquet(f"{base}/out").collect()
    return {(r.series_id, r.i): (r.frequency_hz, r.rocof_hz_s) for r in found}, left


@pytest.mark.parametrize("make", [lambda: sequential.srf_pll(LoopConfig(FS)), lambda: sequential.ekf_angle(KalmanConfig(FS)), lambda: sequential.zcd_loop(ZcdConfig())])
def test_a_stream_equals_batch(rocks, make):
    rows = rows_of("a") + rows_of("b", 300, seed=2)
    found, left = streamed(rocks, rows, make())
    batch = sequential.sequential_trace(rocks.createDataFrame(rows, SCHEMA), make()).collect()
    assert found == {(r.series_id, r.i): (r.frequency_hz, r.rocof_hz_s) for r in batch} and left == 2


def test_a_reset_starts_anew_and_an_end_leaves_no_state(rocks):
    make = lambda: sequential.zcd_loop(ZcdConfig())
    rows = rows_of("a", marks={250: "reset", 410: "reset", 599: "end"}) + rows_of("b", marks={599: "end"}) + rows_of("c", 300, marks={100: "end"})
    found, left = streamed(rocks, rows, make())
    assert left == 1  # of c, which went on after its end
    for name, low, high in (("a", 0, 250), ("a", 250, 410), ("a", 410, 600), ("b", 0, 600), ("c", 0, 101), ("c", 101, 300)):
        own = [r for r in rows if r[0] == name and low <= r[1] < high]
        alone = sequential.sequential_trace(rocks.createDataFrame(own, SCHEMA), make()).collect()
        assert all(found[name, r.i] == (r.frequency_hz, r.rocof_hz_s) for r in alone) and len(alone) == high - low
    assert found["a", 250] == (60.0, 0.0) and found["a", 249] != (60.0, 0.0)


def test_a_silent_series_is_dropped(rocks):
    rows = rows_of("a", marks={}) + [("b", *r[1:]) for r in rows_of("b", 100)]
    found, _ = streamed(rocks, rows, sequential.zcd_loop(ZcdConfig()), 2, ttl_ms=1, pause=0.5)
    assert found["a", 300] == (60.0, 0.0) and found["a", 299] != (60.0, 0.0)


def test_the_step_equals_the_windows(spark):
    rows = rows_of("a") + rows_of(None, 200)
    signal = spark.createDataFrame(rows, SCHEMA)
    for config in (ZcdConfig(), ZcdConfig(mode="either", epsilon=0.3), ZcdConfig(mode="pos_to_neg", min_period_s=0.002)):
        found = {(r.series_id, r.i): r for r in sequential.sequential_trace(signal, sequential.zcd_loop(config)).collect()}
        for r in zcd.zcd_trace(signal, config).collect():
            assert math.isclose(found[r.series_id, r.i].frequency_hz, r.frequency_hz, rel_tol=1e-12)
            assert math.isclose(found[r.series_id, r.i].rocof_hz_s, r.rocof_hz_s, rel_tol=1e-9)


def test_other_state_stores_are_refused(spark):
    with pytest.raises(ValueError, match="providerClass"):
        processors.sequential_stream(spark.range(1).withColumn("series_id", F.lit("a")), sequential.zcd_loop(ZcdConfig()))
