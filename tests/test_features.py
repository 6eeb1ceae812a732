"""Windows from a table, digests, stored runs, the table function, and estimators by moving sums in chunks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hertzlake.config import IpdftConfig, LoopConfig
from hertzlake.operators import metrics, products, sequential, spectral, tablefunction

SCHEMA = "series_id string, i long, t double, x double"


@pytest.mark.parametrize("width", [0.01, 0.5, 100.0])
@pytest.mark.parametrize("by", [True, False])
def test_windows_equal_all_pairs(spark, width, by):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), k, rng.choice((rng.uniform(-2, 5), float(k % 4))), 1.0) for k in range(300)] + [("a", 999, None, 1.0)]
    windows = [(k, a, a + rng.choice((0.0, 0.02, 1.0, 3.0)), rng.choice("ab")) for k, a in enumerate(rng.choices([-1.0, 0.0, 0.3, 2.0, 3.99], k=25))]
    windows += [(100, -1e9, 1e9, "a"), (101, 2.0, 1.0, "a"), (102, None, 1.0, "b"), (103, 50.0, 60.0, "a"), (100, 0.0, 1.0, "b")]
    table = spark.createDataFrame(windows, "window_id long, t0 double, t1 double, series_id string")
    series = spark.createDataFrame(rows, SCHEMA)
    found = products.in_windows(series, table if by else table.drop("series_id"), width)
    inside = lambda t, a, b: None not in (t, a, b) and a <= t <= b
    expected = sorted((s, i, w) for s, i, t, _ in rows for w, a, b, name in windows if inside(t, a, b) and (not by or s == name))
    assert sorted((r.series_id, r.i, r.window_id) for r in found.collect()) == expected and found.columns == [*series.columns, "window_id"]
    assert products.in_windows(series.limit(0), table, width).count() == 0 == products.in_windows(series, table.limit(0), width).count()


def test_windows_meet_their_bins_alone(spark, capsys):
    series = spark.range(10).select(F.lit("a").alias("series_id"), F.col("id").alias("i"), (F.col("id") / 10).alias("t"))
    products.in_windows(series, spark.createDataFrame([(1, 0.0, 0.5)], "window_id long, t0 double, t1 double"), 0.1).explain()
    plan = capsys.readouterr().out
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_digests_of_multisets(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", ""), (2, "b", ""), (3, None, "c")], "k long, u string, v string")
    digest = metrics.suite_digest(rows)
    assert digest == metrics.suite_digest(rows.repartition(3).select("v", "k", "u"))
    others = [rows.distinct(), rows.union(rows.limit(1)), rows.fillna({"v": ""}), rows.withColumn("k", F.col("k") + 1), rows.limit(0), rows.select("k", F.col("v").alias("u"), F.col("u").alias("v"))]
    assert len({digest, *map(metrics.suite_digest, others)}) == len(others) + 1
    assert metrics.multiset_digest(rows, ("k",)).count() == 3


def test_runs_are_stored_once_and_compared(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, rmse double")
    metrics.store_run(rows, "first", str(tmp_path))
    metrics.store_run(rows.withColumn("rmse", F.col("rmse") * F.when(F.col("name") == "a", 1.02).otherwise(1.2)), "second", str(tmp_path))
    with pytest.raises(Exception):
        metrics.store_run(rows, "first", str(tmp_path))
    runs = spark.read.parquet(str(tmp_path))
    assert {r["name"]: r.passed for r in metrics.compare_runs(runs, "second", "first", ("name",), "rmse").collect()} == {"a": True, "b": False}


def tone(spark, n=1200, f=61.5):
    x = np.cos(2 * np.pi * f * np.arange(n) / 5000 + 0.4)
    return spark.createDataFrame([("s", k, k / 5000, float(v)) for k, v in enumerate(x)], SCHEMA)


def test_a_table_function(spark, monkeypatch):
    monkeypatch.setattr(tablefunction, "PIECE", 100)
    tablefunction.register(spark)
    two = tone(spark).union(tone(spark, 700, 59.0).withColumn("series_id", F.lit("r")))
    found = spark.sql("SELECT * FROM frequency('srf_pll', 5000.0D, TABLE({s}) PARTITION BY series_id ORDER BY i)", s=two).collect()
    batch = sequential.sequential_trace(two, sequential.srf_pll(LoopConfig(5000.0))).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, batch)) and len(found) == 1900
    for wrong in ("'other', 5000.0D, TABLE({s})", "'zcd', 5000.0D, TABLE(SELECT 1 AS a)"):
        with pytest.raises(Exception, match="estimator must be|lacks"):
            spark.sql(f"SELECT * FROM frequency({wrong})", s=two).collect()


@pytest.mark.parametrize("trace", [
    lambda s, chunk: spectral.prony_trace(s, IpdftConfig(5000.0, 100), chunk), lambda s, chunk: spectral.rls_trace(s, IpdftConfig(5000.0, 100), 0.99, chunk),
    lambda s, chunk: spectral.sliding_dft_trace(s, IpdftConfig(5000.0, 250), chunk), lambda s, chunk: spectral.goertzel_trace(s, IpdftConfig(5000.0, 500), (60.5, 61.0, 61.5, 62.0), chunk),
])
def test_moving_sums_by_chunk(spark, trace):
    signal = tone(spark)
    whole, cut = (trace(signal, chunk).toPandas().sort_values("i") for chunk in (1 << 16, 90))
    np.testing.assert_allclose(whole.frequency_hz, cut.frequency_hz, rtol=1e-6)
    assert len(cut) == 1200 and abs(whole.frequency_hz[-300:].mean() - 61.5) < 0.2
    assert math.isclose(whole.frequency_hz.iloc[0], 60.0)
    assert trace(signal.limit(0), 90).count() == 0
