"""Long series are many tasks' work, and nothing depends on how they are cut; streams in any order; empty tables."""

import datetime
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hertzlake.operators import zcd
from hertzlake.plans import queries
from hertzlake.sources import signals
from hertzlake.storage import shared_dir, shared_path
from hertzlake.streaming import stateful


def test_numbering_equals_a_window(spark):
    rng = np.random.default_rng(3)
    rows = [(str(rng.choice(["a", "b", None], p=[0.8, 0.1, 0.1])), int(o), None if o % 50 == 0 else float(v)) for o, v in zip(rng.permutation(4000), rng.normal(size=4000))]
    rows = [(None if s == "None" else s, o, v) for s, o, v in rows]
    table = spark.createDataFrame(rows, "s string, o long, v double").repartition(5)
    found = {(r.series_id, r.i): r.x for r in signals.from_table(table, "s", "o", "v", 0.1).collect()}
    expected = {}
    for name in ("a", "b", None):
        own = sorted((o, v) for s, o, v in rows if s == name)
        mean = np.mean([v for _, v in own if v is not None])
        expected.update({(name, k): None if v is None else v - mean for k, (_, v) in enumerate(own)})
    assert found.keys() == expected.keys()
    assert all(found[k] is v is None or math.isclose(found[k], v, abs_tol=1e-12) for k, v in expected.items())


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 20])
def test_running_totals_by_chunk(spark, chunk):
    signal = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "a").alias("series_id"), F.floor(F.col("id") / 2).alias("i"), F.lit(0.25).alias("v"))
    for row in signals.running_total(signal, "v", chunk).collect():
        assert row.total == 0.25 * (row.i + 1)


def test_samples_of_a_long_series_meet_in_no_window(spark, folder, capsys):
    signal = signals.from_table(spark.read.parquet(f"{folder}/events.parquet"), "event_type", "event_id", "value", 0.0002)
    marked = zcd._chunks(signal, zcd.ZcdConfig(), 100)
    for plan in (marked, zcd.zcd_trace_chunked(signal, chunk=100)):
        plan.explain()
        text = capsys.readouterr().out.split("Initial Plan")[0]
        assert not re.search(r"windowspecdefinition\(series_id#\d+L?, (i|o)#", text)  # those by chunk, or of a row a chunk or range, stay


def test_chunks_give_what_a_whole_series_gives(spark):
    t = np.arange(20000) / 5000
    rng = np.random.default_rng(8)
    x = np.where((t > 2) & (t < 3.2), -1.0, np.sin(2 * np.pi * 3 * t) + rng.normal(0, 0.01, len(t)))
    rows = [("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x))]
    signal = spark.createDataFrame(rows, "series_id string, i long, t double, x double")
    whole = zcd.zcd_trace(signal).toPandas().sort_values("i")
    for chunk in (100, 1999):
        cut = zcd.zcd_trace_chunked(signal, chunk=chunk).toPandas().sort_values("i")
        np.testing.assert_array_equal(whole.frequency_hz, cut.frequency_hz)
        np.testing.assert_allclose(whole.rocof_hz_s, cut.rocof_hz_s, rtol=1e-12)


def test_empty_events(spark, tmp_path, folder):
    spark.read.parquet(f"{folder}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("zcd_rocof", "zcd_either", "ipdft_trace", "multi_median", "fused_mean", "fused_consensus", "stream_zcd", "stream_ipdft", "rmse_by_series"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_null_samples_in_a_stream(spark):
    t = np.arange(2000) / 5000
    x = [None if 100 <= k < 130 else float(v) for k, v in enumerate(np.sin(2 * np.pi * 60 * t + 0.2))]
    signal = spark.createDataFrame([("s", k, float(a), b) for k, (a, b) in enumerate(zip(t, x))], "series_id string, i long, t double, x double")
    base = shared_path(spark, "nulls")
    signal.write.parquet(f"{base}/in")
    source = spark.readStream.schema(signal.schema).parquet(f"{base}/in")
    stateful.drained(stateful.zcd_stream(source), f"{base}/out", f"{base}/checkpoint")
    found = spark.read.parquet(f"{base}/out").toPandas().sort_values("i")
    batch = zcd.zcd_trace(signal).toPandas().sort_values("i")
    np.testing.assert_allclose(found.frequency_hz, batch.frequency_hz, rtol=1e-12)


def test_a_stream_out_of_order(spark):
    t = np.arange(1500) / 5000
    rows = [("s", k, float(a), float(b)) for k, (a, b) in enumerate(zip(t, np.sin(2 * np.pi * 60 * t + 0.2)))]
    start = datetime.datetime(2024, 1, 1)
    timed = [(*r, start + datetime.timedelta(seconds=r[1])) for r in rows]
    rng = np.random.default_rng(1)
    jumbled = [timed[k] for k in np.argsort(np.arange(1500) + rng.uniform(0, 40, 1500))]
    schema, base = "series_id string, i long, t double, x double, at timestamp_ntz", shared_path(spark, "order")
    for k in range(0, 1500, 250):  # a file is a micro-batch; some samples come twice
        part = jumbled[k : k + 250] + jumbled[max(0, k - 20) : k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    far = ("s", 10**6, 1e9, 0.0, start + datetime.timedelta(days=9))  # moves the watermark past all
    spark.createDataFrame([far], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    stateful.drained(stateful.in_order(source, "at", "60 seconds"), f"{base}/sorted", f"{base}/c1")
    found = spark.read.parquet(f"{base}/sorted")
    assert sorted(map(tuple, found.collect())) == sorted(rows)
    ended = spark.createDataFrame([("s",)], "series_id string")
    assert stateful.without_series(found, ended).count() == 0


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = None

        def getConf(self):
            return {}

    class Jsc:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isEmpty(self):
            return True

    class Session:
        sparkContext = Context()

    Session.sparkContext._jsc = Jsc()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
