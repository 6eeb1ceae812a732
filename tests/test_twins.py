"""Operators against their SQL twins on tables of their own."""

import math
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_queries import database

from hertzlake.config import IpdftConfig
from hertzlake.operators import ipdft, products, sequential, spectral
from hertzlake.plans import queries
from hertzlake.streaming import stateful


def whole_events(folder, n):
    """Events of whole values, whose sums are exact in any order, so that both engines have the same samples."""
    value = np.random.default_rng(5).exponential(50.0, n).round()
    pd.DataFrame({"event_id": np.arange(n), "event_type": "click", "value": value}).to_parquet(f"{folder}/events.parquet")
    return database(folder)


def test_a_loop_keeps_every_bit(tmp_path):
    # off its tone the loop makes hertz of a last bit, which rounding shows only after some ten thousand samples
    db = whole_events(tmp_path, 3000)
    sql = f"WITH RECURSIVE {queries._PLL}, {queries._walked('omega / (2 * pi())')} SELECT i, frequency_hz FROM trace ORDER BY i"
    signal = db.sql(f"SELECT t, x FROM ({queries.EVENTS_SQL}) ORDER BY i").df()
    start, step = sequential.srf_pll(queries.LOOP)
    found = step(start, signal.t.to_numpy(), signal.x.to_numpy())[1]
    assert found == db.sql(sql).df().frequency_hz.tolist()


def test_a_front_of_results_that_are_not_twice_the_same(spark):
    last_bit = F.udf(lambda: random.random() * 1e-9, "double").asNondeterministic()
    rows = [("a", 1.0, 3.0), ("b", 2.0, 2.0), ("c", 3.0, 2.5), ("d", 3.0, None), ("e", None, 0.0)]
    results = spark.createDataFrame(rows, "name string, cost double, error double").withColumn("cost", F.col("cost") + last_bit())
    assert sorted(r.name for r in products.pareto_front(results, "cost", "error").collect()) == ["a", "b", "d", "e"]


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out.split("Initial Plan")[0]


@pytest.mark.parametrize("name", ["goertzel_trace", "ipdft_spectrum", "ipdft_peak", "ipdft_rocof"])
def test_frames_are_not_summed_anew_at_each_sample(spark, folder, capsys, name):
    text = plan_of(queries.QUERIES[name](spark, folder), capsys)
    assert not re.search(r"specifiedwindowframe\(RowFrame, -\d\d", text)  # a frame's length of work at each sample and frequency
    assert "NestedLoop" not in text and "Cartesian" not in text  # a row for each sample and bin, shuffled


def test_spectra_do_not_hang_on_chunks(spark):
    x = np.random.default_rng(2).normal(size=700)
    rows = [(s, k, k / 5000, None if 200 <= k < 300 else float(v)) for s in ("a", None) for k, v in enumerate(x)]
    signal = spark.createDataFrame(rows, "series_id string, i long, t double, x double")
    config = IpdftConfig(5000.0, 20)
    found = {c: {(r.series_id, r.i, r.k): r.mag for r in ipdft.spectrum(signal, config, c).collect()} for c in (20, 123, 10_000)}
    assert found[20].keys() == found[123].keys() == found[10_000].keys() and len(found[20]) == 2 * 681 * 10
    assert found[20] == found[123] == found[10_000]
    assert all((m is None) == (219 <= i < 300) for (_, i, _), m in found[20].items())
    for i in (19, 150, 320, 699):
        assert math.isclose(found[20]["a", i, 3], abs(np.fft.rfft(x[i - 19 : i + 1])[3]), rel_tol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 100])
def test_moving_sums(n):
    x = np.arange(300.0).reshape(2, 150) ** 2
    x[0, 20] = np.nan
    np.testing.assert_array_equal(spectral.moving_sums(x, n), np.lib.stride_tricks.sliding_window_view(x, n, axis=1).sum(-1))


class Recorded:
    """Stands for a stream, and keeps the step that it is given."""

    def __getattr__(self, name):
        return lambda *given, **named: self

    def __getitem__(self, name):
        return self

    def applyInPandasWithState(self, step, *given):
        return step


class State:
    exists, get, kept = False, None, None

    def update(self, value):
        self.kept = value


@pytest.mark.parametrize("make", [stateful.zcd_stream, lambda s: stateful.ipdft_stream(s, IpdftConfig(5000.0, 64))])
def test_a_micro_batch_is_held_as_numbers(make):
    n, rng = 400_000, np.random.default_rng(1)
    starts = rng.permutation(n // 10_000) * 10_000

    def frames():
        for low in starts.tolist():
            i = np.arange(low, low + 10_000)
            yield pd.DataFrame({"series_id": "s", "i": i, "t": i / 5000, "x": np.sin(i * 0.0754), "gone": False})

    tracemalloc.start()
    count = sum(len(piece) for piece in make(Recorded())(("s",), frames(), State()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == n and peak < 100 * n
