"""The gated fold by chunk against the loop over all crossings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hertzlake.config import ZcdConfig
from hertzlake.operators import zcd
from hertzlake.plans import queries
from hertzlake.sources.tables import event_signal

CONFIGS = [
    ZcdConfig(epsilon=0.8), ZcdConfig(mode="either"), ZcdConfig(min_period_s=0.003), ZcdConfig(epsilon=0.5, mode="either", min_period_s=0.002, max_period_s=0.05),
]


def signal_of(spark):
    rng, rows = np.random.default_rng(5), []
    for name in ("a", "b", None):
        x = rng.normal(size=1500)
        if name == "b":
            x[400:800] = -5.0  # longer than the longest period of one configuration
        rows += [(name, k, k / 5000, None if name == "a" and k % 97 == 0 else float(v)) for k, v in enumerate(x)]
    rows += [("flat", k, k / 5000, 1.0) for k in range(300)] + [("one", 0, 0.0, -1.0), ("one", 1, 0.1, 1.0)]
    return spark.createDataFrame(rows, "series_id string, i long, t double, x double")


def loop(rows, config):
    """The state machine, sample by sample."""
    sign = lambda x: int(x > config.epsilon) - int(x < -config.epsilon)
    x0 = t0 = anchor = f = r = None
    out = []
    for i, t, x in rows:
        if x0 is not None and x is not None:
            a, b = sign(x0), sign(x)
            hit = {"neg_to_pos": a == -1 and b >= 0, "pos_to_neg": a == 1 and b <= 0}.get(config.mode, a != 0 and b not in (0, a))
            if hit:
                time = t0 + (t - t0) * (-x0 / (x - x0))
                if anchor is None:
                    anchor = time
                elif config.min_period_s <= time - anchor <= config.max_period_s:
                    r = None if f is None else (1 / (time - anchor) - f) / (time - anchor)
                    f, anchor = 1 / (time - anchor), time
        x0, t0 = x, t
        out.append((i, 60.0 if f is None else f, 0.0 if r is None else r))
    return out


@pytest.mark.parametrize("config", CONFIGS)
@pytest.mark.parametrize("chunk", [100, 1 << 20])
def test_chunks_equal_the_loop(spark, monkeypatch, config, chunk):
    def none(*_):
        raise AssertionError("a whole series in one task")

    monkeypatch.setattr(zcd, "_folded", none)
    signal = signal_of(spark)
    found = {(r.series_id, r.i): (r.frequency_hz, r.rocof_hz_s) for r in zcd.zcd_trace_chunked(signal, config, chunk, fold=True).collect()}
    rows = signal.collect()
    for name in {r.series_id for r in rows}:
        own = sorted((r.i, r.t, r.x) for r in rows if r.series_id == name)
        for i, f, r in loop(own, config):
            assert math.isclose(found.pop((name, i))[0], f, rel_tol=1e-12), (name, i)
    assert not found


def test_successors_equal_a_search():
    rng = random.Random(1)
    for _ in range(300):
        times = np.cumsum([rng.choice((0.0, 0.1, 0.4, -0.2, 2.0)) for _ in range(rng.randrange(1, 25))])
        times[rng.randrange(len(times))] = math.nan
        config = ZcdConfig(min_period_s=rng.choice((1e-6, 0.3)), max_period_s=rng.choice((0.5, 1.0)))
        fits = lambda a, b: config.min_period_s <= b - a <= config.max_period_s
        expected = [next((j for j in range(k + 1, len(times)) if fits(times[k], times[j])), len(times)) for k in range(len(times))]
        assert zcd.successors(times, times, np.arange(len(times)) + 1, config).tolist() == expected


def test_one_task_per_chunk(spark, folder):
    """Crossings of a series go to as many groups as it has chunks."""
    signal = event_signal(spark, folder)
    marked = zcd._chunks(signal, ZcdConfig(mode="either"), 50)
    exits = zcd._exits(marked.filter("crossed").select("series_id", "chunk", F.lit(0).alias("kind"), "i", F.col("t_cross").alias("t")), ZcdConfig(mode="either"))
    counts = exits.groupBy("series_id").agg(F.count_distinct("chunk").alias("chunks"), F.count("*").alias("n")).collect()
    assert all(r.chunks > 2 and r.n <= 4 * r.chunks for r in counts)


@pytest.mark.parametrize("name", ["zcd_either", "zcd_deadband", "zcd_debounce_fold"])
def test_queries_take_no_series_whole(spark, folder, monkeypatch, name):
    monkeypatch.setattr(zcd, "_folded", None)
    assert queries.QUERIES[name](spark, folder).count() > 0
