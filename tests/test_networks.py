"""Channels and nodes by chunks, and nodes from a table."""

import numpy as np
import pytest

from hertzlake.config import MultiConfig, NetworkConfig, ZcdConfig
from hertzlake.operators import fusion, pmu
from hertzlake.sources import signals


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(11)
    rows = [(i, i * 0.0002, f"n{k}", float(x)) for k in range(3) for i, x in enumerate(rng.normal(size=40 + 9 * k))]
    return spark.createDataFrame(rows, "i long, t double, node string, value double")


def loop(times, xs, nominal=60.0):
    """Frequency and rate after each sample, sample by sample."""
    anchor, f, r, seen = None, None, 0.0, []
    for k in range(len(xs)):
        if k and xs[k - 1] < 0 <= xs[k]:
            t = times[k - 1] + (times[k] - times[k - 1]) * (0 - xs[k - 1]) / (xs[k] - xs[k - 1])
            if anchor is not None and 1e-6 <= t - anchor <= 1.0:
                new = 1 / (t - anchor)
                f, r = new, 0.0 if f is None else (new - f) / (t - anchor)
            if anchor is None or t - anchor <= 1.0:
                anchor = t
        seen.append((nominal if f is None else f, r))
    return seen


@pytest.mark.parametrize("chunk", [None, 7, 1 << 20])
def test_nodes_equal_the_loop(spark, samples, chunk):
    names = ["n0", "n1", "absent"]  # n2 has the most samples, whose times all nodes have
    rows = {(r.node, r.i): r.value for r in samples.collect()}
    times = [i * 0.0002 for i in range(58)]
    local = {n: loop(times, [rows.get((n, i), 0.0) for i in range(58)]) for n in names}
    for nodes in (tuple(names), spark.createDataFrame([(n,) for n in [*names, "n0"]], "node string")):
        found = fusion.fused_nodes(samples, spark.createDataFrame([], "src string, dst string"), NetworkConfig(nodes, fuse="mean"), chunk).collect()
        assert len(found) == 3 * 58
        for r in found:
            means = np.mean([local[n][r.i] for n in names], axis=0)
            assert np.allclose((r.local_hz, r.local_rocof_hz_s, r.frequency_hz, r.rocof_hz_s), (*local[r.node][r.i], *means), rtol=1e-6)


def test_a_map_a_step(spark, samples):
    edges = spark.createDataFrame([("n0", "n1"), ("n1", "n0"), ("n2", "n0")], "src string, dst string")
    config = NetworkConfig(("n0", "n1", "n2"), alpha=0.5)
    flat = fusion.fused_nodes(samples, edges, config, 16).collect()
    steps = {r.i: r for r in fusion.fused_network(samples, edges, config).collect()}
    assert len(steps) == 58 and len(flat) == 3 * 58
    for r in flat:
        step = steps[r.i]
        assert np.allclose((*step.local[r.node], step.frequency_hz, step.rocof_hz_s), (r.local_hz, r.local_rocof_hz_s, r.frequency_hz, r.rocof_hz_s))


def test_many_nodes_and_none(spark, monkeypatch):
    monkeypatch.setattr(fusion, "NODES_A_ROW", 10)
    times = spark.createDataFrame([(0, 0.0), (1, 0.1)], "i long, t double")
    nodes = spark.range(95).selectExpr("'x' || id AS node", "id AS extra")
    for most in (0, 100_000):
        monkeypatch.setattr(fusion, "SMALL_GRAPH", most)
        found = fusion.with_nodes(times, nodes).collect()
        assert sorted((r.i, r.node) for r in found) == sorted((i, f"x{k}") for i in (0, 1) for k in range(95))
    assert fusion.with_nodes(times, nodes.limit(0)).count() == 0
    none = spark.createDataFrame([], "i long, t double, node string, value double")
    edges = spark.createDataFrame([], "src string, dst string")
    for config in (NetworkConfig(nodes.limit(0)), NetworkConfig(("a",)), NetworkConfig(nodes, fuse="mean")):
        assert fusion.fused_nodes(none, edges, config, 8).count() == 0


def test_channels_by_chunk(spark):
    rng = np.random.default_rng(3)
    rows = [("s", i, i * 0.0002, *map(float, rng.normal(size=2))) for i in range(50)]
    wide = spark.createDataFrame(rows, "series_id string, i long, timestamp double, V1 double, V2 double")
    for config in (MultiConfig(), MultiConfig(zcd=ZcdConfig(mode="either"))):
        whole, cut = (sorted(map(tuple, fusion.channel_traces(wide, config, chunk).collect())) for chunk in (None, 6))
        assert len(whole) == 150 and [x[:4] for x in whole] == [x[:4] for x in cut]
        assert np.allclose([x[4:] for x in whole], [x[4:] for x in cut])


def test_windows_over_series_only_without_chunks(spark):
    rows = spark.range(40).selectExpr("'s' AS series_id", "id AS i", "id * 0.0002D AS timestamp", "sin(id) AS V1")
    for find in (lambda chunk: fusion.channel_traces(rows, MultiConfig(), chunk), lambda chunk: pmu.zcd_estimates(rows, chunk=chunk)):
        plans = [find(chunk)._jdf.queryExecution().optimizedPlan().toString() for chunk in (None, 8)]
        assert ["Window" in x for x in plans] == [True, False]
        whole, cut = (sorted((r.i, round(r.frequency_hz, 6)) for r in find(chunk).collect()) for chunk in (None, 8))
        assert len(whole) >= 40 and whole == cut


def test_places(spark):
    found = {r.name: r.k for r in signals.numbered(spark.range(300).selectExpr("printf('%04d', id * 7) AS name").repartition(9), "name").collect()}
    assert found == {f"{k * 7:04d}": k for k in range(300)}
