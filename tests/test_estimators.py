"""Estimators against a sequential loop, and properties of the plans."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hertzlake.config import IpdftConfig, MultiConfig, NetworkConfig, RampStep, ZcdConfig
from hertzlake.operators import fusion, ipdft, metrics, pmu, products, spectral, zcd
from hertzlake.plans import benchmark, queries
from hertzlake.sources import signals

SCHEMA = "series_id string, i long, t double, x double"


def loop(t, x, config):
    """Frequency and rate of each sample, one after the other."""
    sign = lambda v: int(v > config.epsilon) - int(v < -config.epsilon)
    x0 = t0 = anchor = f = r = None
    for now, v in zip(t, x):
        if x0 is not None:
            a, b = sign(x0), sign(v)
            rule = {"neg_to_pos": a == -1 and b >= 0, "pos_to_neg": a == 1 and b <= 0}
            if rule.get(config.mode, a != 0 and b not in (0, a)):
                time = t0 + (now - t0) * (-x0 / (v - x0))
                if anchor is None:
                    anchor = time
                elif config.min_period_s <= time - anchor <= config.max_period_s:
                    gap = time - anchor
                    r, f, anchor = (None if f is None else (1 / gap - f) / gap), 1 / gap, time
        x0, t0 = v, now
        yield config.nominal_hz if f is None else f, 0.0 if r is None else r


def frame(spark, series):
    rows = [(s, i, float(t), float(x)) for s, (ts, xs) in series.items() for i, (t, x) in enumerate(zip(ts, xs))]
    return spark.createDataFrame(rows, SCHEMA)


def noisy(n=3000, fs=5000.0, sigma=0.1, seed=1):
    t = np.arange(n) / fs
    return t, np.sin(2 * np.pi * 60 * t) + np.random.default_rng(seed).normal(0, sigma, n)


def traced(df):
    return df.toPandas().sort_values(["series_id", "i"])


CONFIGS = [
    (ZcdConfig(), None), (ZcdConfig(mode="pos_to_neg"), None), (ZcdConfig(mode="either"), None), (ZcdConfig(mode="other"), None), (ZcdConfig(epsilon=0.05), None),
    (ZcdConfig(epsilon=0.2), None), (ZcdConfig(epsilon=0.05, mode="either"), None), (ZcdConfig(min_period_s=0.005), True), (ZcdConfig(max_period_s=0.01), None),
]


@pytest.mark.parametrize("config,fold", CONFIGS)
@pytest.mark.parametrize("plan", ["whole", "chunked"])
def test_zcd_equals_loop(spark, config, fold, plan):
    series = {"a": noisy(), "b": noisy(700, seed=2), "one": ([0.0], [1.0]), "zeros": (np.arange(50) / 100, np.zeros(50))}
    signal = frame(spark, series)
    found = traced(zcd.zcd_trace(signal, config, fold) if plan == "whole" else zcd.zcd_trace_chunked(signal, config, 333, fold))
    for name, (t, x) in series.items():
        own = found[found.series_id == name]
        expected = np.array(list(loop(t, x, config)))
        np.testing.assert_allclose(own.frequency_hz, expected[:, 0], rtol=1e-9)
        np.testing.assert_allclose(own.rocof_hz_s, expected[:, 1], rtol=1e-6, atol=1e-6)


def test_latch_freezes_the_estimate(spark):
    t = np.arange(30000) / 5000
    x = np.where((t >= 1) & (t < 2.5), -1.0, np.sin(2 * np.pi * 50 * t + 0.1))
    found = traced(zcd.zcd_trace(frame(spark, {"s": (t, x)})))
    np.testing.assert_allclose(found.frequency_hz, [f for f, _ in loop(t, x, ZcdConfig())], rtol=1e-9)
    assert found.frequency_hz[found.t > 2.6].nunique() == 1


@pytest.mark.parametrize("at", [0, 40, 200])
@pytest.mark.parametrize("trace", [lambda x: zcd.zcd_trace(x), lambda x: zcd.zcd_trace(x, fold=True), lambda x: zcd.zcd_trace_chunked(x, chunk=77)])
def test_nan_samples(spark, at, trace):
    t, x = noisy(1500)
    x = x.copy()
    x[at : at + 40] = math.nan
    found = traced(trace(frame(spark, {"s": (t, x)})))
    np.testing.assert_allclose(found.frequency_hz, [f for f, _ in loop(t, x, ZcdConfig())], rtol=1e-9)


@pytest.mark.parametrize("trace", [lambda x: zcd.zcd_trace(x), lambda x: zcd.zcd_trace(x, fold=True), lambda x: zcd.zcd_trace_chunked(x, chunk=50), lambda x: zcd.zcd_trace_chunked(x, chunk=50, fold=True)])
def test_a_null_series_is_a_series(spark, trace):
    signal = frame(spark, {"a": noisy(600)})
    both = signal.union(signal.withColumn("series_id", F.lit(None).cast("string")))
    found = trace(both).toPandas().sort_values("i")
    alone, other = (found[known].frequency_hz.to_numpy() for known in (found.series_id.notna(), found.series_id.isna()))
    np.testing.assert_array_equal(alone, other)
    assert len(set(alone)) > 2


def test_crossings_can_go_back_with_a_deadband(spark):
    x = [-1, -0.21, -0.19, -1, 1]
    found = zcd.crossings(frame(spark, {"s": (np.arange(5) / 1000, x)}), ZcdConfig(epsilon=0.2)).orderBy("n").collect()
    assert [round(r.t_cross, 6) for r in found] == [0.0115, 0.0035]


def test_debounce_and_latch_by_crossing_times(spark):
    times = [0.1, 0.10000005, 0.2, 0.3, 0.35, 1.2, 2.5, 2.6]
    marked = spark.createDataFrame([("s", i, True, t) for i, t in enumerate(times)], "series_id string, i long, crossed boolean, t_cross double")
    assert [r.i for r in zcd._folded(marked, ZcdConfig()).orderBy("i").collect()] == [2, 3, 4, 5]


def test_other_series_and_partitions_change_nothing(spark):
    t, x = noisy(800)
    alone = traced(zcd.zcd_trace(frame(spark, {"a": (t, x)})))
    with_more = traced(zcd.zcd_trace(frame(spark, {"a": (t, x), "b": noisy(500, seed=3)}).repartition(7)))
    pd.testing.assert_frame_equal(alone, with_more[with_more.series_id == "a"].reset_index(drop=True), check_dtype=False)
    louder = traced(zcd.zcd_trace(frame(spark, {"a": (t, x * 4)})))
    np.testing.assert_array_equal(alone.frequency_hz, louder.frequency_hz)


def test_zcd_windows_use_one_exchange_and_no_python(spark, capsys):
    zcd.zcd_trace(frame(spark, {"a": noisy(50)})).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan
    assert plan.split("Initial Plan")[0].count("Exchange") == 1


def test_benchmark_rmse(spark):
    row = benchmark.run_matrix(spark, ["frequency_step"], ["zcd"]).first()
    assert (row.n_samples, round(row.rmse, 7)) == (20000, 0.0427059)


def test_ipdft_smoke(spark):
    found = ipdft.ipdft_trace(signals.clean(spark, 60.0, 0.1, 0.2), IpdftConfig(5000.0, 256)).toPandas().sort_values("i")
    assert len(found) == 1000
    assert round(found.frequency_hz.mean(), 4) == 58.9946
    assert round(found.frequency_hz[found.i >= 255].mean(), 4) == 58.6505


@pytest.mark.parametrize("n", [31, 32, 33, 400])
def test_ipdft_forms_agree(spark, n):
    config = IpdftConfig(5000.0, 32)
    signal = frame(spark, {"a": noisy(n), "b": noisy(n // 2, seed=4)})
    sql, arrow = (traced(f) for f in (ipdft.ipdft_trace_sql(signal, config), ipdft.ipdft_trace(signal, config, chunk=50)))
    np.testing.assert_allclose(sql.frequency_hz, arrow.frequency_hz, atol=1e-6)
    np.testing.assert_allclose(sql.rocof_hz_s, arrow.rocof_hz_s, atol=1e-2)


@pytest.mark.parametrize("value", [0.0, 1.0])
def test_constant_frames_are_zero_hertz(spark, value):
    found = ipdft.ipdft_trace(frame(spark, {"a": (np.arange(64) / 5000, np.full(64, value))}), IpdftConfig(5000.0, 32)).toPandas()
    assert (found.frequency_hz[found.i >= 31] == 0).all() and (found.frequency_hz[found.i < 31] == 60).all()


@pytest.mark.parametrize("fs,duration,n", [(5000, 0.2, 1000), (5000, 4, 20000), (5000, 5, 25000), (5000, 6, 30000), (4800, 1.1, 5280), (10000, 0.3, 3000), (1000, 0.7, 700)])
def test_sample_counts(spark, fs, duration, n):
    assert signals.samples(spark, duration, fs, "s").count() == n


def test_overlapping_ramps_jump(spark):
    found = signals.ramp_step(spark, RampStep(60.0, 59.0, 1.0, 1.5), 3.0, 100.0, 1.0).toPandas().sort_values("i")
    at = dict(zip(found.i, found.f_true))
    assert math.isclose(at[199], 59.01, abs_tol=1e-9) and math.isclose(at[200], 59.5, abs_tol=1e-9)


def test_wrong_configurations_raise(spark):
    for wrong in (lambda: IpdftConfig.of({}), lambda: IpdftConfig(0.0), lambda: IpdftConfig(1.0, 2), lambda: NetworkConfig(()), lambda: signals.ramp_step(spark, fs=0.0)):
        with pytest.raises(ValueError):
            wrong()
    assert ZcdConfig.single({"mode": "x", "eps": 0.1}) == ZcdConfig(epsilon=0.1)
    assert ZcdConfig.general({"mode": "x"}).mode == "x"
    assert MultiConfig.of({"channels": ["Q"]}).channels == ("V1", "V2", "V3")


def test_consensus_of_the_direct_formula(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("c", "a"), ("c", "z")], "src string, dst string")
    values = spark.createDataFrame([("a", 60.0), ("b", 59.0), ("c", 61.0), ("d", 58.0)], "node string, f double")
    found = {r.node: r.f for r in fusion.consensus_step(values, edges, 0.5).collect()}
    third = 1 / 3
    expected = {
        "a": 0.5 * 60 + 0.5 * (third * 60 + third * 59 + third * 61), "b": 0.5 * 59 + 0.5 * (2 * third * 59 + third * 60),
        "c": 0.5 * 61 + 0.5 * (third * 61 + third * 60 + third * 61), "d": 58.0,
    }
    assert all(math.isclose(found[k], expected[k], rel_tol=1e-12) for k in expected)
    none = {r.node: r.f for r in fusion.consensus_step(values, edges.limit(0)).collect()}
    assert set(none.values()) == {59.5}


def direct_weights(adjacency):
    """The definition, entry by entry of the neighbours' lists."""
    degree = {a: max(1, len(near)) for a, near in adjacency.items()}
    found = {}
    for a, near in adjacency.items():
        for b in near:
            found[a, b] = 1 / (1 + max(degree[a], degree.get(b, 1)))
        found[a, a] = max(0.0, 1 - sum(1 / (1 + max(degree[a], degree.get(b, 1))) for b in near))
    return found


@pytest.mark.parametrize("pairs", ["ab ab", "ab ab ba", "aa ab ba", "aa aa ab az", "ab bc ca cb ac ba ba cc"])
@pytest.mark.parametrize("small", [100_000, 0])
def test_repeated_edges_and_edges_to_itself(spark, monkeypatch, pairs, small):
    monkeypatch.setattr(fusion, "SMALL_GRAPH", small)
    adjacency = {}
    for pair in pairs.split():
        adjacency.setdefault(pair[0], []).append(pair[1])
    edges = spark.createDataFrame([tuple(p) for p in pairs.split()], "src string, dst string")
    weights = direct_weights(adjacency)
    found = {(r.src, r.dst): r.w for r in fusion.metropolis_weights(edges).collect()}
    assert found.keys() == weights.keys() and all(math.isclose(found[k], weights[k], rel_tol=1e-12) for k in weights)
    values = {"a": 60.0, "b": 60.5, "c": 59.0, "d": 61.0}
    stepped = {r.node: r.f for r in fusion.consensus_step(spark.createDataFrame(list(values.items()), "node string, f double"), edges, 0.7).collect()}
    for node, f in values.items():
        around = sum(weights[node, b] * values.get(b, f) for b in adjacency.get(node, []))
        expected = 0.3 * f + 0.7 * (weights.get((node, node), 1.0) * f + around)
        assert math.isclose(stepped[node], expected, rel_tol=1e-12)


def test_equal_frequencies_stay(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b")], "src string, dst string")
    values = spark.createDataFrame([("a", 60.0), ("b", 60.0)], "node string, f double")
    assert {round(r.f, 9) for r in fusion.consensus_step(values, edges).collect()} == {60.0}


def test_strict_scores_and_validation_raise(spark):
    estimates = spark.createDataFrame([("s", 0, 1.0)], "series_id string, i long, frequency_hz double")
    truth = spark.createDataFrame([("s", 1, 1.0)], "series_id string, i long, f_true double")
    with pytest.raises(ValueError):
        metrics.frequency_rmse(estimates, truth, strict=True)
    assert metrics.frequency_rmse(estimates.limit(0), truth).count() == 0
    only_nan = estimates.withColumn("frequency_hz", F.lit(math.nan))
    assert math.isnan(metrics.frequency_rmse(only_nan, truth.withColumn("i", F.lit(0))).first().rmse)
    samples = pmu.as_samples(frame(spark, {"s": ([0.0, 1.0], [1.0, math.inf])}))
    assert pmu.validated(samples).count() == 1
    with pytest.raises(Exception, match="not finite"):
        pmu.validated(samples, strict=True).collect()
    with pytest.raises(Exception):
        pmu.channel_signal(samples, "V9", required=True).collect()
    assert pmu.channel_signal(samples, "V9").first().x == 0.0


def test_queue_equals_loop(spark):
    rng = np.random.default_rng(5)
    arrival, service = np.cumsum(rng.exponential(1, 200)), rng.exponential(1, 200)
    rows = [("s", i, float(a), float(b), 2.0) for i, (a, b) in enumerate(zip(arrival, service))]
    found = metrics.queue_times(spark.createDataFrame(rows, "series_id string, i long, arrival double, service double, deadline double")).toPandas().sort_values("i")
    end, expected = 0.0, []
    for a, b in zip(arrival, service):
        end = max(end, a) + b
        expected.append(end)
    np.testing.assert_allclose(found.finish, expected, rtol=1e-12)


def test_files_round_trip(spark, tmp_path):
    results = benchmark.run_matrix(spark, ["clean_drift"], ["zcd"], with_estimates=True)
    target = products.run_folder(str(tmp_path))
    products.write_run(results, target)
    back = spark.read.parquet(f"{target}/results").first()
    assert back.n_samples == 1000 and len(back.f_hat) == 1000
    with pytest.raises(Exception):
        products.write_run(results, target)


def test_reports(spark):
    results = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 2.0), ("c", 3.0, 2.5)], "name string, cost double, rmse double")
    assert sorted(r.name for r in products.pareto_front(results, "cost", "rmse").collect()) == ["a", "b"]
    judged = {r.name: (r.passed, r.reasons) for r in metrics.verdicts(results, {"cost": 2.5, "rmse": 2.9}).collect()}
    assert judged["a"] == (False, "rmse > 2.9") and judged["b"] == (True, "") and not judged["c"][0]


def test_noise_does_not_depend_on_partitions(spark):
    tone = signals.clean(spark, duration=0.1)
    one, other = (traced(signals.with_noise(x, 0.1, 7)) for x in (tone, tone.repartition(5)))
    np.testing.assert_array_equal(one.x, other.x)
    assert 0.08 < float(np.std(one.x - traced(tone).x)) < 0.12


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,time,volt\n0,0.0,1.5\n1,0.1,-2\n")
    found = signals.from_csv(spark, str(tmp_path / "a.csv"), {"i": "n", "t": "time", "x": "volt"}).orderBy("i").collect()
    assert [(r.i, r.x) for r in found] == [(0, 1.5), (1, -2.0)]


def test_reports_of_suites(spark):
    rows = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 2.0), ("t", "a", 3.0)], "scenario string, name string, rmse double")
    cells = {r.scenario: (r.a, r.b) for r in products.heatmap(rows, "scenario", "name", "rmse", ["a", "b"]).collect()}
    assert cells == {"s": (1.0, 2.0), "t": (3.0, None)}
    golden = spark.createDataFrame([("s", "a", 1.02), ("s", "b", 2.5), ("u", "a", 1.0)], rows.schema)
    passed = {(r.scenario, r["name"]): r.passed for r in metrics.golden_gaps(rows, golden, ("scenario", "name"), "rmse").collect()}
    assert passed == {("s", "a"): True, ("s", "b"): False, ("t", "a"): False, ("u", "a"): False}
    assert metrics.suite_digest(rows) == metrics.suite_digest(rows.repartition(3)) != metrics.suite_digest(rows.union(rows.limit(1)))
    tone = signals.clean(spark, 60.0, 0.1, 0.2)
    assert metrics.truth_gaps(tone, F.lit(60.0) + 0.5 * F.col("t")).first().n_wrong == 0
    wrong = metrics.truth_gaps(tone.withColumn("f_true", F.when(F.col("i") == 7, math.nan).when(F.col("i") != 8, F.col("f_true"))), F.lit(60.0) + 0.5 * F.col("t")).first()
    assert (wrong.n_samples, wrong.n_wrong) == (1000, 2)
    exact, near = (metrics.error_quantiles(zcd.zcd_trace(tone), tone, a).first() for a in (None, 10000))
    assert abs(exact.fe_p95 - near.fe_p95) < 1e-3


def test_registries(spark, monkeypatch):
    monkeypatch.setattr(benchmark, "SCENARIOS", dict(benchmark.SCENARIOS))
    monkeypatch.setattr(benchmark, "ESTIMATORS", dict(benchmark.ESTIMATORS))
    benchmark.register_scenario("short", lambda s: signals.clean(s, 60.0, 0.0, 0.1, 5000.0, "short"))
    benchmark.register_estimator("constant", lambda signal: signal.select("series_id", "i", "t", F.lit(61.0).alias("frequency_hz"), F.lit(0.0).alias("rocof_hz_s")))
    assert "short" in benchmark.list_scenarios() and "constant" in benchmark.list_estimators()
    row = benchmark.run_matrix(spark, ["short"], ["constant"]).first()
    assert (row.n_samples, row.rmse) == (500, 1.0)
    assert benchmark.run_matrix(spark, ["short"], ["constant"], warm_up=100).first().n_samples == 400
    with pytest.raises(NotImplementedError):
        benchmark.ESTIMATORS["constant"].stream(None)


def test_spectral_estimators_on_a_pure_tone(spark):
    tone = signals.clean(spark, 60.2, 0.0, 0.3)
    found = spectral.sliding_dft_trace(tone, IpdftConfig(5000.0, 250)).filter("i > 250").toPandas()
    assert abs(found.frequency_hz.mean() - 60.2) < 0.01
    grid = tuple(59.0 + 0.1 * k for k in range(21))
    far = spectral.goertzel_trace(tone, IpdftConfig(5000.0, 1000), grid).filter("i > 1000").toPandas()
    assert abs(far.frequency_hz.mean() - 60.2) < 0.11


def test_phasors_are_the_channels_samples(spark):
    rows = [("u", i, float(i), 2.0, -3.0, 4.0, 5.0, i / 100) for i in range(40)]
    samples = spark.createDataFrame(rows, "series_id string, i long, V1 double, V2 double, V3 double, I1 double, I2 double, timestamp double")
    for row in pmu.ipdft_estimates(samples, IpdftConfig(100.0, 8)).collect():
        assert {k: (z.re, z.im) for k, z in row.phasors.items()} == {"V1": (row.i, 0), "V2": (2, 0), "V3": (-3, 0), "I1": (4, 0), "I2": (5, 0), "I3": (0, 0)}


def test_event_types_are_the_first_in_order(spark, tmp_path):
    types = spark.range(20000).select(F.format_string("e%05d", "id").alias("event_type"))
    types.union(spark.createDataFrame([(None,)], "event_type string")).write.parquet(f"{tmp_path}/events.parquet")
    assert list(queries._event_types(spark, str(tmp_path))) == [f"e0000{k}" for k in range(5)]
