"""The benchmark: scenarios by estimators, scored against the truth."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IpdftConfig, RampStep, ZcdConfig
from ..functions.columns import nan_if_null
from ..operators.ipdft import ipdft_trace
from ..operators.metrics import rmse_of, without_warm_up
from ..operators.products import as_arrays
from ..operators.zcd import zcd_trace
from ..sources import signals
from ..streaming.stateful import ipdft_stream, zcd_stream

Scenario = Callable[[SparkSession], DataFrame]
FS = 5000.0


class Estimator(Protocol):
    """From a signal (series_id, i, t, x) to series_id, i, t, frequency_hz, rocof_hz_s and more.

    batch may keep the columns named; a sample's state is that of its series' samples before it, and starts
    anew with each series, so nothing needs a reset between runs. stream is the same over a stream.
    """

    def batch(self, signal: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame: ...

    def stream(self, signal: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Zcd:
    config: ZcdConfig = ZcdConfig()

    def batch(self, signal: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        return zcd_trace(signal, self.config, keep=keep)

    def stream(self, signal: DataFrame) -> DataFrame:
        return zcd_stream(signal, self.config)


@dataclass(frozen=True)
class Ipdft:
    config: IpdftConfig = IpdftConfig(FS, 256)

    def batch(self, signal: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        return ipdft_trace(signal, self.config, keep=keep)

    def stream(self, signal: DataFrame) -> DataFrame:
        return ipdft_stream(signal, self.config)


@dataclass(frozen=True)
class BatchOnly:
    """A function of a signal as an estimator without a stream form."""

    trace: Callable[[DataFrame], DataFrame]

    def batch(self, signal: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        return self.trace(signal)

    def stream(self, signal: DataFrame) -> DataFrame:
        raise NotImplementedError("this estimator has no stream form")


SCENARIOS: dict[str, Scenario] = {
    "frequency_step": lambda s: signals.frequency_step(s, 60.0, 59.5, 1.0, 2.0, 4.0, FS, "frequency_step"),
    "clean_drift": lambda s: signals.clean(s, 60.0, 0.1, 0.2, FS, "clean_drift"),
    "ramp_step": lambda s: signals.ramp_step(s, RampStep(60.0, 59.5, 0.5, 1.5), 2.0, FS, 1.0, "ramp_step"),
}
ESTIMATORS: dict[str, Estimator] = {"zcd": Zcd(), "ipdft": Ipdft()}


def register_scenario(name: str, scenario: Scenario) -> None:
    SCENARIOS[name] = scenario


def register_estimator(name: str, estimator: Estimator | Callable[[DataFrame], DataFrame]) -> None:
    """An estimator, or a function of a signal."""
    ESTIMATORS[name] = estimator if hasattr(estimator, "batch") else BatchOnly(estimator)


def list_scenarios() -> list[str]:
    return sorted(SCENARIOS)


def list_estimators() -> list[str]:
    return sorted(ESTIMATORS)


def _named(chosen: Iterable[str] | Mapping | None, known: Mapping) -> Mapping:
    return chosen if isinstance(chosen, Mapping) else {name: known[name] for name in (sorted(known) if chosen is None else chosen)}


def estimates(
    spark: SparkSession, scenarios: Iterable[str] | Mapping[str, Scenario] | None = None, estimators: Iterable[str] | Mapping[str, Estimator] | None = None, warm_up: int = 0
) -> DataFrame:
    """scenario, name, series_id, i, t, frequency_hz, rocof_hz_s, f_true of every estimator on every scenario, without the warm-up samples.

    Both are names of the registries, all of them, or their own by name. No state passes between them. An estimator that doesn't keep f_true is joined with it by sample.
    """
    parts, columns = [], ["series_id", "i", "t", "frequency_hz", "rocof_hz_s", "f_true"]
    for scenario, made in _named(scenarios, SCENARIOS).items():
        signal = made(spark)
        for name, estimator in _named(estimators, ESTIMATORS).items():
            traced = estimator.batch(signal, ("f_true",))
            if "f_true" not in traced.columns:
                traced = traced.join(signal.select("series_id", "i", "f_true"), ["series_id", "i"])
            parts.append(without_warm_up(traced, warm_up).select(F.lit(scenario).alias("scenario"), F.lit(name).alias("name"), *columns))
    return reduce(DataFrame.unionByName, parts)


def run_matrix(
    spark: SparkSession, scenarios: Iterable[str] | Mapping[str, Scenario] | None = None, estimators: Iterable[str] | Mapping[str, Estimator] | None = None,
    with_estimates: bool = False, warm_up: int = 0,
) -> DataFrame:
    """scenario, name, n_samples, rmse and, if asked for, f_hat; a NaN or null estimate is counted but not scored."""
    every = estimates(spark, scenarios, estimators, warm_up)
    real = F.when(~F.isnan(nan_if_null(F.col("frequency_hz"))), F.col("frequency_hz"))
    keys = ["scenario", "name"]
    scored = every.groupBy(*keys).agg(F.count("*").alias("n_samples"), nan_if_null(rmse_of(real, F.col("f_true"))).alias("rmse"))
    if not with_estimates:
        return scored
    keyed = every.withColumn("series_id", F.concat_ws("\x1f", *keys))
    parts = F.split("series_id", "\x1f")
    return scored.join(as_arrays(keyed).select(parts[0].alias("scenario"), parts[1].alias("name"), "f_hat"), keys)
