"""PMU records: samples, estimates and their flat form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IpdftConfig, ZcdConfig
from ..functions.columns import all_finite, angle, complex_of, magnitude
from ..schema import CHANNELS, PHASORS
from .ipdft import ipdft_trace
from .zcd import traced


def as_samples(signal: DataFrame, channel: str = "V1") -> DataFrame:
    """PMU samples with the signal in one channel and 0 in the others."""
    fields = [(F.col("x") if c == channel else F.lit(0.0)).alias(c) for c in CHANNELS]
    return signal.select("series_id", "i", *fields, F.col("t").alias("timestamp"))


def pivoted(signal: DataFrame, channels: dict[str, str]) -> DataFrame:
    """One PMU series of several signals: channels maps series_id to channel; channels not named, and samples not there, are 0."""
    named = {c: s for s, c in channels.items()}
    value = lambda c: F.coalesce(F.max(F.when(F.col("series_id") == named[c], F.col("x"))), F.lit(0.0)) if c in named else F.lit(0.0)
    picked = signal.filter(F.col("series_id").isin(*channels))
    grouped = picked.groupBy("i").agg(*(value(c).alias(c) if c in named else F.max(F.lit(0.0)).alias(c) for c in CHANNELS), F.max("t").alias("timestamp"))
    return grouped.select(F.lit("pmu").alias("series_id"), "i", *CHANNELS, "timestamp")


def channel_signal(samples: DataFrame, channel: str, required: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """A channel of PMU samples as a signal, and the columns to keep; a channel that isn't there is 0, or an error if required."""
    x = F.col(channel) if required or channel in samples.columns else F.lit(0.0)
    return samples.select("series_id", "i", F.col("timestamp").alias("t"), x.cast("double").alias("x"), *keep)


def validated(samples: DataFrame, strict: bool = False) -> DataFrame:
    """The samples whose fields are finite numbers; strict: an error at the first other one."""
    if strict:
        checked = F.when(all_finite(), F.col("timestamp")).otherwise(F.raise_error(F.lit("a sample is not finite")).cast("double"))
        return samples.withColumn("timestamp", checked)
    return samples.filter(all_finite())


def _estimates(trace: DataFrame, phasors: Column) -> DataFrame:
    return trace.select(
        "series_id", "i", F.col("t").alias("timestamp_utc"), "frequency_hz", "rocof_hz_s", F.lit(0).alias("status_word"), phasors.alias("phasors")
    )


def zcd_estimates(samples: DataFrame, config: ZcdConfig = ZcdConfig(), chunk: int | None = None) -> DataFrame:
    """PMU estimates by zero crossings of one channel, without phasors; by chunks of samples if i numbers a series' samples from 0."""
    return _estimates(traced(channel_signal(samples, config.channel, required=True), config, chunk), F.create_map().cast(PHASORS))


def ipdft_estimates(samples: DataFrame, config: IpdftConfig) -> DataFrame:
    """PMU estimates by the interpolated DFT of one channel; the phasors are the six channels' samples, 0 for one that isn't there."""
    fields = [(F.col(c) if c in samples.columns else F.lit(0.0)).cast("double").alias(c) for c in CHANNELS]
    signal = channel_signal(samples.select("*", *(f for c, f in zip(CHANNELS, fields) if c not in samples.columns)), config.channel, keep=CHANNELS)
    trace = ipdft_trace(signal, config, keep=CHANNELS)
    return _estimates(trace, F.create_map(*(part for c in CHANNELS for part in (F.lit(c), complex_of(F.col(c))))))


def standard_rows(estimates: DataFrame, names: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Flat rows: TIMESTAMP_UTC, FREQUENCY_HZ, ROCOF_HZ_S, STATUS_WORD and magnitude and angle of each named phasor."""
    flat = [F.col("timestamp_utc").alias("TIMESTAMP_UTC"), F.col("frequency_hz").alias("FREQUENCY_HZ"), F.col("rocof_hz_s").alias("ROCOF_HZ_S"), F.col("status_word").alias("STATUS_WORD")]
    for name in names:
        z = F.try_element_at("phasors", F.lit(name))
        flat += [magnitude(z).alias(f"{name}_MAG"), angle(z).alias(f"{name}_ANGLE_RAD")]
    return estimates.select("series_id", "i", *flat)
