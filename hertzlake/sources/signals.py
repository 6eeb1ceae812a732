"""Signals with a known frequency, and tables as signals.

All have the columns series_id, i, t, x, f_true. Sample i is at i * (1 / fs); the phase is the running
sum of the frequency up to and with the sample.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import RampStep
from ..storage import stored

TWO_PI = 2 * math.pi


def samples(spark: SparkSession, duration: float, fs: float, series_id: str, count: int | None = None) -> DataFrame:
    """series_id, i, t; as many as steps of 1 / fs begin within the duration, or count."""
    if fs <= 0:
        raise ValueError("fs must be positive")
    step = 1.0 / fs
    n = max(0, math.ceil(duration / step)) if count is None else count
    return spark.range(n).select(F.lit(series_id).alias("series_id"), F.col("id").alias("i"), (F.col("id") * F.lit(step)).alias("t"))


#: Samples of a running sum's chunk.
CHUNK = 1 << 20


def running_total(signal: DataFrame, column: str, chunk: int = CHUNK) -> DataFrame:
    """signal with total, the sum of a column up to and with each sample: within chunks of i, plus the sums of the chunks before."""
    cut = signal.withColumn("chunk", F.floor(F.col("i") / F.lit(chunk)))
    own = Window.partitionBy("series_id", "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("series_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("series_id", "chunk").agg(F.sum(column).alias("all"))
    sums = sums.select(F.col("series_id").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("all").over(past), F.lit(0.0)).alias("ahead"))
    summed = cut.withColumn("total", F.sum(column).over(own))
    joined = summed.join(sums, F.col("series_id").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    return joined.select(*signal.columns, (F.col("total") + F.col("ahead")).alias("total"))


def with_phase(timed: DataFrame, frequency: Column, fs: float, chunk: int = CHUNK) -> DataFrame:
    """series_id, i, t, x, f_true: a sine whose phase is the running sum of the frequency."""
    summed = running_total(timed.withColumn("f_true", frequency.cast("double")), "f_true", chunk)
    return summed.select("series_id", "i", "t", F.sin(F.lit(TWO_PI) * F.col("total") / F.lit(float(fs))).alias("x"), "f_true")


def clean(spark: SparkSession, f0: float = 60.0, df: float = 0.0, duration: float = 5.0, fs: float = 5000.0, series_id: str = "clean") -> DataFrame:
    """A tone that drifts by df over the duration."""
    frequency = F.lit(float(f0)) + (F.lit(float(df)) * F.col("t") / F.lit(float(duration)) if duration > 0 else F.lit(0.0))
    return with_phase(samples(spark, duration, fs, series_id), frequency, fs)


def frequency_step(
    spark: SparkSession, f0: float = 60.0, f_step: float = 59.5, t_step: float = 2.0, t_back: float = 4.0, duration: float = 6.0, fs: float = 5000.0, series_id: str = "step"
) -> DataFrame:
    """f_step from t_step until before t_back, else f0."""
    t = F.col("t")
    frequency = F.when((t >= float(t_step)) & (t < float(t_back)), float(f_step)).otherwise(float(f0))
    return with_phase(samples(spark, duration, fs, series_id), frequency, fs)


def ramp_frequency(t: Column, config: RampStep, rocof: float) -> Column:
    """f0, a ramp to f_step, f_step, a ramp back, f0; the order of the cases decides where ramps overlap."""
    change = config.f_step - config.f0
    length = abs(change) / rocof if rocof > 0 else 0.0
    slope = math.copysign(rocof, change) if change else rocof
    a, b = config.t_step, config.t_back
    return (
        F.when(t < a, config.f0)
        .when(t < a + length, F.lit(config.f0) + F.lit(slope) * (t - a))
        .when(t < b, config.f_step)
        .when(t < b + length, F.lit(config.f_step) - F.lit(slope) * (t - b))
        .otherwise(config.f0)
    )


def ramp_step(
    spark: SparkSession, config: RampStep | None = None, duration: float = 6.0, fs: float = 5000.0, rocof: float = 1.0, series_id: str = "ramp_step"
) -> DataFrame:
    """A step with ramps at rocof; none or a negative rocof is a plain step."""
    if duration < 0:
        raise ValueError("duration must not be negative")
    return with_phase(samples(spark, duration, fs, series_id), ramp_frequency(F.col("t"), config or RampStep(), float(rocof)), fs)


def sine(spark: SparkSession, fs: float = 10000.0, f: float = 60.0, seconds: float = 0.2, series_id: str = "sine") -> DataFrame:
    """A sine of time itself, without a summed phase; whole samples only."""
    timed = samples(spark, seconds, fs, series_id, count=int(fs * seconds))
    return timed.select("series_id", "i", "t", F.sin(F.lit(TWO_PI) * F.lit(float(f)) * F.col("t")).alias("x"), F.lit(float(f)).alias("f_true"))


def chirp(spark: SparkSession, f0: float = 59.0, f1: float = 61.0, duration: float = 2.0, fs: float = 5000.0, series_id: str = "chirp") -> DataFrame:
    """From f0 to f1 at a constant rate."""
    return clean(spark, f0, f1 - f0, duration, fs, series_id)


def with_harmonics(signal: DataFrame, parts: dict[float, float], offset: float = 0.0, fs: float = 5000.0) -> DataFrame:
    """signal with multiples of its phase (order: amplitude; orders need not be whole) and an offset."""
    phase = F.lit(TWO_PI) * F.col("total") / F.lit(float(fs))
    added = sum((F.lit(float(a)) * F.sin(F.lit(float(k)) * phase) for k, a in parts.items()), F.lit(float(offset)))
    return running_total(signal, "f_true").withColumn("x", F.col("x") + added).drop("total")


def with_sag(signal: DataFrame, start: float, end: float, depth: float) -> DataFrame:
    """The amplitude times 1 - depth from start until before end; a negative depth is a swell."""
    return signal.withColumn("x", F.when((F.col("t") >= float(start)) & (F.col("t") < float(end)), F.col("x") * F.lit(1.0 - depth)).otherwise(F.col("x")))


def with_noise(signal: DataFrame, sigma: float, seed: int = 0) -> DataFrame:
    """Normal noise from hashes of the key, the same however rows are partitioned (Box-Muller)."""
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "series_id", "i"), F.lit(1 << 52)) + F.lit(1)) / F.lit(float((1 << 52) + 1))
    normal = F.sqrt(F.lit(-2.0) * F.log(unit(1))) * F.cos(F.lit(TWO_PI) * unit(2))
    return signal.withColumn("x", F.col("x") + F.lit(float(sigma)) * normal)


def from_table(rows: DataFrame, series: str, order: str, value: str, step: float) -> DataFrame:
    """A table's rows as signals: a series for each value of `series`, samples in the given unique order, less their mean.

    Rows are sorted by ranges of series and order, so that a long series is many tasks' work, and stored
    with their places. The first place of a series in a range and the ranges' counts and sums, a row for
    each series and range, give numbers from 0 and the mean. A null series is a series.
    """
    picked = rows.select(F.col(series).cast("string").alias("series_id"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    ordered = picked.repartitionByRange("series_id", "o").sortWithinPartitions("series_id", "o")
    # the id's upper bits are the range, the lower ones count its rows
    placed = stored(ordered.select("series_id", "v", F.monotonically_increasing_id().alias("place")).withColumn("part", F.shiftright("place", 33)), "numbered")
    parts = placed.groupBy("series_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.sum("v").alias("sum"), F.count("v").alias("known"))
    whole = Window.partitionBy("series_id")
    past = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(past), F.lit(0)) - F.col("first")
    mean = F.sum("sum").over(whole) / F.nullif(F.sum("known").over(whole), F.lit(0))
    parts = parts.select(F.col("series_id").alias("s"), F.col("part").alias("p"), shift.alias("shift"), mean.alias("mean"))
    joined = placed.join(parts, F.col("series_id").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    numbered = joined.select("series_id", (F.col("place") + F.col("shift")).alias("i"), (F.col("v") - F.col("mean")).alias("x"))
    return numbered.select("series_id", "i", (F.col("i") * F.lit(float(step))).alias("t"), "x")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """order and k, the place from 0 of each of its values, which are unique; sorted by ranges, with a row for each range."""
    ordered = rows.select(order).repartitionByRange(order).sortWithinPartitions(order)
    placed = stored(ordered.select(order, F.monotonically_increasing_id().alias("place")).withColumn("part", F.shiftright("place", 33)), "places")
    parts = placed.groupBy("part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("part", (F.coalesce(F.sum("n").over(past), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(shifts, "part").select(order, (F.col("place") + F.col("shift")).alias("k"))


def from_csv(spark: SparkSession, path: str, mapping: dict[str, str], series_id: str = "csv") -> DataFrame:
    """series_id, i, t, x of CSV files with a header; mapping names their columns for i, t and x."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(
        F.lit(series_id).alias("series_id"), F.col(mapping["i"]).cast("long").alias("i"), F.col(mapping["t"]).cast("double").alias("t"), F.col(mapping["x"]).cast("double").alias("x")
    )
