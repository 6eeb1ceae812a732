"""Schemas of the logical tables, and casts that make results comparable across engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ("V1", "V2", "V3", "I1", "I2", "I3")
SIGNAL = "series_id string, i bigint, t double, x double, f_true double"
PMU_SAMPLE = "series_id string, i bigint, V1 double, V2 double, V3 double, I1 double, I2 double, I3 double, timestamp double"
PHASORS = "map<string,struct<re:double,im:double>>"
PMU_ESTIMATE = f"series_id string, i bigint, timestamp_utc double, frequency_hz double, rocof_hz_s double, status_word int, phasors {PHASORS}"
RUN_RESULT = "scenario string, name string, n_samples bigint, rmse double, f_hat array<double>"
#: Status bits. Fixed values.
STATUS = {"OK": 0, "DATA_ERROR": 1, "CLOCK_NOT_SYNCED": 2, "PLL_UNLOCKED": 4, "OVER_RANGE": 8}
KEY = ("series_id", "i")


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero: one unit in the last place of a sine is not a difference."""
    return (F.round(value, digits) + F.lit(0.0)).cast("double")
