"""Column functions of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CHANNELS, STATUS


def deadband_sign(x: Column, epsilon: float = 0.0) -> Column:
    """1 over epsilon, -1 under -epsilon, else 0; NaN, which SQL takes for the largest number, is 0."""
    return F.when(F.isnan(x), 0).when(x > F.lit(float(epsilon)), 1).when(x < F.lit(-float(epsilon)), -1).otherwise(0)


def crosses(before: Column, now: Column, epsilon: float, mode: str) -> Column:
    """Whether the step from one sample to the next is a crossing; false at the first sample."""
    s0, s1 = deadband_sign(before, epsilon), deadband_sign(now, epsilon)
    step = {"neg_to_pos": (s0 == -1) & (s1 >= 0), "pos_to_neg": (s0 == 1) & (s1 <= 0)}.get(mode, (s0 != 0) & (s1 != 0) & (s1 != s0))
    return before.isNotNull() & now.isNotNull() & step


def crossing_time(x0: Column, t0: Column, x1: Column, t1: Column) -> Column:
    """Where the line through both samples is zero."""
    return t0 + (t1 - t0) * (-x0 / F.nullif(x1 - x0, F.lit(0.0)))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def all_finite(columns: tuple[str, ...] = (*CHANNELS, "timestamp")) -> Column:
    """Whether a sample is valid: every field a finite number."""
    found = F.lit(True)
    for name in columns:
        found = found & is_finite(F.col(name))
    return found


def has_status(word: Column, flag: str) -> Column:
    """Whether a status bit is set; OK means that none is."""
    return word == 0 if flag == "OK" else word.bitwiseAND(STATUS[flag]) != 0


def complex_of(re: Column, im: Column | float = 0.0) -> Column:
    return F.struct(re.cast("double").alias("re"), (im if isinstance(im, Column) else F.lit(im)).cast("double").alias("im"))


def magnitude(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def angle(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def nan_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(float("nan")))
