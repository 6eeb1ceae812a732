"""Data of plots and reports, and result files."""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Windows of the plots. Fixed values.
TOP_WINDOWS = ((0.95, 1.05), (1.95, 2.05))
BOTTOM_WINDOW = (0.5, 2.5)
log = logging.getLogger(__name__)


def zoom_windows(series: DataFrame, windows: tuple[tuple[float, float], ...] = TOP_WINDOWS) -> DataFrame:
    """series with window_id: each row once for each window that its t lies in, ends included; without windows all rows, in window 0."""
    if not windows:
        return series.withColumn("window_id", F.lit(0))
    inside = [F.when(F.col("t").between(float(a), float(b)), F.lit(k)) for k, (a, b) in enumerate(windows)]
    return series.withColumn("window_id", F.explode(F.array_compact(F.array(*inside))))


def in_windows(series: DataFrame, windows: DataFrame, width: float) -> DataFrame:
    """series (t, more) with window_id: each row once for each row of windows (window_id, t0, t1) that its t lies in, ends included.

    A join by bins of time of the given width: a window is a row for each bin that it reaches, so that long ones are cut, and meets the samples of these bins
    alone. Bins in which there is no sample aren't made: a window is cut to the time that the series spans. Windows that end before they begin, or with a null end, hold nothing; a window may
    have the columns of series too, by which it then is joined.
    """
    by = [c for c in windows.columns if c in series.columns]
    bin_ = lambda t: F.floor(t / F.lit(float(width))).cast("long")
    span = series.agg(F.min("t"), F.max("t")).first()
    if span[0] is None:
        return series.join(windows.select("window_id"), F.lit(False))
    reach = windows.filter("t0 <= t1").withColumns({"b0": bin_(F.greatest("t0", F.lit(span[0]))), "b1": bin_(F.least("t1", F.lit(span[1])))})
    cut = reach.filter("b0 <= b1").withColumn("bin", F.explode(F.sequence("b0", "b1"))).drop("b0", "b1")
    joined = series.withColumn("bin", bin_(F.col("t"))).join(cut, [*by, "bin"])
    return joined.filter((F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1"))).select(*(F.col(c) for c in series.columns), "window_id")


def y_limits(truth: DataFrame, window: tuple[float, float] = BOTTOM_WINDOW, share: float = 0.15) -> DataFrame:
    """series_id, y_min, y_max: the mean of f_true in the window, less and plus a share of it; no row without samples there."""
    inside = truth.filter(F.col("t").between(*map(float, window))).groupBy("series_id").agg(F.avg("f_true").alias("m"))
    return inside.select("series_id", (F.col("m") * F.lit(1 - share)).alias("y_min"), (F.col("m") * F.lit(1 + share)).alias("y_max"))


def estimate_axis(estimates: DataFrame, ends: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """estimates (keys, i) with t spread evenly from 0 to ends' (keys, n, t_end)."""
    joined = estimates.join(ends, list(keys))
    return joined.withColumn("t", F.col("i") * F.coalesce(F.col("t_end") / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0))).drop("n", "t_end")


def plot_series(signal: DataFrame, estimates: DataFrame, windows: tuple[tuple[float, float], ...] = TOP_WINDOWS, bottom: tuple[float, float] = BOTTOM_WINDOW) -> DataFrame:
    """panel, line, series_id, window_id, t, y, y_min, y_max: all lines of the plot of a signal and its estimates (series_id, name, i, frequency_hz).

    Panel `top` has the signal's samples in the zoom windows, `bottom` each estimator's frequencies, spread
    evenly over the signal's time, and the true frequency, with the limits of the y axis.
    """
    ends = signal.groupBy("series_id").agg(F.max("t").alias("t_end"))
    counts = estimates.groupBy("series_id", "name").agg(F.count("*").alias("n")).join(ends, "series_id")
    spread = estimate_axis(estimates.select("series_id", "name", "i", "frequency_hz"), counts, ("series_id", "name"))
    none = F.lit(None).cast("double")
    top = zoom_windows(signal, windows).select(
        F.lit("top").alias("panel"), F.lit("signal").alias("line"), "series_id", "window_id", "t", F.col("x").alias("y"), none.alias("y_min"), none.alias("y_max")
    )
    curves = spread.select(F.col("name").alias("line"), "series_id", "t", F.col("frequency_hz").alias("y"))
    truth = signal.select(F.lit("truth").alias("line"), "series_id", "t", F.col("f_true").alias("y"))
    below = curves.union(truth).join(y_limits(signal, bottom), "series_id", "left")
    return top.unionByName(below.select(F.lit("bottom").alias("panel"), "line", "series_id", F.lit(0).alias("window_id"), "t", "y", "y_min", "y_max"))


def heatmap(results: DataFrame, rows: str, columns: str, value: str, names: list[str]) -> DataFrame:
    """One row for each of `rows` with a column for each name: the cells of a heat map, null where there is no result."""
    return results.groupBy(rows).pivot(columns, names).agg(F.first(value, ignorenulls=True))


def pareto_front(results: DataFrame, cost: str, error: str) -> DataFrame:
    """The results that none beats in both columns: for a report, whose rows one task can sort. One without a cost or an error beats none and is beaten by none.

    Each result is read once and meets the others in windows: sums in another order would give another last bit, and equal results would not be equal.
    """
    known = F.col(cost).isNotNull() & F.col(error).isNotNull()
    upto = lambda value, by: F.min(F.when(known, F.col(value))).over(Window.orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = results.withColumns({"__error": upto(error, cost), "__cost": upto(cost, error)})
    front = both.filter(~known | ((F.col(error) == F.col("__error")) & (F.col(cost) == F.col("__cost"))))
    return front.drop("__error", "__cost")


def error_histogram(errors: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """series_id, bin (0 and bins + 1: beyond), n."""
    at = F.expr(f"width_bucket(`{column}`, {float(low)}D, {float(high)}D, {int(bins)})")
    return errors.groupBy("series_id", at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def as_arrays(estimates: DataFrame) -> DataFrame:
    """series_id, f_hat: a series' estimates in order. For report-sized series: a result is one row."""
    return estimates.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "frequency_hz"))), lambda z: z["frequency_hz"]).alias("f_hat"))


def summary_json(results: DataFrame) -> DataFrame:
    """scenario, json of results (scenario, name, n_samples, rmse, f_hat). NaN is written as a string, which JSON can hold."""
    rows = F.array_sort(F.collect_list(F.struct("name", "n_samples", "rmse", "f_hat")))
    return results.groupBy("scenario").agg(F.to_json(rows).alias("json"))


def run_folder(root: str, now: datetime | None = None) -> str:
    return f"{root}/benchmark_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"


def write_run(results: DataFrame, folder: str) -> None:
    """results as JSON lines and Parquet by scenario, and the summary; never over an earlier run."""
    results.write.mode("errorifexists").partitionBy("scenario").json(f"{folder}/jsons")
    results.write.mode("errorifexists").partitionBy("scenario").parquet(f"{folder}/results")
    summary_json(results).write.mode("errorifexists").json(f"{folder}/summary")
    log.info("results written to %s", folder)
