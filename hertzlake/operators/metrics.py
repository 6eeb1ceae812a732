"""Scores of estimates against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import complex_of, magnitude, nan_if_null


def rmse_of(estimate: Column, truth: Column) -> Column:
    """Root of the mean square error; null (NaN in results) of no rows."""
    return F.sqrt(F.avg((estimate - truth) * (estimate - truth)))


def frequency_rmse(estimates: DataFrame, truth: DataFrame, by: tuple[str, ...] = ("series_id",), strict: bool = False) -> DataFrame:
    """by, n_samples, rmse of estimates (series_id, i, frequency_hz) and truth (series_id, i, f_true).

    Samples whose estimate is NaN or null are counted but not scored. strict: raise if the two don't hold
    the same samples; else only samples of both count.
    """
    if strict:
        keys = ["series_id", "i"]
        apart = estimates.select(*keys).exceptAll(truth.select(*keys)).union(truth.select(*keys).exceptAll(estimates.select(*keys)))
        if not apart.isEmpty():
            raise ValueError("estimates and truth hold different samples")
    return rmse_by(estimates.join(truth.select("series_id", "i", "f_true"), ["series_id", "i"]), by)


def rmse_by(both: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """frequency_rmse of estimates that carry their truth, f_true."""
    real = F.when(~F.isnan(nan_if_null(F.col("frequency_hz"))), F.col("frequency_hz"))
    return both.groupBy(*by).agg(F.count("*").alias("n_samples"), nan_if_null(rmse_of(real, F.col("f_true"))).alias("rmse"))


def error_quantiles(estimates: DataFrame, truth: DataFrame, accuracy: int | None = None) -> DataFrame:
    """series_id, fe_p50, fe_p95, rfe_p50, rfe_p95: absolute errors of frequency and of its rate, whose truth is the numeric derivative.

    Exact quantiles hold a series' distinct errors in one task; with an accuracy they are approximate, in a
    sketch of that many entries (ranks are off by at most one in so many).
    """
    order = Window.partitionBy("series_id").orderBy("i")
    both = estimates.join(truth.select("series_id", "i", "f_true"), ["series_id", "i"])
    dt = F.col("t") - F.lag("t").over(order)
    rate = F.when(dt > 0, (F.col("f_true") - F.lag("f_true").over(order)) / F.nullif(dt, F.lit(0.0))).otherwise(0.0)
    errors = both.select("series_id", F.abs(F.col("frequency_hz") - F.col("f_true")).alias("fe"), F.abs(F.col("rocof_hz_s") - rate).alias("rfe"))
    cut = lambda c, p: F.percentile(c, F.lit(p)) if accuracy is None else F.percentile_approx(c, p, accuracy)
    at = lambda c, p: cut(c, p).alias(f"{c}_p{round(100 * p)}")
    return errors.groupBy("series_id").agg(at("fe", 0.5), at("fe", 0.95), at("rfe", 0.5), at("rfe", 0.95))


def without_warm_up(estimates: DataFrame, frames: int) -> DataFrame:
    """The estimates after the first `frames` of each series; i numbers them from 0."""
    return estimates.filter(F.col("i") >= frames)


def truth_gaps(signal: DataFrame, analytic: Column, tolerance: float = 1e-6) -> DataFrame:
    """series_id, n_samples, n_wrong, largest of a signal (series_id, i, t, f_true) against an analytic frequency, an expression in t.

    A null or NaN on either side is wrong; `largest` is over the others.
    """
    gap = F.abs(F.col("f_true") - analytic)
    known = F.when(~F.isnan(gap), gap)
    wrong = F.coalesce(known > tolerance, F.lit(True))
    return signal.groupBy("series_id").agg(F.count("*").alias("n_samples"), F.count_if(wrong).alias("n_wrong"), F.max(known).alias("largest"))


def golden_gaps(results: DataFrame, golden: DataFrame, keys: tuple[str, ...], column: str, tolerance: float = 0.03) -> DataFrame:
    """keys, found, expected, passed: whether each result's column is within a share of the golden one; rows that one side lacks fail."""
    found, expected = results.select(*keys, F.col(column).alias("found")), golden.select(*keys, F.col(column).alias("expected"))
    both = found.join(expected, list(keys), "full")
    near = F.abs(F.col("found") - F.col("expected")) <= F.lit(tolerance) * F.abs("expected")
    return both.withColumn("passed", F.coalesce(near, F.lit(False)))


def multiset_digest(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n_rows, digest: the same for equal rows in any order, partitioning and order of columns, and another one for others.

    A row's sha256 is taken in eight numbers of 32 bits, which are summed, so that partial sums meet in a tree and rows aren't sorted or gathered; the digest is the
    sha256 of the number of rows and the sums. A null is not the empty string; doubles count as Spark writes them.
    """
    columns = sorted(c for c in rows.columns if c not in by)
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    parts = [F.conv(F.substring("sha", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)") for k in range(8)]
    sums = rows.withColumn("sha", F.sha2(text, 256)).groupBy(*by).agg(F.count("*").alias("n_rows"), *(F.sum(x).alias(f"s{k}") for k, x in enumerate(parts)))
    return sums.select(*by, "n_rows", F.sha2(F.concat_ws(",", "n_rows", *(f"s{k}" for k in range(8))), 256).alias("digest"))


def suite_digest(rows: DataFrame) -> str:
    """The digest of all rows, as one string."""
    return multiset_digest(rows).first().digest or ""


def store_run(results: DataFrame, run_id: str, folder: str) -> None:
    """Add results to the runs in a folder; a run is written once."""
    results.write.mode("errorifexists").parquet(f"{folder}/run_id={run_id}")


def compare_runs(runs: DataFrame, found: str, golden: str, keys: tuple[str, ...], column: str, tolerance: float = 0.03) -> DataFrame:
    """golden_gaps of two of the stored runs (run_id, keys, column)."""
    of = lambda name: runs.filter(F.col("run_id") == name)
    return golden_gaps(of(found), of(golden), keys, column, tolerance)


def total_vector_error(estimate: Column, truth: Column) -> Column:
    """Of complex structs: the distance over the truth's magnitude; null if that is 0."""
    gap = complex_of(estimate["re"] - truth["re"], estimate["im"] - truth["im"])
    return magnitude(gap) / F.nullif(magnitude(truth), F.lit(0.0))


def cost_regression(costs: DataFrame) -> DataFrame:
    """name, slope, intercept, r2 of seconds over n of costs (name, n, seconds)."""
    fit = lambda f: f("seconds", "n")
    return costs.groupBy("name").agg(
        fit(F.regr_slope).alias("slope"), fit(F.regr_intercept).alias("intercept"), fit(F.regr_r2).alias("r2")
    )


def queue_times(frames: DataFrame) -> DataFrame:
    """frames (series_id, i, arrival, service, deadline) through one server in order: start, finish, delay, missed, utilization so far.

    finish_i = C_i + max over j <= i of (arrival_j - C_(j-1)), with C the running sum of service times.
    """
    order = Window.partitionBy("series_id").orderBy("i")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = frames.withColumn("c", F.sum("service").over(run))
    slack = summed.withColumn("slack", F.col("arrival") - (F.col("c") - F.col("service")))
    done = slack.withColumn("finish", F.col("c") + F.max("slack").over(run))
    since = F.col("finish") - F.first("arrival").over(run)
    return done.select(
        "series_id", "i", (F.col("finish") - F.col("service")).alias("start"), "finish", (F.col("finish") - F.col("service") - F.col("arrival")).alias("delay"),
        (F.col("finish") - F.col("arrival") > F.col("deadline")).alias("missed"), (F.col("c") / F.nullif(since, F.lit(0.0))).alias("utilization"),
    )


def verdicts(results: DataFrame, limits: dict[str, float]) -> DataFrame:
    """results with passed and reasons: the names of the columns over their limits."""
    over = F.array_compact(F.array(*(F.when(F.col(c) > F.lit(float(x)), F.lit(f"{c} > {x:g}")) for c, x in limits.items())))
    return results.withColumn("reasons", F.concat_ws("; ", over)).withColumn("passed", F.col("reasons") == "")
