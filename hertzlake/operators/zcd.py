"""Zero-crossing detection.

Crossings are found between neighbouring samples, a frequency is one over the time from the anchor to an
accepted crossing, and only an accepted crossing becomes the anchor. In the directional modes, without
deadband and at growing times, that is windows alone: one exchange and one sort by series. In general it
is a fold over the crossings in the order of samples, a fraction of the samples. A long series is cut
into chunks that are worked on in parallel; only tables with a row a chunk have windows over a series.

The fold by chunk: each crossing has a successor, the first later one that the gate accepts if it is the anchor. What is
accepted is the path of successors from the first crossing. In a chunk the paths of all its crossings end at a few exits, which
alone look for their successors in later chunks; the path over exits, a few rows a chunk, is found by pointer
doubling, and then each chunk knows where the path enters it.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ZcdConfig
from ..functions.columns import crosses, crossing_time
from ..storage import Scratch, stored

TRACE = ["series_id", "i", "t", "frequency_hz", "rocof_hz_s", "crossed", "t_cross"]


def _order(*keys: str):
    return Window.partitionBy("series_id", *keys).orderBy("i")


def _so_far(*keys: str):
    return _order(*keys).rowsBetween(Window.unboundedPreceding, 0)


def _before(*keys: str):
    return _order(*keys).rowsBetween(Window.unboundedPreceding, -1)


def _marked(signal: DataFrame, x0: Column, t0: Column, config: ZcdConfig) -> DataFrame:
    """signal with crossed and t_cross, given the sample before."""
    crossed = crosses(F.col("x0"), F.col("x"), config.epsilon, config.mode)
    time = crossing_time(F.col("x0"), F.col("t0"), F.col("x"), F.col("t"))
    return signal.withColumns({"x0": x0, "t0": t0}).withColumns({"crossed": crossed, "t_cross": F.when(crossed, time)}).drop("x0", "t0")


def mark_crossings(signal: DataFrame, config: ZcdConfig = ZcdConfig()) -> DataFrame:
    """signal (series_id, i, t, x) with crossed and t_cross."""
    return _marked(signal, F.lag("x").over(_order()), F.lag("t").over(_order()), config)


def crossings(signal: DataFrame, config: ZcdConfig = ZcdConfig()) -> DataFrame:
    """series_id, n (from 1), i, t_cross of the crossings."""
    found = mark_crossings(signal, config).filter("crossed")
    return found.select("series_id", F.row_number().over(_order()).cast("long").alias("n"), "i", "t_cross")


def _matched(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """left with right's other columns, null where none fits; null keys fit each other."""
    others = [c for c in right.columns if c not in keys]
    named = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *others)
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return left.join(named, same, "left").select(*left.columns, *others)


def _accepted(marked: DataFrame, config: ZcdConfig) -> DataFrame:
    """marked with f and r, the frequency and its rate where a crossing is accepted; by windows.

    A gap over the longest period only grows, as its anchor stays; so the first one ends all acceptance.
    So does a first crossing at NaN, an anchor that nothing fits; a later one at NaN is not accepted.
    """
    sure = marked.withColumn("sure", F.when(~F.isnan("t_cross"), F.col("t_cross")))
    timed = sure.withColumn("gap", F.col("sure") - F.last("sure", True).over(_before()))
    late = F.max(F.col("gap") > config.max_period_s).over(_so_far())
    dead = F.isnan(F.first("t_cross", True).over(_so_far()))
    fits = (F.col("gap") >= config.min_period_s) & ~F.coalesce(late, F.lit(False)) & ~dead
    timed = timed.withColumn("f", F.when(fits, F.lit(1.0) / F.nullif("gap", F.lit(0.0))))
    return timed.withColumn("r", (F.col("f") - F.last("f", True).over(_before())) / F.nullif("gap", F.lit(0.0))).drop("gap", "sure")


def _folded(marked: DataFrame, config: ZcdConfig) -> DataFrame:
    """series_id, i, f, r of accepted crossings, by a fold in the order of samples.

    A first crossing at NaN is an anchor that no later crossing fits. The crossings of a series stream
    through a task in order; the task holds a batch of them and the state.
    """
    low, high = config.min_period_s, config.max_period_s

    def fold(frames):
        series: object = frames  # no series yet
        anchor = before = None
        for rows in frames:
            found = []
            for name, i, time in zip(rows["series_id"], rows["i"], rows["t_cross"]):
                if name != series:
                    series, anchor, before = name, None, None
                if anchor is None:
                    anchor = time
                elif low <= time - anchor <= high:
                    f = 1.0 / (time - anchor)
                    found.append((name, i, f, math.nan if before is None else (f - before) / (time - anchor)))
                    anchor, before = time, f
            yield pd.DataFrame(found, columns=["series_id", "i", "f", "r"])

    times = marked.filter("crossed").select("series_id", "i", F.coalesce("t_cross", F.lit(math.nan)).alias("t_cross"))
    ordered = times.repartition("series_id").sortWithinPartitions("series_id", "i")
    accepted = ordered.mapInPandas(fold, "series_id string, i long, f double, r double")
    return accepted.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def successors(times: np.ndarray, after: np.ndarray, first: np.ndarray, config: ZcdConfig) -> np.ndarray:
    """For each time in after the first place in times, from its own first place on, that the gate accepts; len(times) if none is.

    Times need not grow, and NaN fits nothing. A search ends where no later time can be accepted.
    """
    size, found = len(times), np.full(len(after), len(times))
    least = np.append(np.fmin.accumulate(times[::-1])[::-1], np.nan)
    most = np.append(np.fmax.accumulate(times[::-1])[::-1], np.nan)
    low, high = config.min_period_s, config.max_period_s
    open_, at = np.arange(len(after)), np.array(first)
    while len(open_):
        here = at[open_]
        can = (most[here] - after[open_] >= low) & (least[here] - after[open_] <= high)
        open_, here = open_[can], here[can]
        gap = times[np.minimum(here, size - 1)] - after[open_]
        fits = (low <= gap) & (gap <= high)
        found[open_[fits]] = here[fits]
        open_ = open_[~fits]
        at[open_] += 1
    return found


def _inside(times: np.ndarray, config: ZcdConfig) -> tuple[np.ndarray, np.ndarray]:
    """The successor of each crossing of a chunk, and the last crossing of the path from it in the chunk."""
    own = np.arange(len(times))
    after = successors(times, times, own + 1, config)
    exits = np.where(after < len(times), after, own)
    while (further := exits[exits] != exits).any():
        exits = np.where(further, exits[exits], exits)
    return after, exits


#: Rows about crossings of a chunk: kind is 0 for a crossing, 1 for an exit of an earlier chunk, at sample i0 and time t0, that looks for its successor.
_CROSSING = "series_id string, chunk long, kind int, i long, t double, i0 long, t0 double"


def _exits(crossed: DataFrame, config: ZcdConfig) -> DataFrame:
    """series_id, chunk, i, t, start, low, high of each exit: whether it is that of the chunk's first crossing, and the chunk's least and greatest time."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        times = rows["t"].to_numpy(float)
        _, exits = _inside(times, config)
        last = np.unique(exits)
        out = rows.iloc[last][["series_id", "chunk", "i", "t"]]
        low, high = (np.nan, np.nan) if np.isnan(times).all() else (np.nanmin(times), np.nanmax(times))
        return out.assign(start=last == exits[0], low=low, high=high)

    return crossed.groupBy("series_id", "chunk").applyInPandas(found, "series_id string, chunk long, i long, t double, start boolean, low double, high double")


def _links(crossed: DataFrame, exits: DataFrame, config: ZcdConfig, scratch: Scratch) -> DataFrame:
    """series_id, i0, t0, chunk, i, next: each exit at i0 with its successor at i in a later chunk, and the exit that the path from there takes.

    An exit asks the first later chunk whose times reach its gate, mostly the next one, and if no crossing there fits, the one after, until all are found or
    no chunk is left. Chunks are compared by their spans, a row each.
    """
    spans = exits.groupBy(F.col("series_id").alias("s"), F.col("chunk").alias("c")).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    spans = scratch.stored(spans.filter("not isnan(low)"), "spans")
    order = Window.partitionBy("s").orderBy("c")
    following = spans.select(F.col("s").alias("series_id"), F.col("c").alias("chunk"), *(F.lead(x).over(order).alias(y) for x, y in (("c", "later"), ("low", "low"), ("high", "high"))))
    following = scratch.stored(following, "following")
    fits = (F.col("high") - F.col("t0") >= config.min_period_s) & (F.col("low") - F.col("t0") <= config.max_period_s)
    asking = exits.filter("not isnan(t)").select("series_id", "chunk", F.col("i").alias("i0"), F.col("t").alias("t0"))
    every = None

    def answered(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows[rows["kind"] == 1]
        own = rows[rows["kind"] == 0].sort_values("i")
        times, i = own["t"].to_numpy(float), own["i"].to_numpy()
        if not len(asks):
            return pd.DataFrame(columns=["series_id", "i0", "t0", "chunk", "i", "next", "hit"])
        _, last = _inside(times, config)
        at = successors(times, asks["t0"].to_numpy(float), np.zeros(len(asks), int), config)
        where = np.minimum(at, len(times) - 1)
        return asks[["series_id", "i0", "t0", "chunk"]].assign(i=i[where], next=i[last[where]], hit=at < len(times))

    while True:
        near = _matched(asking, following, "series_id", "chunk").filter("later is not null").withColumn("fits", fits)
        next_ = near.filter("fits").select("series_id", "i0", "t0", F.col("later").alias("chunk"))
        beyond = near.filter("not fits").drop("low", "high", "later", "fits").join(spans, F.col("series_id").eqNullSafe(F.col("s")) & (F.col("c") > F.col("chunk")) & fits)
        target = next_.union(beyond.groupBy("series_id", "i0", "t0").agg(F.min("c").alias("chunk")))
        asks = scratch.stored(target.select("series_id", "chunk", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("t"), "i0", "t0"), "asks")
        if asks.isEmpty():
            return every
        named = asks.select(F.col("series_id").alias("s"), F.col("chunk").alias("c")).distinct()
        needed = crossed.join(named, F.col("series_id").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")), "left_semi")
        answers = needed.unionByName(asks).groupBy("series_id", "chunk").applyInPandas(answered, "series_id string, i0 long, t0 double, chunk long, i long, next long, hit boolean")
        answers = scratch.stored(answers, "answers")
        hits = answers.filter("hit")
        every = hits if every is None else every.union(hits)
        asking = answers.filter("not hit").select("series_id", "chunk", "i0", "t0")


def _on_path(exits: DataFrame, links: DataFrame | None, scratch: Scratch) -> DataFrame:
    """series_id, chunk, i, t0: where the path from a series' first crossing enters each chunk, and the time of the anchor it comes with, null at the first crossing."""
    first = exits.groupBy("series_id").agg(F.min_by(F.struct("chunk", "low"), "chunk").alias("f"))
    begins = first.select("series_id", F.col("f.chunk").alias("chunk"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("t0"))
    if links is None:
        return begins
    same = F.col("series_id").eqNullSafe(F.col("s"))
    start = exits.filter("start").join(begins.select(F.col("series_id").alias("s"), F.col("chunk").alias("c")), same & (F.col("chunk") == F.col("c")), "left_semi")
    reached = start.select("series_id", "i")
    jumps = links.select(F.col("series_id").alias("s"), F.col("i0").alias("at"), F.col("next").alias("to"))
    while True:
        new = reached.join(jumps, same & (F.col("i") == F.col("at"))).select("series_id", F.col("to").alias("i"))
        both = scratch.stored(reached.union(new).distinct(), "reached")
        twice = jumps.alias("a").join(jumps.alias("b"), F.col("a.s").eqNullSafe(F.col("b.s")) & (F.col("a.to") == F.col("b.at")))
        jumps = scratch.stored(twice.select(F.col("a.s").alias("s"), F.col("a.at").alias("at"), F.col("b.to").alias("to")), "jumps")
        reached = both
        if jumps.isEmpty():
            break
    taken = reached.select(F.col("series_id").alias("s"), F.col("i").alias("at"))
    entered = links.join(taken, same & (F.col("i0") == F.col("at")), "left_semi").select("series_id", "chunk", "i", "t0")
    return begins.union(entered)


def _chained(marked: DataFrame, config: ZcdConfig, scratch: Scratch) -> DataFrame:
    """series_id, chunk, i, f, r of the accepted crossings of marked samples (series_id, chunk, i, crossed, t_cross): as _folded, by chunk."""
    empty = [F.lit(None).cast("long").alias("i0"), F.lit(None).cast("double").alias("t0")]
    crossed = marked.filter("crossed").select("series_id", "chunk", F.lit(0).alias("kind"), "i", F.coalesce("t_cross", F.lit(math.nan)).alias("t"), *empty)
    crossed = scratch.stored(crossed, "crossed")
    exits = scratch.stored(_exits(crossed, config), "exits")
    entries = _on_path(exits, _links(crossed, exits, config, scratch), scratch)
    entries = entries.select("series_id", "chunk", F.lit(1).alias("kind"), "i", F.lit(None).cast("double").alias("t"), F.lit(None).cast("long").alias("i0"), "t0")

    def accepted(rows: pd.DataFrame) -> pd.DataFrame:
        entry = rows[rows["kind"] == 1]
        own = rows[rows["kind"] == 0].sort_values("i")
        times, i = own["t"].to_numpy(float), own["i"].to_numpy()
        if not len(entry):
            return pd.DataFrame(columns=["series_id", "chunk", "i", "f", "gap"])
        after, _ = _inside(times, config)
        begins = pd.isna(entry["t0"].iloc[0])
        at = 0 if begins else int(np.searchsorted(i, int(entry["i"].iloc[0])))
        path = []
        while at < len(times):
            path.append(at)
            at = after[at]
        path = np.array(path)
        gap = np.diff(times[path], prepend=np.nan if begins else entry["t0"].iloc[0])
        out = pd.DataFrame({"series_id": own["series_id"].iloc[0], "chunk": own["chunk"].iloc[0], "i": i[path], "f": 1.0 / gap, "gap": gap})
        return out[1:] if begins else out

    found = crossed.unionByName(entries).groupBy("series_id", "chunk").applyInPandas(accepted, "series_id string, chunk long, i long, f double, gap double")
    found = scratch.stored(found, "path")
    ends = found.groupBy("series_id", "chunk").agg(F.max_by("f", "i").alias("last"), F.min("i").alias("i"))
    ends = ends.withColumn("before", F.lag("last").over(Window.partitionBy("series_id").orderBy("chunk"))).drop("last")
    own = F.lag("f").over(_order("chunk"))
    rated = _matched(found.withColumn("own", own), ends.select("series_id", "i", "before"), "series_id", "i")
    return rated.select("series_id", "chunk", "i", "f", ((F.col("f") - F.coalesce("own", "before")) / F.col("gap")).alias("r"))


def needs_fold(config: ZcdConfig) -> bool:
    """Whether crossing times may not grow, or may be closer than a shortest period over the default."""
    return config.epsilon != 0 or config.mode not in ("neg_to_pos", "pos_to_neg") or config.min_period_s > ZcdConfig.min_period_s


def zcd_trace(signal: DataFrame, config: ZcdConfig = ZcdConfig(), fold: bool | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """TRACE of each sample of signal (series_id, i, t, x): the last accepted frequency, nominal before one,
    and its rate, 0 before two; and the columns to keep.

    fold: take the fold even where windows do; needed where times don't grow or steps are under the
    shortest period. A null sample is no crossing, a null series is a series. i must be unique in a series.
    """
    columns = ["series_id", "i", "t", "x"]
    more = [c for c in keep if c not in columns]
    marked = mark_crossings(signal.select(*columns, *more), config)
    if needs_fold(config) if fold is None else fold:
        marked = _matched(marked, _folded(marked, config), "series_id", "i")
    else:
        marked = _accepted(marked, config)
    return marked.select(
        "series_id", "i", "t", F.coalesce(F.last("f", True).over(_so_far()), F.lit(config.nominal_hz)).alias("frequency_hz"),
        F.coalesce(F.last("r", True).over(_so_far()), F.lit(0.0)).alias("rocof_hz_s"), "crossed", "t_cross", *(c for c in keep if c not in TRACE),
    )


#: Crossing times that a chunk hands on: those of a frequency, its rate, and both before a gap that is too long.
HANDED = 4


def _last_times(sure: Column, over_before, over_so_far, marked: DataFrame) -> DataFrame:
    """marked with times: the last HANDED crossing times so far, newest first; null before one."""
    names = ["sure", *(f"b{k}" for k in range(1, HANDED))]
    timed = marked.withColumn("sure", sure)
    for name, earlier in zip(names[1:], names):
        timed = timed.withColumn(name, F.when(F.col("sure").isNotNull(), F.last(earlier, True).over(over_before)))
    times = F.when(F.col("sure").isNotNull(), F.array_compact(F.array(*names)))
    return timed.withColumn("times", F.last(times, True).over(over_so_far)).drop(*names)


def _carried(ends: DataFrame) -> DataFrame:
    """ends (series_id, chunk, times at the chunk's end) with earlier: the last HANDED times before the chunk."""
    past = Window.partitionBy("series_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"p{k}" for k in range(HANDED)]
    for name, before in zip(names, ["times", *names]):
        some = F.col("times") if before == "times" else F.when(F.col("times").isNotNull(), F.col(before))
        ends = ends.withColumn(name, F.last(some, True).over(past))
    none = F.array().cast("array<double>")
    return ends.withColumn("earlier", F.slice(F.concat(*(F.coalesce(name, none) for name in names)), 1, HANDED)).drop(*names)


def _chunks(signal: DataFrame, config: ZcdConfig, chunk: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """signal's samples, marked, with their chunk; a chunk's last sample visits the next one."""
    own = F.floor(F.col("i") / F.lit(chunk))
    both = F.when(F.pmod("i", F.lit(chunk)) == chunk - 1, F.array(own, own + 1)).otherwise(F.array(own))
    cut = signal.select("series_id", "i", "t", "x", *keep, F.explode(both).alias("chunk"))
    marked = _marked(cut, F.lag("x").over(_order("chunk")), F.lag("t").over(_order("chunk")), config)
    return marked.filter(own == F.col("chunk"))


#: Chunks whose rows are broadcast.
FEW_CHUNKS = 100_000


def _before_chunks(marked: DataFrame, config: ZcdConfig) -> DataFrame:
    """series_id, chunk, earlier, late, frozen, dead: what a chunk must know of its series, from a row a chunk.

    earlier: the last HANDED crossing times before it. late: the sample of the series' first gap over the longest period, which ends all
    acceptance, and frozen: the last times then. dead: the series' first crossing is at NaN, an anchor that nothing fits.
    """
    none, times = F.array().cast("array<double>"), F.coalesce("times", F.array().cast("array<double>"))
    sure = F.col("crossed") & ~F.isnan("t_cross")
    late = sure & (F.get(times, F.lit(0)) - F.get(times, F.lit(1)) > config.max_period_s)
    at = lambda which: F.when(which, F.col("i"))
    ends = marked.groupBy("series_id", "chunk").agg(
        F.max_by("times", "i").alias("times"), F.min_by("t_cross", at(F.col("crossed"))).alias("first"), F.min(at(sure)).alias("sure_i"), F.min_by("t_cross", at(sure)).alias("sure_t"),
        F.min(at(late)).alias("own_late"), F.min_by("times", at(late)).alias("own_times"),
    )
    known = _carried(ends).withColumn("earlier", F.coalesce("earlier", none))
    # a gap from the chunks before comes first in a chunk
    across = F.coalesce(F.col("sure_t") - F.get("earlier", F.lit(0)) > config.max_period_s, F.lit(False))
    known = known.withColumns({
        "at": F.when(across, F.col("sure_i")).otherwise(F.col("own_late")),
        "then": F.slice(F.concat(F.when(across, F.array("sure_t")).otherwise(F.coalesce("own_times", none)), "earlier"), 1, HANDED),
    })
    whole = Window.partitionBy("series_id")
    first = F.first("first", True).over(whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return known.select(
        "series_id", "chunk", "earlier", F.min("at").over(whole).alias("late"), F.min_by("then", "at").over(whole).alias("frozen"), F.coalesce(F.isnan(first), F.lit(False)).alias("dead")
    )


def zcd_trace_chunked(signal: DataFrame, config: ZcdConfig = ZcdConfig(), chunk: int = 1 << 20, fold: bool | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """zcd_trace for long series, whose samples i numbers from 0: samples are partitioned by series and chunk of i.

    Samples are marked once and stored with the last crossing times in their chunk. Across chunks go a
    chunk's last crossing times only, and a series' first gap that is too long; with the fold, its exits. These are a row a chunk, which
    all samples of the chunk meet in one join.
    """
    keep = tuple(c for c in keep if c not in TRACE)
    marked = _chunks(signal, config, chunk, keep)
    if needs_fold(config) if fold is None else fold:
        return _filled(marked.drop("x"), config, keep)
    scratch = Scratch(signal.sparkSession)
    sure = F.when(F.col("crossed") & ~F.isnan("t_cross"), F.col("t_cross"))
    marked = scratch.stored(_last_times(sure, _before("chunk"), _so_far("chunk"), marked).drop("x"), "marked")
    before = scratch.stored(_before_chunks(marked, config), "chunks")
    few = before.count() <= FEW_CHUNKS
    joined = _matched(marked, F.broadcast(before) if few else before, "series_id", "chunk")
    none = F.array().cast("array<double>")
    known = F.slice(F.concat(F.coalesce("times", none), "earlier"), 1, HANDED)
    known = F.when(F.col("dead"), none).when(F.col("i") >= F.col("late"), F.slice("frozen", 2, HANDED)).otherwise(known)
    joined = joined.withColumn("known", known)
    newer, older = (F.get("known", F.lit(k)) - F.get("known", F.lit(k + 1)) for k in range(2))
    f = F.lit(1.0) / F.nullif(newer, F.lit(0.0))
    r = (f - F.lit(1.0) / F.nullif(older, F.lit(0.0))) / F.nullif(newer, F.lit(0.0))
    return joined.select(
        "series_id", "i", "t", F.coalesce(f, F.lit(config.nominal_hz)).alias("frequency_hz"), F.coalesce(r, F.lit(0.0)).alias("rocof_hz_s"), "crossed", "t_cross", *keep
    )


def traced(signal: DataFrame, config: ZcdConfig, chunk: int | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The trace by chunks of so many samples, if a chunk is given, else by series."""
    return zcd_trace(signal, config, keep=keep) if chunk is None else zcd_trace_chunked(signal, config, chunk, keep=keep)


def _filled(marked: DataFrame, config: ZcdConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """The trace of marked samples by the fold, filled forward in each chunk and from chunk to chunk."""
    scratch = Scratch(marked.sparkSession)
    marked = scratch.stored(marked, "marked")
    accepted = scratch.stored(_chained(marked, config, scratch), "accepted")
    scratch.clear(marked, accepted)
    last = accepted.groupBy("series_id", "chunk").agg(F.max_by("f", "i").alias("f"), F.max_by("r", F.when(F.col("r").isNotNull(), F.col("i"))).alias("r"))
    every = _matched(marked.select("series_id", "chunk").distinct(), last, "series_id", "chunk")
    past = Window.partitionBy("series_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select("series_id", "chunk", F.last("f", True).over(past).alias("f0"), F.last("r", True).over(past).alias("r0"))
    joined = _matched(_matched(marked, accepted.drop("chunk"), "series_id", "i"), every, "series_id", "chunk")
    run = _so_far("chunk")
    return joined.select(
        "series_id", "i", "t", F.coalesce(F.last("f", True).over(run), "f0", F.lit(config.nominal_hz)).alias("frequency_hz"),
        F.coalesce(F.last("r", True).over(run), "r0", F.lit(0.0)).alias("rocof_hz_s"), "crossed", "t_cross", *keep,
    )
