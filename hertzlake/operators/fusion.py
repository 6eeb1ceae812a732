"""Estimates of several channels or network nodes together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MultiConfig, NetworkConfig, ZcdConfig
from ..functions.columns import complex_of
from ..storage import stored
from .zcd import traced

#: Edges of a graph, or nodes, that are broadcast.
SMALL_GRAPH = 100_000
#: Nodes that a step meets at once, about.
NODES_A_ROW = 1000


def combined(column: str, how: str) -> Column:
    """Mean, or else the exact median; 0 of nothing."""
    return F.coalesce(F.avg(column) if how == "mean" else F.median(column), F.lit(0.0))


def channel_traces(wide: DataFrame, config: MultiConfig, chunk: int | None = None) -> DataFrame:
    """series_id, channel, i, t, x, frequency_hz, rocof_hz_s of the chosen channels of PMU samples; an absent channel is 0.

    chunk: samples of a series that are worked on together, if i numbers a series' samples from 0; without it, all of them are.
    """
    value = lambda c: F.col(c) if c in wide.columns else F.lit(0.0)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), value(c).cast("double").alias("x")) for c in config.channels)))
    long = wide.select("series_id", "i", F.col("timestamp").alias("t"), pairs.alias("p")).select("series_id", "p.channel", "i", "t", "p.x")
    keyed = long.withColumns({"unit": F.col("series_id"), "value": F.col("x")}).withColumn("series_id", F.concat_ws("\x1f", "series_id", "channel"))
    found = traced(keyed, config.zcd, chunk, ("unit", "channel", "value"))
    return found.select(F.col("unit").alias("series_id"), "channel", "i", "t", F.col("value").alias("x"), "frequency_hz", "rocof_hz_s")


def multi_channel(wide: DataFrame, config: MultiConfig = MultiConfig(), chunk: int | None = None) -> DataFrame:
    """series_id, i, timestamp_utc, frequency_hz, rocof_hz_s, status_word, phasors of PMU samples: all chosen channels combined."""
    phasors = F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", complex_of(F.col("x")).alias("z")))))
    grouped = channel_traces(wide, config, chunk).groupBy("series_id", "i", F.col("t").alias("timestamp_utc"))
    return grouped.agg(
        combined("frequency_hz", config.agg).alias("frequency_hz"), combined("rocof_hz_s", config.agg).alias("rocof_hz_s"), F.lit(0).alias("status_word"), phasors.alias("phasors")
    )


def metropolis_weights(edges: DataFrame) -> DataFrame:
    """src, dst, w of directed edges (src, dst) and of each source with itself.

    A target without edges of its own has degree 1. Repeated edges have one weight, but count as often as
    they come in the degree and in the sum that the own weight completes to one. An edge to itself counts
    in both, too; its weight is the own weight.
    """
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("times"))
    degree = pairs.groupBy("src").agg(F.sum("times").alias("degree"))
    other = degree.select(F.col("src").alias("dst"), F.col("degree").alias("other"))
    weighed = pairs.join(degree, "src").join(other, "dst", "left")
    weighed = weighed.select("src", "dst", "times", (F.lit(1.0) / (1 + F.greatest("degree", F.coalesce("other", F.lit(1))))).alias("w"))
    rest = weighed.groupBy("src").agg(F.sum(F.col("times") * F.col("w")).alias("sum"))
    own = rest.select("src", F.col("src").alias("dst"), F.greatest(F.lit(0.0), F.lit(1.0) - F.col("sum")).alias("w"))
    return weighed.filter("src != dst").select("src", "dst", "w").union(own)


def consensus_step(values: DataFrame, edges: DataFrame, alpha: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """by, node, f after one averaging with the neighbours, of values (by, node, f).

    (1 - alpha) f + alpha (w_own f + sum of w f over edges); a neighbour without a value has f itself. Edges
    count as often as they come. A node without edges keeps its value; without any edges all get the mean.
    The edges of a graph of up to SMALL_GRAPH edges are broadcast, so that the values of a node, which are
    as many as steps, needn't meet in one task; larger graphs are joined by node.
    """
    by_ = list(by)
    known = values.select("node").distinct()
    inside = edges.join(known.withColumnRenamed("node", "src"), "src", "left_semi")
    size = inside.limit(SMALL_GRAPH + 1).count()
    small = F.broadcast if size <= SMALL_GRAPH else lambda x: x
    if not size:
        mean = values.groupBy(*by_).agg(F.avg("f").alias("f"))
        return values.select(*by_, "node").join(mean, by_) if by_ else values.select("node").crossJoin(F.broadcast(mean))
    weights = metropolis_weights(inside)
    own = weights.filter("src = dst").select(F.col("src").alias("node"), F.col("w").alias("w_own"))
    terms = inside.join(weights, ["src", "dst"]).select(F.col("src").alias("node"), "dst", "w")
    other = values.select(*by_, F.col("node").alias("dst"), F.col("f").alias("f_other"))
    met = values.join(small(terms), "node").join(other, [*by_, "dst"], "left")
    sums = met.groupBy(*by_, "node").agg(F.sum(F.col("w") * F.coalesce("f_other", "f")).alias("around"))
    joined = values.join(small(own), "node", "left").join(sums, [*by_, "node"], "left")
    mixed = F.coalesce("w_own", F.lit(1.0)) * F.col("f") + F.coalesce("around", F.lit(0.0))
    return joined.select(*by_, "node", (F.lit(1.0 - alpha) * F.col("f") + F.lit(float(alpha)) * mixed).alias("f"))


def with_nodes(times: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each row of times and each of nodes (node): nodes lie in groups by their hash, which a step meets one by one."""
    names = nodes.select("node").distinct()
    size = names.count()
    groups = max(1, -(-size // NODES_A_ROW))
    grouped = names.groupBy(F.pmod(F.xxhash64("node"), F.lit(groups)).alias("group")).agg(F.collect_list("node").alias("names"))
    every = times.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    met = every.join(F.broadcast(grouped) if size <= SMALL_GRAPH else grouped, "group")
    return met.select(*times.columns, F.explode("names").alias("node"))


def node_traces(samples: DataFrame, config: NetworkConfig, chunk: int | None = None) -> DataFrame:
    """i, t, node, frequency_hz, rocof_hz_s of samples (i, t, node, value): unknown nodes are ignored, absent ones are 0. chunk: as for channels."""
    nodes = config.nodes if isinstance(config.nodes, DataFrame) else samples.sparkSession.createDataFrame([(x,) for x in config.nodes], "node string")
    grid = with_nodes(samples.select("i", "t").distinct(), nodes).join(samples.select("i", "node", "value"), ["i", "node"], "left")
    keyed = grid.select(F.col("node").alias("series_id"), "i", "t", F.coalesce("value", F.lit(0.0)).alias("x"))
    return traced(keyed, config.zcd, chunk).select("i", "t", F.col("series_id").alias("node"), "frequency_hz", "rocof_hz_s")


def fused_nodes(samples: DataFrame, edges: DataFrame, config: NetworkConfig, chunk: int | None = None) -> DataFrame:
    """i, t, node, local_hz, local_rocof_hz_s, frequency_hz, rocof_hz_s: the estimate of each node at each step beside the fused one.

    The frequency is the mean after a consensus step if fuse is `consensus`, else the plain mean; the rate is always the mean.
    No row holds a whole network.
    """
    local = stored(node_traces(samples, config, chunk), "node-traces")
    fused = local.groupBy("i").agg(F.avg("frequency_hz").alias("f"), F.avg("rocof_hz_s").alias("r"))
    if config.fuse == "consensus":
        values = consensus_step(local.select("i", "t", "node", F.col("frequency_hz").alias("f")), edges, config.alpha, ("i", "t"))
        fused = fused.drop("f").join(values.groupBy("i").agg(F.avg("f").alias("f")), "i")
    named = local.select("i", "t", "node", F.col("frequency_hz").alias("local_hz"), F.col("rocof_hz_s").alias("local_rocof_hz_s"))
    return named.join(fused, "i").select(*named.columns, F.col("f").alias("frequency_hz"), F.col("r").alias("rocof_hz_s"))


def fused_network(samples: DataFrame, edges: DataFrame, config: NetworkConfig, chunk: int | None = None) -> DataFrame:
    """i, t, local (map of node to frequency and rate), frequency_hz, rocof_hz_s of each step: fused_nodes with a row a step, for networks that fit one."""
    value = F.struct(F.col("local_hz").alias("frequency_hz"), F.col("local_rocof_hz_s").alias("rocof_hz_s")).alias("v")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", value))))
    same = [F.first(c).alias(c) for c in ("frequency_hz", "rocof_hz_s")]
    return fused_nodes(samples, edges, config, chunk).groupBy("i", "t").agg(entries.alias("local"), *same).select("i", "t", "local", "frequency_hz", "rocof_hz_s")
