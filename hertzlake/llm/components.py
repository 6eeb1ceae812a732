"""Connected components of a link table, by contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, root: for every id in links (a, b) a root that two ids share exactly if links connect them.

    In each round every id points to the first of its neighbours and itself in the order of hashes,
    links are replaced by links between what their ends point to, and links within one id go. In
    hash order, paths shrink by a fraction each round. Only minima are taken for an id with very many
    links, which partial aggregation prepares; joins are between written tables, which adaptive
    execution can split. Null ids are ignored; an empty table gives an empty result.
    """
    edges = scratch.stored(links.filter("a != b and a is not null and b is not null").select("a", "b").distinct(), "edges")
    labels = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("root", F.col("id"))
    while not edges.isEmpty():
        both = [edges.select(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (("a", "b"), ("b", "a"), ("a", "a"), ("b", "b"))]
        first = F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("v")))
        points = scratch.stored(reduce(DataFrame.union, both).groupBy("u").agg(first.alias("m")).select("u", F.col("m.v").alias("to")), "points")
        labels = scratch.stored(
            labels.join(points, F.col("root") == F.col("u"), "left").select("id", F.coalesce("to", "root").alias("root")), "labels"
        )
        for end in ("a", "b"):
            edges = edges.join(points, F.col(end) == F.col("u")).drop(end, "u").withColumnRenamed("to", end)
        edges = scratch.stored(edges.filter("a != b").select("a", "b").distinct(), "edges")
    return labels
