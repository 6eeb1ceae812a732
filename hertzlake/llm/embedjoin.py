"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine c are sqrt(2 - 2c) apart; that is epsilon. A rotation to principal dimensions
keeps distances, and some leading dimensions tell most of them. Vectors are sorted by the grid cells,
epsilon wide, of the first of those, and cut into blocks of consecutive vectors with bounding boxes.

The sequence is joined with itself recursively. Intervals of blocks are split by a fixed number, level by
level, as a table of pairs of intervals: of each pair's parts, those whose boxes are over epsilon apart are
skipped. What is left are pairs of blocks. Within these, intervals are halved further. Up to there only
the leading coordinates travel; a block goes once to a group of its partners. Vectors that have a
partner within epsilon in these coordinates are then compared in full, in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hash128
from .components import connected_components

COSINE = 0.98
#: Leading dimensions that boxes and blocks hold, and of the grid order among them.
PLACE_DIMS, GRID_DIMS = 16, 4
#: Vectors of a block, and of an interval that is not halved any more.
BLOCK, LEAF = 2048, 64
#: Intervals that an interval is split into from level to level, and blocks that meet one copy of another.
FAN, GROUP = 32, 16
#: Rounding of distances, in single precision, may not skip a link.
SLACK = 1e-5


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, size, embedding (doubles), valid, h1, h2 of each row: h1 and h2 are the digest of label and embedding.

    Rows that can't be linked have no h2, and an h1 that spreads them.
    """
    picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0.0)
    h1, h2 = hash128(F.col("label"), F.col("embedding"))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & some, F.lit(False))
    keyed = picked.withColumns({"size": F.size("embedding"), "valid": valid})
    return keyed.withColumns({"h1": F.when(F.col("valid"), h1).otherwise(F.xxhash64("vec_id")), "h2": F.when(F.col("valid"), h2)})


def principal_axes(vectors: DataFrame, dims: int = PLACE_DIMS) -> dict[int, np.ndarray]:
    """By vector size: the leading axes, from the second moments of all unit vectors.

    Spark sums the moments; the driver gets the square of a vector's size in numbers, whatever the rows.
    """

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                for size in set(part.column(0).to_pylist()):
                    own = part.filter(pa.compute.equal(part.column(0), size))
                    unit = _unit(np.array(own.column(1).to_pylist()).reshape(-1, size))
                    sums[size] = sums.get(size, 0.0) + unit.T @ unit
        for size, total in sums.items():
            i, j = np.indices((size, size)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size * size, size, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.reshape(-1))],
                ["size", "i", "j", "v"],
            )

    rows = vectors.select("size", "embedding").mapInArrow(moments, "size int, i int, j int, v double")
    found = rows.groupBy("size", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    axes = {}
    for size, own in found.groupby("size"):
        total = np.zeros((size, size))
        total[own["i"], own["j"]] = own["v"]
        axes[int(size)] = np.linalg.eigh(total)[1][:, ::-1][:, :dims]
    return axes


def _apart(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> float:
    """Squared distance of two boxes."""
    gap = np.maximum(0.0, np.maximum(lo - other_hi, other_lo - hi))
    return float(gap @ gap)


def join_intervals(x: np.ndarray, y: np.ndarray, epsilon: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of x, and of y, have a row of the other within epsilon. If same, both are one interval, and a row is not its own partner."""
    epsilon2 = epsilon * epsilon + SLACK
    left, right = np.zeros(len(x), bool), np.zeros(len(y), bool)

    def go(a: int, b: int, c: int, d: int) -> None:
        if a == b or c == d or _apart(x[a:b].min(0), x[a:b].max(0), y[c:d].min(0), y[c:d].max(0)) > epsilon2:
            return
        if b - a <= LEAF and d - c <= LEAF:
            one, other = x[a:b], y[c:d]
            near = (one * one).sum(1)[:, None] + (other * other).sum(1)[None, :] - 2 * one @ other.T <= epsilon2
            if same and a == c:
                np.fill_diagonal(near, False)
            left[a:b] |= near.any(1)
            right[c:d] |= near.any(0)
            return
        m, n = (a + b) // 2, (c + d) // 2
        for part in ((a, m, c, n), (a, m, n, d), (m, b, c, n), (m, b, n, d)):
            if not same or part[0] < part[3]:
                go(*part)

    go(0, len(x), 0, len(y))
    return left | right if same else left, left | right if same else right


def _placed(classes: DataFrame, axes: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """cid, label, size, cells and place (the leading coordinates) of the classes."""
    label = classes.schema["label"].dataType.simpleString()

    def project(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                sizes = part.column(2).to_numpy()
                places = np.zeros((len(sizes), PLACE_DIMS), np.float32)
                for size in set(sizes.tolist()):
                    own = np.flatnonzero(sizes == size)
                    rows = np.array(part.column(3).take(pa.array(own)).to_pylist()).reshape(-1, size)
                    found = _unit(rows) @ axes[size]
                    places[own, : found.shape[1]] = found
                cells = np.floor(places[:, :GRID_DIMS] / epsilon).astype(int).tolist()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(cells, pa.list_(pa.int32())), pa.array([p.tobytes() for p in places], pa.binary())],
                    ["cid", "label", "size", "cells", "place"],
                )

    return classes.select("cid", "label", "size", "embedding").mapInArrow(project, f"cid long, label {label}, size int, cells array<int>, place binary")


def _blocks(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """block, label, size, lo, hi, ids, places: consecutive vectors in epsilon grid order within a label and size, numbered in this order."""
    order = ["label", "size", "cells", "cid"]
    label = placed.schema["label"].dataType.simpleString()
    names = ["part", "at", "label", "size", "lo", "hi", "ids", "places"]

    def cut(batches):
        part, at = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        kind = None

        def block() -> tuple:
            places = np.frombuffer(b"".join(x[4] for x in held), np.float32).reshape(-1, PLACE_DIMS).astype(float)
            return part, at, held[0][1], held[0][2], places.min(0).tolist(), places.max(0).tolist(), [x[0] for x in held], b"".join(x[4] for x in held)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), kind, pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            kind, done = batch.schema.field("label").type, []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and (len(held) == BLOCK or held[0][1:3] != row[1:3]):
                    done.append(block())
                    held, at = [], at + 1
                held.append(row)
            if done:
                yield batch_of(done)
        if held:
            yield batch_of([block()])

    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("cid", "label", "size", "place", "cells")
    narrow = ordered.select("cid", "label", "size", "cells", "place")
    cut_rows = narrow.mapInArrow(cut, f"part int, at long, label {label}, size int, lo array<double>, hi array<double>, ids array<long>, places binary")
    return scratch.stored(cut_rows, "blocks")


def _numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """blocks with their number in the order of the sequence, and how many there are; the driver gets a number a partition."""
    counts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect()}
    ahead, total = [0] * (max(counts, default=0) + 1), 0
    for part in sorted(counts):
        ahead[part] = total
        total += counts[part]
    return blocks.withColumn("block", F.get(F.lit(ahead), F.col("part")) + F.col("at")).drop("part", "at"), total


def _gap(one: str, other: str) -> Column:
    """Squared distance of two boxes (lo, hi)."""
    return F.aggregate(
        F.arrays_zip(F.col(f"{one}.lo").alias("a"), F.col(f"{one}.hi").alias("b"), F.col(f"{other}.lo").alias("c"), F.col(f"{other}.hi").alias("d")), F.lit(0.0),
        lambda s, z: s + F.pow(F.greatest(F.lit(0.0), z["a"] - z["d"], z["c"] - z["b"]), F.lit(2.0)),
    )


def _block_pairs(blocks: DataFrame, total: int, epsilon: float, scratch: Scratch) -> DataFrame:
    """a, b (a <= b) of the blocks of a label and size whose boxes are at most epsilon apart, by recursion from the whole sequence down."""
    levels = 0
    while FAN**levels < total:
        levels += 1
    boxes = blocks.select("label", "size", F.col("block").alias("node"), "lo", "hi")
    pairs = boxes.select("label", "size", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).distinct()
    spread = lambda f, c: F.array(*(f(F.get(c, F.lit(k))) for k in range(PLACE_DIMS))).alias(c)
    for level in range(levels - 1, -1, -1):
        nodes = boxes
        if level:
            up = F.floor(F.col("node") / F.lit(FAN**level))
            nodes = boxes.withColumn("node", up).groupBy("label", "size", "node").agg(spread(F.min, "lo"), spread(F.max, "hi"))
        box = F.struct("lo", "hi")
        parts = nodes.select("label", "size", F.floor(F.col("node") / F.lit(FAN)).alias("up"), "node", box.alias("box"))
        left = parts.select("label", "size", F.col("up").alias("a"), F.col("node").alias("left"), F.col("box").alias("one"))
        right = parts.select("label", "size", F.col("up").alias("b"), F.col("node").alias("right"), F.col("box").alias("other"))
        met = pairs.join(left, ["label", "size", "a"]).join(right, ["label", "size", "b"]).filter(F.col("left") <= F.col("right"))
        near = met.filter(_gap("one", "other") <= epsilon * epsilon + SLACK)
        pairs = scratch.stored(near.select("label", "size", F.col("left").alias("a"), F.col("right").alias("b")), "block-pairs")
    return pairs.select("a", "b")


def _candidates(blocks: DataFrame, pairs: DataFrame, epsilon: float, scratch: Scratch) -> DataFrame:
    """a, b, left, right: of each pair of blocks the ids that have a partner in the other by the leading coordinates; pairs without any are left out.

    A block's partners are dealt into groups of about GROUP; the block goes to each group once, before them.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    dealt = pairs.filter("a != b").join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"))
    payload = blocks.select(F.col("block").alias("b"), "ids", "places")
    partners = dealt.join(payload, "b").select("a", "part", F.lit(1).alias("rank"), "b", "ids", "places")
    heads = groups.select(F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part")).join(payload, "b")
    heads = heads.select(F.col("b").alias("a"), "part", F.lit(0).alias("rank"), "b", "ids", "places")
    kind = pa.list_(pa.int64())

    def run(batches):
        head = (np.zeros(0, np.int64), np.zeros((0, PLACE_DIMS)))
        for batch in batches:
            for k in range(batch.num_rows):
                a, part, rank, b = (batch.column(c)[k].as_py() for c in range(4))
                ids = batch.column(4)[k].values.to_numpy()
                places = np.frombuffer(batch.column(5)[k].as_buffer(), np.float32).reshape(-1, PLACE_DIMS).astype(float)
                if rank == 0:
                    head = (ids.copy(), places)
                    if part:  # the block meets itself in its first group
                        continue
                left, right = join_intervals(head[1], places, epsilon, rank == 0)
                if left.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([a], pa.int64()), pa.array([b], pa.int64()), pa.array([head[0][left]], kind), pa.array([ids[right]], kind)], ["a", "b", "left", "right"]
                    )

    together = heads.union(partners).repartition("a", "part").sortWithinPartitions("a", "part", "rank")
    return scratch.stored(together.mapInArrow(run, "a long, b long, left array<long>, right array<long>"), "candidates")


def _joined(candidates: DataFrame, classes: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """a, b, add: for each pair of blocks, what a class's direct links there add to its number, and a link of its
    component there (a spanning forest, not all links)."""
    sides = [candidates.select("a", "b", F.lit(k).alias("side"), F.explode(name).alias("cid")) for k, name in enumerate(("left", "right"))]
    full = sides[0].union(sides[1].filter("a != b")).join(classes.select("cid", "n", "embedding"), "cid")

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        ids, counts, side = (rows[c].to_numpy() for c in ("cid", "n", "side"))
        unit = _unit(np.array(rows["embedding"].tolist()))
        same = rows["a"].iloc[0] == rows["b"].iloc[0]
        x = np.flatnonzero(side == 0)
        y = x if same else np.flatnonzero(side == 1)
        found = []
        for lo in range(0, len(x), 256):
            i, j = np.nonzero(unit[x[lo : lo + 256]] @ unit[y].T >= cosine)
            i, j = x[i + lo], y[j]
            found.append((i[i < j], j[i < j]) if same else (i, j))
        p, q = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, int),) * 2
        add = np.bincount(p, counts[q], len(ids)) + np.bincount(q, counts[p], len(ids))
        root = np.argsort(np.argsort(ids))  # ranks, so that the least id of a component is its root
        names = np.sort(ids)
        while True:  # smallest label over links, then over labels, until nothing changes
            low = np.minimum(root[p], root[q])
            new = root.copy()
            np.minimum.at(new, p, low)
            np.minimum.at(new, q, low)
            if (new == root).all():
                break
            root = new
        linked = add > 0
        return pd.DataFrame({"a": ids[linked], "b": names[root[linked]], "add": add[linked].astype(np.int64)})

    return scratch.stored(full.groupBy("a", "b").applyInPandas(work, "a long, b long, add long"), "vector-links")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding, label).

    Vectors are linked if their labels are equal and not null, their sizes are equal, and their cosine, in
    double precision, is at least `cosine`. Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing. Equal vectors of a label are one class: they are compared once and
    counted for each. Each row is a vector of its own: rows with one vec_id and different vectors are linked
    as what they hold, and a component's id is the smallest vec_id of its rows. A null vec_id has no links
    and a null component, and is kept. An empty table gives an empty result; other columns are ignored.
    """
    epsilon, scratch = float(np.sqrt(2 - 2 * cosine)), Scratch(vectors.sparkSession)
    keyed = _keyed(vectors)
    grouped = keyed.filter("valid").groupBy("label", "size", "h1", "h2")
    grouped = grouped.agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = scratch.stored(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    blocks, total = _numbered(_blocks(_placed(classes, principal_axes(classes), epsilon), scratch))
    pairs = _block_pairs(blocks, total, epsilon, scratch)
    links = _joined(_candidates(blocks, pairs, epsilon, scratch), classes, cosine, scratch)
    added = links.groupBy("a").agg(F.sum("add").alias("add"))
    labels = connected_components(links.select("a", "b"), scratch)
    named = classes.select("h1", "h2", "cid", "n", "least").join(added, F.col("cid") == F.col("a"), "left").join(labels, F.col("cid") == F.col("id"), "left")
    named = named.filter("add > 0 or n > 1").select(
        "h1", "h2", "least", (F.coalesce("add", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")
    )
    named = scratch.stored(named, "vector-names")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = scratch.stored(named.join(least, "root").select("h1", "h2", "n_links", "component_id"), "vector-groups")
    scratch.clear(groups)
    filled = keyed.select("vec_id", "h1", "h2").join(groups, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return filled.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
