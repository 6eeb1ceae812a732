"""Line deduplication with levelled sorted runs of line hashes.

A run is a table of (h1, h2, n): line hashes, and in how many documents of the run's batches the line
stands. Runs are bucketed by hash and sorted, so that a batch meets the runs bucket by bucket, without a
shuffle of what they hold. A new batch hashes and counts its own lines, merge-anti-joins the runs, which leaves the lines
that they don't yet show to be frequent, and adds these as its own run on level 0. When a level holds
`fan_out` runs, they are compacted into one run of the next level, so that a join meets few runs however
many batches came. Nothing is counted over all batches but by the runs.

Rows then lose their frequent lines where they are: up to a checked number, the hashes of frequent lines are
broadcast. Beyond it, the hashes of all lines are joined with them, and rows with the places that they lose.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, ascii_lower, giving_back, hash128, remove, shared_path

LEAST_DOCS = 10
BATCHES = 4
FAN_OUT = 3
#: Bytes of text, about, whose lines are a bucket of a run.
BUCKET_BYTES = 64 << 20
#: Bytes of text whose lines a task looks up at once.
LOOKED_UP = 1 << 22
#: Frequent lines whose hashes, 16 bytes each, are broadcast.
MOST_BROADCAST = 500_000


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _split_lines(F.col("text")).alias("lines"))


def _hashed(docs: DataFrame, *columns: Column) -> DataFrame:
    """columns, h1, h2: each document's distinct lines that aren't blank, as hashes."""
    keys = F.array_distinct(F.transform(_split_lines(F.col("text")), line_key))
    h1, h2 = hash128(F.col("key"))
    lines = docs.select(*columns, F.explode(keys).alias("key")).filter(F.length("key") > 0)
    return lines.withColumns({"h1": h1, "h2": h2}).drop("key")


def _counted(lines: DataFrame) -> DataFrame:
    return lines.groupBy("h1", "h2").agg(F.count("*").alias("n"))


class LineRuns:
    """The runs of one corpus: partitions of a bucketed table, whose files lie in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, fan_out: int = FAN_OUT, buckets: int = 1):
        self.spark, self.least_docs, self.fan_out, self.buckets = spark, least_docs, fan_out, buckets
        self.path = shared_path(spark, "line_runs")
        self.table = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame, level: int) -> None:
        """run, as files of one bucket each, sorted by hash."""
        name = f"level{level}-{uuid.uuid4().hex}"
        named = run.select("h1", "h2", "n", F.lit(name).alias("run"))
        bucketed = named.write.mode("append").partitionBy("run").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        bucketed.option("path", self.path).format("parquet").saveAsTable(self.table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.table(self.table).filter(F.col("run").isin(names)).select("h1", "h2", "n")

    def _names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def counts(self) -> DataFrame:
        """h1, h2, n over all batches: the runs merged. From least_docs on, n is a lower bound."""
        names = self._names()
        runs = self._read(names) if names else self.spark.createDataFrame([], "h1 long, h2 long, n long")
        return runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """The lines in least_docs documents or more."""
        return self.counts().filter(F.col("n") >= self.least_docs)

    def add(self, batch: DataFrame) -> None:
        """Count the lines of a batch of documents (doc_id, text), without those known as frequent, and add them as a run; compact full levels."""
        # counted where they are first, as one line may be in a third of all rows; then in the runs' buckets
        counts = _counted(_hashed(batch)).repartition(self.buckets, "h1", "h2")
        if self._names():
            counts = counts.join(self.frequent().select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_out:
            full, self.levels[level] = self.levels[level], []
            self._write(self._read(full).groupBy("h1", "h2").agg(F.sum("n").alias("n")), level + 1)
            for name in full:
                self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (run = '{name}')")
                remove(self.spark, f"{self.path}/run={name}")
            level += 1

    def unseen(self, batch: DataFrame) -> DataFrame:
        """doc_id, pos, line of the batch's lines that no run holds: the merge anti-join of a stream of batches."""
        h1, h2 = hash128(line_key(F.col("line")))
        lines = _lines(batch).select("doc_id", F.posexplode("lines").alias("pos", "line"))
        return lines.withColumns({"h1": h1, "h2": h2}).join(self.counts(), ["h1", "h2"], "left_anti").drop("h1", "h2")

    def drop(self) -> None:
        """Delete the runs."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.path)


def count_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fan_out: int = FAN_OUT) -> LineRuns:
    """The runs of docs, which come in so many batches by doc_id's hash, one after the other."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = LineRuns(docs.sparkSession, least_docs, fan_out, max(1, math.ceil(size / BUCKET_BYTES)))
    for k in range(batches):
        runs.add(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    return runs


#: The state that hash128's second hash starts from.
_SECOND = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42)


class Frequent:
    """The hashes of the frequent lines, in a task: 16 bytes each, sorted."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        order = np.lexsort((h2.view(np.uint64), h1.view(np.uint64)))
        self.h1, self.h2 = h1.view(np.uint64)[order], h2.view(np.uint64)[order]

    def holds(self, lines: list[bytes]) -> np.ndarray:
        """Whether each line is frequent."""
        keys = [line.strip(BLANKS.encode()).lower() for line in lines]
        found = np.zeros(len(keys), bool)
        if not len(self.h1):
            return found
        first = np.fromiter(map(_first_hash, keys), np.uint64, len(keys))
        at = np.minimum(np.searchsorted(self.h1, first), len(self.h1) - 1)
        for k in np.flatnonzero(self.h1[at] == first).tolist():
            if keys[k]:
                # lines with one first hash stand together
                second, place = xxhash.xxh64_intdigest(keys[k], _SECOND), int(at[k])
                while place < len(self.h1) and self.h1[place] == first[k] and not found[k]:
                    found[k] = self.h2[place] == second
                    place += 1
        return found


def _first_hash(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, 42)


def _frequent(docs: DataFrame, least_docs: int, batches: int) -> tuple[DataFrame, Callable[[], Frequent] | None]:
    """The frequent lines, stored, and what makes them in a task, if they are few."""
    runs = count_lines(docs.select("doc_id", "text"), least_docs, batches)
    frequent = Scratch(docs.sparkSession).stored(runs.frequent().select("h1", "h2"), "lines")
    runs.drop()
    if frequent.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        return frequent, None
    found = frequent.toPandas().astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((found["h1"].to_numpy(), found["h2"].to_numpy()))
    made: list[Frequent] = []

    def task() -> Frequent:
        if not made:
            made.append(Frequent(*shared.value))
        return made[0]

    return frequent, task


def _stripped(column: pa.Array, frequent: Frequent) -> Iterator[tuple[int, int, bytes]]:
    """Lines before, lines dropped and the lines that stay of each text."""
    held: list[list[bytes]] = []
    size = 0

    def looked_up() -> Iterator[tuple[int, int, bytes]]:
        lost, at = frequent.holds([x for own in held for x in own]).tolist(), 0
        for own in held:
            kept = [x for x, gone in zip(own, lost[at : at + len(own)]) if not gone]
            at += len(own)
            yield len(own), len(own) - len(kept), b"\n".join(kept)

    for text in column.cast(pa.binary()).to_pylist():
        held.append((text or b"").split(b"\n"))
        size += len(text or b"")
        if size >= LOOKED_UP:
            yield from looked_up()
            held, size = [], 0
    yield from looked_up()


def _with_lost(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """row (a struct of docs' columns), lines, and lost, the places of the lines that the row loses.

    The rows are shuffled once, to meet the places of the lines that they lose; lines travel as hashes. A
    hot line's rows are split by adaptive execution, as frequent lines come once each.
    """
    h1, h2 = hash128(F.col("key"))
    lines = (
        docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.transform(_split_lines(F.col("text")), line_key)).alias("pos", "key"))
        .filter(F.length("key") > 0)
        .select("doc_id", "version", "pos", h1.alias("h1"), h2.alias("h2"))
    )
    lost = lines.join(frequent, ["h1", "h2"], "left_semi")
    # repeated ids with other texts stay apart by the text's version
    lost = lost.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("lost")).alias("r")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("version")).alias("l")
    same = F.col("row.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("l.version").eqNullSafe(F.col("r.version"))
    joined = rows.join(lost, same, "left")
    return joined.select("row", _split_lines(F.col("row.text")).alias("lines"), F.coalesce("r.lost", F.array().cast("array<int>")).alias("lost"))


def _kept_text() -> Column:
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost")))
    kept = F.when(F.size("lost") == 0, F.col("lines")).otherwise(F.transform(stay, lambda at: F.get("lines", at)))
    return F.array_join(kept, "\n")


def dedup_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, text (the lines that stay) of each row of docs.

    Lines whose key has a code point at least and stands in least_docs rows or more are dropped in every
    row. A null or empty text is one empty line, which stays. Repeated rows count as documents each and
    give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    frequent, task = _frequent(docs, least_docs, batches)
    if task is None:
        cut = _with_lost(docs.select("doc_id", "text"), frequent)
        return cut.select(
            "row.doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"), _kept_text().alias("text")
        )
    return _mapped(docs, task, "text", lambda kept: kept)


def _mapped(docs: DataFrame, task: Callable[[], Frequent], name: str, last: Callable[[bytes], bytes | str]) -> DataFrame:
    """doc_id, n_lines, n_dropped and a string of the lines that stay."""
    picked = docs.select("doc_id", "text")
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches):
        frequent = task()
        for batch in batches:
            rows = list(_stripped(batch.column(1), frequent))
            columns = [pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([last(x[2]) for x in rows], pa.string())], ["doc_id", "n_lines", "n_dropped", name])

    return picked.mapInArrow(giving_back(run), f"doc_id {kind}, n_lines long, n_dropped long, {name} string")


def dedup_documents(docs: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with the lines that stay as text and all other columns as they are; cases as in dedup_lines."""
    frequent, task = _frequent(docs, least_docs, batches)
    if task is None:
        cut = _with_lost(docs, frequent)
        return cut.select(*(_kept_text().alias(x) if x == "text" else F.col(f"row.`{x}`").alias(x) for x in docs.columns))
    at = docs.columns.index("text")

    def run(batches):
        frequent = task()
        for batch in batches:
            kept = pa.array([x[2] for x in _stripped(batch.column(at), frequent)], pa.string())
            yield batch.set_column(at, pa.field("text", pa.string()), kept)

    return docs.mapInArrow(giving_back(run), docs.schema)


def dropped_lines_digests(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """dedup_lines with the kept text as a digest, which is made where the text is."""
    frequent, task = _frequent(docs, least_docs, BATCHES)
    if task is None:
        cut = _with_lost(docs.select("doc_id", "text"), frequent)
        kept = F.sha2(_kept_text(), 256).alias("kept_sha256")
        return cut.select("row.doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"), kept)
    return _mapped(docs, task, "kept_sha256", lambda kept: hashlib.sha256(kept).hexdigest())
