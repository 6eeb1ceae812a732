"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch, remove, shared_dir, shared_path, stored  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of 64-bit ids that may be broadcast, 8 MB of numbers. More are joined by shuffle.
SMALL = 1_000_000


def if_small(ids: DataFrame, most: int = SMALL) -> DataFrame:
    """ids, a written table, to be broadcast if a count finds at most so many rows."""
    return F.broadcast(ids) if ids.count() <= most else ids.hint("merge")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def hash128(*keys: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: no two keys of a corpus of 10^12 meet in both."""
    return F.xxhash64(*keys), F.xxhash64(F.lit(7), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of a partition's batches, and at its end what the allocators hold free goes back to the system.

    Workers live on from stage to stage, idle ones too, and would keep the most that each stage has needed.
    """

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return whole
