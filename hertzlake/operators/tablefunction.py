"""Sequential estimators as a table function of SQL.

    SELECT * FROM frequency('srf_pll', 5000.0D, TABLE(signal) PARTITION BY series_id ORDER BY i)

The input is any table with the columns series_id, i, t and x. A partition's samples go through the estimator's step a piece at a time, in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from ..config import KalmanConfig, LoopConfig, ZcdConfig
from . import sequential

#: sequential.OUT; analysis runs where no session is, and so can't parse it.
_OUT = StructType().add("series_id", StringType()).add("i", LongType()).add("t", DoubleType()).add("frequency_hz", DoubleType()).add("rocof_hz_s", DoubleType())
#: Samples of a piece.
PIECE = 4096

ESTIMATORS: dict[str, Callable[[float], tuple[sequential.State, sequential.Step]]] = {
    "srf_pll": lambda fs: sequential.srf_pll(LoopConfig(fs)),
    "ekf_angle": lambda fs: sequential.ekf_angle(KalmanConfig(fs)),
    "zcd": lambda fs: sequential.zcd_loop(ZcdConfig()),
}


class Frequency:
    """series_id, i, t, frequency_hz, rocof_hz_s of the samples of a table argument; which estimator, and for how many samples a second."""

    @staticmethod
    def analyze(name: AnalyzeArgument, fs: AnalyzeArgument, table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the last argument must be a table")
        missing = {"series_id", "i", "t", "x"} - set(table.dataType.fieldNames())
        if missing:
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        if name.value not in ESTIMATORS:
            raise ValueError(f"the estimator must be one of {', '.join(sorted(ESTIMATORS))}")
        return AnalyzeResult(_OUT)

    def __init__(self) -> None:
        self.state = self.step = None
        self.rows: list[tuple] = []

    def eval(self, name: str, fs: float, row) -> Iterator[tuple]:
        if self.step is None:
            self.state, self.step = ESTIMATORS[name](float(fs))
        self.rows.append((row["series_id"], row["i"], row["t"], row["x"]))
        if len(self.rows) >= PIECE:
            yield from self._piece()

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield from self._piece()

    def _piece(self) -> Iterator[tuple]:
        names, i, t, x = zip(*self.rows)
        self.rows = []
        self.state, f, rate = self.step(self.state, np.array(t, float), np.array(x, float))
        yield from zip(names, i, t, f, rate)


def register(spark: SparkSession, name: str = "frequency") -> None:
    spark.udtf.register(name, udtf(Frequency))
