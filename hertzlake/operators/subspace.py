"""Subspace estimators: ESPRIT and MUSIC on the covariance of each block of samples.

A block's covariance of lagged samples is a sum of products, which tasks add up in parts: a row for each series and block, whatever
the rate. Its two largest eigenvectors span a real tone; only rows of a block go through Python. A sample has the frequency of the last block that
ended by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import IpdftConfig
from ..storage import Scratch
from .scan import CHUNK, rated

#: Samples of a lagged vector.
LAGS = 8
#: Rows of blocks that are broadcast to the samples.
FEW_BLOCKS = 1_000_000


def block_covariances(signal: DataFrame, config: IpdftConfig, lags: int = LAGS) -> DataFrame:
    """series_id, block, n, r: for each block of frame_len samples the mean products of samples a and b on (a <= b < lags), as an array by a, then b.

    n is the number of lagged vectors; a null or NaN among one leaves it out. The last block may be short; one without vectors has no row.
    """
    cut = signal.select("series_id", "i", F.when(~F.isnan("x"), F.col("x")).alias("x"), F.floor(F.col("i") / F.lit(config.frame_len)).alias("block"))
    order = Window.partitionBy("series_id", "block").orderBy("i")
    ahead = cut.select("series_id", "block", *(F.lead("x", k).over(order).alias(f"x{k}") for k in range(lags)))
    whole = ahead.dropna(subset=[f"x{k}" for k in range(lags)])
    sums = [F.avg(F.col(f"x{a}") * F.col(f"x{b}")) for a in range(lags) for b in range(a, lags)]
    return whole.groupBy("series_id", "block").agg(F.count("*").alias("n"), F.array(*sums).alias("r"))


def _signal_subspace(r: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvectors of the two largest eigenvalues, and the others."""
    matrix = np.zeros((lags, lags))
    matrix[np.triu_indices(lags)] = r
    matrix = matrix + np.triu(matrix, 1).T
    vectors = np.linalg.eigh(matrix)[1]
    return vectors[:, -2:], vectors[:, :-2]


def esprit(r: np.ndarray, lags: int = LAGS) -> float:
    """The turn a sample, from how the subspace moves by one sample; NaN without a tone."""
    if not np.any(r):
        return math.nan
    signal, _ = _signal_subspace(r, lags)
    turned = np.linalg.eigvals(np.linalg.lstsq(signal[:-1], signal[1:], rcond=None)[0])
    angle = float(np.abs(np.angle(turned)).max())
    return angle if np.iscomplexobj(turned) and 0 < angle < math.pi else math.nan


def music(r: np.ndarray, turns: np.ndarray, lags: int = LAGS) -> float:
    """Of the given turns a sample, the one whose wave is farthest from the noise; NaN without samples."""
    if not np.any(r):
        return math.nan
    _, noise = _signal_subspace(r, lags)
    waves = np.exp(1j * np.outer(turns, np.arange(lags)))
    return float(turns[np.argmin((np.abs(waves @ noise) ** 2).sum(axis=1))])


def subspace_trace(signal: DataFrame, config: IpdftConfig, grid: tuple[float, ...] | None = None, lags: int = LAGS, chunk: int = CHUNK) -> DataFrame:
    """series_id, i, t, frequency_hz, rocof_hz_s of each sample of signal (series_id, i, t, x): ESPRIT, or MUSIC over a grid of frequencies.

    i numbers a series' samples from 0. Nominal until a block has ended, and for a block without a tone; a block counts when it has frame_len - lags + 1 vectors.
    """
    turns = None if grid is None else 2 * math.pi * np.array(grid) / config.fs

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            angles = [esprit(np.array(r), lags) if turns is None else music(np.array(r), turns, lags) for r in rows["r"]]
            yield pd.DataFrame({"s": rows["series_id"], "b": rows["block"], "f": np.array(angles, float) * config.fs / (2 * math.pi)})

    whole = block_covariances(signal, config, lags).filter(F.col("n") == config.frame_len - lags + 1)
    scratch = Scratch(signal.sparkSession)
    blocks = scratch.stored(whole.mapInPandas(found, "s string, b long, f double"), "blocks")
    few = F.broadcast(blocks) if blocks.count() <= FEW_BLOCKS else blocks
    last = signal.select("series_id", "i", "t", (F.floor((F.col("i") + 1) / F.lit(config.frame_len)) - 1).alias("block"))
    held = last.join(few, F.col("series_id").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    f = F.coalesce(F.when(~F.isnan("f"), F.col("f")), F.lit(config.nominal_hz))
    return rated(held.select("series_id", "i", "t", f.alias("frequency_hz")), chunk)
