"""Configurations of estimators and scenarios. Wrong values raise here, on the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame

from .schema import CHANNELS

MODES = ("neg_to_pos", "pos_to_neg", "either")


def lookup(config: Any, name: str, default: Any = None) -> Any:
    """An attribute of that name, else a key, else the default."""
    if hasattr(config, name):
        return getattr(config, name)
    return config.get(name, default) if isinstance(config, Mapping) else default


@dataclass(frozen=True)
class ZcdConfig:
    """Zero-crossing detection. A mode that is not one of MODES counts as `either`."""

    epsilon: float = 0.0
    nominal_hz: float = 60.0
    mode: str = "neg_to_pos"
    min_period_s: float = 1e-6
    max_period_s: float = 1.0
    channel: str = "V1"

    @classmethod
    def single(cls, config: Any = None) -> ZcdConfig:
        """One channel: `eps` stands in for an epsilon of 0, an unknown mode becomes neg_to_pos, period limits are fixed."""
        epsilon = float(lookup(config, "epsilon", 0.0) or lookup(config, "eps", 0.0) or 0.0)
        mode = str(lookup(config, "mode", "neg_to_pos"))
        return cls(
            epsilon, float(lookup(config, "nominal_hz", 60.0)), mode if mode in MODES else "neg_to_pos", channel=str(lookup(config, "channel", "V1"))
        )

    @classmethod
    def general(cls, config: Any = None) -> ZcdConfig:
        """For several channels or nodes: all fields as given."""
        return cls(**{f.name: type(f.default)(lookup(config, f.name, f.default)) for f in fields(cls)})


@dataclass(frozen=True)
class MultiConfig:
    zcd: ZcdConfig = ZcdConfig()
    channels: tuple[str, ...] = ("V1", "V2", "V3")
    agg: str = "median"

    @classmethod
    def of(cls, config: Any = None) -> MultiConfig:
        """Only known channels count; with none of them, the three voltages."""
        known = tuple(c for c in lookup(config, "channels", ()) or () if c in CHANNELS)
        return cls(ZcdConfig.general(config), known or ("V1", "V2", "V3"), str(lookup(config, "agg", "median")))


@dataclass(frozen=True)
class NetworkConfig:
    """nodes: names, or for large networks a table of them (node)."""

    nodes: tuple[str, ...] | DataFrame
    zcd: ZcdConfig = ZcdConfig()
    fuse: str = "consensus"
    alpha: float = 1.0

    def __post_init__(self):
        if isinstance(self.nodes, tuple) and not self.nodes:
            raise ValueError("nodes must not be empty")


@dataclass(frozen=True)
class IpdftConfig:
    fs: float
    frame_len: int = 50
    channel: str = "V1"
    nominal_hz: float = 60.0

    def __post_init__(self):
        if not self.fs > 0:
            raise ValueError("fs must be positive")
        if self.frame_len < 3:
            raise ValueError("frame_len must be at least 3")

    @classmethod
    def of(cls, config: Any) -> IpdftConfig:
        fs = lookup(config, "fs")
        if fs is None:
            raise ValueError("fs is required")
        return cls(float(fs), int(lookup(config, "frame_len", 50)), str(lookup(config, "channel", "V1")), float(lookup(config, "nominal_hz", 60.0)))


@dataclass(frozen=True)
class LoopConfig:
    """Loops around a second-order generalised integrator: its gain k, the low pass of a frequency-locked loop, the gains of a phase-locked one."""

    fs: float
    nominal_hz: float = 60.0
    k: float = math.sqrt(2.0)
    tau_s: float = 0.02
    kp: float = 92.0
    ki: float = 4232.0

    def __post_init__(self):
        if not self.fs > 2 * self.nominal_hz > 0:
            raise ValueError("fs must be over twice the nominal frequency")


@dataclass(frozen=True)
class KalmanConfig:
    """Variances of the state's change in a sample (of amplitude, of phase and of angular frequency in an extended filter), of a measurement, and at the start."""

    fs: float
    nominal_hz: float = 60.0
    q: float = 1e-4
    r: float = 1e-1
    p0: float = 1.0
    q_phase: float = 1e-6
    q_omega: float = 1e-2
    p_omega: float = 100.0

    def __post_init__(self):
        if min(self.q, self.r, self.p0) <= 0:
            raise ValueError("variances must be positive")


@dataclass(frozen=True)
class TaylorConfig:
    """A Taylor-Fourier frame: its length, and the order of the phasor's polynomial."""

    fs: float
    frame_len: int = 128
    order: int = 2
    nominal_hz: float = 60.0

    def __post_init__(self):
        if self.order < 1 or self.frame_len < 2 * (self.order + 1):
            raise ValueError("order must be at least 1, and a frame has as many samples as unknowns")


@dataclass(frozen=True)
class RampStep:
    f0: float = 60.0
    f_step: float = 59.5
    t_step: float = 2.0
    t_back: float = 4.0
