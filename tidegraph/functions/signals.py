"""Closed-form probe signals as column expressions on a time column (seconds)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _wave(phase: Column, kind: str) -> Column:
    if kind not in ("sin", "cos"):
        raise ValueError("kind must be 'sin' or 'cos'")
    return F.sin(phase) if kind == "sin" else F.cos(phase)


def tone(t: Column, frequency: float, amplitude: float = 1.0, phase: float = 0.0, kind: str = "sin") -> Column:
    return amplitude * _wave(2 * math.pi * frequency * t + phase, kind)


def close_tones(
    t: Column, f1: float, f2: float, a1: float = 1.0, a2: float = 1.0, kind: str = "sin"
) -> Column:
    if f1 <= 0 or f2 <= 0:
        raise ValueError("frequencies must be positive")
    if a1 < 0 or a2 < 0:
        raise ValueError("amplitudes must not be negative")
    return tone(t, f1, a1, kind=kind) + tone(t, f2, a2, kind=kind)


def chirp(t: Column, f0: float, k: float, amplitude: float = 1.0, phase: float = 0.0, kind: str = "cos") -> Column:
    """Phase 2 pi (f0 + k t) t, so the instantaneous frequency is f0 + 2 k t."""
    if f0 < 0:
        raise ValueError("f0 must not be negative")
    if amplitude < 0:
        raise ValueError("amplitude must not be negative")
    wave = amplitude * _wave(2 * math.pi * (f0 + k * t) * t + phase, kind)
    negative = F.raise_error(F.lit("f0 + k*t must not be negative")).cast("double")
    return F.when(f0 + k * t < 0, negative).otherwise(wave)


def burst_on_carrier(t: Column, carrier: float, burst: float, alpha: float, t1: float, t2: float) -> Column:
    """A carrier tone plus ``alpha`` times a second tone that is on only for t1 <= t <= t2."""
    if t1 >= t2:
        raise ValueError("t1 must be less than t2")
    if carrier <= 0 or burst <= 0:
        raise ValueError("frequencies must be positive")
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    return tone(t, carrier) + F.when(t.between(t1, t2), alpha * tone(t, burst)).otherwise(0.0)


def ramp(t: Column, rise: float, duration: float) -> Column:
    return rise * t / duration
