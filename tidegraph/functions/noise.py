"""Reproducible pseudo-random columns from hashes (never from partition order)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str) -> Column:
    """Uniform number in (0, 1) from the md5 of the joined parts."""
    key = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(2.0**32)


def gauss(*parts: Column | str) -> Column:
    """Standard normal number by Box-Muller on two hashed uniforms."""
    u, v = uniform("u", *parts), uniform("v", *parts)
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * v)


def between(low: Column | int, high: Column | int, *parts: Column | str) -> Column:
    """Integer in [low, high]."""
    lo = F.lit(low) if isinstance(low, int) else low
    hi = F.lit(high) if isinstance(high, int) else high
    return (lo + F.floor(uniform(*parts) * (hi - lo + 1))).cast("long")
