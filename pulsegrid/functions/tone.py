"""Tone curves as column expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def curve(v: Column, expr: str, gamma: float = 0.5) -> Column:
    """Map a value already in [0, 1] through a named curve."""
    if expr == "sqrt":
        return F.sqrt(v)
    if expr == "gamma":
        return F.pow(v, F.lit(max(gamma, 1e-3)))
    if expr == "log":
        return F.log1p(v * 99.0) / math.log(100.0)
    if expr == "asinh":
        return F.asinh(v * 10.0) / math.asinh(10.0)
    if expr in ("linear", "percentile"):
        return v
    raise ValueError(f"unknown tone curve {expr!r}")


def compress(value: Column, white: Column, expr: str = "sqrt", gamma: float = 0.5) -> Column:
    """Clip value/white to [0, 1] and apply a curve."""
    return curve(F.least(F.greatest(value / white, F.lit(0.0)), F.lit(1.0)), expr, gamma)


def compress_signed(value: Column, white: Column, expr: str = "linear", gamma: float = 0.5) -> Column:
    """Curve of the magnitude with the sign restored."""
    return F.signum(value) * curve(F.least(F.abs(value) / white, F.lit(1.0)), expr, gamma)
