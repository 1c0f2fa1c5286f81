"""Opacity and scale activations of splat rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Band edges on activated opacity.
SOLID_ABOVE = 0.9
GHOST_BELOW = 0.15


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(*cols: Column | str) -> Column:
    """True where every column is a number: not null, NaN or infinite."""
    out = F.lit(True)
    for c in cols:
        out = out & (F.abs(_col(c).cast("double")) < F.lit(float("inf")))
    return F.coalesce(out, F.lit(False))


def sigmoid(c: Column | str, clip: float | None = None) -> Column:
    """1 / (1 + e^-x) in double precision; ``clip`` bounds x to [-clip, clip] first. Null and NaN stay as they are."""
    x = _col(c).cast("double")
    if clip is not None:
        bounded = F.greatest(F.least(x, F.lit(float(clip))), F.lit(-float(clip)))
        x = F.when(x.isNull() | F.isnan(x), x).otherwise(bounded)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: float) -> float:
    return math.log(p / (1.0 - p))


def scale_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("scale_")]


def max_scale(columns: Sequence[str]) -> Column:
    """Largest activated scale of a row, null if one is null. exp is monotone, so one exp of the largest log-scale is enough."""
    logs = [_col(c).cast("double") for c in columns]
    if len(logs) == 1:
        return F.exp(logs[0])
    known = logs[0].isNotNull()
    for c in logs[1:]:
        known = known & c.isNotNull()
    return F.exp(F.when(known, F.greatest(*logs)))


def opacity_band(opacity: Column | str) -> Column:
    """Band of an activated opacity: solid, uncertain or ghost."""
    op = _col(opacity)
    return (
        F.when(op > SOLID_ABOVE, F.lit("solid"))
        .when(op < GHOST_BELOW, F.lit("ghost"))
        .when(op.isNotNull(), F.lit("uncertain"))
    )
