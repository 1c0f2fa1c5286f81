"""Opacity pruning and deviation clipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.activation import finite, logit, sigmoid
from scanloom.operators.profile import AXES, axis_stats, beyond, retention
from scanloom.plans.stage import as_keys, attach, stage

MIN_OPACITY = 0.15
PRUNE_SIGMA = 5.0
CLOUD_SIGMA = 3.0


def opaque_enough(threshold: float = MIN_OPACITY) -> Column:
    """Activated opacity at or above the threshold.

    The activation is monotone, so a bound on the stored logit, loose by far more
    than the rounding error, is stated as well: that half reaches the file scan.
    """
    raw = F.col("opacity")
    keep = (sigmoid(raw) >= threshold) & ~F.isnan(raw)
    if 0.0 < threshold < 1.0:
        keep = (raw >= F.lit(logit(threshold) - 1e-6)) & keep
    return keep


def prune_opacity(df: DataFrame, threshold: float = MIN_OPACITY) -> DataFrame:
    """Drop rows below the opacity threshold. A cloud without opacity is returned unchanged."""
    return df.where(opaque_enough(threshold)) if "opacity" in df.columns else df


def _moments(df: DataFrame, keys: list[str], axes: Sequence[str]) -> DataFrame:
    cols = [f"{a}_{s}" for a in axes for s in ("mean", "std")]
    return stage(axis_stats(df, keys, axes).select(*keys, *cols), "axis-stats")


def _within(axes: Sequence[str], k: float) -> Column:
    keep = F.lit(True)
    for a in axes:
        keep = keep & ~beyond(a, k)
    return keep


def sigma_clip(
    df: DataFrame,
    k: float = CLOUD_SIGMA,
    axes: Sequence[str] = AXES,
    by: str | Sequence[str] | None = None,
    mode: str = "joint",
    stats_from: DataFrame | None = None,
) -> DataFrame:
    """Keep rows within k population deviations of the mean.

    ``joint`` takes all statistics from the whole input; ``sequential`` goes axis
    by axis with the statistics of the rows still kept, and skips absent axes.
    k <= 0 keeps everything. Rows with a non-finite coordinate are dropped.
    ``stats_from`` is the same cloud with fewer columns, for sources that cannot
    leave out columns by themselves.
    """
    if mode not in ("joint", "sequential"):
        raise ValueError(f"unknown mode {mode!r}")
    if k <= 0:
        return df
    keys = as_keys(by)
    columns = list(df.columns)
    if mode == "joint":
        if any(a not in columns for a in axes):
            return df
        stats = _moments(df if stats_from is None else stats_from, keys, axes)
        return attach(df.where(finite(*axes)), stats, keys).where(_within(axes, k)).select(*columns)
    used = [a for a in axes if a in columns]
    if not used:
        return df
    source = (df if stats_from is None else stats_from).where(finite(*used))
    kept, out = source, df.where(finite(*used))
    for a in used:
        stats = _moments(kept, keys, [a])
        kept = attach(kept, stats, keys).where(_within([a], k)).select(*source.columns)
        out = attach(out, stats, keys).where(_within([a], k)).select(*columns)
    return out


def prune(
    df: DataFrame,
    threshold: float = MIN_OPACITY,
    sigma: float = PRUNE_SIGMA,
    by: str | Sequence[str] | None = None,
    stats_from: DataFrame | None = None,
) -> DataFrame:
    """Drop faint rows, then spatial outliers axis by axis."""
    kept = prune_opacity(df, threshold)
    if sigma <= 0:
        return kept
    thin = None if stats_from is None else prune_opacity(stats_from, threshold)
    return sigma_clip(kept, sigma, by=by, mode="sequential", stats_from=thin)


def prune_report(
    df: DataFrame,
    threshold: float = MIN_OPACITY,
    sigma: float = PRUNE_SIGMA,
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Rows removed by each step of :func:`prune`, and the rows kept.

    The statistics of each axis come from the rows kept so far, then one pass
    over the input counts all steps at once.
    """
    keys = as_keys(by)
    axes = [a for a in AXES if a in df.columns]
    flags: dict[str, Column] = {}
    rows = df
    if "opacity" in df.columns:
        flags["opacity"] = opaque_enough(threshold)
    if sigma > 0 and axes:
        flags["invalid"] = finite(*axes)
        kept = prune_opacity(df, threshold).where(finite(*axes))
        for a in axes:
            stats = _moments(kept, keys, [a])
            rows = attach(rows, stats, keys, "left")
            flags[a] = F.coalesce(_within([a], sigma), F.lit(True))
            kept = attach(kept, stats, keys).where(_within([a], sigma)).select(*df.columns)
    return retention(rows, flags, keys)
