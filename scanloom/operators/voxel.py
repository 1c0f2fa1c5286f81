"""Voxel thinning and the search for a voxel size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.activation import finite
from scanloom.operators.profile import AXES, axis_stats
from scanloom.plans.stage import as_keys, attach, stage

BISECTIONS = 20
# Levels counted in one job try 2^levels - 1 sizes per point: few jobs for small clouds, little work for large ones.
_LEVELS_SMALL, _LEVELS_LARGE, _LARGE_CLOUD = 5, 3, 20_000_000
_ROWS_PER_SLAB = 1_000_000


def _cells(size: Column) -> list[Column]:
    return [F.floor(F.col(a).cast("double") / size).cast("long").alias(f"_v{a}") for a in AXES]


def _first_per_cell(df: DataFrame, keys: list[str], size: Column, order: str, columns: Sequence[str]) -> DataFrame:
    """The row with the lowest ``order`` in each cell.

    Each column is picked by its own ``min_by``: with a numeric order and numeric
    columns all buffers have a fixed width, so this is a hash aggregate with
    map-side combine.
    """
    rest = [c for c in columns if c not in keys]
    picked = [F.min_by(c, order).alias(f"_p_{c}") for c in rest]
    out = df.groupBy(*keys, *_cells(size)).agg(*picked)
    named = [F.col(c) if c in keys else F.col(f"_p_{c}").alias(c) for c in columns]
    return out.select(*named)


def voxel_downsample(
    df: DataFrame, size: float, by: str | Sequence[str] | None = None, order: str = "point_id"
) -> DataFrame:
    """One row per voxel, the first in ``order``. A size of 0 or less changes nothing."""
    if size <= 0:
        return df
    columns = list(df.columns)
    return _first_per_cell(df.where(finite(*AXES)), as_keys(by), F.lit(float(size)), order, columns)


def _descend(levels: int, goes_up, size_at=None) -> Column:
    """``levels`` bisections of [_lo, _hi] as one expression.

    ``goes_up(pos)`` says whether the lower bound moves to the midpoint numbered
    ``pos``. Returns the final interval, and the midpoint numbered ``size_at`` if
    it is on the way.
    """
    start = F.struct(
        F.col("_lo").cast("double").alias("lo"),
        F.col("_hi").cast("double").alias("hi"),
        F.lit(0).alias("pos"),
        F.lit(None).cast("double").alias("hit"),
    )

    def halve(s: Column, half: Column) -> Column:
        mid, at = (s["lo"] + s["hi"]) / 2, s["pos"] + half
        up = goes_up(at)
        hit = s["hit"] if size_at is None else F.coalesce(s["hit"], F.when(at == size_at, mid))
        return F.struct(
            F.when(up, mid).otherwise(s["lo"]).alias("lo"),
            F.when(up, s["hi"]).otherwise(mid).alias("hi"),
            F.when(up, at).otherwise(s["pos"]).alias("pos"),
            hit.alias("hit"),
        )

    halves = F.array(*[F.lit(1 << i) for i in reversed(range(levels))])
    return F.aggregate(halves, start, halve)


def _bisect(state: DataFrame, points: DataFrame, keys: list[str], target: int, levels: int) -> DataFrame:
    """Advance the search by ``levels`` bisections with one job over the points."""
    low = [f"{a}_min" for a in AXES]
    numbered = state.select(*keys, *low, "_lo", "_hi", F.explode(F.sequence(F.lit(1), F.lit((1 << levels) - 1))).alias("i"))
    size = _descend(levels, lambda at: at < F.col("i"), F.col("i"))["hit"]
    candidates = numbered.select(*keys, *low, "i", size.alias("size")).where(F.col("size") > 0)
    origin = [F.floor(F.col(c) / F.col("size")).alias(f"_o{c[0]}") for c in low]
    candidates = candidates.select(*keys, "i", "size", *origin)

    # A cell index relative to the lower bound is below 2^21 on each axis, so three fit in one long.
    rows = attach(points, candidates, keys) if keys else points.crossJoin(F.broadcast(candidates))
    rel = [F.floor(F.col(a) / F.col("size")) - F.col(f"_o{a}") for a in AXES]
    cell = F.shiftleft(F.shiftleft(rel[0], 21).bitwiseOR(rel[1]), 21).bitwiseOR(rel[2])
    cells = rows.select(*keys, "i", cell.alias("_cell")).distinct().groupBy(*keys, "i").agg(F.count("*").alias("_n"))
    over = cells.groupBy(*keys).agg(F.collect_set(F.when(F.col("_n") > target, F.col("i"))).alias("_over"))

    end = _descend(levels, lambda at: F.coalesce(F.array_contains("_over", at), F.lit(False)))
    walked = attach(state, over, keys, "left").withColumn("_end", end)
    return stage(walked.select(*keys, *low, F.col("_end.lo").alias("_lo"), F.col("_end.hi").alias("_hi")), "bounds")


def _slabs(points: DataFrame, state: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Coordinates of the groups to search, written once in spatial slabs.

    Every round reads them again with each point counted under many sizes, so a
    cell should lie in few tasks: range partitions along the axes make the
    map-side distinct remove nearly all repeats, and split a crowded spot too.
    """
    parts = max(points.sparkSession.sparkContext.defaultParallelism, -(-total // _ROWS_PER_SLAB))
    if keys:
        points = attach(points, state.select(*keys), keys)
    return stage(points.repartitionByRange(parts, *keys, *AXES), "slabs")


def voxel_size_search(
    df: DataFrame,
    target: int,
    by: str | Sequence[str] | None = None,
    bisections: int = BISECTIONS,
    levels_per_job: int | None = None,
) -> DataFrame:
    """Voxel size that thins each group to at most ``target`` cells; one row per group above the target.

    Halves the interval from 0 to the largest extent ``bisections`` times: more
    cells than the target moves the lower bound up, otherwise the upper bound
    down, and the upper bound is the answer. Cell counts are not strictly monotone
    in the size, so the same sizes are tried as a plain bisection would, but the
    sizes of several levels are counted in one job.
    """
    if bisections > BISECTIONS:
        raise ValueError(f"at most {BISECTIONS} bisections")  # cell numbers have 21 bits per axis
    keys = as_keys(by)
    points = df.where(finite(*AXES)).select(*keys, *[F.col(a).cast("double").alias(a) for a in AXES])
    extent = F.greatest(*[F.col(f"{a}_span") for a in AXES])
    state = axis_stats(points, keys).where(F.col("n") > target)
    state = state.select(*keys, "n", *[f"{a}_min" for a in AXES], F.lit(0.0).alias("_lo"), extent.alias("_hi"))
    state = stage(state, "bounds")
    if state.isEmpty():
        return state.select(*keys, F.col("_hi").alias("voxel_size"))
    total = state.agg(F.sum("n")).first()[0]
    points = _slabs(points, state, keys, total)
    levels = levels_per_job or (_LEVELS_SMALL if total < _LARGE_CLOUD else _LEVELS_LARGE)
    left = bisections
    while left > 0:
        step = min(levels, left)
        state = _bisect(state, points, keys, target, step)
        left -= step
    return state.select(*keys, F.col("_hi").alias("voxel_size"))


def voxel_to_target(
    df: DataFrame, target: int, by: str | Sequence[str] | None = None, order: str = "point_id"
) -> DataFrame:
    """Thin every group above ``target`` rows with the voxel size found for it; others are unchanged."""
    keys = as_keys(by)
    columns = list(df.columns)
    sizes = stage(voxel_size_search(df, target, keys), "voxel")
    if sizes.isEmpty():
        return df
    marked = attach(df.where(finite(*AXES)), sizes, keys, "left")
    thinned = _first_per_cell(marked.where("voxel_size > 0"), keys, F.col("voxel_size"), order, columns)
    same = marked.where("voxel_size is null or voxel_size <= 0").select(*columns)
    return thinned.unionByName(same) if keys else thinned
