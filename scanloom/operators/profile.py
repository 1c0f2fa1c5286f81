"""Profiling of clouds and splats: one-pass aggregates, combined on the map side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.activation import (
    GHOST_BELOW,
    SOLID_ABOVE,
    finite,
    max_scale,
    opacity_band,
    scale_columns,
    sigmoid,
)
from scanloom.functions.names import capabilities_of
from scanloom.operators.quantiles import percentiles
from scanloom.plans.stage import as_keys, attach, stage

AXES = ("x", "y", "z")

# The thresholds the reports use.
OPACITY_LADDER = (0.1, 0.3, 0.5, 0.7, 0.9)
GHOST_RATIO_BELOW = 0.1
VERDICT = {"ghost_share": 0.30, "large_share": 0.05, "tiny_share": 0.10, "outlier_share": 0.01}
LARGE_SCALE, HALF_SCALE, SMALL_SCALE, TINY_SCALE = 1.0, 0.5, 0.01, 0.001


def _share(cond: Column) -> Column:
    """Share of rows where ``cond`` holds; a null condition counts as not holding."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def _axis_aggs(axes: Sequence[str]) -> list[Column]:
    out: list[Column] = []
    for a in axes:
        v = F.when(finite(*axes), F.col(a).cast("double"))
        out += [
            F.min(v).alias(f"{a}_min"),
            F.max(v).alias(f"{a}_max"),
            (F.max(v) - F.min(v)).alias(f"{a}_span"),
            F.avg(v).alias(f"{a}_mean"),
            F.stddev_pop(v).alias(f"{a}_std"),
        ]
    return out


def axis_stats(df: DataFrame, by: str | Sequence[str] | None = None, axes: Sequence[str] = AXES) -> DataFrame:
    """Min, max, span, mean and population deviation per axis.

    Rows with a null, NaN or infinite coordinate are left out and counted in ``n_invalid``.
    """
    ok = finite(*axes)
    return df.groupBy(*as_keys(by)).agg(
        F.count_if(ok).alias("n"), F.count_if(~ok).alias("n_invalid"), *_axis_aggs(axes)
    )


def beyond(axis: str, k: float) -> Column:
    """More than k deviations from the mean, given attached axis statistics."""
    return (F.col(f"{axis}_std") > 0) & (
        F.abs(F.col(axis).cast("double") - F.col(f"{axis}_mean")) > F.lit(float(k)) * F.col(f"{axis}_std")
    )


def outlier_counts(
    df: DataFrame, k: float = 3.0, by: str | Sequence[str] | None = None, axes: Sequence[str] = AXES
) -> DataFrame:
    """Rows beyond k deviations, count and percentage, one row per group and axis."""
    keys = as_keys(by)
    stats = stage(
        axis_stats(df, keys, axes).select(*keys, *[f"{a}_{s}" for a in axes for s in ("mean", "std")]),
        "axis-stats",
    )
    rows = df.where(finite(*axes)).select(*keys, *axes)
    counts = (
        attach(rows, stats, keys)
        .groupBy(*keys)
        .agg(F.count("*").alias("n"), *[F.count_if(beyond(a, k)).alias(a) for a in axes])
    )
    per_axis = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("n_outliers")) for a in axes]))
    return counts.select(*keys, "n", per_axis.alias("s")).select(
        *keys,
        "s.axis",
        "n",
        "s.n_outliers",
        F.try_divide(F.col("s.n_outliers") * 100.0, F.col("n")).alias("pct"),
    )


def bbox(df: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Axis-aligned bounds, their volume, and points per unit volume (null when the volume is 0)."""
    keys = as_keys(by)
    stats = axis_stats(df, keys)
    volume = F.col("x_span") * F.col("y_span") * F.col("z_span")
    return stats.select(
        *keys,
        "n",
        *[f"{a}_{e}" for a in AXES for e in ("min", "max")],
        volume.alias("volume"),
        F.try_divide(F.col("n").cast("double"), volume).alias("density"),
    )


def density(df: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    return bbox(df, by).select(*as_keys(by), "n", "volume", "density")


def exceedance(
    df: DataFrame,
    thresholds: Sequence[float] = OPACITY_LADDER,
    by: str | Sequence[str] | None = None,
    opacity: Column | None = None,
) -> DataFrame:
    """Count and percentage of rows above each opacity threshold, all in one pass."""
    keys = as_keys(by)
    op = sigmoid("opacity") if opacity is None else opacity
    base = df.select(*keys, op.alias("_op")).where(finite("_op"))
    wide = base.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("_op") > t).alias(f"_{i}") for i, t in enumerate(thresholds)]
    )
    ladder = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("n_above"))
            for i, t in enumerate(thresholds)
        ]
    )
    return wide.select(*keys, "n", F.explode(ladder).alias("s")).select(
        *keys,
        "s.threshold",
        "s.n_above",
        F.try_divide(F.col("s.n_above") * 100.0, F.col("n")).alias("pct"),
    )


def opacity_stats(
    df: DataFrame, by: str | Sequence[str] | None = None, exact: bool = True, clip: float | None = None
) -> DataFrame:
    """Mean and median activated opacity. ``exact=False`` takes the median from a bounded sketch."""
    keys = as_keys(by)
    base = df.select(*keys, sigmoid("opacity", clip).alias("op")).where(finite("op"))
    if not exact:
        return base.groupBy(*keys).agg(
            F.avg("op").alias("mean_opacity"), F.approx_percentile("op", 0.5, 10000).alias("median_opacity")
        )
    median = percentiles(base, {"op": "op"}, {"median": 0.5}, keys).withColumnRenamed("op_median", "median_opacity")
    return attach(base.groupBy(*keys).agg(F.avg("op").alias("mean_opacity")), median, keys, "left")


def ghost_ratio(
    df: DataFrame, below: float = GHOST_RATIO_BELOW, by: str | Sequence[str] | None = None, clip: float | None = None
) -> DataFrame:
    """Share of rows whose activated opacity is below the threshold."""
    keys = as_keys(by)
    base = df.select(*keys, sigmoid("opacity", clip).alias("_op")).where(finite("_op"))
    return base.groupBy(*keys).agg(F.count("*").alias("n"), _share(F.col("_op") < below).alias("ghost_ratio"))


def scale_stats(df: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Median, mean and size shares of the largest activated scale of each row."""
    keys = as_keys(by)
    base = df.select(*keys, max_scale(scale_columns(df)).alias("s")).where(finite("s"))
    shares = base.groupBy(*keys).agg(
        F.avg("s").alias("mean_scale"),
        _share(F.col("s") > LARGE_SCALE).alias("share_above_1"),
        _share(F.col("s") > HALF_SCALE).alias("share_above_05"),
        _share(F.col("s") < SMALL_SCALE).alias("share_below_001"),
    )
    median = percentiles(base, {"s": "s"}, {"median": 0.5}, keys).withColumnRenamed("s_median", "median_scale")
    return attach(shares, median, keys, "left")


def color_stats(df: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Mean, min and max per colour channel the cloud has."""
    aggs: list[Column] = []
    for c in ("red", "green", "blue"):
        if c in df.columns:
            aggs += [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    if not aggs:
        raise ValueError("no colour channel among the columns")
    return df.groupBy(*as_keys(by)).agg(*aggs)


def opacity_histogram(df: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Rows and percentage per opacity band."""
    keys = as_keys(by)
    base = df.select(*keys, sigmoid("opacity").alias("_op")).where(finite("_op"))
    counts = base.groupBy(*keys, opacity_band("_op").alias("band")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))  # at most three rows per group
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def _report_pass(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every aggregate of the report that needs no other aggregate first."""
    aggs: list[Column] = [F.count("*").alias("n_rows"), F.count_if(finite(*AXES)).alias("n"), *_axis_aggs(AXES)]
    if "opacity" in df.columns:
        op = F.when(finite("_op"), F.col("_op"))
        df = df.withColumn("_op", sigmoid("opacity"))
        aggs += [F.avg(op).alias("mean_opacity"), F.avg((op < GHOST_RATIO_BELOW).cast("double")).alias("ghost_share")]
        aggs += [
            F.avg((op > t).cast("double")).alias(f"share_opacity_above_{int(t * 10)}") for t in OPACITY_LADDER
        ]
    scales = scale_columns(df)
    if scales:
        df = df.withColumn("_s", max_scale(scales))
        s = F.when(finite("_s"), F.col("_s"))
        aggs += [
            F.avg(s).alias("mean_scale"),
            F.avg((s > LARGE_SCALE).cast("double")).alias("large_share"),
            F.avg((s > HALF_SCALE).cast("double")).alias("half_share"),
            F.avg((s < SMALL_SCALE).cast("double")).alias("small_share"),
            F.avg((s < TINY_SCALE).cast("double")).alias("tiny_share"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def _with_outliers(df: DataFrame, stats: DataFrame, keys: list[str], ks: Sequence[float]) -> DataFrame:
    """Attach the share of rows beyond each k to staged axis statistics; one more pass over the axes."""
    per_axis = stats.select(*keys, *[f"{a}_{s}" for a in AXES for s in ("mean", "std")])
    rows = attach(df.where(finite(*AXES)).select(*keys, *AXES), per_axis, keys)
    shares = rows.groupBy(*keys).agg(
        *[_share(beyond(a, k)).alias(f"{a}_outlier_share_{k:g}") for k in ks for a in AXES]
    )
    return attach(stats, shares, keys, "left")


def _issues(df: DataFrame, k: float) -> Column:
    rules = []
    if "ghost_share" in df.columns:
        rules.append(F.when(F.col("ghost_share") > VERDICT["ghost_share"], F.lit("high ghost ratio")))
    if "large_share" in df.columns:
        rules.append(F.when(F.col("large_share") > VERDICT["large_share"], F.lit("large gaussians")))
        rules.append(F.when(F.col("tiny_share") > VERDICT["tiny_share"], F.lit("tiny gaussians")))
    for a in AXES:
        share = F.col(f"{a}_outlier_share_{k:g}")
        rules.append(F.when(share > VERDICT["outlier_share"], F.lit(f"outliers in {a}")))
    return F.array_compact(F.array(*rules))


def quality_verdict(df: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Measured shares, the list of issues they raise, and whether the splat is healthy."""
    keys = as_keys(by)
    stats = stage(_report_pass(df, keys), "report")
    full = _with_outliers(df, stats, keys, [5.0])
    shares = [c for c in ("ghost_share", "large_share", "tiny_share") if c in full.columns]
    out = full.select(
        *keys, "n", *shares, *[f"{a}_outlier_share_5" for a in AXES], _issues(full, 5.0).alias("issues")
    )
    return out.withColumn("healthy", F.size("issues") == 0)


def splat_report(df: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """The whole quality report, one row per group.

    One pass for every plain aggregate, one over the axes for outliers, and the
    narrowing passes of the two medians together.
    """
    keys = as_keys(by)
    stats = stage(_report_pass(df, keys), "report")
    full = _with_outliers(df, stats, keys, [3.0, 5.0])
    values: dict[str, Column] = {}
    if "opacity" in df.columns:
        values["opacity"] = sigmoid("opacity")
    if scale_columns(df):
        values["scale"] = max_scale(scale_columns(df))
    if values:
        medians = percentiles(df, values, {"median": 0.5}, keys)
        medians = medians.select(*keys, *[F.col(f"{v}_median").alias(f"median_{v}") for v in values])
        full = attach(full, medians, keys, "left")
    volume = F.col("x_span") * F.col("y_span") * F.col("z_span")
    full = full.withColumns({"volume": volume, "density": F.try_divide(F.col("n").cast("double"), volume)})
    full = full.withColumn("issues", _issues(full, 5.0))
    return full.withColumn("healthy", F.size("issues") == 0)


def compare_clouds(clouds: Mapping[str, DataFrame | None]) -> DataFrame:
    """One comparison row per named cloud.

    ``None`` stands for a missing file and yields a row with status ``missing``.
    Clouds need not have the same columns; a measure a cloud cannot have is null.
    """
    present = {n: d for n, d in clouds.items() if d is not None}
    missing = [n for n, d in clouds.items() if d is None]
    wanted = [*AXES, "opacity", "red", "green", "blue"]
    parts = []
    for name, d in present.items():
        flags = capabilities_of(d.columns)
        cols = [F.col(c).cast("double").alias(c) if c in d.columns else F.lit(None).cast("double").alias(c) for c in wanted]
        parts.append(d.select(F.lit(name).alias("name"), *[F.lit(v).alias(k) for k, v in flags.items()], *cols))
    if not parts:
        raise ValueError("no cloud to compare")
    out = compare_rows(reduce(DataFrame.unionByName, parts))
    if missing:
        spark = out.sparkSession
        gone = spark.createDataFrame([(n, "missing") for n in missing], "name string, status string")
        out = out.unionByName(gone, allowMissingColumns=True)
    return out


def compare_rows(rows: DataFrame) -> DataFrame:
    """One comparison row per ``name`` of rows that carry it beside the flags of its cloud.

    A measured column that ``rows`` lacks counts as null throughout.
    """
    flags = ["has_color", "has_normals", "is_splat"]
    wanted = [*AXES, "opacity", "red", "green", "blue"]
    values = [F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double") for c in wanted]
    rows = rows.select("name", *flags, *[v.alias(c) for c, v in zip(wanted, values)])
    op = sigmoid("opacity", clip=88.0)
    rows = rows.withColumn("_op", F.when(finite("opacity"), op))
    ladder = (0.1, 0.3, 0.5, 0.9)
    stats = rows.groupBy("name", *flags).agg(
        F.count("*").alias("n"),
        *_axis_aggs(AXES),
        *[F.count_if(F.col("_op") > t).alias(f"_above_{int(t * 10)}") for t in ladder],
        F.avg("_op").alias("mean_opacity"),
        F.avg((F.col("_op") < GHOST_RATIO_BELOW).cast("double")).alias("ghost_ratio"),
        *[
            f(c).alias(f"{c}_{label}")
            for c in ("red", "green", "blue")
            for label, f in (("mean", F.avg), ("min", F.min), ("max", F.max))
        ],
    )
    for t in ladder:
        label = f"n_above_{int(t * 10)}"
        stats = stats.withColumn(label, F.when(F.col("is_splat"), F.col(f"_above_{int(t * 10)}"))).drop(
            f"_above_{int(t * 10)}"
        )
    volume = F.col("x_span") * F.col("y_span") * F.col("z_span")
    stats = stats.withColumns(
        {
            "volume": volume,
            "density": F.try_divide(F.col("n").cast("double"), volume),
            "status": F.lit("ok"),
        }
    )
    medians = percentiles(rows, {"_op": "_op"}, {"median": 0.5}, ["name"]).withColumnRenamed(
        "_op_median", "median_opacity"
    )
    return attach(stats, medians, ["name"], "left")


def retention(df: DataFrame, flags: Mapping[str, Column], by: str | Sequence[str] | None = None) -> DataFrame:
    """Rows in, removed by each filter in turn, kept, and the percentage kept, in one pass.

    ``flags`` are keep-conditions in the order they are applied; a row counts as
    removed by the first one it fails.
    """
    keys = as_keys(by)
    alive: Column = F.lit(True)
    aggs = [F.count("*").alias("n_in")]
    for name, keep in flags.items():
        keep = F.coalesce(keep, F.lit(False))
        aggs.append(F.count_if(alive & ~keep).alias(f"removed_{name}"))
        alive = alive & keep
    aggs.append(F.count_if(alive).alias("n_kept"))
    out = df.groupBy(*keys).agg(*aggs)
    return out.withColumn("pct_kept", F.try_divide(F.col("n_kept") * 100.0, F.col("n_in")))


def compare_runs(
    metrics: DataFrame,
    base: str,
    candidate: str,
    metric: str = "metric",
    run: str = "run",
    value: str = "value",
) -> DataFrame:
    """Metric by run table with the change from ``base`` to ``candidate``."""
    wide = (
        metrics.where(F.col(run).isin(base, candidate))
        .groupBy(metric)
        .pivot(run, [base, candidate])
        .agg(F.first(value, ignorenulls=True))
    )
    b, c = F.col(f"`{base}`"), F.col(f"`{candidate}`")
    return wide.select(
        metric,
        b.alias("before"),
        c.alias("after"),
        (c - b).alias("delta"),
        F.when(c > b, "up").when(c < b, "down").when(c == b, "same").alias("direction"),
    )


__all__ = [
    "AXES",
    "GHOST_BELOW",
    "OPACITY_LADDER",
    "SOLID_ABOVE",
    "axis_stats",
    "bbox",
    "beyond",
    "color_stats",
    "compare_clouds",
    "compare_runs",
    "density",
    "exceedance",
    "ghost_ratio",
    "opacity_histogram",
    "opacity_stats",
    "outlier_counts",
    "percentiles",
    "quality_verdict",
    "retention",
    "scale_stats",
    "splat_report",
]
