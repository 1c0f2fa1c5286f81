"""Depth maps: validity, scale against the sparse model, back-projection, resampling.

A raster is a table of rows: ``frame, v, depth array`` with optional ``conf`` and
``rgb`` arrays. Joins move whole rows; pixels appear only after the last join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.activation import finite
from scanloom.functions.pose import transform_point, w2c
from scanloom.operators.quantiles import percentiles
from scanloom.operators.sample import cap_per_group
from scanloom.plans.stage import as_keys, attach, stage

# The open ranges in which a depth counts, in metres.
NEAREST = 0.05
MODEL_DEPTH_MAX = 30.0
CAMERA_DEPTH = (0.01, 100.0)
FUSE_DEPTH_MAX = 12.0
CLOUD_DEPTH_MAX = 20.0
MIN_CONF = 0.4
STRIDE = 4
MIN_PAIRS_PER_IMAGE = 5
MAX_PAIRS_PER_IMAGE = 2000
MIN_PAIRS = 200


def rows_from_pixels(px: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Row-array form of a pixel table with ``frame, v, u, depth`` and optionally ``conf``."""
    keys = as_keys(by)
    values = [c for c in ("depth", "conf") if c in px.columns]
    packed = F.array_sort(F.collect_list(F.struct("u", *values)))  # one raster row, bounded by its width
    rows = px.groupBy(*keys, "frame", "v").agg(packed.alias("_row"))
    return rows.select(*keys, "frame", "v", *[F.col("_row")[c].alias(c) for c in values])


def pixels(rows: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Pixel form of a row-array table."""
    values = [c for c in ("depth", "conf") if c in rows.columns]
    arrays = F.arrays_zip(*values)
    out = rows.select(*as_keys(by), "frame", "v", F.posexplode(arrays).alias("u", "_p"))
    return out.select(*as_keys(by), "frame", "v", "u", *[F.col("_p")[c].alias(c) for c in values])


def valid_depth(df: DataFrame, max_depth: float, depth: str = "depth") -> DataFrame:
    """Pixels with a depth inside the open range (0.05, ``max_depth``)."""
    return df.where((F.col(depth) > NEAREST) & (F.col(depth) < float(max_depth)))


def min_conf(df: DataFrame, threshold: float = MIN_CONF, conf: str = "conf") -> DataFrame:
    """Pixels with at least the given confidence."""
    return df.where(~F.isnan(conf) & (F.col(conf) >= float(threshold)))


def conf_percentile_cut(
    df: DataFrame, pct: float, by: str | Sequence[str] | None = None, conf: str = "conf"
) -> DataFrame:
    """Pixels at or above the ``pct`` percentile of the confidence of their whole frame."""
    keys = [*as_keys(by), "frame"]
    cut = percentiles(df, {"_cut": conf}, {"p": pct / 100.0}, keys)
    columns = list(df.columns)
    return attach(df, stage(cut, "conf"), keys).where(F.col(conf) >= F.col("_cut_p")).select(*columns)


def stride(df: DataFrame, step: int = STRIDE) -> DataFrame:
    """Every ``step``-th pixel in both directions."""
    return df.where((F.col("v") % step == 0) & (F.col("u") % step == 0))


def rescale_depth(rows: DataFrame, scale: float | Column) -> DataFrame:
    """Depth arrays multiplied by a scale factor."""
    s = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale
    return rows.withColumn("depth", F.transform("depth", lambda d: d * s))


def join_points(observations: DataFrame, points3d: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Tracked observations with the coordinates of their 3D point; dangling ids drop out."""
    keys = [*as_keys(by), "point3d_id"]
    xyz = points3d.select(*keys, F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    return observations.where("point3d_id >= 0").join(xyz, keys)


def project_z(df: DataFrame, prefix: str = "w2c") -> DataFrame:
    """Camera-space depth ``z_cam`` of the point (px, py, pz)."""
    return df.withColumn("z_cam", transform_point(prefix, "px", "py", "pz")[2])


def sample_depth(
    observations: DataFrame, depth_rows: DataFrame, by: str | Sequence[str] | None = None
) -> DataFrame:
    """Depth at the nearest pixel of each observation, clamped to the raster.

    The raster of an observation is its ``frame``, or its ``image_id`` if it has no such
    column. The join moves raster rows, on (frame, v); observations of frames without depth
    and those without a finite position drop out.
    """
    keys = as_keys(by)
    observations = observations.where(finite("x", "y"))
    size = stage(
        depth_rows.groupBy(*keys, "frame").agg(
            (F.max("v") + 1).alias("_h"), F.max(F.size("depth")).alias("_w")
        ),
        "raster-size",
    )
    obs = observations if "frame" in observations.columns else observations.withColumn("frame", F.col("image_id"))
    obs = obs.join(size, [*keys, "frame"])
    obs = obs.withColumns(
        {
            "u": F.expr("CAST(least(greatest(rint(x), 0), _w - 1) AS INT)"),
            "v": F.expr("CAST(least(greatest(rint(y), 0), _h - 1) AS BIGINT)"),
        }
    ).drop("_h", "_w")
    rows = depth_rows.select(*keys, "frame", F.col("v").cast("long").alias("v"), "depth")
    joined = obs.join(rows, [*keys, "frame", "v"])
    return joined.withColumn("z_model", F.get("depth", F.col("u")).cast("double")).drop("depth")


def depth_pairs(
    images: DataFrame,
    observations: DataFrame,
    points3d: DataFrame,
    depth_rows: DataFrame,
    by: str | Sequence[str] | None = None,
    key: str = "obs_key",
) -> DataFrame:
    """Valid pairs of sparse-model depth and map depth with their ratio; all images, no caps.

    ``key`` identifies an observation within its image.
    """
    keys = as_keys(by)
    tracks = join_points(observations.select(*keys, "image_id", key, "x", "y", "point3d_id"), points3d, keys)
    frame = [c for c in images.columns if c == "frame"]
    poses = w2c(images).select(*keys, "image_id", *frame, "w2c_r20", "w2c_r21", "w2c_r22", "w2c_t2")
    tracks = tracks.join(poses, [*keys, "image_id"]).withColumn(
        "z_cam", F.expr("w2c_r20 * px + w2c_r21 * py + w2c_r22 * pz + w2c_t2")
    )
    near, far = CAMERA_DEPTH
    tracks = tracks.where((F.col("z_cam") > near) & (F.col("z_cam") < far))
    tracks = sample_depth(tracks.select(*keys, "image_id", *frame, key, "x", "y", "z_cam"), depth_rows, keys)
    tracks = tracks.where((F.col("z_model") > NEAREST) & (F.col("z_model") < MODEL_DEPTH_MAX))
    return tracks.select(*keys, "image_id", key, "z_cam", "z_model", (F.col("z_cam") / F.col("z_model")).alias("ratio"))


def capped_pairs(
    pairs: DataFrame,
    by: str | Sequence[str] | None = None,
    key: str = "obs_key",
    min_per_image: int = MIN_PAIRS_PER_IMAGE,
    max_per_image: int | None = MAX_PAIRS_PER_IMAGE,
) -> DataFrame:
    """Pairs of images with enough of them, at most ``max_per_image`` each (None: all)."""
    image = [*as_keys(by), "image_id"]
    enough = pairs.groupBy(*image).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_per_image)
    kept = pairs.join(stage(enough.select(*image), "images"), image, "left_semi")
    return kept if max_per_image is None else cap_per_group(kept, image, max_per_image, key)


def depth_scale(
    images: DataFrame,
    observations: DataFrame,
    points3d: DataFrame,
    depth_rows: DataFrame,
    by: str | Sequence[str] | None = None,
    key: str = "obs_key",
    min_total: int = MIN_PAIRS,
    max_per_image: int | None = MAX_PAIRS_PER_IMAGE,
    on_shortage: str = "error",
) -> DataFrame:
    """Scale from map depth to model depth: median ratio over all pairs, with its diagnostics.

    One row per group of ``images``, also of a group without any usable image. Fewer than
    ``min_total`` pairs raise an error when the row is read, or give a null ``scale`` with
    ``on_shortage="null"``. ``max_per_image`` bounds the pairs of one image (None: all).
    """
    keys = as_keys(by)
    pairs = stage(depth_pairs(images, observations, points3d, depth_rows, keys, key), "pairs")
    pairs = stage(capped_pairs(pairs, keys, key, max_per_image=max_per_image), "pairs")
    counts = pairs.groupBy(*keys, "image_id").agg(F.count("*").alias("_n"))
    counts = counts.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_pairs"), F.count("*").alias("n_images")
    )
    spread = pairs.groupBy(*keys).agg(F.stddev_pop("ratio").alias("std"))
    quart = percentiles(pairs, {"r": "ratio"}, {"p25": 0.25, "median": 0.5, "p75": 0.75}, keys)
    quart = quart.select(*keys, *[F.col(f"r_{q}").alias(q) for q in ("p25", "median", "p75")])
    out = attach(attach(counts, quart, keys, "left"), spread, keys, "left")
    if keys:
        out = attach(images.select(*keys).distinct(), out, keys, "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_pairs", "n_images")})
    if on_shortage == "error":
        text = F.concat(F.lit("depth scale needs "), F.lit(str(min_total)), F.lit(" pairs, found "), F.col("n_pairs"))
        scale = F.when(F.col("n_pairs") < min_total, F.raise_error(text).cast("double")).otherwise(F.col("median"))
    else:
        scale = F.when(F.col("n_pairs") >= min_total, F.col("median"))
    return out.withColumn("scale", scale)


def backproject(
    depth_rows: DataFrame,
    frames: DataFrame,
    max_depth: float | Column,
    by: str | Sequence[str] | None = None,
    min_depth: float | Column = NEAREST,
    step: int = 1,
    conf_at_least: float | None = None,
    color_rows: DataFrame | None = None,
    conf_pct: float | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """World points of the valid depth pixels.

    ``frames`` holds one row per frame with ``frame``, intrinsics and a ``c2w`` pose
    without axis flip. Invalid pixels are filtered inside the row arrays, before they
    become rows. ``color_rows`` (``frame, v, rgb array``) is joined on raster rows, so
    each colour stays with its pixel; a pixel without colour keeps nulls, and a colour raster
    of another width or height raises (``resample`` it first). ``carry``
    names columns of ``frames`` to keep.
    """
    keys = as_keys(by)
    on = [*keys, "frame"]
    need = [*carry, "fl_x", "fl_y", "cx", "cy", *[c for c in frames.columns if c.startswith("c2w_")]]
    frames = frames.select(*on, *need)
    rows = valid_rows(depth_rows, frames, max_depth, by, min_depth, step, conf_at_least, color_rows, conf_pct)
    px = rows.withColumn("_p", F.explode("_p"))
    px = px.withColumns({"u": F.col("_p.u"), "depth": F.col("_p.d")})
    world = transform_point("c2w", "(u - cx) / fl_x * depth", "(v - cy) / fl_y * depth", "depth")
    color = []
    if color_rows is not None:
        color = [F.col("_p.rgb")[i].alias(c) for i, c in enumerate(("red", "green", "blue"))]
    return px.select(*on, *carry, "v", "u", "depth", *[w.alias(a) for w, a in zip(world, "xyz")], *color)


def valid_rows(
    depth_rows: DataFrame,
    frames: DataFrame,
    max_depth: float | Column,
    by: str | Sequence[str] | None = None,
    min_depth: float | Column = NEAREST,
    step: int = 1,
    conf_at_least: float | None = None,
    color_rows: DataFrame | None = None,
    conf_pct: float | None = None,
) -> DataFrame:
    """Raster rows of ``frames``, with the columns of both and ``_p``, the array of a row's valid pixels.

    A pixel has its column ``u``, its depth ``d``, and ``rgb`` if colours are given.
    Its number in a row is the size of the array, so pixels are counted without becoming rows.
    """
    keys = as_keys(by)
    on = [*keys, "frame"]
    rows = depth_rows
    if color_rows is not None:
        # Rasters of unlike sizes would join the wrong rows, so heights are compared as well.
        own, other = ((F.max("v").alias(c), df.groupBy(*on)) for c, df in (("_dv", depth_rows), ("_cv", color_rows)))
        heights = attach(own[1].agg(own[0]), other[1].agg(other[0]), on).where("_dv <> _cv").select(*on, F.lit(True).alias("_unlike"))
        rows = attach(rows, stage(heights, "unlike-rasters"), on, "left")
    if step > 1:
        rows = rows.where(F.col("v") % step == 0)
    if conf_pct is not None:
        # The percentile is over the whole frame, so it is taken before any other filter.
        conf_px = depth_rows.select(*keys, "frame", F.explode("conf").alias("conf"))
        cut = percentiles(conf_px, {"_cut": "conf"}, {"p": conf_pct / 100.0}, on)
        rows = attach(rows, stage(cut, "conf"), on)
    rows = rows.join(frames, on)
    if color_rows is not None:
        rows = rows.join(color_rows.select(*on, "v", "rgb"), [*on, "v"], "left")
        wrong = F.raise_error(F.lit("colour and depth rasters differ in size")).cast("array<array<short>>")
        unlike = F.col("_unlike") | (F.col("rgb").isNotNull() & (F.size("rgb") != F.size("depth")))
        rows = rows.withColumn("rgb", F.when(unlike, wrong).otherwise(F.col("rgb").cast("array<array<short>>")))

    low = F.lit(float(min_depth)) if isinstance(min_depth, (int, float)) else min_depth
    high = F.lit(float(max_depth)) if isinstance(max_depth, (int, float)) else max_depth
    with_conf = conf_at_least is not None or conf_pct is not None

    def pixel(d: Column, u: Column) -> Column:
        fields = [u.alias("u"), d.cast("double").alias("d")]
        if with_conf:
            fields.append(F.get("conf", u).cast("double").alias("c"))
        if color_rows is not None:
            fields.append(F.get("rgb", u).alias("rgb"))
        return F.struct(*fields)

    def ok(p: Column) -> Column:
        keep = (p["d"] > low) & (p["d"] < high)
        if step > 1:
            keep = keep & (p["u"] % step == 0)
        if conf_at_least is not None:
            keep = keep & ~F.isnan(p["c"]) & (p["c"] >= float(conf_at_least))
        if conf_pct is not None:
            keep = keep & (p["c"] >= F.col("_cut_p"))
        return keep

    return rows.withColumn("_p", F.filter(F.transform("depth", pixel), ok))


def depth_to_points(
    depth_rows: DataFrame,
    frames: DataFrame,
    by: str | Sequence[str] | None = None,
    color_rows: DataFrame | None = None,
    step: int = STRIDE,
    conf_threshold: float = MIN_CONF,
    max_depth: float = CLOUD_DEPTH_MAX,
    carry: Sequence[str] = (),
) -> DataFrame:
    """World points on a pixel grid with enough confidence, coloured if colours are given."""
    return backproject(
        depth_rows,
        frames,
        max_depth,
        by,
        step=step,
        conf_at_least=conf_threshold,
        color_rows=color_rows,
        carry=carry,
    )


def attach_color(px: DataFrame, color_rows: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Colour of each pixel row, joined on (frame, v) and read at u."""
    on = [*as_keys(by), "frame", "v"]
    joined = px.join(color_rows.select(*on, "rgb"), on, "left").withColumn("_rgb", F.get("rgb", F.col("u")))
    named = {c: F.col("_rgb")[i] for i, c in enumerate(("red", "green", "blue"))}
    return joined.withColumns(named).drop("_rgb", "rgb")


def upsample(
    rows: DataFrame, width: int, height: int, by: str | Sequence[str] | None = None, column: str = "depth"
) -> DataFrame:
    """Bilinear enlargement of row arrays to ``width`` x ``height``: half-pixel centres, clamped edges.

    Rows are stretched in place; then each row is sent to the output rows it
    contributes to with its weight, one shuffle in which every output row receives
    one or two inputs.
    """
    keys = as_keys(by)
    on = [*keys, "frame"]
    size = rows.groupBy(*on).agg((F.max("v") + 1).alias("_h"), F.max(F.size(column)).alias("_w"))
    data = attach(rows.select(*on, "v", column), stage(size, "raster-size"), on)
    data = data.withColumn(
        "_w", F.when((F.col("_w") > width) | (F.col("_h") > height), F.raise_error(F.lit("upsample only enlarges")).cast("int")).otherwise(F.col("_w"))
    )
    # Source position of an output centre, clamped to the outermost source centres.
    at = "greatest(least((o + 0.5D) * _w / {n} - 0.5D, _w - 1), 0)"
    taps = at.format(n=width)
    stretched = F.expr(
        f"""transform(transform(sequence(0, {width - 1}), o -> {taps}), s ->
            {column}[CAST(floor(s) AS INT)] * (1 - (s - floor(s)))
            + {column}[CAST(least(floor(s) + 1, _w - 1) AS INT)] * (s - floor(s)))"""
    )
    data = data.withColumn("_row", stretched)
    # Output rows whose taps include v lie within one source row of it.
    pos = f"greatest(least((o + 0.5D) * _h / {height} - 0.5D, _h - 1), 0)"
    touched = F.expr(
        f"""filter(transform(
              sequence(CAST(greatest(floor((v - 1) * {height} / _h) - 1, 0) AS INT),
                       CAST(least(ceil((v + 2) * {height} / _h) + 1, {height} - 1) AS INT)),
              o -> struct(o AS o, 1 - abs({pos} - v) AS weight)), t -> t.weight > 0)"""
    )
    sent = data.withColumn("_t", F.explode(touched)).select(
        *on, F.col("_t.o").cast("long").alias("v"), F.col("_t.weight").alias("_k"), "_row"
    )
    weighted = F.expr("transform(_row, a -> a * _k)")
    got = sent.select(*on, "v", weighted.alias("_row")).groupBy(*on, "v").agg(F.collect_list("_row").alias("_rows"))
    total = F.expr("CASE WHEN size(_rows) = 1 THEN _rows[0] ELSE zip_with(_rows[0], _rows[1], (a, b) -> a + b) END")
    return got.select(*on, "v", total.alias(column))


def finite_points(df: DataFrame) -> DataFrame:
    return df.where(finite("x", "y", "z"))
