"""Camera intrinsics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTRINSICS = ("fl_x", "fl_y", "cx", "cy", "k1", "k2", "p1", "p2")

# For each camera model id, the slot of ``params`` that holds each
# intrinsic. Absent terms are 0. Ids: 0 simple pinhole, 1 pinhole, 2 simple radial,
# 3 radial, 4 OpenCV.
PARAM_SLOTS: dict[int, dict[str, int]] = {
    0: {"fl_x": 0, "fl_y": 0, "cx": 1, "cy": 2},
    1: {"fl_x": 0, "fl_y": 1, "cx": 2, "cy": 3},
    2: {"fl_x": 0, "fl_y": 0, "cx": 1, "cy": 2, "k1": 3},
    3: {"fl_x": 0, "fl_y": 0, "cx": 1, "cy": 2, "k1": 3, "k2": 4},
    4: {"fl_x": 0, "fl_y": 1, "cx": 2, "cy": 3, "k1": 4, "k2": 5, "p1": 6, "p2": 7},
}

# Fixed value: frame width of the focal length equivalence, in millimetres.
FULL_FRAME_MM = 36.0
MAX_DEPTH_MM = 65535


def intrinsics(df: DataFrame) -> DataFrame:
    """Add focal lengths, principal point and lens terms from ``model_id`` and ``params``.

    Any other model is read like a pinhole; what its parameters lack falls back to
    the first focal length and the image centre.
    """
    fallback = {
        "fl_x": "get(params, 0)",
        "fl_y": "coalesce(get(params, 1), get(params, 0))",
        "cx": "coalesce(get(params, 2), width / 2D)",
        "cy": "coalesce(get(params, 3), height / 2D)",
    }
    out = {}
    for name in INTRINSICS:
        whens = " ".join(
            f"WHEN {m} THEN " + (f"get(params, {slots[name]})" if name in slots else "0D")
            for m, slots in PARAM_SLOTS.items()
        )
        out[name] = F.expr(f"CASE model_id {whens} ELSE {fallback.get(name, '0D')} END")
    return df.withColumns(out)


def scale_intrinsics(df: DataFrame, width: str | int, height: str | int) -> DataFrame:
    """Rescale the intrinsics from ``width`` x ``height`` of the row to another raster size."""
    return df.withColumns(
        {
            **{c: F.expr(f"{c} * ({width} / CAST(width AS DOUBLE))") for c in ("fl_x", "cx")},
            **{c: F.expr(f"{c} * ({height} / CAST(height AS DOUBLE))") for c in ("fl_y", "cy")},
        }
    ).withColumns({"width": F.expr(str(width)).cast("long"), "height": F.expr(str(height)).cast("long")})


def k_matrix(df: DataFrame, name: str = "k") -> DataFrame:
    """Add the 3 x 3 intrinsics matrix."""
    return df.withColumn(name, F.expr("array(array(fl_x, 0D, cx), array(0D, fl_y, cy), array(0D, 0D, 1D))"))


def xmp_intrinsics(df: DataFrame, width: int, height: int) -> DataFrame:
    """Pixel intrinsics from a 35 mm focal length and relative principal-point offsets."""
    longest = max(width, height)
    focal = F.expr(f"fl35 * {longest} / {FULL_FRAME_MM}D")
    return df.withColumns(
        {
            "fl_x": focal,
            "fl_y": focal,
            "cx": F.expr(f"{width} * (0.5D + ppu)"),
            "cy": F.expr(f"{height} * (0.5D + ppv)"),
            "width": F.lit(width).cast("long"),
            "height": F.lit(height).cast("long"),
        }
    )


def downscale_dims(df: DataFrame, factor: float, width: str = "width", height: str = "height") -> DataFrame:
    """Size after shrinking by ``factor``, rounded up, at least 1; factors up to 1 keep the size."""
    if factor <= 1:
        return df.withColumns({"new_width": F.col(width), "new_height": F.col(height)})
    size = "CAST(greatest(1, ceil({c} / {f}D)) AS BIGINT)"
    return df.withColumns(
        {
            "new_width": F.expr(size.format(c=width, f=float(factor))),
            "new_height": F.expr(size.format(c=height, f=float(factor))),
        }
    )


def fit_dims(df: DataFrame, longest: int, width: str = "width", height: str = "height") -> DataFrame:
    """Size scaled so that the long side is ``longest``, truncated to whole pixels."""
    scale = f"({float(longest)}D / greatest({width}, {height}))"
    return df.withColumns(
        {
            "new_width": F.expr(f"CAST({width} * {scale} AS BIGINT)"),
            "new_height": F.expr(f"CAST({height} * {scale} AS BIGINT)"),
        }
    )


def depth_to_mm(depth: Column | str) -> Column:
    """Depth in metres as whole millimetres, clamped to the 16-bit range, truncated; null for null and NaN."""
    c = (F.col(depth) if isinstance(depth, str) else depth).cast("double")
    clamped = F.greatest(F.least(c * 1000.0, F.lit(float(MAX_DEPTH_MM))), F.lit(0.0)).cast("int")
    return F.when(c.isNotNull() & ~F.isnan(c), clamped)


def has_lens_terms() -> Column:
    """True when any lens term differs from 0."""
    return F.expr("k1 <> 0 OR k2 <> 0 OR p1 <> 0 OR p2 <> 0")
