"""Frame tables: images joined to cameras, files, depth maps and sidecars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions.camera import INTRINSICS, has_lens_terms, intrinsics, xmp_intrinsics
from scanloom.functions.names import file_name, stem, with_suffix
from scanloom.functions.pose import model_to_c2w, pose_columns, pose_matrix, xmp_to_c2w
from scanloom.operators.quantiles import percentiles
from scanloom.plans.stage import as_keys, attach, stage


def join_camera(images: DataFrame, cameras: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Images with the columns of their camera."""
    return images.join(cameras, [*as_keys(by), "camera_id"])


def registered_frames(
    images: DataFrame, files: DataFrame, by: str | Sequence[str] | None = None, on: str = "name"
) -> DataFrame:
    """Images whose file exists."""
    keys = [*as_keys(by), on]
    return images.join(files.select(*keys), keys, "left_semi")


def skipped_count(
    images: DataFrame, files: DataFrame, by: str | Sequence[str] | None = None, on: str = "name"
) -> DataFrame:
    """Images without a file, per group."""
    keys = as_keys(by)
    gone = images.join(files.select(*keys, on), [*keys, on], "left_anti")
    return gone.groupBy(*keys).agg(F.count("*").alias("n_skipped"))


def link_depth(
    frames: DataFrame,
    files: DataFrame,
    by: str | Sequence[str] | None = None,
    name: str = "name",
    path: str = "path",
    suffix: str = ".npy",
) -> DataFrame:
    """Add ``depth_path``, the depth file with the same stem; null where there is none."""
    keys = as_keys(by)
    depth = (
        files.where(F.col(path).endswith(suffix))
        .groupBy(*keys, stem(path).alias("_stem"))
        .agg(F.min(path).alias("depth_path"))
    )
    return frames.withColumn("_stem", stem(name)).join(depth, [*keys, "_stem"], "left").drop("_stem")


def linked_count(linked: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    return linked.groupBy(*as_keys(by)).agg(
        F.count("*").alias("n_frames"), F.count("depth_path").alias("n_with_depth")
    )


def match_sidecars(
    sidecars: DataFrame, files: DataFrame, by: str | Sequence[str] | None = None, name: str = "name"
) -> DataFrame:
    """Sidecars whose ``<stem>.jpg`` exists, with that file name as ``jpeg``."""
    keys = as_keys(by)
    jpegs = files.select(*keys, file_name(name).alias("jpeg")).distinct()
    return sidecars.withColumn("jpeg", F.concat("stem", F.lit(".jpg"))).join(jpegs, [*keys, "jpeg"])


def sidecar_counts(
    sidecars: DataFrame, files: DataFrame, by: str | Sequence[str] | None = None, name: str = "name"
) -> DataFrame:
    """Per group: sidecars, those without a JPEG, those with one that were rejected, and those that become frames."""
    keys = as_keys(by)
    jpegs = files.select(*keys, file_name(name).alias("jpeg")).distinct().withColumn("_have", F.lit(True))
    error = F.col("error") if "error" in sidecars.columns else F.lit(None)
    rows = sidecars.select(*keys, F.concat("stem", F.lit(".jpg")).alias("jpeg"), error.isNotNull().alias("_bad"))
    there = F.col("_have").isNotNull()
    return rows.join(jpegs, [*keys, "jpeg"], "left").groupBy(*keys).agg(
        F.count("*").alias("n_sidecars"),
        F.count_if(~there).alias("n_without_image"),
        F.count_if(there & F.col("_bad")).alias("n_rejected"),
        F.count_if(there & ~F.col("_bad")).alias("n_frames"),
    )


def missing_outputs(
    inputs: DataFrame,
    existing: DataFrame,
    suffix: str,
    by: str | Sequence[str] | None = None,
    name: str = "name",
) -> DataFrame:
    """Inputs whose output ``<stem><suffix>`` does not exist yet, with the name it will get."""
    keys = as_keys(by)
    have = existing.select(*keys, file_name(name).alias("output"))
    return inputs.withColumn("output", with_suffix(name, suffix)).join(have, [*keys, "output"], "left_anti")


def registration_rate(inputs: DataFrame, images: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Share of input images the model contains."""
    keys = [*as_keys(by), "name"]
    have = images.select(*keys).distinct().withColumn("_have", F.lit(1.0))
    joined = inputs.select(*keys).join(have, keys, "left")
    return joined.groupBy(*as_keys(by)).agg(
        F.count("*").alias("n_input"),
        F.count("_have").alias("n_registered"),
        F.avg(F.coalesce("_have", F.lit(0.0))).alias("rate"),
    )


def camera_cluster(poses: DataFrame, by: str | Sequence[str] | None = None, prefix: str = "c2w") -> DataFrame:
    """Centroid of the camera centres and the 90th percentile of their distance to it."""
    keys = as_keys(by)
    centre = [f"{prefix}_t{i}" for i in range(3)]
    rows = poses.select(*keys, *centre)
    means = stage(
        rows.groupBy(*keys).agg(
            F.count("*").alias("n_cameras"), *[F.avg(c).alias(f"center_{a}") for c, a in zip(centre, "xyz")]
        ),
        "centre",
    )
    far = " + ".join(f"({c} - center_{a}) * ({c} - center_{a})" for c, a in zip(centre, "xyz"))
    dist = attach(rows, means, keys).select(*keys, F.expr(f"sqrt({far})").alias("dist"))
    radius = percentiles(dist, {"dist": "dist"}, {"p90": 0.9}, keys).withColumnRenamed("dist_p90", "radius_p90")
    return attach(means, radius, keys, "left")


def mean_focal(frames: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    return frames.groupBy(*as_keys(by)).agg(F.avg("fl_x").alias("fl_mean"), F.count("*").alias("n_frames"))


_FRAME = ("file_path", "transform_matrix", "fl_x", "fl_y", "cx", "cy", "w", "h", "depth_file_path")


def build_frames(
    images: DataFrame,
    cameras: DataFrame,
    image_files: DataFrame,
    depth_files: DataFrame | None = None,
    by: str | Sequence[str] | None = None,
    depth_dir: str = "depths",
) -> DataFrame:
    """Frame table of a sparse model: registered images with intrinsics, pose and depth link.

    ``images`` needs scalar pose columns, ``image_files`` a ``name``, ``depth_files``
    a ``path``. Lens terms are null unless one of them differs from 0. ``image_id``
    is kept so that the header can be taken from the first image of the model.
    """
    keys = as_keys(by)
    rows = registered_frames(images, image_files, keys)
    rows = model_to_c2w(intrinsics(join_camera(rows, cameras, keys)))
    if depth_files is not None:
        rows = link_depth(rows, depth_files, keys)
        rows = rows.withColumn("depth_file_path", F.concat(F.lit(f"{depth_dir}/"), file_name("depth_path")))
    else:
        rows = rows.withColumn("depth_file_path", F.lit(None).cast("string"))
    rows = rows.withColumns(
        {
            "file_path": F.concat(F.lit("images/"), F.col("name")),
            "transform_matrix": pose_matrix("c2w"),
            "w": F.col("width").cast("long"),
            "h": F.col("height").cast("long"),
            **{k: F.when(has_lens_terms(), F.col(k)) for k in INTRINSICS[4:]},
        }
    )
    return rows.select(*keys, "image_id", "name", *_FRAME, *INTRINSICS[4:], *pose_columns("c2w"))


def model_header(
    images: DataFrame, cameras: DataFrame, by: str | Sequence[str] | None = None, order: str | None = None
) -> DataFrame:
    """Document defaults: intrinsics of the camera of the first image in ``order``.

    That is the order of the file, ``image_idx``, if there is such a column, else ``image_id``.
    """
    keys = as_keys(by)
    order = order or ("image_idx" if "image_idx" in images.columns else "image_id")
    first = images.groupBy(*keys).agg(F.min_by("camera_id", order).alias("camera_id"))
    rows = intrinsics(join_camera(first, cameras, keys))
    return rows.select(
        *keys,
        F.lit("OPENCV").alias("camera_model"),
        "fl_x",
        "fl_y",
        "cx",
        "cy",
        F.col("width").cast("long").alias("w"),
        F.col("height").cast("long").alias("h"),
    )


def build_frames_xmp(
    sidecars: DataFrame,
    jpegs: DataFrame,
    width: int,
    height: int,
    depth_files: DataFrame | None = None,
    by: str | Sequence[str] | None = None,
    flip: bool = True,
) -> DataFrame:
    """Frame table of pose sidecars. Rejected sidecars and those without a JPEG are left out."""
    keys = as_keys(by)
    rows = sidecars.where(F.col("error").isNull()) if "error" in sidecars.columns else sidecars
    rows = xmp_to_c2w(xmp_intrinsics(match_sidecars(rows, jpegs, keys), width, height), flip=flip)
    if depth_files is not None:
        rows = link_depth(rows, depth_files, keys, name="jpeg", suffix=".png")
        rows = rows.withColumn("depth_file_path", F.concat(F.lit("depth/"), file_name("depth_path")))
    else:
        rows = rows.withColumn("depth_file_path", F.lit(None).cast("string"))
    rows = rows.withColumns(
        {
            "name": F.col("jpeg"),
            "file_path": F.concat(F.lit("images/"), F.col("jpeg")),
            "transform_matrix": pose_matrix("c2w"),
            "w": F.col("width"),
            "h": F.col("height"),
        }
    )
    return rows.select(*keys, "name", *_FRAME, *pose_columns("c2w"))


def xmp_header(frames: DataFrame, width: int, height: int, by: str | Sequence[str] | None = None) -> DataFrame:
    """Document defaults of a sidecar capture: mean focal length and the image centre."""
    keys = as_keys(by)
    depth_unit = F.when(F.count("depth_file_path") > 0, F.lit(0.001))
    head = frames.groupBy(*keys).agg(F.avg("fl_x").alias("fl_x"), depth_unit.alias("depth_unit_scale_factor"))
    return head.select(
        *keys,
        F.lit("OPENCV").alias("camera_model"),
        "fl_x",
        F.col("fl_x").alias("fl_y"),
        F.lit(width / 2).alias("cx"),
        F.lit(height / 2).alias("cy"),
        F.lit(width).cast("long").alias("w"),
        F.lit(height).cast("long").alias("h"),
        "depth_unit_scale_factor",
    )
