"""Whole jobs, composed of the operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanloom.functions.activation import finite
from scanloom.functions.camera import intrinsics, scale_intrinsics
from scanloom.functions.pose import invert_rigid, w2c
from scanloom.operators import depth as D
from scanloom.operators import masks as M
from scanloom.operators.catalog import file_catalog
from scanloom.operators.clip import CLOUD_SIGMA, MIN_OPACITY, PRUNE_SIGMA, prune, prune_opacity, sigma_clip
from scanloom.operators.frames import build_frames_xmp, join_camera, sidecar_counts, xmp_header
from scanloom.operators.profile import AXES, compare_rows
from scanloom.operators.resample import resample
from scanloom.operators.sample import sample_exact
from scanloom.operators.voxel import voxel_to_target
from scanloom.plans.stage import as_keys, attach, stage
from scanloom.sources.captures import write_captures
from scanloom.sources.documents import write_transforms_files
from scanloom.sources.files import list_inputs
from scanloom.sources.ply import ply_catalog, read_unlike
from scanloom.sources.xmp import read_xmp

CLOUD_TARGET = 500_000
#: Points that a merged cloud has at most, by default.
MERGED_CAP = 2_000_000
#: Times ``target`` that the frames of a capture keep together before clipping, by default.
OVERSAMPLE = 4
_SIDE = 1 << 16


#: The folder above the one that holds a file.
_CAPTURE = r"([^/]+)/[^/]+/[^/]+$"


def sidecar_documents(
    spark: SparkSession,
    sidecars: str,
    images: str,
    target: str,
    width: int,
    height: int,
    depth: str | None = None,
    flip: bool = True,
    ply_file_path: str | None = None,
    capture: str = _CAPTURE,
) -> DataFrame:
    """Frame documents of the pose sidecars below ``sidecars``: one ``transforms.json`` per capture below ``target``.

    Files belong to the capture that the first group of ``capture`` finds in their
    path; empty files count as absent. Returns, per capture, how many sidecars there are, have no JPEG below
    ``images``, were rejected and became frames, and the path and length of its
    document: null where no frame is left. Raises if no capture has a frame.
    """
    of = F.regexp_extract("path", capture, 1)
    cars = stage(read_xmp(spark, sidecars).withColumn("capture", of), "sidecars")
    jpegs = stage(file_catalog(spark, images, "*.jpg").select(of.alias("capture"), F.col("path").alias("name")), "listed")
    maps = file_catalog(spark, depth, "*.png").withColumn("capture", of) if depth else None
    frames = stage(build_frames_xmp(cars, jpegs, width, height, maps, "capture", flip), "frames")
    written = write_transforms_files(frames, xmp_header(frames, width, height, "capture"), target, "capture", ply_file_path)
    return sidecar_counts(cars, jpegs, "capture").join(written, "capture", "left")


def union_clouds(clouds: Sequence[DataFrame], strict: bool = False) -> DataFrame:
    """Bag union by column name. ``strict`` requires equal schemas; otherwise missing columns become null."""
    first = clouds[0]
    if strict:
        want = {f.name: f.dataType for f in first.schema}
        for i, c in enumerate(clouds[1:], 1):
            if {f.name: f.dataType for f in c.schema} != want:
                raise ValueError(f"cloud {i} has other columns than the first: {c.schema.simpleString()}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=not strict), clouds)


def merge_splats(clouds: Sequence[DataFrame]) -> DataFrame:
    """Bag union of splats that must all have the properties of the first."""
    return union_clouds(clouds, strict=True)


def merge_files(spark: SparkSession, paths: str | Sequence[str], strict: bool = True) -> DataFrame:
    """All vertices of many point files in one scan, with ``path`` and ``point_id``.

    ``strict`` requires the same properties and types in all files, in any order; otherwise
    what a file lacks is null and types are widened. Headers are read by tasks.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    files = [p for one in given for p, _ in list_inputs(one, ".ply")]
    if not files:
        raise FileNotFoundError(f"no point file in {', '.join(given)}")
    headers = stage(ply_catalog(spark, files), "headers")
    other = headers.where("status <> 'ok'").select("path", "status").first()
    if other is not None:
        raise ValueError(f"{other.path}: {other.status}")
    if strict:
        said = F.array_sort(F.arrays_zip("properties", "kinds"))
        kinds = headers.groupBy(said.alias("said")).agg(F.min("path").alias("path")).orderBy("path").limit(2).collect()
        if len(kinds) > 1:
            raise ValueError(f"{kinds[1].path} has other properties than {kinds[0].path}")
    return read_unlike(spark, files, headers)


def compare_files(spark: SparkSession, clouds: Mapping[str, str]) -> DataFrame:
    """One comparison row per named file or folder of point files, whatever their properties, in one scan.

    The measures are those of ``profile.compare_clouds``. ``status`` is ``missing`` for a name without
    files and tells what is wrong if one of its files cannot be read; such a name
    has no measures. A cloud without vertices has an ``n`` of 0.
    """
    listed: list[tuple[str, str]] = []
    for name, path in clouds.items():
        try:
            listed += [(name, p) for p, _ in list_inputs(path, ".ply")]
        except FileNotFoundError:
            pass
    names = spark.createDataFrame([(n,) for n in clouds], "name string")
    of = spark.createDataFrame(listed, "name string, path string")
    headers = stage(ply_catalog(spark, sorted({p for _, p in listed})), "headers")
    flags = ["has_color", "has_normals", "is_splat"]
    bad = F.when(F.col("status") != "ok", F.col("status"))
    told = of.join(headers, "path").groupBy("name").agg(
        F.coalesce(F.min(bad), F.lit("ok")).alias("status"), *[F.bool_or(f).alias(f) for f in flags]
    )
    told = stage(names.join(told, "name", "left").withColumn("status", F.coalesce("status", F.lit("missing"))), "clouds")
    fit = told.where("status = 'ok'")
    whole = stage(of.join(fit, "name").select("path", "name", *flags), "cloud-files")
    files = sorted({r.path for r in whole.select("path").collect()})
    if not files:
        raise ValueError("no cloud to compare")
    rows = read_unlike(spark, files, headers.join(whole.select("path").distinct(), "path"))
    used = [c for c in rows.columns if c in ("path", *AXES, "opacity", "red", "green", "blue")]
    thin = spark.read.format("ply").schema(StructType([rows.schema[c] for c in used])).option("missing", "null")
    measured = compare_rows(thin.load(",".join(files)).join(whole, "path")).drop("status", *flags)
    out = told.join(measured, "name", "left")
    return out.withColumn("n", F.when(F.col("status") == "ok", F.coalesce("n", F.lit(0))))


def subsample(
    df: DataFrame,
    target: int = CLOUD_TARGET,
    sigma: float = CLOUD_SIGMA,
    key: str = "point_id",
    by: str | Sequence[str] | None = None,
    seed: int = 42,
    ordered: bool = False,
) -> DataFrame:
    """Clip outliers on all axes, then draw exactly ``target`` rows per group.

    Row numbers restart in every file: if ``df`` has ``path`` and it is not in ``by``,
    rows are drawn by path and key.
    """
    kept = sigma_clip(df, sigma, by=by)
    if "path" not in df.columns or "path" in as_keys(by) or key == "path":
        return sample_exact(kept, target, key, seed, by, ordered)
    drawn = kept.withColumn("_row", F.concat_ws(":", "path", F.col(key).cast("string")))
    drawn = sample_exact(drawn, target, "_row", seed, by).drop("_row")
    return drawn.orderBy("path", key) if ordered else drawn


def prune_files(
    spark: SparkSession,
    source: str,
    target: str,
    threshold: float = MIN_OPACITY,
    sigma: float = PRUNE_SIGMA,
    per_file: bool = True,
) -> None:
    """Prune splat files into ``target``, keeping every property and the header of the first file.

    With ``per_file`` each input file is a capture of its own. The files are read twice:
    once for coordinates and opacity, once whole.
    """
    full = spark.read.format("ply").load(source)
    used = [f for f in full.schema.fields if f.name in ("path", "opacity", *AXES)]
    thin = spark.read.format("ply").schema(StructType(used)).load(source)
    # A point file is read whole for any of its columns, so the statistics come from one thin copy.
    thin = stage(prune_opacity(thin, threshold), "thin")
    kept = prune(full, threshold, sigma, ["path"] if per_file else None, stats_from=thin)
    head = list_inputs(source, ".ply")[0][0]
    kept.drop("path", "point_id").write.format("ply").mode("overwrite").option("headerFrom", head).save(target)


def prune_captures(
    spark: SparkSession,
    source: str,
    target: str,
    threshold: float = MIN_OPACITY,
    sigma: float = PRUNE_SIGMA,
    records_per_file: int | None = None,
    overwrite: bool = True,
) -> DataFrame:
    """Prune every splat file below ``source`` by itself, to a file of the same name and header below ``target``.

    Returns name, n_source, n_kept, pct_kept and n_files, a row per input file; one
    with no row left becomes a file without vertices. Order of rows, properties and comments
    stay those of the input file.
    """
    inputs = [p for p, _ in list_inputs(source, ".ply")]
    if not inputs:
        raise FileNotFoundError(f"no point file in {source}")
    root = len(os.path.commonpath(inputs)) + 1 if len(inputs) > 1 else inputs[0].rindex("/") + 1
    full = spark.read.format("ply").load(source)
    used = [f for f in full.schema.fields if f.name in ("path", "opacity", *AXES)]
    thin = spark.read.format("ply").schema(StructType(used)).load(source)
    thin = stage(prune_opacity(thin, threshold), "thin")
    kept = prune(full, threshold, sigma, ["path"], stats_from=thin)
    name = F.substring("path", root + 1, 1 << 16)
    expected = spark.createDataFrame([(p,) for p in inputs], "path string").select(name.alias("name"), F.col("path").alias("header"))
    files = write_captures(
        kept, target, name, header=F.col("path"), expected=expected, records_per_file=records_per_file, overwrite=overwrite
    )
    found = files.groupBy("name").agg(
        F.max("n_source").alias("n_source"), F.sum("n_kept").alias("n_kept"), F.count("*").alias("n_files")
    )
    share = F.when(F.col("n_source") > 0, F.col("n_kept") * 100.0 / F.col("n_source"))
    return found.select("name", "n_source", "n_kept", share.alias("pct_kept"), "n_files")


@dataclass
class FusedDepth:
    """Result of a depth fusion: the coloured cloud, one bounds row per group, and the points found and kept per frame."""

    cloud: DataFrame
    bounds: DataFrame
    frames: DataFrame


def fuse_depth(
    images: DataFrame,
    cameras: DataFrame,
    depth_rows: DataFrame,
    observations: DataFrame | None = None,
    points3d: DataFrame | None = None,
    color_rows: DataFrame | None = None,
    by: str | Sequence[str] | None = None,
    target: int = CLOUD_TARGET,
    sigma: float = CLOUD_SIGMA,
    max_depth: float = D.FUSE_DEPTH_MAX,
    rescale: bool = True,
    obs_key: str = "obs_key",
    min_total: int = D.MIN_PAIRS,
    conf_pct: float | None = None,
    oversample: int | None = OVERSAMPLE,
    max_pairs_per_image: int | None = D.MAX_PAIRS_PER_IMAGE,
    on_shortage: str = "error",
) -> FusedDepth:
    """Fuse the depth maps of every capture into one cloud of at most ``target`` points.

    Depth maps and sparse model differ in scale, so unless ``rescale`` is switched
    off the depths are first multiplied by the scale factor of the capture. Depth
    limits are those of the unscaled map. ``images`` are the registered frames, with
    scalar pose columns; the raster of an image is its ``frame`` (or ``image_id``).

    Before clipping, every frame keeps an equal share of ``oversample * target`` points
    (None: all); ``frames`` of the result tells what it had. ``max_pairs_per_image`` bounds
    the pairs behind the scale. A capture with too few pairs raises an error, or, with
    ``on_shortage="null"``, has no points and bounds without a scale.
    """
    keys = as_keys(by)
    if "frame" not in images.columns:
        images = images.withColumn("frame", F.col("image_id"))
    frames = invert_rigid(w2c(intrinsics(join_camera(images, cameras, keys))))

    info = None
    if rescale:
        if observations is None or points3d is None:
            raise ValueError("rescaling needs observations and points3d")
        info = stage(
            D.depth_scale(
                images, observations, points3d, depth_rows, keys, obs_key, min_total, max_pairs_per_image, on_shortage
            ),
            "depth-scale",
        )
        rows = attach(depth_rows, info.select(*keys, "scale"), keys).where(F.col("scale").isNotNull())
        rows = D.rescale_depth(rows, F.col("scale"))
    else:
        rows = depth_rows.withColumn("scale", F.lit(1.0))

    limits = {
        "max_depth": F.lit(float(max_depth)) * F.col("scale"),
        "min_depth": F.lit(D.NEAREST) * F.col("scale"),
        "conf_pct": conf_pct,
    }
    # Points per frame, counted in the row arrays, and how many of them a frame may keep.
    found = D.valid_rows(rows, frames.select(*keys, "frame"), by=keys, **limits)
    found = found.groupBy(*keys, "frame").agg(F.sum(F.size("_p")).alias("_n")).where("_n > 0")
    share = images.groupBy(*keys).agg(F.count("*").alias("_images"))
    per_frame = F.lit((1 << 62)).cast("long")
    if oversample is not None:
        per_frame = F.greatest(F.floor(F.lit(oversample * target) / F.col("_images")), F.lit(1)).cast("long")
    sizes = attach(found, share, keys).select(*keys, "frame", "_n", per_frame.alias("_k"))
    sizes = stage(sizes, "frame-sizes")
    frames = frames.join(sizes, [*keys, "frame"])
    px = D.backproject(rows, frames, by=keys, color_rows=color_rows, carry=("image_id", "_n", "_k"), **limits)
    px = px.select(*keys, "frame", "_n", "_k", _place("image_id").alias("point_id"), *_coordinates(px))
    cloud = sample_exact(px, "_k", "point_id", 0, [*keys, "frame"], sizes=sizes, n="_n")
    cloud = stage(cloud.drop("_n", "_k"), "cloud")

    cloud = stage(sigma_clip(cloud, sigma, by=keys), "clipped") if sigma > 0 else cloud
    bounds = bounds_rows(cloud, keys, info, aligned=rescale)
    thinned = voxel_to_target(cloud.drop("frame"), target, keys)
    kept = sizes.select(*keys, "frame", F.col("_n").alias("n_found"), F.least("_n", "_k").alias("n_kept"))
    return FusedDepth(thinned, bounds, kept)


def _place(image: str) -> Column:
    """Position of a pixel in the capture: image, then row, then column. Larger rasters than 65,536 a side raise."""
    row = F.shiftleft(F.col(image).cast("long"), 16).bitwiseOR(F.col("v").cast("long"))
    place = F.shiftleft(row, 16).bitwiseOR(F.col("u").cast("long"))
    large = F.raise_error(F.lit(f"a raster has {_SIDE} or more pixels a side")).cast("long")
    return F.when((F.col("u") < _SIDE) & (F.col("v") < _SIDE), place).otherwise(large)


def _coordinates(px: DataFrame) -> list[Column]:
    """Coordinates as 32-bit floats, and the colours if there are any."""
    colour = [F.col(c) for c in ("red", "green", "blue") if c in px.columns]
    return [*[F.col(a).cast("float").alias(a) for a in AXES], *colour]


def bounds_rows(
    cloud: DataFrame, by: str | Sequence[str] | None = None, info: DataFrame | None = None, aligned: bool = True
) -> DataFrame:
    """Bounds document: axis-aligned box, scale factor, whether it was applied, and its diagnostics."""
    keys = as_keys(by)
    box = cloud.where(finite(*AXES)).groupBy(*keys).agg(
        *[f(F.col(a).cast("double")).alias(f"{a}_{e}") for a in AXES for e, f in (("min", F.min), ("max", F.max))]
    )
    if info is None:
        return box.withColumns({"scale_factor": F.lit(1.0), "scale_aligned": F.lit(aligned)})
    names = ("n_pairs", "n_images", "p25", "median", "p75", "std")
    joined = attach(info, box, keys, "left")  # a capture without points is listed too
    return joined.select(
        *box.columns,
        F.col("scale").alias("scale_factor"),
        F.lit(aligned).alias("scale_aligned"),
        F.struct(*names).alias("scale_info"),
    )


def build_init_cloud(
    depth_rows: DataFrame,
    frames: DataFrame,
    color_rows: DataFrame | None = None,
    by: str | Sequence[str] | None = None,
    step: int = D.STRIDE,
    conf_threshold: float = D.MIN_CONF,
    max_points: int | None = MERGED_CAP,
    seed: int = 0,
) -> DataFrame:
    """Merged coloured cloud of per-frame depth and confidence maps.

    ``frames`` has ``frame, image_id, width, height``, intrinsics for that size and a
    ``c2w`` pose; the intrinsics are rescaled to the raster, and so are colours of another
    size. More than ``max_points`` points (None: no limit) are cut down to an exact sample.
    """
    keys = as_keys(by)
    size = depth_rows.groupBy(*keys, "frame").agg(
        (F.max("v") + 1).alias("_rh"), F.max(F.size("depth")).alias("_rw")
    )
    size = stage(size, "raster-size")
    sized = scale_intrinsics(frames.join(size, [*keys, "frame"]), "_rw", "_rh")
    if color_rows is not None:
        wanted = size.withColumnsRenamed({"_rw": "width", "_rh": "height"})
        color_rows = resample(color_rows.select(*keys, "frame", "v", "rgb"), wanted, keys, "rgb")
    cloud = D.depth_to_points(depth_rows, sized, keys, color_rows, step, conf_threshold, carry=("image_id",))
    cloud = cloud.select(*keys, _place("image_id").alias("point_id"), *_coordinates(cloud))
    return cloud if max_points is None else sample_exact(cloud, max_points, "point_id", seed, keys)


@dataclass
class MaskJob:
    """Result of a mask job: final mask rows, and the coverage of each image before erosion."""

    masks: DataFrame
    coverage: DataFrame


def mask_job(
    probabilities: DataFrame,
    images: DataFrame,
    by: str | Sequence[str] | None = None,
    threshold: float = M.MASK_THRESHOLD,
    erosion: int = M.EROSION_SIZE,
    scored: bool = True,
) -> MaskJob:
    """Threshold candidate masks, pick the best (or unite unscored ones), erode, and fill in blanks."""
    keys = as_keys(by)
    bits = M.binarize(probabilities, threshold)
    chosen = M.best_mask(bits, keys) if scored else M.union_mask(bits, keys)
    chosen = stage(chosen.select(*keys, "image", F.col("v").cast("long").alias("v"), "bits"), "masks")
    eroded = M.erode(chosen, erosion, keys)
    return MaskJob(M.fill_blank_masks(images, eroded, keys), M.mask_coverage(chosen, keys))


def score_frames(
    df: DataFrame,
    make_predict_fn: Callable,
    inputs: Sequence[str],
    return_type,
    output: str = "prediction",
    batch_size: int = 32,
    input_tensor_shapes=None,
) -> DataFrame:
    """Add the output of a user model, run on fixed-size batches.

    ``make_predict_fn`` loads the model and returns the function for one batch; it
    runs once per Python worker.
    """
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(
        make_predict_fn, return_type=return_type, batch_size=batch_size, input_tensor_shapes=input_tensor_shapes
    )
    cols: list[Column] = [F.col(c) for c in inputs]
    return df.withColumn(output, udf(*cols))
