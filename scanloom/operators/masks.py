"""Mask rasters: ``image, candidate, score, v, bits array``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.frames import missing_outputs
from scanloom.plans.stage import as_keys

# Mask threshold and erosion window of the mask job.
MASK_THRESHOLD = 0.5
EROSION_SIZE = 3
_ROWS_PER_BLOCK = 256


def binarize(masks: DataFrame, threshold: float = MASK_THRESHOLD) -> DataFrame:
    """Probabilities to booleans: strictly above the threshold."""
    return masks.withColumn("bits", F.transform("bits", lambda p: (p > float(threshold)) & ~F.isnan(p)))


def best_mask(masks: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Rows of the highest-scoring candidate of each image, the lowest index on a tie.

    Scores may cover more candidates than there are masks; if the winner has no
    mask, the first candidate is used.
    """
    image = [*as_keys(by), "image"]
    best = masks.groupBy(*image).agg(
        F.max_by("candidate", F.struct("score", (-F.col("candidate")).alias("c"))).alias("candidate")
    )
    return masks.join(best, [*image, "candidate"], "left_semi")


def pick_mask(masks: DataFrame, scores: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """As :func:`best_mask` with the scores in their own table ``image, candidate, score``."""
    image = [*as_keys(by), "image"]
    best = scores.groupBy(*image).agg(
        F.max_by("candidate", F.struct("score", (-F.col("candidate")).alias("c"))).alias("_best")
    )
    have = masks.groupBy(*image, "candidate").agg(F.lit(True).alias("_has"))
    first = have.groupBy(*image).agg(F.min("candidate").alias("_first"))
    best = best.join(first, image)
    there = have.select(*image, F.col("candidate").alias("_best"), "_has")
    best = best.join(there, [*image, "_best"], "left")
    best = best.select(*image, F.when(F.col("_has"), F.col("_best")).otherwise(F.col("_first")).alias("candidate"))
    return masks.join(best, [*image, "candidate"], "left_semi")


def union_mask(masks: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Union of all boolean candidates of an image.

    The OR runs per pixel with map-side combine, so any number of candidates costs
    no task more than its share; a result row is bounded by the raster width.
    """
    row = [*as_keys(by), "image", "v"]
    px = masks.select(*row, F.posexplode("bits").alias("u", "bit"))
    px = px.groupBy(*row, "u").agg(F.bool_or("bit").alias("bit"))
    packed = F.array_sort(F.collect_list(F.struct("u", "bit")))
    return px.groupBy(*row).agg(packed.alias("_p")).select(*row, F.col("_p")["bit"].alias("bits"))


def mask_coverage(masks: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Percentage of set pixels per image."""
    on = F.sum(F.size(F.filter("bits", lambda b: b)))
    all_px = F.sum(F.size("bits"))
    return masks.groupBy(*as_keys(by), "image").agg(
        on.alias("n_set"), all_px.alias("n_pixels"), F.try_divide(on * 100.0, all_px).alias("coverage_pct")
    )


def erode(masks: DataFrame, size: int = EROSION_SIZE, by: str | Sequence[str] | None = None) -> DataFrame:
    """Minimum filter with a ``size`` x ``size`` window; at the border only pixels inside count.

    Along a row the minimum is taken within the array. Across rows it is a window
    over blocks of rows; each block also gets the few rows next to it, so an image
    of any height is spread over many tasks.
    """
    if size < 1 or size % 2 == 0:
        raise ValueError("the window of an erosion has an odd size")
    if size == 1:
        return masks
    keys = as_keys(by)
    reach = size // 2
    columns = list(masks.columns)
    flat = masks.withColumn(
        "_h",
        F.expr(
            f"""transform(bits, (b, i) ->
                NOT exists(slice(bits, greatest(i - {reach}, 0) + 1,
                                 least(i + {reach}, size(bits) - 1) - greatest(i - {reach}, 0) + 1), x -> NOT x))"""
        ),
    )
    block = f"floor(({{}}) / {_ROWS_PER_BLOCK})"
    blocks = F.expr(
        f"sequence(CAST({block.format(f'greatest(v - {reach}, 0)')} AS BIGINT), "
        f"CAST({block.format(f'v + {reach}')} AS BIGINT))"
    )
    group = [*keys, "image", *[c for c in ("candidate",) if c in columns]]
    spread = flat.withColumn("_block", F.explode(blocks))
    w = Window.partitionBy(*group, "_block").orderBy("v").rangeBetween(-reach, reach)
    near = F.collect_list("_h").over(w)  # at most ``size`` rows
    eroded = F.expr("reduce(slice(_near, 2, size(_near)), _near[0], (acc, r) -> zip_with(acc, r, (a, b) -> a AND b))")
    out = spread.withColumn("_near", near).where(F.col("_block") == F.expr(block.format("v")))
    return out.withColumn("bits", eroded).select(*columns)


def fill_blank_masks(
    images: DataFrame, masks: DataFrame, by: str | Sequence[str] | None = None, name: str = "image"
) -> DataFrame:
    """Mask rows for every image: an all-false raster of the image size where none exists.

    ``images`` has ``name``, ``width``, ``height``; a mask exists if the image's stem has one.
    """
    keys = as_keys(by)
    have = masks.select(*keys, F.concat(F.col("image"), F.lit(".png")).alias(name)).distinct()
    blank = missing_outputs(images, have, ".png", keys, name)
    blank = blank.withColumn("image", F.regexp_replace("output", r"\.png$", ""))
    rows = blank.select(
        *keys,
        "image",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1)).alias("v"),
        F.array_repeat(F.lit(False), F.col("width").cast("int")).alias("bits"),
    )
    return masks.select(*keys, "image", F.col("v").cast("long").alias("v"), "bits").unionByName(rows)
