"""Queries over file catalogues: listings, latest runs, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.names import IMAGE_EXTENSIONS, extension, file_name
from scanloom.plans.stage import as_keys


def file_catalog(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """Path, length and modification time of every file below the folders; contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(paths if isinstance(paths, str) else list(paths)).select(
        "path", "length", "modificationTime"
    )


def list_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    extensions: Sequence[str] = IMAGE_EXTENSIONS,
    require: bool = True,
) -> DataFrame:
    """Files with one of the extensions, in any case, sorted by name. Empty listings raise unless ``require`` is off."""
    files = with_extension(file_catalog(spark, paths).withColumn("name", file_name("path")), extensions)
    if require and files.isEmpty():
        raise FileNotFoundError(f"no file with extension {', '.join(extensions)} in {paths}")
    return files.orderBy("name", "path")


def with_extension(files: DataFrame, extensions: Sequence[str] = IMAGE_EXTENSIONS, name: str = "name") -> DataFrame:
    """Rows of a listing whose name has one of the extensions, in any case."""
    return files.where(extension(name).isin([e.lower() for e in extensions]))


def best_model(
    models: DataFrame, files: DataFrame, by: str | Sequence[str] | None = None
) -> DataFrame:
    """The model with the largest point file; a model without one counts as size 0, ties go to the lowest name.

    ``models`` lists ``model``; ``files`` holds ``model, length`` of the point files.
    """
    keys = as_keys(by)
    sizes = files.groupBy(*keys, "model").agg(F.max("length").alias("length"))
    joined = models.select(*keys, "model").join(sizes, [*keys, "model"], "left")
    joined = joined.withColumn("length", F.coalesce("length", F.lit(0).cast("long")))
    top = joined.groupBy(*keys, "length").agg(F.min("model").alias("model"))
    return top.groupBy(*keys).agg(F.max_by("model", "length").alias("model"), F.max("length").alias("length"))


def next_version(files: DataFrame, by: str | Sequence[str] | None = None, name: str = "name") -> DataFrame:
    """One more than the highest N in ``splat_v<N>*.ply``; 1 when a group has none."""
    digits = F.regexp_extract(file_name(name), r"^splat_v(\d+).*\.ply$", 1)
    number = F.when(digits != "", digits.cast("long"))
    return files.groupBy(*as_keys(by)).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_version"))


def latest_incomplete(
    checkpoints: DataFrame, iterations: int, by: str | Sequence[str] | None = None, tie: str = "step"
) -> DataFrame:
    """The most recently saved run that has not reached its last iteration.

    ``checkpoints`` holds ``run, step, mtime``. The newest checkpoint of a run
    decides about it; equal times are ordered by ``tie``, then by run, highest first.
    """
    keys = as_keys(by)
    newest = checkpoints.groupBy(*keys, "run").agg(
        F.max(F.struct("mtime", tie, *([] if tie == "step" else ["step"]))).alias("_last")
    )
    open_runs = newest.select(*keys, "run", "_last.mtime", "_last.step").where(F.col("step") < iterations - 1)
    pick = open_runs.groupBy(*keys).agg(F.max(F.struct("mtime", "run", "step")).alias("_r"))
    return pick.where(F.col("_r").isNotNull()).select(*keys, "_r.run", "_r.step", "_r.mtime")


def checkpoints(files: DataFrame, path: str = "path") -> DataFrame:
    """Files named ``step-<n>.ckpt`` with their ``run``, the folder they are in, and their ``step``."""
    name = r"^(.*)/step-(\d+)\.ckpt$"
    found = files.where(F.col(path).rlike(name))
    return found.withColumns(
        {"run": F.regexp_extract(path, name, 1), "step": F.regexp_extract(path, name, 2).cast("long")}
    )


def latest_file(
    files: DataFrame,
    pattern: str,
    fallback: str,
    by: str | Sequence[str] | None = None,
    path: str = "path",
    mtime: str = "mtime",
) -> DataFrame:
    """Newest file matching ``pattern``, or ``fallback`` when a group has no match; both are regular expressions."""
    keys = as_keys(by)
    newest = F.struct(F.col(mtime).alias("mtime"), F.col(path).alias("path"))
    got = files.groupBy(*keys).agg(
        F.coalesce(
            F.max(F.when(F.col(path).rlike(pattern), newest)), F.max(F.when(F.col(path).rlike(fallback), newest))
        ).alias("_f")
    )
    return got.where(F.col("_f").isNotNull()).select(*keys, "_f.path", "_f.mtime")
