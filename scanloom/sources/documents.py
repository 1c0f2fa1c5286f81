"""JSON documents: frame documents and bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.plans.stage import as_keys, attach, stage
from scanloom.sources.chunks import write_chunks

_SCALE_INFO = (
    "scale_info struct<n_pairs: bigint, n_images: bigint, p25: double, median: double, p75: double, std: double>"
)
BOUNDS_SCHEMA = (
    "x_min double, x_max double, y_min double, y_max double, z_min double, z_max double, "
    "scale_factor_da3_to_colmap double, scale_aligned boolean, " + _SCALE_INFO
)
_FRAME_FIELDS = (
    "file_path",
    "transform_matrix",
    "fl_x",
    "fl_y",
    "cx",
    "cy",
    "w",
    "h",
    "depth_file_path",
    "k1",
    "k2",
    "p1",
    "p2",
)


def transforms_lines(
    frames: DataFrame,
    header: DataFrame,
    by: str | Sequence[str] | None = None,
    ply_file_path: str | None = None,
) -> DataFrame:
    """The frame documents as text lines: ``by, part, name, value``.

    Ordered by ``part`` and ``name`` the lines of a group are one JSON document:
    its opening with the header values, one line per frame sorted by name, and its
    end. No document is ever assembled in memory. Null fields are left out.
    """
    keys = as_keys(by)
    fields = [c for c in _FRAME_FIELDS if c in frames.columns]
    body = frames.select(*keys, "name", F.to_json(F.struct(*fields)).alias("_json"))
    first = stage(frames.groupBy(*keys).agg(F.min("name").alias("_first")), "first-frame")
    comma = F.when(F.col("name") == F.col("_first"), F.lit("")).otherwise(F.lit(","))
    body = attach(body, first, keys).select(
        *keys, F.lit(1).alias("part"), "name", F.concat(comma, "_json").alias("value")
    )
    extra = [F.lit(ply_file_path).alias("ply_file_path")] if ply_file_path else []
    head_fields = [c for c in header.columns if c not in keys]
    opening = F.to_json(F.struct(*head_fields, *extra))
    # Only groups that have frames get a document.
    heads = attach(header, first.select(*keys), keys) if keys else header
    head = heads.select(
        *keys,
        F.lit(0).alias("part"),
        F.lit("").alias("name"),
        F.concat(F.regexp_replace(opening, r"\}$", ""), F.lit(',"frames":[')).alias("value"),
    )
    tail = heads.select(*keys, F.lit(2).alias("part"), F.lit("").alias("name"), F.lit("]}").alias("value"))
    return head.unionByName(body).unionByName(tail)


def write_transforms(
    frames: DataFrame,
    header: DataFrame,
    path: str,
    by: str | Sequence[str] | None = None,
    ply_file_path: str | None = None,
    mode: str = "overwrite",
) -> None:
    """Write the documents, one folder per group.

    The part files of a folder, joined in name order, are the JSON document; a
    group of ordinary size is one or two files. Raises if there is no frame.
    """
    if frames.isEmpty():
        raise ValueError("no valid frames")
    keys = as_keys(by)
    order = [*keys, "part", "name"]
    lines = transforms_lines(frames, header, keys, ply_file_path)
    lines = lines.repartitionByRange(*order).sortWithinPartitions(*order).drop("part", "name")
    writer = lines.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).text(path)


def document_path(root: str, by: str | Sequence[str] | None, name: str) -> Column:
    """``root/key=value/../name``, with values escaped as in a folder of a partitioned table."""
    folders = []
    for k in as_keys(by):
        value = F.replace(F.url_encode(F.col(k).cast("string")), F.lit("+"), F.lit("%20"))
        value = F.when(F.col(k).cast("string") != "", value)
        folders.append(F.concat(F.lit(f"{k}="), F.coalesce(value, F.lit("__HIVE_DEFAULT_PARTITION__"))))
    return F.concat_ws("/", F.lit(root.rstrip("/")), *folders, F.lit(name))


def write_transforms_files(
    frames: DataFrame,
    header: DataFrame,
    path: str,
    by: str | Sequence[str] | None = None,
    ply_file_path: str | None = None,
    name: str = "transforms.json",
) -> DataFrame:
    """Write each group's document as one JSON file; returns the groups with ``path`` and ``length`` of their file.

    The lines of a document are appended in order by the task of their group, a
    batch at a time; ``write_transforms`` spreads a group over tasks. Files of the
    same name are replaced, others stay. Raises if there is no frame.
    """
    keys = as_keys(by)
    lines = transforms_lines(frames, header, keys, ply_file_path).select(
        document_path(path, keys, name).alias("path"),
        F.struct("part", "name").alias("seq"),
        F.concat("value", F.lit("\n")).cast("binary").alias("content"),
    )
    written = stage(write_chunks(lines), "documents")
    if written.isEmpty():
        raise ValueError("no valid frames")
    return header.select(*keys, document_path(path, keys, name).alias("path")).join(written, "path")


def write_bounds(bounds: DataFrame, path: str, by: str | Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """Write bounds rows as JSON, in one folder per group."""
    keys = as_keys(by)
    out = bounds.withColumnRenamed("scale_factor", "scale_factor_da3_to_colmap")
    writer = out.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).json(path)


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOUNDS_SCHEMA).json(path, multiLine=True)
