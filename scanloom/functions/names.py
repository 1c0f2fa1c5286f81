"""File-name and tag functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Image extensions that count as frames, and the tag of each init cloud.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")
INIT_TAGS = {
    "da3_init.ply": "da3",
    "fused.ply": "mvs_full",
    "fused_sub.ply": "mvs_500k",
    "sparse_init.ply": "sparse",
}
NO_INIT_TAG = "noinit"

# Property names that mean the cloud has colour.
COLOUR_PROPERTIES = ("red", "r", "diffuse_red")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/\\]+)$", 1)


def extension(path: Column | str) -> Column:
    """Lower-case suffix with its dot, or an empty string. A leading dot is part of the name."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column | str) -> Column:
    """File name without folder and without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]+$", "")


def with_suffix(path: Column | str, suffix: str) -> Column:
    return F.concat(stem(path), F.lit(suffix))


def mask_names(name: Column | str) -> Column:
    """The two names a mask is saved under: ``<name>.png`` and ``<stem>.png``."""
    return F.array(F.concat(file_name(name), F.lit(".png")), with_suffix(name, ".png"))


def version_tag(init_file: Column | str) -> Column:
    """Short tag of the cloud a training run started from."""
    c = _col(init_file)
    out = None
    for name, tag in INIT_TAGS.items():
        out = F.when(c == name, tag) if out is None else out.when(c == name, tag)
    return out.otherwise(NO_INIT_TAG)


def capabilities_of(properties: Sequence[str]) -> dict[str, bool]:
    props = set(properties)
    return {
        "has_color": any(p in props for p in COLOUR_PROPERTIES),
        "has_normals": "nx" in props,
        "is_splat": "opacity" in props,
    }


def capabilities(df: DataFrame, properties: str | None = None) -> DataFrame | dict[str, bool]:
    """Colour, normal and splat flags.

    With ``properties`` naming an array column (one row per file) the flags are
    added as columns; without it they are read off the schema of ``df``.
    """
    if properties is None:
        return capabilities_of(df.columns)
    p = F.col(properties)
    return df.withColumns(
        {
            "has_color": F.arrays_overlap(p, F.array(*[F.lit(c) for c in COLOUR_PROPERTIES])),
            "has_normals": F.array_contains(p, "nx"),
            "is_splat": F.array_contains(p, "opacity"),
        }
    )
