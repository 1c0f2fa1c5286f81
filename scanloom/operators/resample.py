"""Resampling of raster rows to another size, smaller or larger, by a triangle filter.

The filter is as wide as a source or an output pixel, whichever is larger, so a
shrunken raster averages what it covers. It is separable: rows are resampled
where they are, then every row goes to the strips of output rows that it
touches, and a strip is finished from its rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, LongType, StructField, StructType

from scanloom.plans.ship import ship_package
from scanloom.plans.stage import as_keys, attach, stage

#: Output rows finished together.
STRIP = 32
_HALF = 0.5 + 1e-9  # sums within 1e-9 of a half count as one


def taps(size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """First source pixel and weights of each output pixel (a row per output pixel, padded with 0)."""
    ratio = size / wanted
    support = max(ratio, 1.0)
    centre = (np.arange(wanted) + 0.5) * ratio
    first = np.maximum(np.floor(centre - support + 0.5).astype(np.int64), 0)
    last = np.minimum(np.floor(centre + support + 0.5).astype(np.int64), size)
    source = first[:, None] + np.arange(int((last - first).max()))[None, :]
    weight = np.maximum(0.0, 1.0 - np.abs(source + 0.5 - centre[:, None]) / support)
    weight[source >= last[:, None]] = 0.0
    return first, weight / weight.sum(axis=1, keepdims=True)


def stretch(values: np.ndarray, wanted: int) -> np.ndarray:
    """The second axis of ``values`` (rows, pixels, channels) resampled to ``wanted`` pixels."""
    first, weight = taps(values.shape[1], wanted)
    out = np.zeros((values.shape[0], wanted, values.shape[2]))
    for k in range(weight.shape[1]):
        used = weight[:, k] > 0
        out[:, used] += values[:, first[used] + k] * weight[used, k][None, :, None]
    return out


def strip_rows(values: np.ndarray, rows: np.ndarray, height: int, wanted: int, start: int, stop: int):
    """Output rows ``start`` to ``stop`` from the source rows given; weights are normalised over the rows that are there."""
    first, weight = taps(height, wanted)
    kernel = np.zeros((stop - start, len(rows)))
    place = rows[None, :] - first[start:stop, None]
    inside = (place >= 0) & (place < weight.shape[1])
    kernel[inside] = np.take_along_axis(weight[start:stop], np.where(inside, place, 0), axis=1)[inside]
    total = kernel.sum(axis=1)
    out = np.full((stop - start, *values.shape[1:]), np.nan)
    some = total > 0
    missing = np.isnan(values)
    flat = np.where(missing, 0.0, values).reshape(len(rows), -1)
    out[some] = (kernel[some] @ flat / total[some, None]).reshape(-1, *values.shape[1:])
    if missing.any():  # a missing pixel is missing in all that it would weigh in
        touched = (kernel[some] > 0).astype(float) @ missing.reshape(len(rows), -1) > 0
        out[some] = np.where(touched.reshape(-1, *values.shape[1:]), np.nan, out[some])
    return out, some


def _levels(dtype) -> tuple[int, bool]:
    """Channels are one level deeper; whether values are whole numbers."""
    inner, depth = dtype, 0
    while isinstance(inner, ArrayType):
        inner, depth = inner.elementType, depth + 1
    if depth not in (1, 2):
        raise ValueError("a raster row is an array of numbers or of channels")
    return depth, isinstance(inner, IntegralType)


def _whole(values: np.ndarray, rounded: bool) -> np.ndarray:
    return np.floor(values + _HALF) if rounded else values


def _values(column: pa.ListArray, depth: int, width: int) -> np.ndarray:
    """Rows of equal width as (rows, pixels, channels); nulls become NaN."""
    if depth == 1:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width, 1)
    pixels = column.flatten()
    if pixels.null_count:  # a pixel without channels
        channels = max((len(p) for p in pixels.to_pylist() if p is not None), default=1)
        flat = [p if p is not None else [None] * channels for p in pixels.to_pylist()]
        return np.array(flat, np.float64).reshape(len(column), width, channels)
    flat = pixels.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), width, -1)


def _lists(values: np.ndarray, kind: pa.DataType, depth: int) -> pa.Array:
    """(rows, pixels, channels) as nested lists of the raster's type; NaN becomes null in whole numbers."""
    inner = kind.value_type if depth == 1 else kind.value_type.value_type
    flat = values.reshape(-1)
    if pa.types.is_integer(inner):
        flat = pa.array(np.where(np.isnan(flat), 0, flat).astype(np.int64), mask=np.isnan(flat)).cast(inner)
    else:
        flat = pa.array(flat).cast(inner)
    n, width, channels = values.shape
    if depth == 2:
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width * channels + 1, channels), pa.int32()), flat)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), flat)


def _across(column: str, depth: int, rounded: bool):
    """Resamples rows to the width in ``_tw``, in runs of equal sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            widths = np.stack([batch.column(c).to_numpy() for c in ("_w", "_tw")], axis=1) if batch.num_rows else []
            edges = np.flatnonzero((np.diff(widths, axis=0) != 0).any(axis=1)) + 1 if len(widths) else []
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                width, wanted = (int(x) for x in widths[a])
                row = _values(piece.column(at), depth, width)
                made = _whole(stretch(row, wanted), rounded)
                arrays = list(piece.columns)
                arrays[at] = _lists(made, piece.column(at).type, depth)
                yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return run


def _down(column: str, keys: list[str], depth: int, rounded: bool):
    """Finishes one strip of one raster."""

    def run(strip: pa.Table) -> pa.Table:
        height, wanted, width = (strip.column(c)[0].as_py() for c in ("_h", "_th", "_tw"))
        start = strip.column("_strip")[0].as_py() * STRIP
        stop = min(start + STRIP, wanted)
        rows = strip.column("v").to_numpy().astype(np.int64)
        data = strip.column(column).combine_chunks()
        values = _values(data, depth, width)
        out, some = strip_rows(values, rows, height, wanted, start, stop)
        out, v = _whole(out[some], rounded), np.arange(start, stop)[some]
        named = {k: strip.column(k).take(pa.array(np.zeros(len(v), np.int64))) for k in keys}
        return pa.table({**named, "v": pa.array(v, pa.int64()), column: _lists(out, data.type, depth)})

    return run


def resample(
    rows: DataFrame,
    sizes: DataFrame | tuple[int, int],
    by: str | Sequence[str] | None = None,
    column: str = "depth",
) -> DataFrame:
    """``rows`` (``frame, v``, an array of numbers or of channels) at another size.

    ``sizes`` is (width, height) for all rasters, or a table of ``frame, width,
    height`` with the keys of ``by``; rasters without a size there drop out.
    Pixel centres lie at halves. Whole numbers are rounded half up after each of
    the two passes, as 8-bit images are. Rasters that have their size already
    pass through unread.

    A missing pixel (null or NaN) is missing wherever it would weigh in; rows
    that are absent are left out of the weights, and an output row without any
    is absent too. Rows of one raster must be equally long.
    """
    keys = as_keys(by)
    on = [*keys, "frame"]
    depth, rounded = _levels(rows.schema[column].dataType)
    rows = rows.withColumn(column, F.col(column).cast(rows.schema[column].dataType.simpleString()))  # elements may be null
    size = rows.groupBy(*on).agg(
        (F.max("v") + 1).cast("int").alias("_h"), F.max(F.size(column)).alias("_w"), F.min(F.size(column)).alias("_least")
    )
    if isinstance(sizes, tuple):
        width, height = sizes
        size = size.withColumns({"_tw": F.lit(int(width)), "_th": F.lit(int(height))})
    else:
        wanted = sizes.select(*on, F.col("width").cast("int").alias("_tw"), F.col("height").cast("int").alias("_th"))
        size = attach(size, wanted, on)
    uneven = F.raise_error(F.lit("raster rows of one frame differ in width")).cast("int")
    size = size.withColumn("_w", F.when(F.col("_least") == F.col("_w"), F.col("_w")).otherwise(uneven)).drop("_least")
    data = attach(rows.select(*on, F.col("v").cast("long").alias("v"), column), stage(size, "raster-size"), on)
    fits = (F.col("_w") == F.col("_tw")) & (F.col("_h") == F.col("_th"))
    same = data.where(fits).select(*on, "v", column)

    ship_package(rows.sparkSession)
    wide = data.where(~fits)
    wide = wide.mapInArrow(_across(column, depth, rounded), wide.schema)
    # Output rows whose weights reach the row, from the centres that lie within the support.
    reach = "greatest(_h / _th, 1D)"
    low = F.expr(f"CAST(greatest(floor((v + 0.5D - {reach}) * _th / _h - 0.5D), 0) AS INT) DIV {STRIP}")
    high = F.expr(f"CAST(least(ceil((v + 0.5D + {reach}) * _th / _h - 0.5D), _th - 1) AS INT) DIV {STRIP}")
    strips = wide.withColumn("_strip", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    fields = {f.name: f for f in rows.schema.fields}
    schema = StructType([*[fields[k] for k in on], StructField("v", LongType()), fields[column]])
    made = strips.groupBy(*on, "_strip").applyInArrow(_down(column, on, depth, rounded), schema)
    return same.union(made)
