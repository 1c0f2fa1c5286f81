"""Colour rasters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.names import stem


def read_color_rows(spark: SparkSession, path: str, on_invalid: str = "error") -> DataFrame:
    """Raster rows of every image below the folder: ``path, frame, v, rgb array<array<short>>``.

    Spark's image source decodes the files; its bytes are blue-green-red. ``path`` tells
    apart images of several captures that share a name. A file that is no image raises,
    or is left out with ``on_invalid="skip"``.
    """
    if on_invalid not in ("error", "skip"):
        raise ValueError(f"unknown on_invalid {on_invalid!r}")
    images = spark.read.format("image").option("dropInvalid", str(on_invalid == "skip").lower()).load(path)
    images = images.select(
        F.col("image.origin").alias("path"),
        stem("image.origin").alias("frame"),
        "image.height",
        "image.width",
        "image.nChannels",
        "image.data",
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image in batch.to_pylist():
                h, w, c = image["height"], image["width"], image["nChannels"]
                if h < 0 or w < 0:
                    raise ValueError(f"{image['path']}: not an image that can be decoded")
                px = np.frombuffer(image["data"], dtype=np.uint8).reshape(h, w, c)
                rgb = np.repeat(px, 3, axis=2) if c == 1 else px[:, :, 2::-1]
                values = pa.array(np.ascontiguousarray(rgb).reshape(-1).astype(np.int16))
                pixel = pa.ListArray.from_arrays(pa.array(np.arange(h * w + 1, dtype=np.int32) * 3), values)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(h + 1, dtype=np.int32) * w), pixel)
                origin = pa.array([image["path"]] * h, pa.string())
                frame = pa.array([image["frame"]] * h, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [origin, frame, pa.array(np.arange(h, dtype=np.int64)), rows], ["path", "frame", "v", "rgb"]
                )

    return images.mapInArrow(split, "path string, frame string, v long, rgb array<array<short>>")
