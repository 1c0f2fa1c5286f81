"""Raster files in NumPy's format: source and per-frame sink."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from scanloom.sources.chunks import write_chunks
from scanloom.sources.files import list_inputs, open_input
from scanloom.sources.splits import Piece, Pieces, pack

_ROWS_PER_BATCH_BYTES = 4 << 20


def _array_header(f) -> tuple[tuple[int, int], np.dtype, int]:
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(f)
    if len(shape) != 2 or fortran or dtype.kind not in "fiu":
        raise ValueError(f"expected a row-major numeric raster with two axes, got {shape} {dtype}")
    return shape, dtype, f.tell()


class _NpyReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options = options
        self.columns = [f.name for f in schema.fields]
        self.value = options.get("column", "depth")

    def partitions(self) -> list[Pieces]:
        try:
            files = list_inputs(self.options["path"], ".npy")
        except FileNotFoundError:
            files = []
        return pack(files, self.options)

    def read(self, split: Pieces) -> Iterator[pa.RecordBatch]:
        for piece in split.pieces:
            yield from self._rows(piece)

    def _rows(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        frame = piece.path.rsplit("/", 1)[-1][: -len(".npy")]
        with open_input(piece.path) as f:
            (height, width), dtype, start = _array_header(f)
            first, last = piece.share(height)
            f.seek(start + first * width * dtype.itemsize)
            step = max(1, _ROWS_PER_BATCH_BYTES // max(1, width * dtype.itemsize))
            for v in range(first, last, step):
                n = min(step, last - v)
                raw = f.read(n * width * dtype.itemsize)
                values = np.frombuffer(raw, dtype=dtype, count=n * width).astype(np.float32)
                offsets = np.arange(n + 1, dtype=np.int32) * width
                made = {
                    "path": pa.array([piece.path] * n, pa.string()),
                    "frame": pa.array([frame] * n, pa.string()),
                    "v": pa.array(np.arange(v, v + n, dtype=np.int64)),
                    self.value: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.float32())),
                }
                yield pa.RecordBatch.from_arrays([made[c] for c in self.columns], self.columns)


class NpyRasterSource(DataSource):
    """``spark.read.format("npy_raster").load(dir)`` gives ``path, frame, v, depth array<float>``.

    ``frame`` is the file stem, which captures may share; ``path`` tells them apart.
    A missing folder gives no rows. Option ``column`` renames the values (``conf`` for
    confidence maps); small rasters share a split, large ones are cut into row ranges
    (options ``splitBytes``, ``minPartitions``).
    """

    @classmethod
    def name(cls) -> str:
        return "npy_raster"

    def schema(self) -> T.StructType:
        return T.StructType(
            [
                T.StructField("path", T.StringType()),
                T.StructField("frame", T.StringType()),
                T.StructField("v", T.LongType()),
                T.StructField(self.options.get("column", "depth"), T.ArrayType(T.FloatType())),
            ]
        )

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _NpyReader(dict(self.options), schema)


def write_rasters(rows: DataFrame, path: str, column: str = "depth", by: Sequence[str] = ()) -> DataFrame:
    """Write the rows of each frame to ``<frame>.npy`` as 32-bit floats.

    ``by`` columns become folders. Evaluating the result, one row per file, does the
    writing; it fails if a frame lacks a row or its rows differ in width.
    """
    keys = [*by, "frame"]
    size = rows.groupBy(*keys).agg(
        (F.max("v") + 1).alias("h"),
        F.count("*").alias("n"),
        F.max(F.size(column)).cast("long").alias("w"),
        F.min(F.size(column)).alias("w_min"),
    )
    folder = [F.lit(path.rstrip("/"))] + [F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in by]
    file = F.concat_ws("/", *folder, F.concat(F.col("frame").cast("string"), F.lit(".npy"))).alias("path")
    bad = (F.col("n") != F.col("h")) | (F.col("w") != F.col("w_min"))
    height = F.when(bad, F.raise_error(F.lit("a raster has missing or uneven rows")).cast("long")).otherwise(F.col("h"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = []
            for h, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out = io.BytesIO()
                np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (h, w)})
                contents.append(out.getvalue())
            seq = pa.array([-1] * len(contents), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), seq, pa.array(contents, pa.binary())], ["path", "seq", "content"]
            )

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = [np.asarray(r.values, dtype="<f4").tobytes() for r in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(contents, pa.binary())], ["path", "seq", "content"]
            )

    chunk = "path string, seq long, content binary"
    head = size.select(file, height.alias("h"), "w").mapInArrow(heads, chunk)
    values = F.col(column).cast("array<float>")
    body = rows.select(file, F.col("v").cast("long").alias("seq"), values.alias("values")).mapInArrow(bodies, chunk)
    return write_chunks(head.unionByName(body))
