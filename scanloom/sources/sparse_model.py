"""Binary sparse-model tables: cameras, images, observations, 3D points.

Records have variable length, so a file is read as one stream in bounded chunks.
Image files, whose keypoints make up nearly all bytes, are also cut into ranges: a
task walks the record heads, skips the keypoints of records outside its range, and
reads those inside.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scanloom.sources.files import CHUNK_BYTES, SPLIT_BYTES, list_inputs, open_input
from scanloom.sources.splits import shared_bytes

# Number of camera parameters for each model id of the public format.
PARAM_COUNTS = {0: 3, 1: 4, 2: 4, 3: 5, 4: 8, 5: 8, 6: 12, 7: 5, 8: 4, 9: 5, 10: 12}

SCHEMAS = {
    "cameras": "path string, camera_id long, model_id int, width long, height long, params array<double>",
    "images": "path string, image_idx long, image_id long, qvec array<double>, tvec array<double>, "
    "camera_id long, name string",
    "observations": "path string, image_id long, idx long, x double, y double, point3d_id long",
    "points3d": "path string, point3d_id long, x double, y double, z double, r short, g short, b short",
}
FILES = {
    "cameras": "cameras.bin",
    "images": "images.bin",
    "observations": "images.bin",
    "points3d": "points3D.bin",
}
_ARROW = {
    "string": pa.string(),
    "long": pa.int64(),
    "int": pa.int32(),
    "short": pa.int16(),
    "double": pa.float64(),
    "array<double>": pa.list_(pa.float64()),
}
_BATCH = 65_536
_HEAD_BYTES = 4096
_KEYPOINT = np.dtype([("x", "<f8"), ("y", "<f8"), ("p", "<i8")])


class _Stream:
    """Sequential reads over a file, buffered, with cheap skips over long payloads."""

    def __init__(self, f, size: int, where: str, chunk: int = CHUNK_BYTES):
        self.f, self.size, self.where, self.chunk = f, size, where, chunk
        self.buf, self.at, self.base = b"", 0, 0

    @property
    def offset(self) -> int:
        return self.base + self.at

    def take(self, n: int) -> bytes:
        if len(self.buf) - self.at < n:
            rest = self.buf[self.at :]
            more = self.f.read(max(n - len(rest), self.chunk))
            self.base += self.at
            self.buf, self.at = rest + more, 0
            if len(self.buf) < n:
                raise ValueError(f"{self.where}: file ends inside a record")
        out = self.buf[self.at : self.at + n]
        self.at += n
        return out

    def unpack(self, fmt: str) -> tuple:
        return struct.unpack(fmt, self.take(struct.calcsize(fmt)))

    def text(self) -> str:
        out = b""
        while True:
            out += self.take(1)  # at least one more byte is in the buffer then
            end = self.buf.find(b"\0", self.at)
            if out[-1:] == b"\0":
                return out[:-1].decode("utf-8", errors="replace")
            out += self.take((end if end >= 0 else len(self.buf)) - self.at)

    def skip(self, n: int) -> None:
        if self.offset + n > self.size:
            raise ValueError(f"{self.where}: file ends inside a record")
        if self.at + n <= len(self.buf):
            self.at += n
            return
        target = self.offset + n
        self.f.seek(target)
        self.buf, self.at, self.base = b"", 0, target


def _signed(value: int, where: str) -> int:
    if value > 2**63 - 1:
        raise ValueError(f"{where}: id {value} exceeds a signed 64-bit integer")
    return value


def _cameras(s: _Stream, part: _Part) -> Iterator[tuple]:
    (count,) = s.unpack("<Q")
    for _ in range(count):
        camera, model, width, height = s.unpack("<IiQQ")
        if model not in PARAM_COUNTS:
            raise ValueError(f"{s.where}: unknown camera model {model}")
        params = list(s.unpack(f"<{PARAM_COUNTS[model]}d"))
        yield s.where, camera, model, _signed(width, s.where), _signed(height, s.where), params


def _image_heads(s: _Stream, part: _Part | None = None) -> Iterator[tuple]:
    """Heads of the records of a part, or of all; the caller takes or skips what follows a head."""
    (count,) = s.unpack("<Q")
    first = 0
    if part is not None:
        first, count = part.index, part.index + part.count
        s.skip(part.first - s.offset)
    for i in range(first, count):
        at = s.offset
        head = s.unpack("<I4d3dI")
        name = s.text()
        (n,) = s.unpack("<Q")
        yield i, at, head, name, n


def _images(s: _Stream, part: _Part) -> Iterator[tuple]:
    for i, _, head, name, n in _image_heads(s, part):
        s.skip(24 * n)
        yield s.where, i, head[0], list(head[1:5]), list(head[5:8]), head[8], name


def _points3d(s: _Stream, part: _Part) -> Iterator[tuple]:
    (count,) = s.unpack("<Q")
    for _ in range(count):
        pid, x, y, z, r, g, b, _, n = s.unpack("<Q3d3BdQ")
        s.skip(8 * n)
        yield s.where, _signed(pid, s.where), x, y, z, r, g, b


_RECORDS = {"cameras": _cameras, "images": _images, "points3d": _points3d}


@dataclass
class _Part(InputPartition):
    """A file, and for image records where the first of the part starts, its number, and how many there are."""

    path: str
    size: int
    first: int = 0
    index: int = 0
    count: int = 0


def _image_parts(path: str, size: int, split_bytes: int) -> list[_Part]:
    """Runs of image records of about ``split_bytes``, found by walking the heads only."""
    parts: list[_Part] = []
    with open_input(path) as f:
        s = _Stream(f, size, path, _HEAD_BYTES)
        for i, at, _, _, n in _image_heads(s):
            if not parts or at - parts[-1].first >= split_bytes:
                parts.append(_Part(path, size, at, i))
            parts[-1].count += 1
            s.skip(24 * n)
    return parts


class _ModelReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path = options["path"]
        self.table = options.get("table", "images")
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.tracked_only = options.get("trackedonly", "true").lower() == "true"
        self.full = pa.schema([(n, _ARROW[t]) for n, t in (f.split(" ") for f in SCHEMAS[self.table].split(", "))])
        self.columns = [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        parts = []
        files = list_inputs(self.path, FILES[self.table])
        split_bytes = shared_bytes(self.split_bytes, sum(size for _, size in files))
        for path, size in files:
            heads = self.table in ("images", "observations")
            parts += _image_parts(path, size, split_bytes) if heads else [_Part(path, size)]
        return parts or [_Part("", 0)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with open_input(part.path) as f:
            s = _Stream(f, part.size, part.path, min(CHUNK_BYTES, max(_HEAD_BYTES, self.split_bytes)))
            if self.table == "observations":
                yield from self._observations(s, part)
                return
            rows: list[tuple] = []
            for record in _RECORDS[self.table](s, part):
                rows.append(record)
                if len(rows) == _BATCH:
                    yield self._batch(list(zip(*rows)))
                    rows = []
            if rows:
                yield self._batch(list(zip(*rows)))

    def _observations(self, s: _Stream, part: _Part) -> Iterator[pa.RecordBatch]:
        for _, _, head, _, n in _image_heads(s, part):
            done = 0
            while done < n:
                m = min(_BATCH, n - done)
                kp = np.frombuffer(s.take(24 * m), dtype=_KEYPOINT)
                idx = np.arange(done, done + m, dtype=np.int64)
                done += m
                if self.tracked_only:
                    keep = kp["p"] >= 0
                    kp, idx = kp[keep], idx[keep]
                if len(kp):
                    where = pa.array([s.where] * len(kp), pa.string())
                    image = np.full(len(kp), head[0], dtype=np.int64)
                    yield self._batch([where, image, idx, *(np.ascontiguousarray(kp[c]) for c in "xyp")])

    def _batch(self, columns: list) -> pa.RecordBatch:
        by_name = dict(zip(self.full.names, columns))
        arrays = [
            c if isinstance(c, pa.Array) else pa.array(c, self.full.field(n).type)
            for n, c in ((n, by_name[n]) for n in self.columns)
        ]
        return pa.RecordBatch.from_arrays(arrays, self.columns)


class SparseModelSource(DataSource):
    """``spark.read.format("sparse_model").option("table", t).load(dir)``.

    ``t`` is ``cameras``, ``images``, ``observations`` or ``points3d``; ``dir`` may
    hold the models of many captures. Observations without a track are dropped
    unless ``trackedOnly`` is ``false``.
    """

    @classmethod
    def name(cls) -> str:
        return "sparse_model"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "images")]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ModelReader(dict(self.options), schema)


def _read(spark: SparkSession, path: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("sparse_model").options(table=table, **options).load(path)


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "cameras")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Poses; ``image_idx`` is the position in the file."""
    return _read(spark, path, "images")


def read_observations(spark: SparkSession, path: str, tracked_only: bool = True) -> DataFrame:
    return _read(spark, path, "observations", trackedOnly=str(tracked_only).lower())


def read_points3d(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "points3d")
