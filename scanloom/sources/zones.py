"""Zone maps of point files: least and greatest value of every property per block of records.

A sidecar below ``_zones`` beside a point file holds them, in segments of many
blocks, so that a split reads only its own. Filters that reach the source skip
blocks that cannot hold a row; sidecars of a file that has changed are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from scanloom.plans.ship import ship_package
from scanloom.sources.files import list_inputs, resolve

#: Records of a block, and blocks of a segment.
BLOCK_ROWS, SEGMENT = 16_384, 256


@dataclass
class Bounds:
    """What pushed filters leave of one column: values from ``low`` to ``high``, or one of ``values``."""

    low: float = -np.inf
    high: float = np.inf
    above: bool = False  # NaN, which is greater than all numbers, may pass
    values: list[float] = field(default_factory=list)

    def blocks(self, least: np.ndarray, greatest: np.ndarray, nan: np.ndarray) -> np.ndarray:
        """Blocks that may hold a row; those of NaN alone have no least value."""
        some = (greatest >= self.low) & (least <= self.high)
        if self.values:
            some &= np.any([(least <= v) & (v <= greatest) for v in self.values], axis=0)
        return some | (nan if self.above else False)

    def rows(self, column: np.ndarray) -> np.ndarray:
        keep = (column >= self.low) & (column <= self.high)
        if self.values:
            keep &= np.isin(column.astype(np.float64), self.values)
        return keep | np.isnan(column) if self.above and column.dtype.kind == "f" else keep


def bounds_of(filters: list[Filter]) -> dict[str, Bounds]:
    """Bounds per column of the filters that compare it with numbers; the others say nothing here.

    Bounds are closed and so may keep a row too many, which Spark's own filter drops.
    """
    out: dict[str, Bounds] = {}
    for f in filters:
        name = getattr(f, "attribute", ())
        given = f.value if isinstance(f, In) else (getattr(f, "value", None),)
        numbers = [v for v in given if isinstance(v, (int, float)) and not isinstance(v, bool)]
        if len(name) != 1 or len(numbers) != len(given) or any(np.isnan(v) for v in numbers) or not numbers:
            continue
        one = out.setdefault(name[0], Bounds(above=True))
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            one.low = max(one.low, numbers[0])
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            one.high, one.above = min(one.high, numbers[0]), False
        elif isinstance(f, EqualTo):
            one.low, one.high, one.above = max(one.low, numbers[0]), min(one.high, numbers[0]), False
        elif isinstance(f, In):
            one.values = [v for v in numbers if not one.values or v in one.values] or [np.inf, -np.inf]
            one.low, one.high, one.above = max(one.low, min(numbers)), min(one.high, max(numbers)), False
    return out


def _sidecar(path: str, segment: int) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder}/_zones/{name}.{segment:06d}"


def _stamp(fs: pafs.FileSystem, inner: str) -> dict:
    info = fs.get_file_info(inner)
    return {"size": info.size, "mtime": info.mtime_ns}


def read_zones(path: str, segment: int) -> dict[str, np.ndarray] | None:
    """Arrays (least, greatest, whether NaN) by property for a segment's blocks; None without a valid sidecar."""
    fs, inner = resolve(path)
    _, side = resolve(_sidecar(path, segment))
    if fs.get_file_info(side).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(side) as f:
        raw = f.read()
    head, _, body = raw.partition(b"\n")
    said = json.loads(head)
    if said["stamp"] != _stamp(fs, inner) or said["block_rows"] != BLOCK_ROWS:
        return None
    values = np.frombuffer(body, np.float64).reshape(len(said["names"]), 3, -1)
    return {n: v for n, v in zip(said["names"], values)}


def ranges(path: str, first: int, last: int, bounds: dict[str, Bounds]) -> list[tuple[int, int]]:
    """Runs of the records ``first`` to ``last`` in blocks that may hold a row within the bounds."""
    if "point_id" in bounds:
        own = bounds["point_id"]
        first = max(first, int(np.ceil(own.low)) if np.isfinite(own.low) else first)
        last = min(last, int(np.floor(own.high)) + 1 if np.isfinite(own.high) else last)
    used = {n: b for n, b in bounds.items() if n not in ("point_id", "path")}
    if first >= last or not used:
        return [(first, last)] if first < last else []
    blocks = np.arange(first // BLOCK_ROWS, -(-last // BLOCK_ROWS))
    keep = np.ones(len(blocks), bool)
    for segment in range(int(blocks[0]) // SEGMENT, int(blocks[-1]) // SEGMENT + 1):
        zones = read_zones(path, segment)
        mine = np.flatnonzero(blocks // SEGMENT == segment)
        if zones is None:
            continue
        for name, one in used.items():
            if name in zones:
                least, greatest, nan = zones[name][:, blocks[mine] % SEGMENT]
                keep[mine] &= one.blocks(least, greatest, nan > 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    found = [(int(blocks[a]) * BLOCK_ROWS, (int(blocks[b - 1]) + 1) * BLOCK_ROWS) for a, b in edges.reshape(-1, 2)]
    return [(max(a, first), min(b, last)) for a, b in found]


def _write_zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from scanloom.sources.ply import read_header

    done = []
    for batch in batches:
        for row in batch.to_pylist():
            path, segment = row["path"], row["segment"]
            header = read_header(path)
            fs, inner = resolve(path)
            stamp = _stamp(fs, inner)
            first = segment * SEGMENT * BLOCK_ROWS
            last = min(header.count, first + SEGMENT * BLOCK_ROWS)
            names = header.dtype.names
            zones = np.zeros((len(names), 3, max(0, -(-(last - first) // BLOCK_ROWS))))
            with fs.open_input_file(inner) as f:
                f.seek(header.offset + first * header.stride)
                for k, start in enumerate(range(first, last, BLOCK_ROWS)):
                    n = min(BLOCK_ROWS, last - start)
                    rows = np.frombuffer(f.read(n * header.stride), header.dtype, n)
                    for i, name in enumerate(names):
                        column = rows[name].astype(np.float64)
                        real = column[~np.isnan(column)]
                        zones[i, :, k] = real.min(initial=np.inf), real.max(initial=-np.inf), len(real) < n
            side = resolve(_sidecar(path, segment))[1]
            fs.create_dir(side.rsplit("/", 1)[0], recursive=True)
            head = json.dumps({"stamp": stamp, "block_rows": BLOCK_ROWS, "names": list(names)}).encode()
            with fs.open_output_stream(f"{side}.tmp{row['attempt']}") as out:
                out.write(head + b"\n" + zones.tobytes())
            fs.move(f"{side}.tmp{row['attempt']}", side)
            done.append((path, segment, zones.shape[2]))
    columns = list(zip(*done)) if done else [()] * 3
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["path", "segment", "blocks"]
    )


def write_zone_maps(spark: SparkSession, path: str) -> DataFrame:
    """Write the sidecars of all point files of ``path``; a row per file with its number of blocks.

    Each task reads segments, ranges of four million records, so a large file is
    spread over many tasks. Reading with filters works without sidecars too; it
    then reads all records and drops rows before they leave Python.
    """
    from scanloom.sources.ply import read_header

    ship_package(spark)
    files = spark.createDataFrame(list_inputs(path, ".ply"), "path string, size long")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                n = max(1, -(-read_header(p).count // (SEGMENT * BLOCK_ROWS)))
                yield pa.RecordBatch.from_pydict({"path": [p] * n, "segment": np.arange(n)})

    wanted = files.mapInArrow(segments, "path string, segment long")
    wanted = wanted.withColumn("attempt", F.expr("uuid()")).repartition(F.col("path"), F.col("segment"))
    done = wanted.mapInArrow(_write_zones, "path string, segment long, blocks long")
    return done.groupBy("path").agg(F.sum("blocks").alias("blocks"))
