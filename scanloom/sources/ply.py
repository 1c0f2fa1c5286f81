"""Binary point files: source, catalogue and sink."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    WriterCommitMessage,
)

from scanloom.plans.ship import ship_package
from scanloom.sources.files import list_inputs, open_input, resolve
from scanloom.sources.splits import Piece, Pieces, pack
from scanloom.sources.zones import Bounds, bounds_of, ranges

# Property types of the format, as NumPy code and Spark type.
PROPERTY_TYPES: dict[str, tuple[str, T.DataType]] = {
    "float": ("f4", T.FloatType()),
    "float32": ("f4", T.FloatType()),
    "double": ("f8", T.DoubleType()),
    "float64": ("f8", T.DoubleType()),
    "char": ("i1", T.ByteType()),
    "int8": ("i1", T.ByteType()),
    "uchar": ("u1", T.ShortType()),
    "uint8": ("u1", T.ShortType()),
    "short": ("i2", T.ShortType()),
    "int16": ("i2", T.ShortType()),
    "ushort": ("u2", T.IntegerType()),
    "uint16": ("u2", T.IntegerType()),
    "int": ("i4", T.IntegerType()),
    "int32": ("i4", T.IntegerType()),
    "uint": ("u4", T.LongType()),
    "uint32": ("u4", T.LongType()),
}
BYTE_ORDER = {"binary_little_endian": "<", "binary_big_endian": ">"}
COLOUR_CHANNELS = ("red", "green", "blue", "alpha", "diffuse_red", "diffuse_green", "diffuse_blue")

_ARROW = {
    T.FloatType(): pa.float32(),
    T.DoubleType(): pa.float64(),
    T.ByteType(): pa.int8(),
    T.ShortType(): pa.int16(),
    T.IntegerType(): pa.int32(),
    T.LongType(): pa.int64(),
}
_META = {"path": (T.StringType(), pa.string()), "point_id": (T.LongType(), pa.int64())}
_BATCH_ROWS = 65_536
_MAX_HEADER = 1 << 20


@dataclass
class PlyHeader:
    """What a file says about its vertices."""

    fmt: str
    count: int
    properties: list[tuple[str, str]]
    offset: int
    lines: list[str]

    @property
    def dtype(self) -> np.dtype:
        order = BYTE_ORDER[self.fmt]
        return np.dtype([(name, order + PROPERTY_TYPES[kind][0]) for name, kind in self.properties])

    @property
    def stride(self) -> int:
        return self.dtype.itemsize


def parse_header(raw: bytes, where: str = "") -> PlyHeader:
    """Header of a point file. Only the vertex element is described; it has to come first."""
    end = raw.find(b"end_header")
    stop = raw.find(b"\n", end) if end >= 0 else -1
    if not raw.startswith(b"ply") or stop < 0:
        raise ValueError(f"{where}: not a point file, or its header is incomplete")
    lines = [s.strip() for s in raw[:stop].decode("ascii", errors="replace").split("\n")]
    fmt, count, element, props = "binary_little_endian", None, None, []
    for line in lines:
        words = line.split()
        if not words:
            continue
        if words[0] == "format":
            fmt = words[1]
        elif words[0] == "element":
            if words[1] != "vertex" and count is None:
                raise ValueError(f"{where}: element {words[1]} precedes the vertices")
            element = words[1]
            if element == "vertex":
                count = int(words[2])
        elif words[0] == "property" and element == "vertex":
            if words[1] not in PROPERTY_TYPES:
                raise ValueError(f"{where}: unsupported vertex property {line!r}")
            props.append((words[2], words[1]))
    if fmt not in BYTE_ORDER:
        raise ValueError(f"{where}: unsupported format {fmt}")
    if count is None:
        raise ValueError(f"{where}: no vertex element")
    return PlyHeader(fmt, count, props, stop + 1, lines)


def read_header(path: str) -> PlyHeader:
    with open_input(path) as f:
        raw = f.read(8192)
        while b"end_header" not in raw[:-1] and len(raw) < _MAX_HEADER:
            more = f.read(65_536)
            if not more:
                break
            raw += more
        if b"end_header" in raw and b"\n" not in raw[raw.find(b"end_header") :]:
            raw += f.read(2)
    return parse_header(raw, path)


def vertex_schema(header: PlyHeader) -> T.StructType:
    fields = [T.StructField("path", T.StringType()), T.StructField("point_id", T.LongType())]
    return T.StructType(fields + [T.StructField(n, PROPERTY_TYPES[k][1]) for n, k in header.properties])


# Spark type that holds the values of a NumPy one.
_HOLDS = {np.dtype(code): kind for code, kind in PROPERTY_TYPES.values()} | {np.dtype("i8"): T.LongType()}


def common_type(kinds: Iterable[str]) -> T.DataType:
    """Narrowest column type that holds the values of all these property types."""
    return _HOLDS[np.result_type(*[np.dtype(PROPERTY_TYPES[k][0]) for k in kinds])]


class _PlyReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options = options
        self.fill = options.get("missing", "error") == "null"
        self.fields = [(f.name, f.dataType) for f in schema.fields]
        self.bounds: dict[str, Bounds] = {}
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take number bounds and file names from the filters; Spark still evaluates all of them."""
        self.bounds = bounds_of(filters)
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                named = set(f.value if isinstance(f, In) else [f.value])
                self.paths = named if self.paths is None else self.paths & named
        return filters

    def partitions(self) -> list[Pieces]:
        files = list_inputs(self.options["path"], self.options.get("suffix", ".ply"))
        return pack([f for f in files if self.paths is None or f[0] in self.paths], self.options)

    def read(self, split: Pieces) -> Iterator[pa.RecordBatch]:
        for piece in split.pieces:
            yield from self._records(piece)

    def _fits(self, have: str | None, kind: T.DataType) -> bool:
        """Whether a column of this type can be given from a file's property; with ``missing=null`` it may be wider or absent."""
        if have is None:
            return self.fill
        if PROPERTY_TYPES[have][1] == kind:
            return True
        target = np.dtype(_ARROW[kind].to_pandas_dtype())
        return self.fill and np.can_cast(np.dtype(PROPERTY_TYPES[have][0]), target, "safe")

    def _records(self, split: Piece) -> Iterator[pa.RecordBatch]:
        header = read_header(split.path)
        kinds = dict(header.properties)
        for name, kind in self.fields:
            if name not in _META and not self._fits(kinds.get(name), kind):
                raise ValueError(f"{split.path}: vertices have no {name} of type {kind.simpleString()}")
        if any(n not in kinds and n not in _META for n in self.bounds):
            return  # null everywhere, and a comparison with null keeps no row
        if split.size < header.offset + header.count * header.stride:
            raise ValueError(f"{split.path}: {header.count} vertices announced, file is too short")
        first, last = split.share(header.count)
        bounds = {n: b for n, b in self.bounds.items() if n in kinds}
        with open_input(split.path) as f:
            for low, high in ranges(split.path, first, last, self.bounds):
                f.seek(header.offset + low * header.stride)
                for start in range(low, high, _BATCH_ROWS):
                    n = min(_BATCH_ROWS, high - start)
                    rows = np.frombuffer(f.read(n * header.stride), dtype=header.dtype, count=n)
                    ids = np.arange(start, start + n, dtype=np.int64)
                    if bounds:
                        keep = np.logical_and.reduce([b.rows(rows[c]) for c, b in bounds.items()])
                        rows, ids = rows[keep], ids[keep]
                    if len(ids):
                        yield self._batch(split.path, ids, rows)

    def _batch(self, path: str, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        arrays, names = [], []
        for name, kind in self.fields:
            if name == "path":
                arrays.append(pa.array([path] * len(rows), pa.string()))
            elif name == "point_id":
                arrays.append(pa.array(ids))
            elif name not in rows.dtype.names:
                arrays.append(pa.nulls(len(rows), _ARROW[kind]))
            else:
                target = _ARROW[kind]
                arrays.append(pa.array(rows[name].astype(target.to_pandas_dtype()), target))
            names.append(name)
        return pa.RecordBatch.from_arrays(arrays, names)


# The property type that a column gets by itself.
_DEFAULT_KIND = {"float": "float", "double": "double", "tinyint": "char", "smallint": "short", "int": "int", "bigint": "uint"}


def default_properties(schema: T.StructType, types: dict[str, str]) -> list[tuple[str, str]]:
    """Vertex properties for the columns of ``schema``; ``types`` names those that are not to follow the column."""
    out = []
    for f in schema.fields:
        if f.name in _META:
            continue
        kind = types.get(f.name)
        if kind is None:
            kind = "uchar" if f.name in COLOUR_CHANNELS else _DEFAULT_KIND.get(f.dataType.simpleString())
        if kind is None:
            raise ValueError(f"column {f.name} of type {f.dataType.simpleString()} cannot be a vertex property")
        out.append((f.name, kind))
    return out


def comments_of(header: PlyHeader) -> list[str]:
    return [s for s in header.lines if s.split()[:1] in (["comment"], ["obj_info"])]


def header_bytes(count: int, properties: list[tuple[str, str]], comments: list[str]) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0", *comments, f"element vertex {count}"]
    lines += [f"property {kind} {name}" for name, kind in properties]
    return ("\n".join([*lines, "end_header"]) + "\n").encode("ascii")


def record_type(properties: list[tuple[str, str]]) -> np.dtype:
    return np.dtype([(n, "<" + PROPERTY_TYPES[k][0]) for n, k in properties])


def pack_records(batch: pa.RecordBatch, dtype: np.dtype) -> np.ndarray:
    """Rows as packed records; nulls, and values that do not fit their property, raise."""
    out = np.empty(batch.num_rows, dtype=dtype)
    for name in dtype.names or ():
        column = batch.column(batch.schema.get_field_index(name))
        if column.null_count:
            raise ValueError(f"column {name} holds nulls, a point file cannot")
        values = column.to_numpy(zero_copy_only=False)
        kind = dtype[name]
        if kind.kind in "iu" and len(values):
            limits = np.iinfo(kind)
            if values.min() < limits.min or values.max() > limits.max:
                raise ValueError(f"column {name} holds values outside the range of its property type")
        out[name] = values
    return out


@dataclass
class _Written(WriterCommitMessage):
    name: str
    count: int


class _PlyWriter(DataSourceArrowWriter):
    """One complete file per task. The body goes to a scratch file until its row count is known."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.dir = options["path"].rstrip("/")
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex
        types = dict(p.split(":") for p in options.get("types", "").split(",") if p)
        self.comments: list[str] = []
        self.order: list[str] | None = None
        source = options.get("headerfrom")
        if source:
            head = read_header(source)
            types = {**dict(head.properties), **types}
            self.order = [n for n, _ in head.properties]
            self.comments = comments_of(head)
        self.properties = default_properties(schema, types)
        if self.order is not None:
            have = {n for n, _ in self.properties}
            if have != set(self.order):
                raise ValueError(f"columns {sorted(have)} do not match the header of {source}")
            self.properties.sort(key=lambda p: self.order.index(p[0]))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        dtype = record_type(self.properties)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        attempt = context.taskAttemptId() if context else 0
        name = f"part-{part:05d}-{attempt}-{self.job[:12]}.ply"
        count = 0
        fs, inner = resolve(self.dir)
        with tempfile.TemporaryFile() as body:
            for batch in iterator:
                body.write(pack_records(batch, dtype).tobytes())
                count += batch.num_rows
            if count == 0:
                return _Written("", 0)
            staging = f"{inner}/_temporary/{self.job}"
            fs.create_dir(staging, recursive=True)
            body.seek(0)
            with fs.open_output_stream(f"{staging}/{name}") as out:
                out.write(header_bytes(count, self.properties, self.comments))
                while chunk := body.read(8 << 20):
                    out.write(chunk)
        return _Written(name, count)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, inner = resolve(self.dir)
        fs.create_dir(inner, recursive=True)
        parts = [m for m in messages if m is not None and m.count]
        files = [{"name": m.name, "count": m.count} for m in parts]
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(inner)) if i.type == pafs.FileType.File]
        if not self.overwrite and f"{inner}/_manifest.json" in old:  # parts of earlier jobs stay listed
            with fs.open_input_stream(f"{inner}/_manifest.json") as f:
                files = json.loads(f.read())["files"] + files
        for m in parts:  # the new parts stand before any old one goes
            fs.move(f"{inner}/_temporary/{self.job}/{m.name}", f"{inner}/{m.name}")
        if self.overwrite:
            for path in old:
                if path.endswith(".ply"):
                    fs.delete_file(path)
        self._drop_staging(fs, inner)
        manifest = {"files": files, "count": sum(f["count"] for f in files)}
        with fs.open_output_stream(f"{inner}/_manifest.json") as out:
            out.write(json.dumps(manifest).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, inner = resolve(self.dir)
        self._drop_staging(fs, inner)

    def _drop_staging(self, fs: pafs.FileSystem, inner: str) -> None:
        staging = f"{inner}/_temporary/{self.job}"
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)


class PlySource(DataSource):
    """``spark.read.format("ply").load(path)`` gives ``path, point_id`` and every vertex property.

    The schema is that of the first file; a file without a wanted property, or with
    another type, fails the read. ``.schema(...)`` with fewer columns reads only
    those. With the option ``missing`` set to ``null`` a file that lacks a property gives nulls, and
    one of a narrower type is widened (see ``read_unlike``). Small files share a split, large ones are cut
    into ranges of whole records (options ``splitBytes``, ``minPartitions``).
    Filters that compare columns with numbers, or ``path`` with names, reach the
    source: it leaves out files and rows, and blocks of records where ``zones.write_zone_maps``
    has left a sidecar.

    ``df.write.format("ply").save(dir)`` writes one standalone file per task and
    ``_manifest.json``. Options: ``headerFrom``, a file whose comments, property
    types and order are kept; ``types``, as ``red:uchar,label:ushort``.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> T.StructType:
        inputs = list_inputs(self.options["path"], self.options.get("suffix", ".ply"))
        if not inputs:
            raise FileNotFoundError(f"no point file in {self.options['path']}")
        return vertex_schema(read_header(inputs[0][0]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PlyReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _PlyWriter(dict(self.options), schema, overwrite)


_CATALOG = (
    "path string, status string, format string, vertex_count long, n_properties int, "
    "properties array<string>, kinds array<string>, size_mib double"
)


def ply_catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per named file: format, vertex count, properties and their types, size and capability flags.

    Missing and unreadable files get a row with their status instead. Only header
    bytes are read, in parallel.
    """
    from scanloom.functions.names import capabilities

    def describe(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path in batch["path"]:
                fs, inner = resolve(path)
                info = fs.get_file_info(inner)
                if info.type != pafs.FileType.File:
                    rows.append((path, "missing", None, None, None, None, None, None))
                    continue
                mib = info.size / 1048576
                try:
                    h = read_header(path)
                except ValueError as e:
                    rows.append((path, f"unreadable: {e}", None, None, None, None, None, mib))
                    continue
                names, kinds = [n for n, _ in h.properties], [k for _, k in h.properties]
                rows.append((path, "ok", h.fmt, h.count, len(names), names, kinds, mib))
            columns = ["path", "status", "format", "vertex_count", "n_properties", "properties", "kinds", "size_mib"]
            frame = pd.DataFrame(rows, columns=columns)
            yield frame.astype({"vertex_count": "Int64", "n_properties": "Int32"})

    ship_package(spark)
    slices = max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4))
    listing = spark.createDataFrame([(p,) for p in paths], "path string").repartition(slices, "path")
    return capabilities(listing.mapInPandas(describe, _CATALOG), "properties")


def merged_schema(catalog: DataFrame) -> T.StructType:
    """``path, point_id`` and every property that a readable file of the catalogue has, in the order of its first place.

    A property of several types gets the narrowest that holds the values of all. What is collected
    is a row per distinct property and type.
    """
    found = catalog.where("status = 'ok'").select(F.posexplode(F.arrays_zip("properties", "kinds")).alias("place", "p"))
    found = found.groupBy("p.properties", "p.kinds").agg(F.min("place").alias("place")).collect()
    place: dict[str, int] = {}
    kinds: dict[str, list[str]] = {}
    for r in found:
        place[r.properties] = min(r.place, place.get(r.properties, r.place))
        kinds.setdefault(r.properties, []).append(r.kinds)
    fields = [T.StructField(n, common_type(kinds[n])) for n in sorted(kinds, key=lambda n: (place[n], n))]
    return T.StructType([T.StructField(n, kind) for n, (kind, _) in _META.items()] + fields)


def read_unlike(spark: SparkSession, paths: list[str], catalog: DataFrame | None = None) -> DataFrame:
    """Files with unlike properties in one scan, under the merged schema of their catalogue; what a file lacks is null.

    Headers are read by tasks. Unreadable files raise.
    """
    schema = merged_schema(ply_catalog(spark, paths) if catalog is None else catalog)
    return spark.read.format("ply").schema(schema).option("missing", "null").load(",".join(paths))


def write_ply(df: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    """Write all columns but ``path`` and ``point_id`` as vertex properties."""
    kept = df.drop("path", "point_id")
    kept.write.format("ply").mode(mode).options(**options).save(path)


def write_ply_rgb(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write coordinates as 32-bit floats and colours, if the cloud has them, as bytes.

    Returns the number of points; an empty cloud writes nothing.
    """
    if df.isEmpty():
        return 0
    columns = [F.col(a).cast("float").alias(a) for a in ("x", "y", "z")]
    columns += [F.col(c).cast("smallint").alias(c) for c in ("red", "green", "blue") if c in df.columns]
    df.select(*columns).write.format("ply").mode(mode).save(path)
    fs, inner = resolve(path.rstrip("/"))
    with fs.open_input_stream(f"{inner}/_manifest.json") as f:
        return json.loads(f.read())["count"]
