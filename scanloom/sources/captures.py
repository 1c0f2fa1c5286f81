"""Point files named by the rows: every capture goes to files of its own, with its own header.

Counts come first, from one sorted copy of the rows, so each file is written front
to back with its header, straight to the target's file system. A capture with more
records than a file may hold is continued in further files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.plans.ship import ship_package
from scanloom.plans.stage import stage
from scanloom.sources.files import list_inputs, resolve
from scanloom.sources.ply import comments_of, default_properties, header_bytes, pack_records, read_header, record_type

#: Bytes of a file, about; counted as if all properties had eight. A task sorts and writes the rows of a file.
FILE_BYTES = 128 << 20
_IN_PARTITION = (1 << 33) - 1
_ENTRY = "name string, file string, temporary string, n_kept long, n_source long, bytes long"
_ENTRY_ARROW = pa.schema(
    [(n, pa.int64() if n in ("n_kept", "n_source", "bytes") else pa.string()) for n in (f.split()[0] for f in _ENTRY.split(", "))]
)


def _part_name(name: str, part: int, parts: int) -> str:
    stem, dot, suffix = name.rpartition(".")
    return name if parts == 1 else f"{stem}-{part:05d}{dot}{suffix}"


class _File:
    """One file while it is written: header first, then as many records as were announced."""

    def __init__(self, fs, temporary: str, name: str, file: str, source: str | None, count: int, properties):
        self.fs, self.temporary, self.name, self.file = fs, temporary, name, file
        self.count, self.left, self.n_source, comments = count, count, None, []
        if source is not None:
            head = read_header(source)
            properties, comments, self.n_source = head.properties, comments_of(head), head.count
        self.dtype = record_type(properties)
        head = header_bytes(count, properties, comments)
        self.bytes = len(head) + count * self.dtype.itemsize
        self.out = fs.open_output_stream(temporary)
        self.out.write(head)

    def write(self, batch: pa.RecordBatch) -> None:
        self.out.write(pack_records(batch, self.dtype).tobytes())
        self.left -= batch.num_rows

    def close(self) -> tuple:
        self.out.close()
        if self.left:
            raise ValueError(f"{self.file}: {self.left} records announced but not written")
        return self.name, self.file, self.temporary, self.count, self.n_source, self.bytes


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ENTRY_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENTRY_ARROW)], schema=_ENTRY_ARROW)


def _writer(folder: str, properties: list[tuple[str, str]]):
    """Writes sorted rows to a temporary file per ``__name`` and ``__part``; gives what was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        attempt = f"{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}"
        fs, inner = resolve(folder)
        fs.create_dir(inner, recursive=True)
        now, file, made = None, None, []
        for batch in batches:
            names, parts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__name", "__part"))
            edges = [0, *(i for i in range(1, len(names)) if (names[i], parts[i]) != (names[i - 1], parts[i - 1])), len(names)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if (names[a], parts[a]) != now:
                    if file is not None:
                        made.append(file.close())
                    now = names[a], parts[a]
                    one = {c: batch.column(batch.schema.get_field_index(c))[a].as_py() for c in ("__header", "__n", "__parts")}
                    place = f"{inner}/{attempt}-{len(made)}"
                    file = _File(fs, place, names[a], _part_name(names[a], parts[a], one["__parts"]), one["__header"], one["__n"], properties)
                if file.count:
                    file.write(batch.slice(a, b - a))
        if file is not None:
            made.append(file.close())
        yield _entries(made)

    return run


def _each_file(entries: DataFrame, act: Callable[[dict], None]) -> None:
    """Run ``act`` on every row, in tasks; it may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                act(row)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]}, pa.schema([("n", pa.int64())]))

    entries.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _into_place(target: str):
    def act(row: dict) -> None:
        fs, inner = resolve(target)
        final = f"{inner}/{row['file']}"
        if fs.get_file_info(row["temporary"]).type == pafs.FileType.File:  # else a first try has moved it
            fs.create_dir(final.rsplit("/", 1)[0], recursive=True)
            fs.move(row["temporary"], final)
        elif fs.get_file_info(final).type != pafs.FileType.File:
            raise FileNotFoundError(final)

    return act


def _delete(row: dict) -> None:
    fs, inner = resolve(row["path"])
    if fs.get_file_info(inner).type == pafs.FileType.File:
        fs.delete_file(inner)


def write_captures(
    df: DataFrame,
    target: str,
    name: Column,
    order: Sequence[str] = ("point_id",),
    header: Column | None = None,
    expected: DataFrame | None = None,
    records_per_file: int | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Write the rows of ``df`` to the point files ``name``, paths relative to ``target``, in the order of ``order``.

    All columns but ``path`` and ``point_id`` are vertex properties. ``header``
    names a point file per row whose comments, property types and their order
    the capture keeps (its properties must be columns); without it they follow
    the columns. A file holds at most ``records_per_file`` records (by default
    about ``FILE_BYTES``); a capture with more is continued, as
    ``name-00000.ply`` and so on, each a point file by itself, so one capture
    with most of the rows is spread over as many tasks as it has files.

    ``expected``, rows of ``name`` and ``header``, lists captures that get a file
    even if no row is left, with no vertices. A target with point files raises
    unless ``overwrite``; then files that the result does not name go when the
    new ones stand. Files appear under their names only after all are written;
    ``_manifest`` lists them, and comes last.

    Returns a row per file: name, file, n_kept, n_source (vertices of the header
    file, null without one) and bytes.
    """
    spark = df.sparkSession
    ship_package(spark)
    fs, inner = resolve(target)
    old = list_inputs(target, ".ply") if fs.get_file_info(inner).type == pafs.FileType.Directory else []
    if old and not overwrite:
        raise FileExistsError(f"{target} holds point files")
    folder = f"{target.rstrip('/')}/_temporary/{uuid.uuid4().hex}"

    used = [c for c in df.columns if c not in ("path", "point_id")]
    source = F.lit(None).cast("string") if header is None else header
    keys = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    rows = df.select(*used, *keys, name.alias("__name"), source.alias("__header"))
    by = ["__name", *[f"__o{i}" for i in range(len(order))]]
    rows = stage(
        rows.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__idx", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))),
        "capture-rows",
    )
    runs = rows.groupBy("__name", "__pid").agg(F.min("__idx").alias("__first"), F.count("*").alias("__own"))
    capture = Window.partitionBy("__name")  # a row a partition that the capture reaches
    runs = runs.select(
        "__name",
        "__pid",
        (F.sum("__own").over(capture.orderBy("__pid")) - F.col("__own") - F.col("__first")).alias("__shift"),
        F.sum("__own").over(capture).alias("__total"),
    )
    most = records_per_file or max(1, FILE_BYTES // (8 * max(1, len(used))))
    ranked = rows.join(stage(runs, "capture-runs"), ["__name", "__pid"]).withColumn("__rank", F.col("__idx") + F.col("__shift"))
    ranked = ranked.withColumns(
        {
            "__part": F.expr(f"CAST(__rank DIV {most} AS INT)"),
            "__parts": F.expr(f"CAST((__total + {most - 1}) DIV {most} AS INT)"),
        }
    ).withColumn("__n", F.least(F.lit(most).cast("long"), F.col("__total") - F.col("__part") * F.lit(most).cast("long")))
    dealt = ranked.repartition("__name", "__part").sortWithinPartitions("__name", "__part", "__rank")
    files = dealt.select(*used, "__name", "__header", "__part", "__parts", "__n")
    properties = default_properties(df.select(*used).schema, {}) if header is None else []
    entries = stage(files.mapInArrow(_writer(folder, properties), _ENTRY), "capture-files")
    if expected is not None:
        absent = expected.select(F.col("name").alias("__name"), F.col("header").alias("__header"))
        absent = absent.join(entries.select(F.col("name").alias("__name")), "__name", "left_anti").distinct()
        zero = {c: F.lit(0) for c in ("__part", "__n")}
        absent = absent.withColumns({**zero, "__parts": F.lit(1)}).repartition("__name")
        entries = entries.union(stage(absent.mapInArrow(_writer(folder, properties), _ENTRY), "capture-files"))

    _each_file(entries, _into_place(target))
    if old:
        qualified = F.concat(F.lit(f"{inner}/"), F.col("file")).alias("path")
        gone = spark.createDataFrame([(resolve(p)[1], p) for p, _ in old], "inner string, path string")
        gone = gone.join(entries.select(qualified.alias("inner")), "inner", "left_anti")
        _each_file(gone.select("path"), _delete)
    place = fs.get_file_info(f"{inner}/_temporary")
    if place.type == pafs.FileType.Directory:
        fs.delete_dir(resolve(folder)[1])
    entries = entries.drop("temporary")
    shared = target if "://" in target or target.startswith("file:") else f"file://{inner}"
    entries.coalesce(1).write.mode("overwrite").json(f"{shared.rstrip('/')}/_manifest")
    return entries
