"""Staged tables and the joins that use them.

A staged table is written once as Parquet to the shared folder named by
``spark.checkpoint.dir``. That cuts the lineage (a lost executor re-reads
files, it does not replay upstream jobs), fixes the values for every later
use, and gives Catalyst the real size in bytes: a small table is broadcast
because its files are small, a large one takes a shuffled join. No operator
forces a broadcast of a table whose size is not fixed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group: what a task that writes long rows holds back before it goes to the file.
ROW_GROUP = 32 << 20
_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir``, or a temporary folder in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    app = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/scanloom-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _recording:
        paths.append(path)
    return path


_recording: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the paths of the tables that are staged inside, for a later ``remove``."""
    paths: list[str] = []
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording.remove(paths)


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return a DataFrame that scans the written files."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("error").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_keys(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def attach(df: DataFrame, per_group: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one row per group back to the rows of that group.

    Without keys ``per_group`` is a global aggregate, so exactly one row, and is
    broadcast. With keys the join strategy is left to Catalyst, which sees the
    size of the staged table; keys compare null-safe so that rows with a null
    group are kept.
    """
    keys = as_keys(by)
    if not keys:
        if how == "left":
            return df.join(F.broadcast(per_group), F.lit(True), "left")
        return df.crossJoin(F.broadcast(per_group))
    renamed = per_group
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__{k}")
    cond = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"__{k}"))
        cond = term if cond is None else cond & term
    return df.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])
