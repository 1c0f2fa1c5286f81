"""Helpers shared by the operators: inputs, row numbers over sorted tables, Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanloom.plans.ship import ship_package
from scanloom.plans.stage import stage

_IN_PARTITION = (1 << 33) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text of a row; a null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_rows(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written once with a number for every row, and the column's name; so several passes agree on the rows."""
    name = free_name(df, "__row")
    return stage(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``fn``, giving what it freed back to the system when a task ends: workers are kept for tasks of other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not every C library can
                pass

    return run


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType):
    """``mapInArrow`` with the package shipped to the workers, which hold no memory between tasks."""
    ship_package(df.sparkSession)
    return df.mapInArrow(_tidy(fn), schema)


def sorted_stage(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Write ``df`` range-sorted by ``order``; adds ``pid`` and ``idx``, a row's partition and its place in it.

    Partitions follow each other in the order, so a row's global place is its
    ``idx`` plus the rows of all lower ``pid``.
    """
    return stage(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("pid", F.spark_partition_id())
        .withColumn("idx", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))),
        label,
    )


def numbered(df: DataFrame, order: Sequence[str], name: str, total: str | None = None, label: str = "sorted"):
    """``df`` with ``name``, each row's place (from 0) in the order of ``order``.

    A global sort, then one count per partition: no task sees more than its
    partition, and only the counts (a row per partition) go through one window.
    ``total`` adds the number of all rows.
    """
    rows = sorted_stage(df, order, label)
    sizes = rows.groupBy("pid").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(F.lit(0))
    sizes = sizes.select(
        "pid",
        (F.sum("__n").over(whole.orderBy("pid")) - F.col("__n")).alias("__before"),
        F.sum("__n").over(whole).alias("__total"),
    )
    out = rows.join(F.broadcast(sizes), "pid").withColumn(name, F.col("__before") + F.col("idx"))
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop("pid", "idx", "__before", "__total")
