"""Process each input file once, remembered by a checkpoint instead of a look at the outputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from scanloom.functions.names import IMAGE_EXTENSIONS, extension, file_name
from scanloom.plans.stage import new_path

_FILE = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, path: str, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """Stream of files with one of the extensions: ``path, name, length, modificationTime``."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").load(path)
    files = files.where(extension("path").isin([e.lower() for e in extensions]))
    return files.select("path", file_name("path").alias("name"), "length", "modificationTime")


def process_new(
    spark: SparkSession,
    path: str,
    handle: Callable[[DataFrame], None],
    checkpoint: str | None = None,
    extensions: Sequence[str] = IMAGE_EXTENSIONS,
) -> None:
    """Run ``handle`` on the files that arrived since the last call with the same checkpoint, then return."""
    query = (
        new_files(spark, path, extensions)
        .writeStream.foreachBatch(lambda batch, _: handle(batch))
        .option("checkpointLocation", checkpoint or new_path(spark, "intake"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
