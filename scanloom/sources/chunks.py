"""Files written from ordered binary pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from scanloom.plans.ship import ship_package
from scanloom.sources.files import resolve


def write_chunks(chunks: DataFrame) -> DataFrame:
    """Write files whose contents are the ``content`` of the rows with one ``path``, in ``seq`` order.

    The rows of a file meet, sorted, in one task, which appends them one batch at a
    time and renames the finished file into place. Evaluating the result, one row
    per file with its size, does the writing.
    """
    ship_package(chunks.sparkSession)
    ordered = chunks.select("path", "seq", "content").repartition("path").sortWithinPartitions("path", "seq")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        current = out = fs = inner = None
        sizes: dict[str, int] = {}

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(f"{inner}.{attempt}.tmp", inner)

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(2)):
                if path != current:
                    close()
                    fs, inner = resolve(path)
                    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    out, current = fs.open_output_stream(f"{inner}.{attempt}.tmp"), path
                    sizes[path] = 0
                out.write(content.as_buffer())
                sizes[path] += content.as_buffer().size
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sizes), pa.string()), pa.array(list(sizes.values()), pa.int64())], ["path", "length"]
        )

    return ordered.mapInArrow(save, "path string, length long")
