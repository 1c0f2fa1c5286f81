"""Token counts with a cache by content digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import map_arrow, text_of
from scanloom.llm.tokens import PieceCounter

LIMIT = 4096
CACHE_SCHEMA = "digest binary, n_tokens long, version string"
_SEEN = 2_000_000


@lru_cache(maxsize=4)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file, so that another file never meets its counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; none if nothing was stored yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.filter(F.col("version") == version).select("digest", "n_tokens")


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest this task has not passed on yet, so that a text with many copies leaves a task once."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for d in batch.column(0).to_pylist():
            keep.append(d not in seen)
            seen.add(d)
        if len(seen) > _SEEN:
            seen.clear()
        yield batch.filter(pa.array(keep))


def _encode_distinct(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = _counter(path), set()
        for batch in batches:
            digests, counts = [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    digests.append(d)
                    counts.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"]
            )

    return run


def fill_cache(docs: DataFrame, cache: str, model: str, text_col: str = "text") -> DataFrame:
    """Encode the distinct texts of ``docs`` that ``cache`` lacks, append their counts, and return the whole cache.

    Only texts that are not stored move, each once per task that holds it, to
    the task of its digest. The counts are appended by Spark's own commit, so a
    lost task leaves nothing half done.
    """
    spark, version = docs.sparkSession, tokenizer_version(model)
    keyed = docs.select(F.unhex(F.sha2(text_of(text_col).cast("binary"), 256)).alias("digest"), text_of(text_col).alias("text"))
    distinct = map_arrow(keyed, _first_of_task, "digest binary, text string")
    missing = distinct.join(read_cache(spark, cache, version), "digest", "left_anti").repartition("digest")
    counts = map_arrow(missing, _encode_distinct(model), "digest binary, n_tokens long")
    counts.withColumn("version", F.lit(version)).write.mode("append").parquet(cache)
    return read_cache(spark, cache, version)


def count_tokens(
    docs: DataFrame, cache: str, model: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens of every whole text, taken from ``cache`` or encoded and added to it.

    ``model`` is a sentencepiece file; ``cache`` a folder that all executors
    share, kept for later calls. A text's key is the SHA-256 of its UTF-8 bytes
    (null counts as empty) with the digest of the vocabulary file; nothing else
    is normalised, since the vocabulary sees every other difference.

    Returns doc_id, n_bytes, n_tokens and over_limit, a row per input row: null
    and repeated ids and rows are kept, empty texts have 0 tokens, and an empty
    table gives no rows. Two calls that run at once may both store a text, with
    the same count; it is read once.
    """
    stored = fill_cache(docs, cache, model, text_col).dropDuplicates(["digest"])
    keys = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(text_of(text_col).cast("binary"), 256)).alias("digest"),
    )
    return keys.join(stored, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
