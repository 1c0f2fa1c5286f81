"""A training corpus from raw documents: quality, near-duplicates, repeats, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of ``docs``; ``run`` writes each stage as Parquet and
reads it again for the next one.

A stage's result is to be written before the next stage begins, which drops the
tables that the one before kept meanwhile.

Null texts count as empty and null ids as the largest, repeated rows are rows of
their own (near-dedup keeps one of them), other columns are carried along
whatever their names, and empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import decontamination, packing, quality, simhash, suffixes
from scanloom.llm.common import free_name, settings, table, with_rows
from scanloom.plans.stage import recorded, remove, stage


#: Rows with long texts go to Python in batches of this many bytes at most.
BATCH_BYTES = 8 << 20
#: Tables of the last stage of a pipeline, by application and folder of the input.
_spent: dict[tuple[str, str], list[str]] = {}


def _stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """Drop the tables that the stage before staged inside: its result has been written when this one begins.

    Stages over other folders keep theirs, so pipelines over several inputs do not disturb each other.
    """

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = spark.sparkContext.applicationId, sf_dir
        remove(spark, _spent.pop(key, []))
        with recorded() as paths, settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}):
            out = fn(spark, docs, sf_dir)
        _spent[key] = paths
        return out

    return run_stage


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from ``labels``, accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the smallest id."""
    rows, row = with_rows(docs)
    dropped = stage(simhash.similar_groups(rows, row).filter(~F.col("first")).select(F.col("row").alias(row)), "copies")
    return rows.join(dropped, row, "left_anti").drop(row)


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what an earlier one holds too; ``n_chars`` follows, and one with nothing left goes."""
    marked = docs.withColumn(null := free_name(docs, "__null"), F.col("text").isNull())
    cut = suffixes.remove_repeats(marked, with_text=True, carry=[c for c in marked.columns if c != "text"])
    kept = cut.filter("n_removed = 0 OR text <> ''")
    new = {c: F.col("rest").getField(c) for c in docs.columns if c != "text"}
    new["text"] = F.when(~F.col("rest").getField(null), F.col("text"))
    if "n_chars" in new:
        length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(new["n_chars"])
        new["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return kept.select(*[new[c].alias(c) for c in docs.columns])


@_stage
def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    rows, row = with_rows(docs)
    leaks = decontamination.find_leaks(rows, table(spark, sf_dir, "benchmark"), row_col=row)
    leaks = stage(leaks.select(F.col("row").alias(row)).distinct(), "leaks")
    return rows.join(leaks, row, "left_anti").drop(row)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, each a power-of-two piece of one document."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("leaks", without_leaks),
    ("packing", packed),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, written = table(spark, sf_dir, "documents"), []
    for name, fn in STAGES:
        out = fn(spark, docs, sf_dir)
        with recorded() as paths:
            docs = stage(out, f"pipeline-{name}")
        remove(spark, written)
        written = paths
    return docs
