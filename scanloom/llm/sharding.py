"""Shards that all hold the mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import numbered, sorted_stage, text_of
from scanloom.plans.stage import stage

SHARDS = 16
SEED = "interleave-1"


def interleave(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Place every row of ``docs`` in one of ``shards`` shards, each with the mixture of the whole.

    Rows are shuffled within their source by a seeded digest. The row of rank r
    among the n of its source has the fraction (r + 1/2) / n; all rows are
    sorted by it and cut into runs whose counts differ by one at most (law
    ``rows``). So a shard takes each source in proportion, to within one row.

    Both sorts are range sorts over narrow rows, so a source with a third of all
    rows is spread over as many tasks as its share; ranks come from counts per
    partition, not from a window over a source.

    Returns doc_id, source, size (UTF-8 bytes of the text plus 1), text_crc32,
    law, shard, slot (place in the shard, from 0) and grown_shard (null: the law
    does not speak of growth). A null text has size 1 and checksum 0; a null
    source is a source of its own; a null id sorts first. Repeated rows are
    placed one by one, equal ones in any order. An empty table gives no rows.
    """
    keys = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            (F.octet_length(text_of(text_col)) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"),
        ).withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))),
        "shard-keys",
    )
    tie = ["__h", "doc_id", "text_crc32", "size"]
    rows = sorted_stage(keys, ["source", *tie], "shard-ranks")
    runs = rows.groupBy("source", "pid").agg(F.min("idx").alias("__first"), F.count(F.lit(1)).alias("__n"))
    one = Window.partitionBy("source")
    runs = runs.select(
        F.col("source").alias("__source"),
        F.col("pid").alias("__pid"),
        (F.sum("__n").over(one.orderBy("pid")) - F.col("__n") - F.col("__first")).alias("__shift"),
        F.sum("__n").over(one).alias("__of"),
    )
    ranked = rows.join(
        runs, F.col("source").eqNullSafe(F.col("__source")) & (F.col("pid") == F.col("__pid")), "inner"
    ).withColumn("__f", (F.col("idx") + F.col("__shift") + F.lit(0.5)) / F.col("__of"))
    placed = numbered(
        ranked.select("doc_id", "source", "size", "text_crc32", "__h", "__f"),
        ["__f", "source", *tie],
        "__place",
        "__all",
        "shard-places",
    )
    shard = F.expr(f"__place * {shards} div __all")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"__place - (shard * __all + {shards - 1}) div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
