"""Exact percentiles that no single task has to hold.

Spark's ``percentile`` keeps all distinct values of a group in one buffer. Here a
group is narrowed instead: count rows per value bucket, pick the bucket that holds
the wanted rank, count again inside it. Counts combine on the map side, so a group
with most of the rows costs one scan per level and never a large task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.activation import finite
from scanloom.plans.stage import as_keys, attach, stage

_SPLIT = 4096
_SMALL_BUCKET = 500_000


def _magnitude_bucket(v: Column) -> Column:
    """Monotone bucket number that depends on the value only: about 1.6 % wide, below 93,000 in all."""
    size = F.floor(F.log1p(F.abs(v) * F.lit(2.0**20)) * 64)
    return F.when(v < 0, -size).otherwise(size)


def _pick(hist: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add ``_before``: rows of the group in lower buckets."""
    w = Window.partitionBy(*keys).orderBy(order)
    return hist.withColumn("_before", F.sum("_c").over(w) - F.col("_c"))


def percentiles(
    df: DataFrame,
    values: Mapping[str, Column | str],
    probs: Mapping[str, float],
    by: str | Sequence[str] | None = None,
    small_bucket: int = _SMALL_BUCKET,
) -> DataFrame:
    """Percentiles with linear interpolation, one row per group.

    ``values`` names the measures, ``probs`` the percentiles; the result has a
    column ``<measure>_<prob name>`` for each pair. Null, NaN and infinite values
    do not count. ``small_bucket`` is the bucket size below which ranks are read
    off a sort; larger buckets are split again, however many levels that takes.
    """
    keys = as_keys(by)
    measures = {n: (F.col(v) if isinstance(v, str) else v) for n, v in values.items()}
    names = list(measures)
    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("_m"), (measures[n].cast("double") + F.lit(0.0)).alias("_v"))
                    for i, n in enumerate(names)
                ]
            )
        ).alias("_s"),
    ).select(*keys, "_s._m", "_s._v")
    long = long.where(finite("_v")).withColumn("_b", _magnitude_bucket(F.col("_v")))
    group = [*keys, "_m"]
    # Later joins use the magnitude bucket as a key as well: a hot group is then many
    # keys, and few rows match.
    site = [*group, "_b"]

    # Level 1: magnitude histogram.
    hist = long.groupBy(*site).agg(
        F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    hist = _pick(hist, group, "_b").withColumn("_n", F.sum("_c").over(Window.partitionBy(*group)))
    wanted = []
    for p, q in enumerate(probs.values()):
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        for side, rank in enumerate((F.floor(pos), F.ceil(pos))):
            wanted.append(
                F.struct(
                    F.lit(p).alias("_p"),
                    F.lit(side).alias("_side"),
                    rank.cast("long").alias("_rank"),
                    (pos - F.floor(pos)).alias("_frac"),
                )
            )
    target = (
        hist.withColumn("_t", F.explode(F.array(*wanted)))
        .where((F.col("_t._rank") >= F.col("_before")) & (F.col("_t._rank") < F.col("_before") + F.col("_c")))
        .select(
            *site,
            "_t._p",
            "_t._side",
            "_t._frac",
            (F.col("_t._rank") - F.col("_before")).alias("_rank"),
            "_lo",
            "_hi",
            "_c",
        )
    )
    target = stage(target, "ranks")

    def inside() -> tuple[DataFrame, list[str]]:
        buckets = target.where("_lo < _hi").select(*site, "_lo", "_hi").distinct()
        rows = attach(long, buckets, site).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        return rows, [*site, "_lo", "_hi"]

    def narrow(hist: DataFrame, order: str, bucket: list[str], lo: str, hi: str) -> DataFrame:
        ranked = _pick(hist, bucket, order).withColumnRenamed("_c", "_cc")
        hit = attach(ranked, target.where("_lo < _hi").drop("_c"), bucket).where(
            (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_cc"))
        )
        done = target.where("_lo = _hi")
        return done.unionByName(
            hit.select(
                *site,
                "_p",
                "_side",
                "_frac",
                (F.col("_rank") - F.col("_before")).alias("_rank"),
                F.col(lo).alias("_lo"),
                F.col(hi).alias("_hi"),
                F.col("_cc").alias("_c"),
            )
        )

    largest = target.where("_lo < _hi").agg(F.max("_c")).first()[0]
    while largest is not None and largest > small_bucket:
        rows, bucket = inside()
        half = F.lit(0.5)
        share = (F.col("_v") * half - F.col("_lo") * half) / (F.col("_hi") * half - F.col("_lo") * half)
        hist = rows.groupBy(*bucket, F.least(F.floor(share * _SPLIT), F.lit(_SPLIT - 1)).alias("_part")).agg(
            F.count("*").alias("_c"), F.min("_v").alias("_lo2"), F.max("_v").alias("_hi2")
        )
        target = stage(narrow(hist, "_part", bucket, "_lo2", "_hi2"), "ranks")
        largest = target.where("_lo < _hi").agg(F.max("_c")).first()[0]
    if largest is not None:
        rows, bucket = inside()
        hist = rows.groupBy(*bucket, "_v").agg(F.count("*").alias("_c"))
        target = narrow(hist, "_v", bucket, "_v", "_v")

    outputs = []
    for m, name in enumerate(names):
        for p, label in enumerate(probs):
            here = (F.col("_m") == m) & (F.col("_p") == p)
            low = F.max(F.when(here & (F.col("_side") == 0), F.col("_lo")))
            high = F.max(F.when(here & (F.col("_side") == 1), F.col("_lo")))
            frac = F.max(F.when(here, F.col("_frac")))
            outputs.append((low + (high - low) * frac).alias(f"{name}_{label}"))
    return target.groupBy(*keys).agg(*outputs)
