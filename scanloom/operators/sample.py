"""Exact-size samples that are the same on every run and every partitioning.

Rows are ordered by ``md5(key:seed)``. The k-th smallest digest of a group is found
by counting, so no task sorts a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.plans.stage import as_keys, attach, stage

_ROWS_PER_BUCKET = 4096
_MAX_BUCKETS = 1 << 20
_SALTS = 32
_WINDOW_CAP = 65_536


def digest(key: Column | str, seed: int) -> Column:
    """``md5(key:seed)``; a null key has the digest of an empty one, never a null digest."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.coalesce(c.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def _unit(h: Column) -> Column:
    """First 52 bits of a hex digest as a number in [0, 1)."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def _cut(ties: DataFrame, keys: list[str]) -> DataFrame:
    """The last (digest, key) needed per group, how many of its copies are, and whether that is not all.

    ``ties`` counts rows per (digest, key) with the number of rows wanted in ``_need``;
    a null digest stands for all smaller ones.
    """
    order = Window.partitionBy(*keys).orderBy("_h", "_key")
    ranked = ties.withColumn("_before", F.sum("_c").over(order) - F.col("_c"))
    last = (F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_c") >= F.col("_need"))
    take = F.col("_need") - F.col("_before")
    return ranked.where(last).select(
        *keys,
        F.col("_h").alias("_cut_h"),
        F.col("_key").alias("_cut_key"),
        take.alias("_take"),
        (take < F.col("_c")).alias("_partial"),
    )


def _upper(n: Column, k: Column) -> Column:
    """Share of the digest range that holds the k smallest of n uniform digests, but for a negligible chance."""
    return (k + _slack(n, k)) / n


def _slack(n: Column, k: Column) -> Column:
    return F.sqrt(k * (n - k) / n) * 8 + 16


def _cut_in_band(thin: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Cuts found in one pass: digests are uniform, so the k-th lies in a narrow band around k/n.

    Rows below the band are counted on the map side, a few times sqrt(k) rows in it
    are kept. Should a k-th digest lie outside, the group gets no cut here.
    """
    n, k = F.col("_n"), F.col("_k")
    band = sizes.withColumns({"_low": (k - _slack(n, k)) / n, "_high": _upper(n, k)})
    rows = attach(thin, band, keys).withColumn("_u", _unit(F.col("_h"))).where("_u < _high")
    inside = F.col("_u") >= F.col("_low")
    ties = rows.groupBy(
        *keys, F.col("_k").alias("_need"), F.when(inside, F.col("_h")).alias("_h"), F.when(inside, F.col("_key")).alias("_key")
    ).agg(F.count("*").alias("_c"))
    return stage(_cut(ties, keys).where(F.col("_cut_h").isNotNull()), "cut")


def _cut_by_buckets(thin: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Cuts for any distribution of digests: bucket counts, then the rows of the boundary bucket."""
    buckets = F.greatest(
        F.least((F.col("_n") / _ROWS_PER_BUCKET).cast("long"), F.lit(_MAX_BUCKETS)), F.lit(1).cast("long")
    )
    rows = attach(thin, sizes.withColumn("_nb", buckets), keys)
    rows = rows.withColumn("_b", F.floor(_unit(F.col("_h")) * F.col("_nb")))
    hist = rows.groupBy(*keys, "_b", "_k").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_c")
    hist = hist.withColumn("_before", before)
    edge = hist.where((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_c") >= F.col("_k")))
    edge = edge.select(*keys, F.col("_b").alias("_edge"), (F.col("_k") - F.col("_before")).alias("_need"))
    edge = attach(rows.drop("_k"), stage(edge, "edge"), keys).where(F.col("_b") == F.col("_edge"))
    ties = edge.groupBy(*keys, "_h", "_key", "_need").agg(F.count("*").alias("_c"))
    return stage(_cut(ties, keys), "cut")


def sample_exact(
    df: DataFrame,
    k: int | str,
    key: str,
    seed: int = 42,
    by: str | Sequence[str] | None = None,
    ordered: bool = False,
    sizes: DataFrame | None = None,
    n: str | None = None,
) -> DataFrame:
    """Exactly ``min(k, n)`` rows of each group, without replacement.

    ``k`` is a number, or the name of a column that holds the number for the group.
    ``key`` should identify a row; ``ordered`` sorts the result by it. Rows with one key,
    null included, are interchangeable: some of them are taken where the cut falls among them.

    One pass counts the groups. If less than half of the rows are wanted, the next
    pass writes only rows whose digest is low enough, and the rest works on those;
    otherwise it reads the key column, then the full rows. Group sizes known
    beforehand can be given as ``sizes`` (``by`` columns and ``_n``, ``_k``), and as
    column ``n`` of the rows when ``k`` is a column too.
    """
    keys = as_keys(by)
    columns = list(df.columns)
    if not isinstance(k, str) and k <= 0:
        return df.limit(0)
    size = F.max(k) if isinstance(k, str) else F.lit(k)
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"), size.cast("long").alias("_k"))
    sizes = stage(sizes.where("_n > _k"), "sizes")
    total = sizes.agg(F.sum("_n").alias("n"), F.sum("_k").alias("k")).first()
    if total.n is None:
        return df.orderBy(key) if ordered else df
    near = df
    if total.k * 2 < total.n:
        u = _unit(digest(key, seed))
        if n is not None:
            near = df.where((F.col(n) <= F.col(k)) | (u < _upper(F.col(n), F.col(k))))
        else:
            near = attach(df, sizes, keys, "left").where(F.col("_n").isNull() | (u < _upper(F.col("_n"), F.col("_k"))))
        near = stage(near.select(*columns), "near")

    def thin(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, F.col(key).alias("_key")).withColumn("_h", digest("_key", seed))

    cut = _cut_in_band(thin(near), sizes, keys)
    found = attach(sizes, cut.select(*keys, "_cut_h"), keys, "left")
    missed = found.where(F.col("_cut_h").isNull()).select(*keys, "_n", "_k")
    if not missed.isEmpty():
        near = df
        cut = cut.unionByName(_cut_by_buckets(thin(df), stage(missed, "sizes"), keys))

    # Every group larger than its sample must have a cut; the others are kept whole.
    cut = attach(sizes.select(*keys), cut.withColumn("_found", F.lit(True)), keys, "left")
    lost = F.raise_error(F.lit("no cut was found for a group")).cast("string")
    cut = cut.withColumn("_cut_h", F.when(F.col("_found"), F.col("_cut_h")).otherwise(lost)).drop("_found")
    marked = attach(near.withColumn("_h", digest(key, seed)), cut, keys, "left")
    same = F.col("_h") == F.col("_cut_h")
    at_cut = same & F.col(key).eqNullSafe(F.col("_cut_key"))
    first = F.coalesce(F.col(key) < F.col("_cut_key"), F.col(key).isNull() & F.col("_cut_key").isNotNull())
    below = F.col("_cut_h").isNull() | (F.col("_h") < F.col("_cut_h")) | (same & first)
    if cut.where("_partial").isEmpty():
        out = marked.where(below | at_cut).select(*columns)
    else:
        # Copies of one key straddle the cut: take as many of them as are needed.
        nth = F.row_number().over(Window.partitionBy(*keys, key).orderBy("_h"))
        copies = marked.where(at_cut & ~below).withColumn("_i", nth).where(F.col("_i") <= F.col("_take"))
        out = marked.where(below).select(*columns).unionByName(copies.select(*columns))
    return out.orderBy(key) if ordered else out


def cap_per_group(
    df: DataFrame, by: str | Sequence[str], cap: int | str, key: str, seed: int = 0
) -> DataFrame:
    """At most ``cap`` rows of each group, chosen by digest; ``cap`` may name a column.

    Small caps rank within salted groups first, so that even a group with most of
    the rows is cut down before its rows meet in one task; both ranks are pruned on
    the map side. Larger and per-group caps use bucket counts.
    """
    keys = as_keys(by)
    if isinstance(cap, str) or cap > _WINDOW_CAP:
        return sample_exact(df, cap, key, seed, keys)
    columns = list(df.columns)
    h = df.withColumn("_h", digest(key, seed))
    h = h.withColumn("_salt", F.conv(F.substring("_h", 31, 2), 16, 10).cast("int") % _SALTS)
    for group in ([*keys, "_salt"], keys):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("_h", key))
        h = h.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")
    return h.select(*columns)
