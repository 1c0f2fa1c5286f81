"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.plans.stage import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every node joins its larger neighbours to its smallest one (or to itself, if it is smaller)."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours, and itself, to the smallest of them; ``links`` has u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``links`` (u, v of one orderable type); the root is the smallest node reachable.

    Roots themselves are rows too. Each round is two joins on node, with minima
    combined before they are shuffled, and is written to the shared folder; the
    number of rounds grows with the logarithm of the longest chain. Links to
    self and repeated links do no harm; no links give no rows.
    """
    now = stage(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = None
    for _ in range(most_rounds):
        now = stage(_small_star(_large_star(now)), "stars")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 65_537)).first()
        if mark == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        before = mark
    raise RuntimeError("components did not settle")
