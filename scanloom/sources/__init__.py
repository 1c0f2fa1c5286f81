"""Readers and writers. ``register(spark)`` adds the binary formats to ``spark.read.format``."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Register the formats ``ply``, ``npy_raster`` and ``sparse_model``, and let filters reach Python sources."""
    from scanloom.plans.ship import ship_package
    from scanloom.sources.npy import NpyRasterSource
    from scanloom.sources.ply import PlySource
    from scanloom.sources.sparse_model import SparseModelSource

    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PlySource, NpyRasterSource, SparseModelSource):
        spark.dataSource.register(source)
