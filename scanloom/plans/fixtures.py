"""Capture-shaped views over the driver tables, for the query registry and the tests.

Each view is one SELECT. Spark runs it as written; :func:`with_views` turns it into
a CTE for DuckDB, where only the driver tables are registered.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("embeddings", "events", "lineitem", "orders", "part", "supplier")

VIEWS: dict[str, str] = {
    # Splat rows, ten captures.
    "gaussians": """
SELECT label AS capture, vec_id AS point_id,
  10 * CAST(element_at(embedding, 1) AS DOUBLE) AS x,
  10 * CAST(element_at(embedding, 2) AS DOUBLE) AS y,
  10 * CAST(element_at(embedding, 3) AS DOUBLE) AS z,
  20 * CAST(element_at(embedding, 55) AS DOUBLE) AS opacity,
  20 * CAST(element_at(embedding, 56) AS DOUBLE) - 3 AS scale_0,
  20 * CAST(element_at(embedding, 57) AS DOUBLE) - 3 AS scale_1,
  20 * CAST(element_at(embedding, 58) AS DOUBLE) - 3 AS scale_2
FROM embeddings""",
    # Coloured cloud, seven captures, unique string key.
    "points": """
SELECT l_linenumber AS capture,
  concat_ws('-', CAST(l_orderkey AS string), CAST(l_partkey AS string), CAST(l_suppkey AS string),
            CAST(l_linenumber AS string), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS string)) AS point_key,
  l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z,
  CAST(l_orderkey % 256 AS INT) AS red, CAST(l_partkey % 256 AS INT) AS green, CAST(l_suppkey % 256 AS INT) AS blue
FROM lineitem""",
    # All five normalised camera models.
    "cameras": """
SELECT s_suppkey AS camera_id, CAST(s_suppkey % 5 AS INT) AS model_id, 25 AS width, 20 AS height,
  array(CAST(20 + s_suppkey % 3 AS DOUBLE), CAST(21 AS DOUBLE), CAST(12.5 AS DOUBLE), CAST(10 AS DOUBLE),
        CAST(0.01 AS DOUBLE), CAST(0.02 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)) AS params
FROM supplier""",
    # Unit quaternions and translations, four captures.
    "images": """
SELECT image_id % 4 AS capture, image_id, camera_id, name, qw/n AS qw, qx/n AS qx, qy/n AS qy, qz/n AS qz, tx, ty, tz FROM (
  SELECT *, sqrt(qw*qw + qx*qx + qy*qy + qz*qz) AS n FROM (
    SELECT vec_id AS image_id, vec_id % 10 AS camera_id,
      concat('img_', lpad(CAST(vec_id AS string), 5, '0'), '.jpg') AS name,
      1 + CAST(element_at(embedding, 59) AS DOUBLE) AS qw, CAST(element_at(embedding, 60) AS DOUBLE) AS qx,
      CAST(element_at(embedding, 61) AS DOUBLE) AS qy, CAST(element_at(embedding, 62) AS DOUBLE) AS qz,
      10 * CAST(element_at(embedding, 1) AS DOUBLE) AS tx, 10 * CAST(element_at(embedding, 2) AS DOUBLE) AS ty,
      10 * CAST(element_at(embedding, 3) AS DOUBLE) AS tz
    FROM embeddings) a) b""",
    # Observations in raster pixels, -1 = untracked.
    "observations": """
SELECT l_suppkey % 4 AS capture, l_suppkey AS image_id,
  concat_ws('-', CAST(l_orderkey AS string), CAST(l_partkey AS string), CAST(l_suppkey AS string),
            CAST(l_linenumber AS string), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS string)) AS obs_key,
  l_quantity * 0.5 AS x, l_discount * 210 AS y,
  CASE WHEN l_linenumber = 7 THEN -1 ELSE l_partkey END AS point3d_id
FROM lineitem""",
    # Every 17th id is missing, so some observations dangle.
    "points3d": """
SELECT p_partkey AS point3d_id, (p_size - 25) / CAST(10 AS DOUBLE) AS x,
  (p_retailprice - 950) / 50 AS y, 5 + p_size / CAST(10 AS DOUBLE) AS z
FROM part WHERE p_partkey % 17 <> 0""",
    # Depth pixels: 500 events make one frame of 20 rows and 25 columns.
    "depth_px": """
SELECT (event_id div 500) % 4 AS capture, event_id div 500 AS frame, (event_id % 500) div 25 AS v, event_id % 25 AS u,
  value / 10 AS depth, ((event_id * 37) % 101) / CAST(100 AS DOUBLE) AS conf
FROM events""",
    # File catalogue: runs, checkpoints, sizes.
    "files": """
SELECT o_orderkey AS file_id, o_custkey % 5 AS capture, o_custkey AS run, (o_orderkey * 7919) % 30000 AS step, o_orderdate AS mtime,
  CAST(round(o_totalprice * 100) AS BIGINT) AS length,
  concat('splat_v', CAST(o_orderkey % 40 AS string), '_x.ply') AS name
FROM orders""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view, planned straight over the Parquet files it needs."""
    sql = VIEWS[name]
    table = re.search(r"FROM (\w+)", sql.rsplit("SELECT", 1)[1]).group(1)
    source = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return spark.sql(re.sub(rf"FROM {table}\b", "FROM {src}", sql), src=source)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def duck(sql: str) -> str:
    """DuckDB spelling of a view."""
    sql = re.sub(r"element_at\((\w+), (\d+)\)", r"\1[\2]", sql)
    return sql.replace(" div ", " // ").replace("array(", "list_value(").replace("AS string", "AS varchar")


def with_views(names: str, body: str) -> str:
    """``body`` preceded by the named views as CTEs. A body may start with ``, name AS (...)`` CTEs of its own."""
    ctes = ",\n".join(f"{n} AS ({duck(VIEWS[n]).strip()})" for n in names.split())
    return f"WITH {ctes}\n{body.strip()}"
