"""Registered queries: splat and cloud profiling, pruning, sampling, thinning."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import activation as act
from scanloom.functions import names
from scanloom.operators import clip, jobs, profile, sample, voxel
from scanloom.plans.fixtures import table, view
from scanloom.plans.registry import query

SIG = "(1 / (1 + exp(-opacity)))"


@query("sigmoid", "point_id ~op", "gaussians", f"SELECT point_id, {SIG} AS op FROM gaussians")
def _(spark, sf):
    return view(spark, sf, "gaussians").select("point_id", act.sigmoid("opacity").alias("op"))


@query(
    "sigmoid_clipped",
    "point_id ~op",
    "gaussians",
    "SELECT point_id, 1 / (1 + exp(-greatest(least(opacity * 100, 88), -88))) AS op FROM gaussians",
)
def _(spark, sf):
    g = view(spark, sf, "gaussians")
    return g.select("point_id", act.sigmoid(F.col("opacity") * 100, clip=88).alias("op"))


@query(
    "max_scale",
    "point_id ~s",
    "gaussians",
    "SELECT point_id, greatest(exp(scale_0), exp(scale_1), exp(scale_2)) AS s FROM gaussians",
)
def _(spark, sf):
    g = view(spark, sf, "gaussians")
    return g.select("point_id", act.max_scale(act.scale_columns(g)).alias("s"))


BAND = f"CASE WHEN {SIG} > 0.9 THEN 'solid' WHEN {SIG} < 0.15 THEN 'ghost' ELSE 'uncertain' END"


@query("opacity_band", "point_id band", "gaussians", f"SELECT point_id, {BAND} AS band FROM gaussians")
def _(spark, sf):
    return view(spark, sf, "gaussians").select("point_id", act.opacity_band(act.sigmoid("opacity")).alias("band"))


@query(
    "opacity_histogram",
    "capture band n ~pct",
    "gaussians",
    f"""SELECT capture, band, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY capture) AS pct
        FROM (SELECT capture, {BAND} AS band FROM gaussians) b GROUP BY capture, band""",
)
def _(spark, sf):
    return profile.opacity_histogram(view(spark, sf, "gaussians"), "capture")


@query(
    "version_tag",
    "file_id tag",
    "files",
    """SELECT file_id, CASE file_id % 6 WHEN 0 THEN 'da3' WHEN 1 THEN 'mvs_full' WHEN 2 THEN 'mvs_500k'
         WHEN 3 THEN 'sparse' ELSE 'noinit' END AS tag FROM files""",
)
def _(spark, sf):
    f = view(spark, sf, "files")
    init = F.expr(
        "CASE file_id % 6 WHEN 0 THEN 'da3_init.ply' WHEN 1 THEN 'fused.ply' WHEN 2 THEN 'fused_sub.ply' "
        "WHEN 3 THEN 'sparse_init.ply' WHEN 4 THEN 'other.ply' END"
    )
    return f.select("file_id", names.version_tag(init).alias("tag"))


@query(
    "derived_names",
    "image_id stem npy mask_a mask_b",
    "images",
    """SELECT image_id, replace(name, '.jpg', '') AS stem, replace(name, '.jpg', '.npy') AS npy,
         concat(name, '.png') AS mask_a, replace(name, '.jpg', '.png') AS mask_b FROM images""",
)
def _(spark, sf):
    path = F.concat(F.lit("/data/images/"), F.col("name"))
    masks = names.mask_names(path)
    return view(spark, sf, "images").select(
        "image_id",
        names.stem(path).alias("stem"),
        names.with_suffix(path, ".npy").alias("npy"),
        masks[0].alias("mask_a"),
        masks[1].alias("mask_b"),
    )


AXIS_COLS = " ".join(f"~{a}_{s}" for a in "xyz" for s in ("min", "max", "span", "mean", "std"))


def _axis_sql(source: str, by: str) -> str:
    aggs = ", ".join(
        f"min({a}) AS {a}_min, max({a}) AS {a}_max, max({a}) - min({a}) AS {a}_span, avg({a}) AS {a}_mean, "
        f"stddev_pop({a}) AS {a}_std"
        for a in "xyz"
    )
    return f"SELECT {by}, count(*) AS n, {aggs} FROM {source} GROUP BY {by}"


@query("axis_stats_splat", f"capture n {AXIS_COLS}", "gaussians", _axis_sql("gaussians", "capture"))
def _(spark, sf):
    return profile.axis_stats(view(spark, sf, "gaussians"), "capture")


@query("axis_stats_cloud", f"capture n {AXIS_COLS}", "points", _axis_sql("points", "capture"))
def _(spark, sf):
    return profile.axis_stats(view(spark, sf, "points"), "capture")


def _outlier_sql(source: str, k: float) -> str:
    parts = " UNION ALL ".join(
        f"SELECT p.capture, '{a}' AS axis, count(*) FILTER (abs({a} - m{a}) > {k} * s{a}) AS n_outliers, "
        f"count(*) AS n FROM {source} p JOIN st USING (capture) GROUP BY p.capture"
        for a in "xyz"
    )
    stats = ", ".join(f"avg({a}) AS m{a}, stddev_pop({a}) AS s{a}" for a in "xyz")
    return f"""WITH st AS (SELECT capture, {stats} FROM {source} GROUP BY capture), c AS ({parts})
        SELECT capture, axis, n, n_outliers, n_outliers * 100.0 / n AS pct FROM c"""


for _source in ("gaussians", "points"):
    for _k in (3, 5, 1.5):

        @query(
            f"outlier_counts_{_source}_{_k}".replace(".", "_"),
            "capture axis n n_outliers ~pct",
            _source,
            _outlier_sql(_source, _k),
        )
        def _(spark, sf, source=_source, k=_k):
            return profile.outlier_counts(view(spark, sf, source), k, "capture")


def _bbox_sql(source: str) -> str:
    return f"""SELECT *, n / nullif(volume, 0) AS density FROM (
        SELECT capture, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max,
          min(z) AS z_min, max(z) AS z_max, (max(x)-min(x)) * (max(y)-min(y)) * (max(z)-min(z)) AS volume
        FROM {source} GROUP BY capture) b"""


BOX = " ".join(f"~{a}_{e}" for a in "xyz" for e in ("min", "max"))


@query("bounding_box", f"capture n {BOX} ~volume ~density", "points", _bbox_sql("points"))
def _(spark, sf):
    return profile.bbox(view(spark, sf, "points"), "capture")


@query("point_density", "capture n ~volume ~density", "gaussians", _bbox_sql("gaussians"))
def _(spark, sf):
    return profile.density(view(spark, sf, "gaussians"), "capture")


LADDER = ", ".join(f"({t})" for t in profile.OPACITY_LADDER)


@query(
    "opacity_exceedance",
    "capture ~threshold n_above ~pct",
    "gaussians",
    f"""SELECT capture, CAST(t AS DOUBLE) AS threshold, count(*) FILTER ({SIG} > t) AS n_above,
          count(*) FILTER ({SIG} > t) * 100.0 / count(*) AS pct
        FROM gaussians CROSS JOIN (VALUES {LADDER}) v(t) GROUP BY capture, t""",
)
def _(spark, sf):
    return profile.exceedance(view(spark, sf, "gaussians"), by="capture")


@query(
    "opacity_stats",
    "capture ~mean_opacity ~median_opacity",
    "gaussians",
    f"""SELECT capture, avg({SIG}) AS mean_opacity, quantile_cont({SIG}, 0.5) AS median_opacity
        FROM gaussians GROUP BY capture""",
)
def _(spark, sf):
    return profile.opacity_stats(view(spark, sf, "gaussians"), "capture")


@query(
    "opacity_stats_clipped_invalid",
    "capture ~mean_opacity ~median_opacity",
    "gaussians",
    """SELECT capture, avg(op) AS mean_opacity, quantile_cont(op, 0.5) AS median_opacity FROM (
         SELECT capture, 1 / (1 + exp(-greatest(least(opacity, 2), -2))) AS op FROM gaussians WHERE point_id % 3 = 2) s
       GROUP BY capture""",
)
def _(spark, sf):
    opacity = F.when(F.col("point_id") % 3 == 1, F.lit(float("nan"))).when(F.col("point_id") % 3 == 2, F.col("opacity"))
    return profile.opacity_stats(view(spark, sf, "gaussians").withColumn("opacity", opacity), "capture", clip=2.0)


@query(
    "percentiles_cloud",
    "capture ~x_p25 ~x_median ~x_p90 ~y_p25 ~y_median ~y_p90",
    "points",
    "SELECT capture, "
    + ", ".join(
        f"quantile_cont(sqrt({a}), {q}) AS {a}_{n}" for a in "xy" for n, q in (("p25", 0.25), ("median", 0.5), ("p90", 0.9))
    )
    + " FROM points GROUP BY capture",
)
def _(spark, sf):
    probs = {"p25": 0.25, "median": 0.5, "p90": 0.9}
    return profile.percentiles(view(spark, sf, "points"), {"x": F.sqrt("x"), "y": F.sqrt("y")}, probs, "capture")


@query(
    "ghost_ratio",
    "capture n ~ghost_ratio",
    "gaussians",
    f"""SELECT capture, count(*) AS n, avg(CASE WHEN {SIG} < 0.1 THEN 1.0 ELSE 0.0 END) AS ghost_ratio
        FROM gaussians GROUP BY capture""",
)
def _(spark, sf):
    return profile.ghost_ratio(view(spark, sf, "gaussians"), by="capture")


MAXS = "greatest(exp(scale_0), exp(scale_1), exp(scale_2))"


@query(
    "scale_stats",
    "capture ~median_scale ~mean_scale ~share_above_1 ~share_above_05 ~share_below_001",
    "gaussians",
    f"""SELECT capture, quantile_cont(s, 0.5) AS median_scale, avg(s) AS mean_scale,
          avg(CAST(s > 1.0 AS INT)) AS share_above_1, avg(CAST(s > 0.5 AS INT)) AS share_above_05,
          avg(CAST(s < 0.01 AS INT)) AS share_below_001
        FROM (SELECT capture, {MAXS} AS s FROM gaussians) q GROUP BY capture""",
)
def _(spark, sf):
    return profile.scale_stats(view(spark, sf, "gaussians"), "capture")


@query(
    "color_stats",
    "capture ~red_mean red_min red_max ~green_mean green_min green_max ~blue_mean blue_min blue_max",
    "points",
    "SELECT capture, "
    + ", ".join(f"avg({c}) AS {c}_mean, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in ("red", "green", "blue"))
    + " FROM points GROUP BY capture",
)
def _(spark, sf):
    return profile.color_stats(view(spark, sf, "points"), "capture")


_VERDICT_SQL = f"""
WITH st AS (SELECT capture, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy,
              avg(z) AS mz, stddev_pop(z) AS sz FROM gaussians GROUP BY capture),
q AS (SELECT g.capture, count(*) AS n,
    avg(CAST({SIG} < 0.1 AS INT)) AS ghost_share, avg(CAST({MAXS} > 1.0 AS INT)) AS large_share,
    avg(CAST({MAXS} < 0.001 AS INT)) AS tiny_share,
    avg(CAST(abs(x - mx) > 5 * sx AS INT)) AS ox, avg(CAST(abs(y - my) > 5 * sy AS INT)) AS oy,
    avg(CAST(abs(z - mz) > 5 * sz AS INT)) AS oz
  FROM gaussians g JOIN st USING (capture) GROUP BY g.capture)
SELECT capture, n, ghost_share, large_share, tiny_share, concat_ws('; ',
    CASE WHEN ghost_share > 0.30 THEN 'high ghost ratio' END, CASE WHEN large_share > 0.05 THEN 'large gaussians' END,
    CASE WHEN tiny_share > 0.10 THEN 'tiny gaussians' END, CASE WHEN ox > 0.01 THEN 'outliers in x' END,
    CASE WHEN oy > 0.01 THEN 'outliers in y' END, CASE WHEN oz > 0.01 THEN 'outliers in z' END) AS issue_text
FROM q"""


@query(
    "quality_verdict",
    "capture n ~ghost_share ~large_share ~tiny_share issue_text healthy",
    "gaussians",
    f"SELECT *, issue_text = '' AS healthy FROM ({_VERDICT_SQL}) v",
)
def _(spark, sf):
    out = profile.quality_verdict(view(spark, sf, "gaussians"), "capture")
    return out.withColumn("issue_text", F.concat_ws("; ", "issues"))


@query(
    "splat_report",
    "capture n ~x_mean ~x_std ~mean_opacity ~median_opacity ~share_opacity_above_5 ~ghost_share ~median_scale "
    "~mean_scale ~large_share ~tiny_share ~volume ~density ~x_outlier_share_3 ~z_outlier_share_5",
    "gaussians",
    f"""WITH st AS (SELECT capture, avg(x) AS mx, stddev_pop(x) AS sx, avg(z) AS mz, stddev_pop(z) AS sz
                    FROM gaussians GROUP BY capture)
        SELECT g.capture, count(*) AS n, any_value(mx) AS x_mean, any_value(sx) AS x_std, avg({SIG}) AS mean_opacity,
          quantile_cont({SIG}, 0.5) AS median_opacity, avg(CAST({SIG} > 0.5 AS INT)) AS share_opacity_above_5,
          avg(CAST({SIG} < 0.1 AS INT)) AS ghost_share, quantile_cont({MAXS}, 0.5) AS median_scale,
          avg({MAXS}) AS mean_scale, avg(CAST({MAXS} > 1.0 AS INT)) AS large_share,
          avg(CAST({MAXS} < 0.001 AS INT)) AS tiny_share,
          (max(x)-min(x)) * (max(y)-min(y)) * (max(z)-min(z)) AS volume,
          count(*) / ((max(x)-min(x)) * (max(y)-min(y)) * (max(z)-min(z))) AS density,
          avg(CAST(abs(x - mx) > 3 * sx AS INT)) AS x_outlier_share_3,
          avg(CAST(abs(z - mz) > 5 * sz AS INT)) AS z_outlier_share_5
        FROM gaussians g JOIN st USING (capture) GROUP BY g.capture""",
)
def _(spark, sf):
    return profile.splat_report(view(spark, sf, "gaussians"), "capture")


@query(
    "compare_clouds",
    "name status n is_splat has_color ~x_span ~y_std ~volume ~density ~mean_opacity ~median_opacity n_above_5 "
    "~ghost_ratio ~red_mean blue_max_int",
    "gaussians points",
    f"""WITH c AS (
          SELECT 'splat' AS name, x, y, z, {SIG} AS op, NULL AS red, NULL AS blue FROM gaussians
          UNION ALL SELECT 'cloud', x, y, z, NULL, red, blue FROM points)
        SELECT name, 'ok' AS status, count(*) AS n, name = 'splat' AS is_splat, name = 'cloud' AS has_color,
          max(x) - min(x) AS x_span, stddev_pop(y) AS y_std,
          (max(x)-min(x)) * (max(y)-min(y)) * (max(z)-min(z)) AS volume,
          count(*) / ((max(x)-min(x)) * (max(y)-min(y)) * (max(z)-min(z))) AS density,
          avg(op) AS mean_opacity, quantile_cont(op, 0.5) AS median_opacity,
          CASE WHEN name = 'splat' THEN count(*) FILTER (op > 0.5) END AS n_above_5,
          avg(CASE WHEN op < 0.1 THEN 1.0 WHEN op >= 0.1 THEN 0.0 END) AS ghost_ratio,
          avg(red) AS red_mean, max(blue) AS blue_max_int
        FROM c GROUP BY name
        UNION ALL SELECT 'gone', 'missing', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""",
)
def _(spark, sf):
    out = profile.compare_clouds(
        {"splat": view(spark, sf, "gaussians"), "cloud": view(spark, sf, "points"), "gone": None}
    )
    return out.withColumn("blue_max_int", F.col("blue_max").cast("int"))


@query(
    "compare_runs",
    "metric ~before ~after ~delta direction",
    "",
    """SELECT event_type AS metric, a AS before, b AS after, b - a AS delta,
         CASE WHEN b > a THEN 'up' WHEN b < a THEN 'down' ELSE 'same' END AS direction
       FROM (SELECT event_type, avg(value) FILTER (user_id % 2 = 0) AS a, avg(value) FILTER (user_id % 2 = 1) AS b
             FROM events GROUP BY event_type) m""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    metrics = e.groupBy(
        F.col("event_type").alias("metric"), F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string")).alias("run")
    ).agg(F.avg("value").alias("value"))
    return profile.compare_runs(metrics, "v0", "v1")


SPLAT_COLS = "capture point_id ~x ~y ~z ~opacity ~scale_0 ~scale_1 ~scale_2"


@query("opacity_prune", SPLAT_COLS, "gaussians", f"SELECT * FROM gaussians WHERE {SIG} >= 0.15")
def _(spark, sf):
    return clip.prune_opacity(view(spark, sf, "gaussians"), 0.15)


def _chain(source: str, k: float, first: str) -> str:
    """Sequential clipping x, y, z with the statistics of the rows still kept."""
    ctes, prev = [f"k0 AS ({first})"], "k0"
    for i, a in enumerate("xyz", 1):
        ctes.append(
            f"k{i} AS (SELECT p.* FROM {prev} p JOIN (SELECT capture, avg({a}) AS m, stddev_pop({a}) AS s "
            f"FROM {prev} GROUP BY capture) t USING (capture) WHERE s = 0 OR abs({a} - m) <= {k} * s)"
        )
        prev = f"k{i}"
    return "WITH " + ",\n".join(ctes)


_PRUNED = f"SELECT * FROM gaussians WHERE {SIG} >= 0.15"


@query("splat_prune", SPLAT_COLS, "gaussians", _chain("gaussians", 5, _PRUNED) + " SELECT * FROM k3")
def splat_prune(spark, sf):
    return clip.prune(view(spark, sf, "gaussians"), 0.15, 5.0, "capture")


@query("sigma_clip_sequential", SPLAT_COLS, "gaussians", _chain("gaussians", 1.5, _PRUNED) + " SELECT * FROM k3")
def _(spark, sf):
    return clip.prune(view(spark, sf, "gaussians"), 0.15, 1.5, "capture")


@query(
    "prune_retention",
    "capture n_in removed_opacity removed_x removed_y removed_z n_kept ~pct_kept",
    "gaussians",
    _chain("gaussians", 2, _PRUNED)
    + """ SELECT capture, n AS n_in, n - n0 AS removed_opacity, n0 - n1 AS removed_x, n1 - n2 AS removed_y,
           n2 - n3 AS removed_z, n3 AS n_kept, n3 * 100.0 / n AS pct_kept
         FROM (SELECT capture, count(*) AS n FROM gaussians GROUP BY capture) a
         JOIN (SELECT capture, count(*) AS n0 FROM k0 GROUP BY capture) b USING (capture)
         JOIN (SELECT capture, count(*) AS n1 FROM k1 GROUP BY capture) c USING (capture)
         JOIN (SELECT capture, count(*) AS n2 FROM k2 GROUP BY capture) d USING (capture)
         JOIN (SELECT capture, count(*) AS n3 FROM k3 GROUP BY capture) e USING (capture)""",
)
def _(spark, sf):
    return clip.prune_report(view(spark, sf, "gaussians"), 0.15, 2.0, "capture")


CLOUD_COLS = "capture point_key ~x ~y ~z red green blue"


def _joint(source: str, k: float) -> str:
    stats = ", ".join(f"avg({a}) AS m{a}, stddev_pop({a}) AS s{a}" for a in "xyz")
    keep = " AND ".join(f"(s{a} = 0 OR abs({a} - m{a}) <= {k} * s{a})" for a in "xyz")
    return f"""SELECT p.* FROM {source} p JOIN (SELECT capture, {stats} FROM {source} GROUP BY capture) t
               USING (capture) WHERE {keep}"""


@query("sigma_clip_joint", CLOUD_COLS, "points", _joint("points", 1.5))
def _(spark, sf):
    return clip.sigma_clip(view(spark, sf, "points"), 1.5, by="capture")


@query(
    "sigma_clip_global",
    CLOUD_COLS,
    "points",
    """SELECT p.* FROM points p CROSS JOIN (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my,
         stddev_pop(y) AS sy, avg(z) AS mz, stddev_pop(z) AS sz FROM points) t
       WHERE abs(x - mx) <= 1.6 * sx AND abs(y - my) <= 1.6 * sy AND abs(z - mz) <= 1.6 * sz""",
)
def _(spark, sf):
    return clip.sigma_clip(view(spark, sf, "points"), 1.6)


def _sample_sql(source: str, k: int, seed: int, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY md5(concat(point_key, ':', '{seed}')), point_key) AS rn
               FROM ({source}) s) q WHERE rn <= {k}"""


@query("sample_exact", CLOUD_COLS, "points", _sample_sql("SELECT * FROM points", 2500, 42))
def _(spark, sf):
    return sample.sample_exact(view(spark, sf, "points"), 2500, "point_key")


@query("sample_exact_per_capture", CLOUD_COLS, "points", _sample_sql("SELECT * FROM points", 300, 7, "capture"))
def _(spark, sf):
    return sample.sample_exact(view(spark, sf, "points"), 300, "point_key", 7, "capture")


@query("cap_per_group", CLOUD_COLS, "points", _sample_sql("SELECT * FROM points", 200, 0, "capture"))
def _(spark, sf):
    return sample.cap_per_group(view(spark, sf, "points"), "capture", 200, "point_key")


_NULL_KEYS = "SELECT capture, CASE WHEN red % 2 = 1 THEN point_key END AS k FROM points"
_KEYS_TAKEN = "count(*) AS n, count(*) - count(k) AS n_null, min(k) AS first_key, max(k) AS last_key"


def _null_keys_sql(seed: int) -> str:
    """Half of the keys are null; they share the digest of an empty key."""
    return f"""SELECT capture, k, row_number() OVER (PARTITION BY capture
      ORDER BY md5(concat(coalesce(k, ''), ':{seed}')), k NULLS FIRST) AS rn FROM ({_NULL_KEYS}) p"""


def _null_keys(spark, sf):
    p = view(spark, sf, "points")
    return p.select("capture", F.when(F.col("red") % 2 == 1, F.col("point_key")).alias("k"))


def _keys_taken(df, *by):
    none = F.count_if(F.col("k").isNull()).alias("n_null")
    return df.groupBy(*by).agg(F.count("*").alias("n"), none, F.min("k").alias("first_key"), F.max("k").alias("last_key"))


@query(
    "sample_exact_null_keys",
    "capture size n n_null first_key last_key",
    "points",
    f"""SELECT capture, size, {_KEYS_TAKEN} FROM ({_null_keys_sql(7)}) q, (VALUES (30), (300), (700)) s(size)
        WHERE rn <= size GROUP BY capture, size""",
)
def _(spark, sf):
    rows = _null_keys(spark, sf)
    parts = [sample.sample_exact(rows, k, "k", 7, "capture").withColumn("size", F.lit(k)) for k in (30, 300, 700)]
    return _keys_taken(jobs.union_clouds(parts), "capture", "size")


@query(
    "cap_per_group_null_keys",
    "capture cap n n_null first_key last_key",
    "points",
    f"""SELECT capture, cap, {_KEYS_TAKEN} FROM ({_null_keys_sql(0)}) q,
          (VALUES ('number', 200), ('column', 200), ('large', 70000)) s(cap, size) WHERE rn <= size GROUP BY capture, cap""",
)
def _(spark, sf):
    rows = _null_keys(spark, sf)
    small = sample.cap_per_group(rows, "capture", 200, "k").withColumn("cap", F.lit("number"))
    column = sample.cap_per_group(rows.withColumn("most", F.lit(200)), "capture", "most", "k").drop("most")
    large = sample.cap_per_group(rows, "capture", 70_000, "k").withColumn("cap", F.lit("large"))
    return _keys_taken(jobs.union_clouds([small, column.withColumn("cap", F.lit("column")), large]), "capture", "cap")


@query("cloud_subsample", CLOUD_COLS, "points", _sample_sql(_joint("points", 1.6), 500, 42, "capture"))
def _(spark, sf):
    return jobs.subsample(view(spark, sf, "points"), 500, 1.6, "point_key", "capture")


_VOXEL = "floor(x / {s}), floor(y / {s}), floor(z / {s})"


@query(
    "voxel_downsample",
    CLOUD_COLS,
    "points",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture, {_VOXEL.format(s=7.5)} ORDER BY point_key) AS rn
        FROM points) q WHERE rn = 1""",
)
def _(spark, sf):
    return voxel.voxel_downsample(view(spark, sf, "points"), 7.5, "capture", "point_key")


_SEARCH = f"""
WITH RECURSIVE walk(step, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) FROM points
  UNION ALL
  SELECT step + 1, CASE WHEN c > {{target}} THEN mid ELSE lo END, CASE WHEN c > {{target}} THEN hi ELSE mid END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
          (SELECT count(*) FROM (SELECT DISTINCT {_VOXEL.format(s='((lo + hi) / 2)')} FROM points) d) AS c
        FROM walk WHERE step < 20) w)
"""


@query(
    "voxel_size_search",
    "~voxel_size",
    "points",
    _SEARCH.format(target=2000) + "SELECT hi AS voxel_size FROM walk WHERE step = 20",
)
def _(spark, sf):
    return voxel.voxel_size_search(view(spark, sf, "points"), 2000)


@query(
    "voxel_to_target",
    CLOUD_COLS,
    "points",
    _SEARCH.format(target=2000)
    + f"""SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY {_VOXEL.format(s='hi')} ORDER BY point_key) AS rn
          FROM points p CROSS JOIN (SELECT hi FROM walk WHERE step = 20) h) q WHERE rn = 1""",
)
def _(spark, sf):
    return voxel.voxel_to_target(view(spark, sf, "points"), 2000, order="point_key")


@query(
    "union_clouds",
    "cloud n ~x_mean n_red",
    "points gaussians",
    """SELECT cloud, count(*) AS n, avg(x) AS x_mean, count(red) AS n_red FROM (
         SELECT 'cloud' AS cloud, x, red FROM points UNION ALL SELECT 'splat', x, NULL FROM gaussians) u GROUP BY cloud""",
)
def _(spark, sf):
    p = view(spark, sf, "points").withColumn("cloud", F.lit("cloud"))
    g = view(spark, sf, "gaussians").withColumn("cloud", F.lit("splat"))
    both = jobs.union_clouds([p, g])
    return both.groupBy("cloud").agg(F.count("*").alias("n"), F.avg("x").alias("x_mean"), F.count("red").alias("n_red"))


@query(
    "merge_splats",
    SPLAT_COLS,
    "gaussians",
    "SELECT * FROM gaussians UNION ALL SELECT * FROM gaussians WHERE opacity > 0",
)
def _(spark, sf):
    g = view(spark, sf, "gaussians")
    return jobs.merge_splats([g, g.where("opacity > 0")])
