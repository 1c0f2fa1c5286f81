"""Registered queries: depth maps, masks, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions import camera, pose
from scanloom.operators import depth, frames, jobs, masks
from scanloom.operators.resample import resample
from scanloom.plans.fixtures import view
from scanloom.plans.queries_frames import INTR_SQL, POSE_SQL
from scanloom.plans.registry import query


def depth_rows(spark, sf, by=("capture",)):
    return depth.rows_from_pixels(view(spark, sf, "depth_px"), by)


def color_rows(spark, sf):
    """A colour for every depth pixel, as raster rows."""
    px = view(spark, sf, "depth_px").selectExpr(
        "capture",
        "frame",
        "v",
        "u",
        "array(CAST((frame * 7 + v) % 256 AS SMALLINT), CAST((v * 11 + u) % 256 AS SMALLINT), "
        "CAST((u * 5 + frame) % 256 AS SMALLINT)) AS rgb",
    )
    packed = F.array_sort(F.collect_list(F.struct("u", "rgb")))
    return px.groupBy("capture", "frame", "v").agg(packed.alias("_p")).select(
        "capture", "frame", "v", F.col("_p")["rgb"].alias("rgb")
    )


RGB_SQL = "(frame * 7 + v) % 256 AS red, (v * 11 + u) % 256 AS green, (u * 5 + frame) % 256 AS blue"
PX = "frame v u ~depth ~conf"


@query("valid_depth", PX, "depth_px", "SELECT * FROM depth_px WHERE depth > 0.05 AND depth < 12")
def _(spark, sf):
    return depth.valid_depth(view(spark, sf, "depth_px"), 12)


@query("min_conf", PX, "depth_px", "SELECT * FROM depth_px WHERE conf >= 0.4")
def _(spark, sf):
    return depth.min_conf(view(spark, sf, "depth_px"))


@query(
    "conf_percentile_cut",
    PX,
    "depth_px",
    """SELECT p.* FROM depth_px p JOIN (SELECT frame, quantile_cont(conf, 0.4) AS cut FROM depth_px GROUP BY frame) c
       USING (frame) WHERE conf >= cut""",
)
def _(spark, sf):
    return depth.conf_percentile_cut(view(spark, sf, "depth_px"), 40)


@query("pixel_stride", PX, "depth_px", "SELECT * FROM depth_px WHERE u % 4 = 0 AND v % 4 = 0")
def _(spark, sf):
    return depth.stride(view(spark, sf, "depth_px"))


@query("rescale_depth", "frame v u ~depth", "depth_px", "SELECT frame, v, u, depth * 1.75 AS depth FROM depth_px")
def _(spark, sf):
    return depth.pixels(depth.rescale_depth(depth_rows(spark, sf, ()), 1.75))


@query(
    "join_points",
    "image_id obs_key ~px ~py ~pz",
    "observations points3d",
    """SELECT image_id, obs_key, p.x AS px, p.y AS py, p.z AS pz FROM observations o
       JOIN points3d p USING (point3d_id) WHERE point3d_id >= 0""",
)
def _(spark, sf):
    return depth.join_points(view(spark, sf, "observations"), view(spark, sf, "points3d"))


TRACK_SQL = f"""SELECT o.capture, o.image_id, obs_key, o.x, o.y, r20 * p.x + r21 * p.y + r22 * p.z + tz AS z_cam
  FROM observations o JOIN points3d p USING (point3d_id) JOIN ({POSE_SQL}) i ON i.image_id = o.image_id
  WHERE point3d_id >= 0"""


@query("projected_depth", "image_id obs_key ~z_cam", "observations points3d images", TRACK_SQL)
def _(spark, sf):
    tracks = depth.join_points(view(spark, sf, "observations"), view(spark, sf, "points3d"))
    poses = pose.w2c(view(spark, sf, "images")).select("image_id", *pose.pose_columns("w2c"))
    return depth.project_z(tracks.join(poses, "image_id"))


SAMPLE_SQL = """SELECT o.*, d.u, d.v, d.depth AS z_model FROM {source} o JOIN depth_px d ON d.frame = o.image_id
  AND d.u = least(greatest(CAST(round_even(o.x, 0) AS BIGINT), 0), 24)
  AND d.v = least(greatest(CAST(round_even(o.y, 0) AS BIGINT), 0), 19)"""


@query(
    "sampled_depth",
    "image_id obs_key u v ~z_model",
    "observations depth_px",
    SAMPLE_SQL.format(source="observations"),
)
def _(spark, sf):
    return depth.sample_depth(view(spark, sf, "observations"), depth_rows(spark, sf, ()))


@query(
    "sampled_depth_invalid",
    "image_id obs_key u v ~z_model",
    "observations depth_px",
    SAMPLE_SQL.format(source="(SELECT * FROM observations WHERE point3d_id % 3 NOT IN (0, 1))"),
)
def _(spark, sf):
    obs = view(spark, sf, "observations")
    x = F.when(F.col("point3d_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("x"))
    y = F.when(F.col("point3d_id") % 3 != 1, F.col("y"))
    return depth.sample_depth(obs.withColumns({"x": x, "y": y}), depth_rows(spark, sf, ()))


PAIR_SQL = f"""SELECT *, z_cam / z_model AS ratio FROM (
  {SAMPLE_SQL.format(source=f"(SELECT * FROM ({TRACK_SQL}) t0 WHERE z_cam > 0.01 AND z_cam < 100)")}) t
  WHERE z_model > 0.05 AND z_model < 30"""
PAIR_VIEWS = "observations points3d images depth_px"


def _pair_inputs(spark, sf):
    return view(spark, sf, "images"), view(spark, sf, "observations")


@query("depth_pairs", "image_id obs_key ~z_cam ~z_model ~ratio", PAIR_VIEWS, PAIR_SQL)
def _(spark, sf):
    images, obs = _pair_inputs(spark, sf)
    return depth.depth_pairs(images, obs, view(spark, sf, "points3d"), depth_rows(spark, sf, ()))


def _scale_sql(cap: int, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    pick = f"{by}, " if by else ""
    return f"""WITH pairs AS ({PAIR_SQL}),
      kept AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5(concat(obs_key, ':', '0')), obs_key) AS rn
        FROM pairs WHERE image_id IN (SELECT image_id FROM pairs GROUP BY image_id HAVING count(*) >= 5))
      SELECT {pick}count(*) AS n_pairs, count(DISTINCT image_id) AS n_images, quantile_cont(ratio, 0.25) AS p25,
        quantile_cont(ratio, 0.5) AS median, quantile_cont(ratio, 0.75) AS p75, stddev_pop(ratio) AS std,
        quantile_cont(ratio, 0.5) AS scale FROM kept WHERE rn <= {cap} {group}"""


SCALE = "n_pairs n_images ~p25 ~median ~p75 ~std ~scale"


@query("depth_scale", SCALE, PAIR_VIEWS, _scale_sql(2000))
def _(spark, sf):
    images, obs = _pair_inputs(spark, sf)
    return depth.depth_scale(images, obs, view(spark, sf, "points3d"), depth_rows(spark, sf, ()))


def _points_per_capture(spark, sf):
    """The sparse points, in each of the four captures."""
    p = view(spark, sf, "points3d")
    return p.withColumn("capture", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3))))


@query(
    "depth_scale_per_capture",
    "capture " + SCALE,
    PAIR_VIEWS,
    f"""SELECT capture, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_images, 0) AS n_images, p25, median, p75, std,
          CASE WHEN n_pairs >= 50 THEN scale END AS scale
        FROM (SELECT DISTINCT capture FROM images) c LEFT JOIN ({_scale_sql(100, "capture")}) s USING (capture)""",
)
def _(spark, sf):
    images, obs = _pair_inputs(spark, sf)
    points, rasters = _points_per_capture(spark, sf), depth_rows(spark, sf)
    return depth.depth_scale(
        images, obs, points, rasters, "capture", min_total=50, max_per_image=100, on_shortage="null"
    )


def posed_frames(spark, sf, by=()):
    """Images with intrinsics and camera-to-world pose; the frame number is the image number."""
    cams = view(spark, sf, "cameras")
    if by:
        cams = cams.withColumn("capture", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3))))
    rows = camera.intrinsics(frames.join_camera(view(spark, sf, "images"), cams, by))
    return pose.invert_rigid(pose.w2c(rows)).withColumn("frame", F.col("image_id"))


# World points of depth pixels; {d} is the depth, {f} the scale of the raster against the camera size.
WORLD_SQL = f"""SELECT d.capture, frame, v, u, {{d}} AS depth, conf, {RGB_SQL},
    r00 * xc + r10 * yc + r20 * zc + c0 AS x, r01 * xc + r11 * yc + r21 * zc + c1 AS y,
    r02 * xc + r12 * yc + r22 * zc + c2 AS z
  FROM (SELECT d.*, p.* EXCLUDE (capture), (u - cx * {{f}}) / (fl_x * {{f}}) * ({{d}}) AS xc,
          (v - cy * {{f}}) / (fl_y * {{f}}) * ({{d}}) AS yc, {{d}} AS zc
        FROM {{source}} d JOIN ({POSE_SQL}) p ON p.image_id = d.frame JOIN ({INTR_SQL}) i USING (camera_id)) d"""
WORLD_VIEWS = "images cameras depth_px"


@query(
    "backproject",
    "frame v u ~x ~y ~z",
    WORLD_VIEWS,
    WORLD_SQL.format(d="depth", f="1.0", source="depth_px") + " WHERE depth > 0.05 AND depth < 12",
)
def _(spark, sf):
    return depth.backproject(depth_rows(spark, sf, ()), posed_frames(spark, sf), 12.0)


@query(
    "backproject_confident",
    "frame v u ~x ~y ~z",
    WORLD_VIEWS,
    f"""SELECT w.* FROM ({WORLD_SQL.format(d="depth", f="1.0", source="depth_px")}) w
        JOIN (SELECT frame, quantile_cont(conf, 0.4) AS cut FROM depth_px GROUP BY frame) c USING (frame)
        WHERE depth > 0.05 AND depth < 12 AND conf >= cut""",
)
def _(spark, sf):
    return depth.backproject(depth_rows(spark, sf, ()), posed_frames(spark, sf), 12.0, conf_pct=40)


@query(
    "depth_to_points",
    "frame v u ~x ~y ~z red green blue",
    WORLD_VIEWS,
    WORLD_SQL.format(d="depth", f="1.0", source="depth_px")
    + " WHERE depth > 0.05 AND depth < 20 AND conf >= 0.4 AND u % 4 = 0 AND v % 4 = 0",
)
def _(spark, sf):
    return depth.depth_to_points(
        depth_rows(spark, sf), posed_frames(spark, sf, ["capture"]), "capture", color_rows(spark, sf)
    )


@query(
    "pixel_colors",
    "frame v u red green blue",
    "depth_px",
    f"SELECT frame, v, u, {RGB_SQL} FROM depth_px WHERE depth > 0.05 AND depth < 12",
)
def _(spark, sf):
    px = depth.valid_depth(view(spark, sf, "depth_px"), 12)
    return depth.attach_color(px, color_rows(spark, sf), "capture")


_AT = "greatest(least((o + 0.5) * {n} / {m} - 0.5, {n} - 1), 0)"


@query(
    "upsample",
    "frame v u ~depth",
    "depth_px",
    f"""WITH cs AS (SELECT o AS u, CAST({_AT.format(n=25, m=61)} AS DOUBLE) AS s FROM range(61) r(o)),
        rs AS (SELECT o AS v, CAST({_AT.format(n=20, m=47)} AS DOUBLE) AS s FROM range(47) r(o)),
        wide AS (SELECT frame, d.v, cs.u, sum(depth * (1 - abs(cs.s - d.u))) AS depth FROM depth_px d
          JOIN cs ON abs(cs.s - d.u) < 1 GROUP BY frame, d.v, cs.u)
        SELECT frame, rs.v, w.u, sum(depth * (1 - abs(rs.s - w.v))) AS depth FROM wide w
          JOIN rs ON abs(rs.s - w.v) < 1 GROUP BY frame, rs.v, w.u""",
)
def _(spark, sf):
    return depth.pixels(depth.upsample(depth_rows(spark, sf, ()), 61, 47))


def photo_rows(spark, sf, width, height):
    """A photograph of the given size for every depth raster, as raster rows."""
    frames_ = view(spark, sf, "depth_px").select("capture", "frame").distinct()
    rows = frames_.withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1))))
    pixel = (
        f"transform(sequence(0, {width - 1}), u -> array(CAST((frame * 7 + v * v * 3) % 256 AS SMALLINT), "
        "CAST((v * 11 + u * u) % 256 AS SMALLINT), CAST((u * 5 + frame * v) % 256 AS SMALLINT))) AS rgb"
    )
    return rows.selectExpr("capture", "frame", "v", pixel)


def _taps_sql(size: int, wanted: int) -> str:
    """Weights (o: output, s: source, w) of a triangle as wide as the coarser of both pixels, normalised."""
    reach = max(size / wanted, 1.0)
    weight = f"1 - abs(s + 0.5 - (o + 0.5) * {size}.0::DOUBLE / {wanted}) / {reach}::DOUBLE"
    inner = f"SELECT o, s, {weight} AS w FROM range({wanted}) a(o), range({size}) b(s) WHERE {weight} > 0"
    return f"SELECT o, s, w / sum(w) OVER (PARTITION BY o) AS w FROM ({inner}) t"


def shrunk_sql(width: int, height: int, new_width: int, new_height: int) -> str:
    """Pixels of the photographs at another size, rounded after each pass."""

    def each(fmt: str) -> str:
        return ", ".join(fmt.format(c=c) for c in ("red", "green", "blue"))

    total = "CAST(floor(sum({c} * w) + 0.5 + 1e-9) AS INT) AS {c}"
    return f"""SELECT frame, y.o AS v, u, {each(total)} FROM (
      SELECT frame, v, x.o AS u, {each(total)} FROM (
        SELECT frame, v, u, (frame * 7 + v * v * 3) % 256 AS red, (v * 11 + u * u) % 256 AS green, (u * 5 + frame * v) % 256 AS blue
        FROM (SELECT DISTINCT frame FROM depth_px) f, range({height}) p(v), range({width}) q(u)) i
      JOIN ({_taps_sql(width, new_width)}) x ON x.s = u GROUP BY frame, v, x.o) h
    JOIN ({_taps_sql(height, new_height)}) y ON y.s = v GROUP BY frame, y.o, u"""


def _color_pixels(rows):
    px = rows.select("frame", "v", F.posexplode("rgb").alias("u", "_c"))
    return px.select("frame", "v", "u", *[F.col("_c")[i].alias(c) for i, c in enumerate(("red", "green", "blue"))])


@query("color_resample_down", "frame v u red green blue", "depth_px", shrunk_sql(50, 40, 17, 9))
def _(spark, sf):
    return _color_pixels(resample(photo_rows(spark, sf, 50, 40), (17, 9), "capture", "rgb"))


@query("color_resample_mixed", "frame v u red green blue", "depth_px", shrunk_sql(50, 40, 23, 61))
def _(spark, sf):
    return _color_pixels(resample(photo_rows(spark, sf, 50, 40), (23, 61), "capture", "rgb"))


@query(
    "depth_resample_down",
    "frame v u ~depth",
    "depth_px",
    f"""SELECT frame, y.o AS v, u, sum(depth * w) AS depth FROM (
          SELECT frame, v, x.o AS u, sum(depth * w) AS depth FROM depth_px JOIN ({_taps_sql(25, 11)}) x ON x.s = u GROUP BY frame, v, x.o) h
        JOIN ({_taps_sql(20, 7)}) y ON y.s = v GROUP BY frame, y.o, u""",
)
def _(spark, sf):
    return depth.pixels(resample(depth_rows(spark, sf, ()).drop("conf"), (11, 7)))


def _fused(spark, sf, by, skip=None, **options):
    images = view(spark, sf, "images")
    cams = view(spark, sf, "cameras")
    pts = view(spark, sf, "points3d")
    if by:
        cams = cams.withColumn("capture", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3))))
        pts = _points_per_capture(spark, sf)
    return jobs.fuse_depth(
        images,
        cams,
        depth_rows(spark, sf),
        view(spark, sf, "observations").where(F.col("capture") != (-1 if skip is None else skip)),
        pts,
        color_rows(spark, sf),
        by,
        target=400,
        sigma=1.5,
        min_total=50,
        oversample=OVERSAMPLE,
        on_shortage="null",
        **options,
    )


# Most images have no depth here, so the others may keep more.
OVERSAMPLE = 100
FUSE_SQL = f"""
WITH RECURSIVE pairs AS ({PAIR_SQL}),
kept AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5(concat(obs_key, ':', '0')), obs_key) AS rn
  FROM pairs WHERE image_id IN (SELECT image_id FROM pairs GROUP BY image_id HAVING count(*) >= 5)),
sc AS (SELECT capture, CASE WHEN n_pairs >= 50 {{skip}} THEN scale END AS scale,
  CASE WHEN true {{skip}} THEN coalesce(n_pairs, 0) ELSE 0 END AS n_pairs
  FROM (SELECT DISTINCT capture FROM images) c LEFT JOIN (
    SELECT capture, quantile_cont(ratio, 0.5) AS scale, count(*) AS n_pairs FROM kept WHERE rn <= 2000 GROUP BY capture) k USING (capture)),
scaled AS (SELECT d.* EXCLUDE (depth), depth * scale AS depth, scale FROM depth_px d JOIN sc USING (capture)),
n AS (SELECT capture, greatest(1, ({OVERSAMPLE} * 400) // count(*)) AS cap FROM images GROUP BY capture),
world AS (SELECT w.* EXCLUDE (x, y, z), CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y,
    CAST(CAST(z AS FLOAT) AS DOUBLE) AS z, (frame * 65536 + v) * 65536 + u AS point_id
  FROM ({WORLD_SQL.format(d="depth", f="1.0", source="scaled")}) w JOIN sc USING (capture)
  WHERE depth > 0.05 * scale AND depth < 12 * scale),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY md5(concat(point_id, ':', '0')), point_id) AS rk
  FROM world) r JOIN n USING (capture) WHERE rk <= cap),
st AS (SELECT capture, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy, avg(z) AS mz,
  stddev_pop(z) AS sz FROM capped GROUP BY capture),
clipped AS (SELECT c.* FROM capped c JOIN st USING (capture)
  WHERE abs(x - mx) <= 1.5 * sx AND abs(y - my) <= 1.5 * sy AND abs(z - mz) <= 1.5 * sz),
box AS (SELECT capture, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max,
  min(z) AS z_min, max(z) AS z_max FROM clipped GROUP BY capture),
walk(capture, step, lo, hi) AS (
  SELECT capture, 0, CAST(0 AS DOUBLE), greatest(x_max - x_min, y_max - y_min, z_max - z_min) FROM box WHERE n > 400
  UNION ALL
  SELECT capture, step + 1, CASE WHEN c > 400 THEN mid ELSE lo END, CASE WHEN c > 400 THEN hi ELSE mid END
  FROM (SELECT w.capture, w.step, any_value(w.lo) AS lo, any_value(w.hi) AS hi, any_value((w.lo + w.hi) / 2) AS mid,
          count(DISTINCT (floor(x / ((w.lo + w.hi) / 2)), floor(y / ((w.lo + w.hi) / 2)), floor(z / ((w.lo + w.hi) / 2)))) AS c
        FROM walk w JOIN clipped p ON p.capture = w.capture WHERE w.step < 20 GROUP BY w.capture, w.step) m)
"""
FUSE_VIEWS = "observations points3d images cameras depth_px"


@query(
    "depth_fusion",
    "capture point_id ~x ~y ~z red green blue",
    FUSE_VIEWS,
    FUSE_SQL.format(skip="")
    + """SELECT * FROM (
      SELECT c.*, hi, row_number() OVER (PARTITION BY c.capture, CASE WHEN hi IS NULL THEN point_id END,
        floor(x / hi), floor(y / hi), floor(z / hi) ORDER BY point_id) AS one
      FROM clipped c LEFT JOIN (SELECT capture, hi FROM walk WHERE step = 20) h USING (capture)) q WHERE one = 1""",
)
def _(spark, sf):
    return _fused(spark, sf, "capture").cloud


@query(
    "fusion_bounds",
    "capture ~x_min ~x_max ~y_min ~y_max ~z_min ~z_max ~scale_factor scale_aligned n_pairs",
    FUSE_VIEWS,
    FUSE_SQL.format(skip="")
    + """SELECT capture, x_min, x_max, y_min, y_max, z_min, z_max, scale AS scale_factor, true AS scale_aligned, n_pairs
         FROM sc LEFT JOIN box USING (capture)""",
)
def _(spark, sf):
    return _fused(spark, sf, "capture").bounds.withColumn("n_pairs", F.col("scale_info.n_pairs"))


@query(
    "fusion_with_short_capture",
    "capture ~x_min ~z_max ~scale_factor n_pairs",
    FUSE_VIEWS,
    FUSE_SQL.format(skip="AND capture <> 3")
    + "SELECT capture, x_min, z_max, scale AS scale_factor, n_pairs FROM sc LEFT JOIN box USING (capture)",
)
def _(spark, sf):
    fused = _fused(spark, sf, "capture", skip=3)
    return fused.bounds.withColumn("n_pairs", F.col("scale_info.n_pairs"))


@query(
    "merged_depth_cloud",
    "capture point_id ~x ~y ~z red green blue",
    WORLD_VIEWS,
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY md5(concat(point_id, ':', '0'))) AS rn FROM (
          SELECT capture, (frame * 65536 + v) * 65536 + u AS point_id, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y,
            CAST(z AS FLOAT) AS z, red, green, blue
          FROM ({WORLD_SQL.format(d="depth", f="0.5", source="depth_px")}) w
          WHERE depth > 0.05 AND depth < 20 AND conf >= 0.4 AND u % 2 = 0 AND v % 2 = 0) p) q WHERE rn <= 150""",
)
def _(spark, sf):
    # Cameras twice the raster size, so the intrinsics are halved.
    fr = posed_frames(spark, sf, ["capture"]).withColumns({"width": F.lit(50), "height": F.lit(40)})
    return jobs.build_init_cloud(
        depth_rows(spark, sf), fr, color_rows(spark, sf), "capture", step=2, max_points=150
    )


@query(
    "merged_depth_cloud_resampled",
    "capture point_id ~x ~y ~z red green blue",
    WORLD_VIEWS,
    f"""SELECT capture, (frame * 65536 + v) * 65536 + u AS point_id, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y,
          CAST(z AS FLOAT) AS z, c.red, c.green, c.blue
        FROM ({WORLD_SQL.format(d="depth", f="0.5", source="depth_px")}) w JOIN ({shrunk_sql(50, 40, 25, 20)}) c USING (frame, v, u)
        WHERE depth > 0.05 AND depth < 20 AND conf >= 0.4 AND u % 2 = 0 AND v % 2 = 0""",
)
def _(spark, sf):
    # Photographs of twice the size of the depth rasters.
    fr = posed_frames(spark, sf, ["capture"]).withColumns({"width": F.lit(50), "height": F.lit(40)})
    return jobs.build_init_cloud(depth_rows(spark, sf), fr, photo_rows(spark, sf, 50, 40), "capture", step=2, max_points=None)


# Masks: three consecutive frames are the candidate masks of one image, confidences are their probabilities.
MASK_SQL = """SELECT concat('m', frame // 3) AS image, frame % 3 AS candidate, ((frame * 13) % 7) / 7.0 AS score,
  v, u, conf > 0.5 AS bit FROM depth_px"""
BEST_SQL = f"""SELECT m.* FROM ({MASK_SQL}) m JOIN (SELECT image, candidate FROM (
  SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, candidate) AS rn
  FROM (SELECT DISTINCT image, candidate, score FROM ({MASK_SQL}) a) b) c WHERE rn = 1) k USING (image, candidate)"""


def mask_rows(spark, sf):
    rows = depth_rows(spark, sf, ())
    return rows.selectExpr(
        "concat('m', CAST(frame div 3 AS string)) AS image",
        "frame % 3 AS candidate",
        "((frame * 13) % 7) / 7D AS score",
        "v",
        "conf AS bits",
    )


def _bits(rows, *extra):
    """Set pixels as rows."""
    return rows.select("image", *extra, "v", F.posexplode("bits").alias("u", "bit"))


@query("mask_binarize", "image candidate v u bit", "depth_px", MASK_SQL)
def _(spark, sf):
    return _bits(masks.binarize(mask_rows(spark, sf)), "candidate")


@query("mask_best", "image candidate v u bit", "depth_px", BEST_SQL)
def _(spark, sf):
    return _bits(masks.best_mask(masks.binarize(mask_rows(spark, sf))), "candidate")


@query(
    "mask_best_with_fallback",
    "image candidate v u bit",
    "depth_px",
    f"""SELECT m.* FROM ({MASK_SQL}) m JOIN (
          SELECT image, CASE WHEN best > last THEN first ELSE best END AS candidate FROM (
            SELECT image, arg_max(candidate + 1, score - candidate / 100.0) AS best, max(candidate) AS last,
              min(candidate) AS first FROM (SELECT DISTINCT image, candidate, score FROM ({MASK_SQL}) a) b GROUP BY image) c) k
        USING (image, candidate)""",
)
def _(spark, sf):
    # Scores are numbered one higher than the masks, so the highest may have no mask.
    rows = mask_rows(spark, sf)
    scores = rows.selectExpr("image", "candidate + 1 AS candidate", "score - candidate / 100D AS score").distinct()
    return _bits(masks.pick_mask(masks.binarize(rows), scores), "candidate")


@query(
    "mask_union",
    "image v u bit",
    "depth_px",
    f"SELECT image, v, u, bool_or(bit) AS bit FROM ({MASK_SQL}) m GROUP BY image, v, u",
)
def _(spark, sf):
    return _bits(masks.union_mask(masks.binarize(mask_rows(spark, sf))))


@query(
    "mask_coverage",
    "image n_set n_pixels ~coverage_pct",
    "depth_px",
    f"""SELECT image, count(*) FILTER (bit) AS n_set, count(*) AS n_pixels, count(*) FILTER (bit) * 100.0 / count(*) AS coverage_pct
        FROM ({BEST_SQL}) m GROUP BY image""",
)
def _(spark, sf):
    return masks.mask_coverage(masks.best_mask(masks.binarize(mask_rows(spark, sf))))


def _erode_sql(reach: int) -> str:
    return f"""SELECT a.image, a.v, a.u, bool_and(b.bit) AS bit FROM ({BEST_SQL}) a JOIN ({BEST_SQL}) b ON a.image = b.image
      AND b.v BETWEEN a.v - {reach} AND a.v + {reach} AND b.u BETWEEN a.u - {reach} AND a.u + {reach} GROUP BY a.image, a.v, a.u"""


@query("mask_erode", "image v u bit", "depth_px", _erode_sql(1))
def _(spark, sf):
    return _bits(masks.erode(masks.best_mask(masks.binarize(mask_rows(spark, sf))), 3))


@query("mask_erode_5", "image v u bit", "depth_px", _erode_sql(2))
def _(spark, sf):
    return _bits(masks.erode(masks.best_mask(masks.binarize(mask_rows(spark, sf))), 5))


BLANK_SQL = """SELECT concat('m', image_id) AS image, v, u, false AS bit FROM images CROSS JOIN range(4) r(v) CROSS JOIN range(6) c(u)
  WHERE concat('m', image_id) NOT IN (SELECT concat('m', frame // 3) FROM depth_px)"""


def _mask_images(spark, sf):
    return view(spark, sf, "images").selectExpr(
        "concat('m', CAST(image_id AS string), '.jpg') AS image", "6 AS width", "4 AS height"
    )


@query(
    "mask_fill_blank",
    "image v u bit",
    "depth_px images",
    f"SELECT image, v, u, bit FROM ({BEST_SQL}) b UNION ALL {BLANK_SQL}",
)
def _(spark, sf):
    best = masks.best_mask(masks.binarize(mask_rows(spark, sf)))
    return _bits(masks.fill_blank_masks(_mask_images(spark, sf), best))


@query(
    "mask_job",
    "image v u bit",
    "depth_px images",
    f"{_erode_sql(1)} UNION ALL {BLANK_SQL}",
)
def _(spark, sf):
    return _bits(jobs.mask_job(mask_rows(spark, sf), _mask_images(spark, sf)).masks)


@query(
    "frame_scores",
    "frame v ~prediction",
    "depth_px",
    "SELECT frame, v, avg(depth) * 2 + 1 AS prediction FROM depth_px GROUP BY frame, v",
)
def _(spark, sf):
    def load_model():
        weight, bias = 2.0, 1.0

        def predict(batch):
            return batch.mean(axis=1) * weight + bias

        return predict

    rows = depth_rows(spark, sf, ())
    return jobs.score_frames(rows, load_model, ["depth"], T.DoubleType(), input_tensor_shapes=[[25]])
