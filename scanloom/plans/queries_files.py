"""Registered queries: tables written to the binary formats and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scanloom import sources
from scanloom.operators import frames, jobs, profile
from scanloom.operators.clip import prune
from scanloom.plans import materialize
from scanloom.plans.fixtures import view
from scanloom.plans.queries_depth import FUSE_SQL, FUSE_VIEWS, _fused, color_rows, depth_rows
from scanloom.plans.queries_frames import COUNTS_SQL, FRAME_SQL, _captured_cameras, model_frames
from scanloom.plans.queries_splat import SPLAT_COLS, _PRUNED, _chain
from scanloom.plans.registry import query
from scanloom.plans.stage import new_path, stage
from scanloom.sources import captures, documents, images, npy, ply, sparse_model, xmp
from scanloom.sources.chunks import write_chunks

#: Rows of a point file of the catalogue, about.
_FILE_ROWS = 1_000_000
F32 = "CAST(CAST({0} AS FLOAT) AS DOUBLE)"
XYZ32 = ", ".join(f"{F32.format(a)} AS {a}" for a in "xyz")


@query("ply_colored_round_trip", "~x ~y ~z red green blue", "points", f"SELECT {XYZ32}, red, green, blue FROM points")
def _(spark, sf):
    sources.register(spark)
    path = new_path(spark, "ply")
    ply.write_ply_rgb(view(spark, sf, "points"), path)
    return spark.read.format("ply").option("splitBytes", 100_000).load(path)


@query(
    "ply_pruned_round_trip",
    "~x ~y ~z ~opacity ~scale_0",
    "gaussians",
    _chain("gaussians", 5, _PRUNED) + " SELECT * FROM k3",
)
def _(spark, sf):
    sources.register(spark)
    path = new_path(spark, "ply")
    ply.write_ply(prune(view(spark, sf, "gaussians"), by="capture").drop("capture"), path)
    return spark.read.format("ply").load(path).select("x", "y", "z", "opacity", "scale_0")


def _splat_files(spark, sf) -> str:
    """A splat file per capture."""
    sources.register(spark)
    path = new_path(spark, "splats")
    name = F.concat(F.lit("capture="), F.col("capture").cast("string"), F.lit("/splat.ply"))
    g = view(spark, sf, "gaussians")
    captures.write_captures(g.select("capture", *[c for c in g.columns if c != "capture"]).withColumn("label", F.col("point_id")), path, name)
    return path


@query(
    "prune_files_per_capture",
    "capture point_id ~x ~y ~z ~opacity ~scale_0 ~scale_1 ~scale_2",
    "gaussians",
    _chain("gaussians", 5, _PRUNED) + " SELECT * FROM k3",
)
def _(spark, sf):
    source, target = _splat_files(spark, sf), new_path(spark, "pruned")
    jobs.prune_captures(spark, source, target, records_per_file=20)
    rows = spark.read.format("ply").load(target)
    own = F.regexp_extract("path", r"capture=(\d+)/splat[-0-9]*\.ply$", 1).cast("int")
    return rows.withColumn("capture", own).withColumn("point_id", F.col("label"))


@query(
    "prune_files_retention",
    "name n_source n_kept ~pct_kept",
    "gaussians",
    _chain("gaussians", 2, _PRUNED)
    + """ SELECT concat('capture=', capture, '/splat.ply') AS name, n AS n_source, coalesce(k, 0) AS n_kept,
            coalesce(k, 0) * 100.0 / n AS pct_kept
          FROM (SELECT capture, count(*) AS n FROM gaussians GROUP BY capture) a
          LEFT JOIN (SELECT capture, count(*) AS k FROM k3 GROUP BY capture) b USING (capture)""",
)
def _(spark, sf):
    return jobs.prune_captures(spark, _splat_files(spark, sf), new_path(spark, "pruned"), sigma=2.0)


@query(
    "ply_catalog",
    "format n n_properties has_color has_normals is_splat",
    "points",
    """SELECT 'binary_little_endian' AS format, count(*) AS n, 6 AS n_properties, true AS has_color, false AS has_normals,
         false AS is_splat FROM points""",
)
def _(spark, sf):
    sources.register(spark)
    path = new_path(spark, "ply")
    cloud = view(spark, sf, "points")
    ply.write_ply_rgb(cloud.repartition(max(4, -(-cloud.count() // _FILE_ROWS))), path)
    names = [p for p, _ in ply.list_inputs(path, ".ply")]
    found = ply.ply_catalog(spark, names)
    return found.groupBy("format", "n_properties", "has_color", "has_normals", "is_splat").agg(
        F.sum("vertex_count").alias("n")
    )


@query(
    "ply_merge",
    SPLAT_COLS,
    "gaussians",
    "SELECT * FROM gaussians UNION ALL SELECT * FROM gaussians WHERE opacity > 1",
)
def _(spark, sf):
    sources.register(spark)
    g = view(spark, sf, "gaussians").withColumnRenamed("point_id", "label")
    paths = [new_path(spark, "ply"), new_path(spark, "ply")]
    for path, part in zip(paths, (g, g.where("opacity > 1"))):
        ply.write_ply(part, path)
    merged = jobs.merge_splats([spark.read.format("ply").load(p).drop("path", "point_id") for p in paths])
    return merged.withColumnRenamed("label", "point_id")


@query(
    "ply_compare",
    "name status n ~x_min ~x_max ~z_mean",
    "points",
    f"""SELECT name, 'ok' AS status, count(*) AS n, min(x) AS x_min, max(x) AS x_max, avg(z) AS z_mean FROM (
          SELECT CASE WHEN capture < 4 THEN 'low' ELSE 'high' END AS name, {XYZ32} FROM points) p GROUP BY name
        UNION ALL SELECT 'absent', 'missing', NULL, NULL, NULL, NULL""",
)
def _(spark, sf):
    sources.register(spark)
    clouds = {}
    p = view(spark, sf, "points")
    for name, part in (("low", p.where("capture < 4")), ("high", p.where("capture >= 4"))):
        path = new_path(spark, "ply")
        ply.write_ply_rgb(part, path)
        clouds[name] = spark.read.format("ply").load(path)
    return profile.compare_clouds({**clouds, "absent": None})


def _unlike_files(spark, sf) -> str:
    """A folder per capture of points and of splats: coloured clouds and splats side by side."""
    sources.register(spark)
    path = new_path(spark, "unlike")
    name = F.concat(F.col("capture").cast("string"), F.lit("/points.ply"))
    cloud = view(spark, sf, "points").select("capture", *[F.col(a).cast("float").alias(a) for a in "xyz"], "red", "green", "blue")
    captures.write_captures(cloud, f"{path}/cloud", name, order=("x", "y", "z"))
    splat = view(spark, sf, "gaussians").select("capture", *[F.col(c).cast("float").alias(c) for c in (*"xyz", "opacity")])
    captures.write_captures(splat, f"{path}/splat", name, order=("x", "y", "z"))
    return path


@query(
    "ply_compare_files",
    "name status n has_color is_splat ~x_min ~x_max ~z_mean ~red_mean ~mean_opacity n_above_5",
    "points gaussians",
    f"""SELECT concat('cloud ', capture) AS name, 'ok' AS status, count(*) AS n, true AS has_color, false AS is_splat, min(x) AS x_min,
          max(x) AS x_max, avg(z) AS z_mean, avg(red) AS red_mean, CAST(NULL AS DOUBLE) AS mean_opacity, CAST(NULL AS BIGINT) AS n_above_5
        FROM (SELECT capture, red, {XYZ32} FROM points) p GROUP BY capture
        UNION ALL SELECT concat('splat ', capture), 'ok', count(*), false, true, min(x), max(x), avg(z), NULL,
          avg(1 / (1 + exp(-o))), count(*) FILTER (1 / (1 + exp(-o)) > 0.5)
        FROM (SELECT capture, {F32.format('opacity')} AS o, {XYZ32} FROM gaussians) g GROUP BY capture
        UNION ALL SELECT 'absent', 'missing', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""",
)
def _(spark, sf):
    path = _unlike_files(spark, sf)
    files = {"absent": f"{path}/absent.ply"}
    for p, _ in ply.list_inputs(path, ".ply"):
        kind, capture = p.split("/")[-3:-1]
        files[f"{kind} {capture}"] = p.rpartition("/")[0]
    return jobs.compare_files(spark, files)


@query(
    "ply_merge_files",
    "capture is_splat ~x ~y ~z red ~opacity",
    "points gaussians",
    f"""SELECT capture, false AS is_splat, {XYZ32}, red, CAST(NULL AS DOUBLE) AS opacity FROM points
        UNION ALL SELECT capture, true, {XYZ32}, NULL, {F32.format('opacity')} FROM gaussians""",
)
def _(spark, sf):
    rows = jobs.merge_files(spark, _unlike_files(spark, sf), strict=False)
    capture = F.regexp_extract("path", r"/(\d+)/[^/]+$", 1).cast("int").alias("capture")
    return rows.select(capture, F.col("path").contains("/splat/").alias("is_splat"), "x", "y", "z", "red", "opacity")


@query(
    "npy_two_captures",
    "capture frame v u ~depth",
    "depth_px",
    f"""SELECT capture, concat('img_', dense_rank() OVER (PARTITION BY capture ORDER BY frame)) AS frame, v, u,
          {F32.format('depth')} AS depth FROM depth_px""",
)
def _(spark, sf):
    sources.register(spark)
    path, rows = new_path(spark, "npy"), depth_rows(spark, sf)
    nth = F.row_number().over(Window.partitionBy("capture").orderBy("frame"))
    shared = rows.select("capture", "frame").distinct().withColumn("shared", F.concat(F.lit("img_"), nth.cast("string")))
    rows = rows.join(shared, ["capture", "frame"]).drop("frame").withColumnRenamed("shared", "frame")
    npy.write_rasters(rows, path, by=("capture",)).count()
    read = spark.read.format("npy_raster").load(path)
    capture = F.regexp_extract("path", r"capture=(\d+)/", 1).cast("int").alias("capture")
    return read.select(capture, "frame", "v", F.posexplode("depth").alias("u", "depth"))


@query("npy_round_trip", "frame v u ~depth", "depth_px", f"SELECT CAST(frame AS varchar) AS frame, v, u, {F32.format('depth')} AS depth FROM depth_px")
def _(spark, sf):
    sources.register(spark)
    path = new_path(spark, "npy")
    npy.write_rasters(depth_rows(spark, sf, ()), path).count()
    rows = spark.read.format("npy_raster").option("splitBytes", 900).load(path)
    return rows.select("frame", "v", F.posexplode("depth").alias("u", "depth"))


@query(
    "image_round_trip",
    "frame v u red green blue",
    "depth_px",
    """SELECT CAST(frame AS varchar) AS frame, v, u, (frame * 7 + v) % 256 AS red, (v * 11 + u) % 256 AS green,
         (u * 5 + frame) % 256 AS blue FROM depth_px""",
)
def _(spark, sf):
    path = new_path(spark, "png")
    materialize.write_images(path, color_rows(spark, sf))
    px = images.read_color_rows(spark, path).select("frame", "v", F.posexplode("rgb").alias("u", "rgb"))
    return px.select("frame", "v", "u", *[F.col("rgb")[i].alias(c) for i, c in enumerate(("red", "green", "blue"))])


def _model(spark, sf) -> str:
    """Model binaries of the four captures, made from the views."""
    sources.register(spark)
    path = new_path(spark, "model")
    pts = view(spark, sf, "points3d").selectExpr(
        "*",
        "point3d_id % 4 AS capture",
        "point3d_id % 256 AS r",
        "point3d_id % 255 AS g",
        "point3d_id % 254 AS b",
    )
    materialize.write_model(
        path, _captured_cameras(spark, sf), view(spark, sf, "images"), view(spark, sf, "observations"), pts
    )
    return path


def _capture():
    return F.regexp_extract("path", r"capture=(\d+)", 1).cast("int").alias("capture")


@query(
    "model_cameras",
    "capture camera_id model_id width height ~p0 n_params",
    "cameras",
    """SELECT capture, camera_id, model_id, width, height, params[1] AS p0, [3, 4, 4, 5, 8][model_id + 1] AS n_params
       FROM cameras CROSS JOIN range(4) r(capture)""",
)
def _(spark, sf):
    cams = sparse_model.read_cameras(spark, _model(spark, sf))
    return cams.select("*", _capture(), F.col("params")[0].alias("p0"), F.size("params").alias("n_params"))


@query("model_images", "capture image_id camera_id name ~qw ~qz ~tx ~tz", "images", "SELECT * FROM images")
def _(spark, sf):
    from scanloom.functions.pose import unpack_pose

    return unpack_pose(sparse_model.read_images(spark, _model(spark, sf))).select("*", _capture())


@query(
    "model_observations",
    "capture image_id idx ~x ~y point3d_id",
    "observations images",
    """SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY o.image_id ORDER BY obs_key, o.x, o.y) - 1 AS idx
       FROM observations o JOIN images USING (image_id)) q WHERE point3d_id >= 0""",
)
def _(spark, sf):
    path = _model(spark, sf)
    obs = spark.read.format("sparse_model").options(table="observations", splitBytes="100000").load(path)
    return obs.select("*", _capture())


@query(
    "model_points",
    "capture point3d_id ~x ~y ~z r g b",
    "points3d",
    """SELECT *, point3d_id % 4 AS capture, point3d_id % 256 AS r, point3d_id % 255 AS g, point3d_id % 254 AS b
       FROM points3d""",
)
def _(spark, sf):
    return sparse_model.read_points3d(spark, _model(spark, sf)).select("*", _capture())


@query(
    "sparse_cloud_export",
    "~x ~y ~z red green blue",
    "points3d",
    f"SELECT {XYZ32}, point3d_id % 256 AS red, point3d_id % 255 AS green, point3d_id % 254 AS blue FROM points3d",
)
def _(spark, sf):
    pts = sparse_model.read_points3d(spark, _model(spark, sf))
    path = new_path(spark, "ply")
    ply.write_ply_rgb(pts.withColumnsRenamed({"r": "red", "g": "green", "b": "blue"}), path)
    return spark.read.format("ply").load(path)


def _sidecar_stems(spark, sf, *folders):
    """Sidecars, some broken, with their place as ``stem``.

    A name holds five digits. Images that share one lie in folders by the rest of their number, so each has a file.
    """
    from scanloom.plans.queries_frames import _sidecars

    rest = F.expr("nullif(substring(CAST(image_id AS string), 6), '')")
    cars = _sidecars(spark, sf).withColumn("broken", F.expr("position[0] > 1"))
    return cars.withColumn("stem", F.concat_ws("/", rest, *folders, "stem"))


@query(
    "sidecar_files",
    "stem ~fl35 ~ppu ~ppv ~r1 ~t2 rejected",
    "images",
    """SELECT replace(name, '.jpg', '') AS stem, CASE WHEN ok THEN 20 + image_id % 30 END AS fl35,
         CASE WHEN ok THEN (image_id % 11 - 5) / 100.0 END AS ppu, CASE WHEN ok THEN (image_id % 7 - 3) / 100.0 END AS ppv,
         CASE WHEN ok THEN qx END AS r1, CASE WHEN ok THEN tz END AS t2, NOT ok AS rejected
       FROM (SELECT *, tx <= 1 AS ok FROM images) i""",
)
def _(spark, sf):
    path = new_path(spark, "xmp")
    materialize.write_sidecars(path, _sidecar_stems(spark, sf))
    read = xmp.read_xmp(spark, path)
    return read.select(
        "*", F.col("rotation")[1].alias("r1"), F.col("position")[2].alias("t2"), F.col("error").isNotNull().alias("rejected")
    )


@query(
    "sidecar_documents_per_capture",
    "capture n_sidecars n_without_image n_rejected n_frames ~fl_x ~cx_sum",
    "images",
    COUNTS_SQL,
)
def _(spark, sf):
    from scanloom.plans.queries_frames import _image_files

    path = new_path(spark, "captures")
    materialize.write_sidecars(path, _sidecar_stems(spark, sf, F.col("capture").cast("string"), F.lit("xmp")))
    there = frames.registered_frames(view(spark, sf, "images"), _image_files(spark, sf), "capture")
    empty = there.select("capture", "name").distinct().select(
        F.concat(F.lit(f"{path}/"), F.concat_ws("/jpg/", "capture", "name")).alias("path"),
        F.lit(0).alias("seq"),
        F.col("name").cast("binary").alias("content"),
    )
    write_chunks(empty).count()
    done = stage(jobs.sidecar_documents(spark, path, path, f"{path}/out", 3024, 4032), "done")
    read = spark.read.schema("fl_x double, frames array<struct<cx: double>>").json(f"{path}/out/*/*.json", multiLine=True)
    read = read.select(
        F.regexp_extract(F.input_file_name(), "capture=([^/]+)", 1).alias("capture"),
        "fl_x",
        F.expr(
            "aggregate(frames.cx, CAST(0 AS DECIMAL(30, 6)), "
            "(a, b) -> CAST(a + CAST(b AS DECIMAL(18, 6)) AS DECIMAL(30, 6)))"
        ).alias("cx_sum"),
    )
    return done.join(read, "capture", "left").withColumn("capture", F.col("capture").cast("long"))


_FRAME_JSON = (
    "file_path string, transform_matrix array<array<double>>, fl_x double, fl_y double, cx double, cy double, "
    "w long, h long, depth_file_path string, k1 double, k2 double, p1 double, p2 double"
)


@query(
    "frame_documents",
    "capture file_path ~fl_x ~cy w depth_file_path ~k1 ~p2 ~m00 ~m13 has_lens",
    "images cameras",
    f"SELECT *, k1 IS NOT NULL AS has_lens FROM ({FRAME_SQL}) f",
)
def _(spark, sf):
    path = new_path(spark, "transforms")
    header = frames.model_header(view(spark, sf, "images"), _captured_cameras(spark, sf), "capture")
    documents.write_transforms(model_frames(spark, sf), header, path, "capture", "da3_init.ply")
    lines = spark.read.text(path).where(F.col("value").contains('"transform_matrix"'))
    parsed = lines.select(
        F.col("capture").cast("long").alias("capture"),
        F.from_json(F.regexp_replace("value", "^,", ""), _FRAME_JSON).alias("f"),
        F.col("value").contains('"k1"').alias("has_lens"),
    )
    m = F.col("transform_matrix")
    return parsed.select("capture", "f.*", "has_lens").withColumns({"m00": m[0][0], "m13": m[1][3]})


@query(
    "bounds_documents",
    "capture ~x_min ~z_max ~scale_factor scale_aligned n_pairs",
    FUSE_VIEWS,
    FUSE_SQL.format(skip="")
    + "SELECT capture, x_min, z_max, scale AS scale_factor, true AS scale_aligned, n_pairs FROM sc LEFT JOIN box USING (capture)",
)
def _(spark, sf):
    path = new_path(spark, "bounds")
    documents.write_bounds(_fused(spark, sf, "capture").bounds, path, "capture")
    out = documents.read_bounds(spark, path)
    return out.select(
        F.col("capture").cast("long").alias("capture"),
        "x_min",
        "z_max",
        F.col("scale_factor_da3_to_colmap").alias("scale_factor"),
        "scale_aligned",
        F.col("scale_info.n_pairs").alias("n_pairs"),
    )
