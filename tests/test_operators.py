"""Operators against brute force on small tables, edge cases included."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.functions import activation, camera, names, pose
from scanloom.operators import catalog, clip, depth, frames, jobs, masks, profile, sample, voxel
from scanloom.operators.resample import resample

RNG = np.random.default_rng(5)


def cloud(spark, xyz, **extra):
    cols = ["point_id", "x", "y", "z", *extra]
    rows = [(i, *map(float, p), *[extra[e][i] for e in extra]) for i, p in enumerate(xyz)]
    kinds = "point_id long, x double, y double, z double" + "".join(f", {e} double" for e in extra)
    return spark.createDataFrame(rows, kinds) if rows else spark.createDataFrame([], kinds).select(*cols)


@pytest.fixture(scope="module")
def xyz():
    return RNG.normal(size=(3000, 3)) * [1, 4, 0.2] + [10, 0, -3]


def test_percentiles_refine_through_levels(spark):
    values = np.concatenate([RNG.normal(size=4000), 500000 + RNG.normal(size=3000) * 1e-3, [1e300, -1e300, 0.0, -0.0]])
    df = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(values)], "g int, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}
    for row in profile.percentiles(df, {"v": "v"}, probs, "g", small_bucket=20).collect():
        group = values[np.arange(len(values)) % 3 == row.g]
        for n, q in probs.items():
            assert row[f"v_{n}"] == pytest.approx(np.percentile(group, q * 100), rel=1e-12, abs=1e-12)


def test_percentiles_of_one_repeated_value_and_bad_values(spark):
    df = spark.createDataFrame([(3.5,)] * 50 + [(float("nan"),), (None,), (float("inf"),)], "v double")
    assert profile.percentiles(df, {"v": "v"}, {"m": 0.5}).first()[0] == 3.5
    assert profile.percentiles(df.limit(0), {"v": "v"}, {"m": 0.5}).first()[0] is None


def test_axis_stats_counts_invalid_rows(spark):
    df = cloud(spark, [(1, 2, 3), (3, 2, 1), (float("nan"), 0, 0), (float("inf"), 0, 0)])
    row = profile.axis_stats(df).first()
    assert (row.n, row.n_invalid, row.x_mean, row.x_std) == (2, 2, 2.0, 1.0)


def test_single_point_and_empty_input(spark):
    one = cloud(spark, [(1, 2, 3)], opacity=[2.0])
    assert clip.sigma_clip(one, 3).count() == 1
    assert clip.prune(one).count() == 1
    box = profile.bbox(one).first()
    assert box.volume == 0 and box.density is None
    empty = one.limit(0)
    assert clip.prune(empty).count() == 0
    assert sample.sample_exact(empty, 5, "point_id").count() == 0
    assert voxel.voxel_to_target(empty, 5).count() == 0
    assert profile.bbox(empty).first().n == 0


def test_joint_clip_matches_numpy(spark, xyz):
    got = {r.point_id for r in clip.sigma_clip(cloud(spark, xyz), 1.7).collect()}
    keep = (np.abs(xyz - xyz.mean(0)) <= 1.7 * xyz.std(0)).all(1)
    assert got == set(np.flatnonzero(keep))


def test_sequential_clip_uses_the_rows_still_kept(spark, xyz):
    op = RNG.normal(size=len(xyz)) * 3
    got = {r.point_id for r in clip.prune(cloud(spark, xyz, opacity=op.tolist()), 0.15, 1.5).collect()}
    mask = 1 / (1 + np.exp(-op)) >= 0.15
    for a in range(3):
        v = xyz[:, a]
        mask &= np.abs(v - v[mask].mean()) <= 1.5 * v[mask].std()
    assert got == set(np.flatnonzero(mask))


def test_prune_without_opacity_or_sigma(spark, xyz):
    df = cloud(spark, xyz)
    assert clip.prune_opacity(df).count() == len(xyz)
    assert clip.prune(df, sigma=0).count() == len(xyz)
    odd = cloud(spark, [(0, 0, 0)] * 3, opacity=[float("nan"), float("inf"), -100.0])
    assert [r.point_id for r in clip.prune_opacity(odd).collect()] == [1]


def test_prune_report_adds_up(spark, xyz):
    op = (RNG.normal(size=len(xyz)) * 3).tolist()
    df = cloud(spark, xyz, opacity=op)
    row = clip.prune_report(df, 0.15, 1.5).first()
    removed = row.removed_opacity + row.removed_invalid + row.removed_x + row.removed_y + row.removed_z
    assert row.n_in - removed == row.n_kept == clip.prune(df, 0.15, 1.5).count()


@pytest.mark.parametrize("k", [1, 17, 999, 2999])
def test_sample_is_exact_and_independent_of_partitioning(spark, xyz, k):
    df = cloud(spark, xyz)
    a = {r.point_id for r in sample.sample_exact(df.repartition(7), k, "point_id").collect()}
    b = {r.point_id for r in sample.sample_exact(df.coalesce(1), k, "point_id").collect()}
    assert len(a) == k and a == b
    assert sample.sample_exact(df, 5000, "point_id").count() == len(xyz)


def test_sample_with_one_hot_group_and_repeated_keys(spark):
    df = spark.range(4000).selectExpr("CASE WHEN id < 3900 THEN 0 ELSE id END AS g", "id % 7 AS key")
    counts = {r.g: r["count"] for r in sample.sample_exact(df, 500, "key", by="g").groupBy("g").count().collect()}
    assert counts.pop(0) == 500 and set(counts.values()) == {1}


def test_bucket_cut_agrees_with_band_cut(spark, xyz):
    thin = cloud(spark, xyz).select(F.col("point_id").alias("_key")).withColumn("_h", sample.digest("_key", 1))
    sizes = spark.createDataFrame([(len(xyz), 700)], "_n long, _k long")
    assert sample._cut_in_band(thin, sizes, []).collect() == sample._cut_by_buckets(thin, sizes, []).collect()


def test_cap_per_group_equals_per_group_sample(spark, xyz):
    df = cloud(spark, xyz).withColumn("g", F.expr("CASE WHEN point_id % 10 < 8 THEN 0 ELSE point_id % 10 END"))
    a = {r.point_id for r in sample.cap_per_group(df, "g", 150, "point_id").collect()}
    b = {r.point_id for r in sample.sample_exact(df, 150, "point_id", 0, "g").collect()}
    c = {r.point_id for r in sample.cap_per_group(df.withColumn("cap", F.lit(150)), "g", "cap", "point_id").collect()}
    assert a == b == c and len(a) == 450


def test_voxel_keeps_the_first_of_each_cell(spark, xyz):
    got = {r.point_id for r in voxel.voxel_downsample(cloud(spark, xyz), 0.5).collect()}
    _, first = np.unique(np.floor(xyz / 0.5).astype(int), axis=0, return_index=True)
    assert got == set(first)
    assert voxel.voxel_downsample(cloud(spark, xyz), 0).count() == len(xyz)


@pytest.mark.parametrize("levels", [1, 3, 5])
def test_voxel_search_follows_plain_bisection(spark, xyz, levels):
    lo, hi = 0.0, float((xyz.max(0) - xyz.min(0)).max())
    for _ in range(20):
        mid = (lo + hi) / 2
        if len(np.unique(np.floor(xyz / mid).astype(int), axis=0)) > 300:
            lo = mid
        else:
            hi = mid
    bisections = 20 if levels == 5 else 6
    got = voxel.voxel_size_search(cloud(spark, xyz), 300, bisections=bisections, levels_per_job=levels).first()[0]
    if bisections == 20:
        assert got == hi
        assert voxel.voxel_to_target(cloud(spark, xyz), 300).count() <= 300
    else:
        assert got >= hi


def test_activation_extremes(spark):
    df = spark.createDataFrame([(-1e4,), (0.0,), (1e4,)], "o double")
    assert [r[0] for r in df.select(activation.sigmoid("o")).collect()] == [0.0, 0.5, 1.0]
    assert [r[0] for r in df.select(activation.sigmoid("o", clip=88)).collect()][0] == pytest.approx(1 / (1 + math.exp(88)))


def test_name_functions(spark):
    df = spark.createDataFrame([("/a/b.c/img.v1.JPG",), ("plain",), (".hidden",), ("s3://x/y.npy",)], "p string")
    rows = df.select(names.stem("p"), names.extension("p"), names.file_name("p")).collect()
    assert [tuple(r) for r in rows] == [
        ("img.v1", ".jpg", "img.v1.JPG"),
        ("plain", "", "plain"),
        (".hidden", "", ".hidden"),
        ("y", ".npy", "y.npy"),
    ]


def test_capabilities(spark):
    assert names.capabilities(cloud(spark, [(0, 0, 0)], opacity=[1.0])) == {
        "has_color": False,
        "has_normals": False,
        "is_splat": True,
    }


def test_pose_algebra(spark):
    q = RNG.normal(size=(20, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    rows = [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(q, RNG.normal(size=(20, 3))))]
    df = spark.createDataFrame(rows, "id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    out = pose.invert_rigid(pose.invert_rigid(pose.w2c(df)), "c2w", "again")
    out = out.select("*", pose.pose_matrix("w2c").alias("m"), pose.pose_matrix("c2w").alias("inv"))
    out = pose.invert_pose(out, "m", "general")
    out = pose.invert_pose(out, "m", "rigid", rigid=True)
    for r in out.collect():
        m = np.array(r.m)
        assert np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3))
        assert np.allclose(np.linalg.inv(m), r.inv) and np.allclose(r.general, r.inv) and np.allclose(r.rigid, r.inv)
        assert np.allclose([r[f"again_{c}"] for c in ("r01", "t2")], [r.w2c_r01, r.w2c_t2])
        x, y, z, w = *rows[r.id][2:5], rows[r.id][1]
        assert r.w2c_r01 == pytest.approx(2 * (x * y - z * w))
    bad = spark.createDataFrame([([[0.0] * 4] * 4,)], "m array<array<double>>")
    assert pose.invert_pose(bad, "m").first().inverse is None


def test_missing_camera_parameters(spark):
    df = spark.createDataFrame([(9, 100, 50, [7.0])], "model_id int, width long, height long, params array<double>")
    r = camera.intrinsics(df).first()
    assert (r.fl_x, r.fl_y, r.cx, r.cy, r.k1) == (7.0, 7.0, 50.0, 25.0, 0.0)


def test_downscale_edges(spark):
    df = spark.createDataFrame([(1, 9)], "width long, height long")
    assert tuple(camera.downscale_dims(df, 4).select("new_width", "new_height").first()) == (1, 3)
    assert tuple(camera.downscale_dims(df, 1).select("new_width", "new_height").first()) == (1, 9)


def raster(spark, values, frame=0, column="depth"):
    rows = [(frame, v, [float(x) for x in row]) for v, row in enumerate(values)]
    return spark.createDataFrame(rows, f"frame long, v long, {column} array<double>")


def test_project_undoes_backproject(spark):
    d = RNG.uniform(1, 5, size=(6, 8))
    fr = spark.createDataFrame(
        [(0, 30.0, 31.0, 4.0, 3.0, 0.9, 0.1, -0.3, 0.2, 1.0, 2.0, 3.0)],
        "frame long, fl_x double, fl_y double, cx double, cy double, qw double, qx double, qy double, qz double, "
        "tx double, ty double, tz double",
    )
    n = "sqrt(qw*qw + qx*qx + qy*qy + qz*qz)"
    fr = fr.selectExpr("frame", "fl_x", "fl_y", "cx", "cy", *[f"{c}/{n} AS {c}" for c in ("qw", "qx", "qy", "qz")], "tx", "ty", "tz")
    posed = pose.invert_rigid(pose.w2c(fr))
    px = depth.backproject(raster(spark, d), posed, 4.5)
    back = px.withColumnsRenamed({"x": "px", "y": "py", "z": "pz"}).join(posed, "frame")
    rows = depth.project_z(back).collect()
    assert len(rows) == (d < 4.5).sum()
    for r in rows:
        assert r.z_cam == pytest.approx(d[r.v, r.u])


def test_upsample_matches_bilinear(spark):
    d = RNG.uniform(size=(4, 5))
    h, w = 9, 13

    def taps(n_out, n_in):
        m = np.zeros((n_out, n_in))
        for o in range(n_out):
            s = min(max((o + 0.5) * n_in / n_out - 0.5, 0), n_in - 1)
            i = int(s)
            m[o, i] += 1 - (s - i)
            m[o, min(i + 1, n_in - 1)] += s - i
        return m

    want = taps(h, 4) @ d @ taps(w, 5).T
    got = sorted(depth.upsample(raster(spark, d), w, h).collect(), key=lambda r: r.v)
    assert np.allclose([r.depth for r in got], want)
    same = sorted(depth.upsample(raster(spark, d), 5, 4).collect(), key=lambda r: r.v)
    assert np.allclose([r.depth for r in same], d)


def test_scale_shortage(spark):
    images = spark.createDataFrame(
        [(0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)],
        "image_id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double",
    )
    obs = spark.createDataFrame([(0, f"o{i}", 1.0, 1.0, i) for i in range(20)], "image_id long, obs_key string, x double, y double, point3d_id long")
    pts = spark.createDataFrame([(i, 0.0, 0.0, 4.0) for i in range(20)], "point3d_id long, x double, y double, z double")
    rows = raster(spark, np.full((3, 3), 2.0))
    with pytest.raises(Exception, match="needs 200 pairs, found 20"):
        depth.depth_scale(images, obs, pts, rows).collect()
    ok = depth.depth_scale(images, obs, pts, rows, min_total=10).first()
    assert (ok.scale, ok.n_pairs, ok.n_images, ok.std) == (2.0, 20, 1, 0.0)
    assert depth.depth_scale(images, obs, pts, rows, on_shortage="null").first().scale is None


def test_erosion_across_blocks_and_subset(spark, monkeypatch):
    monkeypatch.setattr(masks, "_ROWS_PER_BLOCK", 4)
    bits = RNG.uniform(size=(19, 11)) > 0.15
    df = spark.createDataFrame([("a", v, [bool(b) for b in row]) for v, row in enumerate(bits)], "image string, v long, bits array<boolean>")
    got = np.array([r.bits for r in sorted(masks.erode(df, 3).collect(), key=lambda r: r.v)])
    padded = np.pad(bits, 1, constant_values=True)
    want = np.ones_like(bits)
    for dv in range(3):
        for du in range(3):
            want &= padded[dv : dv + 19, du : du + 11]
    assert (got == want).all() and not (got & ~bits).any()
    # Only the rows at a block edge are sent to a second block.
    spread = masks.erode(df, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(FLOOR((cast(greatest((v" in spread and "FLOOR((cast((v" in spread
    assert masks.erode(df, 1) is df


def test_missing_optional_inputs(spark):
    files = spark.createDataFrame([("a", 1, 10)], "run string, step long, mtime long")
    assert catalog.latest_incomplete(files, 2).count() == 0
    none = spark.createDataFrame([("x.txt",)], "name string")
    assert catalog.next_version(none).first()[0] == 1
    assert catalog.latest_file(none.selectExpr("name AS path", "1 AS mtime"), "yml$", "yaml$").count() == 0


def test_merge_refuses_other_properties(spark, xyz):
    with pytest.raises(ValueError, match="other columns"):
        jobs.merge_splats([cloud(spark, xyz[:3]), cloud(spark, xyz[:3], opacity=[1.0] * 3)])


def test_camera_cluster(spark):
    centres = RNG.normal(size=(40, 3))
    df = spark.createDataFrame([tuple(map(float, c)) for c in centres], "c2w_t0 double, c2w_t1 double, c2w_t2 double")
    r = frames.camera_cluster(df).first()
    dist = np.linalg.norm(centres - centres.mean(0), axis=1)
    assert r.radius_p90 == pytest.approx(np.percentile(dist, 90)) and r.center_y == pytest.approx(centres[:, 1].mean())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_physical_plans(spark, xyz, tmp_path):
    path = str(tmp_path / "cloud")
    cloud(spark, xyz, opacity=RNG.normal(size=len(xyz)).tolist()).withColumn("g", F.lit(1)).write.parquet(path)
    df = spark.read.parquet(path)
    pruned = plan(clip.prune(df, by="g"))
    assert "GreaterThanOrEqual(opacity" in pruned  # the opacity bound reaches the scan
    assert "SortMergeJoin" not in pruned and pruned.count("BroadcastHashJoin") == 3
    assert "Exchange hashpartitioning" not in pruned  # the cloud itself is not shuffled
    assert "WindowGroupLimit" in plan(sample.cap_per_group(df, "g", 10, "point_id"))
    thinned = plan(voxel.voxel_downsample(df, 1.0, "g"))
    assert "SortAggregate" not in thinned and "partial_min_by" in thinned
    sampled = plan(sample.sample_exact(df, 100, "point_id"))
    assert "Exchange hashpartitioning" not in sampled and "Window" not in sampled


def plain_resample(a, width, height, rounded):
    """Triangle filter by its definition, one axis after the other."""

    def axis(a, n):
        size = len(a)
        reach = max(size / n, 1.0)
        out = []
        for o in range(n):
            centre = (o + 0.5) * size / n
            w = np.array([max(0.0, 1 - abs(s + 0.5 - centre) / reach) for s in range(size)])
            out.append(np.tensordot(w / w.sum(), a, axes=(0, 0)))
        return np.floor(np.array(out) + 0.5 + 1e-9) if rounded else np.array(out)

    return np.swapaxes(axis(np.swapaxes(axis(np.swapaxes(a, 0, 1), width), 0, 1), height), 0, 0)


@pytest.mark.parametrize("size", [(3, 2), (11, 7), (40, 3), (5, 90), (61, 70), (25, 20), (1, 1)])
def test_resample_matches_definition(spark, size):
    rng = np.random.default_rng(4)
    d = rng.normal(size=(20, 25))
    c = rng.integers(0, 256, (20, 25, 3))
    got = {r.v: r.depth for r in resample(raster(spark, d), size).collect()}
    assert np.allclose([got[v] for v in range(size[1])], plain_resample(d, *size, False))
    rows = spark.createDataFrame([("k", 0, v, r.tolist()) for v, r in enumerate(c)], "cap string, frame int, v int, rgb array<array<short>>")
    wanted = spark.createDataFrame([("k", 0, *size)], "cap string, frame int, width int, height int")
    got = {r.v: r.rgb for r in resample(rows, wanted, "cap", "rgb").collect()}
    assert np.array_equal([got[v] for v in range(size[1])], plain_resample(c, *size, True))


def test_resample_agrees_with_upsample(spark):
    d = np.random.default_rng(5).normal(size=(6, 5))
    a, b = (sorted((r.v, r.depth) for r in f.collect()) for f in (resample(raster(spark, d), (13, 17)), depth.upsample(raster(spark, d), 13, 17)))
    assert [v for v, _ in a] == [v for v, _ in b] and np.allclose([r for _, r in a], [r for _, r in b])


def test_resample_missing_pixels_and_rows(spark):
    schema = "frame int, v int, rgb array<array<short>>"
    px = [[[9, 9, 9], [3, 3, 3], None, [5, 5, 5]], [[1, 1, 1]] * 4, [[7, 7, 7]] * 4]
    rows = spark.createDataFrame([(0, v, r) for v, r in zip((0, 1, 5), px)], schema)  # rows 2 to 4 are absent
    got = {r.v: r.rgb for r in resample(rows, (2, 6), column="rgb").collect()}
    assert sorted(got) == [0, 1, 5] and got[5] == [[7, 7, 7], [7, 7, 7]] and got[0][1] == [None] * 3
    ragged = spark.createDataFrame([(0, 0, [[1, 1, 1]]), (0, 1, [[1, 1, 1]] * 2)], schema)
    with pytest.raises(Exception, match="differ in width"):
        resample(ragged, (1, 1), column="rgb").collect()
    assert resample(rows.limit(0), (2, 2), column="rgb").count() == 0


def test_colours_of_another_size_raise_or_are_resampled(spark):
    d = np.full((4, 6), 2.0)
    posed = spark.createDataFrame([(0, 0, 1.0, 1.0, 0.0, 0.0, 6, 4)], "frame int, image_id long, fl_x double, fl_y double, cx double, cy double, width int, height int")
    posed = posed.withColumns({f"c2w_{k}": F.lit(1.0 if k in ("r00", "r11", "r22") else 0.0) for k in
                               ("r00", "r01", "r02", "t0", "r10", "r11", "r12", "t1", "r20", "r21", "r22", "t2")})
    tall = np.arange(8 * 6 * 3).reshape(8, 6, 3) % 256
    colors = spark.createDataFrame([(0, v, r.tolist()) for v, r in enumerate(tall)], "frame int, v int, rgb array<array<short>>")
    with pytest.raises(Exception, match="differ in size"):  # as wide, but twice as high
        depth.backproject(raster(spark, d), posed, 4.0, color_rows=colors).collect()
    rows = raster(spark, d).withColumn("conf", F.transform("depth", lambda _: F.lit(1.0)))
    cloud = jobs.build_init_cloud(rows, posed, colors, step=1, max_points=None).collect()
    want = plain_resample(tall, 6, 4, True)
    assert len(cloud) == 24
    for r in cloud:
        v, u = (r.point_id >> 16) & 0xFFFF, r.point_id & 0xFFFF
        assert [r.red, r.green, r.blue] == list(want[v, u])
