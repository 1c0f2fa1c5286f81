"""Sources and sinks on files the tests write themselves."""

import glob
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

from scanloom.operators import catalog, jobs
from scanloom.plans import materialize
from scanloom.plans.materialize import png
from scanloom.plans.stage import stage, work_dir
from scanloom.sources import captures, documents, images, npy, ply, sparse_model, splits, xmp, zones
from scanloom.streaming.intake import process_new

RNG = np.random.default_rng(3)
KINDS = {"f4": "float", "f8": "double", "u1": "uchar", "i2": "short", "u4": "uint", "i1": "char", "u2": "ushort"}


def write_file(path, dtype, rows, order="<", comment="made by a test", tail=b"", faces=False, announce=None):
    fmt = "binary_little_endian" if order == "<" else "binary_big_endian"
    props = [f"property {KINDS[t]} {n}" for n, t in dtype]
    lines = ["ply", f"format {fmt} 1.0", f"comment {comment}", f"element vertex {len(rows) if announce is None else announce}", *props]
    if faces:
        lines += ["element face 1", "property list uchar int vertex_indices"]
    data = np.array(rows, dtype=[(n, order + t) for n, t in dtype])
    with open(path, "wb") as f:
        f.write(("\n".join([*lines, "end_header"]) + "\n").encode() + data.tobytes() + tail)
    return data


MIXED = [("x", "f4"), ("y", "f8"), ("red", "u1"), ("k", "i2"), ("id", "u4"), ("c", "i1"), ("h", "u2")]
ROWS = [(i * 0.5, -i / 3, i % 256, -i, 4_000_000_000 + i, i % 100 - 50, i * 7 % 65536) for i in range(1000)]


@pytest.mark.parametrize("order", ["<", ">"])
def test_mixed_types_with_faces(spark, tmp_path, order):
    p = str(tmp_path / "mixed.ply")
    data = write_file(p, MIXED, ROWS, order, tail=b"\x03" + struct.pack("<3i", 0, 1, 2), faces=True)
    df = spark.read.format("ply").option("splitBytes", 999).load(p)
    assert df.rdd.getNumPartitions() > 5
    rows = sorted(df.collect(), key=lambda r: r.point_id)
    assert [r.point_id for r in rows] == list(range(1000))
    for name, _ in MIXED:
        assert [r[name] for r in rows] == data[name].tolist()
    narrow = spark.read.format("ply").schema("id long, path string").load(p)
    assert narrow.columns == ["id", "path"] and narrow.agg(F.sum("id")).first()[0] == data["id"].astype(int).sum()


def test_bad_files(spark, tmp_path):
    p = str(tmp_path / "short.ply")
    write_file(p, MIXED, ROWS, announce=2000)
    with pytest.raises(Exception, match="too short"):
        spark.read.format("ply").load(p).count()
    for i, text in enumerate(
        [
            "ply\nformat ascii 1.0\nelement vertex 0\nend_header\n",
            "ply\nformat binary_little_endian 1.0\nelement vertex 0\nproperty list uchar int a\nend_header\n",
            "ply\nformat binary_little_endian 1.0\nelement face 1\nelement vertex 0\nend_header\n",
            "nothing",
        ]
    ):
        bad = tmp_path / f"bad{i}.ply"
        bad.write_text(text)
        with pytest.raises(ValueError):
            ply.read_header(str(bad))


def test_files_with_other_properties_are_refused(spark, tmp_path):
    write_file(str(tmp_path / "a.ply"), [("x", "f4"), ("y", "f4")], [(1, 2)])
    write_file(str(tmp_path / "b.ply"), [("x", "f4"), ("q", "f4")], [(1, 2)])
    with pytest.raises(Exception, match="no y of type float"):
        spark.read.format("ply").load(str(tmp_path)).collect()


def test_sink_keeps_header_and_types(spark, tmp_path):
    src, dst = str(tmp_path / "in.ply"), str(tmp_path / "out")
    data = write_file(src, MIXED, ROWS, comment="kept")
    df = spark.read.format("ply").load(src)
    df.where("k > -500").repartition(3).write.format("ply").mode("overwrite").option("headerFrom", src).save(dst)
    head = ply.read_header(glob.glob(f"{dst}/*.ply")[0])
    assert "comment kept" in head.lines and [n for n, _ in head.properties] == [n for n, _ in MIXED]
    assert [t for _, t in head.properties] == [KINDS[t] for _, t in MIXED]
    again = spark.read.format("ply").load(dst)
    assert sorted(r.id for r in again.collect()) == data["id"][:500].tolist()
    manifest = json.load(open(f"{dst}/_manifest.json"))
    assert manifest["count"] == 500 == sum(f["count"] for f in manifest["files"])
    assert not os.path.exists(f"{dst}/_temporary") or not os.listdir(f"{dst}/_temporary")
    df.limit(10).write.format("ply").mode("overwrite").option("headerFrom", src).save(dst)
    assert spark.read.format("ply").load(dst).count() == 10
    df.limit(10).write.format("ply").mode("append").option("headerFrom", src).save(dst)
    assert spark.read.format("ply").load(dst).count() == 20


def test_sink_checks_ranges_and_nulls(spark, tmp_path):
    for value in (300, -1, None):
        df = spark.createDataFrame([(1.0, value)], "x double, red int")
        with pytest.raises(Exception, match="outside the range|nulls"):
            df.write.format("ply").mode("overwrite").save(str(tmp_path / "o"))
    empty = spark.createDataFrame([], "x double, y double, z double")
    assert ply.write_ply_rgb(empty, str(tmp_path / "none")) == 0 and not os.path.exists(tmp_path / "none")


def test_catalog_reports_missing_files(spark, tmp_path):
    p = str(tmp_path / "a.ply")
    write_file(p, [("x", "f4"), ("nx", "f4"), ("opacity", "f4")], [(1, 2, 3)] * 4)
    broken = tmp_path / "b.ply"
    broken.write_text("nope")
    rows = {r.path: r for r in ply.ply_catalog(spark, [p, str(broken), "/none.ply"]).collect()}
    assert (rows[p].vertex_count, rows[p].n_properties, rows[p].has_normals, rows[p].is_splat) == (4, 3, True, True)
    assert rows[p].size_mib == pytest.approx(os.path.getsize(p) / 1048576)
    assert rows["/none.ply"].status == "missing" and rows[str(broken)].status.startswith("unreadable")


def test_prune_files_matches_numpy(spark, tmp_path):
    cols = ["x", "y", "z", "opacity", "scale_0"]
    files = []
    for i in range(2):
        rows = [tuple(r) for r in RNG.normal(size=(800, 5)) * [1, 2, 3, 4, 1] + i]
        files.append(write_file(str(tmp_path / f"s{i}.ply"), [(c, "f4") for c in cols], rows))
    jobs.prune_files(spark, str(tmp_path), str(tmp_path / "out"), 0.15, 2.0)
    want = []
    for data in files:
        op = data["opacity"].astype(float)
        mask = 1 / (1 + np.exp(-op)) >= 0.15
        for a in "xyz":
            v = data[a].astype(float)
            mask &= np.abs(v - v[mask].mean()) <= 2 * v[mask].std()
        want += data["scale_0"][mask].tolist()
    got = spark.read.format("ply").load(str(tmp_path / "out"))
    assert sorted(r.scale_0 for r in got.collect()) == sorted(want)


def test_rasters(spark, tmp_path):
    d = RNG.uniform(size=(33, 17)).astype(np.float32)
    np.save(tmp_path / "img_1.npy", d)
    df = spark.read.format("npy_raster").option("splitBytes", 500).load(str(tmp_path))
    rows = sorted(df.collect(), key=lambda r: r.v)
    assert {r.frame for r in rows} == {"img_1"} and np.array_equal([r.depth for r in rows], d)
    npy.write_rasters(df, str(tmp_path / "copy")).collect()
    assert np.array_equal(np.load(tmp_path / "copy" / "img_1.npy"), d)
    assert spark.read.format("npy_raster").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="missing or uneven"):
        npy.write_rasters(df.where("v <> 3"), str(tmp_path / "gap")).collect()


def test_small_files_share_splits():
    """Every part of every file once, in order, and no split much larger than the mean."""
    cases = [
        ([(f"{i:05d}", 4096) for i in range(10_000)], {}, 16),
        ([("a", 10 << 30), ("b", 1)], {}, 81),
        ([("a", 0), ("b", 5)], {}, 1),
        ([(f"{i}", 30 << 20) for i in range(100)], {"minpartitions": "4"}, 24),
        ([("a", 1000), ("b", 1000)], {"splitbytes": "100"}, 20),
    ]
    for files, options, most in cases:
        packed = splits.pack(files, options)
        pieces = [p for s in packed for p in s.pieces]
        assert 0 < len(packed) <= most and all(s.pieces for s in packed)
        assert [p.path for p in pieces if p.part == 0] == [n for n, _ in files]
        for name, size in files:
            shares = [p.share(size) for p in pieces if p.path == name]
            assert shares[0][0] == 0 and shares[-1][1] == size and all(a[1] == b[0] for a, b in zip(shares, shares[1:]))
        costs = [sum(b - a + splits.OPEN_BYTES for p in s.pieces for a, b in [p.share(p.size)]) for s in packed]
        one = max(b - a + splits.OPEN_BYTES for p in pieces for a, b in [p.share(p.size)])
        assert max(costs) <= sum(costs) / len(costs) + 2 * one
    assert [s.pieces for s in splits.pack([], {})] == [[]]
    packed = splits.pack([(f"{i:05d}", 2128) for i in range(12_000)], {"splitbytes": "900"})
    assert len(packed) <= splits.MOST_SPLITS and sum(len(s.pieces) for s in packed) == 36_000
    assert len(splits.pack([("a", 300 << 30)], {})) >= 2400  # large splits stay as they are


def test_many_small_rasters_of_two_captures(spark, tmp_path):
    want = {}
    for c in ("a", "b"):
        (tmp_path / c).mkdir()
        for i in range(60):
            want[c, f"img_{i}"] = d = RNG.uniform(size=(3, 4)).astype(np.float32)
            np.save(tmp_path / c / f"img_{i}.npy", d)
    df = spark.read.format("npy_raster").load(str(tmp_path))
    assert df.columns == ["path", "frame", "v", "depth"] and df.rdd.getNumPartitions() <= 3
    got = {}
    for r in sorted(df.collect(), key=lambda r: r.v):
        got.setdefault((r.path.split("/")[-2], r.frame), []).append(r.depth)
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)
    thin = spark.read.format("npy_raster").schema("frame string, v long").load(str(tmp_path))
    assert thin.columns == ["frame", "v"] and thin.count() == 360


def test_catalog_query_writes_more_files_for_more_rows(spark, monkeypatch):
    from scanloom.plans import queries_files
    from scanloom.plans.registry import QUERIES

    listed = []
    monkeypatch.setattr(queries_files, "_FILE_ROWS", 500, raising=False)
    monkeypatch.setattr(ply, "ply_catalog", lambda spark, names, f=ply.ply_catalog: listed.extend(names) or f(spark, names))
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert QUERIES["ply_catalog"](spark, "/root/testdata/sf0.001").first().n == n and len(listed) == -(-n // 500)


def test_unlike_files_in_one_scan(spark, tmp_path):
    write_file(str(tmp_path / "a.ply"), [("x", "f4"), ("y", "f4"), ("z", "f4"), ("k", "u1")], [(1, 2, 3, 4), (2, 3, 4, 200)])
    write_file(str(tmp_path / "b.ply"), [("x", "f8"), ("y", "f4"), ("z", "f4"), ("opacity", "f4")], [(0.1, 5, 6, -1)], order=">")
    write_file(str(tmp_path / "c.ply"), [("k", "i1"), ("x", "f4"), ("y", "f4"), ("z", "f4")], [(-5, 7, 8, 9)])
    write_file(str(tmp_path / "none.ply"), [("x", "f4"), ("y", "f4"), ("z", "f4")], [])
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "d.ply").write_text("nothing")
    files = [str(tmp_path / f"{n}.ply") for n in ("a", "b", "c", "none")]
    df = jobs.merge_files(spark, files, strict=False)
    assert dict(df.dtypes) == {
        "path": "string", "point_id": "bigint", "k": "smallint", "x": "double", "y": "float", "z": "float", "opacity": "float"
    }
    got = sorted((r.x, r.k, r.opacity) for r in df.collect())
    assert got == [(0.1, None, -1), (1, 4, None), (2, 200, None), (7, -5, None)]
    assert df.where("opacity < 0").count() == 1 and df.where("opacity IS NULL").count() == 3
    assert df.where("k >= 4").count() == 2 and df.where("x = 0.1D").count() == 1
    assert df.rdd.getNumPartitions() == 1
    with pytest.raises(ValueError, match="b.ply has other properties than .*a.ply"):
        jobs.merge_files(spark, files[:2])
    assert jobs.merge_files(spark, [files[0]] * 2).count() == 4
    with pytest.raises(ValueError, match="unreadable"):
        jobs.merge_files(spark, [files[0], str(tmp_path / "bad")], strict=False)
    named = {n: str(tmp_path / f"{n}.ply") for n in ("a", "b", "c", "none", "gone")} | {"bad": str(tmp_path / "bad")}
    rows = {r["name"]: r for r in jobs.compare_files(spark, named).collect()}
    assert {n: r.n for n, r in rows.items()} == {"a": 2, "b": 1, "c": 1, "none": 0, "gone": None, "bad": None}
    assert rows["gone"].status == "missing" and rows["bad"].status.startswith("unreadable") and rows["none"].status == "ok"
    assert rows["a"].x_max == 2 and rows["b"].is_splat and not rows["a"].is_splat and rows["b"].n_above_1 == 1
    assert rows["a"].mean_opacity is None and rows["b"].mean_opacity == pytest.approx(1 / (1 + np.exp(1)))


def model_file(tmp_path):
    with open(tmp_path / "images.bin", "wb") as f:
        f.write(struct.pack("<Q", 3))
        for i, (name, n) in enumerate([("b.jpg", 0), ("ä.jpg", 1000), ("a.jpg", 3)]):
            f.write(struct.pack("<I7dI", 10 + i, 1, 0, 0, 0, i, 2, 3, 7) + name.encode() + b"\0" + struct.pack("<Q", n))
            for k in range(n):
                f.write(struct.pack("<ddq", k, k / 2, -1 if k % 2 else k))


def test_model_tables(spark, tmp_path):
    model_file(tmp_path)
    rows = sparse_model.read_images(spark, str(tmp_path)).collect()
    assert [(r.image_idx, r.image_id, r.name, r.tvec[0]) for r in rows] == [(0, 10, "b.jpg", 0), (1, 11, "ä.jpg", 1), (2, 12, "a.jpg", 2)]
    obs = sparse_model.read_observations(spark, str(tmp_path))
    assert obs.count() == 502 and obs.where("point3d_id < 0").count() == 0
    every = spark.read.format("sparse_model").options(table="observations", trackedOnly="false", splitBytes="700").load(str(tmp_path))
    assert every.count() == 1003 and every.where("image_id = 11").agg(F.max("idx")).first()[0] == 999
    raw = open(tmp_path / "images.bin", "rb").read()
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "images.bin").write_bytes(raw[:-9])
    with pytest.raises(Exception, match="ends inside a record"):
        sparse_model.read_observations(spark, str(cut)).count()
    (cut / "cameras.bin").write_bytes(struct.pack("<QIiQQ", 1, 1, 99, 4, 4))
    with pytest.raises(Exception, match="unknown camera model 99"):
        sparse_model.read_cameras(spark, str(cut)).count()


def test_sidecars(spark, tmp_path):
    ns = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:xcr="http://www.capturingreality.com/ns/xcr/1.1#"'
    good = f"<rdf:RDF {ns}><rdf:Description><xcr:Rotation>1 0 0 0 1 0 0 0 1</xcr:Rotation><xcr:Position>4 5 6</xcr:Position></rdf:Description></rdf:RDF>"
    (tmp_path / "a.xmp").write_text(good)
    (tmp_path / "b.xmp").write_text(good.replace("Position", "Place"))
    (tmp_path / "c.xmp").write_text(good[:60])
    (tmp_path / "d.xmp").write_text(f"<rdf:RDF {ns}/>")
    rows = {r.stem: r for r in xmp.read_xmp(spark, str(tmp_path)).collect()}
    assert rows["a"].position == [4, 5, 6] and rows["a"].fl35 == 0 and rows["a"].error is None
    assert rows["b"].error == "no position" and rows["d"].error == "no description" and rows["c"].error
    assert rows["b"].rotation is None


def test_sidecar_documents(spark, tmp_path):
    ns = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:xcr="http://www.capturingreality.com/ns/xcr/1.1#"'
    pose = "<xcr:Rotation>1 0 0 0 1 0 0 0 1</xcr:Rotation><xcr:Position>4 5 6</xcr:Position>"
    good = f'<rdf:RDF {ns}><rdf:Description xcr:FocalLength35mm="{{}}">{pose}</rdf:Description></rdf:RDF>'
    for name in ("b one", "a", "none"):
        for kind in ("xmp", "jpg", "depth"):
            (tmp_path / name / kind).mkdir(parents=True)
        for i in range(4):
            (tmp_path / name / "xmp" / f"f{i}.xmp").write_text(good.format(20 + i) if i else good[:70])
            if i != 3 and name != "none":
                (tmp_path / name / "jpg" / f"f{i}.jpg").write_bytes(b"x")
    (tmp_path / "a" / "depth" / "f2.png").write_bytes(b"x")
    source, out = str(tmp_path), str(tmp_path / "out")
    args = (spark, source, source, out, 100, 200)
    for _ in range(2):  # a second run replaces the documents
        got = {r.capture: r for r in jobs.sidecar_documents(*args, depth=source, ply_file_path="init.ply").collect()}
    assert {k: tuple(r)[1:5] for k, r in got.items()} == {"a": (4, 1, 1, 2), "b one": (4, 1, 1, 2), "none": (4, 4, 0, 0)}
    assert got["none"].path is None and got["b one"].path == f"{out}/capture=b%20one/transforms.json"
    for k, unit in (("a", 0.001), ("b one", None)):
        text = open(got[k].path).read()
        doc = json.loads(text)
        assert len(text) == got[k].length and doc.get("depth_unit_scale_factor") == unit
        assert [f["file_path"] for f in doc["frames"]] == ["images/f1.jpg", "images/f2.jpg"]
        assert doc["ply_file_path"] == "init.ply" and doc["fl_x"] == pytest.approx(21.5 * 200 / 36)
        assert doc["frames"][1].get("depth_file_path") == ("depth/f2.png" if k == "a" else None)
    assert len(glob.glob(f"{out}/**/*.*", recursive=True)) == 2
    with pytest.raises(ValueError, match="no valid frames"):
        jobs.sidecar_documents(spark, source, f"{source}/none", out, 100, 200)


def test_images_keep_their_channels(spark, tmp_path):
    px = RNG.integers(0, 256, size=(5, 7, 3), dtype=np.uint8)
    (tmp_path / "f.png").write_bytes(png(7, 5, [r.tobytes() for r in px]))
    rows = sorted(images.read_color_rows(spark, str(tmp_path)).collect(), key=lambda r: r.v)
    assert np.array_equal([r.rgb for r in rows], px) and rows[0].frame == "f"


def test_frame_documents_are_json(spark, tmp_path):
    fr = spark.createDataFrame(
        [(c, f"i{i:03d}.jpg", f"images/i{i:03d}.jpg", 1.5, None if i % 2 else 0.1) for c in (1, 2) for i in range(50)],
        "capture int, name string, file_path string, fl_x double, k1 double",
    )
    head = spark.createDataFrame([(1, "OPENCV", 1.0), (2, "OPENCV", 2.0), (3, "OPENCV", 3.0)], "capture int, camera_model string, fl_x double")
    documents.write_transforms(fr, head, str(tmp_path / "t"), "capture", "cloud.ply")
    assert not os.path.exists(tmp_path / "t" / "capture=3")
    for c in (1, 2):
        parts = sorted(glob.glob(str(tmp_path / "t" / f"capture={c}" / "part-*")))
        doc = json.loads("".join(open(p).read() for p in parts))
        assert doc["fl_x"] == c and doc["ply_file_path"] == "cloud.ply"
        assert [f["file_path"] for f in doc["frames"]] == [f"images/i{i:03d}.jpg" for i in range(50)]
        assert "k1" in doc["frames"][0] and "k1" not in doc["frames"][1]
    with pytest.raises(ValueError, match="no valid frames"):
        documents.write_transforms(fr.limit(0), head, str(tmp_path / "u"), "capture")


def test_bounds_document(spark, tmp_path):
    cloud = spark.createDataFrame([(0.0, 1.0, 2.0), (3.0, -1.0, 5.0)], "x double, y double, z double")
    documents.write_bounds(jobs.bounds_rows(cloud, aligned=False), str(tmp_path / "b"))
    r = documents.read_bounds(spark, str(tmp_path / "b")).first()
    assert (r.x_max, r.y_min, r.scale_factor_da3_to_colmap, r.scale_aligned, r.scale_info) == (3, -1, 1, False, None)


def test_listing(spark, tmp_path):
    for n in ("b.JPG", "a.png", "c.txt", "d"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.name for r in catalog.list_files(spark, str(tmp_path)).collect()] == ["a.png", "b.JPG"]
    with pytest.raises(FileNotFoundError):
        catalog.list_files(spark, str(tmp_path), [".heic"])


def test_intake_handles_each_file_once(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    (src / "a.jpg").write_bytes(b"1")
    (src / "a.txt").write_bytes(b"1")
    run = lambda: process_new(spark, str(src), lambda b: seen.extend(r.name for r in b.collect()), str(tmp_path / "cp"))
    run()
    run()
    (src / "b.jpg").write_bytes(b"2")
    run()
    assert seen == ["a.jpg", "b.jpg"]


def test_stage_uses_the_configured_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.checkpoint.dir": "s3a://shared/cp/"}.get(key, default)

    class Session:
        conf = Conf()
        sparkContext = spark.sparkContext

    assert work_dir(Session()) == f"s3a://shared/cp/scanloom-{spark.sparkContext.applicationId}"
    assert os.path.isdir(work_dir(spark)) and stage(spark.range(3)).count() == 3


def test_model_files_are_written_in_small_chunks(spark, tmp_path, monkeypatch):
    """However many keypoints an image has, a row that Python holds has few of them."""
    sizes = []

    def noted(chunks, write=materialize.write_chunks):
        sizes.append(chunks.agg(F.max(F.length("content"))).first()[0])
        return write(chunks)

    monkeypatch.setattr(materialize, "write_chunks", noted)
    obs = spark.range(30_000).selectExpr(
        "0L AS capture", "id % 3 AS image_id", "lpad(CAST(id * 7919 % 30011 AS string), 5, '0') AS obs_key",
        "id / 2 AS x", "CAST(id AS double) AS y", "id - 1 AS point3d_id",
    )
    images = spark.range(1, 4).selectExpr(
        "0L AS capture", "id AS image_id", "1L AS camera_id", "concat('é', id) AS name", "1D AS qw", "0D AS qx", "0D AS qy", "0D AS qz",
        "0D AS tx", "0D AS ty", "1D AS tz",
    )
    cameras = spark.sql("SELECT 0L AS capture, 1L AS camera_id, 0 AS model_id, 4 AS width, 3 AS height, array(1D, 2D, 3D, 4D) AS params")
    points = spark.sql("SELECT 0L AS capture, 7L AS point3d_id, 1D AS x, 2D AS y, 3D AS z, 1 AS r, 2 AS g, 3 AS b")
    materialize.write_model(str(tmp_path), cameras, images, obs, points)
    assert len(sizes) == 3 and max(sizes) <= 4096
    read = spark.read.format("sparse_model").options(table="observations", trackedOnly="false").load(str(tmp_path))
    got = sorted((r.image_id, r.idx, r.x, r.point3d_id) for r in read.collect())
    want = []
    for image in (1, 2):
        rows = sorted(((f"{i * 7919 % 30011:05d}", i) for i in range(30_000) if i % 3 == image))
        want += [(image, k, i / 2, i - 1) for k, (_, i) in enumerate(rows)]
    assert got == want
    named = sorted((r.image_id, r.name) for r in sparse_model.read_images(spark, str(tmp_path)).collect())
    assert named == [(1, "é1"), (2, "é2"), (3, "é3")] and sparse_model.read_points3d(spark, str(tmp_path)).first().z == 3


def test_image_records_are_read_once(spark, tmp_path, monkeypatch):
    """The splits of an image file together read little more than the file."""
    import struct

    from scanloom.sources import sparse_model as sm

    with open(tmp_path / "images.bin", "wb") as f:
        f.write(struct.pack("<Q", 60))
        for i in range(60):
            f.write(struct.pack("<I4d3dI", i, 1, 0, 0, 0, 0, 0, 0, 1) + b"name_%d.jpg\0" % i + struct.pack("<Q", 2000))
            f.write(b"".join(struct.pack("<ddq", k, k, k % 3 - 1) for k in range(2000)))
    size = (tmp_path / "images.bin").stat().st_size
    read = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def read(self, n):
            out = self.inner.read(n)
            read.append(len(out))
            return out

        def seek(self, at):
            return self.inner.seek(at)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.inner.close()

    monkeypatch.setattr(sm, "open_input", lambda p, f=sm.open_input: Counted(f(p)))
    monkeypatch.setattr(sm, "CHUNK_BYTES", 1 << 15)
    monkeypatch.setattr(sm._Stream.__init__, "__defaults__", (1 << 15,))
    for table, want in (("observations", 60 * 2000), ("images", 60)):
        options = {"path": str(tmp_path), "table": table, "splitbytes": str(size // 8), "trackedonly": "false"}
        reader = sm._ModelReader(options, sm.T.StructType([sm.T.StructField(n.split(" ")[0], sm.T.LongType()) for n in sm.SCHEMAS[table].split(", ")]))
        parts = reader.partitions()
        assert 7 <= len(parts) <= 9 and sum(p.count for p in parts) == 60
        read.clear()
        rows = sum(b.num_rows for p in parts for b in reader.read(p))
        assert rows == want and sum(read) <= 1.2 * size


def test_invalid_images_are_noticed(spark, tmp_path):
    (tmp_path / "broken.png").write_bytes(b"not an image")
    with pytest.raises(Exception, match="not an image"):
        images.read_color_rows(spark, str(tmp_path)).collect()
    assert images.read_color_rows(spark, str(tmp_path), on_invalid="skip").count() == 0


def test_append_keeps_the_manifest(spark, tmp_path):
    df = spark.range(10).selectExpr("cast(id as float) as x", "cast(id as float) as y", "cast(id as float) as z")
    for _ in range(2):
        df.coalesce(1).write.format("ply").mode("append").save(str(tmp_path / "out"))
    manifest = json.load(open(tmp_path / "out" / "_manifest.json"))
    assert manifest["count"] == 20 and len(manifest["files"]) == 2


def splats(tmp_path, sizes, comment="comment made by {}"):
    """Splat files in folders of their own; every second one has its properties in another order and opacity as a double."""
    files = {}
    for i, n in enumerate(sizes):
        folder = tmp_path / f"c{i}"
        folder.mkdir(parents=True)
        kinds = {c: "f4" for c in ("x", "y", "z", "opacity", "scale_0")}
        order = list(kinds) if i % 2 == 0 else ["scale_0", "z", "y", "x", "opacity"]
        rows = RNG.normal(size=(n, 5)) * [1, 2, 3, 4, 1] + i
        data = np.array([tuple(r) for r in rows], dtype=[(c, "<f4") for c in order])
        lines = ["ply", "format binary_little_endian 1.0", comment.format(i), f"element vertex {n}"]
        lines += [f"property float {c}" for c in order] + ["end_header"]
        (folder / "splat.ply").write_bytes(("\n".join(lines) + "\n").encode() + data.tobytes())
        files[f"c{i}/splat.ply"] = data
    return files


def kept_rows(data, sigma):
    op = data["opacity"].astype(float)
    mask = 1 / (1 + np.exp(-op)) >= 0.15
    for a in "xyz":
        v = data[a].astype(float)
        mask &= np.abs(v - v[mask].mean()) <= sigma * v[mask].std()
    return data[mask]


def test_prune_captures_keeps_names_headers_and_order(spark, tmp_path):
    files = splats(tmp_path / "in", [900, 40, 300])
    found = {r.name: r for r in jobs.prune_captures(spark, str(tmp_path / "in"), str(tmp_path / "out"), 0.15, 2.0).collect()}
    assert set(found) == set(files)
    for i, (name, data) in enumerate(files.items()):
        want = kept_rows(data, 2.0)
        raw = (tmp_path / "out" / name).read_bytes()
        head = ply.parse_header(raw)
        assert f"comment made by {i}" in head.lines and [p for p, _ in head.properties] == list(data.dtype.names)
        assert head.count == len(want) == found[name].n_kept and found[name].n_source == len(data)
        assert raw[head.offset :] == want.tobytes()  # records and their order untouched
    listed = [json.loads(s) for f in (tmp_path / "out" / "_manifest").glob("part-*") for s in f.read_text().splitlines()]
    assert sorted(e["file"] for e in listed) == sorted(files)
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file() and "_temporary" in p.parts] == []


def test_large_captures_are_continued_in_further_files(spark, tmp_path):
    files = splats(tmp_path / "in", [5000, 10])  # one capture has nearly all rows
    target = tmp_path / "out"
    found = {r.name: r for r in jobs.prune_captures(spark, str(tmp_path / "in"), str(target), 0.15, 3.0, records_per_file=256).collect()}
    want = kept_rows(files["c0/splat.ply"], 3.0)
    parts = sorted((target / "c0").glob("splat-*.ply"))
    assert len(parts) == found["c0/splat.ply"].n_files == -(-len(want) // 256)
    heads = [ply.parse_header(p.read_bytes()) for p in parts]
    assert [h.count for h in heads[:-1]] == [256] * (len(parts) - 1)
    assert b"".join(p.read_bytes()[h.offset :] for p, h in zip(parts, heads)) == want.tobytes()


def test_a_file_by_default_is_what_a_task_can_sort():
    assert captures.FILE_BYTES <= 128 << 20


def test_captures_without_rows_and_overwriting(spark, tmp_path):
    files = splats(tmp_path / "in", [50, 60])
    faint = files["c1/splat.ply"]
    faint["opacity"] = -50
    path = tmp_path / "in" / "c1" / "splat.ply"
    head = ply.parse_header(path.read_bytes())
    path.write_bytes(path.read_bytes()[: head.offset] + faint.tobytes())
    target = tmp_path / "out"
    target.mkdir()
    (target / "old.ply").write_bytes(b"ply\n")
    with pytest.raises(FileExistsError):
        jobs.prune_captures(spark, str(tmp_path / "in"), str(target), overwrite=False)
    found = {r.name: r for r in jobs.prune_captures(spark, str(tmp_path / "in"), str(target)).collect()}
    assert found["c1/splat.ply"].n_kept == 0 and found["c1/splat.ply"].pct_kept == 0 and not (target / "old.ply").exists()
    empty = ply.parse_header((target / "c1" / "splat.ply").read_bytes())
    assert empty.count == 0 and "comment made by 1" in empty.lines
    again = {r.name: r for r in jobs.prune_captures(spark, str(tmp_path / "in"), str(target)).collect()}
    assert again == found
    rows = spark.read.format("ply").load(str(target))
    assert rows.count() == found["c0/splat.ply"].n_kept
    # an input that is one file alone
    alone = jobs.prune_captures(spark, str(tmp_path / "in" / "c0" / "splat.ply"), str(tmp_path / "alone")).collect()
    assert [r.name for r in alone] == ["splat.ply"]


def test_captures_refuse_values_that_do_not_fit(spark, tmp_path):
    df = spark.createDataFrame([("a.ply", 0, 300, 1.0), ("a.ply", 1, 5, None)], "name string, point_id long, red int, x double")
    with pytest.raises(Exception, match="outside the range"):
        captures.write_captures(df.where("point_id = 0").drop("name"), str(tmp_path / "a"), F.lit("a.ply")).collect()
    with pytest.raises(Exception, match="holds nulls"):
        captures.write_captures(df.where("point_id = 1").drop("name"), str(tmp_path / "b"), F.lit("a.ply")).collect()
    none = captures.write_captures(df.limit(0).drop("name"), str(tmp_path / "c"), F.lit("a.ply"))
    assert none.count() == 0


class _Counted:
    """A file that counts what is read from it."""

    def __init__(self, path, total):
        self.file, self.total = open(path, "rb"), total

    def read(self, n):
        self.total[0] += n
        return self.file.read(n)

    def seek(self, at):
        self.file.seek(at)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def scan(path, monkeypatch, filters, columns=None):
    """Rows and bytes of one file, read in this process with these filters."""
    total = [0]
    header = ply.read_header(path)
    monkeypatch.setattr(ply, "open_input", lambda p: _Counted(p, total))
    schema = ply.vertex_schema(header)
    reader = ply._PlyReader({"path": path}, schema)
    assert list(reader.pushFilters(filters)) == filters
    rows = [r for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
    return rows, total[0]


def test_filters_skip_blocks_by_zone_maps(spark, tmp_path, monkeypatch):
    n = 10 * zones.BLOCK_ROWS + 77
    x = np.sort(RNG.normal(size=n))
    op = np.where(np.arange(n) < 3 * zones.BLOCK_ROWS, -9.0, RNG.normal(size=n))
    op[5] = np.nan
    p = str(tmp_path / "big.ply")
    data = write_file(p, [("x", "f8"), ("opacity", "f4"), ("k", "i2")], list(zip(x, op, np.arange(n) % 100)))
    cases = [
        [GreaterThan(("x",), 1.5)],
        [LessThanOrEqual(("x",), -2.0), GreaterThanOrEqual(("opacity",), -8.0)],
        [GreaterThanOrEqual(("opacity",), -1.0)],
        [EqualTo(("k",), 7), LessThan(("x",), 0.0)],
        [In(("k",), (7, 1000)), GreaterThan(("point_id",), 150000)],
        [EqualTo(("k",), 1000)],
        [IsNotNull(("x",))],
    ]

    def right(f, rows):
        values = np.array([r[f.attribute[0]] for r in rows], float) if isinstance(rows, list) else rows(f.attribute[0])
        if isinstance(f, IsNotNull):
            return np.ones(len(values), bool)
        ops = {GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal, EqualTo: np.equal}
        if isinstance(f, In):
            return np.isin(values, f.value)
        return ops[type(f)](values, f.value) | (np.isnan(values) & isinstance(f, (GreaterThan, GreaterThanOrEqual)))

    column = lambda c: np.arange(n) if c == "point_id" else data[c].astype(float)
    whole = {}
    for with_zones in (False, True):
        if with_zones:
            assert zones.write_zone_maps(spark, p).first().blocks == 11
        for i, filters in enumerate(cases):
            rows, read = scan(p, monkeypatch, filters)
            want = np.flatnonzero(np.logical_and.reduce([right(f, column) for f in filters]))
            got = [r["point_id"] for r, *ok in zip(rows, *[right(f, rows) for f in filters]) if all(ok)] if rows else []
            assert got == want.tolist()
            whole.setdefault(i, read)
            if with_zones and i in (0, 1, 2):
                assert read <= 0.85 * whole[i] and (i != 0 or read <= 0.3 * whole[i])
            assert not with_zones or i != 5 or read <= 8192 and rows == []  # the header alone
    os.utime(p, ns=(1, 1))  # a changed file makes the sidecar void
    assert scan(p, monkeypatch, cases[0])[1] == whole[0]


def test_filters_through_spark(spark, tmp_path):
    files = splats(tmp_path / "in", [3000, 200])
    zones.write_zone_maps(spark, str(tmp_path / "in")).collect()
    df = spark.read.format("ply").load(str(tmp_path / "in"))
    some = df.where((F.col("opacity") >= 1.5) & (F.col("x") < 0.25) & (F.col("point_id") < 2000))
    want = sum(int(((d["opacity"] >= 1.5) & (d["x"] < np.float32(0.25)) & (np.arange(len(d)) < 2000)).sum()) for d in files.values())
    assert some.count() == want > 0
    one = df.where(F.col("path").endswith("c1/splat.ply")).select("path").distinct().first()[0]
    assert df.where(F.col("path") == one).count() == 200
    assert df.where(F.col("path") == one).rdd.getNumPartitions() == 1
    assert df.where("x > 1000").count() == 0 and df.where("isnan(x) OR x > 1000").count() == 0
