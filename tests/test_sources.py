"""Formats on generated files."""

import csv
import struct

import pytest
from pyspark.sql import functions as F

from trajecta.sources import rasters, text
from trajecta.sources.artifacts import Artifact, cached, write_memory_table
from trajecta.sources.catalog import export_csv
from trajecta.sources.plugins import Dataset, Method, Registry, run_evaluators


def put(path, content):
    path.write_text(content)
    return str(path)


def test_trajectory_is_densified_and_written_back(spark, tmp_path):
    line = lambda i, t: f"{i} 1 0 0 {t} 0 1 0 0 0 0 1 0"
    path = put(tmp_path / "t.txt", f"# head\n{line(0, 5)}\n{line(2, 6)}\n\n{line(2, 7)}\n")
    got = {r.frame_idx: r.m for r in text.trajectory(spark, path, 4).collect()}
    assert sorted(got) == [0, 1, 2, 3] and got[1] is None and got[2][3] == 7.0
    text.write_trajectory(text.trajectory(spark, path), str(tmp_path / "out"))
    back = {r.frame_idx: r.m for r in text.trajectory(spark, str(tmp_path / "out")).where("m is not null").select("frame_idx", "m").collect()}
    assert back == {0: got[0], 2: got[2]}
    with pytest.raises(Exception, match="13 numbers"):
        text.trajectory(spark, put(tmp_path / "bad.txt", "0 1 2\n")).collect()


def test_intrinsics(spark, tmp_path):
    df = text.intrinsics(spark, put(tmp_path / "k.txt", "0 500 501 320 240 640 480\n"))
    assert df.first()["fy"] == 501.0 and df.first()["width"] == 640
    text.write_intrinsics(df.withColumn("fx", F.lit(None).cast("double")), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first().value.startswith("0 nan 501.0000000000")


def test_pose_texts(spark, tmp_path):
    r = text.tum(spark, put(tmp_path / "tum.txt", "# t\n1.5 1 2 3 0 0 0 2\n1 2\n")).collect()
    assert len(r) == 1 and r[0].t_us == 1_500_000 and r[0].m == [1, 0, 0, 1, 0, 1, 0, 2, 0, 0, 1, 3]
    assert text.indexed_tum(spark, put(tmp_path / "v.txt", "3 1 2 3 0 0 0 1\n3 9 2 3 0 0 0 1\n")).first().m[3] == 9.0
    assert text.kitti_poses(spark, put(tmp_path / "p.txt", "1 0 0 4 0 1 0 5 0 0 1 6\n" * 2)).count() == 2
    assert text.kitti_calibration(spark, put(tmp_path / "c.txt", "P0: 1 2 3 4 5 6 7 8 9 1 2 3\nP2: 7 0 6 0 0 8 5 0 0 0 1 0\n")).first()[1:] == (7.0, 8.0, 6.0, 5.0)
    matrix = "1 0 0 4\n0 1 0 5\n0 0 1 6\n0 0 0 1\n"
    assert text.gl_poses(spark, put(tmp_path / "gl.txt", matrix * 2)).first().m == [1, 0, 0, 4, 0, -1, 0, 5, 0, 0, -1, 6]
    assert text.log_poses(spark, put(tmp_path / "x.log", f"0 0 1\n{matrix}" * 2)).first().m == [1, 0, 0, 4, 0, 1, 0, 5, 0, 0, 1, 6]
    assert text.matrix_poses(spark, put(tmp_path / "m.txt", matrix.replace("\n", " ").strip() + "\n")).first().m[7] == 5.0
    assert text.split_scenes(spark, put(tmp_path / "s.txt", "sequence7\n")).first().scene == "seq-07"


def test_lines_are_numbered_over_splits(spark, tmp_path):
    rows = [f"{k} 1 0 0 {k} 0 1 0 0 0 0 1 0" + (" " if k % 7 else "\n# note\n\n") for k in range(400)]
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.txt", "# head\n" + "\n".join(rows) + "\n")
    put(tmp_path / "in" / "b.txt", "x\r\ny\r\n\r\nz")
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(was, ("2000", "10"), strict=True):
        spark.conf.set(k, v)
    try:
        df = text.lines(spark, str(tmp_path / "in"))
        got = df.collect()
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 4
        assert [(r.line_no, r.line.split()[0]) for r in sorted(got, key=lambda r: r.line_no) if r.file.endswith("a.txt")] == [(k, str(k)) for k in range(400)]
        assert sorted((r.line_no, r.line) for r in got if r.file.endswith("b.txt")) == [(0, "x"), (1, "y"), (2, "z")]
        assert [r.m[3] for r in text.trajectory(spark, str(tmp_path / "in" / "a.txt")).orderBy("frame_idx").collect()] == [float(k) for k in range(400)]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_colmap_text(spark, tmp_path):
    c = text.colmap_cameras(spark, put(tmp_path / "cameras.txt", "# c\n1 SIMPLE_RADIAL 640 480 500 320 240 0.1\n2 PINHOLE 640 480 500 501 320 240\n"))
    assert {r.camera_id: (r.fx, r.fy, r.cx, r.cy) for r in c.collect()} == {1: (500, 500, 320, 240), 2: (500, 501, 320, 240)}
    i = text.colmap_images(spark, put(tmp_path / "images.txt", "# i\n1 1 0 0 0 1 2 3 2 a.png\n5 5 1\n")).first()
    assert (i.camera_id, i["name"]) == (2, "a.png") and i.m[3] == -1.0


def test_ply_ascii_binary_and_sink(spark, tmp_path):
    put(tmp_path / "a.ply", "ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n0 1 2 255 0 51\n3 4 5 0 0 0\n")
    got = rasters.read_ply(spark, str(tmp_path / "a.ply")).orderBy("point_id").collect()
    assert (got[0].x, got[0].r, got[0].b, got[1].z, got[0].distance) == (0.0, 1.0, 0.2, 5.0, None)
    assert rasters.read_ply(spark, str(tmp_path / "a.ply"), max_points=1).count() == 1
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 3\nproperty double x\nproperty double y\nproperty double z\nend_header\n"
    (tmp_path / "b.ply").write_bytes(head + struct.pack("<9d", *range(9)))
    assert [r.y for r in rasters.read_ply(spark, str(tmp_path / "b.ply")).orderBy("point_id").collect()] == [1, 4, 7]
    (tmp_path / "short.ply").write_bytes(head + b"1234")
    with pytest.raises(Exception, match="ends early"):
        rasters.read_ply(spark, str(tmp_path / "short.ply")).collect()
    rasters.read_ply(spark, str(tmp_path / "a.ply")).select("x", "y", "z", "r", "g", "b").coalesce(1).write.format("ply").mode("append").save(str(tmp_path / "sink"))
    assert rasters.read_ply(spark, str(tmp_path / "sink")).agg(F.sum("r")).first()[0] == pytest.approx(1.0)


def test_grid_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 0), (2, 1, 254)], "px int, py int, value int")
    meta = {"meters_per_pixel": 0.05, "origin_u_m": 1.0, "origin_v_m": 2.0, "width_px": 3, "height_px": 2}
    rasters.write_grid(cells, meta, str(tmp_path / "g"))
    got = {(r.px, r.py): r.value for r in rasters.read_grid(spark, str(tmp_path / "g")).collect()}
    assert got == {(0, 0): 0, (1, 0): 205, (2, 0): 205, (0, 1): 205, (1, 1): 205, (2, 1): 254}
    with pytest.raises(Exception, match="outside the grid"):
        rasters.write_grid(spark.createDataFrame([(3, 0, 0)], "px int, py int, value int"), meta, str(tmp_path / "g"))
    with pytest.raises(ValueError, match="64 million"):
        rasters.write_grid(cells, meta | {"width_px": 10_000, "height_px": 10_000}, str(tmp_path / "g"))


def test_ply_ranges_limits_and_commits(spark, tmp_path):
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 1000\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    (tmp_path / "a.ply").write_bytes(head + b"".join(struct.pack("<3f3B", i, 2 * i, 3 * i, i % 256, 0, 255) for i in range(1000)))
    df = rasters.read_ply(spark, str(tmp_path / "a.ply"), rows=130)
    assert df.rdd.getNumPartitions() == 8
    assert [(r.point_id, r.y) for r in df.orderBy("point_id").collect()] == [(i, 2.0 * i) for i in range(1000)]
    assert sorted(r.point_id for r in rasters.read_ply(spark, str(tmp_path / "a.ply"), max_points=140, rows=130).collect()) == list(range(140))
    out = str(tmp_path / "out")
    for mode in ("append", "append", "overwrite"):
        df.repartition(3).write.format("ply").mode(mode).save(out)
    assert rasters.read_ply(spark, out).count() == 1000 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    far = df.withColumn("distance", F.col("x") / 4)
    far.repartition(2).write.format("ply").option("pointsPerFile", 70).mode("overwrite").save(out)
    back = rasters.read_ply(spark, out)
    assert back.count() == 1000 and back.where("distance = x / 4 and b = 1.0").count() == 1000 and back.groupBy("file").count().agg(F.max("count")).first()[0] <= 70
    bad = df.withColumn("x", F.when(F.col("point_id") == 999, F.raise_error(F.lit("no")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("ply").mode("append").save(out)
    assert rasters.read_ply(spark, out).count() == 1000 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_artifacts(spark, tmp_path):
    a = Artifact(spark, f"{tmp_path}/scene")
    pixels = spark.createDataFrame([(f, x, y, 3, 2, float(10 * f + 3 * y + x)) for f in (4, 9) for x in range(3) for y in range(2)], "frame_idx int, px int, py int, src_width int, src_height int, depth double")
    bad = pixels.withColumn("depth", F.when(F.col("frame_idx") == 9, F.raise_error(F.lit("broken frame")).cast("double")).otherwise(F.col("depth")))
    with pytest.raises(Exception, match="broken frame"):
        a.save_frames(bad, ["depth"], 6, 3)
    assert not a.is_complete() and a.metadata() is None
    a.save_frames(pixels, ["depth"], 6, 3)
    assert a.is_complete() and a.metadata()["width"] == 6
    got = {(r.frame, r.frame_idx, r.px, r.py): r.depth for r in a.frames().collect()}
    assert got == {(k, f, x, y): 10.0 * f + 3 * (y * 2 // 3) + x // 2 for k, f in ((0, 4), (1, 9)) for x in range(6) for y in range(3)}
    a.clear_incomplete()
    assert a.is_complete()
    with pytest.raises(FileNotFoundError):
        a.load_sampling()
    a.save_sampling([9, 4], {"stride": 5})
    assert a.load_sampling() == {"num_frames": 2, "frames": [4, 9], "sampling": {"stride": 5}}
    (tmp_path / "scene" / "sampling.json").write_text("{ half")
    (tmp_path / "scene" / ".sampling.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        a.load_sampling()
    a.save_eval("pose", {"b": 1, "a": 2.5})
    assert a.load_eval("pose") == {"a": 2.5, "b": 1} and a.load_eval("depth") is None
    matrix = [[2.0, 0, 0, 1], [0, 2, 0, 0.5], [0, 0, 2, 0], [0, 0, 0, 1]]
    a.save_transform(matrix)
    assert a.load_transform() == matrix
    (tmp_path / "scene" / ".complete.json").write_text("{ not json")
    (tmp_path / "scene" / "..complete.json.crc").unlink(missing_ok=True)
    assert a.metadata() is None
    a.mark_incomplete()
    a.clear_incomplete()
    assert not (tmp_path / "scene").exists()
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert [cached(spark, f"{tmp_path}/cache", {"k": k}, make).count() for k in (1, 1, 2)] == [3, 3, 3] and len(calls) == 2
    write_memory_table(spark.createDataFrame([(20, "b", 1.5, 2.0), (10, "a", 1.0, 1.0)], "n_frames int, mode string, peak_mb double, seconds double"), f"{tmp_path}/csv")
    assert [r.n_frames for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()] == ["10", "20"]


def test_plugins(spark, tmp_path):
    reg = Registry()
    scenes = lambda s: s.createDataFrame([("d", "a"), ("d", "b")], "dataset string, scene string")
    frames = lambda s, sc: sc.crossJoin(s.range(3).select(F.col("id").cast("int").alias("frame_idx")))
    reg.add(Dataset("d", scenes, frames, evaluate_cloud=lambda p, g: p.limit(1)))
    reg.add(Dataset("e", scenes, frames, save=lambda df, path: df.write.json(path), load=lambda s, path: s.read.json(path)))
    first = lambda rows: rows.assign(n=rows.frame_idx * 2)[["scene", "n"]]
    reg.add(Method("m", first, "scene string, n int", ("n",)))
    reg.add(Method("bad", lambda rows: first(rows).assign(n=None), "scene string, n int", ("n",)))
    assert sorted(map(tuple, reg.process(spark, "d", "m").collect())) == [(s, n) for s in "ab" for n in (0, 2, 4)]
    with pytest.raises(Exception, match="gives no n"):
        reg.process(spark, "d", "bad").collect()
    with pytest.raises(ValueError):
        reg.add(Method("m", first, ""))
    with pytest.raises(KeyError, match="there are"):
        reg.dataset("x")
    for name in "de":
        reg.save(name, scenes(spark), f"{tmp_path}/{name}")
        assert reg.load(spark, name, f"{tmp_path}/{name}").count() == 2
    two = spark.range(2)
    assert reg.evaluate_cloud("d", two, two, lambda p, g: p).count() == 1 and reg.evaluate_cloud("e", two, two, lambda p, g: p).count() == 2
    found, failed = run_evaluators({"ok": lambda: two, "odd": lambda: two.select(F.raise_error(F.lit("boom"))), "old": lambda: two}, done={"old"})
    assert list(found) == ["ok"] and list(failed) == ["odd"] and "boom" in failed["odd"]


def test_sequence_texts(spark, tmp_path):
    poses = put(tmp_path / "p.txt", "1 0 0 4 0 1 0 5 0 0 1 6\n" * 4)
    k = put(tmp_path / "c.txt", "P2: 7 0 6 0 0 8 5 0 0 0 1 0\n")
    rows = text.kitti_sequence(spark, poses, k)
    assert rows.count() == 4 and rows.first().fx == 7.0
    other = rows.where("frame_idx < 3")
    assert sorted(r.frame_idx for r in text.shortest(rows, [other], ["file"]).collect()) == [0, 1, 2]
    odd = rows.withColumn("m", F.when(F.col("frame_idx") == 1, F.array(*[F.lit(float("nan"))] * 12)).otherwise(F.col("m")))
    text.write_trajectory(odd, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).count() == 3


def test_csv_export_quotes_and_leaves_nulls_empty(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "so", twice'), (2, None), (3, "line\nbreak")], "id int, note string")
    export_csv(rows.coalesce(1), str(tmp_path / "csv"))
    body = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert body == 'id,note\n1,"say ""so"", twice"\n2,\n3,"line\nbreak"\n'
    assert sorted(map(tuple, csv.reader(body.splitlines(keepends=True)))) == [("1", 'say "so", twice'), ("2", ""), ("3", "line\nbreak"), ("id", "note")]
