"""Snapshots as a stream, datasets with pushed scenes, and members of archives."""

import io
import json
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.sources.archives import first_existing, npz_arrays, npz_cameras, raw_depth, zip_members
from trajecta.sources.scenes import PoseFolders, read_scenes
from trajecta.sources.snapshots import SnapshotReader, snapshot_stream


def test_snapshots_are_told_once_and_again_after_a_failure(tmp_path):
    docs, log = tmp_path / "docs", tmp_path / "log"
    docs.mkdir()
    reader = lambda: SnapshotReader(str(docs), ["pose.json", "path.json"], str(log))
    rows = lambda r, a, b: [x[:3] for p in r.partitions(a, b) for x in r.read(p)]
    r = reader()
    start = r.initialOffset()
    first = r.latestOffset()
    assert rows(r, start, first) == [("pose.json", "missing", None), ("path.json", "missing", None)]
    (docs / "pose.json").write_text('{"x": 1}')
    (docs / "path.json").write_text('{"half": ')
    second = r.latestOffset()
    assert rows(r, first, second) == [("pose.json", "ok", '{"x": 1}')]
    (docs / "pose.json").write_text('{"x": 2}')
    again = reader()  # after a restart, the batch that had begun gives what it gave, and nothing is told twice
    assert rows(again, first, second) == [("pose.json", "ok", '{"x": 1}')]
    third = again.latestOffset()
    assert rows(again, second, third) == [("pose.json", "ok", '{"x": 2}')] and again.latestOffset() == third
    again.commit(third)
    assert len(list(log.glob("*.json"))) == 2 and reader().latestOffset() == third  # the last entry of each stays
    (docs / "pose.json").unlink()
    assert rows(again, third, again.latestOffset()) == [("pose.json", "missing", None)]


def test_snapshot_stream_survives_restarts(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    name, where = "told", str(tmp_path / "out")

    def poll(stop_at):
        q = snapshot_stream(spark, str(docs), ["pose.json"], str(tmp_path / "log")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start(where)
        limit = time.time() + 60
        while time.time() < limit and seen() != stop_at:
            time.sleep(0.3)
        q.stop()
        assert seen() == stop_at, name

    def seen():
        try:
            return sorted((r.version, r.status, r.content and json.loads(r.content)["x"]) for r in spark.read.parquet(where).collect())
        except Exception:
            return []

    (docs / "pose.json").write_text('{"x": 1}')
    poll([(0, "ok", 1)])
    (docs / "pose.json").write_text('{"x": 2}')
    poll([(0, "ok", 1), (1, "ok", 2)])
    poll([(0, "ok", 1), (1, "ok", 2)])


def test_only_asked_scenes_are_opened(spark, tmp_path):
    line = "0 1 0 0 5 0 1 0 6 0 0 1 7\n"
    for scene, text in (("a", line), ("b", "# head\n\n" + line + line.replace("0 1", "1 1", 1)), ("broken", "1 2 3\n"), ("c", "")):
        (tmp_path / scene).mkdir()
        (tmp_path / scene / "poses.txt").write_text(text)
    read = lambda *scenes: read_scenes(spark, "pose_folders", PoseFolders, list(scenes) or None, path=str(tmp_path))
    df = read("a", "b", "none")
    assert df.columns == ["scene", "frame_idx", "m"] and df.rdd.getNumPartitions() == 2
    got = df.orderBy("scene", "frame_idx").collect()  # the broken one would fail
    assert [(r.scene, r.frame_idx, r.m[3]) for r in got] == [("a", 0, 5.0), ("b", 0, 5.0), ("b", 1, 5.0)]
    # filters on one DataFrame do not tell on other uses of it
    assert df.where("scene = 'a'").count() == 1 and df.count() == 3 and df.where("scene = 'b'").unionByName(df).count() == 5
    assert read("c").count() == 0 and read("none").count() == 0
    with pytest.raises(Exception, match="twelve numbers"):
        read().count()


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)


def test_members_and_cameras(spark, tmp_path):
    w2c = np.array([[0.0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]])
    npz = io.BytesIO()
    np.savez(npz, intrinsics=np.array([[500.0, 0, 320], [0, 510, 240], [0, 0, 1]]), extrinsics=w2c)
    depth = np.array([[1.0, np.inf, 0.0], [2.5, np.nan, 4.0]], dtype="<f4")
    archive(tmp_path / "one.zip", {"s1/cam/000.npz": npz.getvalue(), "s1/depth/000.JPG": depth.tobytes(), "s1/scan_5cm.pcd": b"small", "s1/scan.pcd": b"large", "s1/empty/": b""})
    archive(tmp_path / "two.zip", {"s2/scan.pcd": b"only", "s2/note.txt": b"x" * 50})
    (tmp_path / "no.txt").write_text("no archive")
    df = zip_members(spark, str(tmp_path), stretch=60)
    assert sorted((r.member, r.size) for r in df.select("member", "size").collect()) == sorted([("s1/cam/000.npz", len(npz.getvalue())), ("s1/depth/000.JPG", 24), ("s1/scan_5cm.pcd", 5), ("s1/scan.pcd", 5), ("s2/scan.pcd", 4), ("s2/note.txt", 50)])
    chosen = zip_members(spark, str(tmp_path), suffix=".pcd", stretch=60)
    assert chosen.rdd.getNumPartitions() == 2 and chosen.count() == 3  # one stretch an archive: the others are not unpacked
    assert zip_members(spark, str(tmp_path), "s2/").where("size > 10").count() == 1 and zip_members(spark, str(tmp_path / "one.zip"), "s9").count() == 0
    scenes = chosen.withColumn("scene", F.split("member", "/")[0])
    got = {r.scene: bytes(r.content) for r in first_existing(scenes, ["scene"], ["scan_5cm.pcd", "scan.pcd"]).collect()}
    assert got == {"s1": b"small", "s2": b"only"}
    cam = npz_cameras(npz_arrays(df.where(F.col("member").endswith(".npz")), ["member"]), ["member"]).first()
    assert (cam.fx, cam.fy, cam.cx, cam.cy) == (500.0, 510.0, 320.0, 240.0)
    assert np.allclose(np.array(cam.m).reshape(3, 4), np.linalg.inv(w2c)[:3])
    pixels = raw_depth(df.where(F.col("member").endswith(".JPG")), ["member"], 3, 2).orderBy("v", "u").collect()
    assert [(r.u, r.v, r.depth) for r in pixels] == [(0, 0, 1.0), (1, 0, None), (2, 0, None), (0, 1, 2.5), (1, 1, None), (2, 1, 4.0)]
    with pytest.raises(Exception, match="24 bytes|has 16 bytes"):
        raw_depth(df.where(F.col("member").endswith(".JPG")), ["member"], 2, 2).collect()
