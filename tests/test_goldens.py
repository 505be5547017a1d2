"""Goldens derived by hand from the definitions, and properties."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.functions import geometry as g
from trajecta.functions import text as tx
from trajecta.operators import frames as fr
from trajecta.operators import grids as gr
from trajecta.operators import joins
from trajecta.operators.alignment import align, icp, orthogonalize, trajectory_errors
from trajecta.operators import flow as fl
from trajecta.operators.clouds import visible_by_cone, visible_by_count, z_buffer
from trajecta.operators.joins import asof_nearest, nearest_point, ordered_pairs
from trajecta.operators.metrics import align_depth, auc, accuracy_under, cloud_metrics, depth_metrics, lower_median, pose_distances, pose_pair_errors, rank_metrics
from trajecta.operators.ranks import order_metrics
from trajecta.operators.robust import align_robust
from trajecta.streaming.frames import EVENT_SCHEMA, bounded_replay, bounded_stream, current, navigation_state, odometry, snapshots


def one(df):
    return df.first()


def test_auc_and_accuracy(spark):
    r = one(spark.createDataFrame([(0.5,), (2.0,), (3.0,), (10.0,)], "e double").agg(auc(F.col("e"), 3).alias("auc"), accuracy_under(F.col("e"), 3).alias("acc")))
    assert r.auc == pytest.approx(41.666667, abs=1e-6) and r.acc == 50.0  # 3.0 is in the last bin, but not under 3


def test_depth_without_and_with_scale(spark):
    px = spark.createDataFrame([(0, 2.0, 1.0), (0, 4.0, 2.0), (0, 8.0, 4.0)], "frame int, gt double, pred double")
    r = one(depth_metrics(px, []))
    assert (r.abs_rel, r.delta_1, r.delta_3) == (0.5, 0.0, 0.0)
    assert r.sq_rel == pytest.approx(1.166667, abs=1e-6) and r.rmse == pytest.approx(2.645751, abs=1e-6) and r.log_rmse == pytest.approx(0.693147, abs=1e-6)
    for mode in ("scale_only", "lstsq"):
        s = one(depth_metrics(align_depth(px, ["frame"], mode, 1), []))
        assert s.rmse == pytest.approx(0, abs=1e-9) and s.delta_1 == 100.0
    assert align_depth(px, ["frame"]).count() == 0  # under 100 pixels


def points(spark, rows):
    return spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(rows)], "scene int, point_id long, x double, y double, z double")


def test_chamfer_and_f1(spark):
    a, b = points(spark, [(0, 0, 0), (1, 0, 0)]), points(spark, [(0, 0, 0.1), (2, 0, 0)])
    near = lambda s, t: nearest_point(s, t, ["scene"], 0.2, 2)
    r = one(cloud_metrics(near(a, b), near(b, a), ["scene"], (0.5,)))
    assert (r.accuracy, r.completeness, r.chamfer) == pytest.approx((0.55, 0.55, 0.55)) and (r.precision, r.recall, r.f1) == (50.0, 50.0, 50.0)


def test_nearest_points_are_exact(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((80, 3)) * 3, np.round(rng.standard_normal((60, 3)), 1)
    got = {r.point_id: r for r in nearest_point(points(spark, a), points(spark, b), ["scene"], 0.3, 2).collect()}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    for i in range(80):
        assert got[i].distance == pytest.approx(d[i].min()) and got[i].near_id == int(np.flatnonzero(np.isclose(d[i], d[i].min()))[0])


def test_nearest_points_of_dense_clouds(spark, monkeypatch):
    monkeypatch.setattr(joins, "DENSE", 16)
    rng = np.random.default_rng(2)
    dense = rng.standard_normal((300, 3)) * 0.01 + 0.5
    b = np.concatenate([dense, np.repeat(dense[:1], 40, axis=0), rng.standard_normal((60, 3)) * 3])
    a = np.concatenate([rng.standard_normal((80, 3)) * 0.02 + 0.5, dense[:20], rng.standard_normal((40, 3)) * 3])
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    want = {i: (pytest.approx(d[i].min()), int(np.flatnonzero(d[i] == d[i].min())[0])) for i in range(len(a))}
    got = {r.point_id: (r.distance, r.near_id) for r in nearest_point(points(spark, a), points(spark, b), ["scene"], 0.8, 2).collect()}
    assert got == want
    near = {r.point_id: (r.distance, r.near_id) for r in joins.within_radius(points(spark, a), points(spark, b), ["scene"], 0.6).collect()}
    assert near == {i: w for i, w in want.items() if d[i].min() <= 0.6}


def test_asof_ties_go_to_the_earlier_row(spark):
    s = 1_000_000
    left = spark.createDataFrame([(1, 0), (1, s), (1, 5 * s), (2, 0)], "k int, t long")
    right = spark.createDataFrame([(1, s // 100, "A", 1), (1, 99 * s // 100, "B", 2), (1, 101 * s // 100, "C", 3), (1, 101 * s // 100, "D", 4)], "k int, t long, name string, id int")
    got = {(r.k, r.t): r.r_name for r in asof_nearest(left, right, ["k"], "t", "id", s // 50).collect()}
    assert got == {(1, 0): "A", (1, s): "B", (1, 5 * s): None, (2, 0): None}
    assert asof_nearest(left, right, ["k"], "t", "id", s // 50, inner=True).count() == 2


def test_asof_over_stretches_is_the_nearest_of_all(spark, monkeypatch):
    monkeypatch.setattr(joins, "STRETCH", 2)
    rnd = random.Random(6)
    left = [(k, rnd.randrange(-300, 300), i) for k in (1, 2, None) for i in range(60)]
    right = [(k, rnd.randrange(-300, 300), f"n{i}", i) for k in (1, 2) for i in range(50)]
    got = asof_nearest(spark.createDataFrame(left, "k int, t long, l int"), spark.createDataFrame(right, "k int, t long, name string, id int"), ["k"], "t", "id", 4).collect()
    assert len(got) == len(left)
    for r in got:
        near = sorted((abs(t - r.t), t, i) for k, t, _, i in right if k == r.k and abs(t - r.t) <= 4)
        assert r.r_id == (near[0][2] if near else None)


def test_umeyama_golden_and_robust_and_icp(spark):
    src = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    move = lambda p: (-2 * p[1] + 1, 2 * p[0] + 2, 2 * p[2] + 3)
    rows = [(0, *map(float, p), *map(float, move(p))) for p in src]
    schema = "scene int, sx double, sy double, sz double, tx double, ty double, tz double"
    r = one(align(spark.createDataFrame(rows, schema), ["scene"]))
    assert r.scale == pytest.approx(2) and r["align"] == pytest.approx([0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3], abs=1e-9)
    rnd = random.Random(3)
    more = [(0, *p, *move(p)) for p in ([rnd.random() for _ in range(3)] for _ in range(40))] + [(0, *[rnd.random() * 9 for _ in range(6)]) for _ in range(10)]
    r = one(align_robust(spark.createDataFrame(more, schema), ["scene"], 0.05))
    assert r.scale == pytest.approx(2, abs=1e-6) and r.n_inliers >= 40
    cloud = [[rnd.random() * 4 for _ in range(3)] for _ in range(60)]
    a = math.radians(1.0)
    turned = [(math.cos(a) * x - math.sin(a) * y + 0.02, math.sin(a) * x + math.cos(a) * y, z) for x, y, z in cloud]
    cols = ["point_id", "x", "y", "z"]
    pose, fitness, rmse = icp(points(spark, cloud).select(*cols), points(spark, turned).select(*cols), 0.3, 6)
    assert fitness == 1.0 and rmse < 1e-3 and pose[3] == pytest.approx(0.02, abs=1e-3)


def test_identity_and_similarity_leave_no_trajectory_error(spark):
    rnd, rows = random.Random(4), []
    for i in range(30):
        yaw, x, y = rnd.random(), rnd.random() * 5, i * 0.3
        rows.append((0, i, yaw, x, y))
    f = spark.createDataFrame(rows, "scene int, frame_idx int, yaw double, x double, y double")
    gt = g.planar_pose(F.col("yaw"), F.col("x"), F.col("y"))
    same = f.select("scene", "frame_idx", gt.alias("gt"), gt.alias("pred"))
    r = one(trajectory_errors(same, ["scene"], aligned=False))
    assert r.ate == 0 and r.rpe_trans == pytest.approx(0, abs=1e-9)
    moved = g.planar_pose(F.col("yaw") + 0.7, 3 * (F.cos(F.lit(0.7)) * F.col("x") - F.sin(F.lit(0.7)) * F.col("y")) + 1, 3 * (F.sin(F.lit(0.7)) * F.col("x") + F.cos(F.lit(0.7)) * F.col("y")) - 2)
    r = one(trajectory_errors(f.select("scene", "frame_idx", gt.alias("gt"), moved.alias("pred")), ["scene"]))
    assert r.ate == pytest.approx(0, abs=1e-7) and r.rpe_trans == pytest.approx(0, abs=1e-7)
    bad = same.withColumn("pred", F.when(F.col("frame_idx") != 3, F.col("pred")))
    assert one(trajectory_errors(bad, ["scene"], aligned=False)).n_frames == 29
    skew = orthogonalize(same.select("scene", g.pose(1, 0.1, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7).alias("m")).limit(1), "m").first().m
    m = np.array(skew).reshape(3, 4)
    assert np.allclose(m[:, :3] @ m[:, :3].T, np.eye(3)) and m[:, 3].tolist() == [5, 6, 7]


def test_sizes_names_and_samples(spark):
    d = spark.createDataFrame([(640, 480, "2024-03-12-keble-college-02")], "w int, h int, s string")
    w, h = g.area_budget_size(F.col("w"), F.col("h"), 255_000, 14)
    r = one(d.select(w.alias("w"), h.alias("h"), tx.scene_keyword(F.col("s")).alias("s"), tx.threshold_text(F.lit(0.05)).alias("a"), tx.threshold_text(F.lit(0.25)).alias("b"), g.octile(F.lit(0), F.lit(0), F.lit(3), F.lit(1)).alias("o")))
    assert (r.w, r.h, r.s, r.a, r.b) == (574, 434, "keble-college", "0.05", "0.25") and r.o == pytest.approx(3.414214, abs=1e-6)
    f = spark.range(10).select(F.lit(0).alias("k"), F.col("id").cast("int").alias("i"))
    assert [x.i for x in fr.sample_stride(f, "i", 1, None, 3).collect()] == [1, 4, 7]
    assert sorted(x.i for x in fr.sample_count(f, ["k"], "i", 4).collect()) == [0, 3, 6, 9]
    n = spark.createDataFrame([(1, 20)], "k int, n int")
    assert [(x.start, x.end) for x in fr.count_windows(n, ["k"], "n", 2, 4, 2, 2).orderBy("start").collect()] == [(0, 6), (4, 10), (8, 14), (12, 18), (16, 20)]
    assert [one(spark.range(1).select(fr.auto_interval(F.lit(x)).alias("i"))).i for x in (320, 321, 1000)] == [1, 2, 4]
    assert tx.deep_merge({"a": {"b": 1, "c": 2}, "l": [1]}, {"a": {"b": 3}, "l": []}) == {"a": {"b": 3, "c": 2}, "l": []}
    assert one(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double").agg(lower_median("x").alias("m"))).m == 2.0


def test_ranks_share_ties(spark):
    m = spark.createDataFrame([("a", "ate", 5.0), ("b", "ate", 5.0), ("c", "ate", 7.0), ("d", "ate", 9.0), ("a", "f1", 1.0), ("b", "f1", 2.0), ("a", "num_scenes", 3.0)], "method string, metric string, value double").withColumn("scene", F.lit(0))
    got = {(r.method, r.metric): (r["rank"], r.marked) for r in rank_metrics(m, ["scene"], []).collect()}
    assert got == {("a", "ate"): (1, True), ("b", "ate"): (1, True), ("c", "ate"): (3, True), ("d", "ate"): (4, False), ("a", "f1"): (2, True), ("b", "f1"): (1, True)}


def test_grid_of_a_room(spark):
    rows = [(0.0, 0.0, 0.0), (4.0, 3.0, 0.0), (2.0, 1.5, 2.0), (2.0, 1.5, 2.0), (4.0, 0.0, 1.0)]
    p = spark.createDataFrame([(i, u, v, h) for i, (u, v, h) in enumerate(rows)], "point_id long, u double, v double, h double")
    meta = gr.grid_meta(p, [], 0.05, 0.5)
    m = one(meta)
    assert (m.width_px, m.height_px, m.origin_u, m.origin_v) == (101, 81, -0.5, 3.5)
    cells = {(r.px, r.py): r.value for r in gr.density(gr.cells_of(p, meta, [], 0.05), []).collect()}
    assert cells[50, 40] == 255 and len(cells) == 4
    assert one(gr.floor_level(p, [], 0.05)).floor == 0.0 and one(gr.floor_level(p, [], 0.95)).floor == 2.0
    assert gr.dilated(spark.createDataFrame([(0, 0, 5, 5)], "px int, py int, width_px int, height_px int"), [], 1).count() == 3


def test_paths():
    cells = {(x, y) for x in range(3) for y in range(3)}
    cost = lambda p: sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False))
    assert cost(gr.find_path(cells, (0, 0), (2, 2))) == pytest.approx(2.828427, abs=1e-6)
    assert cost(gr.find_path(cells - {(1, 1)}, (0, 0), (2, 2))) == 4.0
    assert gr.find_path({(0, 0), (2, 2)}, (0, 0), (2, 2)) is None
    assert gr.pull_straight(cells, gr.find_path(cells, (0, 0), (2, 2))) == [(0, 0), (2, 2)]
    assert gr.line_cells((0, 0), (3, 1))[0] == (0, 0) and gr.line_cells((0, 0), (3, 1))[-1] == (3, 1)


def test_visibility_counts_closer_neighbours(spark):
    rows = [(0, u, v, 10.0 if (u, v) == (1, 1) else 1.0, u * 3 + v) for u in range(3) for v in range(3)] + [(0, 1, 1, 12.0, 99)]
    z = z_buffer(spark.createDataFrame(rows, "frame int, u int, v int, z double, point_id int"), ["frame"])
    got = {(r.u, r.v): (r.n_closer, r.visible) for r in visible_by_count(z.select("frame", "u", "v", "depth"), ["frame"], 1, 3.0, 8).collect()}
    assert got[1, 1] == (8, False) and got[0, 0] == (0, True) and len(got) == 9


def test_stream_equals_replay_and_keeps_bounded_state(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(f"s{k}", i, rnd.random()) for k in range(3) for i in range(40)]
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], EVENT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    events = spark.readStream.schema(EVENT_SCHEMA).parquet(f"{tmp_path}/in")
    q = bounded_stream(events, 4, 5, 1.0, 6).writeStream.format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(90)
    live = sorted(map(tuple, spark.table("live").collect()))
    assert live == sorted(map(tuple, bounded_replay(spark.createDataFrame(rows, EVENT_SCHEMA), 4, 5, 1.0, 6).collect()))
    assert len(live) == 120 and max(r[5] for r in live) <= 5


def test_short_sequences_come_out_too(spark, tmp_path):
    rows = [("short", i, 0.1) for i in range(3)] + [("long", i, 0.1) for i in range(9)]
    got = [tuple(r) for r in bounded_replay(spark.createDataFrame(rows, EVENT_SCHEMA), 5, 2, 1.0, 30).orderBy("seq", "frame_idx").collect()]
    assert [r[:4] for r in got if r[0] == "short"] == [("short", i, "first", True) for i in range(3)]
    assert [r[3] for r in got if r[0] == "long"] == [True] * 6 + [False] * 3  # the first streamed frame is a keyframe
    spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(EVENT_SCHEMA).parquet(f"{tmp_path}/in")
    q = bounded_stream(events, 5, 2, 1.0, 30, idle_ms=1000).writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    until = time.time() + 60
    while time.time() < until and spark.table("idle").count() < 12:
        time.sleep(1)
    q.stop()
    assert sorted(map(tuple, spark.table("idle").collect())) == sorted(got)


def flow_rows(spark, n_frames=40, seed=9):
    rnd, rows = random.Random(seed), []
    for k in range(3):
        yaw = x = 0.0
        for i in range(n_frames - 7 * k):
            yaw, x = yaw + rnd.uniform(-0.05, 0.05), x + rnd.uniform(0, 0.3)
            c, s = math.cos(yaw), math.sin(yaw)
            rows.append((k, i, [c, 0.0, s, x, 0.0, 1.0, 0.0, 0.1 * k, -s, 0.0, c, 0.2 * i], [0.0, 8.0, 16.0], [0.0, 8.0, 8.0], [3.0 + k, 0.0, 5.0]))
    return rows, spark.createDataFrame(rows, "s int, frame_idx int, pose array<double>, u array<double>, v array<double>, depth array<double>")


def test_flow_keyframes_and_windows_match_a_loop(spark):
    camera, scale, most, gap, size, overlap = (40.0, 36.0, 16.0, 12.0), 3, 2.0, 4, 7, 4
    rows, df = flow_rows(spark)
    matrix = lambda m: np.vstack([np.array(m).reshape(3, 4), [0, 0, 0, 1]])

    def mean_flow(cur, ref):
        out = []
        for u, v, z in zip(*cur[3:], strict=True):
            if z > 1e-6:
                p = np.linalg.inv(matrix(ref)) @ matrix(cur[2]) @ np.array([(u - 16) / 40 * z, (v - 12) / 36 * z, z, 1])
                if p[2] > 1e-6:
                    out.append(math.hypot(40 * p[0] / p[2] + 16 - u, 36 * p[1] / p[2] + 12 - v))
        return sum(out) / len(out) if out else 0.0

    def window(own, start, target):
        out, keys, at = [], 0, start
        while at < len(own) and (at - start < scale or keys < target):
            flow = 0.0
            if at - start < scale:
                kind, pose, last = 0, own[at][2], at
            else:
                flow = mean_flow(own[at], pose)
                kind = 1 if not keys or flow > most or at - last >= gap else 2
                if kind == 1:
                    pose, last, keys = own[at][2], at, keys + 1
            out.append((at, kind, round(flow, 6)))
            at += 1
        return out, at

    keys = [tuple(r) for r in fl.flow_keyframes(df, ["s"], camera, scale, most, gap).collect()]
    wins = [tuple(r) for r in fl.flow_windows(df, ["s"], camera, size, scale, overlap, most, gap).collect()]
    for k in range(3):
        own = [r for r in rows if r[0] == k]
        want, _ = window(own, 0, 10**9)
        assert [(i, kind, round(f, 6)) for s, i, kind, f in keys if s == k] == want and {kind for _, kind, _ in want} == {0, 1, 2}
        start, number, want = 0, 0, []
        while True:
            part, end = window(own, start, size - scale)
            want += [(number, *r) for r in part]
            if end >= len(own):
                break
            start, number = max(end - overlap, start + scale), number + 1
        assert [(w, i, kind, round(f, 6)) for s, w, i, kind, f in wins if s == k] == want and number > 1


def test_flow_matrix_and_pose_distances_match_numpy(spark):
    rows, df = flow_rows(spark, 18)
    poses = {(r[0], r[1]): np.vstack([np.array(r[2]).reshape(3, 4), [0, 0, 0, 1]]) for r in rows}

    def log_length(rel, beta):
        angle = math.acos(min(1, max(-1, (np.trace(rel[:3, :3]) - 1) / 2)))
        w = np.array([rel[2, 1] - rel[1, 2], rel[0, 2] - rel[2, 0], rel[1, 0] - rel[0, 1]]) * (angle / (2 * math.sin(angle)) if angle > 1e-9 else 0.5)
        k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
        v = np.eye(3) + sum(np.linalg.matrix_power(k, n) / math.factorial(n + 1) for n in range(1, 18))
        return math.sqrt((np.linalg.solve(v, beta * rel[:3, 3]) ** 2).sum() + angle**2)

    got = {(r.s, r.i, r.j): r.distance for r in pose_distances(df, ["s"]).collect()}
    assert len(got) == sum(n * (n - 1) // 2 for n in (18, 11, 4))
    for (s, i, j), value in got.items():
        assert value == pytest.approx(log_length(np.linalg.inv(poses[s, i]) @ poses[s, j], 2.5), abs=1e-6)


def test_pairs_by_blocks_are_all_pairs(spark):
    df = spark.createDataFrame([(g, i, i * 1.5) for g, n in ((0, 23), (1, 1), (2, 8)) for i in range(n)], "g int, i int, x double")
    for block in (4, 5, 256):
        pairs = sorted((r.g, r.a_i, r.b_i, r.a_x, r.b_x) for r in ordered_pairs(df, ["g"], "i", ["x"], block=block).collect())
        assert pairs == [(g, i, j, i * 1.5, j * 1.5) for g, n in ((0, 23), (1, 1), (2, 8)) for i in range(n) for j in range(i + 1, n)]
        assert ordered_pairs(df, ["g"], "i", ["x"], loops=True, block=block).count() == 23**2 + 1 + 64


def test_pair_errors_of_rigid_and_other_poses_match_numpy(spark):
    rng, rows = np.random.default_rng(5), []
    for s in range(2):  # the second scene's rotations carry a scale
        for i in range(7):
            q, p = (np.linalg.qr(rng.standard_normal((3, 3)))[0] for _ in range(2))
            q, p = (m * np.sign(np.linalg.det(m)) * (1.0 if s == 0 else 1.0 + 1e-3 * i) for m in (q, p))
            t = rng.standard_normal((2, 3)) if i != 3 else np.zeros((2, 3)) + (rows[-1][2][3::4] if s == 0 else 0)
            rows.append((s, i, np.column_stack([q, t[0]]).ravel().tolist(), np.column_stack([p, t[1]]).ravel().tolist()))
    df = spark.createDataFrame(rows, "s int, frame_idx int, gt array<double>, pred array<double>")
    got = {(r.s, r.i, r.j): (r.r_err, r.t_err) for r in pose_pair_errors(df, ["s"]).collect()}
    full = {(r[0], r[1]): [np.vstack([np.array(m).reshape(3, 4), [0, 0, 0, 1]]) for m in r[2:]] for r in rows}
    assert len(got) == 42
    for (s, i, j), (r_err, t_err) in got.items():
        a, b = (np.linalg.inv(full[s, i][k]) @ full[s, j][k] for k in (0, 1))
        if s == 0:
            angle = math.degrees(math.acos(min(1, max(-1, (np.trace(a[:3, :3] @ b[:3, :3].T) - 1) / 2))))
            assert r_err == pytest.approx(angle, abs=1e-4)
        na, nb = np.linalg.norm(a[:3, 3]), np.linalg.norm(b[:3, 3])
        cos = a[:3, 3] @ b[:3, 3] / ((na + 1e-15) * (nb + 1e-15)) if na > 1e-12 else 0.0
        assert t_err == pytest.approx(math.degrees(math.acos(min(1, abs(cos)))), abs=1e-4)
    assert got[0, 2, 3][1] == pytest.approx(90.0)  # no way between the two ground-truth positions


def test_cone_visibility_counts_cosines_of_every_neighbour(spark):
    # neighbours on the way to the camera in three quadrants, one behind in the fourth
    rows = [(0, 0, 0, 2.0), (0, 1, 1, 1.0), (0, -1, -1, 9.0), (0, 1, -1, 1.0), (0, -1, 1, 1.0)]
    df = spark.createDataFrame(rows, "frame int, u int, v int, depth double")
    r = one(visible_by_cone(df, ["frame"], 1e6, 1e6, 0.0, 0.0, 1, 1.9).where("u = 0 and v = 0"))
    assert r.cover == pytest.approx(2.0, abs=1e-3) and not r.visible
    alone = one(visible_by_cone(df.limit(1), ["frame"], 1e6, 1e6, 0.0, 0.0, 1, 1.9))
    assert alone.cover == -4.0 and alone.visible


def test_metric_and_category_orders(spark):
    names = ["AUC_30", "num_pairs", "AUC_3", "frames", "auc_15"]
    got = order_metrics(spark.createDataFrame([(n,) for n in names], "name string"), "name").orderBy("place").collect()
    assert [r.name for r in got] == ["AUC_3", "auc_15", "AUC_30", "frames", "num_pairs"]


def test_odometry_and_navigation(spark):
    c = spark.createDataFrame([(1, 0, 1.0, 0.0), (1, 1, 2.0, 90.0), (1, 2, 0.0, 300.0)], "k int, i int, forward double, turn double")
    got = [(r.i, r.x, r.y, r.yaw) for r in odometry(c, ["k"], "i").orderBy("i").collect()]
    assert got == [(0, 1.0, 0.0, 0.0), (1, 1.0, 2.0, 90.0), (2, 1.0, 2.0, 30.0)]
    e = spark.createDataFrame([(1, i, x) for i, x in enumerate(["start", "goal", None, "start", "stop"])], "k int, i int, event string")
    assert [x.state for x in navigation_state(e, ["k"], "i").orderBy("i").collect()] == ["IDLE", "GOAL_SELECTED", "GOAL_SELECTED", "NAVIGATING", "STOP"]


def test_line_cells_round_halves_away_from_the_start():
    assert gr.line_cells((0, 0), (4, 2)) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)]
    assert gr.line_cells((4, 2), (0, 0)) == [(4, 2), (3, 1), (2, 1), (1, 0), (0, 0)]
    assert gr.line_cells((1, 1), (0, -3)) == [(1, 1), (1, 0), (0, -1), (0, -2), (0, -3)] and gr.line_cells((2, 5), (2, 5)) == [(2, 5)]


def test_snapshots_keep_the_latest_rows(spark, tmp_path):
    schema = "k string, at long, x double"
    for part in range(3):
        spark.createDataFrame([("a", part, part * 1.0), (f"b{part}", part, 5.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    assert current(spark, f"{tmp_path}/out") is None
    q = snapshots(events, f"{tmp_path}/out", f"{tmp_path}/c", ["k"], "at", 1)
    until = time.time() + 60
    while time.time() < until and ((now := current(spark, f"{tmp_path}/out")) is None or now.count() < 4):
        time.sleep(1)
    q.stop()
    assert sorted(map(tuple, current(spark, f"{tmp_path}/out").collect())) == [("a", 2, 2.0), ("b0", 0, 5.0), ("b1", 1, 5.0), ("b2", 2, 5.0)]
