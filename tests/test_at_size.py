"""Joins, matrices and relaxations whose work grows no faster than their input, and odd rows in them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.functions.geometry import compose, invert_affine, slerp
from trajecta.functions.text import frame_key
from trajecta.operators import flow as fl
from trajecta.operators import grids, joins, tiles
from trajecta.plans import registry


def test_flow_matrix_takes_blocks_of_frames_and_no_pixel_of_unknown_depth(spark):
    rnd = random.Random(4)
    turn = lambda a, x, y: [math.cos(a), -math.sin(a), 0.0, x, math.sin(a), math.cos(a), 0.0, y, 0.0, 0.0, 1.0, 0.0]
    poses = {(s, 1000 * i): turn(rnd.random(), rnd.random(), rnd.random()) for s in "ab" for i in range(9)}
    poses["a", 2000], poses["a", 3000] = None, [0.0] * 12
    pixels = [(s, i, float(u), 4.0 * u, math.nan if u == 5 and i == 4000 else 0.1 if u > 1 and i == 5000 else 2.0 + u) for s, i in poses if i != 6000 for u in range(6)]
    df = spark.createDataFrame([(*k, m) for k, m in poses.items()], "g string, frame_idx long, pose array<double>")
    out = fl.flow_distance_matrix(df, spark.createDataFrame(pixels, "g string, frame_idx long, u double, v double, depth double"), ["g"], 40.0, 36.0, 16.0, 12.0, most=9.0, block=4)
    assert "_fine" not in out._jdf.queryExecution().analyzed().toString()  # pixels of pairs are no rows
    got = {(r.g, r.i, r.j): r.distance for r in out.collect()}

    def seen(s, i, j):
        """(counts, flow) of every pixel of i seen from j."""
        if poses[s, i] is None or poses[s, j] in (None, [0.0] * 12):
            return []
        a, b = (np.array(poses[s, k]).reshape(3, 4) for k in (i, j))
        rows = []
        for u, v, z in [p[2:] for p in pixels if p[:2] == (s, i)]:
            x = np.linalg.solve(b[:, :3], a[:, :3] @ [(u - 16) / 40 * z, (v - 12) / 36 * z, z] + a[:, 3] - b[:, 3])
            rows.append((bool(x[2] > 0.2 and z > 0.2), min(math.hypot(40 * x[0] / x[2] + 16 - u, 36 * x[1] / x[2] + 12 - v), 9.0)))
        return rows

    assert set(got) == {(s, i, j) for s, i in poses for t, j in poses if s == t and (i, j) != (6000, 6000)}
    for (s, i, j), distance in got.items():
        both = seen(s, i, j) + seen(s, j, i)
        fine = [f for ok, f in both if ok]
        assert distance == (None if not both else math.inf if len(fine) / len(both) < 0.7 else pytest.approx(sum(fine) / len(fine)))


def test_names_of_parts_from_a_million_on_are_those_of_the_sql(spark, tmp_path):
    spark.createDataFrame([(7, "SMALL", 1, 1.0), (999_999, "ECONOMY", 2, 1.0), (1_234_567, "LARGE", 3, 1.0)], "p_partkey long, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.frame_key for r in registry.queries()["f30_f34_f39_names"](spark, str(tmp_path)).collect()}
    assert got == {7: "000007", 999_999: "999999", 1_234_567: "123456"}  # lpad(CAST(p_partkey AS VARCHAR), 6, '0')
    assert spark.range(1_234_567, 1_234_568).select(frame_key(F.col("id"))).first()[0] == "1234567"  # the operator keeps numbers whole


def test_points_of_crowded_cubes_meet_few_others(spark, monkeypatch):
    rng, met = np.random.default_rng(5), []
    b = np.concatenate([rng.random((1500, 3)), [[3.0, 3.0, 3.0]]])
    a = np.concatenate([rng.random((500, 3)), [[2.2, 2.4, 2.9], [1.3, 1.2, 1.1], [9.0, 9.0, 9.0]]])
    table = lambda rows: spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(rows)], "scene int, point_id long, x double, y double, z double")
    best = joins._best
    monkeypatch.setattr(joins, "_best", lambda m, keys, tid: met.append(m.count()) or best(m, keys, tid))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    want = {i: (pytest.approx(d[i].min()), int(d[i].argmin())) for i in range(len(a))}
    assert {r.point_id: (r.distance, r.near_id) for r in joins.nearest_point(table(a), table(b), ["scene"], 1.0, 2).collect()} == want
    near = {r.point_id: (r.distance, r.near_id) for r in joins.within_radius(table(a), table(b), ["scene"], 1.0).collect()}
    assert near == {i: w for i, w in want.items() if d[i].min() <= 1.0} and len(near) == len(a) - 2
    assert sum(met) < 2 * 200 * len(a)  # all in a cube of side 1 would be 1500 a point


def test_mean_flow_from_relative_poses(spark):
    pose = lambda a, x: [math.cos(a), -math.sin(a), 0.0, x, math.sin(a), math.cos(a), 0.0, 0.5, 0.0, 0.0, 1.0, 0.0]
    rows = [(i, pose(0.1 * i, 0.2), pose(0.3, 0.1 * i), float(u), 8.0, 2.0 + u, 40.0, 36.0, 16.0, 12.0) for i in range(3) for u in (0, 8, 16)]
    both = spark.createDataFrame(rows, "i int, cur array<double>, ref array<double>, u double, v double, depth double, fx double, fy double, cx double, cy double")
    rel = both.withColumn("rel", compose(invert_affine(F.col("ref")), F.col("cur"))).drop("cur", "ref")
    want, got = ({r.i: (r.flow, r.n_valid) for r in fl.mean_flow(p, ["i"]).collect()} for p in (both, rel))
    assert got == want and all(n == 3 and f > 0 for f, n in got.values())


def test_tiles_relaxed_together_are_those_relaxed_one_by_one():
    rnd, side = random.Random(8), 5
    cells = [[k for k in range((side + 2) ** 2) if rnd.random() < share] for share in (0.0, 0.5, 0.8, 1.0) for _ in range(5)]
    seeds = [[{"x": float(k % 7), "y": float(k // 7), "cost": rnd.random() * 9} for k in rnd.sample(own, min(3, len(own)))] for own in cells]
    together = tiles.relax_together(cells, seeds, side)
    for k, own in enumerate(cells):
        assert np.allclose(together[k], tiles.TileCosts(own, side).relax([(int(s["x"]), int(s["y"]), s["cost"]) for s in seeds[k]]))


def test_shortest_costs_without_joins_of_cells(spark, monkeypatch):
    """Costs from one aggregate a round, as joins of cells are broadcast through the driver."""
    rnd, plans = random.Random(6), []
    free = {(m, x, y) for m in (1, 2) for x in range(-1, 6) for y in range(6) if rnd.random() < 0.8 or (x, y) == (0, 0)} - {(2, 0, 0)}
    rows = spark.createDataFrame([*free, *list(free)[:3], (None, 0, 0), (1, None, 0)], "m int, px int, py int")
    cut = grids.cut
    monkeypatch.setattr(grids, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    moves = grids.edges(rows, ["m"])
    got = {tuple(r)[:3]: r.cost for r in grids.shortest_costs(moves, (0, 0), ["m"]).collect()}
    assert plans and not any("Join" in p for p in plans)
    at = {(x, y) for m, x, y in free if m == 1}
    steps = {(1, x, y, x + i, y + j) for x, y in at for i, j in grids.STEPS if {(x + i, y + j), (x + i, y), (x, y + j)} <= at}
    assert sorted(tuple(r)[:5] for r in moves.where("m = 1").collect()) == sorted(steps)
    paths = {p: grids.find_path(at, (0, 0), p) for p in at}
    length = lambda path: sum(math.dist(a, b) for a, b in zip(path, path[1:], strict=False))
    assert got == {(1, *p): pytest.approx(length(path)) for p, path in paths.items() if path}
    near = {tuple(r)[:3]: r.cost for r in grids.shortest_costs(moves, (0, 0), ["m"], rounds=1).collect()}
    assert near == {(1, 0, 0): 0.0} | {(1, x, y): math.hypot(x, y) for _, a, b, x, y in steps if (a, b) == (0, 0)}
    assert grids.shortest_costs(moves.where("m > 5"), (0, 0), ["m"]).isEmpty()


def test_slerp_names_its_angle_once(spark):
    quats = [(0.0, 0.0, math.sin(a), math.cos(a)) for a in (0.0, 0.001, 0.4, 1.2, 3.0)]
    df = spark.createDataFrame([(i, j, {"x": p[0], "y": p[1], "z": p[2], "w": p[3]}, {"x": q[0], "y": q[1], "z": q[2], "w": q[3]}) for i, p in enumerate(quats) for j, q in enumerate(quats)],
                               "i int, j int, p struct<x:double,y:double,z:double,w:double>, q struct<x:double,y:double,z:double,w:double>")
    out = df.select("i", "j", slerp(F.col("p"), F.col("q"), F.lit(0.25)).alias("s"))
    assert out._jdf.queryExecution().analyzed().toString().count("ACOS(") == 1  # it was named 80 times
    for r in out.collect():
        a, b = np.array(quats[r.i]), np.array(quats[r.j])
        b = -b if a @ b < 0 else b
        t = math.acos(min(a @ b, 1.0))
        want = 0.75 * a + 0.25 * b if a @ b > 0.9995 else (math.sin(0.75 * t) * a + math.sin(0.25 * t) * b) / math.sin(t)
        assert list(r.s) == pytest.approx((want / np.linalg.norm(want)).tolist(), abs=1e-12)


def test_aligned_errors_broadcast_no_frames(spark):
    from trajecta.operators.alignment import trajectory_errors

    rnd = random.Random(8)
    turn = lambda a, x, y: [math.cos(a), -math.sin(a), 0.0, x, math.sin(a), math.cos(a), 0.0, y, 0.0, 0.0, 1.0, 0.0]
    flat = [0.0] * 12
    rows = [(s, i, turn(rnd.random(), rnd.random(), rnd.random()), flat if (s, i) == (2, 3) else turn(rnd.random(), rnd.random(), rnd.random())) for s in (1, 2) for i in range(6)]
    rows += [(3, 0, turn(1.0, 2.0, 3.0), turn(1.0, 2.0, 4.0)), (None, 0, rows[0][2], rows[0][3]), (None, 1, rows[1][2], rows[1][3])]
    df = spark.createDataFrame(rows, "s int, frame_idx int, gt array<double>, pred array<double>")
    out = trajectory_errors(df, ["s"])
    got = {r.s: r for r in out.collect()}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()  # it took the frames where their shuffle was small
    assert set(got) == {1, 2, 3} and got[3].rpe_trans is None and got[3].n_frames == 1
    plain = {r.s: r for r in trajectory_errors(df, ["s"], aligned=False).collect()}
    assert plain[None].n_frames == 2 and plain[None].rpe_trans is None
    poses = {(s, i): [np.vstack([np.array(m).reshape(3, 4), [0, 0, 0, 1]]) for m in (g, p)] for s, i, g, p in rows}
    lengths = []
    for i in range(1, 6):
        (g0, p0), (g1, p1) = poses[1, i - 1], poses[1, i]
        e = np.linalg.inv(np.linalg.inv(g0) @ g1) @ np.linalg.inv(p0) @ p1
        lengths.append(np.linalg.norm(e[:3, 3]))
    assert plain[1].rpe_trans == pytest.approx(math.sqrt(np.mean(np.square(lengths))))
    assert plain[1].ate == pytest.approx(math.sqrt(np.mean([((poses[1, i][0] - poses[1, i][1])[:3, 3] ** 2).sum() for i in range(6)])))
