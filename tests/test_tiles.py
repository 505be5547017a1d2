"""Tiled shortest paths against a plain search of the whole map."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from trajecta.operators import tiles as ti
from trajecta.operators.grids import STEPS, line_cells
from trajecta.operators.tiles import map_tiles, plan_tiled_paths, sight_line


def walls(rnd, n, share, stripes=()):
    """Traversable cells of an n by n map with loose blocks and walls that leave one gap."""
    free = {(x, y) for x in range(n) for y in range(n) if rnd.random() > share}
    for k, x in enumerate(stripes):
        gap = 1 if k % 2 else n - 2
        free -= {(x, y) for y in range(n) if y != gap}
        free |= {(x + d, gap) for d in (-1, 0, 1)}
    return free | {(0, 0), (n - 1, n - 1)}


def steps_into(free, cell):
    for dx, dy in STEPS:
        a = (cell[0] + dx, cell[1] + dy)
        if a in free and (not dx or not dy or ((cell[0], a[1]) in free and (a[0], cell[1]) in free)):
            yield a, math.hypot(dx, dy)


def brute(free, start, goal):
    """Cost, path by the first step back in order, and its turns; None where there is none."""
    cost, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        c, here = heapq.heappop(heap)
        if c > cost[here] + 1e-12:
            continue
        for to, w in steps_into(free, here):
            if c + w < cost.get(to, math.inf) - 1e-12:
                cost[to] = c + w
                heapq.heappush(heap, (c + w, to))
    if goal not in cost:
        return None
    path = [goal]
    while path[-1] != start:
        here = path[-1]
        path.append(next(a for a, w in steps_into(free, here) if abs(cost.get(a, math.inf) + w - cost[here]) < 1e-9))
    path.reverse()
    kept, anchor, probe = [path[0]], 0, 2
    while probe < len(path):
        if all(c in free for c in line_cells(path[anchor], path[probe])):
            probe += 1
        else:
            anchor, probe = probe - 1, probe + 1
            kept.append(path[anchor])
    return cost[goal], path, kept if len(path) == 1 else [*kept, path[-1]]


def plan(spark, maps, asked, **options):
    free = spark.createDataFrame([(m, x, y) for m, cells in maps.items() for x, y in cells], "map_id string, px int, py int")
    requests = spark.createDataFrame(asked, "request_id long, map_id string, sx int, sy int, gx int, gy int")
    return {r.request_id: r for r in plan_tiled_paths(requests, free, ["map_id"], 0.05, **options).collect()}


@pytest.mark.parametrize(("n", "side", "broadcast_rows"), [(14, 5, ti.BROADCAST_ROWS), (7, 4, 0)])
def test_tiled_paths_are_those_of_the_whole_map(spark, monkeypatch, n, side, broadcast_rows):
    monkeypatch.setattr(ti, "BROADCAST_ROWS", broadcast_rows)
    rnd, e = random.Random(3), n - 1
    maps = {"open": walls(rnd, n, 0.0), "loose": walls(rnd, n, 0.25), "maze": walls(rnd, n, 0.1, (3, 9)[: n // 6]), "shut": walls(rnd, n, 0.0) - {(3, y) for y in range(n)}}
    # a map that does not begin at 0, to the left and above of it
    maps["moved"] = {(x - 40, y - 7) for x, y in maps["loose"]}
    asked = [(k, m, 0, 0, e, e) for k, m in enumerate(list(maps)[:4])] + [(10, "open", 3, 3, 3, 3), (11, "maze", e, e, 0, 0), (12, "shut", 3, 3, 0, 0), (14, "open", 5, 0, 2, e), (15, "none", 0, 0, 1, 1), (16, "moved", -40, -7, e - 40, e - 7)]
    got = plan(spark, maps, asked, side=side)
    assert set(got) == {r[0] for r in asked}
    for number, m, sx, sy, gx, gy in asked:
        free, row = maps.get(m, set()), got[number]
        if (sx, sy) not in free or (gx, gy) not in free:
            assert row.status == "blocked" and row.waypoints is None
            continue
        want = brute(free, (sx, sy), (gx, gy))
        if want is None:
            assert row.status == "no path" and row.cost is None
            continue
        assert row.status == "ok" and row.cost == pytest.approx(want[0]) and row.n_cells == len(want[1]), number
        assert [(w.px, w.py) for w in row.waypoints] == want[2], number
        assert row.path_length_m == pytest.approx(want[0] * 0.05, abs=1e-4)


def test_tiles_are_bounded(spark):
    free = spark.range(0, 60 * 60).select((F.col("id") % 60).cast("int").alias("px"), F.floor(F.col("id") / 60).cast("int").alias("py"))
    rows = map_tiles(free, [], 16).collect()
    inside = [r for r in rows if 0 <= r["tx"] < 4 and 0 <= r["ty"] < 4]
    assert max(len(r["cells"]) for r in rows) == 18 * 18 and len(inside) == 16


def test_sight_lines_are_the_lines_of_cells(spark):
    rnd = random.Random(1)
    ends = [tuple(rnd.randrange(-9, 10) for _ in range(4)) for _ in range(200)] + [(2, 2, 2, 2)]
    df = spark.createDataFrame(ends, "ax long, ay long, bx long, by long")
    for r in df.withColumn("line", sight_line(*[F.col(c) for c in ("ax", "ay", "bx", "by")])).collect():
        assert [(p.px, p.py) for p in r.line] == line_cells((r.ax, r.ay), (r.bx, r.by))
