"""Shortest paths on maps of any size, tile by tile.

A map is cut into square tiles, each a row with its traversable cells and a rim of one cell of its
neighbours. A round relaxes, in parallel, the tiles that a better cost has reached at their rim;
between rounds only costs of cells at tile borders are kept. Paths are traced back tile by tile,
and turns are found by joining the cells of sight lines with the traversable cells. No task holds
more than a tile, and no map is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.operators.grids import STEPS
from trajecta.operators.lineage import cut

EPS = 1e-9
#: rows of sight-line cells (about 50 bytes each) up to which they are broadcast to the map's cells
BROADCAST_ROWS = 200_000
NEIGHBOURS = [(0, 0), *STEPS]


def _tile(x: Column, side: int) -> Column:
    return F.floor(x / side).cast("int")


def octile_to_goal(x: Column, y: Column) -> Column:
    dx, dy = F.abs(x - F.col("gx")), F.abs(y - F.col("gy"))
    return dx + dy + F.lit(math.sqrt(2) - 2) * F.least(dx, dy)


def _around(cells: DataFrame, side: int) -> DataFrame:
    """Every cell once for each tile that has it inside or on its rim, with the tile and the cell's place in it, from 0 on the rim to side + 1."""
    spread = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NEIGHBOURS])
    out = cells.withColumn("_o", F.explode(spread)).withColumn("tx", _tile(F.col("px"), side) + F.col("_o.i")).withColumn("ty", _tile(F.col("py"), side) + F.col("_o.j")).drop("_o")
    x, y = F.col("px") - F.col("tx") * side + 1, F.col("py") - F.col("ty") * side + 1
    out = out.withColumn("_x", x.cast("int")).withColumn("_y", y.cast("int"))
    return out.where(F.col("_x").between(0, side + 1) & F.col("_y").between(0, side + 1))


def map_tiles(free: DataFrame, by: list[str], side: int) -> DataFrame:
    """(by, tx, ty, cells): a row a tile with the places of its traversable cells, rim included: (side + 2) squared at most."""
    around = _around(free.select(*by, "px", "py").distinct(), side)
    return around.groupBy(*by, "tx", "ty").agg(F.collect_list((F.col("_y") * (side + 2) + F.col("_x")).cast("int")).alias("cells"))


class TileCosts:
    """One tile: what moves it allows, and the least costs of its cells from known ones."""

    def __init__(self, cells, side: int) -> None:
        n = side + 2
        free = np.zeros(n * n, dtype=bool)
        free[np.asarray(cells, dtype=np.int64)] = True
        self.free, self.n, self.moves = free.reshape(n, n), n, []
        inner = slice(1, n - 1)
        for dx, dy in STEPS:  # from (x + dx, y + dy) into (x, y)
            ys, xs = slice(1 + dy, n - 1 + dy), slice(1 + dx, n - 1 + dx)
            allowed = self.free[inner, inner] & self.free[ys, xs]
            if dx and dy:
                allowed = allowed & self.free[inner, xs] & self.free[ys, inner]
            self.moves.append((dx, dy, ys, xs, math.hypot(dx, dy), allowed))

    def relax(self, seeds) -> np.ndarray:
        """Costs from seeds (x, y, cost), by sweeps over the whole tile until none falls; cells of the rim keep theirs."""
        cost = np.full((self.n, self.n), np.inf)
        for x, y, c in seeds:
            cost[y, x] = min(cost[y, x], c)
        inner = cost[1:-1, 1:-1]
        while True:
            before = inner.copy()
            for _, _, ys, xs, w, allowed in self.moves:
                np.minimum(inner, np.where(allowed, cost[ys, xs] + w, np.inf), out=inner)
            if not (inner < before - EPS).any():
                return cost

    def trace(self, cost: np.ndarray, x: int, y: int) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
        """Cells from (x, y) back along least costs, and the cell of the rim where the way goes on (None at its start)."""
        out = []
        while True:
            out.append((x, y))
            if cost[y, x] <= EPS:
                return out, None
            for dx, dy, _, _, w, allowed in self.moves:  # the first of equal ways in the order of steps
                if allowed[y - 1, x - 1] and abs(cost[y + dy, x + dx] + w - cost[y, x]) <= EPS:
                    x, y = x + dx, y + dy
                    break
            else:
                raise ValueError("no way back from a reached cell")
            if not (1 <= x <= self.n - 2 and 1 <= y <= self.n - 2):
                return out, (x, y)


def _work(asked: DataFrame, tiles: DataFrame, known: DataFrame, by: list[str], side: int) -> DataFrame:
    """asked(request_id, by, tx, ty, ...) with the tile's cells and all known costs in it: a row a request and tile."""
    seeds = _around(known, side).groupBy("request_id", *by, "tx", "ty").agg(F.collect_list(F.struct(F.col("_x").cast("double").alias("x"), F.col("_y").cast("double").alias("y"), "cost")).alias("seeds"))
    return asked.join(tiles, [*by, "tx", "ty"]).join(seeds, ["request_id", *by, "tx", "ty"])


#: cells of tiles that are relaxed in one go
AT_ONCE = 1 << 18


def relax_together(cells: list, seeds: list, side: int) -> np.ndarray:
    """TileCosts.relax of several tiles, as (tiles, y, x): sweeps over all of them until no cost falls."""
    n = side + 2
    free, cost = np.zeros((len(cells), n * n), dtype=bool), np.full((len(cells), n, n), np.inf)
    for k, (own, known) in enumerate(zip(cells, seeds, strict=True)):
        free[k, np.asarray(own, dtype=np.int64)] = True
        for s in known:
            x, y = int(s["x"]), int(s["y"])
            cost[k, y, x] = min(cost[k, y, x], s["cost"])
    free, moves, inner = free.reshape(-1, n, n), [], slice(1, n - 1)
    for dx, dy in STEPS:
        ys, xs = slice(1 + dy, n - 1 + dy), slice(1 + dx, n - 1 + dx)
        allowed = free[:, inner, inner] & free[:, ys, xs]
        if dx and dy:
            allowed = allowed & free[:, inner, xs] & free[:, ys, inner]
        moves.append((ys, xs, np.where(allowed, math.hypot(dx, dy), np.inf)))
    inside = cost[:, inner, inner]
    while True:
        before = inside.copy()
        for ys, xs, w in moves:
            np.minimum(inside, cost[:, ys, xs] + w, out=inside)
        if not (inside < before - EPS).any():
            return cost


def _relax_tiles(side: int, by: list[str], columns: list[str]):
    together = max(1, AT_ONCE // (side + 2) ** 2)
    rim = np.zeros((side + 2, side + 2), dtype=bool)
    rim[1, 1:-1] = rim[-2, 1:-1] = rim[1:-1, 1] = rim[1:-1, -2] = True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), together):
                rows = batch.iloc[at : at + together].reset_index(drop=True)
                cost = relax_together(rows["cells"].tolist(), rows["seeds"].tolist(), side)
                told = np.repeat(rim[None], len(rows), axis=0)
                gx, gy = (rows[g].to_numpy() - rows[t].to_numpy() * side + 1 for g, t in (("gx", "tx"), ("gy", "ty")))
                own = np.flatnonzero((gx >= 1) & (gx <= side) & (gy >= 1) & (gy <= side))
                told[own, gy[own].astype(np.int64), gx[own].astype(np.int64)] = True
                k, y, x = np.nonzero(told & np.isfinite(cost))
                out = {c: rows[c].to_numpy()[k] for c in ("request_id", *by)} | {"px": x - 1 + rows["tx"].to_numpy()[k] * side, "py": y - 1 + rows["ty"].to_numpy()[k] * side, "cost": cost[k, y, x]}
                yield pd.DataFrame(out, columns=columns)

    return run


def tiled_costs(requests: DataFrame, tiles: DataFrame, by: list[str], side: int) -> DataFrame:
    """(request_id, by, px, py, cost) of cells at tile borders and of the goal: least costs from the start, exact for all cells that a shortest path to the goal may use.

    Requests(request_id, by, sx, sy, gx, gy) have traversable ends. A cost goes on to the tiles
    around only while it and the octile distance to the goal are not over the best way that is
    known. Rounds end when no border cost falls.
    """
    goals = cut(requests.select("request_id", "gx", "gy"))
    known = cut(requests.select("request_id", *by, F.col("sx").cast("long").alias("px"), F.col("sy").cast("long").alias("py"), F.lit(0.0).alias("cost")))
    columns = known.columns
    schema = ", ".join(f"`{c}` {known.schema[c].dataType.simpleString()}" for c in columns)
    front = known
    while True:
        reached = _around(front, side).select("request_id", *by, "tx", "ty").distinct().join(goals, "request_id")
        work = _work(reached, tiles, known, by, side)
        found = work.mapInPandas(_relax_tiles(side, by, columns), schema).groupBy("request_id", *by, "px", "py").agg(F.min("cost").alias("new"))
        better = cut(found.join(known, ["request_id", *by, "px", "py"], "left").where(F.col("cost").isNull() | (F.col("new") < F.col("cost") - EPS)).select("request_id", *by, "px", "py", F.col("new").alias("cost")))
        if better.isEmpty():
            return known
        known = cut(known.unionByName(better).groupBy("request_id", *by, "px", "py").agg(F.min("cost").alias("cost")))
        best = known.join(goals, "request_id").where("px = gx and py = gy").select("request_id", F.col("cost").alias("_best"))
        ahead = better.join(goals, "request_id").join(best, "request_id", "left")
        hopeful = F.col("_best").isNull() | (F.col("cost") + octile_to_goal(F.col("px"), F.col("py")) <= F.col("_best") + EPS)
        front = ahead.where(hopeful).select(*columns)


def _trace_tiles(side: int, by: list[str], columns: list[str]):
    together = max(1, AT_ONCE // (side + 2) ** 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, rows, costs = [], batch.to_dict("records"), []
            for k, row in enumerate(rows):
                if k % together == 0:
                    costs = relax_together(*[[r[c] for r in rows[k : k + together]] for c in ("cells", "seeds")], side)
                tile, cost = TileCosts(row["cells"], side), costs[k % together]
                ox, oy = row["tx"] * side - 1, row["ty"] * side - 1
                cells, on = tile.trace(cost, int(row["px"] - ox), int(row["py"] - oy))
                to = (on[0] + ox, on[1] + oy) if on else (None, None)
                out.append([row[c] for c in ("request_id", *by)] + [row["part"], [x + ox for x, _ in cells], [y + oy for _, y in cells], *to])
            yield pd.DataFrame(out, columns=columns).astype({"px": "Int64", "py": "Int64"})

    return run


def tiled_paths(requests: DataFrame, tiles: DataFrame, by: list[str], side: int) -> DataFrame:
    """(request_id, by, at, px, py) of a shortest path, at 0 from the start on; requests without a way have no rows.

    Of several shortest ways it is the one that, from the goal back, takes the first step in
    order of dx, then dy. A round goes back through one tile of every request.
    """
    known = tiled_costs(requests, tiles, by, side)
    types = {c: known.schema[c].dataType.simpleString() for c in known.columns}
    schema = ", ".join(f"`{c}` {types[c]}" for c in ("request_id", *by)) + ", part int, xs array<long>, ys array<long>, px long, py long"
    columns = ["request_id", *by, "part", "xs", "ys", "px", "py"]
    at = known.join(requests.select("request_id", "gx", "gy"), "request_id").where("px = gx and py = gy").select("request_id", *by, "px", "py")
    parts, part = None, 0
    while True:
        asked = at.select("*", _tile(F.col("px"), side).alias("tx"), _tile(F.col("py"), side).alias("ty"), F.lit(part).alias("part"))
        step = cut(_work(asked, tiles, known, by, side).mapInPandas(_trace_tiles(side, by, columns), schema))
        parts, part = step if parts is None else parts.unionByName(step), part + 1
        at = step.where("px is not null").select("request_id", *by, "px", "py")
        if at.isEmpty():
            break
    cells = parts.select("request_id", *by, "part", F.posexplode(F.arrays_zip("xs", "ys")).alias("k", "c"))
    back = Window.partitionBy("request_id").orderBy(F.desc("part"), F.desc("k"))
    return cut(cells.select("request_id", *by, (F.row_number().over(back) - 1).alias("at"), F.col("c.xs").alias("px"), F.col("c.ys").alias("py")))


def sight_line(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The cells of a straight line as an array of structs px, py: one a step of the longer axis, halves away from the start."""
    dx, dy = bx - ax, by - ay
    n = F.greatest(F.abs(dx), F.abs(dy))

    def on(a: Column, d: Column):
        return lambda j: (a + F.signum(d).cast("long") * F.when(n == 0, 0).otherwise(F.floor((2 * j * F.abs(d) + n) / (2 * n)))).cast("long")

    return F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long")), lambda j: F.struct(on(ax, dx)(j).alias("px"), on(ay, dy)(j).alias("py")))


def turns(path: DataFrame, free: DataFrame, by: list[str], look: int = 128) -> DataFrame:
    """The rows of path(request_id, by, at, px, py) that stay when it is pulled straight.

    From a kept cell on, the path is followed while the cell and the one that is looked at see
    each other; before the first that is out of sight, a cell is kept. Sight lines are exploded
    to cells; those that are not among the traversable ones block them. A round looks at the
    next `look` cells of every request.
    """
    last = cut(path.groupBy("request_id", *by).agg(F.max("at").alias("last")))
    here = last.select("request_id", *by, F.lit(0).alias("anchor"), F.lit(2).alias("probe"), "last")
    kept = here.select("request_id", *by, F.lit(0).alias("at")).unionByName(last.select("request_id", *by, F.col("last").alias("at"))).distinct()
    spots = path.select("request_id", "at", F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"))
    here = cut(here.where("probe <= last"))
    while not here.isEmpty():
        ends = here.join(spots.select("request_id", F.col("at").alias("anchor"), F.col("px").alias("_ax"), F.col("py").alias("_ay")), ["request_id", "anchor"])
        ahead = F.sequence("probe", F.least(F.col("probe") + look - 1, F.col("last")))
        ends = ends.withColumn("at", F.explode(ahead)).join(spots.select("request_id", "at", F.col("px").alias("_bx"), F.col("py").alias("_by")), ["request_id", "at"])
        line = sight_line(*[F.col(c) for c in ("_ax", "_ay", "_bx", "_by")])
        cells = cut(ends.select("request_id", *by, "at", F.explode(line).alias("c")).select("request_id", *by, "at", "c.px", "c.py"))
        keys = [*by, "px", "py"]
        places = cells.select(*keys).distinct()
        seen = free.select(*by, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py")).join(F.broadcast(places) if cells.count() <= BROADCAST_ROWS else places, keys, "left_semi")
        hidden = cells.join(seen, keys, "left_anti").groupBy("request_id").agg(F.min("at").alias("hidden"))
        after = cut(here.join(hidden, "request_id", "left"))
        kept = cut(kept.unionByName(after.where("hidden is not null").select("request_id", *by, (F.col("hidden") - 1).alias("at"))))
        found = F.col("hidden").isNotNull()
        here = after.select(
            "request_id", *by, F.when(found, F.col("hidden") - 1).otherwise(F.col("anchor")).alias("anchor"), F.when(found, F.col("hidden") + 1).otherwise(F.col("probe") + look).alias("probe"), "last"
        ).where("probe <= last")
        here = cut(here)
    return kept.distinct().join(path, ["request_id", *by, "at"])


def plan_tiled_paths(requests: DataFrame, free: DataFrame, by: list[str], metres: float, side: int = 128) -> DataFrame:
    """(request_id, by, status, cost, path_length_m, n_cells, waypoints) of every request(request_id, by, sx, sy, gx, gy) on its map.

    Status is `blocked` where an end is not traversable, `no path` where no way leads to the
    goal. Waypoints are structs px, py.
    """
    cells = cut(free.select(*by, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py")).distinct())
    ends = requests
    for a, b in (("sx", "sy"), ("gx", "gy")):
        spot = cells.select(*by, F.col("px").alias(a), F.col("py").alias(b))
        ends = ends.join(spot, [*by, a, b], "left_semi")
    ends = cut(ends)
    tiles = cut(map_tiles(cells, by, side))
    path = tiled_paths(ends, tiles, by, side)
    order = Window.partitionBy("request_id").orderBy("at")
    step = F.hypot(F.col("px") - F.lag("px").over(order), F.col("py") - F.lag("py").over(order))
    sums = path.withColumn("_s", step).groupBy("request_id").agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("cost"), F.count(F.lit(1)).alias("n_cells"))
    kept = turns(path, cells, by).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("at", "px", "py"))).alias("w"))
    kept = kept.select("request_id", F.transform("w", lambda p: F.struct(p["px"].alias("px"), p["py"].alias("py"))).alias("waypoints"))
    out = requests.select("request_id", *by).join(ends.select("request_id", F.lit(True).alias("_open")), "request_id", "left").join(sums, "request_id", "left").join(kept, "request_id", "left")
    status = F.when(F.col("_open").isNull(), "blocked").when(F.col("n_cells").isNull(), "no path").otherwise("ok")
    return out.select("request_id", *by, status.alias("status"), "cost", F.round(F.col("cost") * metres, 4).alias("path_length_m"), "n_cells", "waypoints")
