"""Joins that plain equality does not give: as-of, pairs, nearest points, neighbourhoods."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.operators.lineage import cut


def frame_map(poses: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """Ground-truth rows renumbered by each artifact's frame_index_map; without a map the numbers stay."""
    mapped = artifacts.select(*keys, F.posexplode_outer("frame_index_map").alias("mapped_idx", "frame_idx"))
    with_map, without = mapped.where("frame_idx is not null"), mapped.where("frame_idx is null").select(*keys)
    a = poses.join(with_map, [*keys, "frame_idx"])
    b = poses.join(without, keys).withColumn("mapped_idx", F.col("frame_idx"))
    return a.unionByName(b)


#: tolerances that a stretch of time of an as-of join is long; right rows are repeated about 2 / STRETCH times
STRETCH = 64


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], time: str, right_id: str, tolerance: int, inner: bool = False) -> DataFrame:
    """J2 (left outer) and J3 (inner): the right row nearest in time within the tolerance, the earlier one on ties.

    One union of both sides, sorted once by key, stretch of time and time; two running windows
    carry the last right row before and the first after each left row. A stretch is many
    tolerances long, and right rows near its ends are also in the next one, so a key of very many
    rows is spread over its stretches, and nothing is carried between them. Right rows of one
    time count as the one of the smallest id. Times are integers; tolerance is inclusive. Right
    columns come with the prefix r_.
    """
    stretch = STRETCH * (tolerance + 1)
    at = lambda t: F.floor(t / stretch).cast("long")
    right_cols = [c for c in right.columns if c not in by]
    packed = right.groupBy(*by, time).agg(F.min_by(F.struct(*right_cols), right_id).alias("_r")).withColumn("_side", F.lit(0))
    packed = packed.withColumn("_at", F.explode(F.sequence(at(F.col(time) - tolerance), at(F.col(time) + tolerance))))
    kind = packed.schema["_r"].dataType
    queries = left.select(*by, time, F.lit(None).cast(kind).alias("_r"), F.lit(1).alias("_side"), at(F.col(time)).alias("_at"), F.struct(*left.columns).alias("_l"))
    both = queries.unionByName(packed.withColumn("_l", F.lit(None).cast(queries.schema["_l"].dataType)))
    back = Window.partitionBy(*by, "_at").orderBy(F.col(time), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by, "_at").orderBy(F.col(time), F.col("_side").desc()).rowsBetween(0, Window.unboundedFollowing)
    near = both.withColumn("_b", F.last("_r", True).over(back)).withColumn("_a", F.first("_r", True).over(ahead)).where("_side = 1")
    before, after = F.col(time) - F.col(f"_b.{time}"), F.col(f"_a.{time}") - F.col(time)
    pick = F.when(F.col("_a").isNull() | (before <= after), F.col("_b")).otherwise(F.col("_a"))
    near = near.withColumn("_p", pick)
    near = near.withColumn("_p", F.when(F.abs(F.col(f"_p.{time}") - F.col(time)) <= tolerance, F.col("_p")))
    if inner:
        near = near.where("_p is not null")
    return near.select("_l.*", *[F.col(f"_p.{c}").alias(f"r_{c}") for c in right_cols])


def ordered_pairs(rows: DataFrame, by: list[str], index: str, columns: list[str], loops: bool = False, block: int = 256) -> DataFrame:
    """J4 (i < j) and J5 (all i, j): pairs inside a group; columns come as a_ and b_.

    Frames go by blocks of `block` numbers. A row is sent once for each block that it meets, and
    pairs come from an equality join on (group, block), so a group of n frames is spread over
    n / block keys and no key holds more than block * n pairs.
    """
    blocked = rows.select(*by, F.floor(F.col(index) / block).cast("int").alias("_block"), index, *columns)
    blocks = blocked.select(*by, "_block").distinct()
    meets = blocks.join(blocks.select(*by, F.col("_block").alias("_to")), by)
    if not loops:
        meets = meets.where("_block <= _to")
    a = blocked.join(meets, [*by, "_block"]).select(*by, "_to", *[F.col(c).alias(f"a_{c}") for c in [index, *columns]])
    b = blocked.select(*by, F.col("_block").alias("_to"), *[F.col(c).alias(f"b_{c}") for c in [index, *columns]])
    met = a.join(b, [*by, "_to"]).drop("_to")
    return met if loops else met.where(F.col(f"a_{index}") < F.col(f"b_{index}"))


def consecutive(rows: DataFrame, by: list[str], index: str, columns: list[str]) -> DataFrame:
    """Each row with the one before it, as p_ columns; no join."""
    w = Window.partitionBy(*by).orderBy(index)
    out = rows
    for c in [index, *columns]:
        out = out.withColumn(f"p_{c}", F.lag(c).over(w))
    return out.where(F.col(f"p_{index}").isNotNull())


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def _brute_block(source: DataFrame, target: DataFrame, by: list[str], sid: str, tid: str, part: int) -> DataFrame:
    """Nearest of each source row over all target rows of its group, both dealt to parts of about `part` rows, part by part in numpy."""
    n_parts = lambda df, name: df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias(name))
    # new names for the columns, as both sides may stem from one table
    spots = target.select(*[F.col(c).alias(c) for c in target.columns]).join(n_parts(source, "_ways"), by)
    spots = spots.join(n_parts(target, "_parts"), by).withColumn("_part", F.pmod(F.xxhash64(tid), F.col("_parts")).cast("int"))
    spots = spots.withColumn("_way", F.explode(F.sequence(F.lit(0), F.col("_ways") - 1))).drop("_ways", "_parts")
    asked = source.join(n_parts(source, "_ways"), by).withColumn("_way", F.pmod(F.xxhash64(sid), F.col("_ways")).cast("int")).drop("_ways")
    asked = asked.join(n_parts(target, "_parts"), by).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = a[[*by, sid]].copy()
        if not len(b):
            out[tid], out["distance"] = pd.array([None] * len(a), dtype="Int64"), np.nan
            return out
        b = b.sort_values(tid)
        x, y = a[["x", "y", "z"]].to_numpy(), b[["x", "y", "z"]].to_numpy()
        best, near = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
        for at in range(0, len(y), 4096):
            for s in range(0, len(x), 1024):
                d = ((x[s : s + 1024, None, :] - y[None, at : at + 4096, :]) ** 2).sum(axis=2)
                j = d.argmin(axis=1)
                m = d[np.arange(len(j)), j]
                won = m < best[s : s + 1024]
                near[s : s + 1024][won], best[s : s + 1024][won] = j[won] + at, m[won]
        out[tid], out["distance"] = pd.array(b[tid].to_numpy()[near], dtype="Int64"), np.sqrt(best)
        return out

    schema = ", ".join([*[f"`{c}` {source.schema[c].dataType.simpleString()}" for c in by], f"`{sid}` long, `{tid}` long, distance double"])
    found = asked.groupBy(*by, "_way", "_part").cogroup(spots.groupBy(*by, "_way", "_part")).applyInPandas(nearest, schema)
    return found.where("distance is not null and not isnan(distance)").groupBy(*by, sid).agg(F.min(F.struct("distance", tid)).alias("m")).select(*by, sid, f"m.{tid}", "m.distance")


#: distinct target points of a cube up to which they are compared one by one; denser cubes are halved
DENSE = 256
#: cubes are made smaller until half of the targets sit in cubes of so many different ones at most
CROWD = 4


def _offsets(*steps: int) -> Column:
    return F.array(*[F.array(*map(F.lit, (i, j, k))) for i in steps for j in steps for k in steps])


def _gap(side: float) -> Column:
    """Distance of the source point _x, _y, _z from the cube _cx, _cy, _cz, a little under it."""
    out = F.lit(0.0)
    for c in "xyz":
        low = F.col(f"_c{c}") * side
        out = out + F.greatest(low - F.col(f"_{c}"), F.col(f"_{c}") - low - side, F.lit(0.0)) ** 2
    return F.sqrt(out) * (1 - 1e-9)


def _best(met: DataFrame, keys: list[str], tid: str) -> DataFrame:
    d = F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2 + (F.col("z") - F.col("_z")) ** 2)
    return met.groupBy(*keys).agg(F.min(F.struct(d.alias("distance"), F.col(tid), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))).alias("m"))


def _nearest_by_cubes(source: DataFrame, target: DataFrame, by: list[str], side: float, sid: str, tid: str) -> DataFrame:
    """(by, sid, m) with m the distance, id and place of a target: the nearest one wherever it is within `side`.

    Targets meet the sources around by cubes of this side. Where cubes hold over DENSE different
    targets, a source goes down only into those halves of them that may hold a nearer target
    than one that it has met (each cube tells one of its points), until cubes are small; so no
    source meets all of a dense cube.
    """
    keys, cube = [*by, sid], [*by, "_cx", "_cy", "_cz"]
    spots = target.groupBy(*by, "x", "y", "z").agg(F.min(tid).alias(tid))
    near = source.withColumn("_o", F.explode(_offsets(-1, 0, 1)))
    near = near.select(*keys, *[F.col(c).alias(f"_{c}") for c in "xyz"], *[(_cell(c, side) + F.col("_o")[n]).alias(f"_c{c}") for n, c in enumerate("xyz")])
    placed = lambda rows, s: rows.select("*", *[_cell(c, s).alias(f"_c{c}") for c in "xyz"])
    told = lambda rows, s: placed(rows, s).groupBy(*cube).agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("x", "y", "z"), tid).alias("_one"))
    if near.join(told(spots, side).where(F.col("_n") > DENSE).select(*cube), cube, "left_semi").isEmpty():
        return _best(near.join(placed(spots, side), cube), keys, tid)
    spots, near, found = cut(spots), near.withColumn("_most", F.lit(side)), None
    while True:
        cubes = cut(told(spots, side))
        one = F.sqrt(sum(((F.col(f"_one.{c}") - F.col(f"_{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
        met = near.join(cubes, cube).withColumn("_most", F.least("_most", F.min(one).over(Window.partitionBy(*keys))))
        met = cut(met.where(_gap(side) <= F.col("_most")).drop("_one"))
        small = _best(met.where(F.col("_n") <= DENSE).join(placed(spots, side), cube), keys, tid)
        found = small if found is None else found.unionByName(small)
        deep = met.where(F.col("_n") > DENSE)
        if deep.isEmpty():
            return found.groupBy(*keys).agg(F.min("m").alias("m"))
        spots = cut(placed(spots, side).join(cubes.where(F.col("_n") > DENSE), cube, "left_semi").select(*by, "x", "y", "z", tid))
        near = deep.withColumn("_o", F.explode(_offsets(0, 1))).select(*keys, "_x", "_y", "_z", "_most", *[(F.col(f"_c{c}") * 2 + F.col("_o")[n]).alias(f"_c{c}") for n, c in enumerate("xyz")])
        side /= 2


def _halvings(spots: DataFrame, by: list[str], side: float, most: int = 20) -> int:
    """How often cubes of this side are to be halved until half of the targets have at most CROWD different ones in their cube."""
    places, k = spots.select(*by, "x", "y", "z").distinct(), 0
    while k < most:
        n = places.groupBy(*by, *[_cell(c, side / 2**k) for c in "xyz"]).agg(F.count(F.lit(1)).alias("n"))
        full = F.when(F.col("n") > CROWD, F.col("n"))
        row = n.agg((F.sum(full) / F.sum("n")).alias("share"), (F.sum(full * F.log2(full)) / F.sum(full)).alias("size")).first()
        if (row["share"] or 0.0) <= 0.5:
            break
        k += max(1, int((row["size"] - math.log2(CROWD)) / 3))
    return min(k, most)


def _nearest_by_rounds(source: DataFrame, spots: DataFrame, by: list[str], sides: list[float], sid: str, tid: str) -> tuple[DataFrame, DataFrame | None]:
    """(by, sid, m) of the sources with a target within the last side, as _nearest_by_cubes, and the sources that have none; each side is tried by those that found nothing within the one before."""
    left, done = source.select(*by, sid, "x", "y", "z"), None
    for side in sides:
        tried = cut(left.join(_nearest_by_cubes(left, spots, by, side, sid, tid), [*by, sid], "left"))
        found = tried.where(F.col("m.distance") <= side).select(*by, sid, "m")
        done = found if done is None else done.unionByName(found)
        left = tried.where(F.col("m").isNull() | (F.col("m.distance") > side)).select(*by, sid, "x", "y", "z")
        if left.isEmpty():
            return done, None
    return done, left


def nearest_point(
    source: DataFrame, target: DataFrame, by: list[str], cell: float, rounds: int = 4, sid: str = "point_id", tid: str = "near_id", part: int = 20_000
) -> DataFrame:
    """Exact nearest target point (smallest id on ties) of every source point x, y, z of its group.

    Targets sit in cubes of side `cell`, halved until most of them have few others in their
    cube, so that a source meets about as many targets in a large cloud as in a small one. A
    source point probes the 27 cubes around it by an equality join, and a neighbour within one
    side is final, for no closer point lies outside. The others try again with sides doubled, up
    to cell doubled `rounds` - 1 times; the table of what is left is cut from its plan in every
    round. What is left then is compared with all targets of its group, both dealt to parts of
    about `part` rows. Source points of a group without targets are not in the result.
    """
    spots = target.select(*by, F.col(sid).alias(tid), "x", "y", "z")
    done, left = _nearest_by_rounds(source, spots, by, [cell * 2.0**k for k in range(-_halvings(spots, by, cell), rounds)], sid, tid)
    done = done.select(*by, sid, f"m.{tid}", "m.distance")
    return done if left is None else done.unionByName(_brute_block(left, spots, by, sid, tid, part))


def within_radius(source: DataFrame, target: DataFrame, by: list[str], radius: float, sid: str = "point_id", tid: str = "near_id") -> DataFrame:
    """Nearest target within a radius, by cubes of the radius' side or, in crowded clouds, by smaller ones first; unmatched source points are left out."""
    spots = target.select(*by, F.col(sid).alias(tid), "x", "y", "z")
    own = source.select(*by, sid, "x", "y", "z")
    halvings = _halvings(spots, by, radius)
    if halvings:
        near, _ = _nearest_by_rounds(own, spots, by, [radius * 2.0**k for k in range(-halvings, 1)], sid, tid)
    else:
        near = _nearest_by_cubes(own, spots, by, radius, sid, tid).where(F.col("m.distance") <= radius)
    return near.join(own, [*by, sid]).select(*by, sid, "m.distance", f"m.{tid}", "x", "y", "z", "m.tx", "m.ty", "m.tz")


def stencil(cells: DataFrame, radius: int, disk: bool = True, px: str = "px", py: str = "py") -> DataFrame:
    """Every cell with the cells around it, as nx, ny; a disk or a square of offsets."""
    near = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if not disk or i * i + j * j <= radius * radius]
    offsets = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in near])
    out = cells.withColumn("_o", F.explode(offsets))
    return out.withColumn("nx", F.col(px) + F.col("_o.dx")).withColumn("ny", F.col(py) + F.col("_o.dy")).drop("_o")


def first_known(base: DataFrame, others: list[DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """Columns from the first of several tables that has the key."""
    out = base
    for n, other in enumerate(others):
        out = out.join(other.select(*keys, *[F.col(c).alias(f"_{n}_{c}") for c in columns]), keys, "left")
    picked = [F.coalesce(*[F.col(f"_{n}_{c}") for n in range(len(others))]).alias(c) for c in columns]
    return out.select(*base.columns, *picked)


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """A table function over Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)
