"""Points from pixels, z-buffers, visibility, voxels and cloud filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.geometry import is_finite, project, transform_point, unproject
from trajecta.operators.quantiles import Quantile, quantiles


def valid_grid_points(df: DataFrame) -> DataFrame:
    """Points that are not the origin, of frames with pose and intrinsics."""
    return df.where(((F.col("x") != 0) | (F.col("y") != 0) | (F.col("z") != 0)) & F.col("has_camera"))


def valid_grid_depths(df: DataFrame) -> DataFrame:
    """Finite depths over 1e-4, of frames with pose and intrinsics."""
    return df.where(is_finite(F.col("depth")) & (F.col("depth") > 1e-4) & F.col("has_camera"))


def confident(df: DataFrame, by: list[str], percent: float, value: str = "confidence") -> DataFrame:
    """P4 (by = []) and P5 (by frame): rows at or over the percentile of their group."""
    cut = quantiles(df, by, {"_cut": Quantile(value, percent / 100)})
    joined = df.join(F.broadcast(cut) if not by else cut, by) if by else df.crossJoin(F.broadcast(cut))  # one row
    return joined.where(F.col(value) >= F.col("_cut")).drop("_cut")


def masked(df: DataFrame, masks: DataFrame, keys: list[str], missing: bool) -> DataFrame:
    """P6 (missing masks keep) and P9 (missing masks drop)."""
    return df.join(masks.select(*keys, F.col("mask").alias("_mask")), keys, "left").where(F.coalesce("_mask", F.lit(missing))).drop("_mask")


def every_kth(df: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """Every k-th of the surviving rows, from the first on."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") % k == 0).drop("_n")


def export_filter(df: DataFrame, by: list[str], percent: float, black: bool = True, white: bool = True) -> DataFrame:
    """Confident points that are neither near black nor near white; r, g, b are 0..255."""
    out = confident(df, by, percent).where(F.col("confidence") > 1e-5)
    if black:
        out = out.where(F.col("r") + F.col("g") + F.col("b") >= 16)
    return out.where(~((F.col("r") > 240) & (F.col("g") > 240) & (F.col("b") > 240))) if white else out


def clean_depth(depth: Column, low: float, high: float) -> Column:
    """0 where the depth is missing, too near or too far."""
    return F.when(is_finite(depth) & depth.between(low, high), depth).otherwise(0.0)


def blank_border(depth: Column, u: Column, v: Column, width: Column, height: Column, radius: int) -> Column:
    """P24."""
    edge = (u < radius) | (v < radius) | (u >= width - radius) | (v >= height - radius)
    return F.when(edge, 0.0).otherwise(depth)


def voxel_mean(points: DataFrame, by: list[str], side: float, columns: list[str]) -> DataFrame:
    """Mean of the columns in each cube of a side; the grid starts half a side before the least coordinates of the group."""
    low = points.groupBy(*by).agg(*[(F.min(c) - side / 2).alias(f"_low_{c}") for c in "xyz"])
    placed = points.join(low, by) if by else points.crossJoin(low)  # one row
    cells = [F.floor((F.col(c) - F.col(f"_low_{c}")) / side).cast("long").alias(f"c{c}") for c in "xyz"]
    return placed.groupBy(*by, *cells).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def bounds_and_scale(points: DataFrame, by: list[str]) -> DataFrame:
    """5th and 95th percentile of each axis and the length of their difference, 0.1 at least."""
    p = quantiles(points, by, {f"{n}_{c}": Quantile(c, share) for c in "xyz" for share, n in ((0.05, "low"), (0.95, "high"))})
    span = F.sqrt(reduce(lambda a, b: a + b, [(F.col(f"high_{c}") - F.col(f"low_{c}")) ** 2 for c in "xyz"]))
    return p.withColumn("scale", F.greatest(span, F.lit(0.1)))


def depth_range(df: DataFrame, by: list[str]) -> DataFrame:
    """1st and 99th percentile of the positive finite depths."""
    fine = df.where(is_finite(F.col("depth")) & (F.col("depth") > 0))
    return quantiles(fine, by, {"low": Quantile("depth", 0.01), "high": Quantile("depth", 0.99)})


def to_points(pixels: DataFrame) -> DataFrame:
    """F8 over rows with u, v, depth, fx, fy, cx, cy and pose m: world x, y, z."""
    c = F.col
    camera = unproject(c("u"), c("v"), c("depth"), c("fx"), c("fy"), c("cx"), c("cy"))
    return pixels.withColumns(dict(zip("xyz", transform_point(c("m"), *camera), strict=True)))


def to_pixels(points: DataFrame, near: float, far: float) -> DataFrame:
    """Integer pixels of camera points x, y, z inside the frustum (columns fx, fy, cx, cy, width, height)."""
    c = F.col
    u, v = project(c("x"), c("y"), c("z"), c("fx"), c("fy"), c("cx"), c("cy"))
    out = points.withColumn("u", F.floor(u).cast("int")).withColumn("v", F.floor(v).cast("int"))
    return out.where((c("z") > near) & (c("z") < far) & (c("u") >= 0) & (c("u") < c("width")) & (c("v") >= 0) & (c("v") < c("height")))


def z_buffer(pixels: DataFrame, by: list[str], ident: str = "point_id", z: str = "z") -> DataFrame:
    """The nearest point of each pixel, the smallest id on ties; partial minima go first."""
    return pixels.groupBy(*by, "u", "v").agg(F.min(F.struct(F.col(z).alias("depth"), F.col(ident).alias(ident))).alias("m")).select(*by, "u", "v", "m.*")


def _neighbours(depths: DataFrame, by: list[str], radius: int) -> DataFrame:
    span = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if (i, j) != (0, 0)]
    offsets = F.array(*[F.struct(F.lit(i).alias("du"), F.lit(j).alias("dv")) for i, j in span])
    # the neighbours come to the pixel: each row is sent to the pixels around it
    sent = depths.select(*by, "u", "v", F.col("depth").alias("nd"), F.explode(offsets).alias("o"))
    sent = sent.select(*by, (F.col("u") - F.col("o.du")).alias("u"), (F.col("v") - F.col("o.dv")).alias("v"), "nd", F.col("o.du").alias("du"), F.col("o.dv").alias("dv"))
    return depths.join(sent, [*by, "u", "v"], "left")


def visible_by_count(depths: DataFrame, by: list[str], radius: int = 3, closer: float = 3.0, threshold: int = 4) -> DataFrame:
    """A pixel is hidden if at least `threshold` neighbours lie `closer` metres or more in front of it."""
    near = _neighbours(depths, by, radius)
    n = F.count_if(F.col("nd") <= F.col("depth") - closer)
    return near.groupBy(*by, "u", "v", "depth").agg(n.alias("n_closer")).withColumn("visible", F.col("n_closer") < threshold)


def visible_by_cone(depths: DataFrame, by: list[str], fx: float, fy: float, cx: float, cy: float, radius: int = 3, threshold: float = 3.0) -> DataFrame:
    """Per quadrant, the largest cosine between the ray back to the camera and the way to a neighbour of positive depth, -1 where there is none; hidden if the four sum to the threshold.

    An offset on an axis belongs to both quadrants beside it.
    """
    c = F.col
    near = _neighbours(depths, by, radius)
    p = unproject(c("u"), c("v"), c("depth"), *map(F.lit, (fx, fy, cx, cy)))
    q = unproject(c("u") + c("du"), c("v") + c("dv"), c("nd"), *map(F.lit, (fx, fy, cx, cy)))
    way = [b - a for a, b in zip(p, q, strict=True)]
    norm = lambda v: F.sqrt(v[0] ** 2 + v[1] ** 2 + v[2] ** 2)
    cos = -(way[0] * p[0] + way[1] * p[1] + way[2] * p[2]) / F.nullif(norm(way) * norm(p), F.lit(0.0))
    cos = F.when((c("nd") > 0) & (c("depth") > 0), cos)
    quadrants = [(c("du") >= 0) & (c("dv") >= 0), (c("du") >= 0) & (c("dv") <= 0), (c("du") <= 0) & (c("dv") >= 0), (c("du") <= 0) & (c("dv") <= 0)]
    best = [F.greatest(F.coalesce(F.max(F.when(w, cos)), F.lit(-1.0)), F.lit(-1.0)) for w in quadrants]
    out = near.groupBy(*by, "u", "v", "depth").agg(reduce(lambda a, b: a + b, best).alias("cover"))
    return out.withColumn("visible", ~((c("depth") > 0) & (c("cover") >= threshold)))


def camera_bounds(cameras: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the camera positions x, y, z, and the length of their extent: 1 for one camera, 0.1 at least."""
    span = F.sqrt(reduce(lambda a, b: a + b, [(F.max(c) - F.min(c)) ** 2 for c in "xyz"]))
    scale = F.when(F.count(F.lit(1)) > 1, F.greatest(span, F.lit(0.1))).otherwise(1.0)
    return cameras.groupBy(*by).agg(*[F.avg(c).alias(f"centre_{c}") for c in "xyz"], scale.alias("scale"))


def viewer_pixels(pixels: DataFrame, stride: int, sky: str = "sky") -> DataFrame:
    """P10: every stride-th row and column, without sky; a missing mask is no sky."""
    return pixels.where((F.col("u") % stride == 0) & (F.col("v") % stride == 0) & ~F.coalesce(sky, F.lit(False)))


def base_point_size(pixels: DataFrame, cameras: DataFrame, by: list[str], default: float = 0.001) -> DataFrame:
    """A tenth of mean depth over mean focal length, of each group's first frame with a positive finite depth and a camera(by, frame, fx, fy)."""
    fine = pixels.where(is_finite(F.col("depth")) & (F.col("depth") > 0)).groupBy(*by, "frame").agg(F.avg("depth").alias("_depth")).join(cameras, [*by, "frame"])
    first = fine.groupBy(*by).agg(F.min(F.struct("frame", (F.col("_depth") / ((F.col("fx") + F.col("fy")) / 2) * 0.1).alias("size"))).alias("m"))
    out = pixels.select(*by).distinct().join(first, by, "left")
    return out.select(*by, "m.frame", F.coalesce("m.size", F.lit(default)).alias("size"))


def shrink(df: DataFrame, by: list[str], factor: int, value: str) -> DataFrame:
    """Triangular-weighted mean of the non-zero values of each block, and whether any is set."""
    centre = (factor - 1) / 2
    weight = lambda c: 1 - F.abs(F.col(c) % factor - centre) / factor
    w = F.when(F.col(value) != 0, weight("u") * weight("v"))
    return df.groupBy(*by, F.floor(F.col("u") / factor).cast("int").alias("u"), F.floor(F.col("v") / factor).cast("int").alias("v")).agg(
        (F.sum(w * F.col(value)) / F.nullif(F.sum(w), F.lit(0.0))).alias(value), F.bool_or(F.col(value) != 0).alias("any")
    )


def merge_clouds(clouds: list[DataFrame]) -> DataFrame:
    """Rows of all clouds with the columns that all have."""
    common = [c for c in clouds[0].columns if all(c in x.columns for x in clouds)]
    return reduce(lambda a, b: a.unionByName(b), [x.select(*common) for x in clouds])


def random_cap(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """N rows without replacement, the same for one seed: those whose keys, joined by colons after it, have the least md5. A task keeps n rows at most."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys).limit(n)
