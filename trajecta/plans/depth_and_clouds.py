"""Queries over depth pixels and point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.functions.geometry import area_budget_size, confidence_of, cover_crop, fov_of, inverse_log, min_max, resize_intrinsics, square_pad, unproject, width_fit_height
from trajecta.operators import clouds as cl
from trajecta.operators.joins import first_known, nearest_point, within_radius
from trajecta.operators.metrics import align_depth, cloud_metrics, depth_metrics, depth_ratio_scale, pr_curve, valid_depth
from trajecta.plans.bindings import PIXELS, POINTS, pixels, points, rounded, table
from trajecta.plans.registry import register

LOW, HIGH = 0.0, 20000.0


def valid(spark: SparkSession, d: str) -> DataFrame:
    return valid_depth(pixels(spark, d), LOW, HIGH)


_VALID = f"{PIXELS}, ok AS (SELECT * FROM pix WHERE gt > {LOW} AND gt < {HIGH} AND pred > 0)"
_FIT = f"""WITH {_VALID}, ft AS (SELECT frame, count(*) AS n, quantile_cont(gt, 0.5) / nullif(quantile_cont(pred, 0.5), 0) AS ratio, regr_slope(gt, pred) AS slope, regr_intercept(gt, pred) AS shift
  FROM ok GROUP BY frame HAVING count(*) >= 100)"""
_ERR = """round(avg(abs(p - gt) / gt), 6) AS abs_rel, round(avg((p - gt) ** 2 / gt), 4) AS sq_rel, round(sqrt(avg((p - gt) ** 2)), 4) AS rmse,
  round(sqrt(avg((ln(greatest(p, 1e-5)) - ln(gt)) ** 2)), 6) AS log_rmse, count(*) AS n_pixels,
  round(100.0 * avg(CASE WHEN greatest(gt / nullif(p, 0), p / gt) < 1.25 THEN 1.0 ELSE 0.0 END), 6) AS delta_1,
  round(100.0 * avg(CASE WHEN greatest(gt / nullif(p, 0), p / gt) < 1.5625 THEN 1.0 ELSE 0.0 END), 6) AS delta_2,
  round(100.0 * avg(CASE WHEN greatest(gt / nullif(p, 0), p / gt) < 1.953125 THEN 1.0 ELSE 0.0 END), 6) AS delta_3"""


def _depth(mode):
    def query(spark, d):
        out = depth_metrics(align_depth(valid(spark, d), ["frame"], mode), [])
        return out.select(*[F.round(c, 4 if c in ("sq_rel", "rmse") else 6).alias(c) if c != "n_pixels" else F.col(c) for c in out.columns])

    return query


register("a15_p2_depth_metrics_unaligned", _depth("none"), f"{_FIT}, x AS (SELECT ok.*, pred AS p FROM ok JOIN ft USING (frame)) SELECT {_ERR} FROM x")
register("a15_a16_j10_depth_metrics_scaled", _depth("scale_only"), f"{_FIT}, x AS (SELECT ok.*, pred * ratio AS p FROM ok JOIN ft USING (frame)) SELECT {_ERR} FROM x")
register("a15_a17_depth_metrics_least_squares", _depth("lstsq"), f"{_FIT}, x AS (SELECT ok.*, pred * coalesce(slope, ratio) + CASE WHEN slope IS NOT NULL THEN shift ELSE 0 END AS p FROM ok JOIN ft USING (frame)) SELECT {_ERR} FROM x")


def ranges(spark, d):
    p = pixels(spark, d).withColumn("depth", F.col("gt"))
    return rounded(cl.depth_range(p, ["frame"]), 4)


register("a19_depth_range", ranges, f"WITH {PIXELS} SELECT frame, round(quantile_cont(gt, 0.01), 4) AS low, round(quantile_cont(gt, 0.99), 4) AS high FROM pix WHERE gt > 0 GROUP BY frame")


def clipped(spark, d):
    """The fit sees predictions between bounds, and the aligned ones are held between others."""
    out = depth_metrics(align_depth(valid(spark, d), ["frame"], "lstsq", pre_clip=(3000.0, 15000.0), post_clip=(1000.0, 18000.0)), [])
    return out.select(*[F.round(c, 4 if c in ("sq_rel", "rmse") else 6).alias(c) if c != "n_pixels" else F.col(c) for c in out.columns])


register(
    "a17_depth_metrics_clipped", clipped,
    f"WITH {_VALID}, cl AS (SELECT *, least(greatest(pred, 3000), 15000) AS seen FROM ok), ft AS (SELECT frame, regr_slope(gt, seen) AS slope, regr_intercept(gt, seen) AS shift FROM cl GROUP BY frame HAVING count(*) >= 100), "
    f"x AS (SELECT ok.*, least(greatest(pred * slope + shift, 1000), 18000) AS p FROM ok JOIN ft USING (frame)) SELECT {_ERR} FROM x",
)


def window_scales(spark, d):
    """The lower median of the ratios, some of which have no target, held between bounds."""
    p = pixels(spark, d).select("frame", F.col("gt").alias("anchor"), F.when(F.col("part") % 7 == 0, 0.0).when(F.col("part") % 11 == 0, float("inf")).otherwise(F.col("pred") * F.when(F.col("frame") % 9 == 0, 1e-6).otherwise(1.0)).alias("target"))
    return rounded(depth_ratio_scale(p, ["frame"]))


register(
    "a23_window_scale", window_scales,
    f"WITH {PIXELS}, r AS (SELECT frame, CASE WHEN part % 7 <> 0 AND part % 11 <> 0 THEN gt / (pred * CASE WHEN frame % 9 = 0 THEN 1e-6 ELSE 1 END) END AS ratio FROM pix) "
    "SELECT frame, round(least(greatest(coalesce(quantile_disc(ratio, 0.5), 1), 1e-3), 1e3), 6) AS scale, count(ratio) AS n FROM r GROUP BY frame",
)


def confident(spark, d):
    a = cl.confident(pixels(spark, d), ["frame"], 75.0).groupBy("frame").agg(F.count(F.lit(1)).alias("n_frame"))
    b = cl.confident(pixels(spark, d), [], 75.0).groupBy("frame").agg(F.count(F.lit(1)).alias("n_global"))
    return a.join(b, "frame", "left")


register(
    "p4_p5_confidence_percentile", confident,
    f"WITH {PIXELS}, c AS (SELECT frame, quantile_cont(confidence, 0.75) AS cut FROM pix GROUP BY frame), g AS (SELECT quantile_cont(confidence, 0.75) AS gcut FROM pix) "
    "SELECT frame, count(*) FILTER (confidence >= cut) AS n_frame, count(*) FILTER (confidence >= gcut) AS n_global FROM pix JOIN c USING (frame), g GROUP BY frame",
)


def cleaned(spark, d):
    p = pixels(spark, d).withColumn("depth", cl.clean_depth(F.col("gt"), 2000.0, 50000.0))
    p = p.withColumn("depth", cl.blank_border(F.col("depth"), F.col("l_linenumber"), F.col("part") % 50, F.lit(8), F.lit(50), 2))
    return rounded(p.groupBy("frame").agg(F.count_if(F.col("depth") > 0).alias("n"), F.sum("depth").alias("total")), 2)


register(
    "p13_p24_clean_depth", cleaned,
    f"WITH {PIXELS}, c AS (SELECT frame, CASE WHEN l_linenumber < 2 OR part % 50 < 2 OR l_linenumber >= 6 OR part % 50 >= 48 THEN 0.0 WHEN gt BETWEEN 2000 AND 50000 THEN gt ELSE 0.0 END AS depth FROM pix) "
    "SELECT frame, count(*) FILTER (depth > 0) AS n, round(sum(depth), 2) AS total FROM c GROUP BY frame",
)


def masks(spark, d):
    p = pixels(spark, d)
    m = table(spark, d, "part").select(F.col("p_partkey").alias("part"), (F.col("p_size") > 25).alias("mask")).where("part % 3 <> 0")
    keep, lose = cl.masked(p, m, ["part"], True), cl.masked(p, m, ["part"], False)
    return keep.groupBy("frame").agg(F.count(F.lit(1)).alias("n_keep")).join(lose.groupBy("frame").agg(F.count(F.lit(1)).alias("n_drop")), "frame", "left")


register(
    "p6_p9_masks", masks,
    f"WITH {PIXELS}, m AS (SELECT p_partkey AS part, p_size > 25 AS mask FROM part WHERE p_partkey % 3 <> 0) SELECT frame, count(*) FILTER (coalesce(mask, true)) AS n_keep, "
    "nullif(count(*) FILTER (coalesce(mask, false)), 0) AS n_drop FROM pix LEFT JOIN m USING (part) GROUP BY frame HAVING count(*) FILTER (coalesce(mask, true)) > 0",
)


def zbuffer(spark, d):
    p = pixels(spark, d).select("frame", (F.col("part") % 16).alias("u"), F.col("l_linenumber").alias("v"), F.col("gt").alias("z"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"))
    return rounded(cl.z_buffer(p, ["frame"]), 4)


_Z = f"{PIXELS}, zb AS (SELECT frame, part % 16 AS u, l_linenumber AS v, min(gt) AS depth FROM pix GROUP BY 1, 2, 3)"
register(
    "a28_a29_o4_z_buffer", zbuffer,
    f"WITH {PIXELS}, k AS (SELECT frame, part % 16 AS u, l_linenumber AS v, gt AS depth, l_orderkey * 8 + l_linenumber AS point_id, row_number() OVER (PARTITION BY frame, part % 16, l_linenumber ORDER BY gt, l_orderkey * 8 + l_linenumber) AS k FROM pix) "
    "SELECT frame, u, v, round(depth, 4) AS depth, point_id FROM k WHERE k = 1",
)


def visibility(spark, d):
    z = zbuffer(spark, d).select("frame", "u", "v", "depth")
    return cl.visible_by_count(z, ["frame"], 2, 3000.0, 4).groupBy("frame").agg(F.sum("n_closer").alias("n_closer"), F.count_if("visible").alias("n_visible"))


register(
    "a30_j18_visibility", visibility,
    f"WITH {_Z}, z AS (SELECT frame, u, v, round(depth, 4) AS depth FROM zb), n AS (SELECT a.frame, a.u, a.v, count(b.u) AS c FROM z a LEFT JOIN z b ON a.frame = b.frame AND abs(a.u - b.u) <= 2 AND abs(a.v - b.v) <= 2 "
    "AND (a.u <> b.u OR a.v <> b.v) AND b.depth <= a.depth - 3000 GROUP BY 1, 2, 3) SELECT frame, CAST(sum(c) AS BIGINT) AS n_closer, count(*) FILTER (c < 4) AS n_visible FROM n GROUP BY frame",
)


def cones(spark, d):
    """A31."""
    z = zbuffer(spark, d).select("frame", "u", "v", (F.col("depth") / 1000).alias("depth"))
    seen = cl.visible_by_cone(z, ["frame"], 10.0, 10.0, 8.0, 4.0, 1, 0.5)
    return rounded(seen.groupBy("frame").agg(F.count_if("visible").alias("n_visible"), F.count_if(F.col("cover") < -1).alias("n_open"), F.avg("cover").alias("cover")), 5)


register(
    "a31_visibility_by_cone", cones,
    f"WITH {_Z}, z AS (SELECT frame, u, v, round(depth, 4) / 1000 AS depth, (u - 8) * (round(depth, 4) / 1000) / 10 AS x, (v - 4) * (round(depth, 4) / 1000) / 10 AS y FROM zb), "
    "n AS (SELECT a.frame, a.u, a.v, b.u - a.u AS du, b.v - a.v AS dv, -((b.x - a.x) * a.x + (b.y - a.y) * a.y + (b.depth - a.depth) * a.depth) / (sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.depth - a.depth) ** 2) * sqrt(a.x ** 2 + a.y ** 2 + a.depth ** 2)) AS c "
    "FROM z a LEFT JOIN z b ON a.frame = b.frame AND abs(a.u - b.u) <= 1 AND abs(a.v - b.v) <= 1 AND (a.u <> b.u OR a.v <> b.v)), "
    "q AS (SELECT frame, u, v, " + " + ".join(f"greatest(coalesce(max(c) FILTER (du {x} 0 AND dv {y} 0), -1), -1)" for x in ("<=", ">=") for y in ("<=", ">=")) + " AS cover FROM n GROUP BY 1, 2, 3) "
    "SELECT frame, count(*) FILTER (cover < 0.5) AS n_visible, count(*) FILTER (cover < -1) AS n_open, round(avg(cover), 5) + 0.0 AS cover FROM q GROUP BY frame",
)


def shrunk(spark, d):
    z = zbuffer(spark, d).select("frame", "u", "v", "depth")
    return rounded(cl.shrink(z, ["frame"], 4, "depth"), 2)


register(
    "a32_downsample", shrunk,
    f"WITH {_Z}, w AS (SELECT frame, CAST(u // 4 AS INTEGER) AS u, CAST(v // 4 AS INTEGER) AS v, round(depth, 4) AS depth, (1 - abs(u % 4 - 1.5) / 4) * (1 - abs(v % 4 - 1.5) / 4) AS w FROM zb) "
    "SELECT frame, u, v, round(sum(w * depth) FILTER (depth <> 0) / sum(w) FILTER (depth <> 0), 2) AS depth, bool_or(depth <> 0) AS \"any\" FROM w GROUP BY 1, 2, 3",
)


def union_visible(spark, d):
    """Points that win a pixel of any frame, counted by part."""
    seen = zbuffer(spark, d).select("point_id").distinct()
    rows = pixels(spark, d).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"), "part")
    return rows.join(seen, "point_id", "left_semi").groupBy("part").agg(F.count(F.lit(1)).alias("n_points"))


register(
    "a33_u6_j17_visible_union", union_visible,
    f"WITH {PIXELS}, k AS (SELECT l_orderkey * 8 + l_linenumber AS p, row_number() OVER (PARTITION BY frame, part % 16, l_linenumber ORDER BY gt, l_orderkey * 8 + l_linenumber) AS k FROM pix), s AS (SELECT DISTINCT p FROM k WHERE k = 1) "
    "SELECT part, count(*) AS n_points FROM pix JOIN s ON l_orderkey * 8 + l_linenumber = p GROUP BY part",
)


def cloud_pair(spark, d):
    p = points(spark, d).withColumn("scene", F.lit(0))
    return p.where("is_pred").drop("is_pred"), p.where("not is_pred").drop("is_pred")


_NN = f"""WITH {POINTS}, dd AS (SELECT a.point_id AS a, b.point_id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM pts a JOIN pts b ON a.is_pred AND NOT b.is_pred),
  pg AS (SELECT a, min(d) AS distance FROM dd GROUP BY a), gp AS (SELECT b, min(d) AS distance FROM dd GROUP BY b)"""


def neighbours(spark, d):
    a, b = cloud_pair(spark, d)
    out = nearest_point(a.select("scene", "point_id", "x", "y", "z"), b.select("scene", "point_id", "x", "y", "z"), ["scene"], 0.06, 2)
    return rounded(out.select("point_id", "near_id", "distance"))


register("j7_nearest_points", neighbours, _NN + ", k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM dd) SELECT a AS point_id, b AS near_id, round(d, 6) AS distance FROM k WHERE k = 1")


def cloud_scores(spark, d):
    a, b = (x.select("scene", "point_id", "x", "y", "z") for x in cloud_pair(spark, d))
    ab, ba = nearest_point(a, b, ["scene"], 0.06, 2), nearest_point(b, a, ["scene"], 0.06, 2)
    return rounded(cloud_metrics(ab, ba, ["scene"], (0.05, 0.1)))


_SHARE = ", ".join(f"100.0 * avg(CASE WHEN distance < {t} THEN 1.0 ELSE 0.0 END) AS s{i}" for i, t in enumerate((0.05, 0.1)))
register(
    "a12_a13_cloud_metrics", cloud_scores,
    _NN + f", p AS (SELECT avg(distance) AS accuracy, {_SHARE} FROM pg), q AS (SELECT avg(distance) AS completeness, {_SHARE} FROM gp) "
    "SELECT 0 AS scene, round(accuracy, 6) AS accuracy, round(p.s0, 6) AS \"precision_0.05\", round(p.s1, 6) AS \"precision_0.1\", round(completeness, 6) AS completeness, round(q.s0, 6) AS \"recall_0.05\", round(q.s1, 6) AS \"recall_0.1\", "
    "round((accuracy + completeness) / 2, 6) AS chamfer, round(coalesce(2 * p.s0 * q.s0 / nullif(p.s0 + q.s0, 0), 0), 6) AS \"f1_0.05\", round(coalesce(2 * p.s1 * q.s1 / nullif(p.s1 + q.s1, 0), 0), 6) AS \"f1_0.1\" FROM p, q",
)


def curve(spark, d):
    a, b = (x.select("scene", "point_id", "x", "y", "z") for x in cloud_pair(spark, d))
    return rounded(pr_curve(nearest_point(a, b, ["scene"], 0.06, 2), ["scene"], 0.05).select("bin", "share"))


register("a35_pr_curve", curve, _NN + ", b AS (SELECT CAST(floor(distance / (0.05 / 100)) AS INTEGER) AS bin, count(*) AS n FROM pg WHERE distance < 1000 * (0.05 / 100) GROUP BY 1) SELECT bin, round(100.0 * sum(n) OVER (ORDER BY bin) / (SELECT count(*) FROM pg), 6) AS share FROM b")


def radius(spark, d):
    a, b = cloud_pair(spark, d)
    return rounded(within_radius(a, b, ["scene"], 0.08).select("point_id", "near_id", "distance"))


register("j8_radius_neighbours", radius, _NN + ", k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM dd WHERE d <= 0.08) SELECT a AS point_id, b AS near_id, round(d, 6) AS distance FROM k WHERE k = 1")


def voxels(spark, d):
    return rounded(cl.voxel_mean(points(spark, d), [], 0.1, ["x", "y", "z"]))


_LOW = ", ".join(f"min({c}) - 0.05 AS low_{c}" for c in "xyz")
register("a11_voxel_means", voxels, f"WITH {POINTS}, m AS (SELECT {_LOW} FROM pts) SELECT CAST(floor((x - low_x) / 0.1) AS BIGINT) AS cx, CAST(floor((y - low_y) / 0.1) AS BIGINT) AS cy, CAST(floor((z - low_z) / 0.1) AS BIGINT) AS cz, count(*) AS n, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z FROM pts, m GROUP BY 1, 2, 3")


def bounds(spark, d):
    return rounded(cl.bounds_and_scale(points(spark, d), ["label"]))


register(
    "a14_scene_bounds", bounds,
    f"WITH {POINTS}, q AS (SELECT label, " + ", ".join(f"quantile_cont({c}, 0.05) AS low_{c}, quantile_cont({c}, 0.95) AS high_{c}" for c in "xyz") + " FROM pts GROUP BY label) SELECT label, "
    + ", ".join(f"round({n}_{c}, 6) AS {n}_{c}" for c in "xyz" for n in ("low", "high")) + ", round(greatest(sqrt((high_x - low_x) ** 2 + (high_y - low_y) ** 2 + (high_z - low_z) ** 2), 0.1), 6) AS scale FROM q",
)


def subsampled(spark, d):
    p = cl.every_kth(points(spark, d).where("x > 0"), ["label"], "point_id", 3)
    return p.select("label", "point_id")


register("p7_p23_every_third_survivor", subsampled, f"WITH {POINTS}, k AS (SELECT label, point_id, row_number() OVER (PARTITION BY label ORDER BY point_id) - 1 AS k FROM pts WHERE x > 0) SELECT label, point_id FROM k WHERE k % 3 = 0")


def exported(spark, d):
    e = table(spark, d, "embeddings")
    rgb = [F.floor((F.col("embedding")[i].cast("double") + 0.5) * 255).cast("int").alias(c) for i, c in enumerate("rgb")]
    p = e.select("vec_id", F.col("label").alias("scene"), *rgb, F.abs(F.col("embedding")[3].cast("double")).alias("confidence"))
    return cl.export_filter(p, ["scene"], 40.0).select("scene", "vec_id", "r", "g", "b")


register(
    "p8_k11_export_filter", exported,
    "WITH p AS (SELECT vec_id, label AS scene, CAST(floor((CAST(embedding[1] AS DOUBLE) + 0.5) * 255) AS INTEGER) AS r, CAST(floor((CAST(embedding[2] AS DOUBLE) + 0.5) * 255) AS INTEGER) AS g, "
    "CAST(floor((CAST(embedding[3] AS DOUBLE) + 0.5) * 255) AS INTEGER) AS b, abs(CAST(embedding[4] AS DOUBLE)) AS confidence FROM embeddings), c AS (SELECT scene, quantile_cont(confidence, 0.4) AS cut FROM p GROUP BY scene) "
    "SELECT scene, vec_id, r, g, b FROM p JOIN c USING (scene) WHERE confidence >= cut AND confidence > 1e-5 AND r + g + b >= 16 AND NOT (r > 240 AND g > 240 AND b > 240)",
)


def merged(spark, d):
    a, b = cloud_pair(spark, d)
    return rounded(cl.merge_clouds([a.select("point_id", "x", "label"), b.select("point_id", "x", "y")]))


register("u1_merged_clouds", merged, f"WITH {POINTS} SELECT point_id, round(x, 6) + 0.0 AS x FROM pts")


def camera(spark, d):
    """Unproject pixels, move by a constant, project again; those inside the frustum."""
    p = pixels(spark, d).select("frame", (F.col("part") % 640).cast("double").alias("u0"), (F.col("l_orderkey") % 480).cast("double").alias("v0"), (F.col("gt") / 1000).alias("depth"))
    k = [F.lit(v) for v in (500.0, 480.0, 320.0, 240.0)]
    x, y, z = unproject(F.col("u0"), F.col("v0"), F.col("depth"), *k)
    p = p.select("frame", (x + 0.25).alias("x"), (y - 0.125).alias("y"), z.alias("z"), *[c.alias(n) for c, n in zip(k, ("fx", "fy", "cx", "cy"), strict=True)], F.lit(640).alias("width"), F.lit(480).alias("height"))
    return cl.to_pixels(p, 2.0, 60.0).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("su"), F.sum("v").alias("sv"))


register(
    "f8_p15_frustum", camera,
    f"WITH {PIXELS}, c AS (SELECT frame, (part % 640 - 320.0) * (gt / 1000) / 500.0 + 0.25 AS x, (l_orderkey % 480 - 240.0) * (gt / 1000) / 480.0 - 0.125 AS y, gt / 1000 AS z FROM pix), "
    "q AS (SELECT frame, z, CAST(floor(500.0 * x / z + 320.0) AS INTEGER) AS u, CAST(floor(480.0 * y / z + 240.0) AS INTEGER) AS v FROM c WHERE z > 2 AND z < 60) "
    "SELECT frame, count(*) AS n, CAST(sum(u) AS BIGINT) AS su, CAST(sum(v) AS BIGINT) AS sv FROM q WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480 GROUP BY frame",
)


def image_sizes(spark, d):
    """F10-F14, F28 over part sizes as image sizes."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 20 + 100).alias("w"), (F.col("p_partkey") % 700 + 100).cast("int").alias("h"))
    bw, bh = area_budget_size(F.col("w"), F.col("h"), 255_000, 14)
    c = cover_crop(F.col("w"), F.col("h"), 504, 280)
    s = square_pad(F.col("w"), F.col("h"), 518)
    k = resize_intrinsics(F.struct(F.lit(500.0).alias("fx"), F.lit(400.0).alias("fy"), (F.col("w") / 2).alias("cx"), (F.col("h") / 2).alias("cy")), c.scale, c.scale, c.left, c.top)
    out = p.select("p_partkey", bw.alias("bw"), bh.alias("bh"), c.width.alias("cw"), c.height.alias("ch"), c.left.alias("left"), width_fit_height(F.col("w"), F.col("h"), 518).alias("fit_h"), s.x1.alias("x1"), s.y2.alias("y2"), k.fx.alias("fx"), k.cy.alias("cy"), fov_of(F.lit(500.0), F.col("w")).alias("fov"))
    return rounded(out, 4)


register(
    "f10_f14_f28_image_sizes", image_sizes,
    "WITH p AS (SELECT p_partkey, p_size * 20 + 100 AS w, CAST(p_partkey % 700 + 100 AS INTEGER) AS h FROM part), s AS (SELECT *, least(sqrt(255000.0 / (w * h)), 1) AS b, greatest(504.0 / w, 280.0 / h) AS c, greatest(w, h) AS side FROM p), "
    "t AS (SELECT *, CAST(round_even(w * CAST(c AS DOUBLE), 0) AS INTEGER) AS cw, CAST(round_even(h * CAST(c AS DOUBLE), 0) AS INTEGER) AS ch FROM (SELECT * REPLACE (greatest(CAST(504 AS DOUBLE) / w, CAST(280 AS DOUBLE) / h) AS c) FROM s)) "
    "SELECT p_partkey, CAST(greatest(floor(w * sqrt(CAST(255000 AS DOUBLE) / (w * h)) / 14) * 14 * (CASE WHEN b < 1 THEN 1 ELSE 0 END) + floor(w / 14.0) * 14 * (CASE WHEN b < 1 THEN 0 ELSE 1 END), 14) AS INTEGER) AS bw, "
    "CAST(greatest(floor(h * sqrt(CAST(255000 AS DOUBLE) / (w * h)) / 14) * 14 * (CASE WHEN b < 1 THEN 1 ELSE 0 END) + floor(h / 14.0) * 14 * (CASE WHEN b < 1 THEN 0 ELSE 1 END), 14) AS INTEGER) AS bh, cw, ch, "
    "CAST(floor((cw - 504) / 2.0) AS INTEGER) AS \"left\", CAST(floor(floor(h * 518 / CAST(w AS DOUBLE)) / 14) * 14 AS INTEGER) AS fit_h, round(floor((side - w) / 2.0) * (518.0 / CAST(side AS DOUBLE)), 4) AS x1, round((floor((side - h) / 2.0) + h) * (518.0 / CAST(side AS DOUBLE)), 4) AS y2, "
    "round(500.0 * c, 4) AS fx, round(h / CAST(2 AS DOUBLE) * c - floor((ch - 280) / 2.0), 4) AS cy, round(2 * atan(w / CAST(2 AS DOUBLE) / 500.0), 4) AS fov FROM t",
)


def intrinsics_fallback(spark, d):
    """A value from the first of two tables that knows the key, else a default."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    a = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), (F.col("n_regionkey") + 100).alias("fx"))
    b = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("k"), (F.col("n_regionkey") + 200).alias("fx"))
    return first_known(c, [a, b], ["k"], ["fx"]).select("c_custkey", F.coalesce("fx", F.lit(-1)).alias("fx"))


register("j12_j20_j21_intrinsics_fallback", intrinsics_fallback, "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN n_regionkey + 100 WHEN c_nationkey % 3 = 0 THEN n_regionkey + 200 ELSE -1 END AS fx FROM customer JOIN nation ON c_nationkey = n_nationkey")


def correspondence(spark, d):
    """Pixels that both depths have, with the frame's camera."""
    p = pixels(spark, d)
    a = p.where("gt > 10000").select("frame", "l_orderkey", "l_linenumber", "gt")
    b = p.where("pred > 10000").select("frame", "l_orderkey", "l_linenumber", "pred")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("frame"), "s_nationkey")
    out = a.join(b, ["frame", "l_orderkey", "l_linenumber"]).join(s, "frame", "left")
    return rounded(out.groupBy("frame", "s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("gt") - F.col("pred")).alias("mean_gap")), 4)


register("j9_j11_pixel_correspondence", correspondence, f"WITH {PIXELS} SELECT a.frame, s_nationkey, count(*) AS n, round(avg(a.gt - b.pred), 4) AS mean_gap FROM pix a JOIN pix b USING (frame, l_orderkey, l_linenumber) LEFT JOIN supplier ON a.frame = s_suppkey WHERE a.gt > 10000 AND b.pred > 10000 GROUP BY 1, 2")


def scalars(spark, d):
    """activations and normalisation of embedding components."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    e = e.crossJoin(F.broadcast(e.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))))  # one row
    return rounded(e.select("vec_id", inverse_log(F.col("x")).alias("inv"), confidence_of(F.col("x")).alias("conf"), min_max(F.col("x"), F.col("lo"), F.col("hi")).alias("unit")))


register("f22_f23_activations", scalars, "WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), b AS (SELECT min(x) AS lo, max(x) AS hi FROM e) SELECT vec_id, round(sign(x) * (exp(abs(x)) - 1), 6) + 0.0 AS inv, round(1 + exp(x), 6) AS conf, round((x - lo) / (hi - lo), 6) AS unit FROM e, b")


def gridded(spark, d):
    """Line items as points and depths of frames, every fifth without a camera; some points are the origin, some depths too small or not finite."""
    k = F.col("l_orderkey")
    p = pixels(spark, d).select("frame", "l_orderkey", "l_linenumber", *[F.when(k % 3 == 0, 0.0).otherwise(F.col("gt") * f).alias(c) for c, f in (("x", 1.0), ("y", 0.5), ("z", 0.25))], F.when(k % 7 == 0, float("nan")).when(k % 7 == 1, 1e-4).otherwise(F.col("gt")).alias("depth"), (F.col("frame") % 5 != 0).alias("has_camera"))
    points_ = cl.valid_grid_points(p).groupBy("frame").agg(F.count(F.lit(1)).alias("n_points"))
    depths = cl.valid_grid_depths(p).groupBy("frame").agg(F.count(F.lit(1)).alias("n_depths"), F.sum("depth").alias("total"))
    return rounded(points_.join(depths, "frame", "full"), 2)


register(
    "p3_valid_grid_points", gridded,
    f"WITH {PIXELS} SELECT frame, nullif(count(*) FILTER (l_orderkey % 3 <> 0 AND gt <> 0), 0) AS n_points, nullif(count(*) FILTER (l_orderkey % 7 > 1 AND gt > 1e-4), 0) AS n_depths, round(sum(gt) FILTER (l_orderkey % 7 > 1 AND gt > 1e-4), 2) AS total FROM pix WHERE frame % 5 <> 0 GROUP BY frame",
)
