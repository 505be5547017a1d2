"""Queries over camera motion, windows of frames, viewers and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.functions.geometry import compose, from_inverse_depth, induced_flow, invert_affine, move_homogeneous, nearest_source, planar_pose, pose, project_homogeneous, quaternion, r, rotation_of, scene_alignment
from trajecta.operators import clouds as cl
from trajecta.operators import flow as fl
from trajecta.operators import frames as fr
from trajecta.operators.joins import consecutive
from trajecta.operators.metrics import throughput
from trajecta.operators.ranks import order_categories
from trajecta.operators.robust import align_robust
from trajecta.operators.windows import chain_alignments
from trajecta.plans.bindings import FRAMES, PIXELS, events, frames, pixels, poses, rounded, table
from trajecta.plans.registry import register
from trajecta.streaming.keyframes import Retention, keyframe_replay

CAMERA = (40.0, 36.0, 16.0, 12.0)  # fx, fy, cx, cy of an image of 32 by 24 pixels
_GRID = [(u, v) for v in (0, 8, 16) for u in (0, 8, 16, 24)]


def _samples(event_id) -> list:
    """Arrays u, v and depth of twelve pixels of a frame."""
    depth = [4.0 + (event_id % 5) + 0.25 * k for k in range(len(_GRID))]
    return [F.array(*[F.lit(float(u)) for u, _ in _GRID]).alias("u"), F.array(*[F.lit(float(v)) for _, v in _GRID]).alias("v"), F.array(*depth).alias("depth")]


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    return f.select("scene", "frame_idx", planar_pose(F.col("yaw"), F.col("x") / 100, F.col("y") / 1000).alias("pose"), *_samples(F.col("event_id")))


def flow_steps(spark, d):
    """Mean flow of every frame against the one before it."""
    steps = consecutive(_sampled(spark, d), ["scene"], "frame_idx", ["pose"])
    cells = F.explode(F.arrays_zip("u", "v", "depth")).alias("c")
    rel = compose(invert_affine(F.col("p_pose")), F.col("pose"))
    rows = steps.select("scene", "frame_idx", rel.alias("rel"), "u", "v", "depth").select("scene", "frame_idx", "rel", cells).select("scene", "frame_idx", "rel", "c.*")
    rows = rows.withColumns(dict(zip(("fx", "fy", "cx", "cy"), map(F.lit, CAMERA), strict=True)))
    return rounded(fl.mean_flow(rows, ["scene", "frame_idx"]), 4)


# The flow of pixel k, at depth z, from pose (yaw, x, y) to pose (kyaw, kx, ky): planar, so depths stay.
_UV = "[" + ", ".join(f"{{'u': {u}.0, 'v': {v}.0, 'k': {k}}}" for k, (u, v) in enumerate(_GRID)) + "]"
_SQL_FLOW = """list_avg(list_transform(list_transform(UV, lambda p: {'u': p.u, 'v': p.v, 'z': 4.0 + e + 0.25 * p.k,
    'a': cos(yaw) * (p.u - 16) / 40 * (4.0 + e + 0.25 * p.k) - sin(yaw) * (p.v - 12) / 36 * (4.0 + e + 0.25 * p.k) + x - kx,
    'b': sin(yaw) * (p.u - 16) / 40 * (4.0 + e + 0.25 * p.k) + cos(yaw) * (p.v - 12) / 36 * (4.0 + e + 0.25 * p.k) + y - ky}),
    lambda q: sqrt((40 * (cos(kyaw) * q.a + sin(kyaw) * q.b) / q.z + 16 - q.u) ** 2 + (36 * (-sin(kyaw) * q.a + cos(kyaw) * q.b) / q.z + 12 - q.v) ** 2)))""".replace("UV", _UV)
_SMALL = "sm AS (SELECT scene, frame_idx, yaw, x / 100 AS x, y / 1000 AS y, CAST(event_id % 5 AS DOUBLE) AS e FROM fr)"

register(
    "a20_mean_induced_flow", flow_steps,
    f"WITH {FRAMES}, {_SMALL}, st AS (SELECT *, lag(yaw) OVER w AS kyaw, lag(x) OVER w AS kx, lag(y) OVER w AS ky FROM sm WINDOW w AS (PARTITION BY scene ORDER BY frame_idx)) "
    f"SELECT scene, frame_idx, round({_SQL_FLOW}, 4) AS flow, CAST(12 AS BIGINT) AS n_valid FROM st WHERE kyaw IS NOT NULL",
)


def projected(spark, d):
    """pixel (8, 16) of every frame in inverse depth under a turn about z and a shift, some points near or behind, and the flow at its depth."""
    e = events(spark, d).select("event_id", (F.col("event_id") % 9 / 8.0).alias("w"), F.radians((F.col("event_id") % 5).cast("double")).alias("a"), (F.col("event_id") % 7 - 4.0).alias("tz"))
    c, s = F.cos("a"), F.sin("a")
    m = pose(c, -s, F.lit(0.0), F.lit(0.5), s, c, F.lit(0.0), F.lit(-0.25), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("tz"))
    u, v, camera = F.lit(8.0), F.lit(16.0), [F.lit(x) for x in CAMERA]
    px, py, depth, fine = project_homogeneous(*move_homogeneous(m, *from_inverse_depth(u, v, F.col("w"), *camera)), *camera)
    flow = induced_flow(u, v, 1 / F.nullif("w", F.lit(0.0)), m, *camera)
    return rounded(e.select("event_id", px.alias("px"), py.alias("py"), depth.alias("inverse"), fine.alias("fine"), flow.alias("flow")), 5)


_AHEAD = "CASE WHEN 1 + tz * w < 0.1 THEN 1 ELSE 1 + tz * w END"
register(
    "f9_inverse_depth_projection", projected,
    f"""WITH e AS (SELECT event_id, event_id % 9 / 8.0 AS w, radians(CAST(event_id % 5 AS DOUBLE)) AS a, event_id % 7 - 4.0 AS tz FROM events),
  p AS (SELECT *, cos(a) * (8 - 16) / 40.0 - sin(a) * (16 - 12) / 36.0 + 0.5 * w AS x, sin(a) * (8 - 16) / 40.0 + cos(a) * (16 - 12) / 36.0 - 0.25 * w AS y, 1 + tz * w AS z FROM e)
  SELECT event_id, round(40 * x / ({_AHEAD}) + 16, 5) + 0.0 AS px, round(36 * y / ({_AHEAD}) + 12, 5) + 0.0 AS py, round(w / ({_AHEAD}), 5) + 0.0 AS inverse, z > 0.2 AS fine,
    CASE WHEN w > 0 AND z / w > 0.2 THEN round(sqrt((40 * x / z + 16 - 8) ** 2 + (36 * y / z + 12 - 16) ** 2), 5) END AS flow FROM p""",
)


def flow_matrix(spark, d):
    """Suppliers of a nation as frames; some depths are too near, so some pairs are infinitely far (-1 here)."""
    s = table(spark, d, "supplier")
    f = s.select(F.col("s_nationkey").alias("scene"), F.col("s_suppkey").alias("frame_idx"), planar_pose(F.radians((F.col("s_suppkey") * 7 % 90).cast("double")), F.col("s_acctbal") / 1000, F.col("s_nationkey") / 10.0).alias("pose"))
    depth = F.array(*[F.when((F.col("s_suppkey") % 3 == 0) & F.lit(k < 9), 0.1).otherwise(3.0 + 0.5 * k) for k in range(len(_GRID))])
    grid = F.array(*[F.struct(F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v")) for u, v in _GRID])
    cells = s.select(F.col("s_nationkey").alias("scene"), F.col("s_suppkey").alias("frame_idx"), F.explode(F.arrays_zip(grid.alias("p"), depth.alias("depth"))).alias("c"))
    out = fl.flow_distance_matrix(f, cells.select("scene", "frame_idx", "c.p.u", "c.p.v", "c.depth"), ["scene"], *CAMERA)
    return rounded(out.withColumn("distance", F.when(F.col("distance") == float("inf"), -1.0).otherwise(F.col("distance"))), 4)


_WAY = "sqrt((40 * (cos({b}.yaw) * (a_ - {b}.x) + sin({b}.yaw) * (b_ - {b}.y)) / z + 16 - u) ** 2 + (36 * (-sin({b}.yaw) * (a_ - {b}.x) + cos({b}.yaw) * (b_ - {b}.y)) / z + 12 - v) ** 2)"
register(
    "a21_flow_distance_matrix", flow_matrix,
    "WITH s AS (SELECT s_nationkey AS scene, s_suppkey AS id, radians(CAST(s_suppkey * 7 % 90 AS DOUBLE)) AS yaw, s_acctbal / 1000 AS x, s_nationkey / CAST(10 AS DOUBLE) AS y FROM supplier), "
    f"g AS (SELECT unnest({_UV}) AS p), w AS (SELECT s.*, p.u AS u, p.v AS v, CASE WHEN id % 3 = 0 AND p.k < 9 THEN 0.1 ELSE 3.0 + 0.5 * p.k END AS z FROM s, g), "
    "q AS (SELECT *, cos(yaw) * (u - 16) / 40 * z - sin(yaw) * (v - 12) / 36 * z + x AS a_, sin(yaw) * (u - 16) / 40 * z + cos(yaw) * (v - 12) / 36 * z + y AS b_ FROM w), "
    f"o AS (SELECT q.scene, q.id AS i, t.id AS j, z > 0.2 AS fine, least({_WAY.format(b='t')}, 100) AS f FROM q JOIN s t ON q.scene = t.scene), "
    "b AS (SELECT scene, i, j, fine, f FROM o UNION ALL SELECT scene, j, i, fine, f FROM o) "
    "SELECT scene, i, j, round(CASE WHEN avg(CASE WHEN fine THEN 1.0 ELSE 0.0 END) < 0.7 THEN -1 ELSE avg(f) FILTER (fine) END, 4) AS distance FROM b GROUP BY scene, i, j",
)


def flow_keys(spark, d):
    """Keyframes by the flow against the last keyframe."""
    return rounded(fl.flow_keyframes(_sampled(spark, d), ["scene"], CAMERA, 4, 30.0, 6), 3)


_KEYFRAMES = f"""{FRAMES}, {_SMALL}, k AS (
  SELECT scene, frame_idx, 0 AS kind, CAST(0 AS DOUBLE) AS flow, yaw AS kyaw, x AS kx, y AS ky, frame_idx AS last, 0 AS keys FROM sm WHERE frame_idx = 0
  UNION ALL
  SELECT scene, frame_idx, kind, flow, CASE WHEN kind = 2 THEN kyaw ELSE yaw END, CASE WHEN kind = 2 THEN kx ELSE x END, CASE WHEN kind = 2 THEN ky ELSE y END, CASE WHEN kind = 2 THEN last ELSE frame_idx END, keys + CASE WHEN kind = 1 THEN 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN frame_idx < 4 THEN 0 WHEN keys = 0 OR flow > 30 OR frame_idx - last >= 6 THEN 1 ELSE 2 END AS kind
    FROM (SELECT *, CASE WHEN frame_idx < 4 THEN 0 ELSE {_SQL_FLOW} END AS flow
      FROM (SELECT sm.scene, sm.frame_idx, sm.yaw, sm.x, sm.y, sm.e, k.kyaw, k.kx, k.ky, k.last, k.keys FROM k JOIN sm ON sm.scene = k.scene AND sm.frame_idx = k.frame_idx + 1))))"""
register("w9_t4_flow_keyframes", flow_keys, f"WITH RECURSIVE {_KEYFRAMES} SELECT scene, frame_idx, kind, round(flow, 3) AS flow FROM k")


def cached_frames(spark, d):
    """The replay of the frame cache: what is read, kept and evicted at every frame; summaries of evicted frames stay."""
    rows = _sampled(spark, d).withColumn("summary", F.array(F.col("frame_idx").cast("double")))
    out = keyframe_replay(rows, CAMERA, Retention(4, 5, "evicted"), 30.0, 6, by="scene")
    return rounded(out.withColumn("evicted", F.get("evicted", F.lit(0))), 3)


register(
    "t2_t3_t4_frame_cache", cached_frames,
    f"""WITH RECURSIVE {_KEYFRAMES}, n AS (SELECT scene, count(*) AS n FROM sm GROUP BY scene),
  c AS (SELECT scene, frame_idx, kind, flow, CAST(sum(CASE WHEN kind < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY scene ORDER BY frame_idx) AS BIGINT) AS done FROM k),
  e AS (SELECT scene, frame_idx, lag(frame_idx, 5) OVER (PARTITION BY scene ORDER BY frame_idx) AS old FROM k WHERE kind < 2)
  SELECT c.scene, c.frame_idx, kind, round(flow, 3) AS flow, CAST(CASE WHEN kind = 0 THEN least(4, n) ELSE least(done - kind % 2, 4) + least(greatest(done - kind % 2 - 4, 0), 5) + 1 END AS INTEGER) AS n_read,
    CAST(least(4, CASE WHEN kind = 0 THEN n ELSE done END) AS INTEGER) AS n_pinned, CAST(CASE WHEN kind = 0 THEN 0 ELSE least(greatest(done - 4, 0), 5) END AS INTEGER) AS n_window,
    CASE WHEN kind = 0 THEN 0 ELSE greatest(done - 9, 0) END AS n_summaries, CASE WHEN kind = 1 AND done > 9 THEN old END AS evicted, c.frame_idx + 1 AS total
  FROM c JOIN n ON n.scene = c.scene LEFT JOIN e ON e.scene = c.scene AND e.frame_idx = c.frame_idx""",
)


def filling_cache(spark, d):
    """T3 without pinned frames, every frame a keyframe: the cache fills up to 3 + 6 and falls back to 6."""
    rows = _sampled(spark, d).withColumn("summary", F.array(F.col("frame_idx").cast("double"), F.lit(1.0)))
    out = keyframe_replay(rows, CAMERA, Retention(3, 6, "evicted", True, False), -1.0, 1, by="scene")
    return out.select("scene", "frame_idx", "kind", "n_window", "n_summaries", F.size("evicted").alias("n_evicted"), F.array_max("evicted").alias("last_evicted"))


# After n frames: n up to 9, then 6 and on, falling back every fourth frame; of four that leave, the first three leave nothing.
register(
    "t3_window_only_cache", filling_cache,
    f"""WITH {FRAMES}, s AS (SELECT scene, frame_idx, frame_idx + 1 AS n, count(*) OVER (PARTITION BY scene) AS whole FROM fr)
  SELECT scene, frame_idx, CASE WHEN n <= 3 THEN 0 ELSE 1 END AS kind, CAST(CASE WHEN n <= 3 THEN least(whole, 3) WHEN n < 10 THEN n ELSE 6 + (n - 10) % 4 END AS INTEGER) AS n_window,
    CASE WHEN n < 10 THEN 0 ELSE (n - 10) // 4 + 1 END AS n_summaries, CASE WHEN n >= 10 AND (n - 10) % 4 = 0 THEN 4 ELSE 0 END AS n_evicted, CASE WHEN n >= 10 AND (n - 10) % 4 = 0 THEN n - 7 END AS last_evicted FROM s""",
)


def flow_windows(spark, d):
    """A loop over each sequence has no SQL; compared with a plain loop in the tests."""
    return rounded(fl.flow_windows(_sampled(spark, d), ["scene"], CAMERA, 9, 3, 3, 30.0, 6), 3)


register("t8_flow_windows", flow_windows)


def chained(spark, d):
    """Each window's scale and pose against the one before it, chained to the first window's frame."""
    pairs = frames(spark, d).select(
        "scene", F.col("frame_idx").alias("window_id"), F.exp((F.col("event_id") % 7 - 3) * 0.05).alias("scale"), planar_pose(F.radians((F.col("event_id") % 11).cast("double")), F.col("x") / 1000, F.col("event_id") % 3 * 0.25).alias("m")
    )
    out = chain_alignments(pairs, ["scene"], "window_id")
    return rounded(out.select("scene", "window_id", "scale", r(F.col("m"), 0, 0).alias("r00"), r(F.col("m"), 1, 0).alias("r10"), r(F.col("m"), 0, 3).alias("x"), r(F.col("m"), 1, 3).alias("y")), 4)


register(
    "t9_f25_chained_windows", chained,
    f"WITH {FRAMES}, p AS (SELECT scene, frame_idx, (event_id % 7 - 3) * CAST(0.05 AS DOUBLE) AS g, radians(CAST(event_id % 11 AS DOUBLE)) AS a, x / 1000 AS tx, event_id % 3 * CAST(0.25 AS DOUBLE) AS ty FROM fr), "
    "c AS (SELECT *, coalesce(sum(CASE WHEN frame_idx > 0 THEN g END) OVER w, 0) AS s, coalesce(sum(CASE WHEN frame_idx > 0 THEN a END) OVER w, 0) AS yaw FROM p WINDOW w AS (PARTITION BY scene ORDER BY frame_idx)), "
    "b AS (SELECT *, lag(s) OVER w AS s0, lag(yaw) OVER w AS yaw0 FROM c WINDOW w AS (PARTITION BY scene ORDER BY frame_idx)) "
    "SELECT scene, frame_idx AS window_id, round(exp(s), 4) AS scale, round(cos(yaw), 4) + 0.0 AS r00, round(sin(yaw), 4) + 0.0 AS r10, round(coalesce(sum(exp(s0) * (cos(yaw0) * tx - sin(yaw0) * ty)) OVER w, 0), 4) + 0.0 AS x, "
    "round(coalesce(sum(exp(s0) * (sin(yaw0) * tx + cos(yaw0) * ty)) OVER w, 0), 4) + 0.0 AS y FROM b WINDOW w AS (PARTITION BY scene ORDER BY frame_idx)",
)


def spatial_turns(spark, d):
    """F1, F2, F3 in space: quaternions of any axis through matrices and back, and the inverse of a scaled pose."""
    e = events(spark, d)
    a, b, t = F.radians((F.col("event_id") % 181).cast("double")), F.radians((F.col("event_id") % 359).cast("double")), F.radians((F.col("event_id") % 353).cast("double")) / 2
    q = F.struct((F.sin(t) * F.sin(a) * F.cos(b)).alias("x"), (F.sin(t) * F.sin(a) * F.sin(b)).alias("y"), (F.sin(t) * F.cos(a)).alias("z"), F.cos(t).alias("w"))
    e = e.select("event_id", rotation_of(q, F.col("value") / 100, F.lit(1.5), F.col("k") / 10.0).alias("m"))
    scaled = pose(*[(1.5 if i % 4 != 3 else 1.0) * F.col("m")[i] for i in range(12)])
    e = e.select("event_id", quaternion(F.col("m")).alias("q"), invert_affine(scaled).alias("inv"), compose(invert_affine(scaled), scaled).alias("unit"))
    return rounded(e.select("event_id", *[F.abs(F.col(f"q.{n}")).alias(f"q{n}") for n in "xyzw"], *[r(F.col("inv"), i, 3).alias(f"t{i}") for i in range(3)], r(F.col("unit"), 0, 0).alias("one"), r(F.col("unit"), 1, 2).alias("zero")), 5)


register(
    "f1_f2_f3_turns_in_space", spatial_turns,
    """WITH e AS (SELECT event_id, radians(CAST(event_id % 181 AS DOUBLE)) AS a, radians(CAST(event_id % 359 AS DOUBLE)) AS b, radians(CAST(event_id % 353 AS DOUBLE)) / 2 AS t, value / 100 AS tx,
    CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) / 10 AS tz FROM events),
  q AS (SELECT *, sin(t) * sin(a) * cos(b) AS x, sin(t) * sin(a) * sin(b) AS y, sin(t) * cos(a) AS z, cos(t) AS w FROM e),
  c AS (SELECT *, y * tz - z * 1.5 AS cx, z * tx - x * tz AS cy, x * 1.5 - y * tx AS cz FROM q)
  SELECT event_id, round(abs(x), 5) AS qx, round(abs(y), 5) AS qy, round(abs(z), 5) AS qz, round(abs(w), 5) AS qw,
    round(-(tx - 2 * w * cx + 2 * (y * cz - z * cy)) / 1.5, 5) + 0.0 AS t0, round(-(1.5 - 2 * w * cy + 2 * (z * cx - x * cz)) / 1.5, 5) + 0.0 AS t1,
    round(-(tz - 2 * w * cz + 2 * (x * cy - y * cx)) / 1.5, 5) + 0.0 AS t2, CAST(1.0 AS DOUBLE) AS one, CAST(0.0 AS DOUBLE) AS zero FROM c""",
)


def robust(spark, d):
    """Events of a user as pairs of points under one similarity, but for every fourth, which lies anywhere."""
    e = events(spark, d)
    src = (F.col("value") / 10, F.col("k") / 10.0, F.col("event_id") % 97 / 10.0)
    x, y, z = src
    c, s = F.cos(F.lit(0.5)), F.sin(F.lit(0.5))
    to = (1.5 * (c * x - s * y) + 1, 1.5 * (s * x + c * y) + 2, 1.5 * z + 3)
    off = [(F.col("event_id") * a % b).cast("double") for a, b in ((37, 101), (53, 89), (7, 13))]
    good = F.col("event_id") % 4 != 0
    p = e.select(F.col("user_id").alias("scene"), *[v.cast("double").alias(f"s{n}") for n, v in zip("xyz", src, strict=True)], *[F.when(good, v).otherwise(o).alias(f"t{n}") for n, v, o in zip("xyz", to, off, strict=True)])
    m = F.col("align")
    return rounded(align_robust(p, ["scene"], 1e-4).select("scene", "scale", "n_inliers", m[0].alias("r00"), m[4].alias("r10"), m[3].alias("x"), m[7].alias("y"), m[11].alias("z")), 5)


register(
    "a9_robust_alignment", robust,
    "SELECT user_id AS scene, CAST(1.5 AS DOUBLE) AS scale, count(*) FILTER (event_id % 4 <> 0) AS n_inliers, round(cos(0.5), 5) AS r00, round(sin(0.5), 5) AS r10, CAST(1 AS DOUBLE) AS x, CAST(2 AS DOUBLE) AS y, CAST(3 AS DOUBLE) AS z FROM events GROUP BY user_id",
)


def aligned_scene(spark, d):
    """points of a scene seen from its first camera."""
    first = poses(spark, d).where("frame_idx = 0").select("scene", scene_alignment(F.col("gt")).alias("m"))
    moved = frames(spark, d).select("scene", "frame_idx", "x", "y", F.lit(2.0).alias("z")).join(first, "scene")
    x, y, z = (r(F.col("m"), i, 0) * F.col("x") + r(F.col("m"), i, 1) * F.col("y") + r(F.col("m"), i, 2) * F.col("z") + r(F.col("m"), i, 3) for i in range(3))
    return rounded(moved.select("scene", "frame_idx", x.alias("ax"), y.alias("ay"), z.alias("az")), 4)


# inverse(E0) after diag(-1, -1, 1): the point is turned about z first, then brought into the camera.
register(
    "f27_scene_alignment", aligned_scene,
    f"WITH {FRAMES}, f AS (SELECT *, first_value(yaw) OVER w AS yaw0, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0 FROM fr WINDOW w AS (PARTITION BY scene ORDER BY frame_idx)) "
    "SELECT scene, frame_idx, round(cos(yaw0) * (-x - x0) + sin(yaw0) * (-y - y0), 4) + 0.0 AS ax, round(-sin(yaw0) * (-x - x0) + cos(yaw0) * (-y - y0), 4) + 0.0 AS ay, CAST(2.0 AS DOUBLE) AS az FROM f",
)


def resized(spark, d):
    """rows and columns that a resize by the nearest neighbour reads."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 3).alias("src"), (F.col("p_partkey") % 37 + 5).cast("int").alias("dst"))
    p = p.withColumn("px", F.explode(F.sequence(F.lit(0), F.col("dst") - 1)))
    return p.groupBy("p_partkey").agg(F.sum(nearest_source(F.col("px"), F.col("dst"), F.col("src"))).alias("sum_src"), F.max(nearest_source(F.col("px"), F.col("dst"), F.col("src"))).alias("last_src"))


register(
    "f26_nearest_resize", resized,
    "WITH p AS (SELECT p_partkey, p_size + 3 AS src, CAST(p_partkey % 37 + 5 AS INTEGER) AS dst FROM part), x AS (SELECT p_partkey, CAST(least(floor(px * src / CAST(dst AS DOUBLE)), src - 1) AS INTEGER) AS s FROM (SELECT *, unnest(range(0, dst)) AS px FROM p)) "
    "SELECT p_partkey, CAST(sum(s) AS BIGINT) AS sum_src, max(s) AS last_src FROM x GROUP BY p_partkey",
)


def viewer(spark, d):
    """P10 over line items as pixels: every second row and column without sky."""
    p = pixels(spark, d).select("frame", (F.col("part") % 16).alias("u"), F.col("l_linenumber").alias("v"), "gt", F.when(F.col("part") % 5 > 0, F.col("part") % 5 == 1).alias("sky"))
    return rounded(cl.viewer_pixels(p, 2).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum("gt").alias("total")), 2)


register("p10_viewer_pixels", viewer, f"WITH {PIXELS} SELECT frame, count(*) AS n, round(sum(gt), 2) AS total FROM pix WHERE part % 16 % 2 = 0 AND l_linenumber % 2 = 0 AND part % 5 <> 1 GROUP BY frame")


def point_sizes(spark, d):
    """Nations as groups, their suppliers as frames; every fourth supplier has no camera."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("frame"), F.col("s_nationkey").alias("nation"))
    p = pixels(spark, d).join(s, "frame").select("nation", "frame", F.when(F.col("frame") % 3 > 0, F.col("gt")).otherwise(0.0).alias("depth"))
    cameras = s.where("frame % 4 <> 0").select("nation", "frame", (F.lit(500.0) + F.col("frame")).alias("fx"), F.lit(480.0).alias("fy"))
    return rounded(cl.base_point_size(p, cameras, ["nation"]))


register(
    "a39_base_point_size", point_sizes,
    f"WITH {PIXELS}, p AS (SELECT s_nationkey AS nation, frame, CASE WHEN frame % 3 > 0 THEN gt ELSE 0 END AS depth FROM pix JOIN supplier ON frame = s_suppkey), "
    "m AS (SELECT nation, frame, avg(depth) / ((500.0 + frame + 480.0) / 2) * 0.1 AS size FROM p WHERE depth > 0 AND frame % 4 <> 0 GROUP BY 1, 2), f AS (SELECT nation, min(frame) AS frame, arg_min(size, frame) AS size FROM m GROUP BY 1) "
    "SELECT n.nation, frame, round(coalesce(size, 0.001), 6) AS size FROM (SELECT DISTINCT nation FROM p) n LEFT JOIN f ON n.nation = f.nation",
)


def speeds(spark, d):
    """The values of events as milliseconds a frame, after a first phase of 8 frames in 400 ms."""
    f = frames(spark, d).select("scene", "frame_idx", (F.abs("x") + 1).alias("ms"))
    return rounded(throughput(f, ["scene"], "frame_idx", "ms", 8, 400.0), 4)


def _near(place: str, name: str) -> str:
    return f"round(1000.0 / avg(CASE WHEN frame_idx BETWEEN {place} - 30 AND {place} + 30 THEN ms END), 4) AS fps_{name}"


register(
    "a36_throughput", speeds,
    f"WITH {FRAMES}, f AS (SELECT scene, frame_idx, abs(x) + 1 AS ms, count(*) OVER (PARTITION BY scene) AS n FROM fr) SELECT scene, 8 + count(*) AS total_frames, round(1000.0 / ((400.0 + sum(ms)) / (8 + count(*))), 4) AS global_fps, "
    + ", ".join([_near("greatest(10, n // 10)", "lo"), _near("n // 2", "mid"), _near("(n - greatest(1, n // 10))", "hi")]) + " FROM f GROUP BY scene",
)


def camera_extent(spark, d):
    f = frames(spark, d).select("scene", "x", "y", (F.col("event_id") % 4 * 0.5).alias("z"))
    return rounded(cl.camera_bounds(f, ["scene"]), 5)


register(
    "a14_camera_bounds", camera_extent,
    f"WITH {FRAMES}, c AS (SELECT scene, x, y, event_id % 4 * 0.5 AS z FROM fr) SELECT scene, round(avg(x), 5) + 0.0 AS centre_x, round(avg(y), 5) + 0.0 AS centre_y, round(avg(z), 5) + 0.0 AS centre_z, "
    "round(CASE WHEN count(*) > 1 THEN greatest(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2), 0.1) ELSE 1 END, 5) AS scale FROM c GROUP BY scene",
)


def latest(spark, d):
    """The last click and the last value over 50 of each user."""
    e = events(spark, d).select("user_id", F.struct("t_us", "event_id").alias("at"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("click"), F.when(F.col("value") > 50, F.col("value")).alias("high"))
    return rounded(fr.latest_known(e, ["user_id"], "at", ["click", "high"]))


register(
    "w10_latest_known", latest,
    f"WITH {FRAMES} SELECT user_id, arg_max(event_id, (t_us, event_id)) FILTER (event_type = 'click') AS click, round(arg_max(value, (t_us, event_id)) FILTER (value > 50), 6) AS high FROM ev GROUP BY user_id",
)
register(
    "w12_progress", lambda s, d: rounded(fr.progress(frames(s, d).select("scene", "frame_idx"), ["scene"], "frame_idx")),
    f"WITH {FRAMES} SELECT scene, frame_idx, round(frame_idx / CAST(count(*) OVER (PARTITION BY scene) AS DOUBLE), 6) AS progress FROM fr",
)
register(
    "p11_sample_between", lambda s, d: fr.sample_between(frames(s, d).select("scene", "frame_idx", "event_id"), ["scene"], "frame_idx", 5, 3, 40),
    f"WITH {FRAMES}, n AS (SELECT scene, least(max(frame_idx) + 1, 40) AS upto FROM fr GROUP BY scene), s AS (SELECT scene, CAST(k AS INTEGER) AS sample_pos, CAST(3 + floor(k * (upto - 1 - 3) / 4.0) AS INTEGER) AS frame_idx FROM n, range(5) t(k) WHERE upto > 3) "
    "SELECT scene, frame_idx, sample_pos, event_id FROM s JOIN fr USING (scene, frame_idx)",
)


def listing(spark, d):
    """Names of parts as files of their brand."""
    p = table(spark, d, "part").select("p_brand", F.concat(F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.when(F.col("p_partkey") % 3 == 0, ".PNG").when(F.col("p_partkey") % 3 == 1, ".jpg").otherwise(".txt")).alias("name"), fr.video_interval(F.col("p_size").cast("double"), 10.0).alias("keep_every"))
    return fr.listed_frames(p, ["p_brand"], "name", (".png", "jpg"), 40, 3)


register(
    "s23_listed_frames", listing,
    "WITH p AS (SELECT p_brand, lpad(CAST(p_partkey AS VARCHAR), 8, '0') || CASE p_partkey % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' ELSE '.txt' END AS name, CAST(greatest(round_even(p_size / CAST(10 AS DOUBLE), 0), 1) AS INTEGER) AS keep_every FROM part), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY name) - 1 AS n FROM p WHERE name NOT LIKE '%.txt') SELECT p_brand, name, keep_every, CAST(n // 3 AS INTEGER) AS frame_idx FROM k WHERE n < 40 AND n % 3 = 0",
)


def categories(spark, d):
    """Brands first that are listed, the others by name."""
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return order_categories(p, "category", ["Brand#33", "Brand#11"])


register(
    "o6_category_order", categories,
    "WITH p AS (SELECT p_brand AS category, count(*) AS n FROM part GROUP BY 1) SELECT category, n, CAST(row_number() OVER (ORDER BY CASE category WHEN 'Brand#33' THEN 0 WHEN 'Brand#11' THEN 1 ELSE 2 END, category) AS INTEGER) AS place FROM p",
)
