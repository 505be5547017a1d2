"""Queries over trajectories: pose pairs, as-of joins, relative errors, windows, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.functions.geometry import (
    compose, decode_pose_encoding, finite_pose, invert_affine, invert_rigid, octile, pose_encoding, quaternion, r, rotation_of, slerp,
)
from trajecta.operators import frames as fr
from trajecta.operators.alignment import trajectory_errors
from trajecta.operators.grids import path_length
from trajecta.operators.joins import asof_nearest, consecutive, frame_map
from trajecta.operators.metrics import THRESHOLDS, auc_by_frames, macro, pair_metrics, pose_distances, pose_pair_errors, rank_metrics, long_metrics, mean_of_documents, umeyama_statistics
from trajecta.plans.bindings import EVENTS, FRAMES, events, frames, poses, rounded, table
from trajecta.plans.registry import register
from trajecta.streaming.frames import bounded_replay, live_state, navigation_state, odometry

HOUR = 3_600_000_000


def pair_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of all pairs i < j of each scene, poses given as matrices."""
    return pose_pair_errors(poses(spark, d), ["scene"])


# Planar poses have closed forms: the yaw difference of the relative poses, and their rotated translations.
PAIRS_SQL = (
    "WITH "
    + FRAMES
    + """, pr AS (
  SELECT a.scene, a.frame_idx AS i, b.frame_idx AS j, (b.yaw - a.yaw) - (b.pyaw - a.pyaw) AS dy,
    cos(a.yaw) * (b.x - a.x) + sin(a.yaw) * (b.y - a.y) AS gx, -sin(a.yaw) * (b.x - a.x) + cos(a.yaw) * (b.y - a.y) AS gy,
    cos(a.pyaw) * (b.px - a.px) + sin(a.pyaw) * (b.py - a.py) AS qx, -sin(a.pyaw) * (b.px - a.px) + cos(a.pyaw) * (b.py - a.py) AS qy
  FROM fr a JOIN fr b ON a.scene = b.scene AND a.frame_idx < b.frame_idx
), dt AS (SELECT *, cos(dy / 2) * cos(dy / 2) AS cc, (gx * qx + gy * qy) / ((sqrt(gx * gx + gy * gy) + 1e-15) * (sqrt(qx * qx + qy * qy) + 1e-15)) AS dot FROM pr
), er AS (
  SELECT scene, i, j, degrees(acos(least(greatest(1 - 2 * greatest(1 - cc, 1e-15), -1), 1))) AS r_err,
    degrees(acos(sqrt(least(greatest(1 - greatest(1 - dot * dot, 1e-15), 0), 1)))) AS t_err
  FROM dt)
"""
)


def _sql_metrics() -> str:
    out = []
    for t in THRESHOLDS:
        e = "greatest(r_err, t_err)"
        out += [
            f"100.0 * avg(CASE WHEN r_err < {t} THEN 1.0 ELSE 0.0 END) AS \"Racc_{t:02d}\"", f"100.0 * avg(CASE WHEN t_err < {t} THEN 1.0 ELSE 0.0 END) AS \"Tacc_{t:02d}\"",
            f"100.0 * sum(CASE WHEN {e} <= {t} THEN {t} - least(floor({e}), {t - 1}) ELSE 0 END) / ({t} * count(*)) AS \"AUC_{t:02d}\"",
        ]
    return ", ".join(out)


NAMES = [f"{m}_{t:02d}" for t in THRESHOLDS for m in ("Racc", "Tacc", "AUC")]
ROUND = ", ".join(f'round("{n}", 6) AS "{n}"' for n in NAMES)


def micro(spark, d):
    return rounded(pair_metrics(pair_errors(spark, d).withColumn("dataset", F.lit("events")), ["dataset"]))


def by_scene(spark, d):
    return rounded(pair_metrics(pair_errors(spark, d), ["scene"]))


def macro_query(spark, d):
    return rounded(macro(pair_metrics(pair_errors(spark, d), ["scene"]).withColumn("dataset", F.lit("events")), ["dataset"], NAMES))


register("a3_a4_a6_pose_auc_micro", micro, f"{PAIRS_SQL}, m AS (SELECT count(*) AS n_pairs, {_sql_metrics()} FROM er) SELECT 'events' AS dataset, n_pairs, {ROUND} FROM m")
register("a3_a4_j4_pose_auc_by_scene", by_scene, f"{PAIRS_SQL}, m AS (SELECT scene, count(*) AS n_pairs, {_sql_metrics()} FROM er GROUP BY scene) SELECT scene, n_pairs, {ROUND} FROM m")
register(
    "a7_pose_auc_macro", macro_query,
    f"{PAIRS_SQL}, m AS (SELECT scene, {_sql_metrics()} FROM er GROUP BY scene) SELECT 'events' AS dataset, count(*) AS num_scenes, "
    + ", ".join(f'round(avg("{n}"), 6) AS "{n}"' for n in NAMES) + " FROM m",
)


def auc_frames(spark, d):
    return rounded(auc_by_frames(pair_errors(spark, d), ["scene"], 30))


register(
    "a5_w4_auc_by_frames", auc_frames,
    PAIRS_SQL + """, b AS (SELECT scene, CAST(ceil((j + 1) / 10.0) * 10 AS INTEGER) AS frames, count(*) AS n, max(j) + 1 AS upto,
    sum(CASE WHEN greatest(r_err, t_err) <= 30 THEN 30 - least(floor(greatest(r_err, t_err)), 29) ELSE 0 END) AS area,
    sum(CASE WHEN r_err < 30 THEN 1 ELSE 0 END) AS r, sum(CASE WHEN t_err < 30 THEN 1 ELSE 0 END) AS t FROM er GROUP BY 1, 2)
  SELECT scene, CAST(least(frames, max(upto) OVER (PARTITION BY scene)) AS INTEGER) AS frames, round(100.0 * sum(area) OVER w / (30 * sum(n) OVER w), 6) AS auc, round(100.0 * sum(r) OVER w / sum(n) OVER w, 6) AS racc,
    round(100.0 * sum(t) OVER w / sum(n) OVER w, 6) AS tacc FROM b WINDOW w AS (PARTITION BY scene ORDER BY frames)""",
)


def distance_matrix(spark, d):
    """Mean and largest entry of each scene's matrix of pose distances, from its upper half; the diagonal is zero."""
    p = poses(spark, d).select("scene", "frame_idx", F.col("gt").alias("pose"))
    upper = pose_distances(p, ["scene"]).groupBy("scene").agg(F.sum("distance").alias("total"), F.max("distance").alias("most"))
    n = p.groupBy("scene").agg(F.count(F.lit(1)).alias("n")).join(upper, "scene", "left")
    mean = 2 * F.coalesce("total", F.lit(0.0)) / (F.col("n") * F.col("n"))
    return rounded(n.select("scene", (F.col("n") * F.col("n")).alias("n"), mean.alias("mean_distance"), F.coalesce("most", F.lit(0.0)).alias("max_distance")), 5)


# A planar turn by t stretches the step by t / 2 over sin(t / 2).
register(
    "a22_j5_pose_distance_matrix", distance_matrix,
    f"WITH {FRAMES}, h AS (SELECT a.scene, abs(sin((b.yaw - a.yaw) / 2)) AS half, abs(cos((b.yaw - a.yaw) / 2)) AS w, 6.25 * ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS sq FROM fr a JOIN fr b ON a.scene = b.scene), "
    "p AS (SELECT scene, sqrt((2 * atan2(half, w)) ** 2 + CASE WHEN half > 1e-9 THEN (atan2(half, w) / half) ** 2 ELSE 1 END * sq) AS dist FROM h) "
    "SELECT scene, count(*) AS n, round(avg(dist), 5) AS mean_distance, round(max(dist), 5) AS max_distance FROM p GROUP BY scene",
)


def rpe(spark, d):
    """A2 without alignment and A1's distance: planar, so checked in closed form."""
    return rounded(trajectory_errors(poses(spark, d), ["scene"], aligned=False), 5)


register(
    "a1_a2_j6_w3_trajectory_errors", rpe,
    f"WITH {FRAMES}, " + """st AS (SELECT *, lag(yaw) OVER w AS byaw, lag(x) OVER w AS bx, lag(y) OVER w AS by_, lag(pyaw) OVER w AS cyaw, lag(px) OVER w AS cx, lag(py) OVER w AS cy
    FROM fr WINDOW w AS (PARTITION BY scene ORDER BY frame_idx)),
  rel AS (SELECT scene, yaw - byaw AS gy, pyaw - cyaw AS py_, cos(byaw) * (x - bx) + sin(byaw) * (y - by_) AS g1, -sin(byaw) * (x - bx) + cos(byaw) * (y - by_) AS g2,
    cos(cyaw) * (px - cx) + sin(cyaw) * (py - cy) AS p1, -sin(cyaw) * (px - cx) + cos(cyaw) * (py - cy) AS p2 FROM st WHERE byaw IS NOT NULL),
  e AS (SELECT scene, sqrt((p1 - g1) ** 2 + (p2 - g2) ** 2) AS l, degrees(acos(least(greatest(1 - 2 * greatest(1 - cos((py_ - gy) / 2) ** 2, 1e-15), -1), 1))) AS a FROM rel),
  rr AS (SELECT scene, sqrt(avg(l * l)) AS rpe_trans, sqrt(avg(a * a)) AS rpe_rot FROM e GROUP BY scene),
  tt AS (SELECT scene, sqrt(avg((x - px) ** 2 + (y - py) ** 2)) AS ate, count(*) AS n_frames FROM fr GROUP BY scene)
  SELECT scene, round(ate, 5) AS ate, n_frames, round(rpe_trans, 5) AS rpe_trans, round(rpe_rot, 5) AS rpe_rot FROM tt LEFT JOIN rr USING (scene)""",
)


def aligned_errors(spark, d):
    """Errors after the best similarity; of planar poses the SVD has a closed form."""
    return rounded(trajectory_errors(poses(spark, d), ["scene"]), 4)


# Sums of singular values of the planar covariance: of a turn where its determinant is positive, else of a mirroring, which a turn in space gives.
register(
    "a1_a8_aligned_ate", aligned_errors,
    f"WITH {FRAMES}, " + """m AS (SELECT scene, avg(x) AS mx, avg(y) AS my, avg(px) AS mpx, avg(py) AS mpy FROM fr GROUP BY scene),
  c AS (SELECT scene, avg((x - mx) * (px - mpx)) AS a, avg((x - mx) * (py - mpy)) AS b, avg((y - my) * (px - mpx)) AS c, avg((y - my) * (py - mpy)) AS d,
    avg((px - mpx) ** 2 + (py - mpy) ** 2) AS vp, avg((x - mx) ** 2 + (y - my) ** 2) AS vg, count(*) AS n_frames FROM fr JOIN m USING (scene) GROUP BY scene),
  k AS (SELECT *, sqrt(CASE WHEN a * d - b * c >= 0 THEN (a + d) ** 2 + (c - b) ** 2 ELSE (a - d) ** 2 + (b + c) ** 2 END) AS s FROM c),
  st AS (SELECT *, lag(yaw) OVER w AS byaw, lag(x) OVER w AS bx, lag(y) OVER w AS by_, lag(pyaw) OVER w AS cyaw, lag(px) OVER w AS cx, lag(py) OVER w AS cy
    FROM fr WINDOW w AS (PARTITION BY scene ORDER BY frame_idx)),
  rel AS (SELECT st.scene, yaw - byaw AS gy, pyaw - cyaw AS py_, cos(byaw) * (x - bx) + sin(byaw) * (y - by_) AS g1, -sin(byaw) * (x - bx) + cos(byaw) * (y - by_) AS g2,
    s / vp * (cos(cyaw) * (px - cx) + sin(cyaw) * (py - cy)) AS p1, s / vp * (-sin(cyaw) * (px - cx) + cos(cyaw) * (py - cy)) AS p2 FROM st JOIN k ON k.scene = st.scene WHERE byaw IS NOT NULL),
  e AS (SELECT scene, sqrt((p1 - g1) ** 2 + (p2 - g2) ** 2) AS l, degrees(acos(least(greatest(1 - 2 * greatest(1 - cos((py_ - gy) / 2) ** 2, 1e-15), -1), 1))) AS a FROM rel),
  rr AS (SELECT scene, sqrt(avg(l * l)) AS rpe_trans, sqrt(avg(a * a)) AS rpe_rot FROM e GROUP BY scene)
  SELECT k.scene, round(sqrt(greatest(vg - s * s / vp, 0)), 4) AS ate, n_frames, round(rpe_trans, 4) AS rpe_trans, round(rpe_rot, 4) AS rpe_rot FROM k LEFT JOIN rr ON rr.scene = k.scene""",
)


def statistics(spark, d):
    f = frames(spark, d)
    s = f.select("scene", F.col("px").alias("sx"), F.col("py").alias("sy"), F.lit(0.0).alias("sz"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.lit(0.0).alias("tz"))
    return rounded(umeyama_statistics(s, ["scene"]).select("scene", "n", "sum_sx", "sum_ty", "sum_ss", "sum_tx_sx", "sum_tx_sy", "sum_ty_sx", "sum_ty_sy"), 3)


register(
    "a8_alignment_sums", statistics,
    f"WITH {FRAMES} SELECT scene, count(*) AS n, round(sum(px), 3) AS sum_sx, round(sum(y), 3) AS sum_ty, round(sum(px * px + py * py), 3) AS sum_ss, round(sum(x * px), 3) AS sum_tx_sx, "
    "round(sum(x * py), 3) AS sum_tx_sy, round(sum(y * px), 3) AS sum_ty_sx, round(sum(y * py), 3) AS sum_ty_sy FROM fr GROUP BY scene",
)


def _association(spark, d, inner):
    e = events(spark, d)
    left = e.where("event_type = 'click'").select("user_id", "t_us", "event_id")
    right = e.where("event_type = 'view'").select("user_id", "t_us", F.col("event_id").alias("id"), "value")
    out = asof_nearest(left, right, ["user_id"], "t_us", "id", 8 * HOUR, inner)
    return out.select("user_id", "event_id", "t_us", "r_id", "r_t_us")


_ASOF = f"""WITH {EVENTS}, c AS (
  SELECT l.user_id, l.event_id, l.t_us, r.event_id AS rid, r.t_us AS rt, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t_us - r.t_us), r.t_us, r.event_id) AS k
  FROM ev l JOIN ev r ON l.user_id = r.user_id AND r.event_type = 'view' AND abs(l.t_us - r.t_us) <= {8 * HOUR} WHERE l.event_type = 'click'
)"""
register(
    "j2_asof_nearest_left", lambda s, d: _association(s, d, False),
    _ASOF + " SELECT l.user_id, l.event_id, l.t_us, c.rid AS r_id, c.rt AS r_t_us FROM ev l LEFT JOIN c ON l.event_id = c.event_id AND c.k = 1 WHERE l.event_type = 'click'",
)
register("j3_asof_nearest_inner", lambda s, d: _association(s, d, True), _ASOF + " SELECT user_id, event_id, t_us, rid AS r_id, rt AS r_t_us FROM c WHERE k = 1")


def mapped_frames(spark, d):
    """Predictions for every third ground-truth frame."""
    f = frames(spark, d).select("scene", "frame_idx", "x")
    n = f.groupBy("scene").agg(F.max("frame_idx").alias("last"))
    ids = F.when(F.col("scene") % 2 == 0, F.sequence(F.lit(0), F.col("last"), F.lit(3)))
    return rounded(frame_map(f, n.select("scene", ids.alias("frame_index_map")), ["scene"]).select("scene", "frame_idx", F.col("mapped_idx").cast("int").alias("mapped_idx"), "x"))


register(
    "j1_frame_index_map", mapped_frames,
    f"WITH {FRAMES} SELECT scene, frame_idx, CAST(CASE WHEN scene % 2 = 0 THEN frame_idx // 3 ELSE frame_idx END AS INTEGER) AS mapped_idx, round(x, 6) AS x FROM fr WHERE scene % 2 <> 0 OR frame_idx % 3 = 0",
)


def se3_roundtrips(spark, d):
    """Identities that must hold for every pose, the error of each, rounded, and what the steps in between are."""
    p = poses(spark, d)
    m = F.col("gt")
    unit = compose(invert_rigid(m), m)
    full = compose(invert_affine(m), m)
    p = p.withColumn("q", quaternion(m)).withColumn("code", pose_encoding(m, F.lit(500.0), F.lit(480.0), F.lit(640.0), F.lit(480.0)))
    back = rotation_of(F.col("q"), r(m, 0, 3), r(m, 1, 3), r(m, 2, 3))
    again, k = decode_pose_encoding(F.col("code"), F.lit(640.0), F.lit(480.0))
    worst = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    eye = F.array(*[F.lit(1.0 if i in (0, 5, 10) else 0.0) for i in range(12)])
    out = p.select("scene", worst(unit, eye).alias("rigid"), worst(full, eye).alias("full"), worst(back, m).alias("quaternion"), worst(again, m).alias("encoding"), F.abs(k.fx - 500.0).alias("focal"), finite_pose(m).alias("fine"), F.abs("q.z").alias("qz"), r(invert_rigid(m), 0, 3).alias("ix"), r(invert_affine(m), 1, 3).alias("iy"), F.element_at("code", 8).alias("fov"))
    return rounded(out.groupBy("scene").agg(*[F.max(c).alias(c) for c in ("rigid", "full", "quaternion", "encoding", "focal")], F.bool_and("fine").alias("fine"), *[F.sum(c).alias(c) for c in ("qz", "ix", "iy")], F.max("fov").alias("fov")), 4)


register(
    "f1_f5_f10_pose_round_trips", se3_roundtrips,
    f"WITH {FRAMES} SELECT scene, 0.0 AS rigid, 0.0 AS \"full\", 0.0 AS quaternion, 0.0 AS encoding, 0.0 AS focal, true AS fine, round(sum(abs(sin(yaw / 2))), 4) AS qz, "
    "round(sum(-(cos(yaw) * x + sin(yaw) * y)), 4) + 0.0 AS ix, round(sum(sin(yaw) * x - cos(yaw) * y), 4) + 0.0 AS iy, round(2 * atan(480 / 2.0 / 480), 4) AS fov FROM fr GROUP BY scene",
)


def first_camera(spark, d):
    """Poses relative to the scene's first, planar."""
    p = poses(spark, d)
    w = Window.partitionBy("scene").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    rel = compose(invert_rigid(F.first("gt").over(w)), F.col("gt"))
    return rounded(p.select("scene", "frame_idx", rel.alias("m")).select("scene", "frame_idx", r(F.col("m"), 0, 3).alias("x"), r(F.col("m"), 1, 3).alias("y")), 5)


register(
    "w11_first_camera_frame", first_camera,
    f"WITH {FRAMES}, f AS (SELECT *, first_value(yaw) OVER w AS yaw0, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0 FROM fr WINDOW w AS (PARTITION BY scene ORDER BY frame_idx)) "
    "SELECT scene, frame_idx, round(cos(yaw0) * (x - x0) + sin(yaw0) * (y - y0), 5) + 0.0 AS x, round(-sin(yaw0) * (x - x0) + cos(yaw0) * (y - y0), 5) + 0.0 AS y FROM f",
)


def slerps(spark, d):
    """half way between neighbouring yaws, as a yaw."""
    s = consecutive(frames(spark, d), ["scene"], "frame_idx", ["yaw"])
    quat = lambda yaw: F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.sin(yaw / 2).alias("z"), F.cos(yaw / 2).alias("w"))
    q = s.select("scene", "frame_idx", slerp(quat(F.col("p_yaw")), quat(F.col("yaw")), F.lit(0.5)).alias("q"))
    return rounded(q.select("scene", "frame_idx", (2 * F.atan2("q.z", "q.w")).alias("half_yaw")))


register("f21_slerp_half_way", slerps, f"WITH {FRAMES}, s AS (SELECT *, lag(yaw) OVER (PARTITION BY scene ORDER BY frame_idx) AS b FROM fr) SELECT scene, frame_idx, round((yaw + b) / 2, 6) + 0.0 AS half_yaw FROM s WHERE b IS NOT NULL")


def keyframes(spark, d):
    """Automatic interval over 24 frames, keyframes after 8."""
    f = frames(spark, d).select("scene", "frame_idx")
    n = F.count(F.lit(1)).over(Window.partitionBy("scene"))
    f = f.withColumn("interval", fr.auto_interval(n, 24))
    f = f.withColumn("is_key", fr.keyframe(F.col("frame_idx"), 8, F.col("interval")))
    return f.withColumn("kind", F.when(F.col("frame_idx") < 8, "scale").otherwise("stream"))


register(
    "w7_w8_w14_keyframes", keyframes,
    f"WITH {FRAMES}, f AS (SELECT scene, frame_idx, CAST(CASE WHEN count(*) OVER (PARTITION BY scene) <= 24 THEN 1 ELSE ceil(count(*) OVER (PARTITION BY scene) / 24.0) END AS INTEGER) AS interval FROM fr) "
    "SELECT scene, frame_idx, interval, frame_idx < 8 OR (frame_idx - 8) % interval = 0 AS is_key, CASE WHEN frame_idx < 8 THEN 'scale' ELSE 'stream' END AS kind FROM f",
)


def smoothed(spark, d):
    f = fr.moving_average(frames(spark, d).select("scene", "frame_idx", "x"), ["scene"], "frame_idx", "x", 3, "mean3")
    f = fr.moving_average(f, ["scene"], "frame_idx", "x", 30, "mean30")
    return rounded(f.select("scene", "frame_idx", "mean3", "mean30"), 8)


register(
    "w5_a36_moving_averages", smoothed,
    f"WITH {FRAMES} SELECT scene, frame_idx, round(avg(x) OVER (PARTITION BY scene ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 8) AS mean3, "
    "round(avg(x) OVER (PARTITION BY scene ORDER BY frame_idx ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING), 8) AS mean30 FROM fr",
)


def attention_span(spark, d):
    """How many frames a frame sees with 4 pinned and a window of 6, and its block limit."""
    f = frames(spark, d).select("scene", "frame_idx")
    seen = fr.visible_frames(f, ["scene"], "frame_idx", 4, 6).groupBy("scene", "frame").agg(F.count(F.lit(1)).alias("n_seen"), F.min("seen").alias("first_seen"))
    return seen.withColumn("block_end", fr.block_causal_limit(F.col("frame"), 8).cast("int"))


register(
    "w6_w13_visible_frames", attention_span,
    f"WITH {FRAMES} SELECT a.scene, a.frame_idx AS frame, count(*) AS n_seen, min(b.frame_idx) AS first_seen, CAST((a.frame_idx // 8 + 1) * 8 AS INTEGER) AS block_end FROM fr a JOIN fr b ON a.scene = b.scene "
    "AND b.frame_idx <= a.frame_idx AND (b.frame_idx > a.frame_idx - 6 OR b.frame_idx < 4) GROUP BY a.scene, a.frame_idx",
)


def recent(spark, d):
    """History of 5 frames."""
    f = frames(spark, d).select("scene", "frame_idx")
    low, high = fr.history(F.col("frame_idx"), 5)
    return f.select("scene", "frame_idx", low.cast("int").alias("from_idx"), high.alias("to_idx"))


register("p18_history_range", recent, f"WITH {FRAMES} SELECT scene, frame_idx, greatest(frame_idx - 5, 0) AS from_idx, frame_idx AS to_idx FROM fr")


def strided(spark, d):
    return fr.sample_stride(frames(spark, d).select("scene", "frame_idx", "event_id"), "frame_idx", 2, 60, 3)


register("p11_s23_stride_sampling", strided, f"WITH {FRAMES} SELECT scene, frame_idx, event_id FROM fr WHERE frame_idx >= 2 AND frame_idx < 60 AND (frame_idx - 2) % 3 = 0")


def spaced(spark, d):
    return fr.sample_count(frames(spark, d).select("scene", "frame_idx", "event_id"), ["scene"], "frame_idx", 7)


register(
    "p11_w2_linspace_sampling", spaced,
    f"WITH {FRAMES}, n AS (SELECT scene, max(frame_idx) AS last FROM fr GROUP BY scene), s AS (SELECT scene, CAST(k AS INTEGER) AS sample_pos, CAST(floor(k * last / 6.0) AS INTEGER) AS frame_idx FROM n, range(7) t(k)) "
    "SELECT scene, frame_idx, sample_pos, event_id FROM s JOIN fr USING (scene, frame_idx)",
)


def windows(spark, d):
    n = frames(spark, d).groupBy("scene").agg(F.count(F.lit(1)).cast("int").alias("n"))
    out = fr.count_windows(n, ["scene"], "n", 2, 8, 3, 4)
    return out.select("scene", F.col("window_id").cast("int").alias("window_id"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


_WIN = f"""WITH RECURSIVE {FRAMES}, n AS (SELECT scene, CAST(count(*) AS INTEGER) AS n FROM fr GROUP BY scene),
  c AS (SELECT scene, n, 0 AS window_id, 0 AS start, least(20, n) AS "end" FROM n UNION ALL SELECT scene, n, window_id + 1, start + 16, least(start + 36, n) FROM c WHERE "end" < n)"""
register("t7_count_windows", windows, _WIN + ' SELECT scene, window_id, start, "end" FROM c')


def stitched(spark, d):
    """Windows of the frames, their anchors, and the stitched rows."""
    f = frames(spark, d).select("scene", "frame_idx").withColumn("is_key", fr.keyframe(F.col("frame_idx"), 2, 3))
    w = windows(spark, d)
    rows = f.join(w, "scene").where("frame_idx >= start and frame_idx < end")
    kept = fr.stitch(rows, ["scene"], 4).groupBy("scene").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("frame_idx").alias("sum_idx"))
    anchors = fr.window_anchor(rows, ["scene"]).groupBy("scene").agg(F.sum("anchor").alias("sum_anchor"), F.sum("n_keys").alias("n_keys"))
    return kept.join(anchors, "scene", "left")


register(
    "u2_j16_stitched_windows", stitched,
    _WIN + """, r AS (SELECT f.scene, window_id, f.frame_idx, f.frame_idx < 2 OR (f.frame_idx - 2) % 3 = 0 AS is_key, "end", max(window_id) OVER (PARTITION BY f.scene) AS last
    FROM fr f JOIN c ON f.scene = c.scene AND f.frame_idx >= start AND f.frame_idx < "end"),
  k AS (SELECT scene, count(*) AS n_rows, CAST(sum(frame_idx) AS BIGINT) AS sum_idx FROM r WHERE window_id = last OR frame_idx < "end" - 4 GROUP BY scene),
  a AS (SELECT x.scene, x.window_id, coalesce(max(CASE WHEN x.is_key THEN x.frame_idx END), min(x.frame_idx)) AS anchor, count(*) FILTER (x.is_key) AS n_keys
    FROM r x JOIN r y ON x.scene = y.scene AND x.frame_idx = y.frame_idx AND y.window_id = x.window_id + 1 GROUP BY 1, 2)
  SELECT k.scene, n_rows, sum_idx, CAST(sum(anchor) AS BIGINT) AS sum_anchor, CAST(sum(n_keys) AS BIGINT) AS n_keys FROM k LEFT JOIN a ON k.scene = a.scene GROUP BY k.scene, n_rows, sum_idx""",
)


def length(spark, d):
    return rounded(path_length(frames(spark, d).select("scene", "frame_idx", "x", "y"), ["scene"], "frame_idx", 0.5), 5)


register("a34_path_length", length, f"WITH {FRAMES}, s AS (SELECT scene, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS s FROM fr WINDOW w AS (PARTITION BY scene ORDER BY frame_idx)) SELECT scene, round(coalesce(sum(s), 0) * 0.5, 5) AS length_m FROM s GROUP BY scene")


def state_sizes(spark, d):
    return live_state(frames(spark, d).select("scene", "frame_idx"), ["scene"], ["frame_idx"], 8, 20).select("scene", "frame_idx", "n_pinned", "n_window", "n_evicted", "total")


register(
    "t2_t3_t10_bounded_state", state_sizes,
    f"WITH {FRAMES} SELECT scene, frame_idx, CAST(least(frame_idx + 1, 8) AS INTEGER) AS n_pinned, CAST(least(greatest(frame_idx + 1 - 8, 0), 20) AS INTEGER) AS n_window, "
    "CAST(greatest(frame_idx + 1 - 28, 0) AS INTEGER) AS n_evicted, frame_idx + 1 AS total FROM fr",
)


def speculative(spark, d):
    """The batch replay of the stream; the stream itself is compared with it in the tests."""
    f = frames(spark, d).select(F.col("scene").cast("string").alias("seq"), F.col("frame_idx").cast("long").alias("frame_idx"), (F.abs(F.col("x")) / 100).alias("flow"))
    return bounded_replay(f, 4, 10, 1.0, 6)


register(
    "t1_t4_t5_keyframe_stream_replay", speculative,
    f"""WITH RECURSIVE {FRAMES}, f AS (SELECT scene, frame_idx, abs(x) / 100 AS flow, count(*) OVER (PARTITION BY scene) AS n FROM fr), k AS (
  SELECT scene, frame_idx, n, 0 AS gap, CAST(0 AS DOUBLE) AS moved, 1 AS kept, true AS is_key FROM f WHERE frame_idx = 0
  UNION ALL
  SELECT scene, frame_idx, n, CASE WHEN is_key THEN 0 ELSE gap END, CASE WHEN is_key THEN 0 ELSE moved END, kept + CASE WHEN is_key THEN 1 ELSE 0 END, is_key
  FROM (SELECT *, frame_idx <= 4 OR moved > 1 OR gap >= 6 AS is_key
    FROM (SELECT f.scene, f.frame_idx, f.n, k.gap + 1 AS gap, k.moved + f.flow AS moved, k.kept FROM k JOIN f ON f.scene = k.scene AND f.frame_idx = k.frame_idx + 1))
) SELECT CAST(scene AS VARCHAR) AS seq, CAST(frame_idx AS BIGINT) AS frame_idx, CASE WHEN frame_idx < 4 THEN 'first' ELSE 'stream' END AS phase, is_key, CAST(least(n, 4) AS INTEGER) AS n_pinned,
  CASE WHEN frame_idx < 4 THEN 0 ELSE CAST(least(kept - 4, 10) AS INTEGER) END AS n_window, CASE WHEN frame_idx < 4 THEN 0 ELSE CAST(greatest(kept - 14, 0) AS BIGINT) END AS n_evicted, CAST(frame_idx + 1 AS BIGINT) AS total FROM k""",
)


def drive(spark, d):
    """The pose after every command, rounded as it is stored."""
    e = frames(spark, d).select("scene", "frame_idx", (F.col("event_id") % 5 * 0.25).alias("forward"), (F.col("event_id") % 9 * 10.0).alias("turn"))
    return odometry(e, ["scene"], "frame_idx")


register(
    "t6_f24_odometry", drive,
    f"WITH {FRAMES}, s AS (SELECT scene, frame_idx, event_id % 5 * 0.25 AS f, sum(event_id % 9 * 10.0) OVER (PARTITION BY scene ORDER BY frame_idx) % 360 AS yaw FROM fr) "
    "SELECT scene, frame_idx, round(sum(f * cos(radians(CAST(yaw AS DOUBLE)))) OVER w, 4) + 0.0 AS x, round(sum(f * sin(radians(CAST(yaw AS DOUBLE)))) OVER w, 4) + 0.0 AS y, round(CAST(yaw AS DOUBLE), 2) AS yaw "
    "FROM s WINDOW w AS (PARTITION BY scene ORDER BY frame_idx)",
)


def navigation(spark, d):
    e = events(spark, d)
    said = F.when(F.col("event_type") == "purchase", "goal").when(F.col("event_type") == "click", "start").when(F.col("k") < 20, "stop")
    return navigation_state(e.select("user_id", "event_id", F.struct("t_us", "event_id").alias("at"), said.alias("event")), ["user_id"], "at").groupBy("user_id", "state").agg(F.count(F.lit(1)).alias("n"))


register(
    "t6_navigation_states", navigation,
    f"WITH {EVENTS}, s AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'goal' WHEN event_type = 'click' THEN 'start' WHEN k < 20 THEN 'stop' END AS e FROM ev), "
    "l AS (SELECT user_id, last_value(e IGNORE NULLS) OVER w AS last, max(CASE WHEN e = 'goal' THEN 1 END) OVER w AS goal FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING)) "
    "SELECT user_id, CASE WHEN last = 'goal' THEN 'GOAL_SELECTED' WHEN last = 'start' AND goal = 1 THEN 'NAVIGATING' WHEN last = 'stop' THEN 'STOP' ELSE 'IDLE' END AS state, count(*) AS n FROM l GROUP BY 1, 2",
)


def _scene_metrics(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    wide = l.groupBy(F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("scene")).agg(
        F.avg("l_discount").alias("ate"), F.avg("l_tax").alias("rpe_rot"), F.max("l_quantity").alias("f1"), F.count(F.lit(1)).alias("num_pairs")
    )
    return long_metrics(wide.withColumns({"ate": F.round("ate", 6), "rpe_rot": F.round("rpe_rot", 6)}), ["method", "scene"], ["ate", "rpe_rot", "f1", "num_pairs"])


_METRICS = """m AS (SELECT l_returnflag AS method, l_suppkey AS scene, round(avg(l_discount), 6) AS ate, round(avg(l_tax), 6) AS rpe_rot, max(l_quantity) AS f1, CAST(count(*) AS DOUBLE) AS num_pairs FROM lineitem GROUP BY 1, 2),
  lm AS (SELECT method, scene, 'ate' AS metric, ate AS value FROM m UNION ALL SELECT method, scene, 'rpe_rot', rpe_rot FROM m UNION ALL SELECT method, scene, 'f1', f1 FROM m UNION ALL SELECT method, scene, 'num_pairs', num_pairs FROM m)"""


def ranks(spark, d):
    return rank_metrics(_scene_metrics(spark, d), ["scene"], ["f1"])


register("w1_o5_metric_ranks", ranks, f"WITH {_METRICS}, k AS (SELECT *, CAST(rank() OVER (PARTITION BY scene, metric ORDER BY CASE WHEN metric = 'f1' THEN -value ELSE value END) AS INTEGER) AS rank FROM lm WHERE metric <> 'num_pairs') SELECT method, scene, metric, value, rank, rank <= 3 AS marked FROM k")


def rollup(spark, d):
    return rounded(mean_of_documents(_scene_metrics(spark, d), ["method"]), 5)


register(
    "a18_l3_mean_of_scenes", rollup,
    f"WITH {_METRICS}, s AS (SELECT method, count(DISTINCT scene) AS num_scenes FROM lm GROUP BY 1), a AS (SELECT method, metric, round(avg(value), 5) AS value, count(value) AS present FROM lm GROUP BY 1, 2) "
    "SELECT method, metric, value, present, num_scenes, count(*) OVER (PARTITION BY method) AS n_metrics FROM a JOIN s USING (method)",
)


def octiles(spark, d):
    """F20 between the cells of neighbouring frames."""
    s = consecutive(frames(spark, d).select("scene", "frame_idx", F.floor("x").alias("cx"), F.floor("y").alias("cy")), ["scene"], "frame_idx", ["cx", "cy"])
    return rounded(s.groupBy("scene").agg(F.sum(octile(F.col("p_cx"), F.col("p_cy"), F.col("cx"), F.col("cy"))).alias("octile")), 4)


register(
    "f20_octile_distance", octiles,
    f"WITH {FRAMES}, s AS (SELECT scene, abs(floor(x) - lag(floor(x)) OVER w) AS dx, abs(floor(y) - lag(floor(y)) OVER w) AS dy FROM fr WINDOW w AS (PARTITION BY scene ORDER BY frame_idx)) "
    "SELECT scene, round(sum(dx + dy + (sqrt(2) - 2) * least(dx, dy)), 4) AS octile FROM s WHERE dx IS NOT NULL GROUP BY scene",
)

