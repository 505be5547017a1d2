"""Similarity alignment from sums, iterative registration, absolute and relative errors."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.geometry import compose_parts, determinant, finite_pose, inverse_turn, r, relative_parts, rotation_error, transform_point
from trajecta.operators.joins import within_radius
from trajecta.operators.metrics import rms, umeyama_statistics


def solve(n: float, sum_s: np.ndarray, sum_t: np.ndarray, sum_ss: float, cross: np.ndarray, with_scale: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Least-squares scale, rotation, translation of t ~ s R x + shift from sums; no reflection."""
    ms, mt = sum_s / n, sum_t / n
    cov = cross / n - np.outer(mt, ms)
    var = sum_ss / n - ms @ ms
    u, d, vt = np.linalg.svd(cov)
    sign = np.ones(3)
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        sign[2] = -1
    rot = u @ np.diag(sign) @ vt
    scale = float((d * sign).sum() / var) if with_scale and var > 0 else 1.0
    return scale, rot, mt - scale * rot @ ms


def align(pairs: DataFrame, by: list[str], with_scale: bool = True) -> DataFrame:
    """One row a group: scale, and the pose m of x -> scale * R x + t with R and t in it (R unscaled).

    The sums are a distributed aggregate; only one row a group goes through the 3 by 3 SVD.
    """
    stats = umeyama_statistics(pairs, by)
    s, t = ["sx", "sy", "sz"], ["tx", "ty", "tz"]

    def run(batches):
        for b in batches:
            out = b[by].copy()
            scales, poses = [], []
            for row in b.to_dict("records"):
                cross = np.array([[row[f"sum_{x}_{y}"] for y in s] for x in t])
                scale, rot, shift = solve(row["n"], np.array([row[f"sum_{c}"] for c in s]), np.array([row[f"sum_{c}"] for c in t]), row["sum_ss"], cross, with_scale)
                scales.append(scale)
                poses.append(np.concatenate([rot, shift[:, None]], axis=1).ravel().tolist())
            out["scale"], out["align"] = scales, poses
            yield out

    kinds = "".join(f"`{c}` {stats.schema[c].dataType.simpleString()}, " for c in by)
    return stats.mapInPandas(run, f"{kinds}scale double, align array<double>")


def trajectory_errors(poses: DataFrame, by: list[str], aligned: bool = True) -> DataFrame:
    """A1 and A2 over rows frame_idx, gt, pred (poses): ate, rpe_trans, rpe_rot.

    Pairs with a missing or non-finite pose go first (P1). With `aligned`, pred is moved by the
    best similarity of its positions. The relative error is of frames that follow each other.
    """
    fine = poses.where(finite_pose(F.col("gt")) & finite_pose(F.col("pred")))
    if aligned:
        spots = fine.select(*by, *[r(F.col(p), i, 3).alias(f"{q}{c}") for p, q in (("pred", "s"), ("gt", "t")) for i, c in enumerate("xyz")])
        fine = fine.join(align(spots, by).hint("merge"), by)  # frames of many scenes are small enough in a shuffle to be broadcast, and must not be
        fine = fine.withColumn("_scaled", F.array(*[F.col("pred")[i] * F.col("scale") if i % 4 == 3 else F.col("pred")[i] for i in range(12)]))
        fine = fine.withColumn("pred", compose_parts(F.col("align"), F.col("_scaled")))
    d = F.sqrt(sum(((r(F.col("gt"), i, 3) - r(F.col("pred"), i, 3)) ** 2 for i in range(3)), F.lit(0.0)))
    before = lambda c: F.lag(c).over(Window.partitionBy(*by).orderBy("frame_idx"))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], before("frame_idx").isNotNull())
    steps = fine.select(*by, "gt", "pred", d.alias("d"), known.alias("_known"), before("gt").alias("p_gt"), before("pred").alias("p_pred"))
    # a product of plain columns a projection: small enough to be compiled, and each is computed once
    for name, a, b in (("g", "p_gt", "gt"), ("p", "p_pred", "pred"), ("e", "g", "p")):
        steps = steps.withColumn("_det", F.nullif(determinant(F.col(a)), F.lit(0.0))).withColumn("_turn", inverse_turn(F.col(a), F.col("_det")))
        steps = steps.withColumn(name, relative_parts(F.col("_turn"), F.col(a), F.col(b)))
    length = F.sqrt(r(F.col("e"), 0, 3) ** 2 + r(F.col("e"), 1, 3) ** 2 + r(F.col("e"), 2, 3) ** 2)
    angle = rotation_error(F.col("e"), F.array(*[F.lit(1.0 if i in (0, 5, 10) else 0.0) for i in range(12)]))
    steps = steps.select(*by, "d", F.when(F.col("_known"), length).alias("l"), F.when(F.col("_known"), angle).alias("a"))
    return steps.groupBy(*by).agg(rms(F.col("d")).alias("ate"), F.count(F.lit(1)).alias("n_frames"), rms(F.col("l")).alias("rpe_trans"), rms(F.col("a")).alias("rpe_rot"))


def icp(source: DataFrame, target: DataFrame, radius: float, rounds: int = 20, tolerance: float = 1e-6) -> tuple[list[float], float, float]:
    """A10: rigid registration of one pair of clouds (point_id, x, y, z): (pose, fitness, rmse).

    A round matches points by the radius join, sums the matches, and solves a 3 by 3 problem
    on the driver: one row comes back. The source is transformed from the input each time by
    the accumulated pose, so the plan does not grow.
    """
    total = source.count()
    pose, last = np.eye(4)[:3], (0.0, 0.0)
    src, tgt = source.withColumn("g", F.lit(0)), target.withColumn("g", F.lit(0))
    for _ in range(rounds):
        m = F.array(*[F.lit(float(v)) for v in pose.ravel()])
        moved = src.withColumns(dict(zip("xyz", transform_point(m, F.col("x"), F.col("y"), F.col("z")), strict=True)))
        near = within_radius(moved.select("g", "point_id", "x", "y", "z"), tgt, ["g"], radius)
        near = near.select("g", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), "tx", "ty", "tz", "distance")
        row = umeyama_statistics(near, ["g"]).join(near.groupBy("g").agg(F.sum(F.col("distance") ** 2).alias("dd")), "g").first()
        if row is None or row["n"] < 3:
            break
        s, t = ["sx", "sy", "sz"], ["tx", "ty", "tz"]
        cross = np.array([[row[f"sum_{a}_{b}"] for b in s] for a in t])
        _, rot, shift = solve(row["n"], np.array([row[f"sum_{c}"] for c in s]), np.array([row[f"sum_{c}"] for c in t]), row["sum_ss"], cross, False)
        now = (row["n"] / total, float(np.sqrt(row["dd"] / row["n"])))
        pose = np.concatenate([rot @ pose[:, :3], (rot @ pose[:, 3] + shift)[:, None]], axis=1)
        if abs(now[0] - last[0]) < tolerance and abs(now[1] - last[1]) < tolerance:
            last = now
            break
        last = now
    return pose.ravel().tolist(), *last


def orthogonalize(df: DataFrame, column: str) -> DataFrame:
    """replace R of a pose by the nearest rotation."""

    def run(batches):
        for b in batches:
            out = []
            for v in b[column]:
                m = np.array(v, dtype=float).reshape(3, 4)
                u, _, vt = np.linalg.svd(m[:, :3])
                u[:, 2] *= np.sign(np.linalg.det(u @ vt))
                out.append(np.concatenate([u @ vt, m[:, 3:]], axis=1).ravel().tolist())
            b[column] = out
            yield b

    return df.mapInPandas(run, df.schema)
