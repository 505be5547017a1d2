"""Flow that camera motion induces: means, distance matrices, keyframes and windows by flow."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.functions.geometry import compose, invert_affine, transform_point, unproject
from trajecta.operators.folds import sorted_fold

#: tasks over which a matrix of distances is dealt
MOST_TASKS = 1000


def _moved(m: Column, fx: Column, fy: Column, cx: Column, cy: Column, depth: Column) -> tuple[Column, Column]:
    """Depth of a pixel u, v under the relative pose m, and how far it moves on the image."""
    c = F.col
    x, y, z = transform_point(m, *unproject(c("u"), c("v"), depth, fx, fy, cx, cy))
    ahead = F.greatest(z, F.lit(1e-6))
    return z, F.hypot(fx * x / ahead + cx - c("u"), fy * y / ahead + cy - c("v"))


def mean_flow(pixels: DataFrame, by: list[str], stride: int = 8, intrinsics: tuple[str, ...] = ("fx", "fy", "cx", "cy")) -> DataFrame:
    """Mean length of the flow over every stride-th pixel u, v of positive depth; 0 where none is valid.

    Pixels have the poses `cur` and `ref`, from which to which they flow, or `rel`, their relative
    pose, which then is composed once a frame and not once a pixel.
    """
    fx, fy, cx, cy = map(F.col, intrinsics)
    kept = pixels.where((F.col("u") % stride == 0) & (F.col("v") % stride == 0))
    rel = F.col("rel") if "rel" in pixels.columns else compose(invert_affine(F.col("ref")), F.col("cur"))
    z, flow = _moved(rel, fx, fy, cx, cy, F.col("depth"))
    out = kept.select(*by, "depth", z.alias("_z"), flow.alias("_flow"))
    fine = (F.col("depth") > 1e-6) & (F.col("_z") > 1e-6)
    return out.groupBy(*by).agg(F.coalesce(F.avg(F.when(fine, F.col("_flow"))), F.lit(0.0)).alias("flow"), F.count_if(fine).alias("n_valid"))


def _poses_of(rows: pd.DataFrame) -> np.ndarray:
    """Poses as (n, 3, 4); a missing one is nan."""
    return np.array([np.full(12, np.nan) if m is None else np.asarray(m, dtype=np.float64) for m in rows["pose"]]).reshape(-1, 3, 4)


def _inverses(poses: np.ndarray) -> np.ndarray:
    """Full inverses by the adjugate; nan where R is singular."""
    a, b, c = poses[:, 0, :3], poses[:, 1, :3], poses[:, 2, :3]
    adjugate = np.stack([np.cross(b, c), np.cross(c, a), np.cross(a, b)], axis=2)
    det = (a * adjugate[:, :, 0]).sum(axis=1)
    turn = adjugate / np.where(det == 0, np.nan, det)[:, None, None]
    return np.concatenate([turn, -turn @ poses[:, :, 3:]], axis=2)


def _flow_sums(rows: pd.DataFrame, poses: np.ndarray, into: np.ndarray, camera: tuple[float, ...], most: float, min_depth: float, cells: int = 1 << 17) -> np.ndarray:
    """(3, rows, targets): pixels of each row seen from each target, those of them that count, and the sum of their flows; about `cells` pixels and targets at a time."""
    fx, fy, cx, cy = camera
    out = np.zeros((3, len(rows), len(into)))
    sizes = np.array([0 if u is None else len(u) for u in rows["u"]], dtype=np.int64)
    if not sizes.sum():
        return out
    u, v, depth = (np.concatenate([np.asarray(x, dtype=np.float64) for x in rows[c] if x is not None]) for c in ("u", "v", "depth"))
    frame = np.repeat(np.arange(len(rows)), sizes)
    own = poses[frame]
    world = (own[:, :, :3] @ np.stack([(u - cx) * depth / fx, (v - cy) * depth / fy, depth], axis=1)[:, :, None])[:, :, 0] + own[:, :, 3]
    known = np.isfinite(into).all(axis=(1, 2))
    seen = np.isfinite(poses).all(axis=(1, 2))
    step = max(1, cells // len(into))
    for at in range(0, len(frame), step):
        part = slice(at, at + step)
        w, held = world[part], frame[part]
        x, y, z = (w @ into[:, k, :3].T + into[:, k, 3] for k in range(3))
        ahead = np.maximum(z, 1e-6)
        flow = np.hypot(fx * x / ahead + cx - u[part, None], fy * y / ahead + cy - v[part, None])
        both = seen[held][:, None] & known
        fine = (z > min_depth) & (depth[part, None] > min_depth) & both
        starts = np.flatnonzero(np.diff(held, prepend=-1))
        for k, values in enumerate((both, fine, np.where(fine, np.fmin(flow, most), 0.0))):
            out[k, held[starts]] += np.add.reduceat(values.astype(np.float64), starts, axis=0)
    return out


def flow_distance_matrix(
    frames: DataFrame, pixels: DataFrame, by: list[str], fx: float, fy: float, cx: float, cy: float, most: float = 100.0, min_depth: float = 0.2, min_share: float = 0.7, block: int = 256
) -> DataFrame:
    """(by, i, j, distance) of all ordered pairs of frames(by, frame_idx, pose): mean flow of both directions.

    A pixel's flow is at most `most`; it counts where its depth is over min_depth in both
    cameras; a pair with under min_share of such pixels is infinitely far. A pose that is missing
    or not finite takes no part, and nothing is seen from a singular one; pairs without any view
    have no distance, and pairs without pixels are left out.

    Frames take their pixels(by, frame_idx, u, v, depth) with them in one row and are dealt to
    blocks of about `block` frames; a task takes two blocks at a time and has both directions of
    all their pairs, so pixels are shuffled once a block and pairs not at all.
    """
    held = pixels.where("u is not null and v is not null and depth is not null").groupBy(*by, "frame_idx").agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("u", "v", "depth")])).alias("_p"))
    held = held.select(*by, "frame_idx", *[F.col(f"_p.{c}").alias(c) for c in ("u", "v", "depth")])
    counts = frames.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    dealt = frames.select(*by, "frame_idx", "pose").join(held, [*by, "frame_idx"], "left").join(counts, by)
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("frame_idx"), F.col("_blocks")).cast("int"))
    columns = [*by, "frame_idx", "pose", "u", "v", "depth"]
    first = dealt.select(*columns, F.col("_own").alias("_a"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_b"))
    # new names for the columns, as both sides stem from one table
    second = dealt.select(*[F.col(c).alias(c) for c in columns], F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_a"), F.col("_own").alias("_b"))

    def between(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[*by, "i", "j", "distance"])
        a, b = (x.sort_values("frame_idx", ignore_index=True) for x in (a, b))
        pa, pb = _poses_of(a), _poses_of(b)
        with np.errstate(all="ignore"):
            there = _flow_sums(a, pa, _inverses(pb), (fx, fy, cx, cy), most, min_depth)
            back = there if key[-1] == key[-2] else _flow_sums(b, pb, _inverses(pa), (fx, fy, cx, cy), most, min_depth)
            names, starts = zip(*[np.unique(x["frame_idx"].to_numpy(), return_index=True) for x in (a, b)], strict=True)
            sums = there + back.transpose(0, 2, 1)
            seen, fine, flow = np.add.reduceat(np.add.reduceat(sums, starts[0], axis=1), starts[1], axis=2)
            distance = np.where(fine / seen < min_share, np.inf, flow / fine)
        sampled = [np.add.reduceat(np.array([u is not None for u in x["u"]], dtype=np.int64), s) > 0 for x, s in zip((a, b), starts, strict=True)]
        i, j = np.nonzero(sampled[0][:, None] | sampled[1])
        i, j, distance = names[0][i], names[1][j], distance[i, j]
        if key[-1] != key[-2]:
            i, j, distance = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([distance, distance])
        return pd.DataFrame(dict(zip(by, key, strict=False)) | {"i": i, "j": j, "distance": distance})

    # little data and much work: a task a few blocks, whatever their bytes are
    met = counts.agg(F.sum(F.col("_blocks") * (F.col("_blocks") + 1) / 2)).first()[0] or 1
    keys = [*by, "_a", "_b"]
    first, second = (x.repartition(int(min(met, MOST_TASKS)), *keys) for x in (first, second))
    kinds = {c: frames.schema[c].dataType.simpleString() for c in (*by, "frame_idx")}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], f"i {kinds['frame_idx']}, j {kinds['frame_idx']}, distance double"])
    return first.groupBy(*keys).cogroup(second.groupBy(*keys)).applyInPandas(between, schema)


def flow_between(cur: np.ndarray, ref: np.ndarray, u: np.ndarray, v: np.ndarray, depth: np.ndarray, camera: tuple[float, float, float, float]) -> float:
    """A20 for one pair of 3 by 4 poses inside a fold."""
    fx, fy, cx, cy = camera
    own = np.stack([(u - cx) / fx * depth, (v - cy) / fy * depth, depth])
    world = cur[:, :3] @ own + cur[:, 3:]
    x, y, z = np.linalg.solve(ref[:, :3], world - ref[:, 3:])
    ahead = np.maximum(z, 1e-6)
    fine = (depth > 1e-6) & (z > 1e-6)
    flow = np.hypot(fx * x / ahead + cx - u, fy * y / ahead + cy - v)
    return float(flow[fine].mean()) if fine.any() else 0.0


@dataclass
class FlowWindow:
    """One window of a sequence: its first frame, the frames so far, and the last keyframe's place and pose."""

    start: int = 0
    at: int = 0
    keys: int = 0
    last_key: int = 0
    pose: np.ndarray | None = None

    def take(self, row, scale_frames: int, threshold: float, max_gap: int, camera: tuple) -> tuple[int, float]:
        """The frame's kind (0 scale, 1 keyframe, 2 other) and its flow since the last keyframe."""
        pose, place = np.asarray(row.pose, dtype=np.float64).reshape(3, 4), self.at
        self.at += 1
        if place < scale_frames:
            self.pose, self.last_key = pose, place
            return 0, 0.0
        flow = flow_between(pose, self.pose, *(np.asarray(x, dtype=np.float64) for x in (row.u, row.v, row.depth)), camera)
        if self.keys and flow <= threshold and place - self.last_key < max_gap:
            return 2, flow
        self.pose, self.last_key, self.keys = pose, place, self.keys + 1
        return 1, flow


def flow_keyframes(rows: DataFrame, by: list[str], camera: tuple[float, float, float, float], scale_frames: int, threshold: float, max_gap: int) -> DataFrame:
    """(by, frame_idx, kind, flow) of rows(by, frame_idx, pose, u, v, depth), the last three arrays of sample pixels.

    The first scale_frames are kept; the next is a keyframe, and so is every frame whose flow
    against the last keyframe's pose is over the threshold, or that lies max_gap frames after it.
    """

    def step(window: FlowWindow, row) -> list[tuple]:
        kind, flow = window.take(row, scale_frames, threshold, max_gap, camera)
        return [(int(row.frame_idx), kind, flow)]

    return sorted_fold(rows.select(*by, "frame_idx", "pose", "u", "v", "depth"), by, ["frame_idx"], FlowWindow, step, "frame_idx int, kind int, flow double")


@dataclass
class FlowWindows:
    """Windows of a sequence that end by their number of keyframes, and the last frames, for the next window to go back to."""

    window: FlowWindow = field(default_factory=FlowWindow)
    number: int = 0
    n: int = 0
    recent: list = field(default_factory=list)


def flow_windows(
    rows: DataFrame, by: list[str], camera: tuple[float, float, float, float], window_size: int, scale_frames: int, overlap: int, threshold: float, max_gap: int
) -> DataFrame:
    """(by, window_id, frame_idx, kind, flow); a window ends with window_size - scale_frames keyframes.

    The next one starts `overlap` frames before the end, but never before the last one's start
    plus scale_frames, and its state is fresh; a frame of the overlap has a row a window. The
    state keeps the last `overlap` frames.
    """
    target = window_size - scale_frames

    def step(s: FlowWindows, row) -> list[tuple]:
        s.recent.append(row)
        s.n += 1
        first, out = s.n - len(s.recent), []
        while (cursor := s.window.start + s.window.at) < s.n:
            if s.window.keys >= target and s.window.at > scale_frames:
                s.window, s.number = FlowWindow(max(cursor - overlap, s.window.start + scale_frames)), s.number + 1
                continue
            own = s.recent[cursor - first]
            out.append((s.number, int(own.frame_idx), *s.window.take(own, scale_frames, threshold, max_gap, camera)))
        del s.recent[: max(0, len(s.recent) - max(overlap, 1))]
        return out

    schema = "window_id int, frame_idx int, kind int, flow double"
    return sorted_fold(rows.select(*by, "frame_idx", "pose", "u", "v", "depth"), by, ["frame_idx"], FlowWindows, step, schema)
