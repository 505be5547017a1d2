"""Column functions of poses, rotations, cameras and grids (F1-F29); no Python UDF.

A pose is an array of 12 doubles, the rows of [R | t]; rotations R are used as given, so a
pose may carry a scale. Quaternions are structs (x, y, z, w).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x: float) -> Column:
    return F.lit(float(x))


def pose(*entries: Column | float) -> Column:
    return F.array(*[e if isinstance(e, Column) else lit(e) for e in entries])


def let(value: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body over a struct of values, each computed once however often body names it."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in value.items()])), body)[0]


def r(m: Column, i: int, j: int) -> Column:
    return m[4 * i + j]


def planar_pose(yaw: Column, tx: Column, ty: Column) -> Column:
    return pose(F.cos(yaw), -F.sin(yaw), 0, tx, F.sin(yaw), F.cos(yaw), 0, ty, 0, 0, 1, 0)


def compose(a: Column, b: Column) -> Column:
    """A after B: the product of two poses."""
    return let({"a": a, "b": b}, lambda s: compose_parts(s["a"], s["b"]))


def compose_parts(a: Column, b: Column) -> Column:
    cells = []
    for i in range(3):
        for j in range(4):
            cell = r(a, i, 0) * r(b, 0, j) + r(a, i, 1) * r(b, 1, j) + r(a, i, 2) * r(b, 2, j)
            cells.append(cell + r(a, i, 3) if j == 3 else cell)
    return pose(*cells)


def invert_rigid(m: Column) -> Column:
    """F2, closed form for an orthogonal R: [R^T | -R^T t]."""
    return let({"m": m}, lambda s: _invert_rigid(s["m"]))


def _invert_rigid(m: Column) -> Column:
    cells = []
    for i in range(3):
        cells += [r(m, j, i) for j in range(3)]
        cells.append(-(r(m, 0, i) * r(m, 0, 3) + r(m, 1, i) * r(m, 1, 3) + r(m, 2, i) * r(m, 2, 3)))
    return pose(*cells)


def determinant(m: Column) -> Column:
    return (
        r(m, 0, 0) * (r(m, 1, 1) * r(m, 2, 2) - r(m, 1, 2) * r(m, 2, 1))
        - r(m, 0, 1) * (r(m, 1, 0) * r(m, 2, 2) - r(m, 1, 2) * r(m, 2, 0))
        + r(m, 0, 2) * (r(m, 1, 0) * r(m, 2, 1) - r(m, 1, 1) * r(m, 2, 0))
    )


def invert_affine(m: Column) -> Column:
    """F2, full inverse by the adjugate; null where R is singular."""
    return let({"m": m}, lambda s: let({"m": s["m"], "det": F.nullif(determinant(s["m"]), lit(0))}, lambda t: _invert_affine(t["m"], t["det"])))


def _invert_affine(m: Column, det: Column) -> Column:
    inv = [[None] * 3 for _ in range(3)]
    for i in range(3):
        for j in range(3):
            a, b, c, d = (i + 1) % 3, (i + 2) % 3, (j + 1) % 3, (j + 2) % 3
            inv[j][i] = (r(m, a, c) * r(m, b, d) - r(m, a, d) * r(m, b, c)) / det
    cells = []
    for i in range(3):
        cells += inv[i]
        cells.append(-(inv[i][0] * r(m, 0, 3) + inv[i][1] * r(m, 1, 3) + inv[i][2] * r(m, 2, 3)))
    return F.when(det.isNotNull(), pose(*cells))


def inverse_turn(m: Column, det: Column) -> Column:
    """The inverse of R by the adjugate, as nine numbers; null where the determinant is."""
    at = lambda i, j: r(m, i % 3, j % 3)
    cells = [(at(j + 1, i + 1) * at(j + 2, i + 2) - at(j + 1, i + 2) * at(j + 2, i + 1)) / det for i in range(3) for j in range(3)]
    return F.when(det.isNotNull(), F.array(*cells))


def relative_parts(turn: Column, a: Column, b: Column) -> Column:
    """relative(a, b) from the inverse turn of a, all plain columns."""
    cells = []
    for i in range(3):
        for j in range(4):
            cells.append(sum((turn[3 * i + k] * (r(b, k, j) - r(a, k, 3) if j == 3 else r(b, k, j)) for k in range(1, 3)), turn[3 * i] * (r(b, 0, j) - r(a, 0, 3) if j == 3 else r(b, 0, j))))
    return pose(*cells)


def relative(a: Column, b: Column) -> Column:
    """D12, canonical: inverse(A) after B."""
    return compose(invert_affine(a), b)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite_pose(m: Column) -> Column:
    """Every entry of the pose is finite."""
    return m.isNotNull() & F.coalesce(F.forall(m, is_finite), F.lit(False))


def transform_point(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """F5 for a 3 by 4 transform; other columns stay with the row."""
    return tuple(r(m, i, 0) * x + r(m, i, 1) * y + r(m, i, 2) * z + r(m, i, 3) for i in range(3))


def homogeneous(m16: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """F5 for a full 4 by 4 transform with the division by w."""
    rows = [m16[4 * i] * x + m16[4 * i + 1] * y + m16[4 * i + 2] * z + m16[4 * i + 3] for i in range(4)]
    return tuple(rows[i] / rows[3] for i in range(3))


def quaternion(m: Column) -> Column:
    """Rotation to (x, y, z, w), taking the largest of trace and diagonal first; w >= 0."""
    return let({"m": m}, lambda s: quaternion_parts(s["m"]))


def quaternion_parts(m: Column) -> Column:
    a, b, c = r(m, 0, 0), r(m, 1, 1), r(m, 2, 2)
    trace = a + b + c
    yz, zx, xy = r(m, 2, 1) - r(m, 1, 2), r(m, 0, 2) - r(m, 2, 0), r(m, 1, 0) - r(m, 0, 1)
    pyz, pzx, pxy = r(m, 2, 1) + r(m, 1, 2), r(m, 0, 2) + r(m, 2, 0), r(m, 1, 0) + r(m, 0, 1)

    def make(square: Column, place: str) -> Column:
        s = F.sqrt(F.greatest(square, lit(0))) * 2
        parts = {
            "w": (yz / s, zx / s, xy / s, s / 4), "x": (s / 4, pxy / s, pzx / s, yz / s),
            "y": (pxy / s, s / 4, pyz / s, zx / s), "z": (pzx / s, pyz / s, s / 4, xy / s),
        }[place]
        sign = F.when(parts[3] < 0, -1.0).otherwise(1.0)
        return F.struct(*[(p * sign).alias(n) for p, n in zip(parts, "xyzw", strict=True)])

    return (
        F.when(trace > 0, make(1 + trace, "w"))
        .when((a > b) & (a > c), make(1 + a - b - c, "x"))
        .when(b > c, make(1 + b - a - c, "y"))
        .otherwise(make(1 + c - a - b, "z"))
    )


def rotation_of(q: Column, tx: Column | float = 0, ty: Column | float = 0, tz: Column | float = 0) -> Column:
    """A pose from a quaternion of any length but zero."""
    norm = F.sqrt(q.x * q.x + q.y * q.y + q.z * q.z + q.w * q.w)
    unit = {n: q[n] / norm for n in "xyzw"}
    shift = {n: t if isinstance(t, Column) else lit(t) for n, t in (("tx", tx), ("ty", ty), ("tz", tz))}
    return let(unit | shift, lambda s: _rotation(*[s[n] for n in ("x", "y", "z", "w", "tx", "ty", "tz")]))


def _rotation(x: Column, y: Column, z: Column, w: Column, tx: Column, ty: Column, tz: Column) -> Column:
    return pose(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), tx,
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), ty,
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y), tz,
    )


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, lit(low)), lit(high))


def rotation_error(a: Column, b: Column) -> Column:
    """degrees between two rotations by their quaternions."""
    return let({"p": quaternion(a), "q": quaternion(b)}, lambda s: quaternion_angle(s["p"], s["q"]))


def quaternion_angle(p: Column, q: Column) -> Column:
    dot = p.x * q.x + p.y * q.y + p.z * q.z + p.w * q.w
    return F.degrees(F.acos(clamp(1 - 2 * F.greatest(1 - dot * dot, lit(1e-15)), -1, 1)))


def angle_of_trace(trace: Column) -> Column:
    """F6 for orthogonal rotations: the squared product of their quaternions is a quarter of one plus the trace of the relative rotation."""
    return F.degrees(F.acos(clamp(1 - 2 * F.greatest(1 - (1 + trace) / 4, lit(1e-15)), -1, 1)))


def trace_angle(a: Column, b: Column) -> Column:
    """F6 of two orthogonal rotations, by their trace."""
    return angle_of_trace(sum((r(a, i, j) * r(b, i, j) for i in range(3) for j in range(3)), lit(0)))


def is_rigid(m: Column, tolerance: float = 1e-9) -> Column:
    """Whether the rotation of a pose is orthogonal with determinant one."""
    off = [sum((r(m, i, k) * r(m, j, k) for k in range(3)), lit(-1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)]
    return F.coalesce(F.greatest(*[F.abs(x) for x in off]) < tolerance, F.lit(False)) & (determinant(m) > 0)


def direction_error(a: Column, b: Column) -> Column:
    """degrees between two translations, a direction and its opposite counting the same; 90 where one is zero, 1e6 rad where one is no number."""
    return let({"a": a, "b": b}, lambda s: direction_angle(s["a"], s["b"]))


def direction_angle(a: Column, b: Column) -> Column:
    na, nb = (F.sqrt(r(m, 0, 3) ** 2 + r(m, 1, 3) ** 2 + r(m, 2, 3) ** 2) for m in (a, b))
    return angle_of_products(r(a, 0, 3) * r(b, 0, 3) + r(a, 1, 3) * r(b, 1, 3) + r(a, 2, 3) * r(b, 2, 3), na, nb)


def angle_of_products(dot: Column, na: Column, nb: Column) -> Column:
    """F7 from the product of two vectors and their lengths."""
    cos = dot / ((na + 1e-15) * (nb + 1e-15))
    angle = F.degrees(F.acos(F.sqrt(clamp(1 - F.greatest(1 - cos * cos, lit(1e-15)), 0, 1))))
    angle = F.when(F.isnan(cos) | cos.isNull(), F.degrees(lit(1e6))).otherwise(angle)
    return F.least(angle, F.abs(180 - angle))


def unproject(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    """F8: camera coordinates of a pixel."""
    return (u - cx) * depth / fx, (v - cy) * depth / fy, depth


def project(x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """F8: the pixel of a point in front of the camera; null behind it."""
    front = F.when(z > 0, z)
    return fx * x / front + cx, fy * y / front + cy


def fov_of(focal: Column, size: Column) -> Column:
    """field of view of a focal length."""
    return 2 * F.atan(size / 2 / focal)


def focal_of(fov: Column, size: Column) -> Column:
    return size / 2 / F.tan(fov / 2)


def pose_encoding(m: Column, fx: Column, fy: Column, width: Column, height: Column) -> Column:
    """translation, quaternion, vertical and horizontal field of view: nine numbers."""
    parts = {"m": m, "q": quaternion(m), "v": fov_of(fy, height), "h": fov_of(fx, width)}
    return let(parts, lambda s: F.array(*[r(s["m"], i, 3) for i in range(3)], *[s["q"][n] for n in "xyzw"], s["v"], s["h"]))


def decode_pose_encoding(e: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """the pose and (fx, fy, cx, cy) of an encoding; the principal point is the centre."""
    q = F.struct(e[3].alias("x"), e[4].alias("y"), e[5].alias("z"), e[6].alias("w"))
    k = F.struct(focal_of(e[8], width).alias("fx"), focal_of(e[7], height).alias("fy"), (width / 2).alias("cx"), (height / 2).alias("cy"))
    return rotation_of(q, e[0], e[1], e[2]), k


def area_budget_size(width: Column, height: Column, budget: int, align: int) -> tuple[Column, Column]:
    """the largest aligned size of this shape within a pixel budget; never enlarged."""
    scale = F.least(F.sqrt(F.lit(float(budget)) / (width * height)), lit(1))
    fit = lambda n: F.greatest(F.floor(n * scale / align) * align, F.lit(align)).cast("int")
    return fit(width), fit(height)


def resize_intrinsics(k: Column, scale_x: Column, scale_y: Column, crop_x: Column | float = 0, crop_y: Column | float = 0) -> Column:
    """scale, then crop."""
    return F.struct(
        (k.fx * scale_x).alias("fx"), (k.fy * scale_y).alias("fy"), (k.cx * scale_x - crop_x).alias("cx"), (k.cy * scale_y - crop_y).alias("cy")
    )


def cover_crop(width: Column, height: Column, target_w: int, target_h: int) -> Column:
    """scale to cover the target, round half to even, cut the middle out."""
    scale = F.greatest(F.lit(float(target_w)) / width, F.lit(float(target_h)) / height)
    w, h = F.bround(width * scale, 0).cast("int"), F.bround(height * scale, 0).cast("int")
    return F.struct(
        scale.alias("scale"), w.alias("width"), h.alias("height"),
        F.floor((w - target_w) / 2).cast("int").alias("left"), F.floor((h - target_h) / 2).cast("int").alias("top"),
    )


def width_fit_height(width: Column, height: Column, target_w: int, align: int = 14) -> Column:
    """the height at a given width, floored to a multiple."""
    return (F.floor(F.floor(height * target_w / width) / align) * align).cast("int")


def flip_axes(m: Column) -> Column:
    """F16: negate columns 1 and 2 of R: a camera that looks along -z becomes one that looks along +z."""
    return pose(*[-m[i] if i % 4 in (1, 2) else m[i] for i in range(12)])


def world_to_pixel(u: Column, v: Column, origin_u: Column | float, origin_v: Column | float, metres: float) -> tuple[Column, Column]:
    """cells of a top-down grid, v upward; truncates towards zero."""
    as_col = lambda x: x if isinstance(x, Column) else lit(x)
    return ((u - as_col(origin_u)) / metres).cast("int"), ((as_col(origin_v) - v) / metres).cast("int")


def pixel_to_world(px: Column, py: Column, origin_u: float, origin_v: float, metres: float) -> tuple[Column, Column]:
    """the centre of a cell."""
    return lit(origin_u) + (px + 0.5) * metres, lit(origin_v) - (py + 0.5) * metres


def grid_size(low: Column, high: Column, metres: float) -> Column:
    """cells along an extent."""
    return F.greatest(F.ceil((high - low) / metres) + 1, F.lit(1)).cast("int")


def plane_of(axis: str, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(u, v, height) for an up axis."""
    return {"z": (x, y, z), "y": (x, z, y), "x": (y, z, x)}[axis]


def octile(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """length of the shortest path on an open grid of eight neighbours."""
    dx, dy = F.abs(ax - bx), F.abs(ay - by)
    return dx + dy + (math.sqrt(2) - 2) * F.least(dx, dy)


def slerp(a: Column, b: Column, t: Column) -> Column:
    """between two quaternions, the short way; straight where they nearly agree. Products, weights and length are each computed once."""
    ends = lambda s: {k: s[k] for k in "abt"}
    met = lambda s: ends(s) | {"raw": s["a"].x * s["b"].x + s["a"].y * s["b"].y + s["a"].z * s["b"].z + s["a"].w * s["b"].w}
    turned = lambda s: ends(s) | {"raw": s["raw"], "dot": clamp(F.abs(s["raw"]), 0, 1), "angle": F.acos(clamp(F.abs(s["raw"]), 0, 1))}
    return let({"a": a, "b": b, "t": t}, lambda s: let(met(s), lambda s: let(turned(s), lambda s: let(_slerp_weights(s), lambda s: let({n: s["wa"] * s["a"][n] + s["wb"] * s["b"][n] for n in "xyzw"}, _unit)))))


def _slerp_weights(s: Column) -> dict[str, Column]:
    t, angle, straight = s["t"], s["angle"], s["dot"] > 0.9995
    safe = F.when(straight, 1.0).otherwise(F.sin(angle))
    wa = F.when(straight, 1 - t).otherwise(F.sin((1 - t) * angle) / safe)
    wb = F.when(straight, t).otherwise(F.sin(t * angle) / safe) * F.when(s["raw"] < 0, -1.0).otherwise(1.0)
    return {"a": s["a"], "b": s["b"], "wa": wa, "wb": wb}


def _unit(q: Column) -> Column:
    return let({"q": q, "norm": F.sqrt(q.x**2 + q.y**2 + q.z**2 + q.w**2)}, lambda s: F.struct(*[(s["q"][n] / s["norm"]).alias(n) for n in "xyzw"]))


def inverse_log(y: Column) -> Column:
    """F22."""
    return F.signum(y) * F.expm1(F.abs(y))


def confidence_of(y: Column) -> Column:
    """one plus the exponential."""
    return 1 + F.exp(y)


def min_max(x: Column, low: Column | float, high: Column | float) -> Column:
    """clipped position between two bounds; 0 where they coincide."""
    as_col = lambda v: v if isinstance(v, Column) else lit(v)
    span = F.nullif(as_col(high) - as_col(low), lit(0))
    return F.coalesce(clamp((x - as_col(low)) / span, 0, 1), lit(0))


def dead_reckon(x: Column, y: Column, yaw_deg: Column, forward: Column, turn: Column) -> Column:
    """one command of a pose tracker: metres forward along the heading, then degrees turned."""
    return F.struct(
        F.bround(x + forward * F.cos(F.radians(yaw_deg)), 4).alias("x"), F.bround(y + forward * F.sin(F.radians(yaw_deg)), 4).alias("y"),
        F.bround(F.pmod(yaw_deg + turn, lit(360)), 2).alias("yaw_deg"),
    )


def similarity_warp(scale: Column, rotation: Column, m: Column) -> Column:
    """pose of a window under x -> scale * R x + t, where `rotation` is [R | t] and the camera stays rigid."""
    tx, ty, tz = (scale * (r(rotation, i, 0) * r(m, 0, 3) + r(rotation, i, 1) * r(m, 1, 3) + r(rotation, i, 2) * r(m, 2, 3)) + r(rotation, i, 3) for i in range(3))
    turned = compose(rotation, m)
    return pose(*[{3: tx, 7: ty, 11: tz}.get(i, turned[i]) for i in range(12)])


def square_pad(width: Column, height: Column, target: int) -> Column:
    """where an image lies in a square canvas after padding and scaling."""
    side = F.greatest(width, height)
    scale = F.lit(float(target)) / side
    left, top = F.floor((side - width) / 2), F.floor((side - height) / 2)
    return F.struct(
        scale.alias("scale"), (left * scale).alias("x1"), (top * scale).alias("y1"), ((left + width) * scale).alias("x2"), ((top + height) * scale).alias("y2")
    )


def enhance_colour(red: Column, green: Column, blue: Column, saturation: float, brightness: float, alpha: float) -> tuple[Column, Column, Column]:
    """channels in 0..1 to bytes."""
    mean = (red + green + blue) / 3
    return tuple(
        ((clamp((mean + (c - mean) * saturation) * brightness, 0, 1) * alpha + (1 - alpha)) * 255).cast("int") for c in (red, green, blue)
    )


def induced_flow(u: Column, v: Column, depth: Column, m: Column, fx: Column, fy: Column, cx: Column, cy: Column, min_depth: float = 0.2) -> Column:
    """how far a pixel moves under a relative pose; null where the point comes too near."""
    x, y, z = transform_point(m, *unproject(u, v, depth, fx, fy, cx, cy))
    ahead = F.when(z > min_depth, z)
    return F.hypot(fx * x / ahead + cx - u, fy * y / ahead + cy - v)


def from_inverse_depth(u: Column, v: Column, inverse: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column, Column]:
    """a pixel as the homogeneous point x, y, 1 and its inverse depth: a point at infinity has 0."""
    return (u - cx) / fx, (v - cy) / fy, F.lit(1.0), inverse


def move_homogeneous(m: Column, x: Column, y: Column, z: Column, inverse: Column) -> tuple[Column, Column, Column, Column]:
    """a pose on a homogeneous point: the shift counts by the inverse depth."""
    return (*[r(m, i, 0) * x + r(m, i, 1) * y + r(m, i, 2) * z + r(m, i, 3) * inverse for i in range(3)], inverse)


def project_homogeneous(x: Column, y: Column, z: Column, inverse: Column, fx: Column, fy: Column, cx: Column, cy: Column, min_depth: float = 0.2) -> tuple[Column, Column, Column, Column]:
    """pixel, inverse depth there, and whether the point lies far enough ahead; one nearer than half the least depth is projected as if at depth 1."""
    ahead = F.when(z < min_depth / 2, F.lit(1.0)).otherwise(z)
    return fx * x / ahead + cx, fy * y / ahead + cy, inverse / ahead, z > min_depth


def scene_alignment(first_extrinsics: Column) -> Column:
    """the transform that turns a scene to its first camera: inverse(E0), then y and z flipped, then half a turn about y."""
    turn = pose(-1, 0, 0, 0, 0, -1, 0, 0, 0, 0, 1, 0)  # flip(y, z) after the half turn
    return compose(invert_affine(first_extrinsics), turn)


def nearest_source(pixel: Column, size: Column | int, source_size: Column | int) -> Column:
    """the source pixel of a pixel under a resize by the nearest neighbour."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.floor(pixel * as_col(source_size) / as_col(size)), as_col(source_size) - 1).cast("int")
