"""Trajectory, depth, cloud and pose-pair metrics, and their roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.geometry import angle_of_products, angle_of_trace, compose_parts, direction_error, invert_affine, is_rigid, quaternion, r, rotation_error
from trajecta.operators.joins import ordered_pairs
from trajecta.operators.quantiles import Quantile, quantiles, same_groups

THRESHOLDS = (3, 5, 15, 30)


def _rigid_pair_errors(poses: DataFrame, by: list[str]) -> DataFrame:
    """Pair errors of frames whose rotations are orthogonal, from 15 numbers a frame.

    With E = R_gt R_pred^T of a frame, the trace of the relative rotations' difference is the sum
    of the products of E_i and E_j, and the product of the relative translations is
    d_gt^T E_i d_pred, where d are differences of positions in the world.
    """
    g, p = F.col("gt"), F.col("pred")
    cells = {f"e{i}{j}": r(g, i, 0) * r(p, j, 0) + r(g, i, 1) * r(p, j, 1) + r(g, i, 2) * r(p, j, 2) for i in range(3) for j in range(3)}
    spots = {f"{n}{i}": r(m, i, 3) for n, m in (("g", g), ("p", p)) for i in range(3)}
    pairs = ordered_pairs(poses.select(*by, "frame_idx", *[c.alias(n) for n, c in (cells | spots).items()]), by, "frame_idx", [*cells, *spots])
    trace = reduce(lambda x, y: x + y, [F.col(f"a_{n}") * F.col(f"b_{n}") for n in cells])
    steps = {n: F.col(f"b_{n}") - F.col(f"a_{n}") for n in spots}
    keys = [*by, F.col("a_frame_idx").alias("i"), F.col("b_frame_idx").alias("j")]
    rel = pairs.select(*keys, trace.alias("_trace"), *[F.col(f"a_{n}").alias(n) for n in cells], *[c.alias(n) for n, c in steps.items()])
    dot = reduce(lambda x, y: x + y, [F.col(f"g{i}") * (F.col(f"e{i}0") * F.col("p0") + F.col(f"e{i}1") * F.col("p1") + F.col(f"e{i}2") * F.col("p2")) for i in range(3)])
    norms = [F.sqrt(F.col(f"{n}0") ** 2 + F.col(f"{n}1") ** 2 + F.col(f"{n}2") ** 2) for n in "gp"]
    rel = rel.select(*by, "i", "j", "_trace", dot.alias("_dot"), norms[0].alias("_ng"), norms[1].alias("_np"))
    return rel.select(*by, "i", "j", angle_of_trace(F.col("_trace")).alias("r_err"), angle_of_products(F.col("_dot"), F.col("_ng"), F.col("_np")).alias("t_err"))


def _general_pair_errors(poses: DataFrame, by: list[str]) -> DataFrame:
    """Pair errors by full inverses and quaternions."""
    inv = poses.select(*by, "frame_idx", "gt", "pred", invert_affine(F.col("gt")).alias("gi"), invert_affine(F.col("pred")).alias("pi"))
    pairs = ordered_pairs(inv, by, "frame_idx", ["gt", "pred", "gi", "pi"])
    keys = [*by, F.col("a_frame_idx").alias("i"), F.col("b_frame_idx").alias("j")]
    rel = pairs.select(*keys, compose_parts(F.col("a_gi"), F.col("b_gt")).alias("g"), compose_parts(F.col("a_pi"), F.col("b_pred")).alias("p"))
    return rel.select(*by, "i", "j", rotation_error(F.col("g"), F.col("p")).alias("r_err"), direction_error(F.col("g"), F.col("p")).alias("t_err"))


def pose_pair_errors(poses: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, j, r_err, t_err) of all pairs i < j, poses gt and pred.

    Groups whose rotations are all orthogonal (to 1e-9) take a short form; the others go by
    full inverses and quaternions.
    """
    rigid = poses.groupBy(*by).agg(F.bool_and(is_rigid(F.col("gt")) & is_rigid(F.col("pred"))).alias("_rigid"))
    marked = poses.select(*by, "frame_idx", "gt", "pred").join(rigid, by)
    return _rigid_pair_errors(marked.where("_rigid"), by).unionByName(_general_pair_errors(marked.where("not coalesce(_rigid, false)"), by))


def auc(error: Column, threshold: int) -> Column:
    """A4: percent of the area under the cumulative histogram of integer bins; an error equal to the threshold is in the last bin.

    A pair in bin b adds threshold - b to the area, so one sum replaces histogram and running sum.
    """
    share = F.when((error >= 0) & (error <= threshold), threshold - F.least(F.floor(error), F.lit(threshold - 1))).otherwise(0)
    return 100.0 * F.sum(share) / (threshold * F.count(F.lit(1)))


def accuracy_under(error: Column, threshold: float) -> Column:
    """A3: percent of rows strictly under a threshold."""
    return 100.0 * F.avg(F.when(error < threshold, 1.0).otherwise(0.0))


def pair_metrics(pairs: DataFrame, by: list[str], thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """A3 and A4 over r_err and t_err; grouping by scene gives L1, by dataset the micro aggregate."""
    both = F.greatest("r_err", "t_err")
    aggs = []
    for t in thresholds:
        aggs += [accuracy_under(F.col("r_err"), t).alias(f"Racc_{t:02d}"), accuracy_under(F.col("t_err"), t).alias(f"Tacc_{t:02d}"), auc(both, t).alias(f"AUC_{t:02d}")]
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), *aggs)


def macro(metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Mean over scenes, with their number."""
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("num_scenes"), *[F.avg(n).alias(n) for n in names])


def auc_by_frames(pairs: DataFrame, by: list[str], threshold: int, step: int = 10) -> DataFrame:
    """A5: the metrics on the first step, 2 step, ... frames, and on all of them. A pair counts from its later frame j on."""
    bin_ = F.ceil((F.col("j") + 1) / step) * step
    both = F.greatest("r_err", "t_err")
    share = F.when((both >= 0) & (both <= threshold), threshold - F.least(F.floor(both), F.lit(threshold - 1))).otherwise(0)
    grouped = pairs.groupBy(*by, bin_.cast("int").alias("frames")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(share).alias("area"), (F.max("j") + 1).cast("int").alias("_upto"),
        F.sum(F.when(F.col("r_err") < threshold, 1).otherwise(0)).alias("r"), F.sum(F.when(F.col("t_err") < threshold, 1).otherwise(0)).alias("t"),
    )
    w = Window.partitionBy(*by).orderBy("frames").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("n").over(w)
    all_frames = F.max("_upto").over(Window.partitionBy(*by))
    return grouped.select(
        *by, F.least("frames", all_frames).alias("frames"), (100.0 * F.sum("area").over(w) / (threshold * n)).alias("auc"),
        (100.0 * F.sum("r").over(w) / n).alias("racc"), (100.0 * F.sum("t").over(w) / n).alias("tacc"),
    )


def valid_depth(df: DataFrame, low: float, high: float) -> DataFrame:
    """Both depths finite, ground truth strictly between bounds, prediction positive."""
    fine = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in (F.col("gt"), F.col("pred"))]
    return df.where(fine[0] & fine[1] & (F.col("gt") > low) & (F.col("gt") < high) & (F.col("pred") > 0))


def align_depth(
    df: DataFrame, by: list[str], mode: str = "scale_only", min_pixels: int = 100, pre_clip: tuple[float, float] | None = None, post_clip: tuple[float, float] | None = None
) -> DataFrame:
    """Per frame, pred times the ratio of medians, or the least-squares line; frames of too few pixels go.

    pre_clip bounds the predictions that the fit sees, post_clip the aligned ones.
    """
    seen = "pred"
    if pre_clip is not None:
        df, seen = df.withColumn("_seen", F.least(F.greatest("pred", F.lit(float(pre_clip[0]))), F.lit(float(pre_clip[1])))), "_seen"
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.regr_slope("gt", seen).alias("_slope"), F.regr_intercept("gt", seen).alias("_shift")).where(F.col("_n") >= min_pixels)
    if mode in ("scale_only", "lstsq"):
        medians = quantiles(df, by, {"_gt": Quantile("gt", 0.5), "_pred": Quantile(seen, 0.5)})
        counts = counts.join(medians, by)
        ratio = F.col("_gt") / F.nullif("_pred", F.lit(0.0))
    fit = counts
    if mode == "lstsq":
        scale, shift = F.coalesce(F.col("_slope"), ratio), F.when(F.col("_slope").isNotNull(), F.col("_shift")).otherwise(F.lit(0.0))
    else:
        scale, shift = ratio if mode == "scale_only" else F.lit(1.0), F.lit(0.0)
    out = df.join(fit.select(*by, scale.alias("_s"), shift.alias("_t")), by).withColumn("pred", F.col("pred") * F.col("_s") + F.col("_t")).drop("_s", "_t", "_seen")
    if post_clip is None:
        return out
    return out.withColumn("pred", F.least(F.greatest("pred", F.lit(float(post_clip[0]))), F.lit(float(post_clip[1]))))


def depth_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Errors pooled over all pixels of all frames; only the logarithms see clipped depths."""
    gt, pred = F.col("gt"), F.col("pred")
    ratio = F.greatest(gt / F.nullif(pred, F.lit(0.0)), pred / gt)
    logs = [F.log(F.greatest(c, F.lit(1e-5))) for c in (pred, gt)]
    aggs = [
        F.avg(F.abs(pred - gt) / gt).alias("abs_rel"), F.avg((pred - gt) ** 2 / gt).alias("sq_rel"), F.sqrt(F.avg((pred - gt) ** 2)).alias("rmse"),
        F.sqrt(F.avg((logs[0] - logs[1]) ** 2)).alias("log_rmse"), F.count(F.lit(1)).alias("n_pixels"),
    ]
    aggs += [(100.0 * F.avg(F.when((ratio < 1.25**k) & (pred != 0), 1.0).otherwise(0.0))).alias(f"delta_{k}") for k in (1, 2, 3)]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def cloud_metrics(pred_to_gt: DataFrame, gt_to_pred: DataFrame, by: list[str], thresholds: tuple[float, ...]) -> DataFrame:
    """A12 and A13 from nearest distances both ways."""

    def share(name: str, t: float) -> Column:
        return (100.0 * F.avg(F.when(F.col("distance") < t, 1.0).otherwise(0.0))).alias(name)

    names = [("" if len(thresholds) == 1 else f"_{t:g}", t) for t in thresholds]
    a = pred_to_gt.groupBy(*by).agg(F.avg("distance").alias("accuracy"), *[share(f"precision{n}", t) for n, t in names])
    b = gt_to_pred.groupBy(*by).agg(F.avg("distance").alias("completeness"), *[share(f"recall{n}", t) for n, t in names])
    out = a.join(b, by).withColumn("chamfer", (F.col("accuracy") + F.col("completeness")) / 2)
    for n, _ in names:
        p, q = F.col(f"`precision{n}`"), F.col(f"`recall{n}`")
        out = out.withColumn(f"f1{n}", F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0))
    return out


def pr_curve(distances: DataFrame, by: list[str], tau: float, bins: int = 1000) -> DataFrame:
    """Share of distances under each step of tau / 100 up to 10 tau."""
    step = tau / 100
    b = distances.where(F.col("distance") < bins * step).groupBy(*by, F.floor(F.col("distance") / step).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = distances.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return b.join(total, by).select(*by, "bin", (100.0 * F.sum("n").over(w) / F.col("total")).alias("share"))


def umeyama_statistics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """N, sums and products of source (sx, sy, sz) and target (tx, ty, tz): all that the alignment needs, one row a group."""
    s, t = ["sx", "sy", "sz"], ["tx", "ty", "tz"]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in s + t]]
    aggs += [F.sum(reduce(lambda a, b: a + b, [F.col(c) ** 2 for c in s])).alias("sum_ss")]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"sum_{a}_{b}") for a in t for b in s]
    return pairs.groupBy(*by).agg(*aggs)


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def rank_metrics(metrics: DataFrame, by: list[str], higher_better: list[str], top: int = 3) -> DataFrame:
    """Competition rank of value among the rows of a metric; counts (num_*) and non-finite values are not ranked."""
    up = F.col("metric").isin(higher_better)
    for mark in ("precision", "recall", "f1", "delta_", "AUC", "Racc", "Tacc"):
        up = up | F.col("metric").startswith(mark)
    fit = metrics.where(~F.col("metric").startswith("num_") & ~F.isnan("value") & (F.abs("value") < float("inf")))
    w = Window.partitionBy(*by, "metric").orderBy(F.when(up, -F.col("value")).otherwise(F.col("value")))
    return fit.withColumn("rank", F.rank().over(w)).withColumn("marked", F.col("rank") <= top)


def long_metrics(wide: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Wide metric columns to rows (metric, value)."""
    return wide.unpivot(by, [F.col(n).cast("double").alias(n) for n in names], "metric", "value")


def mean_of_documents(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Mean of every metric over scenes, with the number of scenes that have it and of all."""
    w = Window.partitionBy(*by)
    each = metrics.groupBy(*by, "metric").agg(F.avg("value").alias("value"), F.count("value").alias("present"))
    scenes = metrics.select(*by, "scene").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("num_scenes"))
    return each.join(scenes, by).withColumn("n_metrics", F.count(F.lit(1)).over(w))


def lower_median(x: str) -> Column:
    """The lower of two middle values."""
    return F.expr(f"percentile_disc(0.5) within group (order by {x})")


def depth_ratio_scale(pairs: DataFrame, by: list[str], anchor: str = "anchor", target: str = "target") -> DataFrame:
    """Per group, the lower median of anchor over target where both are finite and |target| is over the 32-bit epsilon, held between 1e-3 and 1e3; 1 where none is."""
    a, t = F.col(anchor), F.col(target)
    fine = a.isNotNull() & t.isNotNull() & ~F.isnan(a) & ~F.isnan(t) & (F.abs(a) < float("inf")) & (F.abs(t) < float("inf")) & (F.abs(t) > 1.1920928955078125e-07)
    rated = pairs.select(*by, F.when(fine, a / t).alias("_ratio"))
    scale = F.least(F.greatest(F.coalesce("scale", F.lit(1.0)), F.lit(1e-3)), F.lit(1e3))
    medians = quantiles(rated, by, {"scale": Quantile("_ratio", 0.5, lower=True)}).withColumn("scale", scale)
    counts = rated.groupBy(*by).agg(F.count("_ratio").alias("n"))
    return same_groups(medians, counts, by)


def throughput(frames: DataFrame, by: list[str], order: str, ms: str, scale_frames: int = 0, first_ms: float = 0.0, half: int = 30) -> DataFrame:
    """Frames a second over all frames, first phase included, and near a tenth, the middle and nine tenths of the streamed ones.

    The first place lies ten frames in at least; each mean reaches `half` frames to both sides.
    """
    w = Window.partitionBy(*by)
    n, at = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order)) - 1
    near = frames.select(*by, F.col(ms).alias("_ms"), at.alias("_at"), n.alias("_n"))
    tenth = F.floor(F.col("_n") / 10)
    places = {"lo": F.greatest(F.lit(10), tenth), "mid": F.floor(F.col("_n") / 2), "hi": F.col("_n") - F.greatest(F.lit(1), tenth)}
    rate = lambda x: F.when(x > 0, 1000.0 / x).otherwise(0.0)
    mean = (first_ms + F.sum("_ms")) / (scale_frames + F.count(F.lit(1)))
    aggs = [(scale_frames + F.count(F.lit(1))).alias("total_frames"), rate(mean).alias("global_fps")]
    aggs += [rate(F.avg(F.when(F.col("_at").between(p - half, p + half), F.col("_ms")))).alias(f"fps_{name}") for name, p in places.items()]
    return near.groupBy(*by).agg(*aggs)


def pose_distances(poses: DataFrame, by: list[str], beta: float = 2.5) -> DataFrame:
    """(by, i, j, distance) of all pairs i < j of rigid poses: the length of the SE(3) logarithm of the relative pose, positions times beta.

    The matrix is symmetric with a zero diagonal. From the quaternion and position of a frame:
    the relative turn by t about an axis stretches what the step has across the axis by
    t / 2 over sin(t / 2).
    """
    m = F.col("pose")
    parts = poses.select(*by, "frame_idx", quaternion(m).alias("q"), *[(beta * r(m, i, 3)).alias(n) for i, n in enumerate(("tx", "ty", "tz"))])
    cols = ["qx", "qy", "qz", "qw", "tx", "ty", "tz"]
    pairs = ordered_pairs(parts.select(*by, "frame_idx", *[F.col(f"q.{n}").alias(f"q{n}") for n in "xyzw"], "tx", "ty", "tz"), by, "frame_idx", cols)
    a, b = ({c: F.col(f"{s}_{c}") for c in cols} for s in "ab")
    vec = [  # of q_b times the conjugate of q_a, the relative turn seen from the world
        b["qw"] * -a["qx"] + b["qx"] * a["qw"] - b["qy"] * a["qz"] + b["qz"] * a["qy"],
        b["qw"] * -a["qy"] + b["qy"] * a["qw"] - b["qz"] * a["qx"] + b["qx"] * a["qz"],
        b["qw"] * -a["qz"] + b["qz"] * a["qw"] - b["qx"] * a["qy"] + b["qy"] * a["qx"],
    ]
    dot = reduce(lambda x, y: x + y, [a[c] * b[c] for c in cols[:4]])
    steps = [b[c] - a[c] for c in cols[4:]]
    keys = [*by, F.col("a_frame_idx").alias("i"), F.col("b_frame_idx").alias("j")]
    rel = pairs.select(*keys, *[v.alias(f"_v{i}") for i, v in enumerate(vec)], F.abs(dot).alias("_w"), *[s.alias(f"_s{i}") for i, s in enumerate(steps)])
    total = lambda x, y: reduce(lambda p, q: p + q, [F.col(f"{x}{i}") * F.col(f"{y}{i}") for i in range(3)])
    rel = rel.select(*by, "i", "j", "_w", F.sqrt(total("_v", "_v")).alias("_half"), total("_v", "_s").alias("_along"), total("_s", "_s").alias("_square"))
    turns = F.col("_half") > 1e-9
    rel = rel.select(
        *by, "i", "j", (2 * F.atan2(F.col("_half"), F.col("_w"))).alias("_angle"), F.when(turns, F.col("_half")).alias("_half"), "_square",
        F.when(turns, (F.col("_along") / F.col("_half")) ** 2).otherwise(0.0).alias("_along"),
    )
    stretch = F.coalesce(F.col("_angle") / 2 / F.col("_half"), F.lit(1.0))
    return rel.select(*by, "i", "j", F.sqrt(F.col("_angle") ** 2 + F.col("_along") + stretch**2 * F.greatest(F.col("_square") - F.col("_along"), F.lit(0.0))).alias("distance"))


def upsert(table_path: str, rows: DataFrame, keys: list[str]) -> None:
    """K6: replace the partitions of rows' keys and keep the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(table_path)
