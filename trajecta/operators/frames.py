"""Frame numbering, sampling, count windows, keyframes and stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reindex(df: DataFrame, by: list[str], order: list[str], name: str = "frame_idx") -> DataFrame:
    """0, 1, 2, ... in order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def sample_stride(df: DataFrame, index: str, start: int = 0, end: int | None = None, stride: int = 1) -> DataFrame:
    """Every stride-th frame of [start, end)."""
    if end is not None and start >= end:
        raise ValueError("start must be before end")
    out = df.where((F.col(index) >= start) & ((F.col(index) - start) % stride == 0))
    return out if end is None else out.where(F.col(index) < end)


def sample_count(df: DataFrame, by: list[str], index: str, n: int) -> DataFrame:
    """N frames at equal steps from the first to the last, truncated; a frame may come twice."""
    last = F.max(index).over(Window.partitionBy(*by))
    ends = df.withColumn("_last", last)
    wanted = ends.select(*by, "_last").distinct().withColumn("sample_pos", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    place = F.floor(F.col("sample_pos") * F.col("_last") / max(n - 1, 1)).cast("int")
    return wanted.select(*by, place.alias(index), "sample_pos").join(df, [*by, index])


def keyframe(position: Column, scale_frames: int, interval: Column | int) -> Column:
    """All of the first frames, then every interval-th."""
    return (position < scale_frames) | ((position - scale_frames) % interval == 0)


def auto_interval(n: Column, limit: int = 320) -> Column:
    """W8."""
    return F.when(n <= limit, F.lit(1)).otherwise(F.ceil(n / limit)).cast("int")


def moving_average(df: DataFrame, by: list[str], order: str, value: str, half: int, name: str) -> DataFrame:
    """Centred mean, shorter at the ends."""
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)))


def visible_frames(df: DataFrame, by: list[str], index: str, scale_frames: int, window: int) -> DataFrame:
    """For each frame, the pinned first frames and the last `window` frames, as (frame, seen)."""
    seen = df.select(*by, F.col(index).alias("seen"))
    me = df.select(*by, F.col(index).alias("frame"))
    offsets = F.sequence(F.greatest(F.col("frame") - (window - 1), F.lit(0)), F.col("frame"))
    pinned = F.sequence(F.lit(0), F.least(F.lit(scale_frames - 1), F.col("frame")))
    both = me.withColumn("seen", F.explode(F.array_distinct(F.concat(pinned, offsets)).cast("array<int>")))
    return both.join(seen, [*by, "seen"], "left_semi")


def block_causal_limit(position: Column, block: int) -> Column:
    """The first position that a row does not see."""
    return (F.floor(position / block) + 1) * block


def history(current: Column, k: int) -> tuple[Column, Column]:
    """The first and last frame shown; only the current one for k = 0."""
    return F.greatest(current - k, F.lit(0)), current


def count_windows(lengths: DataFrame, by: list[str], n: str, scale_frames: int, window: int, interval: int, overlap: int) -> DataFrame:
    """Windows of scale + (window - scale) * interval frames, each starting `overlap` before the last one's end.

    A shorter last window stays if it holds `overlap` frames or more, or ends the sequence.
    """
    size = scale_frames + (window - scale_frames) * interval
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than a window")
    starts = F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)), F.lit(step))
    out = lengths.select(*by, n, F.posexplode(starts).alias("window_id", "start")).withColumn("end", F.least(F.col("start") + size, F.col(n)))
    before = F.lag("end").over(Window.partitionBy(*by).orderBy("start"))
    return out.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") < F.col(n))).where("end > start").drop("_b", n)


def stitch(rows: DataFrame, by: list[str], overlap: int) -> DataFrame:
    """Rows of all windows, without the last `overlap` frames of every window but the last."""
    w = Window.partitionBy(*by)
    last, end = F.max("window_id").over(w), F.max("frame_idx").over(Window.partitionBy(*by, "window_id"))
    out = rows.withColumn("_last", last).withColumn("_end", end)
    return out.where((F.col("window_id") == F.col("_last")) | (F.col("frame_idx") <= F.col("_end") - overlap)).drop("_last", "_end")


def window_anchor(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per neighbouring windows the last frame that is a keyframe in both, else the first frame that both hold."""
    a = rows.select(*by, "window_id", "frame_idx", F.col("is_key").alias("ka"))
    b = rows.select(*by, (F.col("window_id") - 1).alias("window_id"), "frame_idx", F.col("is_key").alias("kb"))
    met = a.join(b, [*by, "window_id", "frame_idx"])
    both = F.col("ka") & F.col("kb")
    return met.groupBy(*by, "window_id").agg(F.coalesce(F.max(F.when(both, F.col("frame_idx"))), F.min("frame_idx")).alias("anchor"), F.count_if(both).alias("n_keys"))


def sample_between(df: DataFrame, by: list[str], index: str, n: int, start: int = 0, end: int | None = None) -> DataFrame:
    """N frames at equal steps over [start, end), truncated; a frame may come twice, and end is the sequence's by default."""
    upto = F.max(index).over(Window.partitionBy(*by)) + 1
    upto = upto if end is None else F.least(upto, F.lit(end))
    wanted = df.select(*by, upto.alias("_upto")).distinct().where(F.col("_upto") > start)
    wanted = wanted.withColumn("sample_pos", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    place = start + F.floor(F.col("sample_pos") * (F.col("_upto") - 1 - start) / max(n - 1, 1))
    return wanted.select(*by, place.cast("int").alias(index), "sample_pos").join(df, [*by, index])


def listed_frames(files: DataFrame, by: list[str], name: str, extensions: tuple[str, ...], first_k: int | None = None, stride: int = 1) -> DataFrame:
    """Files of the extensions in the order of their names, the first first_k of them, then every stride-th."""
    kept = files.where(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*[e.lower().lstrip(".") for e in extensions]))
    numbered = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(name)) - 1)
    if first_k is not None:
        numbered = numbered.where(F.col("_n") < first_k)
    return numbered.where(F.col("_n") % stride == 0).withColumn("frame_idx", F.floor(F.col("_n") / stride).cast("int")).drop("_n")


def video_interval(source_fps: Column, target_fps: float) -> Column:
    """Keep every so many frames of a video; halves round to even."""
    return F.greatest(F.bround(source_fps / target_fps, 0).cast("int"), F.lit(1))


def latest_known(rows: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Of each column the last value that is not null, by the order."""
    return rows.groupBy(*by).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def progress(rows: DataFrame, by: list[str], order: str, name: str = "progress") -> DataFrame:
    """Place in the order as a share of the number of rows, 0 for the first."""
    w = Window.partitionBy(*by)
    return rows.withColumn(name, (F.row_number().over(w.orderBy(order)) - 1) / F.count(F.lit(1)).over(w))
