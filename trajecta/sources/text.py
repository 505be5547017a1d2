"""Trajectory and camera text formats (S4, S5, S13-S21, K1, K2); one plan a format, no collect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.functions.geometry import finite_pose, flip_axes, invert_rigid, rotation_of


def lines(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """(file, line_no from 0, line) without comments; numbered inside each file.

    Files of any size are split anywhere: a line's number is its turn in its split after the
    counts of the splits before, so only a row a split meets in a window.
    """
    kept = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), "value").where(~F.startswith("value", F.lit("#")))
    if not keep_blank:
        kept = kept.where(F.trim("value") != "")
    kept = kept.withColumn("_id", F.monotonically_increasing_id())
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = kept.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    splits = splits.select("file", "_split", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return kept.join(splits, ["file", "_split"]).select("file", (F.col("_id") + F.col("_shift")).cast("int").alias("line_no"), F.trim("value").alias("line"))


def numbers(line: Column) -> Column:
    return F.split(line, r"[\s,]+").cast("array<double>")


def _exactly(values: Column, n: int, what: str) -> Column:
    return F.when(F.size(values) == n, values).otherwise(F.raise_error(F.lit(f"{what}: a line must have {n} numbers")).cast("array<double>"))


def _last_wins(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, "line_no").alias(value))


def trajectory(spark: SparkSession, path: str, num_frames: int = 0) -> DataFrame:
    """Frame number and 12 entries a line; every number up to the last has a row, m null where the file has none."""
    v = _exactly(numbers(F.col("line")), 13, "trajectory")
    rows = lines(spark, path).select("file", "line_no", v.alias("v")).select("file", "line_no", F.col("v")[0].cast("int").alias("frame_idx"), F.slice("v", 2, 12).alias("m"))
    known = _last_wins(rows, ["file", "frame_idx"], "m")
    all_ = known.groupBy("file").agg(F.greatest(F.max("frame_idx") + 1, F.lit(num_frames)).alias("n"))
    all_ = all_.select("file", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame_idx"))
    return all_.join(known, ["file", "frame_idx"], "left")


def intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """Frame number, fx fy cx cy, width, height."""
    v = _exactly(numbers(F.col("line")), 7, "intrinsics")
    rows = lines(spark, path).select("file", "line_no", v.alias("v"))
    names = ["fx", "fy", "cx", "cy"]
    k = F.struct(*[F.col("v")[i + 1].alias(n) for i, n in enumerate(names)], *[F.col("v")[5 + i].cast("int").alias(n) for i, n in enumerate(("width", "height"))])
    return _last_wins(rows.select("file", "line_no", F.col("v")[0].cast("int").alias("frame_idx"), k.alias("k")), ["file", "frame_idx"], "k").select("file", "frame_idx", "k.*")


def tum(spark: SparkSession, path: str) -> DataFrame:
    """Seconds, translation, quaternion x y z w; shorter lines are skipped. Times become whole microseconds."""
    v = lines(spark, path).select("file", "line_no", numbers(F.col("line")).alias("v")).where(F.size("v") >= 8)
    q = F.struct(*[F.col("v")[4 + i].alias(n) for i, n in enumerate("xyzw")])
    return v.select("file", "line_no", F.bround(F.col("v")[0] * 1_000_000, 0).cast("long").alias("t_us"), rotation_of(q, F.col("v")[1], F.col("v")[2], F.col("v")[3]).alias("m"))


def indexed_tum(spark: SparkSession, path: str) -> DataFrame:
    """As tum, but the first number is a frame number; the last line of a number wins."""
    rows = tum(spark, path).select("file", "line_no", F.floor(F.col("t_us") / 1_000_000).cast("int").alias("frame_idx"), "m")
    return _last_wins(rows, ["file", "frame_idx"], "m")


def kitti_poses(spark: SparkSession, path: str) -> DataFrame:
    """12 numbers a line; the line is the frame."""
    return lines(spark, path).select("file", F.col("line_no").alias("frame_idx"), _exactly(numbers(F.col("line")), 12, "poses").alias("m"))


def kitti_calibration(spark: SparkSession, path: str, camera: str = "P2") -> DataFrame:
    """Fx fy cx cy of one projection row."""
    row = lines(spark, path).where(F.col("line").startswith(f"{camera}:"))
    v = row.select("file", numbers(F.trim(F.substring_index("line", ":", -1))).alias("v"))
    return v.select("file", *[F.col("v")[i].alias(n) for n, i in (("fx", 0), ("fy", 5), ("cx", 2), ("cy", 6))])


def kitti_sequence(spark: SparkSession, poses: str, calibration: str, camera: str = "P2") -> DataFrame:
    """Poses of one sequence with the camera of its calibration; only frames that both have, and one camera serves all."""
    one = kitti_calibration(spark, calibration, camera).select("fx", "fy", "cx", "cy").limit(1)
    return kitti_poses(spark, poses).crossJoin(F.broadcast(one))  # one row


def shortest(frames: DataFrame, others: list[DataFrame], by: list[str]) -> DataFrame:
    """Frames up to the least number that every table has: rows with frame_idx under the smallest count of each group."""
    out = frames
    for n, other in enumerate([frames, *others]):
        out = out.join(other.groupBy(*by).agg(F.count(F.lit(1)).alias(f"_n{n}")), by)
    counts = [F.col(f"_n{n}") for n in range(len(others) + 1)]
    return out.where(F.col("frame_idx") < (F.least(*counts) if len(counts) > 1 else counts[0])).select(*frames.columns)


def _stacked(spark: SparkSession, path: str, height: int, first: int) -> DataFrame:
    """Matrices of four lines in records of `height` lines, from line `first` of a record on: (file, frame_idx, m)."""
    rows = lines(spark, path).select("file", F.floor(F.col("line_no") / height).cast("int").alias("frame_idx"), (F.col("line_no") % height - first).alias("row"), "line")
    rows = rows.where(F.col("row").between(0, 2)).groupBy("file", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("row", numbers(F.col("line")).alias("v")))).alias("r"))
    return rows.select("file", "frame_idx", F.flatten(F.col("r.v")).alias("m"))


def gl_poses(spark: SparkSession, path: str) -> DataFrame:
    """Four lines a matrix, cameras along -z; turned to look along +z."""
    return _stacked(spark, path, 4, 0).withColumn("m", flip_axes(F.col("m")))


def log_poses(spark: SparkSession, path: str) -> DataFrame:
    """Five lines a record: a head line and a matrix."""
    return _stacked(spark, path, 5, 1)


def matrix_poses(spark: SparkSession, path: str) -> DataFrame:
    """16 numbers a line."""
    return lines(spark, path).select("file", F.col("line_no").alias("frame_idx"), F.slice(_exactly(numbers(F.col("line")), 16, "matrix"), 1, 12).alias("m"))


def split_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Lines such as sequence7 become seq-07."""
    return lines(spark, path).select(F.concat(F.lit("seq-"), F.lpad(F.regexp_extract("line", r"(\d+)", 1), 2, "0")).alias("scene"))


def millimetre_depth(raw: Column, invalid: int = 65535, low: float = 1e-3, high: float = 10.0) -> Column:
    """Metres from 16-bit millimetres; 0 for invalid, too near or too far."""
    m = raw / 1000.0
    return F.when((raw == invalid) | (m < low) | (m > high), 0.0).otherwise(m)


def colmap_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Id, model, width, height, parameters to fx fy cx cy; models with one focal length share it."""
    p = F.split("line", r"\s+")
    v = lines(spark, path).select(p[0].cast("int").alias("camera_id"), p[1].alias("model"), p[2].cast("int").alias("width"), p[3].cast("int").alias("height"), F.slice(p, 5, 100).cast("array<double>").alias("a"))
    single = F.col("model").isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL")
    a = F.col("a")
    return v.select("camera_id", "model", "width", "height", a[0].alias("fx"), F.when(single, a[0]).otherwise(a[1]).alias("fy"), F.when(single, a[1]).otherwise(a[2]).alias("cx"), F.when(single, a[2]).otherwise(a[3]).alias("cy"))


def colmap_images(spark: SparkSession, path: str) -> DataFrame:
    """Header lines of pairs: id, quaternion w x y z and translation of world to camera, camera, name; poses are inverted."""
    head = lines(spark, path).where("line_no % 2 = 0").select(F.split("line", r"\s+").alias("p"))
    q = F.struct(*[F.col("p")[i].cast("double").alias(n) for n, i in (("x", 2), ("y", 3), ("z", 4), ("w", 1))])
    world_to_camera = rotation_of(q, *[F.col("p")[5 + i].cast("double") for i in range(3)])
    return head.select(F.col("p")[0].cast("int").alias("image_id"), F.col("p")[8].cast("int").alias("camera_id"), F.col("p")[9].alias("name"), invert_rigid(world_to_camera).alias("m"))


def write_trajectory(poses: DataFrame, path: str) -> None:
    """K1: rows in frame order with ten decimals; missing poses and poses with a number that is not finite are left out."""
    entries = [F.format_string("%.10f", F.col("m")[i]) for i in range(12)]
    line = F.concat_ws(" ", F.col("frame_idx").cast("string"), *entries)
    _write_lines(poses.where(finite_pose(F.col("m"))), line, path)


def write_intrinsics(rows: DataFrame, path: str) -> None:
    """K2: as K1, but missing values are written as nan."""
    k = [F.when(F.col(c).isNull(), "nan").otherwise(F.format_string("%.10f", F.col(c))) for c in ("fx", "fy", "cx", "cy")]
    _write_lines(rows, F.concat_ws(" ", F.col("frame_idx").cast("string"), *k, F.col("width").cast("string"), F.col("height").cast("string")), path)


def _write_lines(rows: DataFrame, line: Column, path: str) -> None:
    """Part files are in frame order, one after the other."""
    rows.repartitionByRange("frame_idx").sortWithinPartitions("frame_idx").select(line.alias("value")).write.mode("overwrite").text(path)

