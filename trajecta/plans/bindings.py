"""The driver's tables as trajectories, depth pixels, points and metrics, for Spark and as SQL views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.functions.geometry import planar_pose


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")
    return F.unix_micros(column)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", "user_id", "event_type", F.col("value").cast("double").alias("value"), micros(e, "ts").alias("t_us"), k.alias("k"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of one scene a user, with planar ground-truth and predicted poses as numbers."""
    w = Window.partitionBy("scene").orderBy("t_us", "event_id")
    e = events(spark, sf_dir).withColumnRenamed("user_id", "scene").withColumn("frame_idx", F.row_number().over(w) - 1)
    day = F.col("t_us") / 86_400_000_000.0
    off = F.col("event_id") % 7
    return e.select(
        "scene", "frame_idx", "event_id", "t_us", F.radians(F.col("k").cast("double")).alias("yaw"), F.col("value").alias("x"), day.alias("y"),
        F.radians(F.col("k") + 0.37 + off * 0.91).alias("pyaw"), (F.col("value") * 1.01 + off * 0.05).alias("px"), (day + F.col("event_id") % 5 * 0.03).alias("py"),
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames with the poses as 3 by 4 matrices gt and pred."""
    f = frames(spark, sf_dir)
    return f.select("scene", "frame_idx", planar_pose(F.col("yaw"), F.col("x"), F.col("y")).alias("gt"), planar_pose(F.col("pyaw"), F.col("px"), F.col("py")).alias("pred"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as depth pixels: a frame a supplier."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    gt = F.col("l_extendedprice")
    return l.select(F.col("l_suppkey").alias("frame"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), gt.alias("gt"), (gt * (1 - F.col("l_discount"))).alias("pred"), F.col("l_quantity").alias("confidence"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: the first three components, even ids predicted and odd ids ground truth."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")], "label", (F.col("vec_id") % 2 == 0).alias("is_pred"))


# The same views in SQL.
EVENTS = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t_us, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INTEGER) AS k FROM events)"
FRAMES = (
    EVENTS
    + """, fr AS (
  SELECT user_id AS scene, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1 AS INTEGER) AS frame_idx, event_id, t_us,
    radians(CAST(k AS DOUBLE)) AS yaw, value AS x, t_us / 86400000000.0 AS y, radians(k + 0.37 + (event_id % 7) * 0.91) AS pyaw,
    value * 1.01 + (event_id % 7) * 0.05 AS px, t_us / 86400000000.0 + event_id % 5 * 0.03 AS py
  FROM ev)"""
)
PIXELS = "pix AS (SELECT l_suppkey AS frame, l_orderkey, l_linenumber, l_partkey AS part, l_extendedprice AS gt, l_extendedprice * (1 - l_discount) AS pred, l_quantity AS confidence FROM lineitem)"
POINTS = "pts AS (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label, vec_id % 2 = 0 AS is_pred FROM embeddings)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without a negative zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
