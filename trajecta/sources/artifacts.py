"""Artifacts of a scene: frames, completion records, transforms, evaluation documents and keyed caches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.sources import files


class Artifact:
    """What one method made of one scene, in a folder that Spark reaches.

    K5: a folder counts once its completion record is there, which is written last; what an
    attempt that failed has left is cleared before the next.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.record = f"{self.root}/.complete.json"

    def is_complete(self) -> bool:
        return files.exists(self.spark, self.record)

    def mark_complete(self, metadata: dict | None = None) -> None:
        now = datetime.now(timezone.utc).isoformat()
        files.write_text(self.spark, self.record, json.dumps({"completed_at": now, "metadata": metadata or {}}, indent=2))

    def mark_incomplete(self) -> None:
        files.remove(self.spark, self.record)

    def metadata(self) -> dict | None:
        """None without a record, or where it cannot be read."""
        text = files.read_text(self.spark, self.record)
        try:
            return json.loads(text).get("metadata", {}) if text is not None else None
        except json.JSONDecodeError:
            return None

    def save_sampling(self, frames: list[int], config: dict | None = None) -> None:
        """Which frames were sampled, ascending, and how; a list of frame numbers is small."""
        document = {"num_frames": len(frames), "frames": sorted(frames)} | ({"sampling": config} if config else {})
        files.write_text(self.spark, f"{self.root}/sampling.json", json.dumps(document, indent=2))

    def load_sampling(self) -> dict:
        """The sampling document; a missing or corrupt one is an error."""
        text = files.read_text(self.spark, f"{self.root}/sampling.json")
        if text is None:
            raise FileNotFoundError(f"{self.root}/sampling.json")
        return json.loads(text)

    def clear_incomplete(self) -> None:
        if not self.is_complete():
            files.remove(self.spark, self.root)

    def clear(self) -> None:
        files.remove(self.spark, self.root)

    def save_eval(self, kind: str, results: dict) -> None:
        files.write_text(self.spark, f"{self.root}/eval/{kind}.json", json.dumps(results, indent=2, sort_keys=True))

    def load_eval(self, kind: str) -> dict | None:
        text = files.read_text(self.spark, f"{self.root}/eval/{kind}.json")
        return None if text is None else json.loads(text)

    def save_transform(self, matrix: list[list[float]]) -> None:
        """K7: a 4 by 4 similarity as text of ten decimals, under two lines of comment."""
        head = "# 4x4 similarity transform\n# apply to homogeneous points: aligned = T @ original\n"
        files.write_text(self.spark, f"{self.root}/eval/traj_transform.txt", head + "".join(" ".join(f"{x:.10f}" for x in row) + "\n" for row in matrix))

    def load_transform(self) -> list[list[float]] | None:
        text = files.read_text(self.spark, f"{self.root}/eval/traj_transform.txt")
        return None if text is None else [[float(x) for x in line.split()] for line in text.splitlines() if line and not line.startswith("#")]

    def save_frames(self, pixels: DataFrame, columns: list[str], width: int, height: int) -> None:
        """K4: pixels(frame_idx, px, py, src_width, src_height, columns) resized to one size by the nearest pixel, frames renumbered from 0.

        A source pixel is sent to the pixels that read it. The numbers that frames had before are
        a table beside them. A failed task fails the job, and then the scene has no record.
        """
        self.clear_incomplete()
        ids = pixels.select("frame_idx").distinct()
        ids = ids.withColumn("number", F.row_number().over(Window.orderBy("frame_idx")) - 1)  # one row a frame of one scene
        ids.write.mode("overwrite").parquet(f"{self.root}/frame_index_map")
        span = lambda at, src, dst: (F.ceil(at * dst / src).cast("int"), (F.ceil((at + 1) * dst / src) - 1).cast("int"))
        (x0, x1), (y0, y1) = span(F.col("px"), F.col("src_width"), width), span(F.col("py"), F.col("src_height"), height)
        sent = pixels.where((x0 <= x1) & (y0 <= y1)).withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1)))
        known = self.spark.read.parquet(f"{self.root}/frame_index_map")
        out = sent.join(known, "frame_idx").select(F.col("number").alias("frame"), F.col("x").alias("px"), F.col("y").alias("py"), *columns)
        out.write.mode("overwrite").parquet(f"{self.root}/frames")
        self.mark_complete({"width": width, "height": height, "columns": columns})

    def frames(self) -> DataFrame:
        """The saved pixels, with the numbers that their frames had before."""
        numbers = self.spark.read.parquet(f"{self.root}/frame_index_map").select(F.col("number").alias("frame"), F.col("frame_idx"))
        return self.spark.read.parquet(f"{self.root}/frames").join(numbers, "frame")


def cached(spark: SparkSession, folder: str, parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that `make` gives, kept under a key of its parameters; other parameters make another table."""
    key = hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:24]
    path = f"{folder.rstrip('/')}/{key}"
    if not files.exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: K12, fixed: the head of a table of memory figures.
MEMORY_COLUMNS = ["n_frames", "mode", "peak_mb", "seconds"]


def write_memory_table(rows: DataFrame, path: str) -> None:
    """CSV with a fixed head, in the order of frames and mode; one file, for it is a row a run."""
    ordered = rows.select(*MEMORY_COLUMNS).orderBy("n_frames", "mode").coalesce(1)
    ordered.write.mode("overwrite").option("header", True).csv(path)
