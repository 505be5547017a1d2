"""Structured Streaming over frame events with bounded state (T1-T6, T10-T12), and the batch replay of each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trajecta.operators.folds import sorted_fold

EVENT_SCHEMA = "seq string, frame_idx long, flow double"
OUT_SCHEMA = "seq string, frame_idx long, phase string, is_key boolean, n_pinned int, n_window int, n_evicted long, total long"
#: position, gap, flow since the keyframe, keyframes so far, frames that wait for the first batch
STATE_SCHEMA = "position long, gap long, moved double, kept long, waiting array<long>"


@dataclass
class SequenceState:
    """What one sequence keeps: five numbers and at most `pinned` waiting frames."""

    position: int = 0
    gap: int = 0
    moved: float = 0.0
    kept: int = 0
    waiting: list[int] = field(default_factory=list)

    def flush(self) -> list[tuple]:
        """The first frames, together; fewer than `pinned` where the sequence ends early."""
        out = [(f, "first", True, len(self.waiting), 0, 0, i + 1) for i, f in enumerate(self.waiting)]
        self.waiting = []
        return out

    def take(self, frame: int, flow: float, pinned: int, window: int, threshold: float, max_gap: int) -> list[tuple]:
        """Rows that are out after one more frame.

        T1: the first `pinned` frames wait and leave together; later ones leave one by one. T2 / T3:
        pinned frames and the last `window` keyframes are live, older ones are evicted and only
        counted. T4 / T5: a frame that is no keyframe reads the state and does not change it: it is
        decided before anything is written. The first streamed frame is a keyframe.
        """
        first = self.position == pinned
        self.position += 1
        if self.position <= pinned:
            self.waiting.append(frame)
            self.kept += 1
            return self.flush() if self.position == pinned else []
        early = self.flush()
        self.gap, self.moved = self.gap + 1, self.moved + flow
        key = first or self.moved > threshold or self.gap >= max_gap
        if key:
            self.gap, self.moved, self.kept = 0, 0.0, self.kept + 1
        live = min(self.kept - pinned, window)
        return [*early, (frame, "stream", key, pinned, live, self.kept - pinned - live, self.position)]


_COLUMNS = ["seq", "frame_idx", "phase", "is_key", "n_pinned", "n_window", "n_evicted", "total"]


def bounded_stream(
    events: DataFrame, pinned: int = 8, window: int = 64, threshold: float = 1.0, max_gap: int = 30, idle_ms: int = 60_000
) -> DataFrame:
    """Streaming frames keyed by sequence; a new sequence (T11) starts with empty state.

    `flow` is each frame's motion against the frame before it. After idle_ms without a new frame
    a sequence has ended: first frames that wait for others leave, and its state goes. Decisions
    by poses, and a cache of frames, are in keyframe_stream.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = SequenceState(*state.get) if state.exists else SequenceState()
        now.waiting = list(now.waiting)
        if state.hasTimedOut:
            out = now.flush()
            state.remove()
        else:
            frames = sorted((int(f), float(x)) for b in batches for f, x in zip(b["frame_idx"], b["flow"], strict=True))
            out = [r for f, x in frames for r in now.take(f, x, pinned, window, threshold, max_gap)]
            state.update((now.position, now.gap, now.moved, now.kept, now.waiting))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=_COLUMNS)

    return events.groupBy("seq").applyInPandasWithState(run, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.ProcessingTimeTimeout)


def bounded_replay(events: DataFrame, pinned: int = 8, window: int = 64, threshold: float = 1.0, max_gap: int = 30) -> DataFrame:
    """The same rows from a whole table, every frame of every sequence."""

    def step(state: SequenceState, row) -> list[tuple]:
        return state.take(int(row.frame_idx), float(row.flow), pinned, window, threshold, max_gap)

    schema = OUT_SCHEMA.removeprefix("seq string, ")
    return sorted_fold(events.select("seq", "frame_idx", "flow"), ["seq"], ["frame_idx"], SequenceState, step, schema, SequenceState.flush)


def live_state(df: DataFrame, by: list[str], order: list[str], pinned: int, window: int) -> DataFrame:
    """T2 without Python: after each frame, the number of pinned, live and evicted frames (every frame a keyframe)."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    later = F.greatest(n - pinned, F.lit(0))
    return df.withColumn("n_pinned", F.least(n, F.lit(pinned))).withColumn("n_window", F.least(later, F.lit(window))).withColumn(
        "n_evicted", F.greatest(later - window, F.lit(0))
    ).withColumn("total", n)


def odometry(commands: DataFrame, by: list[str], order: str) -> DataFrame:
    """Pose after each (turn, forward) command of a key, from the origin; x and y are rounded to 4 digits and yaw to 2 as they are given out.

    Headings and positions are running sums, so a key's commands meet in one sort and no state is gathered.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turned = commands.withColumn("yaw", F.pmod(F.sum("turn").over(w), F.lit(360.0)))
    x, y = (F.sum(F.col("forward") * f(F.radians("yaw"))).over(w) for f in (F.cos, F.sin))
    return turned.select(*by, order, (F.round(x, 4) + 0.0).alias("x"), (F.round(y, 4) + 0.0).alias("y"), F.round("yaw", 2).alias("yaw"))


def navigation_state(events: DataFrame, by: list[str], order: str) -> DataFrame:
    """IDLE, GOAL_SELECTED, NAVIGATING or STOP after each of the events goal, start, stop; other events change nothing."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    said = F.when(F.col("event").isin("goal", "start", "stop"), F.col("event"))
    last, goal = F.last(said, True).over(w), F.max(F.when(F.col("event") == "goal", 1)).over(w)
    state = F.when(last == "goal", "GOAL_SELECTED").when((last == "start") & goal.isNotNull(), "NAVIGATING").when(last == "stop", "STOP").otherwise("IDLE")
    return events.withColumn("state", state)


def snapshots(stream: DataFrame, path: str, checkpoint: str, by: list[str], order: str, seconds: int = 1, keep: int = 2):
    """Keep the latest row of each key as a small table that readers poll.

    A batch writes a folder of its own number, so a batch that runs twice gives the same folder;
    the last `keep` stay, for readers that have just begun. current() finds the last whole one.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = _newest(spark, path, below=number)
        both = batch if last is None else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/{last}"))
        latest = both.groupBy(*by).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{path}/{number}")
        for old in _numbers(spark, path):
            if old <= number - keep:
                where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}")
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} second").start()


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose folders are whole, by Hadoop's listing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def _newest(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    found = [n for n in _numbers(spark, path) if below is None or n < below]
    return found[-1] if found else None


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """What a reader sees now: the last whole snapshot, None before the first."""
    number = _newest(spark, path)
    return None if number is None else spark.read.parquet(f"{path}/{number}")
