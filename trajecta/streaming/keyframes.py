"""A cache of frames a sequence, kept in the state store: pinned frames, a window of keyframes and their summaries.

Every frame is decided by its pose against the last keyframe's, before anything is written: a
keyframe is committed to the cache and the oldest of the window leaves; any other frame has only
read the cache. The same tracker runs over a stream, with its parts in state variables, and over
a whole table, with them in memory.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trajecta.operators.flow import flow_between
from trajecta.operators.folds import sorted_fold

FRAME_SCHEMA = "seq string, frame_idx long, pose array<double>, u array<double>, v array<double>, depth array<double>, summary array<double>, ends boolean"
#: kind: 0 one of the first frames, 1 keyframe, 2 other, 3 late; n_read frames (this one too) are seen while the frame is decided; evicted frames leave the cache with it
OUT_SCHEMA = "seq string, frame_idx long, kind int, flow double, n_read int, n_pinned int, n_window int, n_summaries long, evicted array<long>, total long"
_OUT = [c.split()[0] for c in OUT_SCHEMA.split(", ")]
SCALE, KEY, OTHER, LATE = range(4)


@dataclass(frozen=True)
class Retention:
    """What stays.

    The first `pinned` frames and the last `window` keyframes after them are live. Where
    keep_pinned is off, the cache fills up to pinned + window, and then only its last `window`
    frames stay. Summaries stay of every committed frame (`all`), of those that left the cache
    between its first `pinned` and its last `window` places (`evicted`), or not at all (`none`);
    with camera_only, only their first number.
    """

    pinned: int = 8
    window: int = 64
    summaries: str = "all"
    camera_only: bool = False
    keep_pinned: bool = True


@dataclass
class Progress:
    """What one sequence keeps beside its cache: the places [low, high) of committed frames that are live after the pinned ones, and the last keyframe."""

    total: int = 0
    last_frame: int = -(2**62)
    low: int = 0
    high: int = 0
    keys: int = 0
    last_key: int = 0
    n_summaries: int = 0
    timer: int = 0
    pose: list[float] = field(default_factory=list)


class MemoryCache:
    """Frames by place, summaries and waiting frames of one sequence, in memory."""

    def __init__(self) -> None:
        self.frames: dict[int, tuple[int, list[float]]] = {}
        self.summaries: list[list[float]] = []
        self.waiting: list[int] = []

    def put(self, place: int, frame: int, summary: list[float]) -> None:
        self.frames[place] = (frame, summary)

    def take(self, place: int) -> tuple[int, list[float]]:
        return self.frames.pop(place)

    def keep(self, summary: list[float]) -> None:
        self.summaries.append(summary)

    def wait(self, frame: int) -> None:
        self.waiting.append(frame)

    def leave(self) -> list[int]:
        out, self.waiting = self.waiting, []
        return out


class Tracker:
    """Takes the frames of one sequence in order; rows() of a call are what is out after it."""

    def __init__(self, progress: Progress, cache, retention: Retention, threshold: float, max_gap: int, camera: tuple[float, float, float, float]) -> None:
        self.p, self.cache, self.keep, self.threshold, self.max_gap, self.camera = progress, cache, retention, threshold, max_gap, camera

    def _row(self, frame: int, kind: int, flow: float | None, n_read: int, evicted: list[int], total: int) -> tuple:
        p, k = self.p, self.keep
        head = min(p.high, k.pinned) if k.keep_pinned else 0
        return (frame, kind, flow, n_read, head, p.high - max(p.low, head), p.n_summaries, evicted, total)

    def _commit(self, frame: int, pose: list[float], summary: list[float]) -> list[int]:
        """Write the frame and evict what the retention lets go; the frames that left."""
        p, k = self.p, self.keep
        own = summary[:1] if k.camera_only else summary
        self.cache.put(p.high, frame, own)
        if k.summaries == "all":
            self.cache.keep(own)
            p.n_summaries += 1
        p.high, p.pose = p.high + 1, list(pose)
        first = max(p.low, k.pinned) if k.keep_pinned else p.low
        full = p.high - first > k.window + (0 if k.keep_pinned else k.pinned)
        if not full:
            return []
        out = []
        upto = p.high - k.window
        for place in range(first, upto):
            old, kept = self.cache.take(place)
            out.append(old)
            if k.summaries == "evicted" and (k.keep_pinned or place >= first + k.pinned):
                self.cache.keep(kept)
                p.n_summaries += 1
        p.low = upto
        return out

    def take(self, frame: int, pose: list[float], u, v, depth, summary: list[float]) -> list[tuple]:
        p, k = self.p, self.keep
        if frame <= p.last_frame:
            return [self._row(frame, LATE, None, 0, [], p.total)]
        p.last_frame, place = frame, p.total
        p.total += 1
        if place < k.pinned:
            self._commit(frame, pose, summary)
            p.last_key = place
            self.cache.wait(frame)
            return self.flush() if p.total == k.pinned else []
        n_read = p.high - p.low + (min(p.low, k.pinned) if k.keep_pinned else 0) + 1
        flow = flow_between(*(np.asarray(m, dtype=np.float64).reshape(3, 4) for m in (pose, p.pose)), *(np.asarray(x, dtype=np.float64) for x in (u, v, depth)), self.camera) if p.pose else 0.0
        if p.keys and flow <= self.threshold and place - p.last_key < self.max_gap:
            return [self._row(frame, OTHER, flow, n_read, [], p.total)]
        evicted = self._commit(frame, pose, summary)
        p.last_key, p.keys = place, p.keys + 1
        return [self._row(frame, KEY, flow, n_read, evicted, p.total)]

    def flush(self) -> list[tuple]:
        """The first frames, together; fewer than `pinned` where the sequence ends early."""
        waiting = self.cache.leave()
        return [self._row(f, SCALE, 0.0, len(waiting), [], i + 1) for i, f in enumerate(waiting)]


class StoredCache:
    """The same over state variables: a map of live frames by place, and lists of summaries and of waiting frames."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getMapState("frames", "place long", "frame long, summary array<double>")
        self.summaries = handle.getListState("summaries", "summary array<double>")
        self.waiting = handle.getListState("waiting", "frame long")

    def put(self, place: int, frame: int, summary: list[float]) -> None:
        self.frames.updateValue((place,), (frame, summary))

    def take(self, place: int) -> tuple[int, list[float]]:
        frame, summary = self.frames.getValue((place,))
        self.frames.removeKey((place,))
        return int(frame), list(summary)

    def keep(self, summary: list[float]) -> None:
        self.summaries.appendValue((summary,))

    def wait(self, frame: int) -> None:
        self.waiting.appendValue((frame,))

    def leave(self) -> list[int]:
        out = [int(f) for (f,) in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        return out

    def clear(self) -> None:
        for part in (self.frames, self.summaries, self.waiting):
            part.clear()


def _present(frames: pd.DataFrame) -> Iterator[tuple]:
    for row in frames.itertuples(index=False):
        yield row, [] if row.summary is None else [float(x) for x in row.summary]


class KeyframeProcessor(StatefulProcessor):
    def __init__(self, retention: Retention, threshold: float, max_gap: int, camera: tuple, idle_ms: int, remember_ms: int | None) -> None:
        self.options, self.idle_ms, self.remember_ms = (retention, threshold, max_gap, camera), idle_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.cache = handle, StoredCache(handle)
        self.progress = handle.getValueState("progress", "total long, last_frame long, low long, high long, keys long, last_key long, n_summaries long, timer long, pose array<double>")
        #: the last frame of a sequence that has ended, for as long as it is remembered
        self.ended = handle.getValueState("ended", "last_frame long", ttlDurationMs=self.remember_ms) if self.remember_ms else None

    def _load(self) -> Progress:
        if self.progress.exists():
            got = self.progress.get()
            return Progress(*map(int, got[:-1]), [float(x) for x in got[-1]])
        start = Progress()
        if self.ended is not None and self.ended.exists():
            start.last_frame = int(self.ended.get()[0])
        return start

    def _end(self, p: Progress) -> None:
        if p.timer:
            self.handle.deleteTimer(p.timer)
        self.progress.clear()
        self.cache.clear()
        if self.ended is not None:
            self.ended.update((p.last_frame,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("frame_idx", kind="stable")
        p, out = self._load(), []
        for row, summary in _present(frames):
            tracker = Tracker(p, self.cache, *self.options)
            out += tracker.take(int(row.frame_idx), row.pose, row.u, row.v, row.depth, summary)
            if row.ends is True or row.ends is np.True_:
                out += tracker.flush()
                self._end(p)
                p = self._load()
        if p.total:
            if p.timer:
                self.handle.deleteTimer(p.timer)
            p.timer = (timerValues.getCurrentProcessingTimeInMs() or int(time.time() * 1000)) + self.idle_ms
            self.handle.registerTimer(p.timer)
            self.progress.update((p.total, p.last_frame, p.low, p.high, p.keys, p.last_key, p.n_summaries, p.timer, p.pose))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.progress.exists():
            return
        p = self._load()
        p.timer = 0
        out = Tracker(p, self.cache, *self.options).flush()
        self._end(p)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=_OUT)

    def close(self) -> None:
        pass


def keyframe_stream(
    frames: DataFrame, camera: tuple[float, float, float, float], retention: Retention = Retention(), threshold: float = 1.0, max_gap: int = 30,
    idle_ms: int = 60_000, remember_ms: int | None = None,
) -> DataFrame:
    """Streaming frames(seq, frame_idx, pose, u, v, depth, summary, ends) with each one's kind and what it does to the cache.

    The state of a sequence is at most pinned + window frames, its summaries as the retention
    says, and one last keyframe. It goes when a frame `ends` the sequence or none has come for
    idle_ms; first frames that still wait come out then. A frame at or before the last one that
    was taken is late: it comes out as such, and changes nothing. After an end the sequence
    starts anew (T11); with remember_ms, late frames of the ended one are still told for so long.
    Rows of one sequence in one micro-batch are sorted in memory, so triggers bound them. Needs
    the RocksDB state store.
    """
    processor = KeyframeProcessor(retention, threshold, max_gap, camera, idle_ms, remember_ms)
    return frames.groupBy("seq").transformWithStateInPandas(processor, OUT_SCHEMA, "Append", "ProcessingTime")


def keyframe_replay(
    frames: DataFrame, camera: tuple[float, float, float, float], retention: Retention = Retention(), threshold: float = 1.0, max_gap: int = 30, by: str = "seq"
) -> DataFrame:
    """The same rows from a whole table; sequences end with their last frame, `ends` is not read."""

    def start() -> Tracker:
        return Tracker(Progress(), MemoryCache(), retention, threshold, max_gap, camera)

    def step(t: Tracker, row) -> list[tuple]:
        return t.take(int(row.frame_idx), row.pose, row.u, row.v, row.depth, [] if row.summary is None else list(row.summary))

    finish: Callable[[Tracker], list[tuple]] = Tracker.flush
    schema = OUT_SCHEMA.removeprefix("seq string, ")
    return sorted_fold(frames.select(by, "frame_idx", "pose", "u", "v", "depth", "summary"), [by], ["frame_idx"], start, step, schema, finish)
