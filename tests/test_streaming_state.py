"""The frame cache in the state store: contents, eviction, rollback, ends, idle sequences, late frames."""

import math
import random
import time

import pytest
from pyspark.sql import SparkSession

from trajecta.operators import flow as fl
from trajecta.streaming.keyframes import FRAME_SCHEMA, KEY, LATE, OTHER, SCALE, MemoryCache, Progress, Retention, Tracker, keyframe_replay, keyframe_stream

CAMERA = (40.0, 36.0, 16.0, 12.0)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def turned(rnd):
    """A rotation about any axis as three rows."""
    a, b, t = rnd.uniform(0, math.pi), rnd.uniform(0, 2 * math.pi), rnd.uniform(-0.08, 0.08)
    x, y, z = math.sin(a) * math.cos(b), math.sin(a) * math.sin(b), math.cos(a)
    c, s = math.cos(t), math.sin(t)
    return [[c + x * x * (1 - c), x * y * (1 - c) - z * s, x * z * (1 - c) + y * s], [y * x * (1 - c) + z * s, c + y * y * (1 - c), y * z * (1 - c) - x * s], [z * x * (1 - c) - y * s, z * y * (1 - c) + x * s, c + z * z * (1 - c)]]


def frames_of(seq, n, rnd, ends=False):
    out, r, t = [], [[1, 0, 0], [0, 1, 0], [0, 0, 1]], [0.0, 0.0, 0.0]
    for i in range(n):
        m = turned(rnd)
        r = [[sum(r[a][k] * m[k][b] for k in range(3)) for b in range(3)] for a in range(3)]
        t = [x + rnd.uniform(-0.1, 0.3) for x in t]
        pose = [float(x) for a in range(3) for x in (*r[a], t[a])]
        out.append((seq, i, pose, [0.0, 8.0, 16.0], [0.0, 8.0, 8.0], [3.0, 0.0, 5.0 + i % 3], [float(i), 1.0], ends and i == n - 1))
    return out


@pytest.fixture
def rocks(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def test_a_hundred_frames_leave_the_pinned_and_the_last_ones():
    cache, p = MemoryCache(), Progress()
    t = Tracker(p, cache, Retention(8, 64), -1.0, 30, CAMERA)
    rows = [r for f in frames_of("s", 100, random.Random(1)) for r in t.take(f[1], *f[2:6], f[6] * 3)]
    assert sorted(f for f, _ in cache.frames.values()) == [*range(8), *range(36, 100)]
    assert rows[-1][4:7] == (8, 64, 100) and [r[7] for r in rows[-28:]] == [[k] for k in range(8, 36)]
    assert len(cache.summaries) == 100 and sum(map(len, cache.summaries)) == 600


@pytest.mark.parametrize("keep_pinned", [True, False])
@pytest.mark.parametrize("summaries", ["all", "evicted", "none"])
def test_retention_is_what_a_list_gives(keep_pinned, summaries):
    s, w = 3, 5
    keep = Retention(s, w, summaries, camera_only=summaries == "evicted", keep_pinned=keep_pinned)
    cache = MemoryCache()
    t = Tracker(Progress(), cache, keep, -1.0, 30, CAMERA)
    live, told = [], []
    for f in frames_of("s", 40, random.Random(2)):
        rows = t.take(f[1], *f[2:7])
        live.append(f[1])
        if summaries == "all":
            told.append(f[6])
        if len(live) > s + w:
            if summaries == "evicted":
                told += [[float(k)] for k in live[s : len(live) - w]]
            live = (live[:s] if keep_pinned else []) + live[-w:]
        assert [cache.frames[k][0] for k in sorted(cache.frames)] == live and cache.summaries == told
        assert not rows or (rows[-1][4] + rows[-1][5], rows[-1][6]) == (len(live), len(told))


def write(spark, rows, path):
    spark.createDataFrame(rows, FRAME_SCHEMA).coalesce(1).write.parquet(path, mode="append")


def until(name, n, q, what=None):
    """Wait until as many rows are out, or what() is so."""
    seen = what or (lambda: SparkSession.getActiveSession().table(name).count())
    limit = time.time() + 120
    while time.time() < limit and seen() != n and q.isActive:
        time.sleep(0.5)
    assert seen() == n


def run(spark, tmp_path, name, **options):
    frames = spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = keyframe_stream(frames, CAMERA, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c")
    return out


def test_stream_keyframes_replay_and_stored_frames(spark, rocks, tmp_path):
    rnd = random.Random(8)
    rows = [f for k in range(3) for f in frames_of(f"s{k}", 40 - 6 * k, rnd)]
    for part in range(4):
        write(spark, [r for r in rows if r[1] // 10 == part], f"{tmp_path}/in")
    keep = Retention(4, 5, "evicted")
    q = run(spark, tmp_path, "cached", retention=keep, threshold=4.0, max_gap=6).start()
    until("cached", len(rows), q)
    q.stop()
    live = sorted(tuple(r) for r in spark.table("cached").collect())
    assert live == sorted(tuple(r) for r in keyframe_replay(spark.createDataFrame(rows, FRAME_SCHEMA), CAMERA, keep, 4.0, 6).collect())
    batch = spark.createDataFrame(rows, FRAME_SCHEMA)
    by_flow = sorted((r.seq, r.frame_idx, r.kind, round(r.flow, 9)) for r in fl.flow_keyframes(batch, ["seq"], CAMERA, 4, 4.0, 6).collect())
    assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in live) == by_flow
    assert {r[2] for r in live} == {SCALE, KEY, OTHER}
    stored = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "frames").load().collect()
    for k in range(3):
        keys = [r[1] for r in live if r[0] == f"s{k}" and r[2] != OTHER]
        held = {r["user_map_value"]["frame"] for r in stored if r["key"]["seq"] == f"s{k}"}
        assert held == set(keys[:4] + keys[4:][-5:])  # frames that were no keyframes were never written


def test_ended_idle_and_late(spark, rocks, tmp_path):
    rnd = random.Random(4)
    whole, idle, short = frames_of("whole", 12, rnd, ends=True), frames_of("idle", 9, rnd), frames_of("short", 2, rnd)
    write(spark, whole[:7] + idle[:5] + short, f"{tmp_path}/in")
    q = run(spark, tmp_path, "ends", retention=Retention(4, 3), threshold=0.0, idle_ms=4000).trigger(processingTime="1 second").start()

    try:
        until("ends", 7 + 5 + 2, q)  # the short sequence comes out when it has been idle
        until("ends", 0, q, lambda: rows_of(q))
        write(spark, [*whole[7:10], whole[3], whole[2]], f"{tmp_path}/in")  # its state has gone, so it starts anew, with 2 and 3
        until("ends", 14 + 5, q)
        write(spark, [whole[8], whole[10], whole[11]], f"{tmp_path}/in")
        until("ends", 14 + 5 + 3, q)
        until("ends", 0, q, lambda: rows_of(q))
    finally:
        q.stop()
    kinds = {(r.seq, r.frame_idx, r.kind) for r in spark.table("ends").collect()}
    assert ("whole", 8, LATE) in kinds and ("whole", 11, KEY) in kinds and ("short", 1, SCALE) in kinds and ("whole", 9, KEY) in kinds


def rows_of(q):
    """Rows in the state store after the last trigger that has told."""
    last = q.lastProgress
    return last["stateOperators"][0]["numRowsTotal"] if last else -1


def test_an_ended_sequence_is_remembered_for_a_while(spark, rocks, tmp_path):
    rows = frames_of("s", 9, random.Random(3), ends=True)
    write(spark, rows, f"{tmp_path}/in")
    write(spark, [rows[4]], f"{tmp_path}/in")
    q = run(spark, tmp_path, "remembered", retention=Retention(2, 3), threshold=0.0, remember_ms=600_000).start()
    until("remembered", 10, q)
    q.stop()
    got = sorted((r.frame_idx, r.kind) for r in spark.table("remembered").collect())
    assert got.count((4, LATE)) == 1 and len(got) == 10


def test_repeated_frames_are_late_in_a_replay(spark):
    rows = frames_of("s", 10, random.Random(5))
    got = keyframe_replay(spark.createDataFrame([*rows, rows[3]], FRAME_SCHEMA), CAMERA, Retention(4, 3), 0.0, 30).orderBy("frame_idx", "kind").collect()
    assert [(r.frame_idx, r.kind) for r in got if r.kind == LATE] == [(3, LATE)] and len(got) == 11
