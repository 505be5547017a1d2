"""Exact quantiles by bucket counts against the built-in aggregates and numpy, over hard values and large groups."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.operators import quantiles as qs
from trajecta.operators.clouds import bounds_and_scale, confident, depth_range
from trajecta.operators.metrics import align_depth, depth_ratio_scale
from trajecta.operators.quantiles import Quantile, quantiles

INF = float("inf")


def values(rnd, n, kind):
    if kind == "even":
        return [rnd.random() * 10 for _ in range(n)]
    if kind == "far":
        return [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300) for _ in range(n)]
    if kind == "ties":
        return [float(rnd.choice([1, 1, 1, 2, 5])) for _ in range(n)]
    if kind == "near":
        return [math.nextafter(1.0, 2.0) if rnd.random() < 0.5 else 1.0 + rnd.randrange(5) * 2.0**-50 for _ in range(n)]
    return [rnd.choice([None, INF, -INF, 0.0, -0.0, rnd.gauss(0, 1), 5e-324]) for _ in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(6)
    rows = [(None if k == "ties" else k, v, rnd.gauss(0, 3)) for k in ("even", "far", "ties", "near", "odd") for v in values(rnd, 4000, k)]
    rows += [("small", float(v), 1.0) for v in range(7)] + [("none", None, 2.0)] * 3
    return spark.createDataFrame(rnd.sample(rows, len(rows)), "g string, x double, y double").repartition(7)


WANTED = {"a": Quantile("x", 0.05), "b": Quantile("x", 0.5), "c": Quantile("y", 0.99), "d": Quantile("x", 0.5, lower=True), "e": Quantile("x", 0.0), "f": Quantile("x", 1.0)}


def plain(df, by):
    return df.groupBy(*by).agg(*[q.aggregate().alias(n) for n, q in WANTED.items()])


def same(a, b):
    """nan, as infinite neighbours give, is nan on both sides."""
    return a == b or a is not None and b is not None and (math.isnan(a) and math.isnan(b) or a == pytest.approx(b, rel=1e-15))


@pytest.mark.parametrize(("buckets", "broadcast_rows"), [(64, qs.BROADCAST_ROWS), (4096, 0)])
def test_groups_are_as_the_aggregates_say(table, monkeypatch, buckets, broadcast_rows):
    monkeypatch.setattr(qs, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(qs, "MAX_PASSES", 12 if buckets > 64 else 20)
    got = {r.g: r.asDict() for r in quantiles(table, ["g"], WANTED, exact_rows=20, buckets=buckets).collect()}
    want = {r.g: r.asDict() for r in plain(table, ["g"]).collect()}
    assert set(got) == set(want)
    for g, row in want.items():
        assert all(same(got[g][n], row[n]) for n in WANTED), (g, got[g], row)


def test_one_group_of_everything(table):
    fine = table.where("x is null or abs(x) < 1e308")
    got, want = quantiles(fine, [], WANTED, exact_rows=50).first(), plain(fine, []).first()
    assert all(same(got[n], want[n]) for n in WANTED)
    assert quantiles(fine.limit(0), [], WANTED).first()["a"] is None


def test_nan_is_the_greatest(spark):
    df = spark.createDataFrame([(float("nan") if k % 10 == 0 else float(k),) for k in range(1000)], "x double")
    got = quantiles(df, [], {"m": Quantile("x", 0.5), "top": Quantile("x", 0.95, lower=True)}, exact_rows=10).first()
    fine = sorted(float(k) for k in range(1000) if k % 10)
    assert got.m == (fine[499] + fine[500]) / 2 and math.isnan(got.top)


def test_buffers_stay_bounded(spark):
    """No plan gathers a large group: passes count by bucket, and what is gathered in the end is few."""
    df = spark.range(0, 300_000, numPartitions=6).select((F.col("id") % 7).alias("g"), F.rand(3).alias("x"))
    out = quantiles(df, ["g"], {"m": Quantile("x", 0.3)}, exact_rows=1000)
    got = {r.g: r.m for r in out.collect()}
    rows = {}
    for r in df.collect():
        rows.setdefault(r.g, []).append(r.x)
    assert got == pytest.approx({g: np.percentile(v, 30) for g, v in rows.items()})
    plan = quantiles(df.where("g = 3"), [], {"m": Quantile("x", 0.3)}, exact_rows=1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_operators_keep_their_rows_when_groups_are_large(spark, monkeypatch):
    rnd = random.Random(2)
    px = spark.createDataFrame([(k % 3, 1 + rnd.random(), 2 + rnd.random(), rnd.random()) for k in range(1500)], "frame int, gt double, pred double, confidence double")
    px = px.withColumns({"depth": F.col("gt"), "x": F.col("gt"), "y": F.col("pred"), "z": F.col("confidence"), "anchor": F.col("gt"), "target": F.col("pred")})
    run = {
        "p4": lambda: confident(px, [], 30.0), "p5": lambda: confident(px, ["frame"], 30.0), "a14": lambda: bounds_and_scale(px, ["frame"]), "a19": lambda: depth_range(px, ["frame"]),
        "a16": lambda: align_depth(px, ["frame"]), "a17": lambda: align_depth(px, ["frame"], "lstsq"), "a23": lambda: depth_ratio_scale(px, ["frame"]),
    }
    before = {n: sorted(map(tuple, f().collect())) for n, f in run.items()}
    monkeypatch.setattr(qs.quantiles, "__defaults__", (100, 4096))
    for n, f in run.items():
        for a, b in zip(before[n], sorted(map(tuple, f().collect())), strict=True):
            assert a == pytest.approx(b), n
