"""Robust similarity alignment: random hypotheses, scored by one aggregate over all pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.operators.alignment import align
from trajecta.operators.lineage import cut
from trajecta.operators.quantiles import meet_groups, same_groups

SPOTS = ["sx", "sy", "sz", "tx", "ty", "tz"]
#: numbers of a hypothesis: scale, then the rows of (R | t)
WIDTH = 13
#: pairs of a group that one task scores
CHUNK = 100_000


def fit_triples(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Least-squares similarities of k triples of points, arrays (k, 3, 3), as rows of scale and (R | t)."""
    ms, mt = source.mean(axis=1, keepdims=True), target.mean(axis=1, keepdims=True)
    s, t = source - ms, target - mt
    cov = np.einsum("kia,kib->kab", t, s) / 3
    var = (s**2).sum(axis=(1, 2)) / 3
    u, d, vt = np.linalg.svd(cov)
    sign = np.ones((len(cov), 3))
    sign[np.linalg.det(u) * np.linalg.det(vt) < 0, 2] = -1
    rot = np.einsum("kab,kb,kbc->kac", u, sign, vt)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(var > 0, (d * sign).sum(axis=1) / var, 1.0)
    shift = mt[:, 0] - scale[:, None] * np.einsum("kab,kb->ka", rot, ms[:, 0])
    return np.concatenate([scale[:, None], np.concatenate([rot, shift[:, :, None]], axis=2).reshape(-1, 12)], axis=1)


#: distances that are computed in one go, so that small groups take few calls
AT_ONCE = 1 << 17


def inliers(hypotheses: np.ndarray, source: np.ndarray, target: np.ndarray, threshold: float) -> np.ndarray:
    """Numbers of pairs nearer than the threshold, one a hypothesis."""
    out = np.zeros(len(hypotheses), dtype=np.int64)
    together = max(1, AT_ONCE // max(1, len(source)))
    for at in range(0, len(hypotheses), together):
        h = hypotheses[at : at + together]
        m = h[:, 1:].reshape(-1, 3, 4)
        d = h[:, 0, None, None] * (source @ m[:, :, :3].transpose(0, 2, 1)) + m[:, None, :, 3] - target
        out[at : at + together] = np.count_nonzero(np.einsum("kij,kij->ki", d, d) < threshold**2, axis=1)
    return out


def tries_needed(share: float, confidence: float) -> float:
    """Samples of three after which one of inliers only was drawn with this confidence."""
    good = share**3
    if good >= 1:
        return 0.0
    return math.log(1 - confidence) / math.log1p(-good) if good > 0 else math.inf


def _propose(by: list[str], batch: int, seed: int):
    """Rows of a group's pool, as lists, to a row of its hypotheses; a task takes many groups at once."""

    def picked(pool: np.ndarray) -> np.ndarray | None:
        spots = pool[np.argsort(pool[:, -1], kind="stable"), :-1]
        rng = np.random.default_rng([seed, len(spots)])
        picks = np.argsort(rng.random((batch, len(spots))), axis=1)[:, :3] if len(spots) <= 64 else rng.permutation(len(spots))[: len(spots) // 3 * 3].reshape(-1, 3)[:batch]
        if picks.shape[1] < 3:
            return None
        h = fit_triples(spots[picks][:, :, :3], spots[picks][:, :, 3:])
        return h[np.isfinite(h).all(axis=1)].ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = [rows.column(c) for c in (*SPOTS, "_turn")]
            ends = np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))
            found = [picked(p) for p in np.split(np.stack([c.flatten().to_numpy() for c in lists], axis=1), ends[:-1])] if len(ends) else []
            made = pa.array(found, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in by], made], names=[*by, "_h"]).filter(made.is_valid())

    return run


def _score(by: list[str], threshold: float):
    """Rows of a chunk come after its hypotheses; counts come out a batch and chunk, to be summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, own = None, None
        for batch in batches:
            keys = list(zip(*[batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in by], batch["_chunk"].tolist(), strict=True))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            spots, models, ats, goods = batch[SPOTS].to_numpy(float), batch["_h"].tolist(), [], []
            for a, b in zip(starts, starts[1:], strict=False):
                first = a
                if models[a] is not None:
                    held, own, first = np.asarray(models[a], dtype=float).reshape(-1, WIDTH), keys[a], a + 1
                if first < b and own == keys[a] and len(held):
                    ats.append(a)
                    goods.append(inliers(held, spots[first:b, :3], spots[first:b, 3:], threshold))
            if ats:
                out = batch[by].iloc[np.repeat(ats, [len(g) for g in goods])].reset_index(drop=True)
                yield out.assign(_k=np.concatenate([np.arange(len(g)) for g in goods]), _good=np.concatenate(goods))

    return run


def residual(scale: Column, m: Column) -> Column:
    """Distance of a pair after the similarity."""
    d = [scale * (m[4 * i] * F.col("sx") + m[4 * i + 1] * F.col("sy") + m[4 * i + 2] * F.col("sz")) + m[4 * i + 3] - F.col(c) for i, c in enumerate(("tx", "ty", "tz"))]
    return F.sqrt(d[0] ** 2 + d[1] ** 2 + d[2] ** 2)


def align_robust(pairs: DataFrame, by: list[str], threshold: float, iterations: int = 100_000, confidence: float = 0.999, seed: int = 0, batch: int = 128) -> DataFrame:
    """(by, scale, n_inliers, align, tries) of pairs(by, sx, sy, sz, tx, ty, tz): the similarity that most pairs agree with, fitted to these.

    Rounds of `batch` hypotheses, each round's twice as many up to 1024, are fitted to triples of
    a random pool of pairs (a few thousand rows a group), and scored on all pairs of the group,
    which are dealt over tasks in chunks. A group is done when its best share of pairs under the
    threshold makes a better one unlikely by `confidence`, or after `iterations`. Where fewer
    than three pairs agree, scale and align are null. Null keys are a group like others; pairs
    with null or nan coordinates never agree.
    """
    rows = pairs.select(*by, *[F.col(c).cast("double").alias(c) for c in SPOTS])
    for c in SPOTS:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c))
    kinds = "".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}, " for c in by)
    counts = cut(pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    n_groups = counts.count()
    state = cut(counts.select("*", F.lit(0).cast("long").alias("_best"), F.lit(0).cast("long").alias("_tried"), F.lit(None).cast("array<double>").alias("_model")))
    need = F.log(F.lit(1 - confidence)) / F.log1p(-F.least(F.pow(F.col("_best") / F.col("_n"), 3), F.lit(1 - 1e-15)))
    open_ = (F.col("_n") >= 3) & (F.col("_tried") < iterations) & ((F.col("_best") < 3) | (F.col("_tried") < need))
    step = 0
    while not (todo := cut(state.where(open_))).isEmpty():
        size = min(batch << min(step, 10), 1024)
        share = F.least(F.lit(6.0 * size) / F.col("_n"), F.lit(1.0))
        met = meet_groups(rows, todo.select(*by, "_n"), by, n_groups).withColumn("_turn", F.rand(seed * 1009 + step + 1))
        pool = met.where(F.col("_turn") < share)
        listed = pool.groupBy(*by).agg(*[F.collect_list(c).alias(c) for c in (*SPOTS, "_turn")])
        models = cut(listed.mapInArrow(_propose(by, size, seed + step), f"{kinds}_h array<double>"))
        chunks = F.ceil(F.col("_n") / CHUNK).cast("int")
        given = same_groups(models, todo.select(*by, "_n"), by).select(*by, F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_chunk"), "_h", *[F.lit(None).cast("double").alias(c) for c in SPOTS])
        dealt = met.select(*by, F.floor(F.rand(seed + 7) * chunks).cast("int").alias("_chunk"), F.lit(None).cast("array<double>").alias("_h"), *SPOTS)
        both = given.unionByName(dealt).repartition(*by, "_chunk").sortWithinPartitions(*by, "_chunk", F.col("_h").isNull())
        scores = both.mapInPandas(_score(by, threshold), f"{kinds}_k int, _good long").groupBy(*by, "_k").agg(F.sum("_good").alias("_good"))
        top = scores.groupBy(*by).agg(F.max(F.struct("_good", (-F.col("_k")).alias("k"))).alias("_top"))
        tops = same_groups(models, top, by, "left").select(*by, F.coalesce("_top.k", F.lit(0)).alias("_k"), F.coalesce("_top._good", F.lit(0)).alias("_now"), "_h")
        tops = tops.select(*by, "_now", F.slice("_h", -F.col("_k") * WIDTH + 1, WIDTH).alias("_new"), (F.size("_h") / WIDTH).cast("long").alias("_more"))
        new = same_groups(state, tops, by, "left")
        better, tried = F.coalesce(F.col("_now") > F.col("_best"), F.lit(False)), F.when(open_, F.greatest(F.coalesce("_more", F.lit(0)), F.lit(size))).otherwise(0)
        state = cut(new.select(*by, "_n", F.when(better, F.col("_now")).otherwise(F.col("_best")).alias("_best"), (F.col("_tried") + tried).alias("_tried"), F.when(better, F.col("_new")).otherwise(F.col("_model")).alias("_model")))
        step += 1
    known = state.where("_best >= 3").select(*by, F.col("_model")[0].alias("_scale"), F.slice("_model", 2, 12).alias("_m"))
    agreeing = meet_groups(rows, known, by, n_groups).where(residual(F.col("_scale"), F.col("_m")) < threshold)
    fitted = align(agreeing.select(*by, *SPOTS), by)
    out = same_groups(state, fitted, by, "left")
    return out.select(*by, "scale", F.col("_best").alias("n_inliers"), "align", F.col("_tried").alias("tries"))
