"""Operator 8: toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.llm.common import frugal, frugal_on_driver, id_fold, read_table

_WORD = re.compile(r"[^\W\d_]+")
PREFIX = 5


def features_of(text: str | None) -> set[str]:
    """Distinct lower-case words, and the first letters of longer words as "stem*"."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        """Probability-like score of one whole text; the sum does not depend on the order of its words."""
        z = math.fsum([self.bias, *map(self.weights.__getitem__, features_of(text) & self.weights.keys())])
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def risk_and_gradient(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative PU risk of the logistic loss, and the descent direction by each positive and each unlabelled score.

    risk = prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]). While the second
    part is negative, its reversed gradient is the direction.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    gu, gp = sigmoid(zu) / len(zu), -prior * sigmoid(zp) / len(zp)
    risk = prior * np.logaddexp(0, -zp).mean() + max(0.0, rest)
    return float(risk), (gp - prior * sigmoid(-zp) / len(zp) if rest >= 0 else -gp), (gu if rest >= 0 else -gu)


def nn_pu_fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], words: list[str], prior: float, max_features: int = 4000, min_positive: int = 4,
    min_purity: float = 0.6, steps: int = 600, rate: float = 0.05, l2: float = 1e-4,
) -> Classifier:
    """A linear logistic classifier under the non-negative PU risk, from the places in `words` of each text's features.

    Features are the words and stems that positives hold significantly oftener than unlabelled
    texts do, and whose holders are toxic by a share of min_purity at least, as the prior and
    the two rates tell.
    """
    n_p, n_u = max(len(positive), 1), max(len(unlabelled), 1)
    flat = [np.concatenate([np.zeros(0, dtype=np.int32), *texts]) for texts in (positive, unlabelled)]
    held = [np.repeat(np.arange(len(texts)), [len(t) for t in texts]) for texts in (positive, unlabelled)]
    count_p, count_u = (np.bincount(f, minlength=len(words)) for f in flat)
    rate_p, rate_u = count_p / n_p, count_u / n_u
    purity = prior * rate_p / np.maximum(np.maximum(rate_u, prior * rate_p), 1e-300)  # share of toxic texts among those that hold it
    noise = np.sqrt(np.maximum(rate_u, 1 / n_u) / n_p)
    fit = np.flatnonzero((count_p >= min_positive) & (purity >= min_purity) & (rate_p - rate_u > 5 * noise))
    chosen = sorted(fit.tolist(), key=lambda w: (-rate_p[w] * purity[w], words[w]))[:max_features]
    if not chosen:
        return Classifier({}, -3.0)
    place = np.full(len(words), -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))
    (pr, pc), (ur, uc) = ((h[place[f] >= 0], place[f][place[f] >= 0]) for f, h in zip(flat, held, strict=True))
    w, b = np.zeros(len(chosen)), -1.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        zp = np.bincount(pr, w[pc], minlength=n_p) + b
        zu = np.bincount(ur, w[uc], minlength=n_u) + b
        _, gp, gu = risk_and_gradient(zp, zu, prior)
        grad = np.bincount(pc, gp[pr], minlength=len(w)) + np.bincount(uc, gu[ur], minlength=len(w)) + l2 * w
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= scale * m / (np.sqrt(v) + 1e-8)
        b -= scale * mb / (np.sqrt(vb) + 1e-8)
    return Classifier({words[x]: float(w[i]) for i, x in enumerate(chosen) if abs(w[i]) > 1e-6}, float(b))


def draw(rows: DataFrame, n: int, count: int, max_chars: int, only: DataFrame | None = None) -> list[str]:
    """At most n whole texts of rows(doc_id, text), by a hash of the row, until they hold max_chars characters together.

    With `only`, of the rows whose doc_id is in that table. Then the rows' ids and hashes meet the
    table without their texts, and the texts of the at most n drawn ones are read afterwards.
    """
    rate = min(1 << 20, int((1 << 20) * 1.5 * n / max(count, 1)) + 1)
    turn = F.xxhash64("doc_id", "text", F.lit(1))
    drawn = rows.where((F.length("text") > 0) & (F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)) < rate)).withColumn("turn", turn)
    if only is not None:
        met = drawn.select("doc_id", "turn").join(only.select("doc_id"), "doc_id", "left_semi").orderBy("turn").limit(n)
        chosen = rows.sparkSession.createDataFrame(met.distinct().collect(), met.schema)  # n rows of two numbers
        drawn = drawn.join(F.broadcast(chosen), ["doc_id", "turn"], "left_semi")
    drawn = drawn.select("text", "turn").orderBy("turn").limit(n)
    before = F.sum(F.length("text")).over(Window.orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, -1))  # n rows
    drawn = drawn.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < max_chars)
    return [r["text"] for r in drawn.orderBy("turn", "text").select("text").collect()]


@frugal_on_driver
def train(
    docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 9000, positive_chars: int = 6_000_000, unlabelled_chars: int = 18_000_000
) -> Classifier:
    """Fit on texts confirmed toxic in labels(doc_id, toxic) and on unlabelled texts of docs(doc_id, text).

    Both samples are bounded in texts and characters and drawn by a hash of the row, so a text
    comes as often as its copies do; texts are whole and of any length. The class prior is the
    toxic share of the labelled rows, 0.1 where there are none.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    said = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    n, p = said["n"] or 0, said["p"] or 0
    prior = min(max(p / n, 0.01), 0.6) if n else 0.1
    toxic = known.where("toxic = 1").select("doc_id")
    places: dict[str, int] = {}

    def numbered(texts: list[str]) -> list[np.ndarray]:
        return [np.array([places.setdefault(w, len(places)) for w in sorted(features_of(t))], dtype=np.int32) for t in texts]

    positive = numbered(draw(docs.select("doc_id", "text"), max_positive, p, positive_chars, toxic))
    unlabelled = numbered(draw(docs.select("doc_id", "text"), max_unlabelled, docs.count(), unlabelled_chars))
    return nn_pu_fit(positive, unlabelled, list(places), prior)


def score_toxicity(docs: DataFrame, model: Classifier, threshold: float = 0.7, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, score (0 to 1), predicted (1 from the threshold on).

    Null and empty texts get the score of a text without features. Repeated rows and null
    doc_ids are scored row by row; columns in `carry` are passed through and others not read;
    an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: max_features weights

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = np.array([held.value.score(t if isinstance(t, str) else None) for t in batch["text"]], dtype=np.float64)
            out = {"doc_id": batch["doc_id"].astype("Int64"), "score": s, "predicted": (s >= threshold).astype(np.int32)}
            yield pd.DataFrame(out | {c: batch[c] for c in carry})

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("doc_id", "text", *[c for c in carry if c != "text"]).mapInPandas(frugal(predict), "doc_id long, score double, predicted int" + kinds)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from labels outside the held-out fold."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.coalesce(id_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    out = score_toxicity(docs, train(docs, labels.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")
