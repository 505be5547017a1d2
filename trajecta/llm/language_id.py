"""Operator 3: language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.llm.common import frugal, frugal_on_driver, id_fold, read_table

ORDER = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def letters_only(text: str | None) -> str:
    """Lower case, every run of characters that are no letters a single space, a space at both ends."""
    if not text:
        return ""
    low = text.lower()
    if low.isascii():
        low = low.translate(_ASCII)
    else:
        low = "".join([c if c.isalpha() else " " for c in low]) if not low.isalpha() else low
    words = low.split()
    return f" {' '.join(words)} " if words else ""


_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-grams; position i is the gram that ends with code i + n - 1."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(size, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        h = (h + codes[k : k + size]) * _MUL
        h ^= h >> np.uint64(29)
    return h * _MIX


@dataclass
class Model:
    """Sorted hash arrays of the grams of each order, and for each language their log probability and log backoff."""

    langs: list[str]
    grams: list[np.ndarray]  # by order - 1: sorted hashes
    log_p: list[np.ndarray]  # [grams, langs]
    contexts: list[np.ndarray]  # by order - 1: sorted hashes of contexts of order - 1 codes
    log_backoff: list[np.ndarray]
    floor: float
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    per_char: np.ndarray | None = None
    tolerance: float = 8.0

    def deviations(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each text, and how many calibrated deviations its cross-entropy lies over the language's mean."""
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        own = np.sqrt(self.spread[best] ** 2 + self.per_char[best] / np.maximum(n, 1)) + 0.01
        return best, (low - self.mean[best]) / own

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Natural-log probability [positions, langs] of every code after the first ORDER - 1."""
        order = len(self.grams)
        n = len(codes) - order + 1
        out = np.zeros((max(n, 0), len(self.langs)), dtype=np.float32)
        todo = np.arange(max(n, 0))
        for k in range(order, 0, -1):
            if not len(todo):
                break
            keys = gram_hashes(codes[order - k :], k)[todo]
            at = np.searchsorted(self.grams[k - 1], keys)
            at[at == len(self.grams[k - 1])] = 0
            hit = self.grams[k - 1][at] == keys
            out[todo[hit]] += self.log_p[k - 1][at[hit]]
            todo = todo[~hit]
            if k > 1 and len(todo):
                ctx = gram_hashes(codes[order - k : len(codes) - 1], k - 1)[todo]
                at = np.searchsorted(self.contexts[k - 1], ctx)
                at[at == len(self.contexts[k - 1])] = 0
                hit = self.contexts[k - 1][at] == ctx
                out[todo[hit]] += self.log_backoff[k - 1][at[hit]]
        out[todo] += self.floor
        return out


def codes_of(text: str) -> np.ndarray:
    """Code points, padded on the left so that every letter has a whole context."""
    return np.frombuffer((" " * (ORDER - 1) + text).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def fit_models(texts: dict[str, list[str]], order: int = ORDER, discount: float = 0.75) -> Model:
    """Interpolated Kneser-Ney models of all languages over shared gram arrays.

    The highest order discounts counts; lower orders discount the number of distinct codes seen
    before a gram. log_p holds the fully interpolated probability of every gram that any
    language has seen, so one lookup scores a position for all languages at once.
    """
    langs = sorted(texts)
    raw: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
    for k in range(1, order + 1):
        per = []
        for lang in langs:
            codes = np.concatenate([codes_of(t) for t in texts[lang]]) if texts[lang] else np.zeros(0, dtype=np.uint64)
            grams = gram_hashes(codes, k)
            if not len(grams):
                per.append(tuple(np.zeros(0, dtype=np.uint64) for _ in range(4)))
                continue
            if k < order:  # continuation counts: distinct codes before the gram
                wide = gram_hashes(codes, k + 1)
                _, first = np.unique(wide, return_index=True)
                ends = first + 1
                keys, where, counts = np.unique(grams[ends], return_index=True, return_counts=True)
                where = ends[where]
            else:
                keys, where, counts = np.unique(grams, return_index=True, return_counts=True)
            ctx = gram_hashes(codes, k - 1)[where] if k > 1 else np.zeros(len(where), dtype=np.uint64)
            low = gram_hashes(codes, k - 1)[where + 1] if k > 1 else np.zeros(len(where), dtype=np.uint64)
            per.append((keys, counts.astype(np.float64), ctx, low))
        raw.append(per)
    vocabulary = max(2, len(np.unique(np.concatenate([x[0] for x in raw[0]]))) + 1)
    floor = -float(np.log(vocabulary))
    model = Model(langs, [], [], [], [], floor)
    for k in range(1, order + 1):
        per = raw[k - 1]
        keys, first = np.unique(np.concatenate([x[0] for x in per]), return_index=True)
        ctx_of = np.concatenate([x[2] for x in per])[first]
        low_of = np.concatenate([x[3] for x in per])[first]
        contexts = np.unique(np.concatenate([x[2] for x in per]))
        p = np.zeros((len(keys), len(langs)))
        backoff = np.ones((len(contexts), len(langs)))
        at_ctx = np.searchsorted(contexts, ctx_of)
        for j, (own, counts, ctx, _) in enumerate(per):
            if not len(own):
                continue
            c = np.searchsorted(contexts, ctx)
            total = np.bincount(c, counts, minlength=len(contexts))
            kinds = np.bincount(c, minlength=len(contexts))
            seen = total > 0
            backoff[seen, j] = discount * kinds[seen] / total[seen]
            p[np.searchsorted(keys, own), j] = np.maximum(counts - discount, 0) / total[c]
        if k == 1:
            lower = np.full((len(keys), len(langs)), 1.0 / vocabulary)
        else:
            at = np.searchsorted(model.grams[k - 2], low_of)
            at[at == len(model.grams[k - 2])] = 0
            known = model.grams[k - 2][at] == low_of
            lower = np.where(known[:, None], np.exp(model.log_p[k - 2][at]), 1.0 / vocabulary)
        p += backoff[at_ctx] * lower
        model.grams.append(keys)
        model.log_p.append(np.log(p).astype(np.float32))
        model.contexts.append(contexts)
        model.log_backoff.append(np.log(backoff).astype(np.float32))
    if order and len(model.contexts[0]):  # an unseen first-order code costs the backoff of the empty context too
        model.floor += float(model.log_backoff[0].mean())
    return model


def entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: cross-entropy per code [texts, langs] in nats, its number of codes, variance of the best language's terms."""
    h = np.zeros((len(texts), len(model.langs)))
    n = np.zeros(len(texts), dtype=np.int64)
    var = np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not text:
            continue
        total, squares, codes = np.zeros(len(model.langs)), np.zeros(len(model.langs)), codes_of(text)
        lead = len(model.grams) - 1
        for a in range(lead, len(codes), 200_000):
            part = model.score(codes[a - lead : a + 200_000]).astype(np.float64)
            total += part.sum(axis=0)
            squares += (part**2).sum(axis=0)
        n[i] = len(codes) - lead
        h[i] = -total / n[i]
        best = int(h[i].argmin())
        var[i] = max(squares[best] / n[i] - h[i, best] ** 2, 0)
    return h, n, var


def calibrate(model: Model, texts: dict[str, list[str]], seed: int = 3) -> Model:
    """Mean and spread of each language's cross-entropy over texts that were not fitted, and the deviation at which texts are rejected.

    The same texts with their letters shuffled stand for what is in no language. The limit lies
    half way between the most deviant clean text and the shuffled text that one in a hundred
    falls under, but at 1.25 times the former at least, so clean texts are never given up for
    foreign ones.
    """
    size, rng = len(model.langs), np.random.default_rng(seed)
    model.mean, model.spread, model.per_char = np.zeros(size), np.zeros(size), np.ones(size)
    clean = {lang: [c for t in texts.get(lang, []) if (c := letters_only(t))] for lang in model.langs}
    for j, lang in enumerate(model.langs):
        h, n, var = entropies(model, clean[lang])
        if len(h):
            weight = n / n.sum()
            model.mean[j] = float((h[:, j] * weight).sum())
            model.per_char[j] = float((var * weight).sum())
            model.spread[j] = float(np.sqrt(np.maximum((h[:, j] - model.mean[j]) ** 2 - model.per_char[j] / n, 0).mean()))
        else:
            model.mean[j], model.spread[j], model.per_char[j] = np.inf, 0, 1
    every = [t for own in clean.values() for t in own if len(t) > 40]
    if every:
        h, n, _ = entropies(model, every)
        most = max(float(model.deviations(h, n)[1].max()), 1.0)
        h, n, _ = entropies(model, ["".join(rng.permutation(list(t))) for t in every])
        foreign = float(np.quantile(model.deviations(h, n)[1], 0.01))
        model.tolerance = max(1.25 * most, (most + foreign) / 2)
    return model


def sample_texts(labelled: DataFrame, per_lang: int, max_chars: int) -> dict[str, list[str]]:
    """A bounded sample of whole texts of every language: at most per_lang, until they hold max_chars characters together.

    Rows are drawn by a hash of the row (with doc_id where it is there, so a text comes as often
    as its copies do), first by a rate that follows from each language's count and then by rank,
    so no window holds a whole language.
    """
    row = ["doc_id", "text"] if "doc_id" in labelled.columns else ["text"]
    fit = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    fit = fit.select("text", "lang", F.xxhash64(*row).alias("hash"))
    counts = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return {}
    rate = F.lit(0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1 << 20, int((1 << 20) * 2 * per_lang / n) + 1))).otherwise(rate)
    drawn = fit.withColumn("turn", F.pmod("hash", F.lit(1 << 20))).where(F.col("turn") < rate)
    w = Window.partitionBy("lang").orderBy("turn", "text")
    drawn = drawn.withColumn("k", F.row_number().over(w)).withColumn("before", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    drawn = drawn.where((F.col("k") <= per_lang) & (F.coalesce("before", F.lit(0)) < max_chars))
    out: dict[str, list[str]] = {}
    for r in drawn.select("lang", "text").orderBy("lang", "k").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


@frugal_on_driver
def train(labelled: DataFrame, per_lang: int = 500, max_chars: int = 1_000_000) -> Model | None:
    """Fit on four fifths of a bounded sample of labelled(text, lang) and calibrate on the rest; None without labels."""
    drawn = sample_texts(labelled, per_lang, max_chars)
    fit = {k: [c for t in (v if len(v) < 5 else [t for i, t in enumerate(v) if i % 5]) if (c := letters_only(t))] for k, v in drawn.items()}
    fit = {k: v for k, v in fit.items() if v}
    if not fit:
        return None
    return calibrate(fit_models(fit), {k: [t for i, t in enumerate(v) if len(v) < 5 or i % 5 == 0] for k, v in drawn.items()})


def identify(docs: DataFrame, model: Model | None, tolerance: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, lang_pred, score, cross_entropy, rejected.

    lang_pred is the language of the lowest length-normalised cross-entropy (the first by name
    on ties), `und` where the text is null or has no letter or nothing was learned. score is
    the share of the best language in exp(-cross-entropy * 20), 0 for `und`. rejected marks
    `und` and texts whose cross-entropy lies over `tolerance` calibrated deviations above the
    language's mean (by default the limit that calibrate() found); a deviation combines the
    spread between texts and the sampling error of a text of that length. Columns in `carry` are passed through. Null doc_ids, repeated rows and very long texts are scored row by
    row; other columns are not read; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for batch in batches:
            n = len(batch)
            lang, score, best_h, rejected = np.full(n, "und", dtype=object), np.zeros(n), np.full(n, np.nan), np.ones(n, dtype=bool)
            texts = [letters_only(t) if isinstance(t, str) else "" for t in batch["text"]]
            own = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
            if m is not None and len(own):
                h, size, _ = entropies(m, [texts[i] for i in own])
                best, over = m.deviations(h, size)
                low = h[np.arange(len(own)), best]
                lang[own] = np.array(m.langs, dtype=object)[best]
                score[own] = 1 / np.exp(-20 * (h - low[:, None])).sum(axis=1)
                best_h[own] = low
                rejected[own] = over > (m.tolerance if tolerance is None else tolerance)
            out = {"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": lang, "score": score, "cross_entropy": best_h, "rejected": rejected}
            yield pd.DataFrame(out | {c: batch[c] for c in carry})

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    schema = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean" + kinds
    return docs.select("doc_id", "text", *[c for c in carry if c != "text"]).mapInPandas(frugal(predict), schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_fold(F.col("doc_id"), 4) == 2, F.lit(False))
    out = identify(docs, train(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
