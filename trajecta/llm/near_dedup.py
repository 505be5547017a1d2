"""Operator 6: near-duplicate groups by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm.common import connected_components, counted, discard, frugal, frugal_on_driver, hot_join, hot_keys, materialize, read_table
from trajecta.llm.tokens import text_batches

#: 72 bands of 8 rows: a pair at similarity 0.8 shares no band with probability (1 - 0.8**8)**72 < 2e-6.
BANDS, ROWS = 72, 8
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9FB21C651E98DF25
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LETTER = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def word_hashes(data: bytes, stretch: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of UTF-8 text, and where they start; A-Z count as lower case.

    The hash of a word is a polynomial of random 64-bit numbers that stand for its bytes, so
    one running sum over a stretch of text gives the hashes of all its words.
    """
    raw = np.frombuffer(data.lower(), dtype=np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(at + stretch, len(raw))
        while end < len(raw) and not _SPACE[raw[end - 1]]:  # words stay whole
            gaps = np.flatnonzero(_SPACE[raw[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else min(at + 2 * (end - at), len(raw))
        gap = _SPACE[raw[at:end]]
        turn = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
        first, stop = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        powers, inverse = _powers(end - at)
        total = np.zeros(end - at + 1, dtype=np.uint64)
        np.cumsum(_LETTER[raw[at:end]] * powers[: end - at], out=total[1:])
        hashes.append(mix((total[stop] - total[first]) * inverse[first] + (stop - first).astype(np.uint64) * _MUL))
        starts.append(first + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


def shingle_sets_of(word_hashes: np.ndarray, sizes: np.ndarray, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all runs of `width` words in each of many word sequences laid end to end, and the sizes of the sets.

    A sequence shorter than `width` gives one hash, of all its words; an empty one gives none.
    """
    ends = np.cumsum(sizes)
    starts, span = ends - sizes, np.minimum(sizes, width)
    n_runs = np.where(sizes > 0, sizes - span + 1, 0)
    run_ends = np.cumsum(n_runs)
    where = np.arange(int(run_ends[-1]) if len(run_ends) else 0) + np.repeat(starts - (run_ends - n_runs), n_runs)
    of_run = np.repeat(span, n_runs)
    h = of_run.astype(np.uint64)
    for k in range(width):
        if k == 0 or (of_run > k).all():
            h = mix(h * _MUL + word_hashes[where + k])
        else:
            longer = of_run > k
            h[longer] = mix(h[longer] * _MUL + word_hashes[where[longer] + k])
    for a, b in zip((run_ends - n_runs).tolist(), run_ends.tolist(), strict=True):
        h[a:b].sort()
    first = np.ones(len(h), dtype=bool)
    first[1:] = h[1:] != h[:-1]
    first[(run_ends - n_runs)[n_runs > 0]] = True
    kept = np.concatenate([[0], np.cumsum(first)])
    return h[first], kept[run_ends] - kept[run_ends - n_runs]


def shingle_set(word_hashes: np.ndarray, width: int = 4) -> np.ndarray:
    return shingle_sets_of(word_hashes, np.array([len(word_hashes)]), width)[0]


def min_max_signatures(shingles: np.ndarray, sizes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """[2 * permutations, sets]: the minima and then the maxima of each set under each permutation, two values a hash evaluation.

    Sets lie end to end and none is empty. A permutation multiplies the upper 32 bits of the
    hashes by an odd number.
    """
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((2 * len(multipliers), len(sizes)), dtype=np.uint32)
    for k, m in enumerate(multipliers):
        h = x * m
        out[k] = np.minimum.reduceat(h, starts)
        out[len(multipliers) + k] = np.maximum.reduceat(h, starts)
    return out


def permutations(n: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[bands, sets]: half the bands take minima and half maxima, each of `rows` different permutations.

    Values of one band are independent, however small the sets are. The maxima are dealt to
    bands in another way than the minima, so that no two bands hold the same permutations.
    """
    n = bands * rows // 2
    lows = np.arange(n).reshape(bands // 2, rows)
    highs = n + np.arange(n).reshape(rows, bands // 2).T
    h = np.repeat((np.arange(bands, dtype=np.uint64) + np.uint64(1))[:, None], signatures.shape[1], axis=1)
    for r in range(rows):
        h = mix(h * _MUL + signatures[np.concatenate([lows[:, r], highs[:, r]])].astype(np.uint64))
    return h


def word_key(word_hashes: np.ndarray) -> bytes:
    """A 128-bit key of a word sequence."""
    return hashlib.blake2b(word_hashes.tobytes(), digest_size=16).digest()


def _hashed(texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
    """Stretches (from, to, word hashes end to end, their number by text, word keys) of a batch of texts."""
    texts = [t if isinstance(t, str) else None for t in texts]
    for a, b in text_batches(texts):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts[a:b]]
        h, starts = word_hashes(b"\n".join(raw))
        ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raw]))
        sizes = np.diff(np.concatenate([[0], ends]))
        yield a, b, h, sizes, [word_key(h[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = 4) -> DataFrame:
    """Per row: row_id (a number of its own), doc_id, n_shingles, word_key (hash of the word sequence), band keys."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        perms, row_id = permutations(bands * rows // 2), TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, h, sizes, keys in _hashed(batch["text"].tolist()):
                shingles, n = shingle_sets_of(h, sizes, width)
                bkeys, own = [np.zeros(0, dtype=np.int64)] * (b - a), np.flatnonzero(n)
                if len(own):
                    found = band_keys(min_max_signatures(shingles, n[own], perms), bands, rows).T.copy().view(np.int64)
                    for i, row in zip(own.tolist(), found, strict=True):
                        bkeys[i] = row
                ids = batch["doc_id"].iloc[a:b].astype("Int64")
                yield pd.DataFrame({"row_id": row_id + np.arange(b - a), "doc_id": ids.to_numpy(dtype=object, na_value=None), "n_shingles": n, "word_key": keys, "bands": bkeys})
                row_id += b - a

    schema = "row_id long, doc_id long, n_shingles long, word_key binary, bands array<bigint>"
    return docs.select("doc_id", "text").mapInPandas(frugal(sign), schema)


def shingle_sets(docs: DataFrame, width: int = 4) -> DataFrame:
    """(word_key, shingles): the key of the word sequence and the sorted set as bytes."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, _, h, sizes, keys in _hashed(batch["text"].tolist()):
                shingles, n = shingle_sets_of(h, sizes, width)
                ends = np.cumsum(n)
                yield pd.DataFrame({"word_key": keys, "shingles": [shingles[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]})

    return docs.select("text").mapInPandas(frugal(sets), "word_key binary, shingles binary")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, hubs: list) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity; b may repeat often, and the values in `hubs` do."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(batch["sa"], batch["sb"], strict=True)]
            yield batch.loc[keep, ["a", "b"]]

    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    with_b = hot_join(with_a, sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), ["b"], "b", hubs)
    return with_b.select("a", "b", "sa", "sb").mapInPandas(frugal(check), "a long, b long")


def spanning_links(names: list, classes: np.ndarray, sets: list[np.ndarray], percent: int, first: int | None = None) -> list[tuple]:
    """Links between members of different classes, at most one for each pair of classes that it joins.

    With `first`, only pairs of a member before that position and one after it are compared.
    Pairs whose sizes cannot reach the similarity are left out; the intersections of the others
    are counts of common bits, over the shingles that at least two members hold.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    meet = np.triu(classes[:, None] != classes[None, :], 1)
    meet &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    if first is not None:
        meet[:first, :first] = False
        meet[first:, :] = False
    rows = np.flatnonzero(meet.any(axis=1))
    if not len(rows):
        return []
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[order[1:]] != values[order[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], np.repeat(np.arange(len(sets)), sizes)[order[keep]]
    inter = np.zeros(meet.shape, dtype=np.int64)
    for start in range(0, int(shared.sum()), 1 << 15):
        a, b = np.searchsorted(column, [start, start + (1 << 15)])
        width = min(1 << 15, int(shared.sum()) - start)
        held = np.zeros((len(sets), -(-width // 64) * 64), dtype=bool)
        held[owner[a:b], column[a:b] - start] = True
        bits = np.packbits(held, axis=1).view(np.uint64)
        for i in rows.tolist():
            others = np.flatnonzero(meet[i])
            inter[i, others] += np.bitwise_count(bits[i] & bits[others]).sum(axis=1, dtype=np.int64)
    good = meet & (100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter))
    parent = {int(c): int(c) for c in classes}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(good), strict=True):
        x, y = root(int(classes[i])), root(int(classes[j]))
        if x != y:
            parent[x] = y
            out.append((names[i], names[j]))
    return out


def compare_buckets(members: DataFrame, sets: DataFrame, percent: int, block: int = 192, lot: int = 2000) -> DataFrame:
    """Links (a, b) between different classes among members(bucket, node, class).

    In a bucket, members of its largest class are only compared with the others. Both kinds
    are cut into blocks of about `block` members; every block of others meets itself and each
    block of either kind in a group of at most two blocks, so a group is bounded however large
    the bucket is. Groups go to Python in lots of about `lot` rows.
    """
    lots = max(1, -(-2 * members.count() // lot))
    of_class = members.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("k"))
    sizes = of_class.groupBy("bucket").agg(F.sum("k").alias("m"), F.max(F.struct("k", "class")).alias("top"))
    minor, major = (F.ceil(n / block).cast("int") for n in (F.col("m") - F.col("top.k"), F.col("top.k")))
    sizes = sizes.select("bucket", F.col("top.class").alias("top"), minor.alias("minor"), major.alias("major")).where("minor > 0")
    turn, others = F.xxhash64("node"), F.col("class") != F.col("top")
    own = F.when(others, F.pmod(turn, F.col("minor"))).otherwise(F.col("minor") + F.pmod(turn, F.col("major"))).cast("int")
    meets = F.sequence(F.lit(0), F.when(others, F.col("minor") + F.col("major")).otherwise(F.col("minor")) - 1)
    met = members.join(sizes, "bucket").select("bucket", "node", "class", own.alias("own"), F.explode(meets).alias("other"))
    met = met.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "class")
    full = met.join(sets, "node")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "x", "y", "own", "node"])
        bucket, x, y, own, node, kind = (rows[c].to_numpy() for c in ("bucket", "x", "y", "own", "node", "class"))
        new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        held, links = [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]], []
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(rows)], strict=True):
            classes = np.unique(kind[a:b], return_inverse=True)[1]
            if classes.any():
                first = int((own[a:b] == x[a]).sum()) if x[a] != y[a] else None
                links += spanning_links(node[a:b].tolist(), classes, held[a:b], percent, first)
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    dealt = full.withColumn("lot", F.pmod(F.xxhash64("bucket", "x", "y"), F.lit(lots)))
    return dealt.groupBy("lot").applyInPandas(compare, "a long, b long")


@frugal_on_driver
def near_duplicates(
    docs: DataFrame, percent: int = 80, width: int = 4, bands: int = BANDS, rows: int = ROWS, star_rounds: int = 2
) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked whose shingle sets have 100 * intersection >= percent * union.
    1. One scan makes the set size, a key of the word sequence and `bands` band keys.
    2. Rows with the same word sequence form a node, whatever their number.
    3. Nodes that share a band key form a bucket. In each star round (two at most) a bucket
       proposes pairs of one member with the others, so proposals are linear in the bucket;
       they are confirmed on full sets. New links are kept between classes only, and their
       components merge the classes in one table of labels.
    4. Buckets that still hold several classes are compared exhaustively between classes, in
       blocks, so no link inside a bucket is lost.
    Texts are shuffled once, to make the sets of those that share a bucket. Null or empty
    texts are linked with nothing. A null doc_id takes part in no link; its row has a null
    component_id and is kept. Rows that repeat a doc_id share its component, which joins what
    any of them links. Other columns are not read; an empty table gives no rows.
    """
    signed = materialize(signatures(docs, bands, rows, width), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    every = F.lit(True)
    nodes = usable.groupBy("word_key").agg(F.min("row_id").alias("node"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes, "nodes", count=every)
    banded = usable.groupBy("word_key").agg(F.min("row_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    buckets = materialize(banded.select("node", F.col("n").cast("int").alias("n"), F.explode("bands").alias("bucket")), "buckets")

    def stars(members: DataFrame, *order: Column) -> DataFrame:
        """(bucket, hub) of the buckets with several members; hub is the first member in the order."""
        kept = [c for c in ("node", "n", "class") if c in members.columns]
        turn = [c.alias(f"_{i}") for i, c in enumerate([*order, F.xxhash64("node")])]
        found = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(*turn, *kept)).alias("hub"))
        return found.where("m > 1").select("bucket", F.struct(*[f"hub.{c}" for c in kept]).alias("hub"))

    # the first star comes with the search for shared buckets
    shared = materialize(stars(buckets), "shared")
    crowded = materialize(hot_join(buckets, shared, ["bucket"], "bucket", hot_keys(buckets, "bucket")), "crowded")
    discard(shared)
    discard(buckets)
    wanted = materialize(crowded.select("node").distinct().join(nodes, "node"), "wanted", count=every)
    files = max(1, -(-counted(wanted) // 250_000))  # of tables about as long as the list of nodes
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    sets = shingle_sets(texts, width).join(wanted.select("word_key", "node"), "word_key").dropDuplicates(["node"]).select("node", "shingles")
    sets = materialize(sets, "sets")

    # classes of nodes that take part in links: rows that repeat a doc_id with another text are links from the start
    several = usable.groupBy("doc_id").agg(F.min("word_key").alias("x"), F.max("word_key").alias("y")).where("x <> y").select("doc_id")
    several = usable.join(several, "doc_id").select("doc_id", "word_key").distinct().join(nodes.select("word_key", "node"), "word_key")
    own = several.groupBy("doc_id").agg(F.min("node").alias("b"))
    links = materialize(several.join(own, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b"), "links", files=files, count=every)
    labels = wanted.select("node", F.col("node").alias("class"))
    if counted(links):
        labels = labels.union(several.select("node", F.col("node").alias("class"))).distinct()

    def merged(labels_: DataFrame, links_: DataFrame) -> DataFrame:
        """Labels after the links between their classes."""
        side = lambda c: labels_.select(F.col("node").alias(c), F.col("class").alias(f"class_{c}"))
        between = hot_join(links_.join(side("a"), "a"), side("b"), ["b"], "b", hot_keys(links_, "b"))
        parts = connected_components(between.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")), files=files)
        many = hot_keys(labels_, "class")
        to = parts.select(F.col("node").alias("class"), "component")
        out = materialize(hot_join(labels_, to, ["class"], "class", many, "left").select("node", F.coalesce("component", "class").alias("class")), "labels", files=files)
        discard(parts)
        discard(labels_)
        discard(links_)
        return out

    def mixed(labels_: DataFrame) -> DataFrame:
        """(bucket, node, n, class) of the buckets that hold several classes."""
        known = crowded.join(labels_, "node")
        several_ = known.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("bucket")
        return materialize(known.join(several_, "bucket", "left_semi"), "mixed")

    if counted(links):
        labels = merged(labels, links)
    left, tried = None, None
    for second in [False, True][:star_rounds]:
        if not second:
            star = crowded.select("node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")).where("node <> hub")
        else:
            left = mixed(labels)
            # another hub, of another class than the first one's members where there is one
            known_hubs = labels.select(F.col("node").alias("first"), F.col("class").alias("first_class"))
            left_ = left.withColumn("first", F.col("hub.node")).drop("hub")
            left_ = hot_join(left_, known_hubs, ["first"], "first", hot_keys(left_, "first"))
            hub = stars(left_.where("node <> first"), F.col("class") == F.col("first_class"))
            star = hot_join(left_, hub, ["bucket"], "bucket", hot_keys(left, "bucket")).where("class <> hub.class and node <> first")
            star = star.select("node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
        fits = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
        pairs = star.where(fits).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        links = materialize(confirm(pairs, sets, percent, hot_keys(pairs, "b")), "links", count=every)
        if left is not None:
            discard(left)
        tried = pairs
        if counted(links):
            labels = merged(labels, links)
    # a bucket of one member more than there were hubs is done; buckets of the same members are compared once
    left = mixed(labels)
    alike = left.groupBy("bucket").agg(F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("k"), F.count(F.lit(1)).alias("m"))
    once = alike.where(F.col("m") > star_rounds + 1).groupBy("k", "m").agg(F.min("bucket").alias("bucket")).select("bucket")
    rest = left.join(once, "bucket", "left_semi").select("bucket", "node", "class")
    links = materialize(compare_buckets(rest, sets, percent), "links", count=every)
    if counted(links):
        labels = merged(labels, links)
    of_node = nodes.select("node", "word_key", "rep").join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))
    smallest = of_node.groupBy("class").agg(F.min("rep").alias("component_id"))
    of_node = hot_join(of_node, smallest, ["class"], "class", hot_keys(labels, "class")).select("word_key", "component_id")
    row = signed.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("word_key")).alias("word_key"))
    copies = nodes.where((F.col("copies") >= 256) & (F.col("copies") * 512 > counted(nodes)))  # few, as their rows are many
    copies = [r["word_key"] for r in copies.select("word_key").orderBy(F.desc("copies")).limit(512).collect()]
    row = hot_join(row, of_node, ["word_key"], "word_key", copies, "left")
    component = F.coalesce("component_id", "doc_id")
    out = row.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    out = materialize(out, "near")
    for done in (left, tried, crowded, sets, wanted, labels, nodes, signed):
        if done is not None:
            discard(done)
    return out


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: four-word shingles, similarity 0.8."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


#: Exact: shingle lists, intersections by a join on the shingle, components by recursion.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] FOR i IN range(1, len(ws) - 2)]) END AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT r.node, g.b FROM r JOIN g ON r.seen = g.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY 1) c ON s.doc_id = c.node
"""
