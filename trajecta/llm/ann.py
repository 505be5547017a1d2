"""Operator 10: nearest neighbours by inner product with a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm.common import materialize, read_table


@dataclass
class Forest:
    """Complete binary trees of one depth: node i has children 2i + 1 and 2i + 2."""

    planes: np.ndarray  # [trees, nodes, dims]
    cuts: np.ndarray  # [trees, nodes]
    depth: int

    @property
    def n_trees(self) -> int:
        return len(self.planes)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers [rows, trees]."""
        out = np.zeros((len(x), self.n_trees), dtype=np.int32)
        for t in range(self.n_trees):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.planes[t][node]) > self.cuts[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - (2**self.depth - 1)
        return out

    def visit(self, query: np.ndarray, counts: np.ndarray, enough: float) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) from the best on until they hold `enough` rows.

        One priority queue holds nodes of all trees; a node's priority is the smallest margin
        on its path, so the next leaf comes from whichever tree has the most promising branch.
        """
        inner, out, held = 2**self.depth - 1, [], 0.0
        margins = self.planes @ query - self.cuts if inner else np.zeros((self.n_trees, 0))
        heap = [(-np.inf, t, 0) for t in range(self.n_trees)]
        while heap and held < enough:
            low, t, node = heapq.heappop(heap)
            while node < inner:
                m = float(margins[t, node])
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(heap, (max(low, abs(m)), t, far))
                node = near
            out.append((t, node - inner))
            held += counts[t, node - inner]
        return out


def fit_forest(sample: np.ndarray, n_trees: int, depth: int, seed: int = 5) -> Forest:
    """Each node cuts its sample at the median along the line between two of its points."""
    rng, dims = np.random.default_rng(seed), sample.shape[1]
    planes, cuts = np.zeros((n_trees, 2**depth - 1, dims)), np.zeros((n_trees, 2**depth - 1))
    for t in range(n_trees):
        own = {0: np.arange(len(sample))}
        for node in range(2**depth - 1):
            rows = own.pop(node, np.zeros(0, dtype=np.int64))
            direction = np.zeros(dims)
            if len(rows) > 1:
                a, b = rng.choice(rows, 2, replace=False)
                direction = sample[a] - sample[b]
            if not np.linalg.norm(direction) > 0:
                direction = rng.standard_normal(dims)
            planes[t, node] = direction / np.linalg.norm(direction)
            along = sample[rows] @ planes[t, node]
            cuts[t, node] = np.median(along) if len(rows) else 0.0
            right = along > cuts[t, node]
            own[2 * node + 1], own[2 * node + 2] = rows[~right], rows[right]
    return Forest(planes, cuts, depth)


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    """Add a coordinate that makes all norms equal, so that largest inner product means nearest."""
    rest = np.sqrt(np.maximum(largest**2 - (x**2).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the order of the components."""
    return np.cumsum(vectors * query, axis=1)[:, -1] if len(vectors) else np.zeros(0)


def best_of(scores: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int, longest: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, exact scores), ties to smaller ids; scores are approximate and -inf where no candidate.

    Scores within rounding of the k-th, as the lengths of the query and of the longest vector
    give it, are taken exactly before the k are cut.
    """
    live = np.flatnonzero(scores > -np.inf)
    if len(live) > k:
        kth = np.partition(scores[live], len(live) - k)[len(live) - k]
        reach = float(np.linalg.norm(vectors, axis=1).max()) if longest is None else longest
        live = live[scores[live] >= kth - 1e-12 * (len(query) + 1) * float(np.linalg.norm(query)) * reach]
    s = exact(query, vectors[live])
    order = np.lexsort((ids[live], -s))[:k]
    return ids[live][order], s[order]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of rows with an id and a non-zero vector of finite components, as doubles."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def brute_force(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> dict[int, list[tuple[int, float, np.ndarray]]]:
    """Exact neighbours of a bounded list of queries: each task keeps k, and the k of all tasks are merged."""
    held = rows.sparkSession.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list] = {q: [] for q, _ in held.value}
        for batch in batches:
            ids, x = batch["vec_id"].to_numpy(), _matrix(batch["v"])
            for q, v in held.value:
                s = x @ v
                s[ids == q] = -np.inf
                top_ids, top = best_of(s, ids, x, v, k)
                at = {i: j for j, i in enumerate(ids.tolist())}
                best[q] = sorted([*best[q], *((-float(y), int(i), x[at[int(i)]].tolist()) for i, y in zip(top_ids, top, strict=True))], key=lambda r: r[:2])[:k]
        out = [(q, i, -s, v) for q, found in best.items() for s, i, v in found]
        yield pd.DataFrame(out, columns=["q", "i", "s", "v"])

    found = rows.mapInPandas(scan, "q long, i long, s double, v array<double>")
    found = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "i", "v"))), 1, k).alias("top"))
    return {r["q"]: [(x["i"], -x["s"], np.array(x["v"])) for x in r["top"]] for r in found.collect()}


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", n_trees: int = 4, leaf_rows: int = 256,
    fit_rows: int = 8192, max_depth: int = 9, target_recall: float = 0.96, probe_queries: int = 64, group_rows: int = 8192,
) -> DataFrame:
    """The k rows of largest inner product for each query: (query_id, rank from 1, vec_id, score).

    1. The trees are fitted on at most fit_rows rows; every usable row is indexed in every tree.
    2. probe_queries queries are answered by brute force; the number of rows that the shared
       priority queue must gather for target_recall on them is taken as a share of all rows.
    3. Each query visits leaves of all trees by the queue until it has gathered that share.
       Neighbouring leaves form groups of about group_rows rows; a leaf that holds more is
       dealt to several. A group meets the queries that visit it, and keeps k exact scores for each.
    4. The k best over the groups of a query, ties to the smaller id, are its result.
    A query is never its own neighbour. Rows with a null id, and vectors that are null, zero or
    hold null or non-finite components take no part, nor do vectors of another length than
    the most common. Rows that repeat an id count once, by their largest score. Other columns
    are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vec_col)
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("sq"))
    common = dims.orderBy(F.desc("n"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    d, total, largest = common["d"], common["n"], float(np.sqrt(common["sq"]))
    rows = rows.where(F.size("v") == d)
    wanted = usable(queries, id_col, vec_col).where(F.size("v") == d)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < min(1 << 20, int(1.3 * fit_rows * (1 << 20) / total) + 64))
    sample = _matrix(pd.Series([r["v"] for r in drawn.orderBy(F.xxhash64("vec_id", F.lit(1))).limit(fit_rows).collect()]))
    depth = 0
    while depth < max_depth and total / 2**depth > 2 * leaf_rows and len(sample) / 2**depth > 8:
        depth += 1
    forest = fit_forest(lift(sample, largest) if len(sample) else np.zeros((0, d + 1)), n_trees, depth)
    model = spark.sparkContext.broadcast(forest)  # bounded: n_trees * 2**max_depth planes

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["v"])
            leaves = model.value.leaves(lift(x, largest)) if len(x) else np.zeros((0, n_trees), dtype=np.int32)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": batch["v"], "leaves": list(leaves)})

    indexed = materialize(rows.mapInPandas(index, "vec_id long, v array<double>, leaves array<int>"), "ann-index")
    counts = np.zeros((n_trees, 2**depth), dtype=np.int64)
    for r in indexed.select(F.posexplode("leaves").alias("t", "leaf")).groupBy("t", "leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["t"], r["leaf"]] = r["n"]

    probes = [(r["vec_id"], np.array(r["v"])) for r in wanted.dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id", F.lit(2))).limit(probe_queries).collect()]
    truth = brute_force(indexed.select("vec_id", "v"), probes, k) if probes else {}
    costs = []
    for q, v in probes:
        where = {}
        for _, _, x in truth.get(q, []):
            where[len(where)] = set(enumerate(forest.leaves(lift(x[None], largest))[0].tolist()))
        held = 0.0
        for leaf in forest.visit(np.append(v, 0.0), counts, np.inf):
            held += counts[leaf]
            for i in [i for i, leaves in where.items() if leaf in leaves]:
                costs.append(held)
                del where[i]
    enough = float(np.quantile(costs, target_recall)) + 1 if costs else float(total)

    groups, chunks, n_groups = np.zeros_like(counts), np.ones_like(counts), 0
    for t in range(n_trees):
        size = 0
        for leaf in range(2**depth):
            n = int(counts[t, leaf])
            if size and size + n > group_rows:
                n_groups, size = n_groups + 1, 0
            groups[t, leaf], chunks[t, leaf] = n_groups, max(1, -(-n // group_rows))
            size += n
            if chunks[t, leaf] > 1:  # a leaf that is dealt out stands alone
                n_groups, size = n_groups + int(chunks[t, leaf]), 0
        n_groups += 1
    plan = spark.sparkContext.broadcast((groups, chunks, counts, enough))  # bounded as the forest

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group_of, chunk_of, _, _ = plan.value
        for batch in batches:
            leaves = np.stack(batch["leaves"].tolist()) if len(batch) else np.zeros((0, n_trees), dtype=np.int64)
            ids = batch["vec_id"].to_numpy()
            spread = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            for t in range(n_trees):
                g = group_of[t][leaves[:, t]] + spread % chunk_of[t][leaves[:, t]]
                yield pd.DataFrame({"g": g, "leaf": leaves[:, t] + t * 2**depth, "vec_id": ids, "v": batch["v"]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group_of, chunk_of, leaf_counts, gather = plan.value
        for batch in batches:
            out = []
            for q, v in zip(batch["vec_id"], batch["v"], strict=True):
                visits: dict[int, list[int]] = {}
                for t, leaf in model.value.visit(np.append(np.asarray(v), 0.0), leaf_counts, gather):
                    for c in range(int(chunk_of[t, leaf])):
                        visits.setdefault(int(group_of[t, leaf]) + c, []).append(leaf + t * 2**depth)
                out += [(g, q, v, leaves) for g, leaves in visits.items()]
            yield pd.DataFrame(out, columns=["g", "query_id", "q", "visits"])

    dealt = indexed.mapInPandas(deal, "g long, leaf int, vec_id long, v array<double>")
    asked = wanted.dropDuplicates(["vec_id"]).mapInPandas(ask, "g long, query_id long, q array<double>, visits array<int>")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values(["leaf", "vec_id"])
            ids, leaf, x = left["vec_id"].to_numpy(), left["leaf"].to_numpy(), _matrix(left["v"])
            longest = float(np.linalg.norm(x, axis=1).max())
            names = np.unique(leaf)
            place = np.searchsorted(names, leaf)
            for at in range(0, len(right), 64):
                part = right.iloc[at : at + 64]
                q = _matrix(part["q"])
                seen = np.zeros((len(part), len(names)), dtype=bool)
                for i, leaves in enumerate(part["visits"]):
                    own = np.searchsorted(names, leaves)
                    own = np.minimum(own, len(names) - 1)
                    seen[i, own[names[own] == leaves]] = True
                scores = q @ x.T
                scores[~seen[:, place]] = -np.inf
                scores[part["query_id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
                for i, name in enumerate(part["query_id"]):
                    top, s = best_of(scores[i], ids, x, q[i], k, longest)
                    if len(top):
                        out.append((name, top, s))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    near = dealt.groupBy("g").cogroup(asked.groupBy("g")).applyInPandas(meet, "query_id long, ids array<long>, scores array<double>")

    def merge(rows_: pd.DataFrame) -> pd.DataFrame:
        ids, s = np.concatenate(rows_["ids"].tolist()), np.concatenate(rows_["scores"].tolist())
        order = np.lexsort((ids, -s))
        _, first = np.unique(ids[order], return_index=True)
        order = order[np.sort(first)][:k]
        n = len(order)
        return pd.DataFrame({"query_id": rows_["query_id"].iloc[0], "rank": np.arange(1, n + 1, dtype=np.int32), "vec_id": ids[order], "score": s[order]})

    return near.groupBy("query_id").applyInPandas(merge, schema)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row of embeddings whose id is divisible by 20."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.pmod("vec_id", F.lit(20)) == 0), 20)
