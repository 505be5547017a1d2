"""Merkle manifests of datasets (operator 13): mountain ranges over ranges of rows, merged at their edges.

Rows are dealt to ranges of (group, order), and the counts of the ranges give every row its place
in its group. A task climbs its ranges with a stack of unfinished runs, one a level: a run of
`fanout` nodes carries into its parent, as digits do. Runs that a range only holds in part come
out as edges, at most two a level, and are joined level by level over all ranges. The last run
of a level is hashed as short as it is. Hashes are sha256 of concatenated hex digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.llm.common import discard, id_fold, materialize, read_table

FANOUT = 16
DIGEST = 64
NODE_SCHEMA = "grp string, total long, level int, idx long, hash string, children string"
PATH = "array<struct<before:string,after:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 length, a colon and the value: no two rows give the same text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(value: Column) -> Column:
    """A key that is never null and sorts as the value does, null first."""
    return F.coalesce(F.concat(F.lit("1"), value.cast("string")), F.lit("0"))


def level_sizes(total: int, fanout: int = FANOUT) -> list[int]:
    """Numbers of nodes from the leaves up to the top, which is 1."""
    sizes = [total]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fanout))
    return sizes


class PeakStack:
    """Unfinished runs of a stretch of leaves, one a level; push() carries finished ones upwards.

    Memory is a run a level, however long the stretch. `out` gathers (level, idx, hash, children)
    of parents, and the same with children None for nodes of runs that other stretches share.
    """

    def __init__(self, total: int, fanout: int = FANOUT) -> None:
        self.sizes, self.fanout, self.out = level_sizes(total, fanout), fanout, []
        self.runs: list[tuple[int, list[str]]] = [(0, []) for _ in self.sizes]

    def push(self, idx: int, digest: str) -> None:
        level = 0
        while self.sizes[level] > 1:
            first, run = self.runs[level]
            if not run:
                self.runs[level] = (idx, run)
                first = idx
            run.append(digest)
            if (idx + 1) % self.fanout and idx + 1 != self.sizes[level]:
                return
            self.runs[level] = (0, [])
            if first % self.fanout:
                self._edges(level, first, run)
                return
            children = "".join(run)
            level, idx, digest = level + 1, idx // self.fanout, hashlib.sha256(children.encode()).hexdigest()
            self.out.append((level, idx, digest, children))

    def _edges(self, level: int, first: int, run: list[str]) -> None:
        self.out += [(level, first + k, d, None) for k, d in enumerate(run)]

    def finish(self) -> list[tuple]:
        """All that came out, with the peaks that stand at the end of the stretch."""
        for level, (first, run) in enumerate(self.runs):
            self._edges(level, first, run)
        return self.out


@dataclass
class Manifest:
    """placed(grp, total, idx, leaf, ...) are the rows with their places, nodes(grp, total, level, idx, hash, children) all inner nodes, tops(grp, hash) the groups' tops; `most` is the largest group."""

    placed: DataFrame
    nodes: DataFrame
    tops: DataFrame
    most: int


def _climb(fanout: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack, own, due, total = None, None, 0, 0
        names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame([(own, total, *r) for r in rows], columns=names)

        for batch in batches:
            for grp, n, idx, leaf in zip(batch["grp"], batch["total"].tolist(), batch["idx"].tolist(), batch["leaf"], strict=True):
                if stack is None or grp != own or idx != due:
                    if stack is not None:
                        yield frame(stack.finish())
                    stack, own, total = PeakStack(n, fanout), grp, n
                stack.push(idx, leaf)
                due = idx + 1
            if stack is not None and stack.out:
                yield frame(stack.out)
                stack.out = []
        if stack is not None:
            yield frame(stack.finish())

    return run


def _size(level: Column | int, fanout: int) -> Column:
    """Number of nodes of a level of a group of `total` leaves."""
    step = F.lit(fanout**level) if isinstance(level, int) else F.pow(F.lit(fanout), level).cast("long")
    return F.expr("total") if isinstance(level, int) and level == 0 else F.floor((F.col("total") - 1) / step).cast("long") + 1


def build(rows: DataFrame, order: list[str], fanout: int = FANOUT) -> Manifest:
    """The trees of rows(grp, leaf, ...), one a group, its leaves ascending by `order`, then by leaf.

    grp is never null (group_key). Rows that repeat all of this are alike, and may stand in any
    order. One range shuffle deals the rows; a group or a repeated row of any size is spread over
    ranges, as the range key ends with the row's own number. An empty table gives empty trees.
    """
    numbered = materialize(rows.withColumn("_turn", F.monotonically_increasing_id()), "leaves")
    keys = ["grp", *order, "leaf", "_turn"]
    ranged = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_turn")
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), "ranges")
    discard(numbered)
    counts = ranged.groupBy("grp", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(counts.select("grp", "_part", "_first", before.alias("_start"), F.sum("_n").over(group).alias("total")), "starts")
    most = starts.agg(F.max("total")).first()[0] or 0
    placed = ranged.join(starts, ["grp", "_part"]).withColumn("idx", F.col("_start") + F.col("_seq") - F.col("_first"))
    placed = placed.drop("_part", "_seq", "_first", "_start")
    climbed = placed.select("grp", "total", "idx", "leaf").sortWithinPartitions("grp", "idx").mapInPandas(_climb(fanout), NODE_SCHEMA)
    pieces = materialize(climbed, "pieces")
    edges, nodes, made = pieces.where("children is null"), [pieces.where("children is not null")], None
    for level in range(len(level_sizes(most, fanout)) - 1):
        loose = edges.where(F.col("level") == level).select("grp", "total", "idx", "hash")
        if made is not None:
            loose = loose.unionByName(made.where(_size(level, fanout) > 1).select("grp", "total", "idx", "hash"))
        runs = loose.groupBy("grp", "total", F.floor(F.col("idx") / fanout).cast("long").alias("idx")).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), "hash"))).alias("run"))
        joined = runs.withColumn("children", F.array_join(F.col("run.hash"), "")).withColumn("hash", F.sha2("children", 256))
        made = materialize(joined.select("grp", "total", F.lit(level + 1).alias("level"), "idx", "hash", "children"), "merged")
        nodes.append(made)
    every = reduce(DataFrame.unionByName, nodes)
    lone = placed.where("total = 1").select("grp", F.col("leaf").alias("hash"))
    return Manifest(placed, every, lone.unionByName(every.where(_size(F.col("level"), fanout) == 1).select("grp", "hash")), most)


def _siblings(children: Column, idx: Column, fanout: int) -> Column:
    """What stands left and right of a node in its run."""
    k = (idx % fanout).cast("int")
    return F.array(F.struct(children.substr(F.lit(1), k * DIGEST).alias("before"), children.substr((k + 1) * DIGEST + 1, F.lit(DIGEST * fanout)).alias("after")))


def with_paths(tree: Manifest, above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """placed with `path`, the siblings from the leaf's run up to the root, and the columns of above(grp, path, ...), one row a group, which has the path from the group's top on.

    Paths go down from the tops: a join a level, each between nodes and their parents, so keys
    are unique on one side and met by at most `fanout` rows on the other.
    """
    extra = [c for c in above.columns if c not in ("grp", "path")]
    lower = None
    for level in range(len(level_sizes(tree.most, fanout)) - 1, 0, -1):
        own = tree.nodes.where(F.col("level") == level).select("grp", "total", "idx", "children")
        here = own.where(_size(level, fanout) == 1).join(above, "grp").select("grp", "idx", "children", "path", *extra)
        lower = here if lower is None else here.unionByName(_below(own.where(_size(level, fanout) > 1), lower, ["children"], extra, fanout))
    kept = [c for c in tree.placed.columns if c not in ("grp", "total", "idx")]
    lone = tree.placed.where("total = 1").join(above, "grp").select("grp", "idx", *kept, "path", *extra)
    return lone if lower is None else lone.unionByName(_below(tree.placed.where("total > 1"), lower, kept, extra, fanout))


def _below(rows: DataFrame, parents: DataFrame, kept: list[str], extra: list[str], fanout: int) -> DataFrame:
    parents = parents.select("grp", F.col("idx").alias("_up"), F.col("children").alias("_run"), F.col("path").alias("_path"), *extra)
    met = rows.withColumn("_up", F.floor(F.col("idx") / fanout).cast("long")).join(parents, ["grp", "_up"])
    return met.select("grp", "idx", *kept, F.concat(_siblings(F.col("_run"), F.col("idx"), fanout), F.col("_path")).alias("path"), *extra)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def build_manifest(rows: DataFrame, order: list[str], fanout: int = FANOUT) -> tuple[DataFrame, str | None]:
    """Rows with path, subroot and the other columns of rows(grp, leaf, ...), and the root over the groups' tops, None without rows.

    The groups' tops are the leaves of one more tree, ascending by group.
    """
    tree = build(rows, order, fanout)
    over = build(tree.tops.select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("hash").alias("leaf")), ["member"], fanout)
    top = over.tops.first()
    above = with_paths(over, over.tops.select("grp", F.array().cast(PATH).alias("path")), fanout)
    above = materialize(above.select(F.col("member").alias("grp"), "path", F.col("leaf").alias("subroot")), "group-paths")
    return with_paths(tree, above, fanout), top["hash"] if top else None


def manifest_of(docs: DataFrame, group: str = "source", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, tampered: Column | None = None) -> tuple[DataFrame, str | None]:
    """A manifest of a table: rows(group key, order, leaf, tampered, path, subroot) and root.

    A leaf is the hash of the given fields, nulls apart from empty texts; other columns are not
    read, so their names clash with nothing. `tampered` is a leaf hash to be checked in place of
    the leaf, null where there is none. A null group is a group of its own, the first; a null
    order value comes first. Rows that repeat an order value stand by their leaves, repeated
    rows side by side, each a leaf. Texts of any length are hashed whole, once.
    """
    other = tampered if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(group_key(F.col(group)).alias("grp"), F.col(order), leaf_hash(*map(F.col, fields)).alias("leaf"), other.alias("tampered"))
    return build_manifest(rows, [order])


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and what its root is after tampering with a fifth of the texts; a null doc_id is not tampered with."""
    docs = read_table(spark, sf_dir, "documents")
    lowered = leaf_hash(*[F.col(c) for c in FIELDS[:-1]], F.translate("text", UPPER, UPPER.lower()))
    rows, root = manifest_of(docs, tampered=F.when(id_fold(F.col("doc_id"), 5) == 0, lowered))
    folded = fold(F.col("path"), F.coalesce("tampered", "leaf"))
    out = rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = """
WITH RECURSIVE bytes AS (
  SELECT list(n ORDER BY k) AS t FROM (
    SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS n
    FROM (SELECT unnest(range(256))::BIGINT AS k))),
docs AS (
  SELECT doc_id, coalesce('1' || source, '0') AS g, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS crc
  FROM documents, bytes),
leaves AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS low, crc % 5 = 0 AS tampered
  FROM docs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS total FROM leaves),
tree AS (
  SELECT g, 0 AS level, idx, total, leaf AS hash FROM placed
  UNION ALL
  SELECT g, any_value(level) + 1, idx // 16, any_value((total + 15) // 16), sha256(string_agg(hash, '' ORDER BY idx)) FROM tree WHERE total > 1 GROUP BY g, idx // 16),
tops AS (SELECT g, hash, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS total FROM tree WHERE total = 1),
over_tree AS (
  SELECT 0 AS level, idx, total, hash FROM tops
  UNION ALL
  SELECT any_value(level) + 1, idx // 16, any_value((total + 15) // 16), sha256(string_agg(hash, '' ORDER BY idx)) FROM over_tree WHERE total > 1 GROUP BY idx // 16),
beside AS (
  SELECT a.g, a.level, a.idx, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM tree a JOIN tree b ON a.g = b.g AND a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.total > 1 GROUP BY a.g, a.level, a.idx),
over_beside AS (
  SELECT a.level, a.idx, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM over_tree a JOIN over_tree b ON a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.total > 1 GROUP BY a.level, a.idx),
climb AS (
  SELECT p.g, p.idx AS leaf_idx, p.idx, 0 AS level, CASE WHEN tampered THEN low ELSE leaf END AS acc, '' AS proof FROM placed p
  UNION ALL
  SELECT c.g, c.leaf_idx, c.idx // 16, c.level + 1, sha256(b.l || c.acc || b.r), c.proof || b.l || b.r
  FROM climb c JOIN beside b ON b.g = c.g AND b.level = c.level AND b.idx = c.idx),
heights AS (SELECT g, max(level) AS h FROM tree GROUP BY g),
over_climb AS (
  SELECT c.g, c.leaf_idx, t.idx, 0 AS level, c.acc, c.proof FROM climb c JOIN heights h ON h.g = c.g AND h.h = c.level JOIN tops t ON t.g = c.g
  UNION ALL
  SELECT c.g, c.leaf_idx, c.idx // 16, c.level + 1, sha256(b.l || c.acc || b.r), c.proof || b.l || b.r
  FROM over_climb c JOIN over_beside b ON b.level = c.level AND b.idx = c.idx)
SELECT p.doc_id, p.leaf, t.hash AS subroot, r.hash AS root, sha256(c.proof) AS proof_sha256, c.acc AS folded_root, c.acc = r.hash AS verified
FROM placed p JOIN tops t ON t.g = p.g JOIN over_climb c ON c.g = p.g AND c.leaf_idx = p.idx JOIN over_tree r ON r.total = 1
WHERE c.level = (SELECT max(level) FROM over_tree)
"""
