"""Merkle manifests against a plain Python version, over many ranges and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trajecta.llm.merkle import PeakStack, build, fold, level_sizes, manifest_of, op13_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, root string, idx string, path string, grp long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout=16):
    """Levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[k : k + fanout])) for k in range(0, len(low), fanout)])
    return levels


def beside(levels, k, fanout=16):
    out = []
    for nodes in levels[:-1]:
        a = k // fanout * fanout
        out.append(("".join(nodes[a:k]), "".join(nodes[k + 1 : a + fanout])))
        k //= fanout
    return out


def brute(rows):
    """Rows (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        leaf = sha("".join(map(field, (doc_id, source, lang, n, text))))
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        key = (source is not None, (source or "").encode())
        groups[key].append((doc_id is not None, doc_id or 0, leaf, sha("".join(map(field, (doc_id, source, lang, n, low)))) if tampered else leaf, doc_id))
    trees = {key: (sorted(own), climb([r[2] for r in sorted(own)])) for key, own in groups.items()}
    over = climb([trees[key][1][-1][0] for key in sorted(trees)])
    out = []
    for at, key in enumerate(sorted(trees)):
        own, levels = trees[key]
        for k, (_, _, leaf, seen, doc_id) in enumerate(own):
            path = beside(levels, k) + beside(over, at)
            acc = seen
            for left, right in path:
                acc = sha(left + acc + right)
            out.append((doc_id, leaf, levels[-1][0], over[-1][0], sha("".join(a + b for a, b in path)), acc, acc == over[-1][0]))
    return sorted(out, key=str)


def sources(rnd, n):
    """A third of the rows in one source, a few sources of one row, one without a name."""
    names = ["hot"] * 5 + [None, "", "é", "z", "Z", "a b", "0", "1"]
    rows = [(i, rnd.choice(["Text A", "plain", None, "", "É", "x" * 5000, "ABC"]), rnd.choice(["en", None]), rnd.choice(names), rnd.choice([None, 3, 12])) for i in range(n)]
    rows += [(5000 + k, "Alone", "en", f"one{k}", 5) for k in range(40)]
    rows += [(None, "No id", "en", "hot", 5), (None, None, None, None, None), (-4, "Below", "en", "hot", 5)]
    rows += [(77, "Same", "en", "hot", 4)] * 60 + [(77, "Other", "en", "hot", 5)]
    return rnd.sample(rows, len(rows))


@pytest.fixture
def many_ranges(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("n", [0, 1, 700])
def test_against_python(spark, tmp_path, many_ranges, n):
    rnd = random.Random(n)
    rows = sources(rnd, n) if n > 1 else [(5, "One Only", "en", "s", 8)] * n
    spark.createDataFrame([(*r, 1, "x", "x", "x", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)
    assert n < 2 or {r[6] for r in got} == {True, False}


def test_nodes_over_many_ranges(spark, many_ranges):
    rnd = random.Random(9)
    leaves = [(g, k, sha(f"{g} {k}")) for g, size in (("a", 1), ("b", 3), ("c", 4), ("d", 81), ("e", 200)) for k in range(size)]
    tree = build(spark.createDataFrame(rnd.sample(leaves, len(leaves)), "grp string, k long, leaf string"), ["k"], fanout=3)
    got = {(r.grp, r.level, r.idx): r.hash for r in tree.nodes.collect()}
    want = {}
    for g in "abcde":
        levels = climb([x[2] for x in leaves if x[0] == g], 3)
        want |= {(g, level, k): h for level, nodes in enumerate(levels) for k, h in enumerate(nodes) if level}
    assert got == want
    assert tree.nodes.count() == len(want)


def test_stack_leaves_only_edges():
    rnd = random.Random(3)
    for total in (1, 2, 15, 16, 17, 255, 257, 300):
        levels = climb([sha(str(k)) for k in range(total)])
        assert level_sizes(total) == [len(x) for x in levels]
        cuts = sorted({0, total, *(rnd.randrange(total) for _ in range(3))})
        nodes = {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            stack = PeakStack(total)
            for k in range(a, b):
                stack.push(k, levels[0][k])
            out = stack.finish()
            assert all(levels[level][idx] == digest for level, idx, digest, _ in out)
            edges = [r for r in out if r[3] is None]
            assert len(edges) <= 2 * 15 * len(levels)
            nodes |= {r[:2]: r[2] for r in out}
        if len(cuts) == 2 and total > 1:
            assert nodes[(len(levels) - 1, 0)] == levels[-1][0]


def test_a_changed_row_is_found(spark):
    docs = spark.createDataFrame([(k, "t", "en", "s" if k % 3 else None, 1) for k in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    wrong = F.when(F.col("doc_id") == 7, F.lit(sha("something else")))
    rows, root = manifest_of(docs, tampered=wrong)
    bad = rows.where(fold(F.col("path"), F.coalesce("tampered", "leaf")) != root).collect()
    assert [r.doc_id for r in bad] == [7]
