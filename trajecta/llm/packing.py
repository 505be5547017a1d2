"""Operator 7: best-fit packing with large-item matching."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm.common import dense_rank_slots, frugal, materialize, read_table
from trajecta.llm.tokens import encoder, text_batches

PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long, tie long"


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Pack items given as {size: how many} into bins; segments (size, first rank, first bin, offset).

    Items of a size are numbered from 0; those from a segment's first rank up to the next
    segment's go to consecutive bins from first bin on, at the same offset. Sizes above a third
    of the capacity are matched greedily, the largest with the largest that still fits beside
    it, at most two a bin. Smaller sizes, largest first, go to the bins with the tightest gap
    that holds them. The work depends on the number of sizes, at most `capacity`, and not on
    the number of items.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError(f"sizes must lie between 1 and {capacity}")
    taken = dict.fromkeys(left, 0)
    segments: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []
    n_bins = 0

    def put(size: int, first_bin: int, n: int, offset: int) -> None:
        segments.append((size, taken[size], first_bin, offset))
        taken[size] += n
        left[size] -= n

    def add_gap(gap: int, first_bin: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                bisect.insort(open_gaps, gap)
                gaps[gap] = []
            gaps[gap].append((first_bin, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        if not left[size]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - size) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at = min(at, len(large)) - 1
        mate = large[at] if at >= 0 else 0
        n = left[size] if not mate else left[size] // 2 if mate == size else min(left[size], left[mate])
        if not n:  # one item is left of a size that could only pair with its own
            smaller = [s for s in large[:at] if left[s]]
            mate, n = (smaller[-1], 1) if smaller else (0, 1)
        put(size, n_bins, n, 0)
        if mate:
            put(mate, n_bins, n, size)
        add_gap(capacity - size - mate, n_bins, n)
        n_bins += n
    for size in sorted((s for s in left if left[s]), reverse=True):
        while left[size]:
            at = bisect.bisect_left(open_gaps, size)
            if at == len(open_gaps):
                per_bin = capacity // size
                n = -(-left[size] // per_bin)
                add_gap(capacity, n_bins, n)
                n_bins += n
                continue
            gap = open_gaps[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(at)
            used = min(n, left[size])
            put(size, first, used, capacity - gap)
            add_gap(gap, first + used, n - used)
            add_gap(gap - size, first, used)
    return segments


def cut_into_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, cache_pieces: int = 900_000) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, tie): a document's ids and end_id, cut only if longer than capacity.

    The first piece takes the remainder, the others are full. Null text counts as empty. `tie`
    numbers equal rows so that repeated rows stay apart. A worker keeps the ids of about
    cache_pieces pieces: fewer take less of its memory and more time, and give the same rows.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), 0
        enc, end = encoder(tokenizer_path, cache_pieces), np.array([end_id], dtype=np.uint32)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            names = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
            for a, b in text_batches(texts):
                rows = []
                for name, own in zip(names[a:b], enc.encode_many(texts[a:b]), strict=True):
                    ids = np.concatenate([own, end]).astype("<u4")
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                    for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        rows.append((name, k, x, y - x, zlib.crc32(ids[x:y].tobytes()), (task << 40) + seen))
                        seen += 1
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "tie"])
                yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(frugal(pieces, encodes=True), PIECE_SCHEMA)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give every piece a sequence_id and an offset.

    The plan is made from the number of pieces of each length, at most `capacity` numbers;
    pieces are then numbered inside their length, over many tasks even where one length is
    very common, and looked up in the plan.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = plan_bins(counts, capacity)
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for size, rank, first_bin, offset in segments:
        by_size.setdefault(size, []).append((rank, first_bin, offset))
    sizes = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(v), strict=True)) for s, v in by_size.items()}
    plan = spark.sparkContext.broadcast(sizes)  # bounded: the segments of at most `capacity` sizes
    ranked = dense_rank_slots(pieces, ["length"], ["doc_id", "piece", "tie"], "rank", total=sum(counts.values()))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(dtype=np.int64), batch["rank"].to_numpy(dtype=np.int64)
            sequence, offset = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            for size in np.unique(length).tolist():
                own = length == size
                ranks, bins, offsets = plan.value[size]
                at = np.searchsorted(ranks, rank[own], side="right") - 1
                sequence[own] = bins[at] + rank[own] - ranks[at]
                offset[own] = offsets[at]
            out = batch[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["sequence_id"], out["offset"] = sequence, offset
            yield out

    return ranked.drop("tie").mapInPandas(
        frugal(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, cache_pieces: int = 900_000) -> DataFrame:
    """Tokenize, cut and pack: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null text is an empty document (its end id alone); null or repeated doc_ids and repeated
    rows are packed each as a document of its own; an empty table gives no rows.
    """
    return pack(materialize(cut_into_pieces(docs, tokenizer_path, capacity, end_id, cache_pieces), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)
