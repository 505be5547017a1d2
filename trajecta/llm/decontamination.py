"""Operator 5: benchmark decontamination by pigeonhole pieces and Myers bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm.common import discard, frugal, materialize, read_table

_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower case, with one space for every run that is no letter or digit."""
    return _GAP.sub(" ", text.lower()).strip() if text else ""


def error_budget(length: int, error_rate: float, min_piece: int) -> int:
    """Edits allowed for an item: error_rate of its length, but pieces keep min_piece characters."""
    return max(0, min(int(length * error_rate), length // min_piece - 1))


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces (start, piece) that cover the item: some piece survives any `budget` edits."""
    n, k = len(item), budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any substring of text, and its end, if within budget.

    Vertical differences of a whole column of the dynamic-programming table are two bit
    vectors, so each character of the text costs a few operations on integers of len(pattern) bits.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = ones, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (ones & ~(xh | plus))
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & ones, down << 1 & ones
        plus = down | (ones & ~(xv | up))
        minus = up & xv
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


class Matcher:
    """Exact piece search over a block of items, and verification of the spots that it finds."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_piece: int) -> None:
        import ahocorasick

        self.items = []
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            own = normalise(text)
            if own:
                budget = error_budget(len(own), error_rate, min_piece)
                for start, piece in pieces_of(own, budget):
                    at.setdefault(piece, []).append((len(self.items), start))
                self.items.append((item_id, own, budget))
        self.search = ahocorasick.Automaton()
        for piece, owners in at.items():
            self.search.add_word(piece, (len(piece), owners))
        if at:
            self.search.make_automaton()
        self.any = bool(at)
        self.seen: dict[tuple[int, str], tuple[int, int] | None] = {}
        self.seen_chars = 0

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of every item within its budget; the nearest spot of each."""
        own = normalise(text)
        if not own or not self.any:
            return []
        spots: dict[int, set[int]] = {}
        for end, (size, owners) in self.search.iter(own):
            for k, start in owners:
                spots.setdefault(k, set()).add(end + 1 - size - start)  # where the item would begin
        out = []
        for k, begins in spots.items():
            item_id, item, budget = self.items[k]
            m, best, done = len(item), None, None
            for begin in sorted(begins):
                if done is not None and begin <= done:
                    continue  # the window just verified holds it
                a, b = max(0, begin - budget), begin + m + 2 * budget + 1
                done = begin + budget if budget else begin
                window = own[a:b]
                exact = window.find(item)
                if exact >= 0:
                    hit = (0, exact + m)
                elif not budget:
                    continue
                else:
                    key = (k, window)
                    if key not in self.seen:
                        self.seen_chars += len(window)
                        if self.seen_chars > 16_000_000:
                            self.seen.clear()
                            self.seen_chars = len(window)
                        self.seen[key] = myers(item, window, budget)
                    hit = self.seen[key]
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], a + hit[1])
                    if not best[0]:
                        break
            if best:
                out.append((item_id, *best))
        return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, min_piece: int = 12, block_items: int = 20_000, block_chars: int = 16_000_000
) -> DataFrame:
    """Rows (doc_id, item_id, distance, end): items of benchmark(item_id, text) within the edit budget of a part of docs(doc_id, text).

    Both sides are normalised. An item of m characters may differ by
    min(error_rate * m, m / min_piece - 1) edits from some substring; cut into budget + 1 pieces,
    one piece must occur unchanged, so an automaton over all pieces finds every candidate, and
    Myers distance over the window around it decides. Items are taken in blocks of about
    block_items items and block_chars characters at most, with one scan of the documents a
    block; of several blocks each is written before the next is read, so the driver and the
    tasks hold one block however large the benchmark is. Null or empty texts and items match nothing; repeated rows give
    repeated results; other columns are not read; an empty table gives no rows.
    """
    schema = "doc_id long, item_id long, distance int, end long"
    out, blocks = None, item_blocks(benchmark, block_items, block_chars)
    for block in blocks:
        rows = _held(block)

        def scan(batches: Iterator[pd.DataFrame], rows=rows) -> Iterator[pd.DataFrame]:
            matcher = Matcher(rows.value, error_rate, min_piece)
            for batch in batches:
                found = [
                    (None if pd.isna(d) else int(d), *hit)
                    for d, t in zip(batch["doc_id"], batch["text"], strict=True)
                    for hit in matcher.find(t if isinstance(t, str) else None)
                ]
                frame = pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "end"])
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

        part = docs.select("doc_id", "text").mapInPandas(scan, schema)
        if len(blocks) > 1:
            part = materialize(part, "contamination")
            rows.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def item_blocks(benchmark: DataFrame, block_items: int, block_chars: int) -> list[DataFrame]:
    """Parts of benchmark(item_id, text), which the driver reads one at a time."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    n = max(1, -(-size["n"] // block_items), -(-(size["chars"] or 0) // block_chars))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _held(block: DataFrame):
    return block.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").collect()])


def without_contamination(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, min_piece: int = 12, block_items: int = 20_000, block_chars: int = 16_000_000
) -> DataFrame:
    """The rows of docs, whole, in whose text find_contamination finds nothing: judged one by one in the scan itself, so ids decide nothing and no join is needed.

    What a block leaves is written before the next block is read.
    """
    out, blocks = docs, item_blocks(benchmark, block_items, block_chars)
    for block in blocks:
        rows = _held(block)

        def clean(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(rows.value, error_rate, min_piece)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column("text").to_pylist()], type=pa.bool_()))

        left = out.mapInArrow(frugal(clean), out.schema)
        if len(blocks) > 1:
            left = materialize(left, "uncontaminated")
            rows.destroy()
            discard(out)
        out = left
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found, with edits, in all documents."""
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
