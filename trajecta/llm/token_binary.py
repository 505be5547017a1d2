"""Operator 2: token ids in grammar-compressed shards (batched Re-Pair) with random access."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.llm.common import read_table, shared_path
from trajecta.llm.tokens import encoder, ragged_take, text_batches

#: One row is one shard. Symbols below `base` are ranks in `alphabet`; symbol base + r is rule r.
SHARD_SCHEMA = (
    "part int, seq int, n_docs int, n_tokens long, doc_ids array<bigint>, doc_tokens array<int>, doc_symbols array<int>, "
    "symbol_bytes int, alphabet binary, rules binary, rule_lengths binary, sequence binary"
)
#: Symbols of two bytes; a shard of more distinct ids than that takes four bytes a symbol.
_SHORT_SYMBOLS = 65_536


def _frequent_pairs(keys: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys that occur min_count times, their counts, and for each key its place among them or -1."""
    order = np.sort(keys)
    cuts = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.concatenate([cuts, [len(order)]]))
    often = counts >= min_count
    names, counts = order[cuts[often]], counts[often]
    if not len(names):
        return names, counts, np.full(len(keys), -1, dtype=np.int32)
    fold = lambda k: ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)
    table = np.full(1 << 20, -1, dtype=np.int32)
    table[fold(names)] = np.arange(len(names), dtype=np.int32)
    place = table[fold(keys)]
    look = np.flatnonzero(place >= 0)
    other = look[names[place[look]] != keys[look]]  # keys of another name's slot
    at = np.searchsorted(names, keys[other])
    at[at == len(names)] = 0
    place[other] = np.where(names[at] == keys[other], at, -1)
    return names, counts, place


def _outranking(at: np.ndarray, own: np.ndarray, prio: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The places among `at` whose pair ranks before the pairs at both overlapping places; prio is all-high but during the call."""
    prio[at] = own
    best = at[(own < prio[after[at]]) & (own < prio[before[at]])]
    prio[at] = np.iinfo(np.uint64).max
    return best


def repair_compress(
    ids: np.ndarray, doc_sizes: np.ndarray, min_count: int = 8
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over one shard: (alphabet, rules[n, 2], rule lengths, sequence, symbols of each document).

    A round ranks all pairs that occur min_count times, the most frequent first. Pairs that
    outrank what they overlap in min_count places get a rule each, and all their occurrences
    are replaced but those that a replaced one overlaps; so the best pair loses none, and runs
    of one symbol go by twos. Only pairs beside replaced ones change: the counts of old ones go
    down, and the others hold a new symbol and are counted alone. Rounds stop when no pair
    occurs min_count times without overlap or, where the ids of the shard fit two bytes, when
    rules have used up the symbols of two bytes. Pairs never cross the end of a document, so
    each document is a range of the sequence.
    """
    if int(ids.max()) < 1 << 24:
        present = np.zeros(int(ids.max()) + 1, dtype=bool)
        present[ids] = True
        alphabet = np.flatnonzero(present)
        seq = (np.cumsum(present) - 1).astype(np.uint64)[ids]
    else:
        alphabet, seq = np.unique(ids, return_inverse=True)
        seq = seq.astype(np.uint64)
    limit = _SHORT_SYMBOLS if len(alphabet) <= _SHORT_SYMBOLS else 1 << 32
    n, half, low = len(seq), np.uint64(32), np.uint64(0xFFFFFFFF)
    last, gone, busy = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool), np.zeros(n + 1, dtype=bool)
    last[np.cumsum(doc_sizes)[doc_sizes > 0] - 1] = True
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    pair = np.full(n + 1, -1, dtype=np.int32)  # the frequent pair that starts at each place; one place more stands for "none"
    prio = np.full(n + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    turn = (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B1)) & low  # decides between overlapping equal pairs
    inner = ~last[:-1]
    names, counts, place = _frequent_pairs((seq[:-1] << half | seq[1:])[inner], min_count)
    live = np.flatnonzero(inner).astype(np.int32)
    pair[live] = place
    live = live[place >= 0]
    left_of, right_of, n_symbols = [], [], len(alphabet)
    while len(live) and n_symbols < limit:
        rank = np.empty(len(counts), dtype=np.uint64)
        rank[np.lexsort((names, -counts))] = np.arange(len(counts), dtype=np.uint64)
        first = _outranking(live, rank[pair[live]] << half | turn[live], prio, before, after)
        good = np.flatnonzero(np.bincount(pair[first], minlength=len(counts)) >= min_count)
        good = good[np.argsort(rank[good])][: limit - n_symbols]
        number = np.zeros(len(counts), dtype=np.uint64)
        number[good] = np.arange(n_symbols, n_symbols + len(good), dtype=np.uint64)
        fresh, more = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        if len(good):
            n_symbols += len(good)
            left_of.append(names[good] >> half)
            right_of.append(names[good] & low)
            open_at, chosen = live[number[pair[live]] > 0], []
            first = first[number[pair[first]] > 0]
            while len(first):
                chosen.append(first)
                for x in (first, after[first], before[first]):
                    busy[x] = True
                open_at = open_at[~busy[open_at]]
                first = _outranking(open_at, rank[pair[open_at]] << half | turn[open_at], prio, before, after)
            first = np.concatenate(chosen)
            second, ahead = after[first], before[first]
            for x in (first, second, ahead):
                busy[x] = False
            busy[first] = busy[second] = True  # ends of pairs that this round undoes
            third = after[second]
            ahead = ahead[(ahead >= 0) & ~busy[ahead]]
            lost = np.concatenate([first, second, ahead])
            busy[first] = busy[second] = False
            seen = pair[lost]
            counts = counts - np.bincount(seen[seen >= 0], minlength=len(counts))
            seq[first] = number[pair[first]]
            pair[lost] = -1
            gone[second], last[first], after[first] = True, last[second], third
            inside = third < n
            before[third[inside]] = first[inside]
            fresh = np.concatenate([first, ahead])  # first keeps its place where two replaced pairs meet
            fresh = fresh[~last[fresh]]
            live = live[pair[live] >= 0]
            more, more_counts, place = _frequent_pairs(seq[fresh] << half | seq[after[fresh]], min_count)
            fresh, place = fresh[place >= 0], place[place >= 0]
            pair[fresh] = place + len(names)
            live, names, counts = np.concatenate([live, fresh]), np.concatenate([names, more]), np.concatenate([counts, more_counts])
        else:
            counts[rank == 0] = 0  # the best pair has enough places only with overlap
        keep = counts >= min_count
        stays = keep[pair[live]]
        pair[live[~stays]] = -1
        live = live[stays]
        pair[live] = (np.cumsum(keep) - 1)[pair[live]]
        names, counts = names[keep], counts[keep]
    rules = np.stack([np.concatenate(left_of), np.concatenate(right_of)], axis=1).astype(np.int64) if left_of else np.zeros((0, 2), dtype=np.int64)
    lengths = np.ones(n_symbols, dtype=np.int64)
    at = len(alphabet)
    for left, right in zip(left_of, right_of, strict=True):
        lengths[at : at + len(left)] = lengths[left.astype(np.int64)] + lengths[right.astype(np.int64)]
        at += len(left)
    seq, last = seq[~gone], last[~gone]
    doc_symbols = np.zeros(len(doc_sizes), dtype=np.int64)
    doc_symbols[doc_sizes > 0] = np.diff(np.concatenate([[0], np.flatnonzero(last) + 1]))
    return alphabet.astype(np.uint32), rules, lengths[len(alphabet) :], seq.astype(np.int64), doc_symbols


class ShardReader:
    """Random access to one shard: any range of its tokens is decoded from the symbols that cover it."""

    def __init__(self, symbol_bytes: int, alphabet: bytes, rules: bytes, rule_lengths: bytes, sequence: bytes) -> None:
        kind = f"<u{symbol_bytes}"
        self.alphabet = np.frombuffer(alphabet, dtype="<u4")
        self.rules = np.frombuffer(rules, dtype=kind).reshape(-1, 2).astype(np.int64)
        self.sequence = np.frombuffer(sequence, dtype=kind).astype(np.int64)
        self.lengths = np.concatenate([np.ones(len(self.alphabet), dtype=np.int64), np.frombuffer(rule_lengths, dtype="<u4").astype(np.int64)])
        self.ends = np.cumsum(self.lengths[self.sequence])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of the symbols, one level of the grammar a pass."""
        base = len(self.alphabet)
        while True:
            rule = symbols >= base
            if not rule.any():
                return self.alphabet[symbols]
            sizes = np.where(rule, 2, 1)
            starts = np.cumsum(sizes) - sizes
            out = np.empty(int(sizes.sum()), dtype=np.int64)
            out[starts[~rule]] = symbols[~rule]
            pair = self.rules[symbols[rule] - base]
            out[starts[rule]], out[starts[rule] + 1] = pair[:, 0], pair[:, 1]
            symbols = out

    def all(self) -> np.ndarray:
        """Every id: each symbol's expansion is built once from shorter ones, then copied."""
        base = len(self.alphabet)
        starts = np.cumsum(self.lengths) - self.lengths
        flat = np.empty(int(self.lengths.sum()), dtype=np.uint32)
        flat[:base] = self.alphabet
        done, n = base, len(self.lengths)
        while done < n:  # a rule only names earlier symbols; rules up to the first that names one of this pass go together
            rest = self.rules[done - base :]
            late = np.flatnonzero(rest.max(axis=1) >= done)
            upto = done + (int(late[0]) if len(late) else len(rest))
            for side, lead in ((0, np.zeros(upto - done, dtype=np.int64)), (1, self.lengths[self.rules[done - base : upto - base, 0]])):
                own = self.rules[done - base : upto - base, side]
                target = starts[done:upto] + lead
                sizes = self.lengths[own]
                ends = np.cumsum(sizes)
                to = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(target - (ends - sizes), sizes)
                flat[to] = ragged_take(flat, starts[own], sizes)
            done = upto
        return ragged_take(flat, starts[self.sequence], self.lengths[self.sequence])

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1 of the shard."""
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        first = int(np.searchsorted(self.ends, start, side="right"))
        final = int(np.searchsorted(self.ends, stop, side="left"))
        begin = int(self.ends[first] - self.lengths[self.sequence[first]])
        return self.expand(self.sequence[first : final + 1])[start - begin : stop - begin]


def write_token_shards(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, shard_tokens: int = 2_000_000, compression: str = "zstd"
) -> None:
    """Encode doc_id, text and write the shards, ascending by doc_id, as Parquet files at `path`.

    Null text counts as empty; a null doc_id sorts first; rows that repeat a doc_id are kept
    next to each other in the order of their texts; other columns are not read. Ranges of
    doc_id are dealt to tasks by one range shuffle of the texts; a task holds one shard of
    about shard_tokens ids (or one longer document) at a time.
    """
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        enc, end = encoder(tokenizer_path, cache_pieces=900_000), np.array([end_id], dtype=np.uint32)
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0

        def shard() -> pd.DataFrame:
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            alphabet, rules, lengths, sequence, symbols = repair_compress(np.concatenate(ids), sizes)
            symbol_bytes = 2 if len(alphabet) + len(rules) <= _SHORT_SYMBOLS else 4
            kind = f"<u{symbol_bytes}"
            return pd.DataFrame(
                {
                    "part": [part], "seq": [seq], "n_docs": [len(ids)], "n_tokens": [int(sizes.sum())], "doc_ids": [names],
                    "doc_tokens": [sizes.tolist()], "doc_symbols": [symbols.tolist()], "symbol_bytes": [symbol_bytes],
                    "alphabet": [alphabet.astype("<u4").tobytes()], "rules": [rules.astype(kind).tobytes()],
                    "rule_lengths": [lengths.astype("<u4").tobytes()], "sequence": [sequence.astype(kind).tobytes()],
                }
            )

        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            doc_ids = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
            for a, b in text_batches(texts):
                for name, own in zip(doc_ids[a:b], enc.encode_many(texts[a:b]), strict=True):
                    ids.append(np.concatenate([own, end]))
                    names.append(name)
                    held += len(own) + 1
                    if held >= shard_tokens:
                        yield shard()
                        ids, names, held, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    ranged.mapInPandas(shards, SHARD_SCHEMA).write.option("compression", compression).parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, shard_part, shard_seq, start_in_shard.

    Shard starts are sums of sums: parts first, then shards inside a part, so only a row a part
    meets in one window.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("seq_start")).join(parts, "part")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = ShardReader(row.symbol_bytes, row.alphabet, row.rules, row.rule_lengths, row.sequence).all().astype("<u4")
                sizes = np.asarray(row.doc_tokens, dtype=np.int64)
                ends = np.cumsum(sizes)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                names = pd.array([None if x is None or x != x else int(x) for x in row.doc_ids], dtype="Int64")
                yield pd.DataFrame(
                    {"doc_id": names, "part": row.part, "seq": row.seq, "start_in_shard": ends - sizes, "n_tokens": sizes, "ids_crc32": np.array(crc, dtype=np.int64)}
                )

    schema = "doc_id long, part int, seq int, start_in_shard long, n_tokens long, ids_crc32 long"
    shards = shards.select("part", "seq", "doc_ids", "doc_tokens", "symbol_bytes", "alphabet", "rules", "rule_lengths", "sequence")
    return (
        shards.mapInPandas(decode, schema)
        .join(starts, ["part", "seq"])
        .select(
            "doc_id", (F.col("part_start") + F.col("seq_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32",
            F.col("part").alias("shard_part"), F.col("seq").alias("shard_seq"), "start_in_shard",
        )
    )


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token shards in the shared folder and return the index that the files give."""
    import public_tokenizers

    path = shared_path(spark, "token-shards")
    write_token_shards(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_shards(spark, path)
