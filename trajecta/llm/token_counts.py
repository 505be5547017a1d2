"""Operator 9: token counts under edits, by a tree of pre-token segments for each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm.common import materialize, read_table
from trajecta.llm.tokens import PieceEncoder, encoder, text_batches

EDIT = "array<struct<start:int,length:int,replacement:string>>"


def safe_cut(left: str, right: str) -> bool:
    """Whether tokens of left + right are those of left and then those of right: a word, then one space and a word."""
    return len(right) > 1 and right[0] == " " and not right[1].isspace() and bool(left) and not left[-1].isspace()


def segments_of(text: str, about: int = 96) -> list[str]:
    """Cut a text at safe places into segments of about so many characters."""
    out, start = [], 0
    while len(text) - start > about:
        at = text.find(" ", start + about)
        while 0 < at < len(text) - 1 and not safe_cut(text[at - 1], text[at : at + 2]):
            at = text.find(" ", at + 1)
        if at < 0 or at >= len(text) - 1:
            break
        out.append(text[start:at])
        start = at
    if start < len(text):
        out.append(text[start:])
    return out


class CountTree:
    """Segments as leaves of a binary tree whose nodes hold sums of characters and tokens."""

    def __init__(self, leaves: list[str], tokens: list[int]) -> None:
        self.leaves = list(leaves)
        self.width = 1
        while self.width < max(1, len(leaves)):
            self.width *= 2
        self.chars, self.tokens = np.zeros(2 * self.width, dtype=np.int64), np.zeros(2 * self.width, dtype=np.int64)
        self.chars[self.width : self.width + len(leaves)] = [len(x) for x in leaves]
        self.tokens[self.width : self.width + len(leaves)] = tokens
        self.leaves += [""] * (self.width - len(leaves))
        level = self.width // 2
        while level:
            for sums in (self.chars, self.tokens):
                sums[level : 2 * level] = sums[2 * level : 4 * level : 2] + sums[2 * level + 1 : 4 * level : 2]
            level //= 2
        self.encoded_chars = 0

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, and the character's place in it."""
        node = 1
        while node < self.width:
            node *= 2
            if at >= self.chars[node]:
                at -= int(self.chars[node])
                node += 1
        return node - self.width, at

    def put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self.width + leaf
        dc, dt = len(text) - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += dc
            self.tokens[node] += dt
            node //= 2

    def edit(self, start: int, length: int, replacement: str, enc: PieceEncoder) -> None:
        """Replace characters, and encode again only the leaves touched and as many neighbours as the cuts at both ends need.

        start and length are clipped to the text. The region goes to its first leaf; its other
        leaves become empty.
        """
        n = int(self.chars[1])
        start = min(max(start, 0), n)
        length = min(max(length, 0), n - start)
        if not length and not replacement:
            return
        if not n:
            self.put(0, replacement, len(enc.encode_many([replacement])[0]))
            self.encoded_chars += len(replacement)
            return
        first, inside = self.find(start) if start < n else self._last()
        last, _ = self.find(start + length - 1) if length else (first, 0)
        region = "".join(self.leaves[first : last + 1])
        region = region[:inside] + replacement + region[inside + length :]
        while (before := self._near(first, -1)) is not None and not safe_cut(self.leaves[before], region):
            first, region = before, self.leaves[before] + region
        while (after := self._near(last, 1)) is not None and not safe_cut(region, self.leaves[after]):
            last, region = after, region + self.leaves[after]
        self.encoded_chars += len(region)
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self.put(leaf, "", 0)
        self.put(first, region, len(enc.encode_many([region])[0]))

    def _last(self) -> tuple[int, int]:
        leaf = self._outermost(1, 1)
        return leaf, len(self.leaves[leaf])

    def _outermost(self, node: int, side: int) -> int:
        """The first (side 0) or last (side 1) leaf with text under a node that has any."""
        while node < self.width:
            node = 2 * node + side if self.chars[2 * node + side] else 2 * node + 1 - side
        return node - self.width

    def _near(self, leaf: int, step: int) -> int | None:
        """The next leaf with text to the left (-1) or right (1), by the sums on the way up."""
        node = leaf + self.width
        while node > 1:
            if (node % 2 == 0) == (step > 0) and self.chars[node ^ 1]:
                return self._outermost(node ^ 1, 0 if step > 0 else 1)
            node //= 2
        return None


def build_trees(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """State rows (doc_id, text, segment_chars, segment_tokens): the leaves of each document's tree; null text counts as empty."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for a, b in text_batches(texts):
                cut = [segments_of(t) for t in texts[a:b]]
                counts = np.array([len(x) for x in enc.encode_many([s for segs in cut for s in segs])], dtype=np.int32)
                ends = np.cumsum([len(x) for x in cut])
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[a:b].astype("Int64").to_numpy(dtype=object, na_value=None),
                        "text": texts[a:b],
                        "segment_chars": [[len(s) for s in segs] for segs in cut],
                        "segment_tokens": [counts[e - len(s) : e] for e, s in zip(ends, cut, strict=True)],
                    }
                )

    return docs.select("doc_id", "text").mapInPandas(build, "doc_id long, text string, segment_chars array<int>, segment_tokens array<int>")


def attach_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Add each document's edits(doc_id, seq, start, length, replacement) in the order of seq as the column `edits`."""
    own = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "length", "replacement"))).alias("edits"))
    own = own.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].cast("int").alias("start"), e["length"].cast("int").alias("length"), e["replacement"].alias("replacement"))))
    return trees.join(own, "doc_id", "left").withColumn("edits", F.coalesce("edits", F.expr(f"cast(array() as {EDIT})")))


def whole(x: float | None) -> int:
    """A number that pandas may have made a float or NaN; null counts as 0."""
    return 0 if x is None or x != x else int(x)


def apply_edits(trees: DataFrame, tokenizer_path: str, keep_state: bool = False) -> DataFrame:
    """Apply `edits` to each tree of trees(doc_id, text, segment_chars, segment_tokens, edits).

    Returns doc_id, n_tokens before and n_tokens_after, n_chars_after, encoded_chars (characters
    encoded again), n_segments; with keep_state also the new text and segments. An edit's
    start counts characters of the text as the edits before it left it. The edits of one document
    are one list and must fit a row. Null or missing edits
    change nothing; null doc_ids and repeated rows are edited row by row; an empty table gives
    no rows.
    """

    def change(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                text, ends = r.text or "", np.concatenate([[0], np.cumsum(r.segment_chars, dtype=np.int64)])
                tree = CountTree([text[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], list(r.segment_tokens))
                before = tree.total
                for e in r.edits if r.edits is not None else []:
                    if e is not None:
                        tree.edit(whole(e["start"]), whole(e["length"]), e["replacement"] or "", enc)
                row = [None if pd.isna(r.doc_id) else int(r.doc_id), before, tree.total, int(tree.chars[1]), tree.encoded_chars, len(r.segment_chars)]
                if keep_state:
                    live = [i for i, x in enumerate(tree.leaves) if x]
                    row += [tree.text(), [len(tree.leaves[i]) for i in live], [int(tree.tokens[tree.width + i]) for i in live]]
                rows.append(row)
            names = ["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "encoded_chars", "n_segments"]
            names += ["text", "segment_chars", "segment_tokens"] if keep_state else []
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_tokens long, n_tokens_after long, n_chars_after long, encoded_chars long, n_segments int"
    schema += ", text string, segment_chars array<int>, segment_tokens array<int>" if keep_state else ""
    return trees.select("doc_id", "text", "segment_chars", "segment_tokens", "edits").mapInPandas(change, schema)


def sample_edits(text: Column) -> Column:
    """Three edits a document at places that a hash of the text decides: an insertion, a deletion, a replacement."""
    n = F.length(text)
    place = lambda k: F.pmod(F.xxhash64(text, F.lit(k)), F.greatest(n, F.lit(1)).cast("long")).cast("int")
    return F.array(
        F.struct(place(1).alias("start"), F.lit(0).alias("length"), F.lit(" as amended by the editor").alias("replacement")),
        F.struct(place(2).alias("start"), F.lit(37).alias("length"), F.lit("").alias("replacement")),
        F.struct(place(3).alias("start"), F.lit(11).alias("length"), F.lit("[redacted]").alias("replacement")),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each; the trees are kept as a table between the two."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    trees = materialize(build_trees(read_table(spark, sf_dir, "documents"), path), "count-trees")
    return apply_edits(trees.withColumn("edits", sample_edits(F.col("text"))), path)
