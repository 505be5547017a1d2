"""Token ids of whole texts by a tokenizers file, with a cache of pieces."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np

_TWO_SPACES = re.compile(r"\s\s")
#: Letters, then ASCII punctuation: one or two pre-tokens of a byte-level pre-tokenizer.
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")
_ENCODERS: dict[tuple[str, int], "PieceEncoder"] = {}


def encoder(path: str, cache_pieces: int = 300_000) -> "PieceEncoder":
    """One encoder a worker process, so tasks that follow one another share its cache."""
    key = (path, cache_pieces)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, cache_pieces)
    return _ENCODERS[key]


def forget_encoders() -> None:
    """Drop this worker process's encoders with their caches, hundreds of MB, once its tasks no longer encode."""
    _ENCODERS.clear()


class PieceEncoder:
    """Encodes texts with `Tokenizer.encode(text, add_special_tokens=False)` results.

    A byte-level pre-tokenizer cuts between a non-space and a single white space after it, so a
    text without two white spaces in a row is the concatenation of its pieces (" word", or a
    line end and a word), and each distinct piece is encoded once. Texts with two white spaces
    in a row, texts that hold the string of an added token, and all texts of other kinds of
    tokenizer are encoded whole. When the cache holds over cache_pieces pieces or 16 times as
    many ids, the pieces that came up again since they were added, or since the last time, stay. The usual piece, letters and then punctuation marks, goes to the
    tokenizer's model by its two parts, which spares the rest of the library's work.
    """

    def __init__(self, path: str, cache_pieces: int) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = json.loads(self.tokenizer.to_str())
        level, line = pre.get("pre_tokenizer") or {}, self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_pieces = level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space") and not pre.get("normalizer")
        self.line = line[0] if len(line) == 1 else None
        kept = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves in a byte-level vocabulary
        self.byte_chars = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in kept)}
        self.space = chr(self.byte_chars[32])
        self.by_parts = self.by_pieces and self.line is not None and (pre.get("model") or {}).get("type") == "BPE"
        self.tokenize = self.tokenizer.model.tokenize  # each access to the model makes a new object
        self.cache_pieces = cache_pieces
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.parts: dict[str, tuple[int, ...]] = {}  # ids of a space and letters
        self.bare: dict[str, tuple[int, ...]] = {}  # ids of letters and of marks without a space
        self.sizes = np.zeros(1024, dtype=np.int64)
        self.starts = np.zeros(1024, dtype=np.int64)
        self.again = np.zeros(1024, dtype=bool)
        self.flat = np.zeros(4096, dtype=np.uint32)
        self.used = 0

    def _trim(self) -> None:
        n = len(self.slots)
        stay = np.flatnonzero(self.again[:n])
        names = list(compress(self.slots, self.again[:n].tolist()))  # slots count up in the order of the dict
        sizes, ids = self.sizes[stay], ragged_take(self.flat, self.starts[stay], self.sizes[stay])
        self._clear()
        if 2 * len(names) <= self.cache_pieces and len(ids) <= 8 * self.cache_pieces:
            self._put(names, ids, np.cumsum(sizes) - sizes, sizes)

    def _keys(self, text: str) -> list[str]:
        """Keys of a text's pieces: w for " w", a line end and w for itself, NUL and w for w without a space, two NUL and a whole text."""
        if not self.by_pieces or "\0" in text or _TWO_SPACES.search(text) or any(s in text for s in self.specials):
            return ["\0\0" + text]
        words = text.replace("\n", " \n").split(" ")
        if words[0]:
            words[0] = "\0" + words[0]
            return words
        return words[1:]

    def _put(self, pieces: list[str], ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        slot, end = len(self.slots), self.used + len(ids)
        while slot + len(pieces) > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), end), dtype=np.uint32)])
        self.flat[self.used : end] = ids
        self.sizes[slot : slot + len(pieces)], self.starts[slot : slot + len(pieces)] = sizes, self.used + begins
        self.used = end
        self.slots.update(zip(pieces, range(slot, slot + len(pieces)), strict=True))

    def _part(self, part: str, spaced: bool) -> tuple[int, ...]:
        """Ids of one pre-token, a space before it or not, by the tokenizer's model."""
        chars = part if part.isascii() else part.encode("utf-8").decode("latin-1").translate(self.byte_chars)
        return tuple([t.id for t in self.tokenize(self.space + chars if spaced else chars)])

    def _add(self, keys: list[str]) -> None:
        """Encode new pieces: by parts where they are letters and marks, else many in one text with line ends between them, odd ones alone."""
        simple, odd, by_parts = [], [], []
        flat: list[int] = []
        ends: list[int] = []
        together = self.line is not None and self.by_pieces
        match = _WORD_AND_MARKS.fullmatch if self.by_parts else lambda _: None
        if len(self.parts) > self.cache_pieces // 2:
            self.parts.clear()
        if len(self.bare) > self.cache_pieces // 2:
            self.bare.clear()
        for key in keys:
            lead = key[:1]
            body = key[1:] if lead == "\0" or lead == "\n" else key
            found = match(body)
            if found is not None and (body.isascii() or (max(body) < "\u0250" and found[1].isalpha())) and len(body) < 1000:
                letters, marks = found.groups()
                if lead == "\n":
                    flat.append(self.line)
                known = self.parts if body is key else self.bare
                ids = known.get(letters)
                if ids is None:
                    ids = known[letters] = self._part(letters, body is key)
                flat += ids
                if marks:
                    ids = self.bare.get(marks)
                    if ids is None:
                        ids = self.bare[marks] = self._part(marks, False)
                    flat += ids
                by_parts.append(key)
                ends.append(len(flat))
            elif together and len(key) < 1000 and body[:1] != "\0" and body.split() == [body]:
                simple.append(key)
            else:
                odd.append(key)
        if by_parts:
            stops = np.array(ends, dtype=np.int64)
            begins = np.concatenate([[0], stops[:-1]])
            self._put(by_parts, np.array(flat, dtype=np.uint32), begins, stops - begins)
        for at in range(0, len(simple), 5_000):
            part = simple[at : at + 5_000]
            text = "\n" + "\n".join(k[1:] if k[0] in "\0\n" else " " + k for k in part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cuts = np.flatnonzero(ids == self.line)
            if len(cuts) != len(part):
                raise RuntimeError("pieces do not stand apart in this tokenizer")
            own_line = np.fromiter((k[0] == "\n" for k in part), dtype=np.int64, count=len(part))
            begins = cuts + 1 - own_line
            self._put(part, ids, begins, np.append(cuts[1:], len(ids)) - begins)
        for key in odd:
            text = key[2:] if key[:2] == "\0\0" else key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            self._put([key], ids, np.zeros(1, dtype=np.int64), np.array([len(ids)]))

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text; null counts as empty."""
        if len(self.slots) > self.cache_pieces or self.used > 16 * self.cache_pieces:
            self._trim()
        known = len(self.slots)
        pieces: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            own = self._keys(text) if text else []
            pieces += own
            counts[i] = len(own)
        slots = np.fromiter(map(self.slots.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        new = np.flatnonzero(slots < 0)
        if len(new):
            own = [pieces[i] for i in new.tolist()]
            self._add(list(dict.fromkeys(own)))
            slots[new] = np.fromiter(map(self.slots.__getitem__, own), dtype=np.int64, count=len(own))
        self.again[slots[slots < known]] = True
        sizes = self.sizes[slots]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total, dtype=np.int64) + np.repeat(self.starts[slots] - (ends - sizes), sizes)
        ids = self.flat[source]
        piece_ends = np.concatenate([[0], ends])
        doc_ends = piece_ends[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[doc_ends[i] : doc_ends[i + 1]] for i in range(len(texts))]


def text_batches(texts: list[str | None], max_chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about max_chars characters, one text at least."""
    start = chars = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and chars + n > max_chars:
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)


def ragged_take(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[s : s + n] for every (s, n), end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)]
