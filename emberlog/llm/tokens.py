"""Tokenising through pieces cut at safe boundaries.

A byte-level pre-tokeniser starts a pre-token before every single space that stands
between two other characters, so a text may be cut there before any merge. Pieces
repeat far more often than texts do; each worker encodes a piece once and keeps
the result in a bounded memo, which changes speed alone.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from emberlog.llm.common import enter, hold, slices_by_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A cut before one space or line feed that stands between two other characters:
#: the byte-level pre-tokeniser starts a pre-token there in any context.
BEFORE_SINGLE_SPACE = re.compile(r"(?<=\S)(?=[ \n]\S)")


class RowEncoder:
    """Encodes many short strings: rows of about ROW characters of them are joined by a special
    token, which the tokenizer takes out of a text before anything else is done to it. Rows are
    encoded in batches of about BATCH characters; a longer string is a row and a batch of its own."""

    ROW, BATCH = 512, 1 << 16

    def __init__(self, path: str, lengths_only: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lengths_only = lengths_only
        added = self.tokenizer.get_added_tokens_decoder().items()
        special = sorted((t.content, i) for i, t in added if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized))
        self.mark = special[0] if special else (None, -1)
        self.added = [t.content for _, t in added]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of the pieces. Those that hold the joining string stand alone."""
        mark, mark_id = self.mark
        rows: list[list[str]] = []
        room = -1  # no row is open
        for piece in pieces:
            alone = mark is None or mark in piece
            if alone or len(piece) > room:
                rows.append([piece])
                room = -1 if alone else max(0, self.ROW - len(piece))  # -1: not even an empty piece
            else:
                rows[-1].append(piece)
                room -= len(piece)
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        sizes = np.cumsum([0, *(sum(map(len, r)) for r in rows)])
        for a, z in slices_by_bytes(sizes, self.BATCH):
            block = rows[a:z]
            done = self.tokenizer.encode_batch_fast([r[0] if len(r) == 1 else mark.join(r) for r in block], add_special_tokens=False)
            for r, e in zip(block, done):
                own = np.array(e.ids, np.uint32)
                if len(r) == 1:
                    counts.append(np.array([len(own)]))
                else:
                    cuts = np.flatnonzero(own == mark_id)
                    counts.append(np.diff(cuts, prepend=-1, append=len(own)) - 1)
                    own = own[own != mark_id] if not self.lengths_only else own
                if not self.lengths_only:
                    ids.append(own)
        return np.concatenate(counts), np.concatenate(ids)


class _Numbers(dict):
    """Numbers new keys in the order in which they are asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class PieceCounter:
    """Token counts of texts, piece by piece. Beyond ``memo`` pieces, or MEMO_CHARS characters of them, the memo starts anew."""

    MEMO_CHARS = 32 << 20

    def __init__(self, path: str, memo: int = 1_000_000):
        self.rows, self.memo = RowEncoder(path, lengths_only=True), memo
        self._reset()

    def _reset(self) -> None:
        self.number = _Numbers()
        self.counts = np.zeros(0, np.int64)
        self.chars = 0

    def count_tokens(self, texts: list[str]) -> np.ndarray:
        if len(self.number) > self.memo or self.chars > self.MEMO_CHARS:
            self._reset()
        cut = [BEFORE_SINGLE_SPACE.split(t) for t in texts]
        per_text = np.fromiter(map(len, cut), np.int64, len(cut))
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(per_text.sum()))
        new, self.number.new = self.number.new, []
        if new:
            self.counts = np.concatenate([self.counts, self.rows.encode(new)[0]])
            self.chars += sum(map(len, new))
        total, ends = np.concatenate([[0], np.cumsum(self.counts[numbers])]), np.cumsum(per_text)
        return total[ends] - total[ends - per_text]


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` one after another."""
    before = np.cumsum(counts) - counts
    return values[np.repeat(starts - before, counts) + np.arange(counts.sum())]


def groups(texts: list[str], most: int):
    """Consecutive texts of about ``most`` characters together."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most or i == len(texts) - 1:
            yield texts[start : i + 1]
            start, size = i + 1, 0


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """One counter for each worker process and file."""
    enter("tokens")
    hold("tokens", _COUNTERS.clear)
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]
