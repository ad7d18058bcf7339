"""Token ids of whole batches for a tokenizer that drops white space and case.

Texts are cut at white space on their bytes. A piece is looked up by a 64-bit hash,
for all pieces at once in an open-addressing table, and its bytes are compared with
those kept of the piece found, so an equal hash alone never decides. Only pieces
that are new become strings and are encoded. A worker keeps a few tens of bytes per
known piece, and no string. Beyond ``memo`` pieces the table starts anew.

Pieces of ASCII letters in any case share an entry, since case is dropped. Pieces
with other characters, or with a character that special strings begin with, are
kept apart byte for byte.
"""

from __future__ import annotations

import re

import numpy as np

from emberlog.llm import tokens, word_hash
from emberlog.llm.common import enter, hold

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: A run of letters and the marks behind it are separate pre-tokens.
_WORD_AND_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!#$%&*;:?]+)")


#: Bytes of known pieces beyond which a worker starts anew.
MAX_SPELT = 32 << 20


class Table:
    """Numbers by hash: open addressing with steps of one, vectorised."""

    def __init__(self, bits: int):
        self.bits = bits
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.key = np.zeros(1 << bits, U)
        self.value = np.full(1 << bits, -1, np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        out = np.full(len(key), -1, np.int64)
        left, at = np.arange(len(key)), (key >> self.shift).astype(np.int64)
        while len(left):
            value = self.value[at]
            hit = (value >= 0) & (self.key[at] == key[left])
            out[left[hit]] = value[hit]
            go_on = (value >= 0) & ~hit
            left, at = left[go_on], (at[go_on] + 1) & self.mask
        return out

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        """Put in new, distinct entries."""
        left, at = np.arange(len(key)), (key >> self.shift).astype(np.int64)
        while len(left):
            free = self.value[at] < 0
            self.value[at[free]] = value[left[free]]  # of several for one place the last wins
            won = free & (self.value[at] == value[left])
            self.key[at[won]] = key[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def grown(self) -> Table:
        """A table of twice the places with the same entries."""
        out, held = Table(self.bits + 1), self.value >= 0
        out.add(self.key[held], self.value[held])
        return out


class WordEncoder:
    def __init__(self, path: str, memo: int = 1_000_000, hashes=word_hash.hashes):
        self.rows = tokens.RowEncoder(path, lengths_only=False)
        self.memo, self.hashes = memo, hashes
        first = {c[0] for c in self.rows.added if c}
        if any(ord(c) > 127 for c in first):
            raise ValueError("special strings have to begin with an ASCII character")
        self.apart = np.arange(256) >= 128
        self.apart[[ord(c) for c in first]] = True
        self._reset()

    def _reset(self) -> None:
        self.table = Table(12)
        self.known = self.used = self.spelt = 0
        self.counts, self.starts, self.ids = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        # the bytes of the known pieces, where each begins and its size
        self.bytes, self.at, self.size = np.zeros(8192, np.uint8), np.zeros(1024, np.int64), np.zeros(1024, np.int32)

    def token_ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (slices of ``data`` between offsets) one after another, and how many each text has."""
        if self.known > self.memo or self.spelt > MAX_SPELT:
            self._reset()
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        start, end = word_hash.runs(data, off, _SPACE)
        seen = np.concatenate([[0], np.cumsum(self.apart[data])])
        apart = seen[end] > seen[start]
        step = np.zeros(n + 1, np.int8)
        step[start[apart]] += 1
        step[end[apart]] -= 1
        shown = np.where(np.cumsum(step[:-1], dtype=np.int8) > 0, data, _FOLD[data])
        pad, size = word_hash.padded(shown), end - start
        key = self.hashes(pad, start, end)
        number = self.table.find(key)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            _, one = np.unique(key[missing], return_index=True)
            one = missing[one]
            self._learn(pad, start[one], size[one], key[one])
            number[missing] = self.table.find(key[missing])
        # the hash finds, the bytes decide
        equal = size == self.size[number]
        equal[equal] = word_hash.same(pad, start[equal], self.bytes, self.at[number[equal]], size[equal])
        if not equal.all():
            number[~equal] = self._strays(pad, start[~equal], size[~equal])
        counts = self.counts[number].astype(np.int64)
        total, bounds = np.concatenate([[0], np.cumsum(counts)]), np.searchsorted(start, off)
        return tokens.gather(self.ids, self.starts[number], counts), np.diff(total[bounds])

    def _strays(self, pad: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of pieces whose hash another piece has: kept, but not found by hash."""
        place: dict[bytes, int] = {}
        which = np.array([place.setdefault(pad[a : a + n].tobytes(), len(place)) for a, n in zip(start.tolist(), size.tolist())])
        first = np.array([int(np.flatnonzero(which == k)[0]) for k in range(len(place))])
        return self._learn(pad, start[first], size[first], None)[which]

    def _learn(self, pad: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray | None) -> np.ndarray:
        """Encode new pieces and number them; of a word with marks behind it both parts on their own."""
        pieces = [pad[a : a + n].tobytes().decode() for a, n in zip(start.tolist(), size.tolist())]
        matched = [_WORD_AND_MARKS.fullmatch(p) for p in pieces]
        parts: dict[str, int] = {}
        number = lambda s: parts.setdefault(s, len(parts))
        pairs = np.array([(number(m[1]), number(m[2])) if m else (number(p), -1) for p, m in zip(pieces, matched)], np.int64)
        counts, ids = self.rows.encode(list(parts))
        own = pairs.ravel()
        own = own[own >= 0]
        per_piece = 1 + (pairs[:, 1] >= 0)
        total = np.add.reduceat(counts[own], np.cumsum(per_piece) - per_piece)
        flat = tokens.gather(ids, (np.cumsum(counts) - counts)[own], counts[own])
        new = np.arange(self.known, self.known + len(pieces))
        if key is not None:
            while self.known + len(pieces) > 3 << self.table.bits - 2:
                self.table = self.table.grown()
            self.table.add(key, new.astype(np.int32))
        self.starts = _put(self.starts, self.known, self.used + np.cumsum(total) - total)
        self.counts = _put(self.counts, self.known, total)
        self.ids = _put(self.ids, self.used, flat)
        self.at = _put(self.at, self.known, self.spelt + np.cumsum(size) - size)
        self.size = _put(self.size, self.known, size)
        self.bytes = _put(self.bytes, self.spelt, np.append(tokens.gather(pad, start, size), np.zeros(8, np.uint8)))
        self.known += len(pieces)
        self.used += len(flat)
        self.spelt += int(size.sum())
        return new


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """Write values behind the first ``at``; an array that is full is replaced by one twice as large."""
    if at + len(values) > len(array):
        larger = np.zeros(max(at + len(values), 2 * len(array)), array.dtype)
        larger[:at] = array[:at]
        array = larger
    array[at : at + len(values)] = values
    return array


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    enter("word_encoder")
    hold("word_encoder", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
