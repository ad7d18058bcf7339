"""Sets of word shingles as sorted 64-bit hashes, computed for whole batches of bytes.

Words are the runs of bytes other than space and \\t\\n\\v\\f\\r, with A-Z folded to
a-z. A text's set holds its distinct ``width``-word shingles; a text of fewer words,
but some, has one element, its whole sequence; a text without words has none.

Elements are known by 64-bit hashes, made of the words' hashes (see ``word_hash``)
by mixing that isn't linear. Two different shingles of a text, or of two texts that
are compared, agree with a probability of 2^-64 for each pair of them.
"""

from __future__ import annotations

import hashlib

import numpy as np

from emberlog.llm import word_hash
from emberlog.llm.common import enter, slices_by_bytes
from emberlog.llm.word_hash import U, mix

_BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are hashed together.
SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _slice_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (and the last end)."""
    if len(data) == 0:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    start, end = word_hash.runs(data, off, _SPACE)
    return word_hash.hashes(word_hash.padded(_FOLD[data]), start, end), np.searchsorted(start, off)


#: Slots of the word sketch; a word's slot is the top of its hash.
SLOT_BITS = 18


def slot(word: np.ndarray) -> np.ndarray:
    return (word >> U(64 - SLOT_BITS)).astype(np.int64)


def _slice_sets(word: np.ndarray, bounds: np.ndarray, width: int, weight: np.ndarray | None):
    rolled = np.zeros(max(0, len(word) - width + 1), U)
    for k in range(width if len(rolled) else 0):
        rolled = mix(rolled * U(_BASE) + word[k : k + len(rolled)])
    if weight is not None:
        own_weight = weight[slot(word)].astype(np.uint16)
        heavy = np.zeros(len(rolled), np.uint16)
        for k in range(width if len(rolled) else 0):
            heavy += own_weight[k : k + len(rolled)]
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if z - a >= width:
            if weight is None:
                yield np.unique(rolled[a : z - width + 1])
            else:
                own, first = np.unique(rolled[a : z - width + 1], return_index=True)
                yield own, heavy[a:][first]
            continue
        own = np.zeros(0, U)
        if z > a:
            own = np.full(1, U(z - a))
            for w in word[a:z]:
                own = mix(own * U(_BASE) + w)
        yield own if weight is None else (own, np.zeros(len(own), np.uint16))


def sets(data: np.ndarray, off: np.ndarray, width: int, weight: np.ndarray | None = None, seen: np.ndarray | None = None):
    """The set of each text, as sorted hashes; texts are the slices of ``data`` between offsets.

    With ``weight`` (by slot), pairs of a set and its shingles' weights, the sums over
    their words. ``seen`` (by slot) is increased by every word.
    """
    enter("shingles")
    for i, j in slices_by_bytes(off, SLICE_BYTES):
        word, bounds = _slice_words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        if seen is not None:
            seen += np.bincount(slot(word), minlength=len(seen))
        yield from _slice_sets(word, bounds, width, weight)


def digest(hashes: np.ndarray, salt: bytes = b"") -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16, key=salt).digest()
