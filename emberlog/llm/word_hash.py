"""Hashes of byte runs (words), computed for whole batches, and comparison of their bytes.

A run is read in chunks of eight bytes, each mixed into the state by a function
that isn't linear, so no family of words (such as those on which polynomials
modulo 2^64 agree) collides by construction. Runs longer than LONG bytes are
hashed by BLAKE2b. Hashes find; callers that must be exact compare with :func:`same`.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Runs of more bytes are hashed and compared one by one.
LONG = 64

_STEP = U(0x9E3779B97F4A7C15)
#: What of a chunk belongs to a run that has 0 to 8 bytes left.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def runs(data: np.ndarray, off: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes that aren't ``space`` begin and end; they end where texts do."""
    n = len(data)
    solid = ~space[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = off[(off > 0) & (off < n)]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def padded(data: np.ndarray) -> np.ndarray:
    """The bytes with eight more behind them, as :func:`hashes` and :func:`same` need them."""
    return np.concatenate([data, np.zeros(8, np.uint8)])


def _chunks(pad: np.ndarray) -> np.ndarray:
    return np.ndarray((len(pad) - 7,), "<u8", pad, strides=(1,))


def hashes(pad: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of the padded bytes."""
    view, size = _chunks(pad), end - start
    out = size.astype(U) * _STEP
    live = np.flatnonzero(size <= LONG)
    at, left = start[live], size[live]
    step = 0
    while len(live):
        step += 1
        out[live] = mix((out[live] ^ (view[at] & _LEFT[np.minimum(left, 8)])) * _STEP + U(step))
        go_on = left > 8
        live, at, left = live[go_on], at[go_on] + 8, left[go_on] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(pad[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same(pad: np.ndarray, start: np.ndarray, other: np.ndarray, at_other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at ``start`` are those at ``at_other`` of the other padded bytes."""
    view, held = _chunks(pad), _chunks(other)
    out = np.ones(len(size), bool)
    live = np.flatnonzero(size <= LONG)
    a, b, left = start[live], at_other[live], size[live]
    while len(live):
        equal = ((view[a] ^ held[b]) & _LEFT[np.minimum(left, 8)]) == 0
        out[live] = equal
        go_on = equal & (left > 8)
        live, a, b, left = live[go_on], a[go_on] + 8, b[go_on] + 8, left[go_on] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.array_equal(pad[start[i] : start[i] + size[i]], other[at_other[i] : at_other[i] + size[i]])
    return out
