"""Hashed words and byte n-grams of Arrow string columns, with numpy on whole batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._bpe import MIX, MIX2, hash_pieces, utf8

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[32, *range(9, 14)]] = True
#: Bytes of words made of letters: a-z and everything beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes (A-Z only), with spare bytes at the end, and text offsets."""
    data, offsets = utf8(column)
    return LOWER[data], offsets


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, cut at text borders."""
    n = int(offsets[-1])
    flags = np.zeros(n + 2, np.int8)
    flags[1 : n + 1] = inside[:n]
    step = np.diff(flags)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run, and how many runs each text has."""
    starts, ends = runs(inside, offsets)
    bounds = np.searchsorted(starts, offsets)
    return hash_pieces(data, starts, ends - starts), np.diff(bounds)


def finish(h: np.ndarray) -> np.ndarray:
    """A full mix of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * MIX2
    h = (h ^ (h >> np.uint64(27))) * MIX
    return h ^ (h >> np.uint64(31))
