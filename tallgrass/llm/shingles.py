"""Word shingles as 64-bit hashes, over whole Arrow batches at a time.

Words are runs of bytes other than white space (0x20, 0x09-0x0D), lower-cased in A-Z. A document's set holds the hashes of its five-word shingles; with fewer
words, of the whole sequence; without words it is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tallgrass.llm.common import mix64, utf8

WORDS = 5
#: 64-bit odd multipliers and a table of random bytes values, drawn from a fixed seed.
_RNG = np.random.default_rng(20_240_101)
BASE = np.uint64(_RNG.integers(1 << 62, 1 << 63)) | np.uint64(1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 1 << 19

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse. Those for one piece are kept; a longer text's are made when it comes."""
    if n > PIECE:
        return _row(BASE, n), _row(INVERSE, n)
    if not _POWERS:
        _POWERS.update(up=_row(BASE, PIECE), down=_row(INVERSE, PIECE))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _row(base: np.uint64, n: int) -> np.ndarray:
    row = np.full(n, base, dtype=np.uint64)
    row[0] = 1
    return np.cumprod(row, dtype=np.uint64)


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last byte of every word, and the bounds of each document's words, for documents that lie end to end in raw."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none.view(np.uint64), none, none, np.zeros(len(off), dtype=np.int64)
    word = ~SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _powers(n)
    sums = np.cumsum(BYTES[LOWER[raw]] * up, dtype=np.uint64)
    hashes = (sums[ends] - np.where(starts > 0, sums[np.maximum(starts, 1) - 1], np.uint64(0))) * down[starts]
    return mix64(hashes + (ends - starts).astype(np.uint64)), starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the bounds of each document's words."""
    hashes, _, _, bounds = words_of(raw, off)
    return hashes, bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in order of their places, and the bounds of each document's."""
    counts = np.diff(bounds)
    total = np.zeros(max(len(words) - WORDS + 1, 0), dtype=np.uint64)
    for k in range(WORDS):
        total += words[k : k + len(total)] * PLACES[k]
    total = mix64(total)
    short = (counts > 0) & (counts < WORDS)
    sizes = np.where(short, 1, np.maximum(counts - WORDS + 1, 0))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], dtype=np.uint64)
    long = np.flatnonzero(counts >= WORDS)
    if len(long):
        # places of shingles that begin in a document and end in it
        source = np.repeat(bounds[long] - at[long], sizes[long])
        dest = np.concatenate([np.arange(at[i], at[i + 1]) for i in long]) if len(long) < 64 else np.flatnonzero(np.repeat(~short, sizes))
        out[dest] = total[dest + source]
    for k in range(1, WORDS):
        some = np.flatnonzero(counts == k)
        if len(some):
            w = words[bounds[some][:, None] + np.arange(k)] * PLACES[:k]
            out[at[some]] = mix64(w.sum(axis=1, dtype=np.uint64) + np.uint64(k))
    return out, at


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of every row's shingles; null and empty rows give empty sets."""
    raw, off = utf8(column)
    i = 0
    while i < len(off) - 1:
        j = max(int(np.searchsorted(off, off[i] + PIECE, side="right")) - 1, i + 1)
        shingles, at = shingle_hashes(*word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
        for k in range(j - i):
            yield unique(shingles[at[k] : at[k + 1]])
        i = j


def unique(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    if len(values) < 2:
        return values
    keep = np.empty(len(values), dtype=bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def set_id(values: np.ndarray) -> int:
    """A signed 64-bit name for a set."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) == 0 or len(b) == 0:
        return 0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())
