"""Repeated strings of bytes: winnowed fingerprints, an enhanced suffix array, and its common-prefix interval tree.

The suffix array is built over the suffixes that matter, each cut off at its own limit. Its longest common prefixes form a tree of intervals, which a scan with a
stack walks through. An interval whose occurrences have different bytes before them cannot be extended to the left, and by its depth not to the right either: it is a
maximal repeat, and all suffixes in it are its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tallgrass.llm.common import mix64
from tallgrass.llm.shingles import BYTES, _powers

LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1
PIECE = 1 << 19
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash for the GRAM bytes at each place, as far as there are so many."""
    n = len(raw) - GRAM + 1
    words = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=np.ascontiguousarray(raw), strides=(1,))
    h = words[:n] * _A
    h ^= h >> np.uint64(32)
    h += words[8 : 8 + n] * _B
    return mix64(h)


def _leftmost_min(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` places, the place of the smallest upper half of a hash, the leftmost of equals."""
    best = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    # windows of doubling width, then two that overlap; the place decides between equals
    while step * 2 <= width:
        best, step = np.minimum(best[:-step], best[step:]), step * 2
    rest = width - step
    if rest:
        best = np.minimum(best[:-rest], best[rest:])
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Selected:
    """The fingerprints of documents that lie end to end: place, hash, document, and the first and last start of the strings of LENGTH bytes that each stands for. key names the bytes that those strings cover."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        parts = []
        i, n = 0, len(off) - 1
        while i < n:
            j = max(int(np.searchsorted(off, off[i] + PIECE, side="right")) - 1, i + 1)
            parts.append(self._piece(raw[off[i] : off[j]], off[i : j + 1] - off[i], int(off[i]), i))
            i = j
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=d) for k, d in enumerate((np.int64, np.uint64, np.int64, np.int64, np.int64, np.uint64))]
        self.place, self.hash, self.doc, self.first, self.last, self.key = columns

    @staticmethod
    def _piece(raw: np.ndarray, off: np.ndarray, base: int, doc: int) -> tuple[np.ndarray, ...]:
        if len(raw) < LENGTH:
            none = np.zeros(0, dtype=np.int64)
            return none, none.view(np.uint64), none, none, none, none.view(np.uint64)
        hashes = _gram_hashes(raw)
        at = _leftmost_min(hashes, WINDOW)
        # strings that begin in a document's last bytes would reach into the next one
        inside = np.ones(len(at) + 1, dtype=bool)
        inside[-1] = False
        over = (off[1:, None] - np.arange(1, LENGTH)).reshape(-1)
        inside[over[(over >= 0) & (over < len(at))]] = False
        change = at[1:] != at[:-1]
        begins, ends = inside[:-1].copy(), inside[:-1].copy()
        begins[1:] &= change | ~inside[:-2]
        ends &= np.append(change, True) | ~inside[1:]
        # a document shorter than LENGTH leaves no gap before the next one, but nothing of its own either
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        place = at[first]
        up, down = _powers(len(raw))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTES[raw] * up, dtype=np.uint64)])
        key = mix64((sums[last + LENGTH] - sums[first]) * down[first] + mix64(((last - first) * 64 + (place - first)).astype(np.uint64) + _A))
        return place + base, hashes[place], np.searchsorted(off, first, side="right") - 1 + doc, first + base, last + base, key


def suffix_array(data: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes data[start : start + limit] in order, and what each has in common with the one before (0 for the first). A suffix that ends sorts before those that go on."""
    n, widest = len(starts), int(limits.max()) if len(limits) else 0
    columns = -(-widest // 8)
    padded = np.concatenate([data, np.zeros(8 * columns + 8, dtype=np.uint8)])
    words = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
    keys = []
    for c in range(columns):
        have = np.clip(limits - 8 * c, 0, 8)
        mask = np.where(have == 8, ~np.uint64(0), ~(~np.uint64(0) >> (np.minimum(have, 7) * 8).astype(np.uint64)))
        keys.append(words[starts + 8 * c].astype(np.uint64) & mask)
    order = np.lexsort([limits, *keys[::-1]])
    lcp = np.zeros(n, dtype=np.int64)
    if n > 1:
        same = np.ones(n - 1, dtype=bool)
        for k in keys:
            x = k[order[1:]] ^ k[order[:-1]]
            equal = x == 0
            top = np.zeros(n - 1, dtype=np.int64)
            # leading equal bytes of the first pair of words that differ
            for b in range(1, 8):
                top += (x >> np.uint64(64 - 8 * b)) == 0
            lcp[1:] += np.where(same, np.where(equal, 8, top), 0)
            same &= equal
        lcp[1:] = np.minimum(lcp[1:], np.minimum(limits[order[1:]], limits[order[:-1]]))
    return order, lcp


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of the tree that is at least so deep, children before parents. Runs between shallower places are scanned one by one."""
    deep = np.flatnonzero(lcp >= least)
    if len(deep) == 0:
        return
    for run in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1):
        values = lcp[run].tolist()
        low = int(run[0]) - 1
        if values.count(values[0]) == len(values):
            yield values[0], low, low + len(values)
            continue
        stack: list[tuple[int, int]] = []
        for i, v in enumerate([*values, -1]):
            left = low + i
            while stack and stack[-1][0] > v:
                depth, left = stack.pop()
                yield depth, left, low + i
            if v >= 0 and (not stack or stack[-1][0] < v):
                stack.append((v, left))


def maximal_repeats(data: np.ndarray, starts: np.ndarray, limits: np.ndarray, left: np.ndarray, least: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """(length, indices into starts) of every maximal repeat of at least so many bytes, with all its occurrences. left: the byte before each suffix, or a negative number that occurs once where the suffix may not be extended to the left."""
    order, lcp = suffix_array(data, starts, limits)
    before = left[order]
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])]) if len(before) else np.zeros(0, dtype=np.int64)
    for depth, first, last in intervals(lcp, least):
        if changes[first] != changes[last]:
            yield depth, order[first : last + 1]
