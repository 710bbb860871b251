"""Byte-pair encoding as a vocabulary file of the tokenizers library describes it, for files with NFC, lower case, a splitting pattern and byte-level symbols.

A word's merges are found with a segment tree over the ranks of adjacent pairs: its root is the leftmost pair of the lowest rank, and each merge updates three
leaves in logarithmic time. It ends when the root says that no pair can be merged. Words of up to WIDEST symbols that come together are merged together: one tree each,
as rows of an array, and a merge in each of them at a time.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

#: The splitting pattern of the file, and the space characters of Unicode.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NONE = 1 << 62
#: Symbols of the longest words that are merged together, and so many words at once.
WIDEST, TOGETHER = 32, 8192


def _ranges(major: str, last: int = sys.maxunicode) -> str:
    """Characters of a general category up to `last`, as the inside of a character class."""
    out, start = [], None
    for c in range(last + 2):
        inside = c <= last and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class Splitter:
    """The pattern with its properties written out, for the standard library's matcher, which is several times faster. It looks up small classes fastest, so there
    is one form for ASCII texts, one for texts of the basic plane, and one for all others. Letters come first: no other branch begins with one."""

    def __init__(self, pattern: str = PATTERN):
        branches = pattern.split("|")
        letters = [x for x in branches if x == r"[\p{L}]+"]
        pattern = "|".join(letters + [x for x in branches if x not in letters])

        def form(last: int) -> re.Pattern:
            both, spaces = [_ranges(m, last) for m in "LN"], "".join(c for c in SPACES if ord(c) <= last)
            written = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{''.join(both)}]")
            return re.compile(written.replace(r"\p{L}", both[0]).replace(r"\p{N}", both[1]))

        self.forms = form(127), form(0xFFFF), form(sys.maxunicode)
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search

    def findall(self, text: str) -> list[str]:
        return self.forms[0 if text.isascii() else 1 if self.beyond(text) is None else 2].findall(text)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def lower(text: str) -> str:
    """Lower case by single characters: a capital sigma gives the same letter wherever it stands."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def _bytes(words: dict[str, tuple[bytes, str]]) -> int:
    """About what entries take, with the objects around them."""
    return 280 * len(words) + 8 * sum(map(len, words))


class SegmentTree:
    """Minimum over a row of numbers with point updates."""

    def __init__(self, values: list[int]):
        size = 1
        while size < len(values):
            size *= 2
        self.size = size
        self.tree = tree = [NONE] * size + values + [NONE] * (size - len(values))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    def root(self) -> int:
        return self.tree[1]

    def put(self, i: int, value: int) -> None:
        tree, i = self.tree, i + self.size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            m = a if a < b else b
            if tree[i] == m:
                return
            tree[i] = m
            i >>= 1


class Forest:
    """Segment trees of `width` leaves (a power of two), one for each row of leaves."""

    def __init__(self, leaves: np.ndarray):
        rows, self.width = leaves.shape
        tree = np.full((rows, 2 * self.width), NONE, dtype=np.int64)
        tree[:, self.width :] = leaves
        size = self.width
        while size > 1:
            tree[:, size // 2 : size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
            size //= 2
        self.flat = tree.reshape(-1)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        return self.flat[rows * (2 * self.width) + 1]

    def put(self, rows: np.ndarray, i: np.ndarray, values: np.ndarray | int) -> None:
        flat, base, i = self.flat, rows * (2 * self.width), i + self.width
        flat[base + i] = values
        for _ in range(self.width.bit_length() - 1):
            i = i >> 1
            at = base + i
            below = at + i
            flat[at] = np.minimum(flat[below], flat[below + 1])


class Bpe:
    def __init__(self, model_json: str, cache: int = 16 << 20):
        spec = json.loads(model_json)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = self.vocab
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        symbols = byte_symbols()
        self.first = [ids.get(s) for s in symbols]
        self.last = [ids.get(s + self.suffix) for s in symbols]
        self.symbols = np.array([[-1 if i is None else i for i in row] for row in (self.first, self.last)], dtype=np.int64)
        # the pairs again as columns in order of their two ids
        self.many = max(self.tokens, default=0) + 1
        rows = sorted((a * self.many + b, rank, made) for (a, b), (rank, made) in self.pairs.items())
        self.pair, self.rank, _ = np.array(rows, dtype=np.int64).reshape(-1, 3).T.copy()
        self.made = np.zeros(len(merges), dtype=np.int64)
        for _, rank, made in rows:
            self.made[rank] = made
        self.split = Splitter(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.at_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words: dict[str, tuple[bytes, str]] = {}
        self.cache, self.used = cache, 0

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode()
        ids = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        ids = [i for i in ids if i is not None]
        n, pairs = len(ids), self.pairs
        if n < 2:
            return ids
        # keys order by rank first, by position second
        shift = n.bit_length()
        mask = (1 << shift) - 1
        keys = []
        for i in range(n - 1):
            p = pairs.get((ids[i], ids[i + 1]))
            keys.append(NONE if p is None else p[0] << shift | i)
        tree = SegmentTree(keys)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (key := tree.root()) != NONE:
            i = key & mask
            j = after[i]
            ids[i] = pairs[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, NONE)
            if k < n:
                before[k] = i
                p = pairs.get((ids[i], ids[k]))
                tree.put(i, NONE if p is None else p[0] << shift | i)
            else:
                tree.put(i, NONE)
            h = before[i]
            if h >= 0:
                p = pairs.get((ids[h], ids[i]))
                tree.put(h, NONE if p is None else p[0] << shift | h)
        return [i for i in ids if i >= 0]

    def _keys(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, shift: int) -> np.ndarray:
        """Leaves for the pairs of a and b at the places i."""
        want = a * self.many + b
        at = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        return np.where(self.pair[at] == want, self.rank[at] << shift | i, NONE)

    def merge_rows(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Merges every row of ids (its first `sizes` symbols, then -1; the width is a power of two) and leaves -1 where a symbol went."""
        rows, width = ids.shape
        if width < 2 or not len(self.pair):
            return ids
        shift, place = width.bit_length() - 1, np.arange(width)
        leaves = np.full((rows, width), NONE, dtype=np.int64)
        x, y = np.nonzero(place[1:] < sizes[:, None])
        leaves[x, y] = self._keys(ids[x, y], ids[x, y + 1], y, shift)
        forest = Forest(leaves)
        flat, after, before = ids.reshape(-1), np.tile(place + 1, rows), np.tile(place - 1, rows)
        live = np.arange(rows)
        while True:
            root = forest.roots(live)
            some = root != NONE
            live, root = live[some], root[some]
            if not len(live):
                return ids
            base, i, new = live * width, root & (width - 1), self.made[root >> shift]
            j = after[base + i]
            k = after[base + j]
            flat[base + i], flat[base + j], after[base + i] = new, -1, k
            forest.put(live, j, NONE)
            leaf, some = np.full(len(live), NONE, dtype=np.int64), k < sizes[live]
            at = base[some] + k[some]
            before[at] = i[some]
            leaf[some] = self._keys(new[some], flat[at], i[some], shift)
            forest.put(live, i, leaf)
            h = before[base + i]
            some = h >= 0
            h = h[some]
            forest.put(live[some], h, self._keys(flat[base[some] + h], new[some], h, shift))

    def merge_all(self, words: list[str]) -> list[tuple[bytes, str]]:
        """For each word its ids as bytes, and their decoded text."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        out: list = [None] * len(words)
        for n in np.flatnonzero(sizes > WIDEST).tolist():
            ids = self.merge(words[n])
            out[n] = np.array(ids, dtype="<u4").tobytes(), self.decode(ids)
        width, token = 1, self.tokens
        while width <= WIDEST:
            which = np.flatnonzero((sizes <= width) & (sizes > width // 2))
            for s in range(0, len(which), TOGETHER):
                some = which[s : s + TOGETHER]
                size, numbers = sizes[some], some.tolist()
                data = np.frombuffer(b"".join([raw[n] for n in numbers]), dtype=np.uint8)
                first = self.symbols[0][data]
                ends = np.cumsum(size) - 1
                first[ends] = self.symbols[1][data[ends]]
                owner = np.repeat(np.arange(len(some)), size)
                if (first < 0).any():  # symbols that the vocabulary lacks
                    owner, first = owner[first >= 0], first[first >= 0]
                    size = np.bincount(owner, minlength=len(some))
                ids = np.full((len(some), width), -1, dtype=np.int64)
                ids[owner, np.arange(len(owner)) - (np.cumsum(size) - size)[owner]] = first
                ids = self.merge_rows(ids, size)
                kept = ids >= 0
                bounds = [0, *np.cumsum(kept.sum(axis=1)).tolist()]
                kept = ids[kept]
                tokens, data = [token[i] for i in kept.tolist()], kept.astype("<u4").tobytes()
                for n, a, b in zip(numbers, bounds[:-1], bounds[1:], strict=True):
                    out[n] = data[4 * a : 4 * b], " ".join(tokens[a:b])
            width *= 2
        return out

    def _found(self, words: set[str]) -> dict[str, tuple[bytes, str]]:
        """What merge_all() gives for these words. The results are kept; beyond `cache` bytes those of the last words alone are."""
        get = self.words.get
        found = {w: f for w in words if (f := get(w)) is not None}
        new = [w for w in words if w not in found]
        more = dict(zip(new, self.merge_all(new), strict=True))
        found.update(more)
        self.used += _bytes(more)
        if self.used <= self.cache:
            self.words.update(more)
        else:
            self.used = _bytes(found)
            self.words = dict(found) if self.used <= self.cache else {}
            self.used = self.used if self.words else 0
        return found

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return self.split.findall(lower(text))

    def _parts(self, text: str) -> list[tuple[list[str], str | None]]:
        """Words of a text up to each special token, with the token; after the last one, None."""
        if self.at_special is None or "<" not in text:
            return [(self._words(text), None)]
        parts = [*self.at_special.split(text), None]
        return [(self._words(a), b) for a, b in zip(parts[::2], parts[1::2], strict=True)]

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and the text that decode() gives for them. Words of all the texts are merged together."""
        texts = [self._parts(t) for t in texts]
        every: set[str] = set()
        for parts in texts:
            for words, _ in parts:
                every.update(words)
        found = self._found(every)
        for parts in texts:
            ids, decoded = [], []
            for words, special in parts:
                some = [found[w] for w in words]
                ids += [f[0] for f in some]
                decoded += [f[1] for f in some]
                if special is not None:
                    ids.append(np.array([self.special[special]], dtype="<u4").tobytes())
                    decoded.append(special)
            yield b"".join(ids), " ".join(w for w in decoded if w) if "" in decoded else " ".join(decoded)

    def encode_both(self, text: str) -> tuple[bytes, str]:
        return next(self.encode_all([text]))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_both(text)[0], dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: tokens with a space between, ends of words as they are."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)
