"""A noisy channel for disguised words: character lattices of leetspeak, spacing and repetition, decoded by Viterbi under a character language model.

The model holds every run of ORDER letters of the corpus (accents folded, other scripts as one class), backed off to shorter runs. Its table and all prices of the channel
are whole numbers (STEP for each natural unit), so a decoding is exact: the cheapest path of the lattice, whatever the length of the token. A state of the lattice is the last
ORDER - 1 classes, which is all that the rest of a path depends on; no state is left out.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa

from tallgrass.llm.common import utf8

#: What a sign may stand for. Signs that are not listed stand for themselves if they are letters or digits.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
#: Whole numbers for one natural unit of log probability.
STEP = 12
#: Prices of the channel: a sign for a letter; a digit for itself; a sign that stands for nothing, at an edge; one letter written twice, or more often; two letters written once more; the end of a word between spaced signs.
SUBSTITUTE, LITERAL, NOTHING, TWICE, STRETCHED, GAP = 20, 60, 40, 50, 36, 30
#: Classes of the language model: 0 the edge of a word, 1-26 a-z, 27 all other letters and digits.
SIZE, OTHER, ORDER = 28, 27, 5
CONTEXTS = SIZE ** (ORDER - 1)

#: Words of letters; words as they may be disguised, with letters and signs; single signs with separators between.
PLAIN = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[@$€£!|¡]*[^\W_](?:[^\W_]|[@$!|+€£¡]+(?=[^\W_]))*[@$€£]*")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$€£])(?:[\x20\t\n\r.\-_*,/|~]+(?:[^\W_]|[@$€£])(?![^\W_])){2,}")
TWO = re.compile(r"(.)\1", re.DOTALL)
_TABLE: list[np.ndarray] = []


def _class(ch: str) -> int:
    if not ch.isalnum():
        return 0
    base = "s" if ch in "ßẞ" else unicodedata.normalize("NFKD", ch)[:1].lower()
    return ord(base) - 96 if "a" <= base <= "z" else OTHER


def class_table() -> np.ndarray:
    """Class of every code point; digits count as edges in texts, since no word is learned from them."""
    if not _TABLE:
        table = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = _class(ch)
        _TABLE.append(table)
    return _TABLE[0]


def gram_codes(text: str) -> np.ndarray:
    """A code for each letter of a text and each end of a word: the classes before it, back to the word's beginning, and its own."""
    points = np.frombuffer((" " * ORDER + text + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = class_table()[points].astype(np.int32)
    n = len(c) - ORDER
    now = c[ORDER:]
    used = (now > 0) | (c[ORDER - 1 : -1] > 0)
    code, alive, place = now.copy(), np.ones(n, dtype=bool), 1
    for back in range(1, ORDER):
        before = c[ORDER - back : len(c) - back]
        alive = alive & (before > 0)
        place *= SIZE
        code += np.where(alive, before, 0) * np.int32(place)
    return code[used]


class CharModel:
    """Prices of a class after the classes before it, as bytes of whole numbers: table[context * SIZE + class]."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, strength: float = 5.0):
        """codes (ascending) and how often each occurs."""
        lower = [np.full(SIZE, 1.0 / SIZE)]
        for k in range(1, ORDER):
            c = np.bincount(codes % SIZE**k, weights=counts, minlength=SIZE**k).reshape(-1, SIZE)
            lower.append(self._smooth(c, lower[-1], strength))
        out = np.empty(CONTEXTS * SIZE, dtype=np.uint8)
        block = SIZE ** (ORDER - 1)
        for first in range(SIZE):
            lo, hi = np.searchsorted(codes, [first * block, (first + 1) * block])
            c = np.bincount(codes[lo:hi] - first * block, weights=counts[lo:hi], minlength=block).reshape(-1, SIZE)
            p = self._smooth(c, lower[-1], strength)
            out[first * block : (first + 1) * block] = np.clip(np.rint(-STEP * np.log(p)), 0, 255).reshape(-1)
        self.table = out.tobytes()

    @staticmethod
    def _smooth(c: np.ndarray, lower: np.ndarray, strength: float) -> np.ndarray:
        """Counts (contexts x classes), backed by the probabilities of contexts that lack the first class."""
        low = lower.reshape(-1, SIZE)
        back = np.tile(low, (len(c) // len(low), 1))
        return np.maximum((c + strength * back) / (c.sum(axis=1, keepdims=True) + strength), 1e-9)


@lru_cache(4096)
def options(sign: str, n: int, edge: bool) -> tuple[tuple[str, tuple[int, ...], int], ...]:
    """(letters, classes, price) of what a run of n equal signs (3 stands for more) may stand for."""
    single = ([(sign, 0 if sign.isalpha() else LITERAL)] if sign.isalnum() else []) + [(x, SUBSTITUTE) for x in LEET.get(sign, "")]
    found = [("", (), NOTHING)] if edge and not sign.isalnum() else []
    for letter, price in single:
        c = _class(letter)
        one = (0, TWICE, STRETCHED)[n - 1]
        found.append((letter, (c,), price + one))
        if n > 1:
            found.append((letter * 2, (c, c), 2 * price + (0 if n == 2 else STRETCHED)))
    return tuple(found)


class Decoder:
    """Restores words."""

    def __init__(self, model: CharModel):
        self.table = model.table
        self._kept = lru_cache(50_000)(self.decode)

    def decode(self, token: str, spaced: bool = False) -> str:
        """The likeliest word that the channel turns into this token; with `spaced`, words with blanks between them, for signs that stood apart."""
        table = self.table
        runs = [(sign, sum(1 for _ in same)) for sign, same in groupby(token)]
        states: dict[int, tuple[int, tuple | None]] = {0: (0, None)}
        for at, (sign, n) in enumerate(runs):
            choices = options(sign, min(n, 3), at in (0, len(runs) - 1))
            if not choices:
                continue
            new: dict[int, tuple[int, tuple | None]] = {}
            for context, (cost, path) in states.items():
                for letters, classes, price in choices:
                    c, x = cost + price, context
                    for d in classes:
                        k = x * SIZE + d
                        c += table[k]
                        x = k % CONTEXTS
                    old = new.get(x)
                    if old is None or c < old[0]:
                        new[x] = (c, (path, letters))
            if spaced and at < len(runs) - 1:
                c, path = self._ended(new)
                if 0 not in new or c + GAP < new[0][0]:
                    new[0] = (c + GAP, (path, " "))
            states = new
        _, path = self._ended(states)
        out = []
        while path is not None:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out))

    def _ended(self, states: dict) -> tuple[int, tuple | None]:
        """The cheapest path that ends here; of equals the one with the smallest state."""
        best = None
        for x in sorted(states):
            c = states[x][0] + self.table[x * SIZE]
            if best is None or c < best[0]:
                best = (c, states[x][1])
        return best

    def word(self, token: str) -> str:
        """A token restored. One without doubled letters and signs has a lattice of a single path: itself."""
        if token.isalpha() and TWO.search(token) is None:
            return token
        if not any(map(str.isalpha, token)):
            return ""
        return self._kept(token) if len(token) <= 40 else self.decode(token)

    def apart(self, text: str) -> list[str]:
        """Words that stood as single signs with separators between them."""
        out = []
        for m in SPACED.finditer(text):
            signs = [(i, c) for i, c in enumerate(m.group()) if c.isalnum() or c in "@$€£"]
            gaps = [j - i for (i, _), (j, _) in zip(signs, signs[1:], strict=False)]
            # where gaps differ, the wider ones are ends of words
            least, word = min(gaps), signs[0][1]
            for gap, (_, c) in zip([*gaps, 0], [*signs[1:], (0, "")], strict=True):
                if c and gap == least:
                    word += c
                    continue
                if any(map(str.isalpha, word)):
                    out += [w for w in self.decode(word, True).split(" ") if len(w) > 1]
                word = c
        return out

    def words(self, text: str) -> set[str]:
        """The different words of a text, in lower case, restored."""
        text = text.lower()
        return {w for t in tokens(text, True) if (w := self.word(t))} | set(self.apart(text))


def tokens(text: str, signs: bool) -> set[str]:
    """Words of a text in lower case; with signs, as they may be disguised. Where a sign may be part of a word or not, both readings count."""
    if not signs:
        return set(PLAIN.findall(text))
    found = set(TOKEN.findall(text))
    return found | {p for t in found if not t.isalpha() for p in PLAIN.findall(t) if len(p) > 3}


#: By byte: parts of words (letters, digits, signs that count as letters, all beyond ASCII); letters; signs before letters; signs after letters; bytes that begin a letter or digit.
_WORD, _LETTER, _BEFORE, _AFTER = (np.zeros(256, dtype=bool) for _ in range(4))
for _b in range(256):
    _WORD[_b] = _b >= 128 or chr(_b).isalnum() or chr(_b) in "@$"
    _LETTER[_b] = _b >= 128 or chr(_b).isalpha()
    _BEFORE[_b] = _b < 128 and chr(_b) in "0123456789@$!|+"
    _AFTER[_b] = _b < 128 and chr(_b) in "0123456789@$"
_BEGINS = _WORD & ~_BEFORE | _AFTER & ~np.isin(np.arange(256), [ord("@"), ord("$")])
_BEGINS[0x80:0xC0] = False


def disguises(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a column: whether it may hold disguised words, and words of spaced signs. False is certain: characters beyond Latin letters always may."""
    raw, off = utf8(column)
    n = len(off) - 1
    noisy, spaced = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if len(raw) < 2:
        return noisy, spaced
    owner = lambda at: np.searchsorted(off, at, side="right") - 1
    letter = _LETTER[raw]
    before = _BEFORE[raw]
    noisy[owner(np.flatnonzero((before[:-1] & (letter[1:] | (before[1:] & ~_AFTER[raw[:-1]]))) | (letter[:-1] & _AFTER[raw[1:]])))] = True
    # other scripts and marks, and the two characters of the Latin-1 letter range that aren't letters
    wide = np.flatnonzero((raw == 0xC2) | (raw > 0xC3) | ((raw == 0x97) | (raw == 0xB7)))
    noisy[owner(wide)] = True
    spaced[owner(wide)] = True
    word = _WORD[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    chars = np.concatenate([[0], np.cumsum(_BEGINS[raw])])
    # three in a row that hold a single letter or digit, besides signs
    short = chars[ends + 1] - chars[starts] <= 1
    if len(short) > 2:
        some = np.flatnonzero(short[:-2] & short[1:-1] & short[2:])
        doc = owner(starts[some])
        spaced[doc[doc == owner(starts[some + 2])]] = True
    return noisy, spaced
