"""Words of whole batches of texts, found and hashed by numpy over the code points of the lower-cased texts.

No Python code runs per word: classes of characters come from a table, words are the runs of a class, and the hash of a word is a
difference of running polynomial sums. Texts are taken in parts of at most ``PART`` characters (one longer text is one part).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from tracelake.llm.common import mix64

PART = 1 << 20
BASE = 0x9E3779B97F4A7C15
LETTER, ALNUM, DIGIT, SPACE, JOINER, STOP, BREAK, LATIN = (1 << i for i in range(8))
# Joiners stand inside a word between two letters, stops end a unit before white space, breaks end it anywhere, marks count as white space.
JOINERS, STOPS, BREAKS, MARKS = "-'’", ".!?;:", "\n•", "*`#|="


def _kind(c: str) -> int:
    k = LETTER if c.isalnum() and not c.isdecimal() else 0
    if c in "abcdefghijklmnopqrstuvwxyz":
        k |= ALNUM | LATIN
    if c in "0123456789":
        k |= ALNUM | DIGIT
    for s, v in ((JOINERS, JOINER), (STOPS, STOP), (BREAKS, BREAK), (MARKS, SPACE)):
        k |= v if c in s else 0
    return k | (SPACE if c.isspace() else 0)


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    out = np.array([_kind(chr(i)) for i in range(1 << 16)], dtype=np.uint8)
    out[0] = SPACE | BREAK  # stands behind every text
    return out


def kinds(codes: np.ndarray) -> np.ndarray:
    """Classes of code points, as bits."""
    out = _table()[np.minimum(codes, 0xFFFF)]
    for c in np.unique(codes[codes > 0xFFFF]):  # few: beyond the basic plane
        out[codes == c] = _kind(chr(int(c)))
    return out


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(n + n // 4, b, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Texts:
    """Lower-cased texts one behind the other, a zero behind each. ``first``: number of the first text in its batch; ``upper``: was the character a capital?"""

    def __init__(self, texts: list[str | None], first: int = 0, cased: bool = False):
        texts = [(t or "").replace("\0", " ") for t in texts]
        lows = [t.lower() for t in texts]
        self.first, self.text = first, "\0".join([*lows, ""])
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.bounds = np.cumsum([0] + [len(t) + 1 for t in lows])
        self.kind = kinds(self.codes)
        self.upper = None
        if cased:
            raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            if any(len(t) != len(low) for t, low in zip(texts, lows)):  # a capital that is several small characters
                raw = np.repeat(raw, [len(c.lower()) for t in texts for c in f"{t}\0"])
            self.upper = raw != self.codes
        up, self._down = _powers(len(self.codes) + 1)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.codes + 1).astype(np.uint64) * up[: len(self.codes)])])

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each run of characters that are ``inside`` (never the zeros)."""
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        return edge[::2], edge[1::2]

    def alnum(self) -> tuple[np.ndarray, np.ndarray]:
        """The longest runs of a-z0-9."""
        return self.words((self.kind & ALNUM) > 0)

    def terms(self, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters, with single joiners between two of them; only where ``open_`` is true."""
        letter = (self.kind & LETTER) > 0
        if open_ is not None:
            letter &= open_
        joined = (self.kind & JOINER) > 0
        joined[1:-1] &= letter[:-2] & letter[2:]
        joined[[0, -1]] = False
        return self.words(letter | joined)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._sums[end] - self._sums[start]) * self._down[start])

    def record(self, at: np.ndarray) -> np.ndarray:
        """Number (in this part) of the text that holds each place."""
        return np.searchsorted(self.bounds, at, side="right") - 1

    def count(self, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many characters from start to end are marked."""
        total = np.concatenate([[0], np.cumsum(mark)])
        return total[end] - total[start]


def parts(texts: list[str | None], cased: bool = False) -> Iterator[Texts]:
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if i > first and size + n > PART:
            yield Texts(texts[first:i], first, cased)
            first, size = i, 0
        size += n
    if texts:
        yield Texts(texts[first:], first, cased)


def word_hash(words: list[str]) -> np.ndarray:
    """Hashes of given words (lower case), as ``Texts.hashes`` has them; joiners are all of one kind."""
    t = Texts(list(words))
    start = t.bounds[:-1]
    return t.hashes(start, t.bounds[1:] - 1)


def among(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """np.isin for a sorted ``of``."""
    if not len(of):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(of, x), len(of) - 1)
    return of[at] == x
