"""Edit distance between step sequences, and what it implies for counts and grams.

Two sequences are near-same if at most ``longer // 10`` steps are changed, inserted or removed. From that follow the
lossless filters the joins use: lengths differ by at most the radius; per set of codes the counts differ by at most the
radius; of each d + 1 disjoint blocks of one side one is left whole in the other, moved by at most d places; and of the
longer side's q-grams all but q * d are found in the other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.llm.common import gram_hashes, mix64

PIVOTS = 4  # halves of the code space, by bits of a hash
SHARE = 10  # one edit in so many steps of the longer sequence


def radius(n: int | np.ndarray) -> int | np.ndarray:
    return n // SHARE


def longest_partner(n: int | np.ndarray) -> int | np.ndarray:
    """The longest sequence that can still be near-same to one of n steps."""
    return SHARE * n // (SHARE - 1)


def distance(a: list | np.ndarray, b: list | np.ndarray, most: int) -> int:
    """Levenshtein distance, bit-parallel over the whole of ``a``; ``most + 1`` once it is known to exceed ``most``."""
    a, b = list(a), list(b)
    if abs(len(a) - len(b)) > most:
        return most + 1
    i, end = 0, min(len(a), len(b))
    while i < end and a[i] == b[i]:
        i += 1
    j = 0
    while j < end - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pos, neg, score, left = full, 0, len(a), len(b)
    for y in b:
        eq = where.get(y, 0)
        xv = eq | neg
        xh = (((eq & pos) + pos) ^ pos) | eq
        ph, mh = neg | (~(xh | pos) & full), pos & xh
        left -= 1
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score - left > most:
            return most + 1
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pos, neg = mh | (~(xv | ph) & full), ph & xv
    return score


def profiles_apart(a: np.ndarray, b: np.ndarray) -> int:
    """Lower bound of the distance: the larger of the surpluses of code counts on either side."""
    codes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    diff = np.bincount(at[: len(a)], minlength=len(codes)) - np.bincount(at[len(a) :], minlength=len(codes))
    return int(max(diff[diff > 0].sum(), -diff[diff < 0].sum()))


def grams_shared(a: np.ndarray, b: np.ndarray, q: int = 6) -> int:
    """How many q-grams of the two have a counterpart in the other."""
    x, y = gram_hashes(a, q), gram_hashes(b, q)
    _, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    n = int(at.max(initial=-1)) + 1
    return int(np.minimum(np.bincount(at[: len(x)], minlength=n), np.bincount(at[len(x) :], minlength=n)).sum())


def near_same(a: np.ndarray, b: np.ndarray) -> bool:
    n, q = max(len(a), len(b)), 6
    most = n // SHARE
    if abs(len(a) - len(b)) > most or profiles_apart(a, b) > most:
        return False
    return grams_shared(a, b, q) >= n - q + 1 - q * most and distance(a.tolist(), b.tolist(), most) <= most


def pivot_counts(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per record the number of its steps in each of PIVOTS fixed halves of the code space, 16 bits each in one BIGINT. Counts stop at 65535,
    which keeps every bound that differences of counts give."""
    bits = mix64(codes.astype(np.int64).view(np.uint64) + np.uint64(0x51ED))
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    for k in range(PIVOTS):
        total = np.r_[0, np.cumsum((bits >> np.uint64(k)) & np.uint64(1)).astype(np.int64)]
        out |= np.minimum(total[offsets[1:]] - total[offsets[:-1]], 65535).astype(np.uint64) << np.uint64(16 * k)
    return out.view(np.int64)


def within_reach(a: str, b: str, reach: Column) -> Column:
    """Do the packed counts of two columns differ by at most ``reach`` in every pivot?"""
    ok = F.lit(True)
    for k in range(PIVOTS):
        x, y = (F.shiftrightunsigned(F.col(c), 16 * k).bitwiseAND(0xFFFF) for c in (a, b))
        ok &= F.abs(x - y) <= reach
    return ok
