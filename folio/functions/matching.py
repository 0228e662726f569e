"""Sizes of the matching blocks of two texts, exactly as difflib without its heuristics finds them, from hashes of short pieces."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Length of the pieces looked for first; a power of two.
PIECE = 8
#: A text with more pairs of equal pieces a character is repetitive; longer pieces are looked for.
PAIRS = 16
#: Ranges with at most so many pairs of characters are compared directly.
DIRECT = 4096

Run = tuple[int, int, int]


def matched_size(a: str, b: str) -> int:
    """Sum of the sizes of SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks().

    The longest match, of several the first in a, of those the first in b, parts
    both texts, and so on. All matches of at least k characters are found at once,
    and parted by until only shorter ones are left; what lies between takes half of k.
    """
    total, todo = 0, [(a, b, 0)]
    while todo:
        x, y, below = todo.pop()
        if x in y or y in x:
            total += min(len(x), len(y))
            continue
        if below == 1 or len(x) * len(y) <= DIRECT:
            total += sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
            continue
        k = below // 2 or PIECE
        found = _runs(x, y, k) if k <= min(len(x), len(y)) else []
        while found is None and not below and 2 * k <= min(len(x), len(y)):
            k *= 2
            found = _runs(x, y, k)
        if found is None:  # too many pairs: one step as difflib takes it
            m = SequenceMatcher(None, x, y, autojunk=False).find_longest_match()
            if m.size:
                total += m.size
                todo += [(x[: m.a], y[: m.b], below), (x[m.a + m.size :], y[m.b + m.size :], below)]
            continue
        size, rest = _parted(len(x), len(y), found, k)
        total += size
        todo += [(x[p:q], y[r:s], k) for p, q, r, s in rest]
    return total


def _hashes(x: str, k: int) -> np.ndarray:
    """A hash of each piece of k characters."""
    h, n = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64), 1
    while n < k:
        h = h[:-n] * np.uint64(0x9E3779B97F4A7C15) + h[n:]
        h ^= h >> np.uint64(32)
        n *= 2
    return h


def _runs(x: str, y: str, k: int) -> list[Run] | None:
    """All maximal matches (start in x, start in y, length) of at least k characters; null if they have too many pairs of pieces, or hashes of unlike pieces are equal."""
    u, v = _hashes(x, k), _hashes(y, k)
    order = np.argsort(v, kind="stable")
    v = v[order]
    lo = np.searchsorted(v, u, "left")
    n = np.searchsorted(v, u, "right") - lo
    pairs = int(n.sum())
    if pairs > PAIRS * (len(x) + len(y)):
        return None
    i = np.repeat(np.arange(len(u)), n)
    j = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(pairs)]
    # along a diagonal, pieces that follow each other are one match
    wide = len(x) + 1
    key = np.sort((j - i + len(x)) * wide + i)
    first = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    length = np.diff(first, append=pairs) + k - 1
    at = key[first] % wide
    out = list(zip(at.tolist(), (at + key[first] // wide - len(x)).tolist(), length.tolist(), strict=True))
    return out if all(x[p : p + m] == y[q : q + m] for p, q, m in out) else None


def _parted(n: int, m: int, runs: list[Run], k: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """The sum of the blocks of at least k characters, and the ranges (from, to in each text) between them."""
    total, rest = 0, []
    todo = [(0, n, 0, m, runs)]
    while todo:
        a0, a1, b0, b1, near = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        best, kept = (k - 1, 0, 0), []
        for p, q, size in near:
            cut = max(0, a0 - p, b0 - q)
            p, q, size = p + cut, q + cut, min(size - cut, a1 - p - cut, b1 - q - cut)
            if size >= k:
                kept.append((p, q, size))
                if size > best[0] or size == best[0] and (p, q) < best[1:]:
                    best = (size, p, q)
        size, p, q = best
        if size < k:
            rest.append((a0, a1, b0, b1))
            continue
        total += size
        # a match before the block begins before it in both texts
        todo.append((a0, p, b0, q, [r for r in kept if r[0] < p and r[1] < q]))
        todo.append((p + size, a1, q + size, b1, [r for r in kept if r[0] + r[2] > p + size and r[1] + r[2] > q + size]))
    return total, rest
