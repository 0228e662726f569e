"""Regularized logistic regression on hashed character n-grams and a few dense features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from folio.llm.ngrams import points

#: Hashed features, a power of 2; with the dense ones they bound the size of a model.
DIM = 1 << 17
ORDERS = (1, 2, 3, 4)
_SALT = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def ngrams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all lines' n-grams and the line of each; no n-gram crosses a line."""
    if not lines:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = points("\n" + "\n".join(lines) + "\n")
    nl = a == 10
    row = np.cumsum(nl, dtype=np.int32) - 1
    x = np.where((a >= 48) & (a <= 57), np.uint32(48), a).astype(np.uint64)
    feats, rows = [], []
    h = (x + np.uint64(1)) * np.uint64(_SALT[1])
    for n in ORDERS:
        # the n-gram that begins at i; a line feed may only stand at its ends
        if n == 1:
            ok = ~nl
        else:
            h = (h[:-1] ^ (x[n - 1:] * np.uint64(_SALT[n]))) * np.uint64(0xBF58476D1CE4E5B9)
            if n == 2:
                ok = ~(nl[:-1] & nl[1:])
            else:
                inner = ~nl[1:-1] if n == 3 else inner[:-1] & ~nl[n - 2:-1]  # noqa: F821
                ok = inner
        v = h >> np.uint64(31)
        v ^= h
        v >>= np.uint64(3)
        v &= np.uint64(DIM - 1)
        feats.append(v[ok])
        rows.append(row[: len(h)][ok])  # one that begins with the line feed before a line belongs to that line
    f, r = np.concatenate(feats).view(np.int64), np.concatenate(rows).astype(np.int64)
    keep = r < len(lines)
    return (f, r) if keep.all() else (f[keep], r[keep])


class Hashed:
    """n-grams of ngrams() in the order of the text: a number for each order and place, DIM where no n-gram begins, so that sums over lines need no line numbers."""

    __slots__ = ("f", "at", "scale")

    def __init__(self, lines: list[str]):
        a = points("\n" + "\n".join(lines) + "\n")
        nl, n = np.flatnonzero(a == 10), len(a) - 1
        x = np.zeros(n + len(ORDERS), np.uint64)
        x[: n + 1] = np.where((a >= 48) & (a <= 57), np.uint32(48), a)
        f = np.empty((len(ORDERS), n), np.uint64)
        h = (x[:n] + np.uint64(1)) * np.uint64(_SALT[1])
        y = np.empty_like(h)
        for k, v in zip(ORDERS, f, strict=True):
            if k > 1:
                np.multiply(x[k - 1: k - 1 + n], np.uint64(_SALT[k]), out=y)
                h ^= y
                h *= np.uint64(0xBF58476D1CE4E5B9)
            np.right_shift(h, np.uint64(31), out=v)
            v ^= h
            v >>= np.uint64(3)
            v &= np.uint64(DIM - 1)
        self.f = f.view(np.int64)
        #: A line's places begin at the line feed before it.
        self.at = nl[:-1]
        length = np.diff(nl) - 1
        self.f[0, self.at] = DIM
        self.f[1, self.at[length == 0]] = DIM
        self.f[2:, nl[1:] - 1] = DIM
        self.f[3, np.maximum(nl[1:] - 2, 0)] = DIM
        #: 1/sqrt(number of a line's n-grams).
        self.scale = 1 / np.sqrt(np.maximum(len(ORDERS) * length, 1))

    def logits(self, w: np.ndarray) -> np.ndarray:
        """Of each line by its n-grams; ``w`` has DIM + 1 weights, the last 0."""
        s = w[self.f[0]]
        for f in self.f[1:]:
            s += w[f]
        return np.add.reduceat(s, self.at) * self.scale

    def gradient(self, e: np.ndarray) -> np.ndarray:
        """Sums by n-gram of the lines' errors."""
        x = np.repeat(e * self.scale, np.diff(self.at, append=self.f.shape[1]))
        g = np.bincount(self.f[0], weights=x, minlength=DIM + 1)
        for f in self.f[1:]:
            g += np.bincount(f, weights=x, minlength=DIM + 1)
        return g[:DIM]


def pieces(lines: list[str], characters: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Where to cut lines so that no piece has more characters, but for single lines."""
    at = n = 0
    for i, x in enumerate(lines):
        if n and n + len(x) + 1 > characters:
            yield at, i
            at, n = i, 0
        n += len(x) + 1
    if n:
        yield at, len(lines)


class Logistic:
    """weights of hashed n-grams (each line's n-grams scaled by 1/sqrt(their number)) and of dense features."""

    def __init__(self, w: np.ndarray, d: np.ndarray, b: float):
        self.w, self.d, self.b = w.astype(np.float32), d.astype(np.float64), float(b)

    def logits(self, lines: list[str], dense: np.ndarray) -> np.ndarray:
        f, r = ngrams(lines)
        n = len(lines)
        if not n:
            return np.zeros(0)
        s = np.bincount(r, weights=self.w[f], minlength=n) / np.sqrt(np.maximum(np.bincount(r, minlength=n), 1))
        return s + dense @ self.d + self.b


def fit(lines: list[str], dense: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 80, rate: float = 0.15) -> Logistic:
    """Full-batch Adam on the L2-regularized log loss; deterministic."""
    f, r = ngrams(lines)
    n = len(lines)
    scale = 1 / np.sqrt(np.maximum(np.bincount(r, minlength=n), 1))
    # only features that occur have weights to fit: the others stay 0
    used, f = np.unique(f, return_inverse=True)
    order = np.argsort(r, kind="stable")
    f, r = f[order], r[order]
    v = scale[r]
    c = np.ones(n) if weight is None else weight
    c = c / c.sum()
    u, k = len(used), dense.shape[1]
    theta = np.zeros(u + k + 1)

    def gradient(_: int, theta: np.ndarray) -> np.ndarray:
        z = np.bincount(r, weights=theta[f] * v, minlength=n) + dense @ theta[u:u + k] + theta[-1]
        e = c * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        return np.concatenate([np.bincount(f, weights=e[r] * v, minlength=u), dense.T @ e, [e.sum()]])

    theta = adam(theta, gradient, n, l2, steps, rate)
    w = np.zeros(DIM)
    w[used] = theta[:u]
    return Logistic(w, theta[u:u + k], theta[-1])


def adam(theta: np.ndarray, gradient: Callable[[int, np.ndarray], np.ndarray], n: int | np.ndarray, l2: float, steps: int = 80, rate: float = 0.15) -> np.ndarray:
    """Weights after the steps; the last of them, a classifier's constant, is not regularized. ``gradient``: of the loss in a step (from 1) at some weights."""
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        g = gradient(t, theta)
        g[..., :-1] += l2 / n * theta[..., :-1]
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        theta = theta - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
    return theta
