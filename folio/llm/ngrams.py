"""Character n-gram models over NumPy arrays of code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed bigram and unigram tables: their sizes bound what is collected and broadcast, whatever the corpus.
BIGRAMS = 1 << 20
UNIGRAMS = 1 << 16
#: Weight of the unigram prior in a bigram's smoothed probability.
PRIOR = 2.0
#: Taken off every bigram's count.
DISCOUNT = 1.5

def points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


#: ASCII characters that are neither letters nor figures are one context: a tag, a line end and a space alike.
_CLASS = np.array([c if chr(c).isalnum() else 10 for c in range(128)], dtype=np.uint32)


def classes(a: np.ndarray) -> np.ndarray:
    out = a.copy()
    low = a < 128
    out[low] = _CLASS[a[low]]
    return out


def uni_index(a: np.ndarray) -> np.ndarray:
    return np.where(a < UNIGRAMS, a, UNIGRAMS - 1).astype(np.int64)


def bi_index(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)


class Model:
    """P(next | character): hashed bigram counts, backed off to add-one unigrams."""

    def __init__(self, bi: np.ndarray, uni: np.ndarray):
        total = uni.sum()
        p_uni = (uni + 0.5) / (total + 0.5 * UNIGRAMS)
        self.log_prior = np.log(PRIOR * p_uni).astype(np.float32)
        self.p_prior = (PRIOR * p_uni).astype(np.float32)
        self.log_den = np.log(uni + PRIOR).astype(np.float32)
        # a bigram seen once proves nothing: records that only look clean would vouch for themselves
        self.bi = np.maximum(bi - DISCOUNT, 0).astype(np.float32)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.log(self.bi[bi_index(a, b)] + self.p_prior[uni_index(b)]) - self.log_den[uni_index(a)]


def train(df: DataFrame, text_col: str, clean, fold: Column, folds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each fold (numbers, counts) of what is not 0 among bigrams with at least one character beyond ASCII and, from BIGRAMS on, all first characters, over every clean text.

    Each task sums tables over all its texts and emits what is not 0; the engine
    adds the tasks' sums up, so what is shuffled is a small share of the input
    and what is collected is bounded by the tables.
    ``clean``: text -> text to count, or None to leave the record out.
    """
    size = BIGRAMS + UNIGRAMS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, size), np.int64)
        for b in batches:
            texts: list[list[str]] = [[] for _ in range(folds)]
            for x, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if x and (t := clean(x)):
                    texts[k].append(t)
            for k, some in enumerate(texts):
                if not some:
                    continue
                a = classes(points("\n" + "\n".join(some) + "\n"))
                keep = (a[:-1] > 127) | (a[1:] > 127)
                f, s = a[:-1][keep], a[1:][keep]
                sums[k, :BIGRAMS] += np.bincount(bi_index(f, s), minlength=BIGRAMS)
                sums[k, BIGRAMS:] += np.bincount(uni_index(f), minlength=UNIGRAMS)
        for k in range(folds):
            some = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_arrays([pa.array(some + k * size, pa.int32()), pa.array(sums[k, some], pa.int64())], names=["i", "n"])

    parts = df.select(F.col(text_col), fold.cast("int")).mapInArrow(count, "i int, n bigint")
    # at most folds * (BIGRAMS + UNIGRAMS) rows
    t = parts.groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    i, n = t.column("i").to_numpy(), t.column("n").to_numpy()
    return [((i[i // size == k] % size).astype(np.int32), n[i // size == k]) for k in range(folds)]
