"""Approximate nearest neighbours by a forest of sorted hash strings with longest-prefix descent."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import vector_classes
from .exact_topk import best_of, blocks, ranked

BITS = 32
#: Trees whose strings are made at a time.
TOGETHER = 16
#: Bits that an ascent may take at once.
STRIDE = 4


class Forest:
    """Sorted arrays of BITS-long hash strings, one per tree, over the rows of one block.

    Strings are signs of random projections. A last component sqrt(max_norm^2 - norm^2) is added to the rows
    and 0 to queries, so that a larger inner product is a smaller angle.
    """

    def __init__(self, rows: np.ndarray, trees: int, seed: int):
        norms = (rows**2).sum(axis=1)
        self.planes = np.random.default_rng(seed).standard_normal((rows.shape[1] + 1, trees * BITS)).astype(np.float32)
        self.trees, self.n = trees, len(rows)
        strings = self.strings(np.c_[rows, np.sqrt(np.maximum(0, norms.max() - norms))])
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """(tree, row): BITS signs as a number whose first bit is the highest."""
        x, out = (x / (np.abs(x).max() or 1.0)).astype(np.float32), np.empty((self.trees, len(x)), np.uint32)
        for t in range(0, self.trees, TOGETHER):
            signs = x @ self.planes[:, t * BITS : (t + TOGETHER) * BITS] > 0
            out[t : t + TOGETHER] = np.packbits(signs, axis=1).reshape(len(x), -1, 4).view(">u4")[:, :, 0].T
        return out

    def ranges(self, strings: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends in each tree's sorted array of the rows that share the first `length` bits of each query: (tree, query)."""
        rest = (1 << (BITS - length)) - 1
        low = strings & np.uint32((1 << BITS) - 1 - rest)
        lo, hi = (np.empty(strings.shape, np.int64) for _ in range(2))
        for t in range(self.trees):
            lo[t] = np.searchsorted(self.sorted[t], low[t], "left")
            hi[t] = np.searchsorted(self.sorted[t], low[t] | np.uint32(rest), "right")
        return lo, hi

    def met(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """In how many trees each row lies in the ranges of one query."""
        size = hi - lo
        at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size) + np.repeat(np.arange(self.trees) * self.n, size)
        return np.bincount(self.order.ravel()[at], minlength=self.n)

    def candidates(self, queries: np.ndarray, least: int):
        """(query, rows): all trees descend to their longest matches and ascend together, a bit at a time, until `least` rows are met.

        Of the last step those met in most trees are taken, so the number of rows is `least`.
        """
        strings = self.strings(np.c_[queries, np.zeros(len(queries))])
        left, before = np.arange(len(queries)), [None] * len(queries)
        # Ranges only grow on the way up, so while all of a longer stride have met too few rows, its single bits needn't be looked at.
        start = BITS
        while start >= STRIDE and all((hi - lo).sum(axis=0).max(initial=0) < least for lo, hi in [self.ranges(strings, start - STRIDE)]):
            start -= STRIDE
        for length in range(start, -1, -1):
            if not len(left):
                return
            lo, hi = self.ranges(strings[:, left], length)
            going = (hi - lo).sum(axis=0) < least
            on = list(np.flatnonzero(going))
            for i in np.flatnonzero(~going):
                times = self.met(lo[:, i], hi[:, i])
                if (times > 0).sum() < least:
                    before[left[i]] = times
                    on.append(i)
                    continue
                deeper = before[left[i]]
                rank = times + (0 if deeper is None else deeper * (self.trees + 1))
                yield left[i], np.sort(np.argpartition(-rank, least - 1)[:least])
            left = left[np.sort(np.array(on, int))]


def forest_search(queries: np.ndarray, items: np.ndarray, k: int, trees: int, share: float, seed: int):
    """Rows of queries, rows of items and exact products of the k best candidates and their ties."""
    forest, out = Forest(items, trees, seed), []
    least = min(len(items), max(k, math.ceil(share * len(items))))
    for at in range(0, len(queries), 1024):
        part = queries[at : at + 1024]
        for q, cols in forest.candidates(part, least):
            got = (items[cols] * part[q]).sum(axis=1)
            kept = got >= np.partition(got, -k)[-k] if len(got) > k else np.ones(len(got), bool)
            out.append((np.full(kept.sum(), at + q), cols[kept], got[kept]))
    return (np.concatenate(x) for x in zip(*out, strict=True))


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, trees: int = 512, share: float = 0.45, seed: int = 1, query_block: int = 8192, item_block: int = 16384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by `every`, the k nearest others found.

    Nearness is the inner product in double precision. All classes of equal vectors are dealt to blocks of about
    `item_block`; each block indexes every row it has in a forest, and the stated queries meet the forests block
    by block. In a block a query's trees descend to their longest common prefixes and ascend together until `share` of the
    block's rows (k at least) have been met; only these are scored, exactly. The planes are random, so nothing
    is fitted. `share` and `trees` set recall against work: vectors without structure, as in the tests, need this much for 0.9.

    Null and zero vectors and those with null, NaN or infinite components take no part; vectors of another length
    than the query's are not its candidates. Fewer than k candidates: all. Ties go to the smaller vec_id; equal
    vectors are one class, found together. An empty table gives no rows. Extra columns are not read.
    """
    classes, members = vector_classes(embeddings, k + 1, allow_zero=False)
    members = members.filter(F.col("vec_id") % every == 0)
    left, right = blocks(embeddings, classes, members, every, query_block, item_block)

    def search(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(items):
            return best_of(queries, items, np.zeros(0, int), np.zeros(0, int), np.zeros(0, float), k)
        rows, cols, scores = forest_search(np.stack(queries["q_vector"]), np.stack(items["vector"]), k + 1, trees, share, seed)
        return best_of(queries, items, rows, cols, scores, k)

    found = left.groupBy("qb", "ib", "dim").cogroup(right.groupBy("qb", "ib", "dim")).applyInPandas(search, "class_id long, score double, ids array<long>")
    return ranked(found, members, k)
