"""Exact top-k inner products over integer vectors, pruned by multi-resolution segment statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import vector_classes

#: Segments of each resolution; each halves those of the one before.
LEVELS = (1, 2, 4, 8, 16, 32)
#: Integers up to this size are exact as doubles; larger products are made with Python's integers.
EXACT = float(1 << 53)


def segment_stats(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, means and deviations (root of the summed squares about the mean) of n even segments of each row.

    Components are in order of strength, so a segment holds axes of like strength.
    """
    edges = np.linspace(0, x.shape[1], n + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    spread = np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, edges[:-1], axis=1)
    return size, mean, np.sqrt(spread)


def bounds(q: tuple, x: tuple) -> np.ndarray:
    """Upper bounds on every inner product of the rows behind q and x: per segment, length * means + product of deviations."""
    return (q[1] * q[0]) @ x[1].T + q[2] @ x[2].T


def turned(items: np.ndarray) -> np.ndarray:
    """A rotation to the principal axes of items, strongest first: inner products stay, and segments differ in what they hold."""
    scale = np.abs(items).max() or 1.0
    return np.linalg.eigh((items / scale).T @ (items / scale))[1][:, ::-1]


def products(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers: as doubles where no sum can leave their exact range, else as Python's integers."""
    if np.abs(queries).max(initial=0) * np.abs(items).max(initial=0) * queries.shape[1] < EXACT:
        return (queries @ items.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    out = whole(queries) @ whole(items).T
    if out.size and max(abs(out.min()), abs(out.max())) >= 1 << 63:
        raise OverflowError("an inner product of scaled components does not fit 64 bits")
    return out.astype(np.int64)


def block_search(queries: np.ndarray, items: np.ndarray, k: int, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries, rows of items and scores: for each query all items that score at least its k-th best here.

    A larger inner product is a smaller distance, so upper bounds on the product are lower bounds on the
    distance. Bounds are those of the rotated vectors (`turned`). The exact products of the items best by the coarsest bound give a first
    threshold; each finer resolution is computed for what the coarser ones left, raises the threshold in the same way and drops what
    cannot reach it; survivors of the finest are multiplied out.
    Rows of very large components (where products leave the exact range of doubles) are multiplied out at once.
    counts: gets the pairs alive after each level.
    """
    dim = items.shape[1]
    small = np.abs(items).max(axis=1) < math.sqrt(EXACT / dim / 2)
    odd = np.flatnonzero(~small)
    plain = np.flatnonzero(small)
    axes = turned(items[plain]) if len(plain) else np.eye(dim)
    levels = [n for n in LEVELS if n <= dim]
    stats_x = [segment_stats(items[plain] @ axes, n) for n in levels]
    out = []
    step = max(1, (1 << 22) // max(1, len(items)))
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        best = products(part, items[odd])
        large = np.abs(part).max(axis=1) >= math.sqrt(EXACT / dim / 2)
        alive, floor = None, np.full(len(part), -np.inf)
        for n, sx in zip(levels, stats_x, strict=True):
            sq = segment_stats(part @ axes, n)
            slack = 1e-6 + 1e-9 * np.linalg.norm(part, axis=1)[:, None] * np.linalg.norm(items[plain], axis=1)[None, :] if alive is None else slack
            if alive is None or alive.mean() > 0.2:  # a product of matrices is cheaper than picking pairs
                rough = bounds(sq, sx) + slack
                if alive is not None:
                    rough[~alive] = -np.inf
                if len(items) >= k:
                    first = np.argpartition(-rough, min(4 * k, len(plain)) - 1, axis=1)[:, : 4 * k] if len(plain) else np.zeros((len(part), 0), int)
                    seen = np.stack([np.r_[products(part[i : i + 1], items[plain[f]])[0], best[i]] for i, f in enumerate(first)])
                    floor = np.maximum(floor, np.partition(seen, -k, axis=1)[:, -k])
                alive = (rough >= floor[:, None]) | (large[:, None] & (True if alive is None else alive))
            else:
                r, c = np.nonzero(alive)
                for lo in range(0, len(r), 1 << 18):
                    i, j = r[lo : lo + (1 << 18)], c[lo : lo + (1 << 18)]
                    top = (sq[1][i] * sx[1][j]) @ sq[0] + (sq[2][i] * sx[2][j]).sum(axis=1) + slack[i, j]
                    alive[i, j] = (top >= floor[i]) | large[i]
            if counts is not None:
                counts[n] = counts.get(n, 0) + int(alive.sum())
        if alive.mean() > 0.2:
            got = products(part, items[plain])
            r, c = np.nonzero(alive & (got >= floor[:, None]))
            out.append((r + at, plain[c], got[r, c]))
        else:
            r, c = np.nonzero(alive)
            got = np.concatenate([products(part[i : i + 1], items[plain[c[r == i]]])[0] for i in range(len(part))]) if len(r) else np.zeros(0, np.int64)
            kept = got >= floor[r]
            out.append((r[kept] + at, plain[c[kept]], got[kept]))
        r, c = np.nonzero(best >= floor[:, None])
        out.append((r + at, odd[c], best[r, c]))
    rows, cols, scores = (np.concatenate(x) for x in zip(*out, strict=True))
    return rows, cols, scores.astype(np.int64)


def exact_topk(embeddings: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, query_block: int = 4096, item_block: int = 16384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by `every`, its k best other rows.

    The score is the inner product of floor(scale * x) components, ties go to the smaller vec_id.
    The stated queries meet all rows block by block: queries are cut into blocks of `query_block`, items into
    blocks of `item_block` classes, and each pair of blocks is one group of bounded size; no side is broadcast.
    Items are sent once per query block, so traffic grows with rows * query blocks, which is what an exact
    search of a query set that grows with the table costs at least.
    Equal vectors are one class, so a vector that a third of the rows share is scored once.

    Null vectors and those with null, NaN or infinite components take no part; vectors of other lengths than
    the query's are not its candidates. Components of any size count exactly; a score that a long cannot hold is an error. Zero vectors
    take part. Fewer than k candidates: all. An empty table gives no rows. Extra columns are not read.
    """
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= 2.0**52 / scale)  # noqa: E731  whole numbers already, if they are numbers
    floor = lambda x: F.when(odd(x), x * scale).otherwise(F.floor(x * scale).cast("double"))
    scaled = embeddings.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), floor).alias("embedding"))
    classes, members = vector_classes(scaled, k + 1, allow_zero=True)
    members = members.filter(F.col("vec_id") % every == 0)
    left, right = blocks(embeddings, classes, members, every, query_block, item_block)

    def search(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(items):
            return best_of(queries, items, np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), k)
        rows, cols, scores = block_search(np.stack(queries["q_vector"]), np.stack(items["vector"]), k + 1)
        return best_of(queries, items, rows, cols, scores, k)

    found = left.groupBy("qb", "ib", "dim").cogroup(right.groupBy("qb", "ib", "dim")).applyInPandas(search, "class_id long, score long, ids array<long>")
    return ranked(found, members, k)


def blocks(embeddings: DataFrame, classes: DataFrame, members: DataFrame, every: int, query_block: int, item_block: int) -> tuple[DataFrame, DataFrame]:
    """The classes that are asked for and all classes, so dealt to (qb, ib, dim) that each pair of blocks meets once."""
    n_queries, n_items = embeddings.filter(F.col("vec_id") % every == 0).count(), embeddings.count()
    q_blocks, i_blocks = -(-max(1, n_queries) // query_block), -(-max(1, n_items) // item_block)
    block = lambda n, salt: F.pmod(F.xxhash64("class_id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = classes.join(members.select("class_id").distinct(), "class_id", "left_semi")
    left = asked.select(F.size("vector").alias("dim"), F.col("class_id").alias("q_class"), F.col("vector").alias("q_vector"), block(q_blocks, 1).alias("qb"), each(i_blocks).alias("ib"))
    right = classes.select(F.size("vector").alias("dim"), "class_id", "vector", "ids", block(i_blocks, 2).alias("ib"), each(q_blocks).alias("qb"))
    return left, right


def best_of(queries: pd.DataFrame, items: pd.DataFrame, rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The k + 1 best (rows, cols, scores) of each query row, ties to the class whose smallest id is smaller."""
    first = np.array([x[0] for x in items["ids"]], np.int64)
    order = np.lexsort((first[cols], -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    starts = np.flatnonzero(np.r_[True, np.diff(rows) != 0]) if len(rows) else np.zeros(0, int)
    kept = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)])) <= k
    return pd.DataFrame({"class_id": queries["q_class"].to_numpy()[rows[kept]], "score": scores[kept], "ids": items["ids"].to_numpy(object)[cols[kept]]}, index=range(kept.sum()))


def ranked(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The k best of each query from (class_id, score, ids) rows: highest score, then smallest id, never the query itself."""
    flat = found.select("class_id", "score", F.explode("ids").alias("vec_id")).distinct()
    best = W.partitionBy("class_id").orderBy(F.desc("score"), "vec_id")
    top = flat.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    pairs = members.withColumnRenamed("vec_id", "query_id").distinct().join(top, "class_id").filter("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
