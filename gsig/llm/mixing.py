"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, checkpointed

WEIGHTS = (5, 2, 1)
#: Objects up to which numpy draws hypergeometric numbers.
EXACT_BELOW = 10**9
#: ln(2 pi) / 2.
HALF_LOG_2_PI = Decimal("0.91893853320467274178032973640561763986139747363778")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text, null: 0) and key, copy: what tells rows apart, equal rows by a number."""
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "source", "text").alias("key"))
    return rows.withColumn("copy", F.row_number().over(W.partitionBy("key").orderBy("size")))


def targets(rows: DataFrame, weights: tuple = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, n_docs, target: shares of all sizes by weight, none above `most` times its source's size.

    Sources by code point, null last, take the weights in turn. What a cap frees is shared again by weight: with
    sources in order of cap/weight, the level is the first that needs no cap. One row per source; documents
    are summed before anything is ordered.
    """
    src = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = (F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    src = src.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1))
    src = src.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("r", F.col("cap") / F.col("w"))
    order = W.orderBy("r", F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    whole = F.sum("source_size").over(W.partitionBy())
    src = src.withColumn("level", (whole - before) / left)
    level = F.max(F.when(F.col("level") <= F.col("r"), F.col("level"))).over(W.partitionBy())
    return src.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("w")))).select("source", "source_size", "n_docs", "target")


def log_factorial(n: int) -> Decimal:
    """ln n! to 40 digits: Stirling's series from 200 on, where its terms fall fast."""
    if n < 200:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    # Numerators and denominators of the series in 1/n, 1/n^3, ...
    terms = ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400))
    return (x + Decimal("0.5")) * x.ln() - x + HALF_LOG_2_PI + sum(Decimal(a) / Decimal(b) / x ** (2 * i + 1) for i, (a, b) in enumerate(terms))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of `good` are among n draws without replacement from good + bad, exactly so distributed at any size.

    numpy draws up to 10^9 objects. Beyond, rejection from an envelope that holds for every log-concave law: flat
    about the mode, with exponential tails. Probabilities are computed to 40 digits.
    """
    if good + bad < EXACT_BELOW:
        return int(rng.hypergeometric(good, bad, n))
    with localcontext(prec=50):
        whole = log_factorial(good) + log_factorial(bad) + log_factorial(n) + log_factorial(good + bad - n) - log_factorial(good + bad)

        def log_p(k: int) -> Decimal:
            return whole - log_factorial(k) - log_factorial(good - k) - log_factorial(n - k) - log_factorial(bad - n + k)

        low, high = max(0, n - bad), min(good, n)
        mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
        top = log_p(mode)
        p = float(top.exp())
        w = 1 + p / 2
        while True:
            u, v, sign = rng.random(), rng.random(), -1 if rng.random() < 0.5 else 1
            y = v * w / p if u <= w / (1 + w) else (w + rng.exponential()) / p
            x = mode + sign * round(y)
            if low <= x <= high and rng.random() * min(1.0, math.exp(w - p * y)) <= float((log_p(x) - top).exp()):
                return x


def split(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of each count fall among n draws without replacement: one hypergeometric draw per source in turn."""
    out, left = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        left -= c
        out[i] = x = hypergeometric(rng, c, left, n) if c and n else 0
        n -= x
    return out


def leaves(quota: list[int], shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, offsets, counts) of the tree's leaves in first..last: each node deals its counts to two halves.

    Every node has its own seed, so any task replays the splits on the path from the root and then expands its part.
    """
    nodes = [(0, shards, np.zeros(len(quota), np.int64), np.array(quota, np.int64))]
    while nodes:
        lo, hi, start, counts = nodes.pop()
        if hi <= first or lo > last:
            continue
        if hi - lo == 1:
            yield lo, start, counts
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        take = split(rng, counts, int(counts.sum()) * (mid - lo) // (hi - lo))
        nodes += [(mid, hi, start + take, counts - take), (lo, mid, start, take)]


def mix(rows: DataFrame, src: DataFrame, block_words: int | None = 256, shard_blocks: int = 4096, bucket: int = 65536, seed: int = 7) -> DataFrame:
    """The mix of sized() rows to the targets() of their sources: shard, position, key, copy, block, pass, words taken (from the block's start).

    A document is cut into blocks of `block_words` words (None: one block). A source whose target is t times its
    size gives all its blocks floor(t) times and, in one more permuted pass, blocks until the target is
    reached; with blocks of words the last is cut to fit, so a source's words miss its target by less than one, and
    with whole documents the last is taken if that comes nearer. The exact quotas of draws are split among shards
    by the tree, each shard takes its own disjoint run of every source's permuted draws, and a hash of the draw
    orders the shard.

    A source's permutation is by hash in buckets of about `bucket` blocks with running totals over buckets, so a source
    with a third of all rows is not ordered in one task. Sources: one row each. Empty documents have no blocks. The same
    input gives the same mix in any partitioning.
    """
    src = src.withColumn("goal", F.round("target").cast("long"))
    word = F.lit(block_words or 1)
    n_blocks = F.ceil(F.col("size") / word) if block_words else F.lit(1).cast("long")
    blocks = rows.filter("size > 0").select("source", "key", "copy", "size", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"))
    words = F.least(word, F.col("size") - F.col("block") * word) if block_words else F.col("size")
    draws = join_source(blocks.withColumn("words", words), src.filter("source_size > 0").withColumn("full", F.floor(F.col("goal") / F.col("source_size"))))
    draws = draws.withColumn("rest", F.col("goal") - F.col("full") * F.col("source_size"))
    draws = draws.filter("goal > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1))))
    draws = draws.filter("pass >= 0").withColumn("u", F.xxhash64("key", "copy", "block", "pass", F.lit(seed)))
    per_source = F.ceil(F.col("source_size") / (word if block_words else F.lit(256)) / bucket)
    draws = draws.withColumn("bucket", F.floor((F.col("u").cast("double") / 2.0**64 + 0.5) * per_source))
    place = ["source_no", "pass", "bucket"]
    draws = draws.withColumn("source_no", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))))
    draws = draws.select(*place, "u", "key", "copy", "block", "words", "full", "rest")
    totals = draws.groupBy(*place).agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    earlier = W.partitionBy("source_no", "pass").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*place, F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    inside = W.partitionBy(*place).orderBy("u", "key", "copy", "block")
    draws = draws.join(totals, place).withColumn("begin", F.col("w0") + F.sum("words").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
    draws = draws.withColumn("seq", F.col("n0") + F.row_number().over(inside) - 1)
    room = F.col("rest") - F.col("begin")
    part = F.least("words", room) if block_words else F.when(room * 2 >= F.col("words"), F.col("words"))
    draws = draws.withColumn("taken", F.when(F.col("pass") < F.col("full"), F.col("words")).otherwise(part)).filter("taken > 0")
    draws = checkpointed(draws.select("source_no", "pass", "seq", "u", "key", "copy", "block", "taken"))

    # Draws of a source in order: its full passes, then the begun one. Only the begun pass can be short, and it is the last.
    passes = draws.groupBy("source_no", "pass").agg(F.count("*").alias("n"))
    passes = passes.withColumn("p0", F.coalesce(F.sum("n").over(W.partitionBy("source_no").orderBy("pass").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    quotas = passes.groupBy("source_no").agg(F.sum("n").alias("q"))
    root = quotas.agg(F.array_sort(F.collect_list(F.struct("source_no", "q"))).alias("quota"), F.sum("q").alias("all")).filter("all > 0")
    n_shards = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("all") / shard_blocks)))).cast("long")
    each = 64
    tasks = root.withColumn("shards", n_shards).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1, F.lit(each).cast("long")))).repartition(32)

    def expand(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for quota, shards, first in zip(part["quota"], part["shards"], part["first"], strict=True):
                names = [x["source_no"] for x in quota]
                for shard, start, counts in leaves([x["q"] for x in quota], shards, first, first + each - 1, seed):
                    yield pd.DataFrame({"source_no": names, "seq": start, "n": counts, "shard": shard}).query("n > 0")

    runs = tasks.select("quota", "shards", "first").mapInPandas(expand, "source_no long, seq long, n long, shard long")
    # A run covers seq .. seq+n-1. Both sides are cut at multiples of a chunk, and each draw takes the last run begun in its chunk.
    chunk = 8192
    runs = runs.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("seq") / chunk), F.floor((F.col("seq") + F.col("n") - 1) / chunk))))
    runs = runs.select("source_no", "chunk", F.greatest("seq", F.col("chunk") * chunk).alias("seq"), "shard")
    sought = draws.join(passes.select("source_no", "pass", "p0"), ["source_no", "pass"]).withColumn("seq", F.col("seq") + F.col("p0")).drop("p0")
    sought = sought.withColumn("chunk", F.floor(F.col("seq") / chunk))
    both = runs.unionByName(sought, allowMissingColumns=True)
    last = W.partitionBy("source_no", "chunk").orderBy("seq", F.desc_nulls_last("shard")).rowsBetween(W.unboundedPreceding, 0)
    dealt = both.withColumn("shard", F.last("shard", ignorenulls=True).over(last)).filter("key is not null")
    position = F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64("u", F.lit(seed)), "u", "key", "copy", "block"))
    return dealt.select("shard", position.alias("position"), "key", "copy", "block", "pass", "taken")


def join_source(rows: DataFrame, src: DataFrame) -> DataFrame:
    """rows with the columns of their source; null is a source too. The side of sources is tiny and grows with their number only."""
    s = src.withColumnRenamed("source", "__source")
    return rows.join(s, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def mix_report(docs: DataFrame, weights: tuple = WEIGHTS, most: int = 3, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, draws, first_shard, first_position.

    Null texts and texts without words have size 0 and taken 0; rows that repeat a document are documents of their own.
    An empty table gives no rows. Extra columns are not read.
    """
    rows = checkpointed(sized(docs))
    src = checkpointed(targets(rows, weights, most))
    mixed = mix(rows, src, **options)
    taken = mixed.groupBy("key", "copy").agg(F.sum("taken").alias("taken"), F.count("*").alias("draws"), F.min(F.struct("shard", "position")).alias("first"))
    out = join_source(rows, src).join(taken, ["key", "copy"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("draws", F.lit(0)).alias("draws"), F.col("first.shard").alias("first_shard"), F.col("first.position").alias("first_position"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: int = 3, **options) -> DataFrame:
    """The documents of the mix, whole, with their own columns; one that is taken twice is there twice, one not taken is absent."""
    rows = checkpointed(sized(docs))
    mixed = mix(rows, checkpointed(targets(rows, weights, most)), block_words=None, **options)
    own = docs.withColumn("__key", F.xxhash64("doc_id", "source", "text"))
    own = own.withColumn("__copy", F.row_number().over(W.partitionBy("__key").orderBy("doc_id")))
    wanted = mixed.select(F.col("key").alias("__key"), F.col("copy").alias("__copy"))
    return own.join(wanted, ["__key", "__copy"]).select(*(F.col(f"`{c}`") for c in docs.columns))
