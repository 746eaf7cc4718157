"""Sampling, splitting and generation. Random choices are hashes of ids and a seed, so they do not depend on partitions."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import physical

#: Positions of a leaf of the tree that splits a sample over bins, and nodes at its top.
LEAF, TOP = 4096, 4096


def draw(seed: int, *ids: str) -> Column:
    """A number in [0, 1) from ids and a seed."""
    return F.xxhash64(*ids, F.lit(seed)).cast("double") / F.lit(2.0**64) + 0.5


def ranked(rows: DataFrame, order: list, keys: list[str] = (), name: str = "_r") -> DataFrame:
    """rows with their rank (from 0) by a draw in [0, 1) and ids, and _all, by blocks cut from the data."""
    return physical.ranked(rows, list(keys), order, name)


def split_exact(rng: np.random.Generator, sizes: np.ndarray, k: int) -> np.ndarray:
    """How many of k objects, drawn without replacement, fall to groups of these sizes; exact for whole numbers of 64 bits.

    Each group gives a binomial number; what that is off the total, about its root, is drawn anew from what was taken or from what was left,
    which keeps every set of k objects equally likely. A few objects are drawn one by one.
    """
    total = int(sizes.sum())
    if 2 * k > total:
        return sizes - split_exact(rng, sizes, total - k)
    if k <= 256:
        chosen: set[int] = set()
        while len(chosen) < k:
            chosen.add(int(rng.integers(total)))
        return np.bincount(np.searchsorted(np.cumsum(sizes), sorted(chosen), "right"), minlength=len(sizes)).astype(np.int64)
    taken = rng.binomial(sizes, k / total)
    over = int(taken.sum()) - k
    return taken - split_exact(rng, taken, over) if over > 0 else taken + split_exact(rng, sizes - taken, -over)


def thin_exact(rows: DataFrame, fraction: float, seed: int = 1, complement: bool = False) -> DataFrame:
    """rows (contig, pos, n) with `kept`: a sample of exactly round(fraction * total) of the counted objects, without replacement;
    with complement also `rest`, those that are not in it.

    A tree splits the sample: TOP nodes on the driver, the leaves of a node in one task, the bins of a leaf (LEAF positions) in
    another. Draws follow from a node's number and the seed. Every bin is a row on its way, however many objects it counts.
    """
    size = F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("long")
    leaf = F.xxhash64("contig", F.floor(F.col("pos") / LEAF))
    leaves = physical.shared(rows.groupBy(leaf.alias("_leaf")).agg(F.sum(size).alias("_t")).withColumn("_node", F.pmod("_leaf", F.lit(TOP))))
    top = sorted((r[0], r[1]) for r in leaves.groupBy("_node").agg(F.sum("_t")).collect())
    sizes = np.array([n for _, n in top], np.int64)
    quotas = split_exact(np.random.default_rng([seed, 0]), sizes, math.floor(sizes.sum() * fraction + 0.5))
    quotas = rows.sparkSession.createDataFrame([(node, int(q)) for (node, _), q in zip(top, quotas, strict=True)], "_node long, _q long")

    def among(level: int, node: str, order: list[str], weight: str, out: str):
        def share(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(order)
            rng = np.random.default_rng([seed, level, int(part[node].iloc[0]) & (2**63 - 1)])
            return part.assign(**{out: split_exact(rng, part[weight].to_numpy(np.int64), int(part["_q"].iloc[0]))}).drop(columns=["_q", node])

        return share

    shares = leaves.join(quotas, "_node").groupBy("_node").applyInPandas(among(1, "_node", ["_leaf"], "_t", "_share"), "_leaf long, _t long, _share long")
    bins = rows.withColumn("_leaf", leaf).withColumn("_size", size).join(shares.select("_leaf", F.col("_share").alias("_q")), "_leaf")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    out = bins.groupBy("_leaf").applyInPandas(among(2, "_leaf", ["contig", "pos", "_size"], "_size", "kept"), f"{schema}, _size long, kept long").drop("_size")
    return out.withColumn("rest", F.col("n") - F.col("kept")) if complement else out


def thin_binomial(rows: DataFrame, fractions: list[float], seed: int = 1) -> DataFrame:
    """rows (contig, pos, n) with frac and kept, binomial for each bin."""
    each = rows.withColumn("frac", F.explode(F.array(*map(F.lit, fractions))))

    @F.pandas_udf("long")
    def thin(n: pd.Series, frac: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([int(np.random.default_rng(abs(int(x))).binomial(int(a), f)) for a, f, x in zip(n, frac, u, strict=True)])

    return each.withColumn("kept", thin("n", "frac", F.xxhash64("contig", "pos", "frac", F.lit(seed))))


def random_rounding(rows: DataFrame, ids: list[str], seed: int = 1) -> DataFrame:
    """Values rounded up with the chance of their decimals."""
    v = F.col("value")
    return rows.withColumn("value", F.floor(v) + (draw(seed, *ids) < v - F.floor(v)).cast("long"))


def balanced_split(rows: DataFrame, key: str, parts: int, seed: int = 1) -> DataFrame:
    """rows with part: sizes equal up to one id, and all rows of an id together."""
    ids = ranked(rows.select(key).distinct().withColumn("_u", draw(seed, key)), ["_u", key])
    return rows.join(ids.select(key, (F.col("_r") % parts).alias("part")), key)


def sample_pairs(rows: DataFrame, key: str, fraction: float, seed: int = 1) -> DataFrame:
    """A fraction of ids, all rows of an id together; no shuffle."""
    return rows.filter(draw(seed, key) < fraction)


def sample_exact(rows: DataFrame, key: str, fraction: float, seed: int = 1) -> DataFrame:
    """Exactly floor(fraction * ids) of the ids."""
    ids = ranked(rows.select(key).distinct().withColumn("_u", draw(seed, key)), ["_u", key])
    return rows.join(ids.filter(F.col("_r") < F.floor(F.col("_all") * fraction)).select(key), key, "left_semi")


def shuffle_reads(rows: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """rows with place: a random order that tables with the same ids share."""
    return ranked(rows.withColumn("_u", draw(seed, key)), ["_u", key], name="place").drop("_u", "_all")


def train_valid_test(rows: DataFrame, order: Column, train: float, valid: float, most: int | None = None, balanced: bool = False) -> DataFrame:
    """rows with split, per label: the first by `order` (a draw in [0, 1)) up to a number or the smaller label's, cut at rounded shares."""
    r = ranked(rows.withColumn("_u", order), ["_u", "id"], ["label"])
    n = F.col("_all")
    if balanced:
        least = rows.groupBy("label").agg(F.count("*").alias("_c")).agg(F.min("_c").alias("_m"))
        r, n = r.join(least), F.col("_m")
    n = F.least(n, F.lit(most)) if most is not None else n
    a, b = F.round(n * train), F.round(n * (train + valid))
    split = F.when(F.col("_r") < a, "train").when(F.col("_r") < b, "valid").otherwise("test")
    return r.filter(F.col("_r") < n).withColumn("split", split).drop("_u", "_r", "_all", "_m")


def interleave_shards(rows: DataFrame, shard: int, test: int, valid: int, train: int | None = None, alternate: bool = True) -> DataFrame:
    """id, label, split, shard, place: reads of both labels in turn, until one label ends; test first, then valid, then train, up to a cap.

    rows: id, label, file, place. Files of a label are read in turn, a read of each that has any left, or, without alternate, one after another.
    A read's turn follows from its rank in its file and the files' sizes, so only ranks inside files need an order; files are few.
    """
    r = physical.ranked(rows.select("id", "label", "file", "place"), ["label", "file"], ["place", "id"], name="_rank")
    files = r.groupBy("label", "file").agg(F.count("*").alias("n"))
    files = files.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("file", "n"))).alias("_files"), F.sum("n").alias("_all_files"))
    pairs = files.agg(F.when(F.count("*") == 2, F.min("_all_files")).otherwise(0).alias("_pairs"))
    earlier = lambda x: x["file"] < F.col("file")
    if alternate:
        share = lambda x: F.least(x["n"], F.col("_rank")) + (earlier(x) & (x["n"] > F.col("_rank"))).cast("long")
        turn = F.aggregate("_files", F.lit(0).cast("long"), lambda s, x: s + share(x))
    else:
        turn = F.aggregate("_files", F.col("_rank").cast("long"), lambda s, x: s + F.when(earlier(x), x["n"]).otherwise(0))
    r = r.join(files.drop("_all_files"), "label").withColumn("_turn", turn).join(pairs).filter(F.col("_turn") < F.col("_pairs"))
    r = r.select("id", "label", (F.col("_turn") * 2 + F.when(F.col("label"), 0).otherwise(1)).alias("place"))
    p = F.col("place")
    if train is not None:
        r = r.filter(p < test + valid + train)
    start = F.when(p < test, 0).when(p < test + valid, test).otherwise(test + valid)
    return r.withColumn("split", F.when(p < test, "test").when(p < test + valid, "valid").otherwise("train")).withColumn("shard", F.floor((p - start) / shard))


def class_balanced(rows: DataFrame, per_epoch: int, seed: int = 1) -> DataFrame:
    """rows with epoch: slices of a shuffled order per label, an equal number of each label in every epoch."""
    r = ranked(rows.withColumn("_u", draw(seed, "id")), ["_u", "id"], ["label"])
    return r.withColumn("epoch", F.floor(F.col("_r") / per_epoch)).drop("_u", "_r", "_all")


def random_sequences(spark: SparkSession, n: int, length: int, freqs: dict[str, float], seed: int = 1) -> DataFrame:
    """id, seq: Markov sequences whose k-mers have the given frequencies: the first k bases by frequency, then each by the last k-1."""
    k = len(next(iter(freqs)))
    names = sorted(freqs)
    start = np.array([freqs[x] for x in names], float)
    begin = np.cumsum(start / start.sum())
    letters = sorted({*"ACGT", *"".join(names)})
    # Contexts are the last k-1 letters as a number; of each, the letters that follow and their cumulated shares. Unmet ones are followed by ACGT alike.
    number = lambda x: sum(letters.index(c) * len(letters) ** i for i, c in enumerate(reversed(x)))
    steps, after = np.full((len(letters) ** (k - 1), len(letters)), np.inf), np.zeros((len(letters) ** (k - 1), len(letters)), np.int64)
    steps[:, :4], after[:, :4] = np.cumsum([0.25] * 4), [letters.index(x) for x in "ACGT"]
    own: dict[str, list[str]] = {}
    for m in names:
        own.setdefault(m[:-1], []).append(m)
    for x, some in own.items():
        w = np.array([freqs[m] for m in some], float)
        row = number(x)
        steps[row] = np.inf
        steps[row, : len(some)] = np.cumsum(w / w.sum()) if w.sum() else np.cumsum(np.full(len(some), 1 / len(some)))
        after[row] = letters.index(some[-1][-1])
        after[row, : len(some)] = [letters.index(m[-1]) for m in some]
    first, codes = np.array([[letters.index(c) for c in m] for m in names]), np.frombuffer("".join(letters).encode("utf-32-le"), np.uint32)

    def sequences(ids: np.ndarray) -> list[str]:
        """A letter of all of them at a time; each has its own draws."""
        u = np.array([np.random.default_rng([seed, i]).random(1 + max(0, length - k)) for i in ids.tolist()])
        out = np.empty((len(ids), max(k, length)), np.int64)
        out[:, :k] = first[np.searchsorted(begin, u[:, 0], side="right").clip(0, len(names) - 1)]
        context = out[:, 1:k] @ len(letters) ** np.arange(k - 2, -1, -1)
        for at in range(k, length):
            followed = (steps[context] <= u[:, at - k + 1, None]).sum(axis=1)
            out[:, at] = after[context, np.minimum(followed, len(letters) - 1)]
            context = (context * len(letters) + out[:, at]) % len(steps)
        return [row.tobytes().decode("utf-32-le") for row in codes[out[:, :length]]]

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = max(1, (1 << 18) // max(1, length))
        for part in parts:
            for at in range(0, len(part), size):
                ids = part["id"].iloc[at : at + size]
                yield pd.DataFrame({"id": ids, "seq": sequences(ids.to_numpy())})

    return spark.range(n).mapInPandas(make, "id long, seq string")


def permutation(counts: dict[str, int], rank: int) -> str:
    """The permutation of that rank (from 0), in the order of letters, of so many of each letter."""
    counts, out = dict(sorted(counts.items())), []
    left = sum(counts.values())
    ways = math.factorial(left)
    for n in counts.values():
        ways //= math.factorial(n)
    for left in range(left, 0, -1):
        for x, n in counts.items():
            begin = ways * n // left  # those that go on with x
            if rank < begin:
                break
            rank -= begin
        out.append(x)
        counts[x] -= 1
        ways = begin
    return "".join(out)


def strict_gc_sequences(spark: SparkSession, n: int, length: int, gc: float, seed: int | None = 1) -> DataFrame:
    """id, seq: sequences of which each has exactly the GC content, rounded to pairs of bases: as many G as C and, but for an odd A, A as T.

    Sequence i is a permutation by its rank, drawn evenly from i and the seed, or, without a seed, the i-th one; so any task makes any of them.
    """
    half = length // 2
    strong = math.floor(half * gc + 0.5)
    counts = {"A": half - strong + length % 2, "C": strong, "G": strong, "T": half - strong}
    ways = math.factorial(length) // math.prod(map(math.factorial, counts.values()))

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ranks = (int(i) % ways if seed is None else random.Random(f"{seed}:{i}").randrange(ways) for i in part["id"])
            yield pd.DataFrame({"id": part["id"], "seq": [permutation(counts, r) for r in ranks]})

    return spark.range(n).mapInPandas(make, "id long, seq string")


def fitted_frequencies(rows: DataFrame, k: int) -> dict[str, float]:
    """Frequencies of the k-mers of sequences; at most 4^k rows reach the driver."""
    from .kmers import kmer_counts

    got = {r["kmer"]: r["n"] for r in kmer_counts(rows, k).collect()}
    total = sum(got.values()) or 1
    return {m: n / total for m, n in got.items()}


def shuffle_sequences(rows: DataFrame, copies: int = 1, dinucleotides: bool = False, seed: int = 1) -> DataFrame:
    """contig, copy, seq: letters shuffled, or, keeping every pair of neighbours as frequent as it is, a random walk over all its pairs."""

    def walk(seq: str, rng: np.random.Generator) -> str:
        if len(seq) < 3:
            return seq
        letters = sorted(set(seq))
        edges: dict[str, list[str]] = {x: [] for x in letters}
        for x, y in zip(seq, seq[1:], strict=False):
            edges[x].append(y)
        # A last exit per letter, such that all lead to the final letter, makes every shuffle of the others a walk that ends there.
        last = seq[-1]
        while True:
            exits = {x: edges[x][rng.integers(len(edges[x]))] for x in letters if x != last and edges[x]}

            def leads(x: str) -> bool:
                for _ in letters:
                    if x == last:
                        return True
                    x = exits.get(x, last)
                return x == last

            if all(map(leads, exits)):
                break
        for x in letters:
            rest = list(edges[x])
            if x in exits:
                rest.remove(exits[x])
            rest = [rest[i] for i in rng.permutation(len(rest))]
            edges[x] = rest + ([exits[x]] if x in exits else [])
        at, out, used = seq[0], [seq[0]], dict.fromkeys(letters, 0)
        while used[at] < len(edges[at]):
            used[at] += 1
            at = edges[at][used[at] - 1]
            out.append(at)
        return "".join(out)

    def shuffled(seq: str, rng: np.random.Generator) -> str:
        """Letters are numbers, of a byte each where that is enough."""
        code, kind = ("ascii", np.uint8) if seq.isascii() else ("utf-32-le", np.uint32)
        return np.frombuffer(seq.encode(code), kind)[rng.permutation(len(seq))].tobytes().decode(code)

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sequence at a time, which gives all its copies; results go on after about a million letters."""
        out, held = ([], [], []), 0
        for part in parts:
            for contig, seq, u in zip(*map(part.column, ("contig", "seq", "_u")), strict=True):
                contig, seq, rng = contig.as_py(), seq.as_py(), np.random.default_rng(abs(u.as_py()))
                for copy in range(copies):
                    new = None if seq is None else (walk if dinucleotides else shuffled)(seq, rng)
                    for column, value in zip(out, (contig, copy, new), strict=True):
                        column.append(value)
                    held += len(new or "")
                    if held >= 1 << 20:
                        yield batch_of(out)
                        out, held = ([], [], []), 0
        if out[0]:
            yield batch_of(out)

    def batch_of(out: tuple[list, list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.string()), strict=True)], ["contig", "copy", "seq"])

    # Sequences are dealt out: a file may have one row group of millions of them, which one task would read and shuffle.
    each = rows.select("contig", "seq", F.xxhash64("contig", F.lit(seed)).alias("_u")).repartition("contig")
    return each.mapInArrow(make, "contig long, copy int, seq string")


def softmin_probabilities(rows: DataFrame, temperature: float) -> DataFrame:
    """rows (id, option, energy) with prob proportional to exp((least energy - energy) / temperature)."""
    w = W.partitionBy("id")
    e = F.exp((F.min("energy").over(w) - F.col("energy")) / temperature)
    return rows.withColumn("_e", e).withColumn("prob", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def softmin_choice(rows: DataFrame, temperature: float, seed: int = 1) -> DataFrame:
    """One option of each id, with its probability."""
    p = softmin_probabilities(rows, temperature)
    upto = F.sum("prob").over(W.partitionBy("id").orderBy("option").rowsBetween(W.unboundedPreceding, 0))
    p = p.withColumn("_c", upto).withColumn("_u", draw(seed, "id"))
    last = F.max("option")
    return p.groupBy("id").agg(F.coalesce(F.min(F.when(F.col("_c") >= F.col("_u"), F.col("option"))), last).alias("option"))
