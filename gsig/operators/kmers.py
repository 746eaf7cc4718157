"""k-mers and composition of windows: rows of contig, seq."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import physical, windows
from .tracks import quantiles


def kmers(rows: DataFrame, k: int, with_n: bool = False) -> DataFrame:
    """contig, start, kmer of every position."""
    out = windows.sliding_windows(rows, k).withColumnRenamed("seq", "kmer")
    return out if with_n else out.filter(~F.col("kmer").contains("N"))


def kmer_of(number: Column, k: int, alphabet: str = "ACGT") -> Column:
    """The k-mer with these digits."""
    n = len(alphabet)
    digit = lambda i: F.substring(F.lit(alphabet), (F.floor(number / n**i) % n + 1).cast("int"), F.lit(1))
    return F.concat(*(digit(i) for i in reversed(range(k))))


def all_kmers(spark: SparkSession, k: int, alphabet: str = "ACGT") -> DataFrame:
    """id, kmer: every k-mer over an alphabet, by the digits of its number."""
    return spark.range(len(alphabet) ** k).select("id", kmer_of(F.col("id"), k, alphabet).alias("kmer"))


def numbers(bases: np.ndarray, k: int, alphabet: str) -> np.ndarray:
    """The number of the k-mer at each place of some bases, as bytes; -1 where it has a character outside the alphabet."""
    base = len(alphabet)
    table = np.full(256, -1, np.int64)
    table[np.frombuffer(alphabet.encode(), np.uint8)] = range(base)
    tok = table[bases]
    n = max(0, len(tok) - k + 1)
    number, known = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        number = number * base + tok[i : i + n]
        known &= tok[i : i + n] >= 0
    return np.where(known, number, -1)


def numbers_in(some: windows.Joined, k: int, alphabet: str) -> np.ndarray:
    """As numbers, for each base of joined parts; -1, too, where a k-mer would leave its part."""
    number = np.full(len(some.bases), -1, np.int64)
    number[: max(0, len(number) - k + 1)] = numbers(some.bases, k, alphabet)
    number[some.place > some.lengths[some.row] - k] = -1
    return number


def letters_of(ids: np.ndarray, k: int, alphabet: str) -> pa.Array:
    """The k-mers of these numbers."""
    digits = ids[:, None] // len(alphabet) ** np.arange(k)[::-1] % len(alphabet)
    data = np.frombuffer(alphabet.encode(), np.uint8)[digits].tobytes()
    return pa.StringArray.from_buffers(len(ids), pa.py_buffer((np.arange(len(ids) + 1) * k).astype(np.int32)), pa.py_buffer(data))


def numbered_counts(rows: DataFrame, k: int, alphabet: str, groups: int = 1) -> DataFrame:
    """id, n: k-mers by number, counted inside each task first; k-mers with a character outside the alphabet don't count.

    With several groups, rows have a group (from 0), and ids of group g are larger by g times the number of all k-mers.
    """
    base = len(alphabet)
    every = base**k * groups
    small = every <= 1 << 20
    keep = ["group"] if groups > 1 else []

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(every if small else 0, np.int64)
        for some in windows.joined(batches):
            number = numbers_in(some, k, alphabet)
            at = np.flatnonzero(number >= 0)
            number = number[at] + some.each("group", at) * base**k if keep else number[at]
            if small:
                total += np.bincount(number, minlength=len(total))
            else:
                ids, times = np.unique(number, return_counts=True)
                yield pd.DataFrame({"id": ids, "n": times})
        if small:
            yield pd.DataFrame({"id": np.flatnonzero(total), "n": total[total > 0]})

    return windows.over_parts(windows.chunks(rows, k, 1, keep=keep).select(*keep, "part"), counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def kmer_counts(rows: DataFrame, k: int, with_n: bool = False) -> DataFrame:
    """kmer, n over all sequences, absent k-mers included, sorted."""
    alphabet = "ACGTN" if with_n else "ACGT"
    n = numbered_counts(rows, k, alphabet)
    return all_kmers(rows.sparkSession, k, alphabet).join(n, "id", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n")).orderBy("kmer")


def contrast_counts(rows: DataFrame, k: int, high: Column, low: Column) -> DataFrame:
    """kmer, high, low: how often each k-mer that occurs is in sequences of either kind; no occurrence is a row."""
    kind = F.when(high, 1).when(low, 2).otherwise(0)
    n = numbered_counts(rows.withColumn("group", kind), k, "ACGT", 3)
    of = lambda g: F.sum(F.when(F.floor(F.col("id") / 4**k) == g, F.col("n")).otherwise(0))
    return n.groupBy((F.col("id") % 4**k).alias("id")).agg(of(1).alias("high"), of(2).alias("low")).select(kmer_of(F.col("id"), k).alias("kmer"), "high", "low")


def kmer_counts_by_seq(rows: DataFrame, k: int, with_n: bool = False) -> DataFrame:
    """contig, kmer, n for the k-mers of each sequence that occur; counted as numbers in chunks first."""
    alphabet = "ACGTN" if with_n else "ACGT"

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in windows.joined(batches):
            number = numbers_in(some, k, alphabet)
            at = np.flatnonzero(number >= 0)
            key, times = np.unique(some.row[at] * len(alphabet) ** k + number[at], return_counts=True)
            yield pd.DataFrame({"contig": some.rows["contig"].to_numpy()[key // len(alphabet) ** k], "id": key % len(alphabet) ** k, "n": times})

    found = windows.over_parts(windows.chunks(rows, k, 1).select("contig", "part"), counted, f"contig {rows.schema['contig'].dataType.simpleString()}, id long, n long")
    return found.groupBy("contig", "id").agg(F.sum("n").alias("n")).select("contig", kmer_of(F.col("id"), k, alphabet).alias("kmer"), "n")


def sliding_kmer_runs(rows: DataFrame, k: int, size: int) -> DataFrame:
    """contig, kmer, n, start, end: the longest runs of starts of windows of `size` bases that hold the k-mer n times.

    A k-mer at p is in the windows that start at p + k - size .. p; it enters at one and leaves after the other, so the counts
    are running sums of entries and exits. These are taken inside chunks of starts, with the bases that their windows reach; only runs that
    touch a border of chunks are joined to those beyond it.
    """

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for contig, at, length, text in zip(*(part[c] for c in ("contig", "at", "length", "part")), strict=True):
                number, last = numbers(np.frombuffer(text.encode("ascii", "replace"), np.uint8), k, "ACGT"), len(text) - size
                p = np.flatnonzero(number >= 0)
                enter, leave = np.maximum(0, p + k - size), np.minimum(p, last) + 1
                p, enter, leave = (x[enter <= last] for x in (p, enter, leave))
                code, place, step = np.r_[number[p], number[p]], np.r_[enter, leave], np.repeat([1, -1], len(p))
                key, first = np.unique(code * (last + 2) + place, return_inverse=True)
                moves = np.bincount(first, weights=step, minlength=len(key)).astype(np.int64)
                key, moves = key[moves != 0], moves[moves != 0]
                n = np.cumsum(moves)
                runs = np.flatnonzero(n > 0)
                start, end = key[runs] % (last + 2), key[runs + 1] % (last + 2)
                edge = ((start == 0) & (at > 0)) | ((end == last + 1) & (at + len(text) < length))
                yield pd.DataFrame({"contig": contig, "id": key[runs] // (last + 2), "n": n[runs], "start": start + at, "end": end + at, "edge": edge})

    schema = f"contig {rows.schema['contig'].dataType.simpleString()}, id long, n long, start long, end long, edge boolean"
    parts = windows.chunks(rows, size, 1, keep=["length"]).select("contig", "at", "length", "part")
    runs = windows.over_parts(parts, counted, schema)
    w = W.partitionBy("contig", "id").orderBy("start")
    new = ~F.coalesce((F.lag("end").over(w) == F.col("start")) & (F.lag("n").over(w) == F.col("n")), F.lit(False))
    at_edges = runs.filter("edge").withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    at_edges = at_edges.groupBy("contig", "id", "_run", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    every = runs.filter("not edge").select("contig", "id", "n", "start", "end").unionByName(at_edges.drop("_run"))
    return every.select("contig", kmer_of(F.col("id"), k).alias("kmer"), "n", "start", "end")


def sliding_kmer_counts(rows: DataFrame, k: int, size: int) -> DataFrame:
    """contig, kmer, n, start: one row for every window in which a k-mer occurs."""
    return sliding_kmer_runs(rows, k, size).select("contig", "kmer", "n", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("start"))


def neighbours(each: np.ndarray, n: int) -> np.ndarray:
    """Sums of every n values in a row, put together from sums of 1, 2, 4 and so on."""
    total, run, width, done = np.zeros(max(0, len(each) - n + 1), each.dtype), each, 1, 0
    while width <= n and len(total):
        if n & width:
            total += run[done : done + len(total)]
            done += width
        run, width = run[:-width] + run[width:], 2 * width
    return total


def sliding_kmer_table(rows: DataFrame, k: int, size: int, with_n: bool = False) -> DataFrame:
    """contig, start, and a column for every k-mer over the alphabet: its count in the window of `size` bases. Every window is a row.

    Each k-mer is counted along chunks by itself, so k is small. Counts leave Python side by side in numbers of 64 bits, eight in one where
    a byte holds them, as each value of a batch costs Spark more than the counting; only then they become columns.
    """
    alphabet = "ACGTN" if with_n else "ACGT"
    names, reach = ["".join(x) for x in product(alphabet, repeat=k)], size - k + 1
    if reach < 1:
        raise ValueError("a window has to hold a k-mer")
    wide = np.min_scalar_type(reach).itemsize
    each = 8 // wide
    whole = -(-len(names) // each)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in windows.joined(batches):
            number, at = numbers_in(some, k, alphabet).astype(np.int32), some.starts(size)
            counts = np.zeros((len(at), whole * each), f"<u{wide}")
            for i in range(len(names)):
                counts[:, i] = neighbours((number == i).astype(counts.dtype), reach)[at]
            held = {f"_{i}": column for i, column in enumerate(counts.view("<i8").T)}
            yield pd.DataFrame({"contig": some.each("contig", at), "start": some.each("at", at) + some.place[at], **held})

    schema = f"contig {rows.schema['contig'].dataType.simpleString()}, start int, {', '.join(f'_{i} long' for i in range(whole))}"
    packed = windows.over_parts(windows.chunks(rows, size, 1).select("contig", "at", "part"), counted, schema, 1 << 17)
    count = lambda i: F.shiftright(f"_{i // each}", i % each * wide * 8).bitwiseAND(F.lit((1 << wide * 8) - 1).cast("long")).cast("int")
    return packed.select("contig", "start", *(count(i).alias(m) for i, m in enumerate(names)))


def sliding_kmer_totals(rows: DataFrame, k: int, size: int) -> DataFrame:
    """contig, kmer, total, squares: sums of a k-mer's counts, and of their squares, over all windows of `size` bases.

    A window counts in total once for each occurrence in it, and in squares once for each pair of occurrences. Occurrences that a window
    can hold together are at most size - k apart, so they are compared at each such distance along chunks; no run or window is a row.
    """
    base = 4**k

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in windows.joined(batches):
            number = numbers_in(some, k, "ACGT")
            sums = []
            ids, which = np.unique(np.where(number >= 0, some.row * base + number, -1), return_inverse=True)
            for d in range(min(size - k, len(number) - 1) + 1):
                p = np.flatnonzero((number[d:] == number[: len(number) - d]) & (number[d:] >= 0))
                p = p[some.row[p] == some.row[p + d]]
                held = np.minimum(some.place[p], (some.lengths - size)[some.row[p]]) + 1 - np.maximum(0, some.place[p] + d + k - size)
                sums.append(np.bincount(which[p], np.maximum(held, 0), len(ids)))
            own = ids >= 0
            total, squares = sums[0][own], (sums[0] + 2 * sum(sums[1:]))[own]
            yield pd.DataFrame({"contig": some.rows["contig"].to_numpy()[ids[own] // base], "id": ids[own] % base, "total": total.astype(np.int64), "squares": squares.astype(np.int64)})

    parts = windows.over_parts(windows.chunks(rows, size, 1).select("contig", "part"), summed, f"contig {rows.schema['contig'].dataType.simpleString()}, id long, total long, squares long")
    return parts.groupBy("contig", "id").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares")).select("contig", kmer_of(F.col("id"), k).alias("kmer"), "total", "squares")


def expected_kmers(bases: DataFrame, k: int) -> DataFrame:
    """kmer, freq: products of base frequencies; the base table has one row per base."""
    one = bases.select(F.col("base").alias("kmer"), "freq")
    extra = F.array_sort(F.collect_list(F.struct("base", "freq")))
    table = bases.agg(extra.alias("_b"))
    grow = lambda df: df.withColumn("_x", F.explode("_b")).select(F.concat("kmer", "_x.base").alias("kmer"), (F.col("freq") * F.col("_x.freq")).alias("freq"), "_b")
    return reduce(lambda df, _: grow(df), range(k - 1), one.join(table)).select("kmer", "freq")


def window_summary(rows: DataFrame, signal: DataFrame, size: int) -> DataFrame:
    """contig, win, gc, value: GC and mean signal of non-overlapping windows without unknown bases."""
    gc = windows.sliding_windows(rows, size, size).filter(~F.col("seq").contains("N"))
    gc = gc.select("contig", (F.col("start") / size).cast("long").alias("win"), ((F.length("seq") - F.length(F.translate("seq", "GC", ""))).cast("double") / size).alias("gc"))
    mean = signal.groupBy("contig", F.floor(F.col("pos") / size).alias("win")).agg(F.avg("value").alias("value"))
    return gc.join(mean, ["contig", "win"])


def window_kmers(rows: DataFrame, k: int, size: int) -> DataFrame:
    """contig, win, kmers: a map of counts in each non-overlapping window. Chunks hold whole windows, so each is counted in its task."""
    base = 4**k

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in windows.joined(batch.to_pandas() for batch in batches):
            number = numbers_in(some, k, "ACGT")
            at = np.flatnonzero((number >= 0) & (some.place % size <= size - k))
            wide = int(some.lengths.max()) // size + 1
            key, times = np.unique((some.row[at] * wide + some.place[at] // size) * base + number[at], return_counts=True)
            win = key // base
            first = np.flatnonzero(np.diff(win, prepend=-1))
            row, place = win[first] // wide, win[first] % wide
            kmers = pa.MapArray.from_arrays(pa.array(np.r_[first, len(key)], pa.int32()), letters_of(key % base, k, "ACGT"), pa.array(times, pa.int64()))
            contig = pa.array(some.rows["contig"].to_numpy()[row])
            yield pa.RecordBatch.from_arrays([contig, pa.array(some.rows["at"].to_numpy(np.int64)[row] // size + place), kmers], ["contig", "win", "kmers"])

    return windows.chunks(rows, k, size).mapInArrow(counted, f"contig {rows.schema['contig'].dataType.simpleString()}, win long, kmers map<string,long>")


def sliding_summary(rows: DataFrame, signal: DataFrame | Callable[[Column], Column], size: int, undefined: float = 0.38) -> DataFrame:
    """contig, start, gc, value of every window: GC (0.38 where undefined) and the signal at the middle.

    signal: rows of contig, pos, value, or a function from a position to its value; these are taken as windows are made, without a join.
    """
    gc = windows.sliding_gc(rows.filter(F.length("seq") >= size), size).withColumn("gc", F.coalesce("gc", F.lit(undefined)))
    if callable(signal):
        return gc.withColumn("value", signal(F.col("start").cast("long") + size // 2))
    at = signal.select("contig", (F.col("pos") - size // 2).alias("start"), "value")
    return gc.join(at, ["contig", "start"])


def correlation(x: str, y: str) -> Column:
    """corr(x, y), not a number where either is constant; there corr() of Spark divides by zero, which is an error."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread).when(spread == 0, float("nan"))


def kmer_contrast(groups: DataFrame) -> DataFrame:
    """kmer, high, low, percent difference, Yates chi-square of its 2x2 table, p, from rows (kmer, high, low)."""
    total = groups.agg(F.sum("high").alias("_h"), F.sum("low").alias("_l"))
    a, b = F.col("high").cast("double"), F.col("low").cast("double")
    c, d = F.col("_h") - a, F.col("_l") - b
    n = a + b + c + d
    gap = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2)
    chi = n * gap * gap / ((a + b) * (c + d) * (a + c) * (b + d))

    @F.pandas_udf("double")
    def p_of(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v == v else float("nan"))

    rates = (a / F.col("_h"), b / F.col("_l"))
    percent = (rates[0] - rates[1]) / (rates[0] + rates[1]) * 200
    return groups.join(total).select("kmer", "high", "low", percent.alias("percent"), chi.alias("chi2")).withColumn("p", p_of("chi2"))


def global_chi2(groups: DataFrame) -> DataFrame:
    """chi2, df of the whole table of k-mers by group."""
    total = groups.agg(F.sum("high").alias("_h"), F.sum("low").alias("_l"))
    s = (F.col("high") + F.col("low")) / (F.col("_h") + F.col("_l"))
    part = F.pow(F.col("high") - s * F.col("_h"), 2.0) / (s * F.col("_h")) + F.pow(F.col("low") - s * F.col("_l"), 2.0) / (s * F.col("_l"))
    return groups.join(total).agg(F.sum(part).alias("chi2"), (F.count("*") - 1).alias("df"))


#: The order in which dinucleotides are shown; the first eight join a strong and a weak base, the last eight two alike.
DINUCLEOTIDES = "AC GT CA TG AG CT GA TC AA TT AT TA CC GG CG GC".split()


def dinucleotide_order(rows: DataFrame) -> DataFrame:
    """rows (kmer, ...) with place in the order (from 1) and kind: alt for its first half, same for the second; other k-mers go."""
    place = F.array_position(F.array(*map(F.lit, DINUCLEOTIDES)), F.col("kmer"))
    kind = F.when(F.col("place") <= len(DINUCLEOTIDES) // 2, "alt").otherwise("same")
    return rows.withColumn("place", place).filter("place > 0").withColumn("kind", kind).orderBy("place")


def gc_strata(rows: DataFrame, parts: int, least: int) -> DataFrame:
    """rows of each GC value that are among its lowest or highest n / parts, by value; GC values with few rows are dropped.

    Ranks come from blocks cut from the data, so one GC value may hold all rows.
    """
    ranked = physical.ranked(rows, ["gc"], ["value", "id"]).filter(F.col("_all") >= least)
    k = F.floor(F.col("_all") / parts)
    group = F.when(F.col("_r") < k, "low").when(F.col("_r") >= F.col("_all") - k, "high")
    return ranked.withColumn("group", group).filter("group is not null").drop("_all", "_r")


def terciles(rows: DataFrame) -> DataFrame:
    """rows with group: low, mid or high by value among those of their GC, in thirds of which the first may be one larger."""
    ranked = physical.ranked(rows, ["gc"], ["value", "id"])
    third, more = F.floor(F.col("_all") / 3), F.col("_all") % 3
    first, second = third + (more > 0).cast("int"), third * 2 + more
    group = F.when(F.col("_r") < first, "low").when(F.col("_r") < second, "mid").otherwise("high")
    return ranked.withColumn("group", group).drop("_all", "_r")


def gc_bin(gc: Column, width: float = 0.05) -> Column:
    """The centre of the bin of `width` about its multiples."""
    return F.floor((gc + width / 2) / width) * width


def gc_envelope(rows: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    return quantiles(rows, [low, high], ["gc"]).withColumnsRenamed({"q0": "low", "q1": "high"})
