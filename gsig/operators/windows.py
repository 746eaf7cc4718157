"""Position windows and bins: rows of contig, pos, value with one row per position, or of contig, seq."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import physical

KEYS = ["contig"]


def chunks(rows: DataFrame, size: int, stride: int, offset: int = 0, chunk: int = 1 << 16, *, keep: list[str] = ()) -> DataFrame:
    """contig, at, part: pieces of sequences that together hold every window of a size, each once; windows start at `offset` and every `stride`.

    keep: more columns of rows, or length, the sequence's.
    """
    rows = rows.withColumn("length", F.length("seq")) if "length" in keep else rows
    return _cut(rows.filter(F.length("seq") >= size + offset), size, stride, offset, chunk, keep)


def _cut(rows: DataFrame, size: int, stride: int, offset: int = 0, chunk: int = 1 << 16, keep: list[str] = ()) -> DataFrame:
    """As chunks; sequences shorter than a window are a piece, too."""
    step = max(stride, chunk // stride * stride)
    each = rows.select("contig", *keep, "seq", F.explode(F.sequence(F.lit(offset), F.greatest(F.length("seq") - size, F.lit(offset)), F.lit(step))).alias("at"))
    return each.select("contig", *keep, "at", F.substring("seq", F.col("at") + 1, F.lit(step + size - 1)).alias("part"))


@dataclass
class Joined:
    """The bases of some parts, one after another, as bytes; of each base its part's row, and its place there."""

    rows: pd.DataFrame
    bases: np.ndarray
    lengths: np.ndarray

    def __post_init__(self):
        self.row = np.repeat(np.arange(len(self.rows)), self.lengths)
        self.place = np.arange(len(self.bases)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def starts(self, size: int, stride: int = 1) -> np.ndarray:
        """Where windows of a size start that lie in one part, every `stride` places of it."""
        fits = self.place <= self.lengths[self.row] - size
        return np.flatnonzero(fits if stride == 1 else fits & (self.place % stride == 0))

    def each(self, column: str, at: np.ndarray) -> np.ndarray:
        """A column of the parts' rows at these bases."""
        return self.rows[column].to_numpy()[self.row[at]]


def joined(batches: Iterator[pd.DataFrame], most: int = 1 << 19) -> Iterator[Joined]:
    """Some parts at a time, of about `most` bases in all, so what is made of them stays as small, however many rows a batch has."""
    for batch in batches:
        lengths = batch["part"].str.len().to_numpy(np.int64)
        group = np.cumsum(lengths) // most
        for i, j in pairwise([0, *(np.flatnonzero(np.diff(group)) + 1), len(batch)]):
            if j > i:
                yield Joined(batch.iloc[i:j], np.frombuffer("".join(batch["part"].iloc[i:j]).encode("ascii", "replace"), np.uint8), lengths[i:j])


def over_parts(parts: DataFrame, made: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, most: int = 1 << 19) -> DataFrame:
    """As mapInPandas over rows with a part. Of a batch, rows of about `most` bases at a time become objects, so it is held once, as bytes."""

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            group = np.cumsum(pc.fill_null(pc.binary_length(batch.column("part")), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
            for i, j in pairwise([0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]):
                if j > i:
                    yield batch.slice(i, j - i).to_pandas()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in made(small(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return parts.mapInArrow(each, schema)


def sliding_windows(rows: DataFrame, size: int, stride: int = 1, chunk: int = 256) -> DataFrame:
    """contig, start, seq: all windows of a size, every `stride` positions.

    Contigs are cut in chunks with halo; small ones, as finding a character takes time that grows with its place.
    """
    step = max(stride, chunk // stride * stride)
    chunks = rows.filter(F.length("seq") >= size).select("contig", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - size, F.lit(step))).alias("at"))
    chunks = chunks.select("contig", "at", F.substring("seq", F.col("at") + 1, F.lit(step + size - 1)).alias("part"))
    starts = F.sequence(F.lit(0), F.least(F.length("part") - size, F.lit(step - 1)), F.lit(stride))
    each = chunks.select("contig", "at", "part", F.explode(starts).alias("i"))
    return each.select("contig", (F.col("at") + F.col("i")).alias("start"), F.substring("part", F.col("i") + 1, F.lit(size)).alias("seq"))


def chunk_regions(rows: DataFrame, size: int) -> DataFrame:
    """contig, win, sum over each full window of `size` positions; an incomplete tail is dropped."""
    return rows.groupBy("contig", F.floor(F.col("pos") / size).alias("win")).agg(F.sum("value").alias("value"), F.count("*").alias("n")).filter(F.col("n") == size).drop("n")


def valid_windows(rows: DataFrame, size: int) -> DataFrame:
    """contig, start of windows without unknown bases (N). Unknown bases are counted along each chunk; only valid starts become rows."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in joined(batches):
            unknown = np.r_[0, np.cumsum(some.bases == ord("N"))]
            at = some.starts(size)
            at = at[unknown[at + size] == unknown[at]]
            yield pd.DataFrame({"contig": some.each("contig", at), "start": some.each("at", at) + some.place[at]})

    return over_parts(chunks(rows, size, 1), found, f"contig {rows.schema['contig'].dataType.simpleString()}, start int")


def valid_centres(rows: DataFrame, size: int, labels: DataFrame, exclude: DataFrame) -> DataFrame:
    """contig, pos: centres of valid windows whose label is not zero and that are not excluded."""
    centres = valid_windows(rows, size).select("contig", (F.col("start") + size // 2).alias("pos"))
    return centres.join(labels.filter("value <> 0").select("contig", "pos"), ["contig", "pos"], "left_semi").join(exclude, ["contig", "pos"], "left_anti")


def adapt_to_window(rows: DataFrame, lengths: DataFrame, size: int, anchor: str = "center") -> DataFrame:
    """Positions that anchor a whole window, counted from the first: centre, start or end of it."""
    first = {"center": size // 2, "start": 0, "end": size - 1}[anchor]
    j = rows.join(lengths.select("contig", "length"), "contig")
    last = F.col("length") - size + first
    return j.filter((F.col("pos") >= first) & (F.col("pos") <= last)).withColumn("pos", F.col("pos") - first).drop("length")


def moving_sum(rows: DataFrame, n: int, lengths: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Sums over n positions from each one on; the n-1 last of a contig are dropped."""
    if n <= 0:
        raise ValueError("n must be positive")
    out = physical.frame(rows, keys, 0, n - 1, {"value": lambda w: F.sum("value").over(w)})
    lengths = rows.groupBy(*keys).agg((F.max("pos") + 1).alias("length")) if lengths is None else lengths
    return out.join(lengths, keys).filter(F.col("pos") <= F.col("length") - n).drop("length")


def moving_average(rows: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    """Means over n positions about each one, n//2 below and (n-1)//2 above; positions beyond the ends count as 0."""
    return physical.frame(rows, keys, n // 2, (n - 1) // 2, {"value": lambda w: F.sum("value").over(w) / n})


def kernel(kind: str, size: int, sigma: float | None = None) -> list[float]:
    """Weights of a flat, gaussian or triangle kernel, summing to 1. A triangle is 0 at both ends, so it needs 3 places at least."""
    mid = (size - 1) / 2
    if kind == "flat":
        w = [1.0] * size
    elif kind == "gaussian":
        w = [math.exp(-0.5 * ((i - mid) / sigma) ** 2) for i in range(size)]
    elif kind == "triangle":
        w = [float(min(i, size - 1 - i)) for i in range(size)]
    else:
        raise ValueError(kind)
    if not sum(w):
        raise ValueError(f"a {kind} kernel of {size} places has no weight")
    return [x / sum(w) for x in w]


def smooth(rows: DataFrame, weights: list[float], keys: list[str] = KEYS, mode: str = "same") -> DataFrame:
    """Convolution with a kernel: flat kernels are a frame, others a weighted sum over a sorted array of the frame.

    same: each position; valid: positions whose whole kernel lies inside; full is same with rows added beyond the ends.
    """
    n = len(weights)
    below, above = n // 2, (n - 1) // 2
    if mode == "full":
        ends = rows.groupBy(*keys).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
        extra = ends.select(*keys, F.explode(F.concat(F.sequence(F.col("lo") - above, F.col("lo") - 1), F.sequence(F.col("hi") + 1, F.col("hi") + below))).alias("pos"), F.lit(0.0).alias("value")) if n > 2 else None
        rows = rows.select(*keys, "pos", "value").unionByName(extra) if extra is not None else rows
    if len(set(weights)) == 1:
        out = physical.frame(rows, keys, below, above, {"value": lambda w: F.sum("value").over(w) * weights[0], "_n": lambda w: F.count("*").over(w)})
    else:
        table = F.array(*map(F.lit, weights))
        pairs = lambda w: F.collect_list(F.struct("pos", "value")).over(w)
        # Offset of a row from the centre, mirrored, is its place in the kernel.
        out = physical.frame(rows, keys, below, above, {"_near": pairs, "_n": lambda w: F.count("*").over(w)})
        out = out.withColumn("value", F.aggregate("_near", F.lit(0.0), lambda s, x: s + x["value"] * F.element_at(table, (F.col("pos") - x["pos"] + above + 1).cast("int")))).drop("_near")
    return (out.filter(F.col("_n") == n) if mode == "valid" else out).drop("_n")


def nan_smooth(rows: DataFrame, n: int, keys: list[str] = KEYS, pad_masked: bool = False, weights: list[float] | None = None) -> DataFrame:
    """Smoothing where missing values do not count, flat or with the n weights of a kernel, which sum to 1.

    Flat: null only without any valid value in the frame; weighted: null if more than (n - 1) / n of the weight is missing.
    Positions beyond the ends count as valid zeros, or, with pad_masked, as missing.
    """
    if weights is not None:
        return _nan_smooth_weighted(rows, weights, keys, pad_masked)
    below, above = n // 2, (n - 1) // 2
    valid = F.col("value").isNotNull() & ~F.isnan("value")
    clean = rows.withColumn("_ok", valid.cast("int")).withColumn("value", F.when(valid, F.col("value")).otherwise(0.0))
    out = physical.frame(clean, keys, below, above, {"_s": lambda w: F.sum("value").over(w), "_k": lambda w: F.sum("_ok").over(w)})
    if not pad_masked:
        ends = rows.groupBy(*keys).agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
        out = out.join(ends, keys)
        outside = F.greatest(F.lit(0), F.col("_lo") - (F.col("pos") - below)) + F.greatest(F.lit(0), F.col("pos") + above - F.col("_hi"))
        out = out.withColumn("_k", F.col("_k") + outside).drop("_lo", "_hi")
    return out.withColumn("value", F.when(F.col("_k") > 0, F.col("_s") / F.col("_k"))).drop("_s", "_k", "_ok")


def _nan_smooth_weighted(rows: DataFrame, weights: list[float], keys: list[str], pad_masked: bool) -> DataFrame:
    n = len(weights)
    below, above = n // 2, (n - 1) // 2
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    near = F.struct("pos", F.when(finite, F.col("value")).alias("v"))
    out = physical.frame(rows, keys, below, above, {"_near": lambda w: F.collect_list(near).over(w)})
    table = F.array(*map(F.lit, weights))
    place = lambda x: F.element_at(table, (F.col("pos") - x["pos"] + above + 1).cast("int"))
    total = lambda f: F.aggregate("_near", F.lit(0.0), lambda s, x: s + f(x))
    out = out.withColumn("_s", total(lambda x: F.coalesce(x["v"] * place(x), F.lit(0.0))))
    valid = total(lambda x: F.when(x["v"].isNotNull(), place(x)).otherwise(0.0))
    missing = 1 - valid if pad_masked else total(lambda x: F.when(x["v"].isNull(), place(x)).otherwise(0.0))
    out = out.withColumn("_missing", missing)
    enough = (F.col("_missing") <= (n - 1) / n + 1e-9) & (F.col("_missing") < 1)
    return out.withColumn("value", F.when(enough, F.col("_s") / (1 - F.col("_missing")))).drop("_near", "_s", "_missing")


def windows_holding(rows: DataFrame, size: int, stride: int, bases: str = "GC") -> DataFrame:
    """contig, start, n: how many bases of the windows of a size, every `stride` positions, are among these; counted along chunks."""
    wanted = np.zeros(256, bool)
    wanted[np.frombuffer(bases.encode(), np.uint8)] = True

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in joined(batches):
            upto, at = np.r_[0, np.cumsum(wanted[some.bases])], some.starts(size, stride)
            yield pd.DataFrame({"contig": some.each("contig", at), "start": some.each("at", at) + some.place[at], "n": upto[at + size] - upto[at]})

    return over_parts(chunks(rows, size, stride), counted, f"contig {rows.schema['contig'].dataType.simpleString()}, start int, n int")


def window_blocks(rows: DataFrame, size: int, length: int, stride: int, inner: int = 1) -> DataFrame:
    """contig, block, start, windows: blocks that begin every `stride` positions, each the `length` / `inner` windows of a size that begin
    every `inner` positions from there on. Blocks that don't fit whole are left out."""
    if length % inner:
        raise ValueError("inner has to divide length")
    spans = sliding_windows(rows, size + length - inner, stride, chunk=max(256, length))
    windows = F.transform(F.sequence(F.lit(0), F.lit(length - inner), F.lit(inner)), lambda i: F.substring("seq", i + 1, F.lit(size)))
    return spans.select("contig", F.floor(F.col("start") / stride).alias("block"), "start", windows.alias("windows"))


def _shares(some: Joined, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of n bases start (a shorter part is one), and their GC; not a number without known bases."""
    code = np.zeros(256, np.int8)
    code[np.frombuffer(b"ACGT", np.uint8)] = (1, 3, 3, 1)
    x, fit = code[some.bases], np.minimum(some.lengths, n)
    at = np.flatnonzero(some.place <= (some.lengths - fit)[some.row])
    until = at + fit[some.row[at]]
    known, gc = ((c := np.r_[0, np.cumsum(f)])[until] - c[at] for f in (x > 0, x == 3))
    return at, np.divide(gc, known, out=np.full(len(gc), np.nan), where=known > 0)


def sliding_gc(rows: DataFrame, n: int) -> DataFrame:
    """contig, start, gc over windows of n bases (at most the contig's length); null without known bases.

    Bases are counted along chunks of sequences, and a window is the difference of two counts.
    """

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in joined(batches):
            at, gc = _shares(some, n)
            yield pd.DataFrame({"contig": some.each("contig", at), "start": some.each("at", at) + some.place[at], "gc": gc})

    each = over_parts(_cut(rows.filter(F.length("seq") > 0), n, 1), windows, f"contig {rows.schema['contig'].dataType.simpleString()}, start int, gc double")
    return each.withColumn("gc", F.when(~F.isnan("gc"), F.col("gc")))


def gc_totals(rows: DataFrame, n: int, value: Callable[[np.ndarray], np.ndarray] = lambda gc: gc) -> DataFrame:
    """contig, n, known, total, low, high: of the windows of `sliding_gc` how many there are and how many have a GC; sum, least and most of
    a function of it. Windows are summed where they are made, so none is a row."""

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in joined(batches):
            at, gc = _shares(some, n)
            row, v, parts = some.row[at], value(gc), len(some.rows)
            ok = ~np.isnan(gc)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            least, most = (f.reduceat(np.where(ok, v, fill), first) for f, fill in ((np.minimum, np.inf), (np.maximum, -np.inf)))
            known = np.bincount(row[ok], minlength=parts)
            yield pd.DataFrame({"contig": some.rows["contig"].to_numpy(), "n": np.bincount(row, minlength=parts), "known": known, "total": np.bincount(row[ok], v[ok], parts), "low": least, "high": most})

    parts = _cut(rows.filter(F.length("seq") > 0), n, 1).select("contig", "part").mapInPandas(totals, f"contig {rows.schema['contig'].dataType.simpleString()}, n long, known long, total double, low double, high double")
    seen = lambda c: F.when(F.col("known") > 0, F.col(c))
    return parts.groupBy("contig").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum(seen("total")).alias("total"), F.min(seen("low")).alias("low"), F.max(seen("high")).alias("high"))


def gc_energy(rows: DataFrame, n: int, target: float, tolerance: float = 0.0) -> DataFrame:
    """Root mean square distance of sliding GC from a target; distances within the tolerance are 0."""

    def squared(gc: np.ndarray) -> np.ndarray:
        d = np.abs(gc - target)
        return np.where(d < tolerance, 0.0, d) ** 2

    return gc_totals(rows, n, squared).select("contig", F.sqrt(F.when(F.col("known") > 0, F.col("total") / F.col("known"))).alias("energy"))


def bin_values(rows: DataFrame, size: int, columns: dict[str, Column], keys: list[str] = KEYS) -> DataFrame:
    """Aggregates per `size` positions; columns: name -> aggregate. The last bin may be short."""
    if size <= 0:
        raise ValueError("size must be positive")
    return rows.groupBy(*keys, F.floor(F.col("pos") / size).alias("bin")).agg(*(c.alias(k) for k, c in columns.items()))


def binned_counts(rows: DataFrame, size: int, contigs: list[str] | int | None = None) -> DataFrame:
    """Totals per bin over all contigs, those listed, the first n, or all but the last -n."""
    if isinstance(contigs, int):
        names = rows.select("contig").distinct().withColumn("_r", F.row_number().over(W.orderBy("contig"))).withColumn("_n", F.count("*").over(W.partitionBy()))
        names = names.filter(F.col("_r") <= (F.lit(contigs) if contigs >= 0 else F.col("_n") + contigs))
        rows = rows.join(names.select("contig"), "contig", "left_semi")
    elif contigs is not None:
        rows = rows.filter(F.col("contig").isin(contigs))
    return bin_values(rows, size, {"value": F.sum("value")})


def grid(lengths: DataFrame, size: int) -> DataFrame:
    """contig, bin: every bin of every contig, the last one short."""
    return lengths.filter("length > 0").select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / size) - 1)).alias("bin"))


def midpoint_counts(fragments: DataFrame, lengths: DataFrame, size: int, max_length: int | None = None) -> DataFrame:
    """contig, bin, n: fragments by the bin of their middle, over all bins, zeros included."""
    if max_length is not None:
        fragments = fragments.filter(F.col("end") - F.col("start") <= max_length)
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    counts = fragments.groupBy("contig", F.floor(mid / size).alias("bin")).agg(F.count("*").alias("n"))
    return grid(lengths, size).join(counts, ["contig", "bin"], "left").select("contig", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def coverage(fragments: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """contig, start, end, depth: runs of equal depth, from +1 where a fragment starts and -1 after its inclusive end.

    Events of a position are summed first; depths and ends of runs come from blocks of positions, so no contig is one task.
    """
    edge = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d"))))
    events = fragments.select(*keys, edge.alias("e")).groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).filter("d <> 0")
    depth = physical.running_sum(events, keys, F.col("d"), "depth")
    runs = physical.beside(depth, keys, ["pos"], "pos", "end", ahead=True)
    return runs.filter("depth > 0").select(*keys, F.col("pos").alias("start"), "end", "depth")


def densify(runs: DataFrame) -> DataFrame:
    """One row per position of runs."""
    return runs.select("contig", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "depth")


def bin_annotation(rows: DataFrame, lengths: DataFrame, size: int, process: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """contig, bin, value over all bins of all contigs, 0 where there is no annotation."""
    rows = rows.transform(process) if process else rows
    return grid(lengths, size).join(bin_values(rows, size, {"value": F.sum("value")}), ["contig", "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def rebin(coarse: DataFrame, fine: DataFrame, ratio: int) -> DataFrame:
    """fine (contig, bin) with the values of a table whose bins are `ratio` times wider; bins beyond fine are trimmed."""
    spread = coarse.withColumn("bin", F.explode(F.sequence(F.col("bin") * ratio, F.col("bin") * ratio + ratio - 1)))
    return fine.select("contig", "bin").join(spread, ["contig", "bin"])
