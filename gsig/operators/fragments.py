"""Alignments to fragments: rows of qname, flag, contig, start, end, mapq, is_reverse, tlen (0-based, half-open)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def from_alignments(rows: DataFrame, paired: bool = True, length: int | None = None, most: int | None = None, least_mapq: int = 0) -> DataFrame:
    """contig, start, end: one fragment per leftmost mate, or a fixed length from the start of single reads."""
    rows = rows.filter(F.col("mapq") >= least_mapq)
    if paired:
        rows = rows.filter(F.col("tlen") > 0)
        rows = rows.filter(F.col("tlen") <= most) if most is not None else rows
        return rows.select("contig", "start", (F.col("start") + F.col("tlen")).alias("end"))
    return rows.select("contig", "start", (F.col("start") + length).alias("end"))


def rejected(rows: DataFrame, most: int, least_mapq: int) -> DataFrame:
    kept = (F.col("tlen") > 0) & (F.col("tlen") <= most) & (F.col("mapq") >= least_mapq)
    return rows.agg(F.count_if(~kept).alias("rejected"), F.count("*").alias("total"))


def pair_mates(rows: DataFrame) -> DataFrame:
    """qname and the two mates, the forward one first; names with other than one of each are dropped."""
    g = rows.groupBy("qname", "contig").agg(F.count_if(~F.col("is_reverse")).alias("_f"), F.count_if("is_reverse").alias("_r"), F.min(F.when(~F.col("is_reverse"), F.struct("start", "end"))).alias("_a"), F.min(F.when(F.col("is_reverse"), F.struct("start", "end"))).alias("_b"))
    return g.filter("_f = 1 and _r = 1").select("qname", "contig", F.col("_a.start").alias("start1"), F.col("_a.end").alias("end1"), F.col("_b.start").alias("start2"), F.col("_b.end").alias("end2"))


def ends(rows: DataFrame, start: int, end: int, relative: bool = False, rna: bool = False) -> DataFrame:
    """contig, first, last, strand of fragments inside a region; the strand is that of the second read, turned for RNA."""
    inside = rows.filter((F.col("start") >= start) & (F.col("end") <= end))
    second = F.col("flag").bitwiseAND(128) != 0
    off = start if relative else 0
    return inside.select("contig", (F.col("start") - off).alias("first"), (F.col("end") - 1 - off).alias("last"), F.when(second != F.lit(rna), "-").otherwise("+").alias("strand"))


def fold(pos: Column, origin: int, period: int) -> Column:
    """Position in a repeat of `period` bases that starts at `origin`."""
    return F.pmod(pos - origin, F.lit(period))


def fold_fragments(rows: DataFrame, origin: int, period: int, read_length: int) -> DataFrame:
    """first and last folded; the last is moved up by whole repeats until the fragment is at least a read long."""
    a, b = fold(F.col("start"), origin, period), fold(F.col("end"), origin, period)
    short = F.greatest(F.lit(0), F.ceil((a + read_length - b) / period))
    return rows.select("contig", a.alias("first"), (b + short * period).alias("last"))


def end_histogram(rows: DataFrame, keys: list[str] = ("contig",)) -> DataFrame:
    """keys, pos, starts, ends by position; with keys contig and is_reverse, by strand."""
    edge = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct((F.col("end") - 1).alias("pos"), F.lit(0).alias("s"), F.lit(1).alias("e"))))
    return rows.select(*keys, edge.alias("x")).groupBy(*keys, F.col("x.pos").alias("pos")).agg(F.sum("x.s").alias("starts"), F.sum("x.e").alias("ends"))


def length_histogram(rows: DataFrame) -> DataFrame:
    """length, n, is_mode."""
    h = rows.groupBy((F.col("end") - F.col("start")).alias("length")).agg(F.count("*").alias("n"))
    mode = h.agg(F.max_by("length", F.struct("n", -F.col("length"))).alias("_m"))
    return h.join(mode).select("length", "n", (F.col("length") == F.col("_m")).alias("is_mode"))


def centres(rows: DataFrame, least: int = 130, most: int = 200) -> DataFrame:
    """The middle 2 (even length) or 3 (odd) bases of forward fragments of `least` to `most` bases."""
    n = F.col("tlen")
    kept = rows.filter(~F.col("is_reverse") & n.between(least, most))
    first = F.col("start") + F.floor((n - 2 - n % 2) / 2) + n % 2
    return kept.select("contig", first.alias("start"), (first + 2 + n % 2).alias("end"))


def midpoints(rows: DataFrame, skip_duplicates: bool = False) -> DataFrame:
    """One base at start + tlen // 2 of forward fragments; optionally once for each place."""
    kept = rows.filter(~F.col("is_reverse") & (F.col("tlen") > 0))
    kept = kept.select("contig", "start", "tlen").distinct() if skip_duplicates else kept
    at = F.col("start") + F.floor(F.col("tlen") / 2)
    return kept.select("contig", at.alias("start"), (at + 1).alias("end"))


def on_rna_strand(flag: Column, strand: str) -> Column:
    """Whether a read is of RNA of the forward or the reverse strand, by pair flags (second mates lie on it), or the strand of single reads."""
    bits = lambda mask, value: flag.bitwiseAND(mask) == value
    if strand == "forward":
        return F.when(bits(1, 1), bits(144, 128) | bits(96, 64)).otherwise(bits(16, 16))
    return F.when(bits(1, 1), bits(144, 144) | bits(96, 96)).otherwise(bits(16, 0))


@dataclass
class Blocks:
    """The blocks of some alignments, one after another: start, end, and of each the row of its alignment."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: int

    @classmethod
    def of(cls, lists: pa.ListArray) -> Blocks:
        counts = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        flat = pc.cast(lists.flatten().field("start"), pa.int64()), pc.cast(lists.flatten().field("end"), pa.int64())
        return cls(np.repeat(np.arange(len(lists)), counts), *(x.to_numpy(zero_copy_only=False) for x in flat), len(lists))

    def sizes(self) -> np.ndarray:
        """Bases of each alignment."""
        return np.bincount(self.row, self.end - self.start, self.rows).astype(np.int64)

    def extended(self, flag: np.ndarray, tlen: np.ndarray, next_pos: np.ndarray, length: int, max_pair: int) -> Blocks:
        """With a block more on the 3' side: of proper pairs of at most `max_pair` bases to the mate, of others to `length` bases."""
        borders, n = np.searchsorted(self.row, np.arange(self.rows + 1)), self.sizes()
        some = np.flatnonzero(np.diff(borders))
        first, after = borders[some], borders[some + 1]
        reverse, pair, n = flag[some] & 16 != 0, (flag[some] & 2 != 0) & (np.abs(tlen[some]) <= max_pair), n[some]
        left, right = self.start[first], self.end[after - 1]
        start = np.where(reverse, np.where(pair, next_pos[some], np.maximum(0, left - length + n)), right)
        end = np.where(reverse, left, right + np.where(pair, np.abs(tlen[some]), length) - n)
        more, at = start < end, np.where(reverse, first, after)
        put = lambda old, new: np.insert(old, at[more], new[more])
        return Blocks(put(self.row, some), put(self.start, start), put(self.end, end), self.rows)

    def cut(self, low: np.ndarray, high: np.ndarray) -> Blocks:
        """Bases low .. high - 1 of each alignment, counted over its blocks; blocks that touch are one."""
        total = np.r_[0, np.cumsum(self.end - self.start)]
        done = total[:-1] - total[np.searchsorted(self.row, self.row)]
        start, end = self.start + np.maximum(0, low[self.row] - done), np.minimum(self.end, self.start + high[self.row] - done)
        kept = start < end
        row, start, end = self.row[kept], start[kept], end[kept]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (end[:-1] < start[1:])
        return Blocks(row[new], start[new], end[np.roll(new, -1)], self.rows)


def offsets(rows: DataFrame, first: int, last: int | None = None, strand: str | None = None, extend: int | None = None, max_pair: int = 1000, center: bool = False, rna_strand: str | None = None) -> DataFrame:
    """Bases first..last (1-based, negative from the 3' end) of each alignment, from its 5' end over its blocks; blocks that touch are one.

    rows carry blocks: array<struct<start, end>>. strand keeps '+' or '-', rna_strand "forward" or "reverse" by pair flags. With
    extend, alignments are extended to their fragments first (rows carry tlen and next_pos, too); with center, as many bases as were
    aligned are taken from its middle. Blocks of a batch are worked on as arrays.
    """
    last = first if last is None else last
    reverse = F.col("flag").bitwiseAND(16) != 0
    if strand:
        rows = rows.filter(reverse if strand == "-" else ~reverse)
    if rna_strand:
        rows = rows.filter(on_rna_strand(F.col("flag"), rna_strand))
    more = ["tlen", "next_pos"] if extend is not None else []

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = Blocks.of(batch.column("blocks"))
            flag, *mate = (pc.fill_null(pc.cast(batch.column(c), pa.int64()), 0).to_numpy(zero_copy_only=False) for c in ("flag", *more))
            aligned = blocks.sizes()
            if extend is not None:
                blocks = blocks.extended(flag, *mate, extend, max_pair)
            every = blocks.sizes()
            skip, n = ((every - aligned) // 2, aligned) if center else (0, every)
            at = lambda k: k - 1 if k > 0 else n + k  # noqa: B023, E731
            low, high = skip + np.maximum(0, at(first)), skip + np.minimum(n, at(last) + 1)
            # From the 5' end of a reverse read counts down from the right.
            back = flag & 16 != 0
            blocks = blocks.cut(np.where(back, every - high, low), np.where(back, every - low, high))
            names = (batch.column(c).take(pa.array(blocks.row)) for c in ("qname", "contig"))
            yield pa.RecordBatch.from_arrays([*names, pa.array(blocks.start), pa.array(blocks.end)], ["qname", "contig", "start", "end"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("qname", "contig"))
    return rows.select("qname", "contig", "flag", "blocks", *more).mapInArrow(taken, f"{kinds}, start long, end long")


def match_positions(rows: DataFrame) -> DataFrame:
    """qname, contig, start, end, hits, exact: exact if every mate there has score 0."""
    return rows.groupBy("qname", "contig", "start", "end").agg(F.count("*").alias("hits"), F.bool_and(F.col("score") == 0).alias("exact"))


def scale(rows: DataFrame, factor: float) -> DataFrame:
    return rows.withColumn("value", F.col("value") * factor)
