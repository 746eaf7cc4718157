"""Intervals and range joins: rows of contig, start, end (half-open) and what else they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import physical
from .tracks import quantiles


def find_peaks(signal: DataFrame, threshold: float, tolerance: int = 0, least: int = 0, block: int = physical.BLOCK) -> DataFrame:
    """contig, start, end of runs of values above a threshold; gaps of up to `tolerance` are closed, runs under `least` dropped.

    A run starts where the last position above the threshold is further back than the tolerance. Runs are found in blocks of
    positions and then joined over their borders, so that a long contig is not one task.
    """
    above = signal.filter(F.col("value") > threshold).select("contig", "pos")
    inside = W.partitionBy("contig", "_block").orderBy("pos")
    rows = above.withColumn("_block", F.floor(F.col("pos") / block))
    rows = rows.withColumn("_gap", F.col("pos") - F.lag("pos").over(inside))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_gap") <= tolerance + 1, 0).otherwise(1)).over(inside))
    runs = rows.groupBy("contig", "_block", "_run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    runs = physical.run_starts(runs.drop("_block", "_run"), ["contig"], tolerance + 1, block=block)
    return runs.groupBy("contig", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run").filter(F.col("end") - F.col("start") >= least)


def clip_intervals(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Intervals that overlap a window, cut to it."""
    cut = rows.filter((F.col("start") < end) & (F.col("end") > start))
    return cut.withColumn("start", F.greatest("start", F.lit(start))).withColumn("end", F.least("end", F.lit(end)))


def overlapping(a: DataFrame, b: DataFrame, tolerance: int = 0, keep: bool = True, width: int = 64, key: tuple[str, ...] = ("contig", "start", "end")) -> DataFrame:
    """Rows of a that overlap any of b, or none; both ends closed, plus a tolerance. b is merged first, so that matches stay few."""
    merged = merge(b, tolerance=1)
    hit = physical.range_join(a.select(*key).distinct(), merged, width, tolerance=tolerance + 1).select(*key).distinct()
    return a.join(hit, list(key), "left_semi" if keep else "left_anti")


def overlap_summary(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    """n, overlapping and percent of a."""
    n = a.agg(F.count("*").alias("n"))
    return n.join(overlapping(a, b, **options).agg(F.count("*").alias("overlapping"))).withColumn("percent", F.col("overlapping") * 100.0 / F.col("n"))


def self_overlaps(rows: DataFrame, tolerance: int = 0) -> DataFrame:
    """Rows whose end reaches the start of the next one; a tolerance of 1 counts adjacent ones."""
    return physical.beside(rows, ["contig"], ["start", "end"], "start", "_n", ahead=True).filter(F.col("end") > F.col("_n") - tolerance).drop("_n")


def merge(rows: DataFrame, tolerance: int = 0, span: int = 65_536) -> DataFrame:
    """contig, start, end of merged intervals: what overlaps, or with a tolerance of 1 touches, becomes one; nested ones included.

    The largest end so far and the run that is open are carried over blocks of starts. Equal intervals become one, empty ones too.
    """
    runs = physical.run_starts(rows.select("contig", "start", "end"), ["contig"], tolerance, block=span)
    return runs.groupBy("contig", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def base_overlap(a: DataFrame, b: DataFrame, width: int = 64) -> DataFrame:
    """bases_a, bases_b, shared and percentages, from merged sets, so no base is a row."""
    a, b = merge(a), merge(b)
    size = lambda df, name: df.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias(name))
    common = F.least("end", "b_end") - F.greatest("start", "b_start")
    both = physical.range_join(a, b, width).agg(F.coalesce(F.sum(common), F.lit(0)).alias("shared"))
    out = size(a, "bases_a").join(size(b, "bases_b")).join(both)
    return out.withColumn("percent_a", F.col("shared") * 100.0 / F.col("bases_a")).withColumn("percent_b", F.col("shared") * 100.0 / F.col("bases_b"))


def interval_lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy((F.col("end") - F.col("start")).alias("length")).agg(F.count("*").alias("n"))


def mark_bins(bins: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """bins (contig, bin, ...) with marked: whether any interval touches the bin."""
    touched = rows.filter("end > start").select("contig", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("bin")).distinct()
    return bins.join(touched.withColumn("_m", F.lit(True)), ["contig", "bin"], "left").withColumn("marked", F.coalesce("_m", F.lit(False))).drop("_m")


def interval_signal(rows: DataFrame, tracks: DataFrame, width: int = 64, centred: int | None = None, clip: float | None = None) -> DataFrame:
    """id, track, total: signal inside each interval; optionally in a fixed size about its middle, or with values clipped at a quantile."""
    if centred is not None:
        mid = F.floor((F.col("start") + F.col("end")) / 2)
        rows = rows.withColumn("start", mid - centred // 2).withColumn("end", F.col("start") + centred)
    if clip is not None:
        tops = quantiles(tracks, [clip]).withColumnRenamed("q0", "_top")
        tracks = tracks.join(tops, "track").withColumn("value", F.least("value", "_top")).drop("_top")
    points = tracks.select("track", "contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")
    return physical.range_join(rows, points, width).groupBy("id", F.col("b_track").alias("track")).agg(F.sum("b_value").alias("total"))


def interval_enrichment(totals: DataFrame, track_totals: DataFrame, ip: str, control: str) -> DataFrame:
    """track sums, means and deviations in counts per million, and log2 fold change and % of ip over control."""
    j = totals.join(track_totals.select("track", F.col("total").alias("_all")), "track").withColumn("cpm", F.col("total") * 1e6 / F.col("_all"))
    per = j.groupBy("track").agg(F.sum("cpm").alias("sum"), F.avg("cpm").alias("mean"), F.stddev_samp("cpm").alias("std"), F.count("*").alias("n"))
    one = lambda name, c: per.filter(F.col("track") == name).select(F.col("sum").alias(c))
    return per.join(one(ip, "_ip").join(one(control, "_c"))).withColumn("log2_fold", F.log2(F.col("_ip") / F.col("_c"))).withColumn("percent", F.col("_ip") * 100 / F.col("_c")).drop("_ip", "_c")


def neighbour(rows: DataFrame, name: str, ahead: bool) -> DataFrame:
    """rows with start and end of the match before or after theirs on the contig."""
    held = rows.withColumn("_held", F.struct("start", "end"))
    return physical.beside(held, ["contig"], ["start", "end", "id"], "_held", name, ahead=ahead).drop("_held")


def resolve_nested(rows: DataFrame) -> DataFrame:
    """One pass over consecutive matches of a contig: of two that overlap the longer one goes (the earlier if equal)."""
    size = F.col("end") - F.col("start")
    rows = neighbour(neighbour(rows, "_n", True), "_p", False)
    by_next = (F.col("_n.start") < F.col("end")) & (size >= F.col("_n.end") - F.col("_n.start"))
    by_last = (F.col("_p.end") > F.col("start")) & (size > F.col("_p.end") - F.col("_p.start"))
    return rows.filter(~(F.coalesce(by_next, F.lit(False)) | F.coalesce(by_last, F.lit(False)))).drop("_n", "_p")


def crossed(rows: DataFrame) -> DataFrame:
    """For each two consecutive overlapping matches the shortest of the four intervals that their starts and ends make."""
    j = neighbour(rows, "_n", True).withColumn("s2", F.col("_n.start")).withColumn("e2", F.col("_n.end")).filter("s2 < end")
    pair = lambda s, e: F.when(F.col(e) > F.col(s), F.struct((F.col(e) - F.col(s)).alias("n"), F.col(s).alias("start"), F.col(e).alias("end")))
    best = F.least(pair("start", "end"), pair("start", "e2"), pair("s2", "end"), pair("s2", "e2"))
    return j.select("contig", "id", best["start"].alias("start"), best["end"].alias("end"))


def extend(rows: DataFrame, lengths: DataFrame, by: int, least: int) -> DataFrame:
    """Both sides moved out, up to a least size about the middle, then shifted back inside the contig."""
    j = rows.join(lengths.select("contig", "length"), "contig")
    half = F.greatest(F.lit(by), F.ceil((F.lit(least) - (F.col("end") - F.col("start"))) / 2))
    j = j.withColumn("_s", F.col("start") - half).withColumn("_e", F.col("end") + half)
    shift = F.when(F.col("_s") < 0, -F.col("_s")).when(F.col("_e") > F.col("length"), F.col("length") - F.col("_e")).otherwise(0)
    return j.withColumn("start", F.greatest(F.lit(0), F.col("_s") + shift)).withColumn("end", F.least("length", F.col("_e") + shift)).drop("_s", "_e", "length")


def interval_features(rows: DataFrame, signal: DataFrame, width: int = 64) -> DataFrame:
    """id, mean signal and number of positions inside each interval."""
    points = signal.select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")
    return physical.range_join(rows, points, width).groupBy("id").agg(F.avg("b_value").alias("mean"), F.count("*").alias("n"))


def metaprofile(anchors: DataFrame, signal: DataFrame, reach: int, anchor: str = "center", width: int = 64) -> DataFrame:
    """offset, mean, n: mean signal at each offset of up to `reach` about the anchors."""
    rows = anchored(anchors, signal, reach, anchor, width)
    return rows.groupBy("offset").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def anchored(anchors: DataFrame, signal: DataFrame, reach: int, anchor: str, width: int) -> DataFrame:
    at: Column = {"center": F.floor((F.col("start") + F.col("end")) / 2), "start": F.col("start"), "end": F.col("end") - 1}[anchor]
    spans = anchors.select("id", "contig", at.alias("at")).withColumn("start", F.col("at") - reach).withColumn("end", F.col("at") + reach + 1)
    points = signal.select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")
    return physical.range_join(spans, points, width).select("id", (F.col("b_start") - F.col("at")).alias("offset"), F.col("b_value").alias("value"))


def profile_correlation(anchors: DataFrame, signal: DataFrame, reach: int, anchor: str = "center", width: int = 64) -> DataFrame:
    """id, corr of each anchor's profile with the mean profile, in that order."""
    rows = anchored(anchors, signal, reach, anchor, width)
    mean = rows.groupBy("offset").agg(F.avg("value").alias("mean"))
    return rows.join(mean, "offset").groupBy("id").agg(F.corr("value", "mean").alias("corr")).orderBy(F.desc("corr"))
