"""Aggregates, normalisation and arithmetic of tracks: rows of track, contig, pos, value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import physical, windows


def quantiles(rows: DataFrame, probabilities: list[float], keys: list[str] = ("track",)) -> DataFrame:
    """Exact quantiles with linear interpolation, as q0, q1, ...; null and NaN take no part.

    Different values are counted, ranked by blocks, and the two about each quantile picked, so no task holds the values of a key.
    """
    keys = list(keys)
    counts = rows.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).groupBy(*keys, "value").agg(F.count("*").alias("_n"))
    r, _ = physical.ranked_counts(counts, keys)
    holds = lambda at: (F.col("_upto") - F.col("_n") <= at) & (at < F.col("_upto"))
    aggs, out = [F.max("_all").alias("_all")], []
    for i, p in enumerate(probabilities):
        at = (F.col("_all") - 1) * F.lit(float(p))
        aggs += [F.max(F.when(holds(F.floor(at)), F.col("value"))).alias(f"_lo{i}"), F.max(F.when(holds(F.ceil(at)), F.col("value"))).alias(f"_hi{i}")]
        lo, hi = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(f"q{i}"))
    return r.groupBy(*keys).agg(*aggs).select(*keys, *out)


def totals(rows: DataFrame, clip: float = 0.99) -> DataFrame:
    """track, total and the total with values clipped at a quantile."""
    top = quantiles(rows, [clip])
    return rows.join(top, "track").groupBy("track").agg(F.sum("value").alias("total"), F.sum(F.least("value", "q0")).alias("clipped"))


def value_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("contig", F.col("value").cast("long").alias("value")).agg(F.count("*").alias("n"))


def clipnorm(rows: DataFrame, quantile: float = 0.99, low: float | None = 0.0) -> DataFrame:
    """Values clipped at the quantile over all contigs of a track and divided by it."""
    j = rows.join(quantiles(rows, [quantile]), "track")
    v = F.least("value", "q0") if low is None else F.greatest(F.lit(low), F.least("value", "q0"))
    return j.withColumn("value", v / F.col("q0")).drop("q0")


def z_score(rows: DataFrame, keys: list[str], subset: DataFrame | None = None) -> DataFrame:
    """(value - mean) / population deviation per keys, both optionally from a subset."""
    base = rows if subset is None else subset
    stats = base.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return rows.join(stats, list(keys)).withColumn("value", (F.col("value") - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def cpm(rows: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Counts per million of the track's total over contigs that are not excluded."""
    total = rows.filter(~F.col("contig").isin(list(exclude))).groupBy("track").agg(F.sum("value").alias("_t"))
    return rows.join(total, "track").withColumn("value", F.col("value") * 1e6 / F.col("_t")).drop("_t")


def mask_regions(rows: DataFrame, regions: DataFrame, width: int = 64, huge: float = 1e38) -> DataFrame:
    """0 inside regions and for missing or huge values."""
    points = rows.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 1)
    from .intervals import merge

    inside = physical.range_join(points.select("contig", "pos", "start", "end").distinct(), merge(regions), width).select("contig", "pos").distinct().withColumn("_m", F.lit(True))
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") > huge) | F.col("_m").isNotNull()
    return rows.join(inside, ["contig", "pos"], "left").withColumn("value", F.when(bad, 0.0).otherwise(F.col("value"))).drop("_m")


def merge_replicates(rows: DataFrame, tracks: int) -> DataFrame:
    """Mean over a number of tracks by position; a track without the position counts as 0."""
    return rows.groupBy("contig", "pos").agg((F.sum("value") / tracks).alias("value"))


def pick_track(rows: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Of each contig the track of highest priority that has it."""
    order = F.create_map(*(F.lit(x) for kv in priority.items() for x in kv))
    have = rows.select("contig", "track").distinct().withColumn("_p", F.element_at(order, F.col("track")))
    best = have.groupBy("contig").agg(F.min_by("track", "_p").alias("track"))
    return rows.join(best, ["contig", "track"], "left_semi")


RATIOS: dict[str, Callable[[Column, Column], Column]] = {
    "ratio": lambda x, y: x / y,
    "log": lambda x, y: F.log(x / y),
    "log2": lambda x, y: F.log2(x / y),
    "xlog": lambda x, y: x * F.log(x / y),
    "sqrtlog": lambda x, y: F.sqrt(x) * F.log(x / y),
}


def paired(rows: DataFrame, a: str, b: str) -> DataFrame:
    """contig, pos, x, y: the values of two tracks, 0 where one is absent."""
    one = lambda name: F.coalesce(F.sum(F.when(F.col("track") == name, F.col("value"))), F.lit(0.0))
    return rows.filter(F.col("track").isin(a, b)).groupBy("contig", "pos").agg(one(a).alias("x"), one(b).alias("y"))


def track_ratio(rows: DataFrame, a: str, b: str, kind: str | Callable[[Column, Column], Column] = "ratio", smooth: int | None = None) -> DataFrame:
    """contig, pos, value: a named or given function of two tracks, 0 where either is 0; smoothed first if asked for."""
    f = RATIOS[kind] if isinstance(kind, str) else kind
    p = paired(rows, a, b).withColumn("_zero", (F.col("x") == 0) | (F.col("y") == 0))
    if smooth:
        mean = lambda c: lambda w: F.sum(c).over(w) / smooth
        p = physical.frame(p, ["contig"], smooth // 2, (smooth - 1) // 2, {"x": mean("x"), "_y": mean("y")}).drop("y").withColumnRenamed("_y", "y")
    return p.select("contig", "pos", F.when(F.col("_zero"), 0.0).otherwise(f(F.col("x"), F.col("y"))).alias("value"))


def invalid_positions(rows: DataFrame, a: str, b: str, either: bool = False) -> DataFrame:
    bad = F.col("y") == 0
    return paired(rows, a, b).filter(bad | (F.col("x") == 0) if either else bad).select("contig", "pos")


def to_counts(rows: DataFrame, clip: float | None = None) -> DataFrame:
    """Values as multiples of the smallest non-zero one, rounded, optionally clipped."""
    step = rows.groupBy("track").agg(F.min(F.when(F.col("value") != 0, F.col("value"))).alias("_s"))
    n = F.round(F.col("value") / F.col("_s"))
    return rows.join(step, "track").withColumn("value", F.least(n, F.lit(float(clip))) if clip is not None else n).drop("_s")


def halved(rows: DataFrame) -> DataFrame:
    """Counts of whole objects from counts of their two ends: the difference of half the running sum."""
    run = physical.running_sum(rows, ["track", "contig"], F.col("value"), "_r")
    half = F.floor(F.col("_r") / 2) - F.floor((F.col("_r") - F.col("value")) / 2)
    return run.withColumn("value", half.cast("double")).drop("_r")


def min_max(rows: DataFrame, keys: list[str]) -> DataFrame:
    e = rows.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return rows.join(e, list(keys)).withColumn("value", (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def label_pipeline(rows: DataFrame, clip: float = 0.99, size: int = 91, sigma: float = 15.0, halve: bool = False, remove_zero: bool = False, postclip: bool = False) -> DataFrame:
    """Counts, clipped at a quantile, gaussian smoothed and scaled to 0..1 per contig.

    halve: counts of two ends become counts of objects. remove_zero: quantiles are those of values that aren't 0. postclip: what was smoothed
    is clipped at its quantile again.
    """

    def clipped(values: DataFrame) -> DataFrame:
        top = quantiles(values.filter("value <> 0") if remove_zero else values, [clip])
        return values.join(top, "track").withColumn("value", F.least("value", "q0")).drop("q0")

    counts = halved(to_counts(rows)) if halve else to_counts(rows)
    smoothed = windows.smooth(clipped(counts), windows.kernel("gaussian", size, sigma), ["track", "contig"])
    return min_max(clipped(smoothed) if postclip else smoothed, ["track", "contig"])


def label_replicates(rows: DataFrame, most: float, size: int, sigma: float, quantile: float, times: float = 1.0) -> DataFrame:
    """contig, pos, value: counts of all tracks (replicates), each clipped at `most`, added up, gaussian smoothed, clipped at `times` a quantile
    over all contigs and divided by it."""
    total = to_counts(rows, most).groupBy("contig", "pos").agg(F.sum("value").alias("value"))
    smoothed = windows.smooth(total, windows.kernel("gaussian", size, sigma), ["contig"]).withColumn("track", F.lit("all"))
    top = quantiles(smoothed, [quantile]).select("track", (F.col("q0") * times).alias("_top"))
    return smoothed.join(top, "track").select("contig", "pos", (F.least("value", "_top") / F.col("_top")).alias("value"))


def log_saturating(rows: DataFrame) -> DataFrame:
    """Missing as 0, infinite as the 99.5 (else 98) percentile, then log2(value + 1)."""
    infinite = F.abs("value") == float("inf")
    known = rows.filter(F.col("value").isNotNull() & ~F.isnan("value") & ~infinite)
    tops = rows.select("track").distinct().join(quantiles(known, [0.995, 0.98]), "track", "left").select("track", F.coalesce("q0", "q1", F.lit(0.0)).alias("_t"))
    v = F.when(F.col("value").isNull() | F.isnan("value"), 0.0).when(infinite, F.col("_t")).otherwise(F.col("value"))
    return rows.join(tops, "track").withColumn("value", F.log2(v + 1)).drop("_t")


def combine(rows: DataFrame, how: str | Callable[[], Column] = "mean") -> DataFrame:
    """contig, pos, value over the tracks that have the position: mean, geometric mean, max, or a given aggregate."""
    zero = F.max((F.col("value") == 0).cast("int")) == 1
    kinds = {"mean": lambda: F.avg("value"), "max": lambda: F.max("value"), "geometric": lambda: F.when(zero, 0.0).otherwise(F.exp(F.avg(F.when(F.col("value") > 0, F.log("value")))))}
    f = kinds[how] if isinstance(how, str) else how
    return rows.groupBy("contig", "pos").agg(f().alias("value"))


def mean_by_contig(rows: DataFrame) -> DataFrame:
    """contig, value: mean per contig, a contig's _rev form averaged with its own."""
    each = rows.groupBy("contig").agg(F.avg("value").alias("value"))
    return each.groupBy(F.regexp_replace("contig", "_rev$", "").alias("contig")).agg(F.avg("value").alias("value"))


def clip_to_least(rows: DataFrame, epsilon: float | None = None) -> DataFrame:
    """Zeros as the smallest non-zero value of the track, or as epsilon."""
    least = rows.groupBy("track").agg(F.min(F.when(F.col("value") != 0, F.col("value"))).alias("_l"))
    new = F.lit(epsilon) if epsilon is not None else F.col("_l")
    return rows.join(least, "track").withColumn("value", F.when(F.col("value") == 0, new).otherwise(F.col("value"))).drop("_l")


def class_weights(rows: DataFrame) -> DataFrame:
    """rows with weight = n / (2 * size of their class)."""
    w = rows.groupBy("label").agg(F.count("*").alias("_c")).withColumn("_n", F.sum("_c").over(W.partitionBy()))
    return rows.join(w.select("label", (F.col("_n") / (2 * F.col("_c"))).alias("weight")), "label")


def histogram_weights(rows: DataFrame, classes: int) -> DataFrame:
    """rows with weight = N / (classes * size of their bin), bins of equal width over [0, 1]; missing values weigh 0."""
    b = F.least(F.floor(F.col("value") * classes), F.lit(classes - 1))
    rows = rows.withColumn("_b", b)
    w = rows.filter("_b is not null").groupBy("_b").agg(F.count("*").alias("_c")).withColumn("_n", F.sum("_c").over(W.partitionBy()))
    w = w.select("_b", (F.col("_n") / (classes * F.col("_c"))).alias("weight"))
    return rows.join(w, "_b", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).drop("_b")


def copy_number(rows: DataFrame, contig: str, start: int, end: int, repeats: int, how: str = "max") -> DataFrame:
    """estimate = repeats * max or median of a region / median of all else."""
    inside = (F.col("contig") == contig) & (F.col("pos") >= start) & (F.col("pos") < end)
    part = rows.select("track", "value", inside.alias("_in"))
    rest = quantiles(part.filter("not _in"), [0.5])
    own = part.filter("_in")
    own = own.groupBy("track").agg(F.max("value").alias("_own")) if how == "max" else quantiles(own, [0.5]).withColumnRenamed("q0", "_own")
    return rest.join(own, "track", "left").select("track", (repeats * F.col("_own") / F.col("q0")).alias("estimate"))
