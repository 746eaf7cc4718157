"""Tests, correlations and models."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import physical
from .tracks import quantiles

#: Up to this many trials the binomial tail is a sum of terms, beyond it a continued fraction.
SUMMED = 4096


def binom_tail(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """P(X >= k) for X ~ Binomial(n, p), without cancellation: terms in logs, or the incomplete beta function for large n."""
    return np.array([_tail(int(a), int(b), p) for a, b in zip(k, n, strict=True)])


def _tail(k: int, n: int, p: float) -> float:
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    if n > SUMMED:
        return incomplete_beta(k, n - k + 1, p)
    i = np.arange(k, n + 1)
    logs = LOG_FACTORIAL[n] - LOG_FACTORIAL[i] - LOG_FACTORIAL[n - i] + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return min(1.0, float(math.exp(top) * np.exp(logs - top).sum()))


LOG_FACTORIAL = np.r_[0.0, np.cumsum(np.log(np.arange(1, SUMMED + 1)))]


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction, evaluated where it converges fast."""
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Lentz's evaluation of 1 / (1 + d1 / (1 + d2 / (1 + ...))).
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    out = d
    for m in itertools.count(1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(1 - c * d) < 1e-15 or c * d != c * d:
            break
    return min(1.0, max(0.0, front * out))


def counts_of(bins: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ip_count, ctrl_count, _n: how many bins have these counts, written once. Tests depend on nothing else of a bin."""
    return physical.shared(bins.groupBy(*keys, "ip_count", "ctrl_count").agg(F.count("*").alias("_n")))


def with_tails(counts: DataFrame, keys: list[str], less: bool) -> DataFrame:
    """counts with p_more: the chance of so many ip counts or more, given ip + control and the overall share of ip; with less, also p_less."""
    share = counts.groupBy(*keys).agg((F.sum(F.col("ip_count") * F.col("_n")) / F.sum((F.col("ip_count") + F.col("ctrl_count")) * F.col("_n"))).alias("_p"))
    counts = counts.join(share, keys) if keys else counts.join(share)

    @F.pandas_udf("p_more double, p_less double")
    def tails(k: pd.Series, c: pd.Series, p: pd.Series) -> pd.DataFrame:
        both = [(_tail(int(a), int(a + b), q), _tail(int(b), int(a + b), 1 - q) if less else None) for a, b, q in zip(k, c, p, strict=True)]
        return pd.DataFrame(both, columns=["p_more", "p_less"], dtype=float)

    out = counts.withColumn("_t", tails("ip_count", "ctrl_count", F.coalesce("_p", F.lit(0.0))))
    return out.withColumns({c: F.col(f"_t.{c}") for c in ("p_more", "p_less")[: 1 + less]}).drop("_p", "_t")


def binom_pvalue(bins: DataFrame, keys: list[str] = (), less: bool = False) -> DataFrame:
    """bins with pval: the chance of so many ip counts or more (with less: control counts), given ip + control and the overall share.

    Tails are computed once per distinct (ip, control) of each key and joined back, so the work does not grow with the number of bins.
    """
    keys = list(keys)
    tails = with_tails(counts_of(bins, keys), keys, less).select(*keys, "ip_count", "ctrl_count", F.col("p_less" if less else "p_more").alias("pval"))
    return bins.join(tails, [*keys, "ip_count", "ctrl_count"])


def q_values(counts: DataFrame, keys: list[str], p: str, q: str) -> DataFrame:
    """keys, p, q from different p with the number of tests that have it (_n): the least p * m / rank over larger p, at most 1.

    Distinct p are ranked by blocks, and the least of later blocks is carried to earlier ones, so no task orders them all.
    """
    ranked, several = physical.ranked_counts(counts, keys, p)
    ranked = ranked.withColumn("_v", F.col(p) * F.col("_all") / F.col("_upto"))
    inside = W.partitionBy(*keys, "_block").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    least = ranked.withColumn("_v", F.min("_v").over(inside))
    if not several:
        return least.select(*keys, p, F.least(F.lit(1.0), "_v").alias(q))
    later = W.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    carried = ranked.groupBy(*keys, "_block").agg(F.min("_v").alias("_least")).select(*keys, "_block", F.min("_least").over(later).alias("_least"))
    return least.join(carried, [*keys, "_block"]).select(*keys, p, F.least(F.lit(1.0), "_v", "_least").alias(q))


def fdr_bh(rows: DataFrame, keys: list[str] = (), p: str = "pval", q: str = "qval") -> DataFrame:
    """rows with q: the least p * m / rank over larger p, at most 1. Ranks are over distinct p with their counts."""
    keys = list(keys)
    return rows.join(q_values(rows.groupBy(*keys, p).agg(F.count("*").alias("_n")), keys, p, q), [*keys, p])


def tested(bins: DataFrame, keys: list[str], less: bool, skip_empty: bool = False) -> DataFrame:
    """keys, ip_count, ctrl_count, p_more, q_more, and with less p_less, q_less: the tests of all bins, once for each pair of counts.

    Counts and tails are written once; q-values of both tails come from one ranking, in which the tail is a key.
    """
    tails = physical.shared(with_tails(counts_of(bins, keys), keys, less))
    kinds = ("more", "less")[: 1 + less]
    each = tails.filter("ip_count + ctrl_count > 0") if skip_empty else tails
    each = each.select(*keys, "ip_count", "ctrl_count", "_n", F.explode(F.array(*(F.struct(F.lit(k).alias("tail"), F.col(f"p_{k}").alias("pval")) for k in kinds))).alias("_x"))
    each = each.select(*keys, "ip_count", "ctrl_count", "_n", "_x.tail", "_x.pval")
    q = q_values(each.groupBy(*keys, "tail", "pval").agg(F.sum("_n").alias("_n")), [*keys, "tail"], "pval", "qval")
    own = [F.max(F.when(F.col("tail") == k, F.col(v))).alias(f"{v[0]}_{k}") for k in kinds for v in ("pval", "qval")]
    out = each.join(q, [*keys, "tail", "pval"]).groupBy(*keys, "ip_count", "ctrl_count").agg(*own)
    if skip_empty:
        empty = tails.filter("ip_count + ctrl_count = 0").select(*keys, "ip_count", "ctrl_count", *(c for k in kinds for c in (F.col(f"p_{k}"), F.lit(1.0).alias(f"q_{k}"))))
        out = out.unionByName(empty)
    return out


def enrichment(bins: DataFrame, alpha: float = 0.05, skip_empty: bool = False, keys: list[str] = ()) -> DataFrame:
    """bins with pval, qval, -log10 of both and significant; with skip_empty, bins without counts are left out of the control."""
    keys, bins = list(keys), physical.shared(bins)
    tests = tested(bins, keys, False, skip_empty).withColumnsRenamed({"p_more": "pval", "q_more": "qval"})
    out = bins.join(tests, [*keys, "ip_count", "ctrl_count"])
    return out.withColumn("log_p", -F.log10("pval")).withColumn("log_q", -F.log10("qval")).withColumn("significant", F.col("qval") < alpha)


def genome_enrichment(ip: DataFrame, control: DataFrame, lengths: DataFrame, size: int, max_length: int | None = None, alpha: float = 0.05) -> DataFrame:
    """Two sets of fragments to bins of the genome and their enrichment."""
    from .windows import midpoint_counts

    a = midpoint_counts(ip, lengths, size, max_length).withColumnRenamed("n", "ip_count")
    b = midpoint_counts(control, lengths, size, max_length).withColumnRenamed("n", "ctrl_count")
    return enrichment(a.join(b, ["contig", "bin"]), alpha)


def pool_experiments(*experiments: DataFrame) -> DataFrame:
    """Counts of several experiments added up by bin, and tested again."""
    rows = experiments[0]
    for other in experiments[1:]:
        rows = rows.unionByName(other)
    return enrichment(rows.groupBy("contig", "pos").agg(F.sum("ip_count").alias("ip_count"), F.sum("ctrl_count").alias("ctrl_count")))


def compare_coverage(bins: DataFrame) -> DataFrame:
    """bins with the shares of both samples and their ratio, 0 where the control has none."""
    t = bins.agg(F.sum("ip_count").alias("_i"), F.sum("ctrl_count").alias("_c"))
    j = bins.join(t).withColumn("ip_share", F.col("ip_count") / F.col("_i")).withColumn("ctrl_share", F.col("ctrl_count") / F.col("_c"))
    return j.withColumn("ratio", F.when(F.col("ctrl_count") == 0, 0.0).otherwise(F.col("ip_share") / F.col("ctrl_share"))).drop("_i", "_c")


def coincidence(flags: DataFrame, sizes: list[str]) -> DataFrame:
    """size, agreeing, n: of the significant positions of each bin size, how many sizes agree there."""
    agreeing = sum((F.col(s).cast("int") for s in sizes), F.lit(0))
    long = flags.withColumn("agreeing", agreeing).select("agreeing", *sizes).unpivot(["agreeing"], sizes, "size", "flag")
    return long.filter("flag").groupBy("size", "agreeing").agg(F.count("*").alias("n"))


def flag_patterns(flags: DataFrame, sizes: list[str]) -> DataFrame:
    return flags.groupBy(*sizes).agg(F.count("*").alias("n"))


def count_clusters(rows: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Runs of true: positions that are true and follow none that is."""
    rows = physical.beside(rows, keys, ["pos"], flag, "_before")
    return rows.withColumn("_s", F.col(flag) & ~F.coalesce("_before", F.lit(False))).groupBy(*keys).agg(F.count_if("_s").alias("clusters"))


def thinned(bins: DataFrame, fractions: list[float], seed: int = 1, only_ip: bool = False) -> DataFrame:
    """bins with frac: counts thinned to each fraction at random; fraction 1 keeps them as they are.

    Fractions are nested: one multinomial split of a bin's objects says from which fraction on each is kept. It is drawn from ids
    and a seed, once for all fractions.
    """
    order = sorted(min(float(f), 1.0) for f in fractions)
    steps = np.diff([0.0, *order, 1.0]).clip(0)

    @F.pandas_udf("array<long>")
    def split(n: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([np.cumsum(np.random.default_rng(abs(int(x))).multinomial(int(a), steps / steps.sum()))[:-1] if a else np.zeros(len(order), np.int64) for a, x in zip(n, u, strict=True)])

    draw = lambda c, salt: split(c, F.xxhash64("contig", "pos", *["rep"] * ("rep" in bins.columns), F.lit(seed + salt)))
    out = bins.withColumn("_a", draw("ip_count", 0))
    if not only_ip:
        out = out.withColumn("_b", draw("ctrl_count", 1))
    at = [order.index(min(float(f), 1.0)) for f in fractions]
    kept = lambda f, i, c, n: (F.col(n) if f >= 1 else F.get(c, i)).alias(n)
    each = F.explode(F.array(*(F.struct(F.lit(float(f)).alias("frac"), kept(f, i, "_a", "ip_count"), F.col("ctrl_count") if only_ip else kept(f, i, "_b", "ctrl_count")) for f, i in zip(fractions, at, strict=True))))
    return out.select(*(c for c in bins.columns if c not in ("ip_count", "ctrl_count")), each.alias("_x")).select("*", "_x.*").drop("_x")


def saturation(bins: DataFrame, sizes: list[int], fractions: list[float], alpha: float = 0.05, seed: int = 1, only_ip: bool = False, replicates: int = 1) -> DataFrame:
    """binsize, frac, n, ip_cov, ctrl_cov, ip, ctrl, undetermined, ip_clusters, ctrl_clusters: bins that either sample exceeds, by bin size and fraction.

    ip_cov and ctrl_cov are the counts that are left of either sample. More than one replicate adds rep (from 0), each drawn anew.
    The given bins are thinned once, for all bin sizes; wider bins of what is left are written once and tested by their counts.
    """
    keys = ["binsize", "frac"]
    if replicates > 1:
        bins = bins.withColumn("rep", F.explode(F.array(*map(F.lit, range(replicates)))))
        keys.append("rep")
    wide = thinned(bins, fractions, seed, only_ip).withColumn("binsize", F.explode(F.array(*map(F.lit, sizes))))
    wide = wide.groupBy(*keys, "contig", F.floor(F.col("pos") / F.col("binsize")).alias("pos")).agg(F.sum("ip_count").alias("ip_count"), F.sum("ctrl_count").alias("ctrl_count"))
    wide = physical.shared(wide.filter("ip_count + ctrl_count > 0"))
    both = wide.join(tested(wide, keys, True), [*keys, "ip_count", "ctrl_count"])
    both = both.withColumn("_i", (F.col("q_more") < alpha).cast("int")).withColumn("_c", (F.col("q_less") < alpha).cast("int"))
    # A cluster begins where the bin right before is not flagged.
    flagged = {n: (lambda w, c=c: F.sum(c).over(w)) for n, c in (("_wi", "_i"), ("_wc", "_c"))}
    both = physical.frame(both, [*keys, "contig"], 1, 0, flagged)
    start = lambda c, w: F.count_if((F.col(c) == 1) & (F.col(w) == 1))
    flags = [F.sum("_i").alias("ip"), F.sum("_c").alias("ctrl"), F.count_if(F.col("_i") + F.col("_c") == 0).alias("undetermined")]
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("ip_count").alias("ip_cov"), F.sum("ctrl_count").alias("ctrl_cov"), *flags, start("_i", "_wi").alias("ip_clusters"), start("_c", "_wc").alias("ctrl_clusters"))


def saturation_percent(rows: DataFrame) -> DataFrame:
    return rows.select("binsize", "frac", *((F.col(c) * 100.0 / F.col("n")).alias(c) for c in ("ip", "ctrl", "undetermined")))


def pearson_by_contig(rows: DataFrame, size: int | None = None, clip: float | None = None, subset: str | None = None) -> DataFrame:
    """contig, a, b, corr for every two tracks, over positions, or bins of positions, that both have.

    With clip, values end at that quantile of their track and contig. subset: "nonzero" leaves out positions where either is 0,
    "finite" those where either is missing, NaN or infinite.
    """
    if size:
        rows = rows.groupBy("track", "contig", F.floor(F.col("pos") / size).alias("pos")).agg(F.avg("value").alias("value"))
    if clip is not None:
        top = quantiles(rows, [clip], ["track", "contig"])
        rows = rows.join(top, ["track", "contig"]).withColumn("value", F.least("value", "q0")).drop("q0")
    if subset == "nonzero":
        rows = rows.filter("value <> 0")
    elif subset == "finite":
        rows = rows.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    a, b = (rows.select("contig", "pos", F.col("track").alias(n), F.col("value").alias(f"_{n}")) for n in "ab")
    return a.join(b, ["contig", "pos"]).filter("a < b").groupBy("contig", "a", "b").agg(F.corr("_a", "_b").alias("corr"))


def average_ranks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their average rank as value; ranks are over distinct values with counts."""
    n, _ = physical.ranked_counts(rows.groupBy(*keys, "value").agg(F.count("*").alias("_n")), keys)
    n = n.select(*keys, "value", (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias("_r"))
    return rows.join(n, [*keys, "value"]).withColumn("value", F.col("_r")).drop("_r")


def spearman_by_contig(rows: DataFrame) -> DataFrame:
    """Correlation of average ranks; rows must have every track at every position."""
    return pearson_by_contig(average_ranks(rows, ["track", "contig"]))


def nan_pearson(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Correlation over rows where both are finite."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return rows.filter(finite(a) & finite(b)).groupBy(*keys).agg(F.corr(a, b).alias("corr"))


def lagged(x: DataFrame, y: DataFrame, offsets: list[int], rows: list[str] = ()) -> DataFrame:
    """contig, offset, x, y: values of y at pos + offset beside x; with `rows`, for each row of y that these columns name."""
    a = x.select("contig", F.explode(F.array(*map(F.lit, offsets))).alias("offset"), "pos", F.col("value").alias("x"))
    a = a.withColumn("pos", F.col("pos") + F.col("offset"))
    return a.join(y.select("contig", *rows, "pos", F.col("value").alias("y")), ["contig", "pos"])


def lagged_correlation(x: DataFrame, y: DataFrame, offsets: list[int], rows: list[str] = ()) -> DataFrame:
    """contig, offset, corr of two signals, or of one signal with each of many rows."""
    return lagged(x, y, offsets, rows).groupBy("contig", *rows, "offset").agg(F.corr("x", "y").alias("corr"))


def best_lag(x: DataFrame, y: DataFrame, offsets: list[int]) -> DataFrame:
    """contig, lag with the largest sum of products; of equal ones the last."""
    s = lagged(x, y, offsets).groupBy("contig", "offset").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    return s.groupBy("contig").agg(F.max_by("offset", F.struct("s", "offset")).alias("lag"))


def autocorr_period(rows: DataFrame, block: int, least: int, lags: tuple[int, int], smooth: int = 8) -> DataFrame:
    """contig, block, period: the lag of the largest normalised autocorrelation of each block; null at the edges of the range.

    Sums over all lags come from a Fourier transform of the block, so a position is one row. Lags without any pair don't count, nor do
    blocks of equal values.
    """
    s = physical.frame(rows, ["contig"], smooth // 2, (smooth - 1) // 2, {"value": lambda w: F.sum("value").over(w) / smooth})
    s = s.select("contig", F.floor(F.col("pos") / block).alias("block"), "pos", "value")
    lo, hi = lags

    def period(part: pd.DataFrame) -> pd.DataFrame:
        n, value = len(part), part["value"].to_numpy(float)
        first, best = part.iloc[0], None
        if n < least or not value.var():
            return part.iloc[:0][["contig", "block"]].assign(period=pd.Series(dtype="Int64"))
        place = part["pos"].to_numpy() - int(first["block"]) * block
        x, there = np.zeros(2 * block), np.zeros(2 * block)
        x[place], there[place] = value - value.mean(), 1
        sums, pairs = (np.fft.irfft(np.abs(np.fft.rfft(v)) ** 2, 2 * block)[lo : min(hi, block)] for v in (x, there))
        r = np.where(pairs > 0.5, np.round(sums / (n * value.var()), 9), -np.inf)
        if (r > -np.inf).any():
            best = lo + int(r.argmax())
        return pd.DataFrame({"contig": [first["contig"]], "block": [first["block"]], "period": pd.array([best if best is not None and lo < best < hi - 1 else None], "Int64")})

    return s.groupBy("contig", "block").applyInPandas(period, f"contig {rows.schema['contig'].dataType.simpleString()}, block long, period int")


def continuous_jaccard(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Sum of the smaller absolute values, signed by agreement, over the sum of the larger."""
    same = F.when(F.signum(a) == F.signum(b), 1.0).otherwise(-1.0)
    return rows.groupBy(*keys).agg((F.sum(F.least(F.abs(a), F.abs(b)) * same) / F.sum(F.greatest(F.abs(a), F.abs(b)))).alias("jaccard"))


def profile_error(rows: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    d = F.col(truth) - F.col(pred)
    out = rows.groupBy(*keys).agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.corr(truth, pred).alias("corr"))
    return out.withColumn("loss", 1 - F.col("corr") + F.col("mae"))


def line_fit(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def least_squares(rows: DataFrame, inputs: list[str], label: str, intercept: bool = True):
    """A linear model by the normal equations; .transform(rows) predicts, for these rows or another set."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="_x"), LinearRegression(featuresCol="_x", labelCol=label, solver="normal", fitIntercept=intercept)]).fit(rows)


def best_threshold(rows: DataFrame, bins: int, label: str = "label", value: str = "pred") -> DataFrame:
    """threshold, accuracy, above: the bin edge over [0, 1] that parts two classes best, in either direction."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))
    n = rows.groupBy(b.alias("_b")).agg(F.count_if(F.col(label)).alias("_t"), F.count_if(~F.col(label)).alias("_f"))
    upto = W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy()
    n = n.withColumn("_ct", F.sum("_t").over(upto)).withColumn("_cf", F.sum("_f").over(upto)).withColumn("_at", F.sum("_t").over(everything)).withColumn("_af", F.sum("_f").over(everything))
    right = (F.col("_cf") + F.col("_at") - F.col("_ct")) / (F.col("_at") + F.col("_af"))
    n = n.withColumn("accuracy", F.greatest(right, 1 - right)).withColumn("above", right >= 0.5)
    best = F.max_by(F.struct("_b", "accuracy", "above"), F.struct("accuracy", -F.col("_b")))
    return n.agg(best.alias("x")).select(((F.col("x._b") + 1) / F.lit(float(bins))).alias("threshold"), "x.accuracy", "x.above")
