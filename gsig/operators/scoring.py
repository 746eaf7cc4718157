"""Scoring of windows and evaluation of predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .windows import chunks, joined, over_parts


def linear_scorer(weights: np.ndarray, scale: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    """A scorer of (windows, size) tokens: the sum of weights (size, 5) of the bases; several outputs with (outputs, size, 5)."""
    w = np.asarray(weights, float)

    def score(tok: np.ndarray) -> np.ndarray:
        out = np.zeros((len(tok), 1 if w.ndim == 2 else len(w)))
        for h, m in enumerate(w if w.ndim == 3 else w[None]):
            for i in range(tok.shape[1]):
                out[:, h] += m[i].take(tok[:, i])
        return out * scale

    return score


def score_windows(
    rows: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], size: int, stride: int = 1, strands: str = "+", head_interval: int | None = None, middle_half: bool = False, offset: int = 0, flanks: tuple[str, str] = ("", ""), edge: str = "valid",
    totals: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None,
) -> DataFrame:
    """contig, pos, strand, value: a scorer applied to every window, placed at its centre, or each output at its head's place.

    The scorer takes (windows, size) tokens, 4 for unknown, and gives (windows, outputs); it goes to the tasks as it is, so it must be
    small. With head_interval, output h of a window from s stands at s + h * head_interval + head_interval // 2, and with middle_half only
    outputs of the window's middle half are kept. Reverse strands read the complement and place outputs mirrored.

    The first window starts at `offset`. `flanks` stand before and after each sequence and are read, but positions count from the
    sequence's start; with edge="pad" they are unknown bases, as many as give every position a window about it. A contig is named
    once. Sequences go to the scorer in chunks of overlapping ends, some at a time.

    With totals (name -> f(pos, value)): contig, strand, n and the sums of these functions over all windows; they are taken where
    windows are scored, so none is a row. Heads have no totals.
    """
    if edge == "pad":
        flanks = ("N" * (size // 2), "N" * (size - 1 - size // 2))
    if totals is not None and head_interval is not None:
        raise ValueError("heads have no totals")
    rows = rows.withColumn("seq", F.concat(F.lit(flanks[0]), "seq", F.lit(flanks[1]))) if any(flanks) else rows
    table = np.full(256, 4, np.uint8)
    table[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    complement = np.array([3, 2, 1, 0, 4], np.uint8)
    left = len(flanks[0])

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in joined(batches, max(1, (1 << 21) // size)):
            at = some.starts(size, stride)
            if not len(at):
                continue
            tok = np.lib.stride_tricks.sliding_window_view(table[some.bases], size)[at]
            start = some.each("at", at) - left + some.place[at]
            for strand in strands:
                got = np.asarray(scorer(complement[tok][:, ::-1] if strand == "-" else tok), float).reshape(len(at), -1)
                if head_interval is None:
                    pos, value = start + size // 2, got.mean(axis=1)
                    if totals is None:
                        yield pd.DataFrame({"contig": some.each("contig", at), "pos": pos, "strand": strand, "value": value})
                    else:
                        sums = {k: np.bincount(some.row[at], f(pos, value), len(some.rows)) for k, f in totals.items()}
                        yield pd.DataFrame({"contig": some.rows["contig"].to_numpy(), "strand": strand, "n": np.bincount(some.row[at], minlength=len(some.rows))} | sums)
                    continue
                inside = np.arange(got.shape[1]) * head_interval + head_interval // 2
                kept = (inside >= size // 4) & (inside < size - size // 4) if middle_half else np.ones(len(inside), bool)
                place = (size - 1 - inside if strand == "-" else inside)[kept]
                pos = start[:, None] + place
                yield pd.DataFrame({"contig": np.repeat(some.each("contig", at), len(place)), "pos": pos.ravel(), "strand": strand, "value": got[:, kept].ravel()})

    contig, kind = rows.schema["contig"].dataType.simpleString(), "int" if head_interval is None else "long"
    parts = chunks(rows, size, stride, offset)
    if totals is not None:
        sums = over_parts(parts, scored, f"contig {contig}, strand string, n long, {', '.join(f'{k} double' for k in totals)}")
        return sums.groupBy("contig", "strand").agg(*(F.sum(c).alias(c) for c in ("n", *totals)))
    each = over_parts(parts, scored, f"contig {contig}, pos {kind}, strand string, value double")
    return each if head_interval is None else each.groupBy("contig", "pos", "strand").agg(F.avg("value").alias("value"))


def mutation_scores(rows: DataFrame, mutants: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], size: int, chunk: int = 1 << 12) -> DataFrame:
    """contig, pos, mutant, value: mean squared change of the score over the windows that cover a substitution.

    mutants: contig, pos, mutant. Sequences meet them in chunks, and each mutation is cut out with size - 1 bases on both sides, so only
    windows over it are scored; mutations with as many bases about them go to the scorer together.
    """
    each = rows.select("contig", "seq", F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(chunk))).alias("_at"))
    first = F.greatest(F.col("_at") - size + 1, F.lit(0))
    parts = each.select("contig", F.floor(F.col("_at") / chunk).alias("_chunk"), first.alias("_first"), F.substring("seq", first + 1, F.col("_at") - first + chunk + size - 1).alias("_part"))
    j = mutants.withColumn("_chunk", F.floor(F.col("pos") / chunk)).join(parts, ["contig", "_chunk"])
    at = F.col("pos") - F.col("_first")
    lo, hi = F.greatest(at - size + 1, F.lit(0)), F.least(at + size, F.length("_part"))
    j = j.withColumn("_lo", lo).withColumn("own", F.substring("_part", (lo + 1).cast("int"), (hi - lo).cast("int"))).filter(F.length("own") >= size)
    j = j.withColumn("new", F.overlay("own", "mutant", (at - F.col("_lo") + 1).cast("int")))

    @F.pandas_udf("double")
    def change(own: pd.Series, new: pd.Series) -> pd.Series:
        table = np.full(256, 4)
        table[np.frombuffer(b"ACGT", np.uint8)] = range(4)
        out, lengths = np.empty(len(own)), own.str.len().to_numpy()
        for n in np.unique(lengths):
            which = np.flatnonzero(lengths == n)
            wins = lambda s: np.lib.stride_tricks.sliding_window_view(table[np.frombuffer("".join(s.iloc[which]).encode("ascii", "replace"), np.uint8)].reshape(-1, n), size, axis=1).reshape(-1, size)  # noqa: B023, E731
            gap = np.asarray(scorer(wins(own)), float) - np.asarray(scorer(wins(new)), float)
            out[which] = (gap**2).reshape(len(which), -1).mean(axis=1)
        return pd.Series(out)

    return j.select("contig", "pos", "mutant", change("own", "new").alias("value"))


def substitution_scores(rows: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], size: int, chunk: int = 1 << 12, *, totals: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """contig, pos, mutant, value: mean squared change of the score over the windows that cover it, for every substitution of every sequence.

    Sequences are cut in chunks with the bases around them. The windows of a chunk are scored once as they are, and once for each
    place in a window and each base, so no sequence is copied for a substitution. Sequences shorter than a window have none.

    With totals (name -> f(pos, value)): contig, mutant, n and the sums of these functions over the positions, taken inside tasks first.
    """
    table = np.full(256, 4, np.uint8)
    table[np.frombuffer(b"ACGT", np.uint8)] = range(4)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The substitutions of some chunks; these lie one after another, and windows over a border are left out."""
        for some in joined(batches, (1 << 20) // size):
            part, tok, row, place, at = some.rows, table[some.bases], some.row, some.place, some.starts(size)
            wins = np.lib.stride_tricks.sliding_window_view(tok, size)[at]
            flat = lambda x: np.asarray(x, float).reshape(len(at), -1)  # noqa: B023, E731
            own, total, count = flat(scorer(wins)), np.zeros((4, len(tok))), np.zeros(len(tok))
            for j in range(size):
                count[at + j] += 1
                new = wins.copy()
                for base in range(4):
                    new[:, j] = base
                    total[base, at + j] += ((flat(scorer(new)) - own) ** 2).mean(axis=1)
            skip = (part["at"] - part["first"]).to_numpy()[row]
            core = (place >= skip) & (place < skip + part["n"].to_numpy()[row])
            for base, mutant in enumerate("ACGT"):
                which = np.flatnonzero(core & (tok != base))
                pos, value = place[which] + part["first"].to_numpy()[row[which]], total[base, which] / count[which]
                if totals is None:
                    yield pd.DataFrame({"contig": part["contig"].to_numpy()[row[which]], "pos": pos, "mutant": mutant, "value": value})
                    continue
                n = np.bincount(row[which], minlength=len(part))
                sums = pd.DataFrame({"contig": part["contig"].to_numpy(), "mutant": mutant, "n": n} | {k: np.bincount(row[which], f(pos, value), len(part)) for k, f in totals.items()})
                yield sums[n > 0]

    each = rows.filter(F.length("seq") >= size).select("contig", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(chunk))).alias("at"))
    first, n = F.greatest(F.col("at") - size + 1, F.lit(0)), F.least(F.lit(chunk), F.length("seq") - F.col("at"))
    parts = each.select("contig", "at", first.alias("first"), n.alias("n"), F.substring("seq", first + 1, F.col("at") - first + n + size - 1).alias("part"))
    contig = rows.schema["contig"].dataType.simpleString()
    if totals is None:
        return over_parts(parts, scored, f"contig {contig}, pos long, mutant string, value double")
    sums = over_parts(parts, scored, f"contig {contig}, mutant string, n long, {', '.join(f'{k} double' for k in totals)}")
    return sums.groupBy("contig", "mutant").agg(*(F.sum(c).alias(c) for c in ("n", *totals)))


def accumulate(rows: DataFrame, signed: bool = False, low: float = 0.4, high: float = 0.6) -> DataFrame:
    """contig, pos, value: per-window arrays added onto positions, absolute, or signed by +1 above and -1 below quantiles of all values."""
    each = rows.select("contig", "win_start", F.posexplode("grads").alias("off", "g")).withColumn("g", F.col("g").cast("double"))
    v = F.abs("g")
    if signed:
        from .tracks import quantiles

        q = quantiles(each.select(F.lit(1).alias("track"), F.col("g").alias("value")), [low, high]).select("q0", "q1")
        each = each.join(q)
        v = v * F.when(F.col("g") >= F.col("q1"), 1.0).when(F.col("g") <= F.col("q0"), -1.0).otherwise(0.0)
    return each.groupBy("contig", (F.col("win_start") + F.col("off")).alias("pos")).agg(F.sum(v).alias("value"))


def offset_totals(rows: DataFrame) -> DataFrame:
    return rows.select("contig", F.posexplode("grads").alias("off", "g")).groupBy("contig", "off").agg(F.sum(F.abs(F.col("g").cast("double"))).alias("value"))


def window_means(rows: DataFrame) -> DataFrame:
    total = F.aggregate("grads", F.lit(0.0), lambda s, g: s + g.cast("double"))
    return rows.select("contig", "win_start", (total / F.size("grads")).alias("value"))


def project(rows: DataFrame) -> DataFrame:
    """rows (contig, grads: four values per base in a row, token array) with, per base, the present base's value less the mean of the four."""
    at = lambda i, b: F.element_at("grads", (i * 4 + b + 1).cast("int")).cast("double")
    value = F.transform("tok", lambda t, i: F.when(t < 4, at(i, t) - (at(i, 0) + at(i, 1) + at(i, 2) + at(i, 3)) / 4).otherwise(0.0))
    return rows.withColumn("projected", value)


def classification_report(rows: DataFrame) -> DataFrame:
    """Accuracy of each class, their mean and overall; a prediction of exactly 0.5 is wrong for both."""
    right = F.when(F.col("label"), F.col("pred") > 0.5).otherwise(F.col("pred") < 0.5).cast("double")
    a = rows.withColumn("_r", right).agg(F.avg(F.when(F.col("label"), F.col("_r"))).alias("positive"), F.avg(F.when(~F.col("label"), F.col("_r"))).alias("negative"), F.avg("_r").alias("overall"))
    return a.withColumn("mean", (F.col("positive") + F.col("negative")) / 2)


def relabel(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.withColumn("label", (F.col("pred") > threshold) & F.col("label"))


def select_by_score(rows: DataFrame, above: float | None = None, below: float | None = None) -> DataFrame:
    if above is not None:
        rows = rows.filter(F.col("pred") > above)
    return rows.filter(F.col("pred") < below) if below is not None else rows


def score_histogram(rows: DataFrame, bins: int = 100) -> DataFrame:
    """label, bin, n over equal bins of [0, 1], the last one closed; empty bins included."""
    b = F.least(F.floor(F.round(F.col("pred") * bins, 9)), F.lit(bins - 1))
    n = rows.groupBy("label", b.alias("bin")).agg(F.count("*").alias("n"))
    grid = rows.select("label").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return grid.join(n, ["label", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def training_log_summary(log: DataFrame, patience: int) -> DataFrame:
    """run, epoch, loss, val_loss of each epoch as 1 - correlation + mean absolute error, and whether it is the one `patience` before the end."""
    n = F.count("*").over(W.partitionBy("run"))
    at = F.row_number().over(W.partitionBy("run").orderBy("epoch"))
    return log.select("run", "epoch", (1 - F.col("correlate") + F.col("mae")).alias("loss"), (1 - F.col("val_correlate") + F.col("val_mae")).alias("val_loss"), (at == n - patience).alias("chosen"))


def best_epoch(log: DataFrame, column: str = "val_loss") -> DataFrame:
    return log.groupBy("run").agg(F.min_by("epoch", F.struct(column, "epoch")).alias("epoch"))
