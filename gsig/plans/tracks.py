"""Queries over tracks."""

from pyspark.sql import functions as F

from ..operators import tracks as op
from .registry import query


def rounded(df, digits=6, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols or ("value",)})


@query("select track, round(quantile_cont(value, 0.5), 6) as q0, round(quantile_cont(value, 0.9), 6) as q1, round(quantile_cont(value, 0.99), 6) as q2 from tracks group by 1")
def track_quantiles(t):
    return rounded(op.quantiles(t.tracks, [0.5, 0.9, 0.99]), 6, "q0", "q1", "q2")


@query("with q as (select track, quantile_cont(value, 0.99) as q from tracks group by 1) select track, sum(value) as total, round(sum(least(value, q)), 4) as clipped from tracks join q using (track) group by 1")
def track_totals(t):
    return rounded(op.totals(t.tracks), 4, "clipped")


@query("select contig, cast(value as bigint) as value, count(*) as n from tracks group by 1, 2")
def value_histogram(t):
    return op.value_histogram(t.tracks)


@query("with q as (select track, quantile_cont(value, 0.9) as q from tracks group by 1) select track, contig, pos, round(greatest(0, least(value, q)) / q, 6) as value from tracks join q using (track)")
def clipnorm(t):
    return rounded(op.clipnorm(t.tracks, 0.9))


@query("with s as (select track, avg(value) as m, stddev_pop(value) as s from tracks where contig = 'O' group by 1) select track, contig, pos, round((value - m) / s, 6) as value from tracks join s using (track)")
def z_score(t):
    return rounded(op.z_score(t.tracks, ["track"], t.tracks.filter("contig = 'O'")))


@query("with s as (select track, sum(value) as s from tracks where contig <> 'O' group by 1) select track, contig, pos, round(value * 1e6::double / s, 6) as value from tracks join s using (track)")
def cpm(t):
    return rounded(op.cpm(t.tracks, ["O"]))


@query("""select track, contig, pos, case when value > 150 or exists (select 1 from intervals_a a where a.contig = t.contig and t.pos >= a.start and t.pos < a."end" and a.score > 5) then 0 else value end as value from tracks t""")
def mask_regions(t):
    return op.mask_regions(t.tracks, t.intervals_a.filter("score > 5"), huge=150.0)


@query("select contig, pos, round(sum(value) / 3, 6) as value from tracks group by 1, 2")
def merge_replicates(t):
    return rounded(op.merge_replicates(t.tracks, 3))


@query("with p as (select contig, min(case track when 'N' then 1 when 'A' then 2 else 3 end) as p from tracks group by 1) select t.* from tracks t join p on p.contig = t.contig and p.p = case track when 'N' then 1 when 'A' then 2 else 3 end")
def pick_track(t):
    return op.pick_track(t.tracks, {"N": 1, "A": 2, "R": 3})


PAIR = "p as (select contig, pos, coalesce(sum(value) filter (track = 'R'), 0) as x, coalesce(sum(value) filter (track = 'A'), 0) as y from tracks where track in ('R', 'A') group by 1, 2)"


@query(f"with {PAIR} select contig, pos, " + ", ".join(f"round(case when x = 0 or y = 0 then 0 else {e} end, 6) as {k}" for k, e in (("ratio", "x / y"), ("log", "ln(x / y)"), ("log2", "log2(x / y)"), ("xlog", "x * ln(x / y)"), ("sqrtlog", "sqrt(x) * ln(x / y)"))) + " from p")
def track_ratio(t):
    out = None
    for kind in op.RATIOS:
        one = rounded(op.track_ratio(t.tracks, "R", "A", kind)).withColumnRenamed("value", kind)
        out = one if out is None else out.join(one, ["contig", "pos"])
    return out


@query(f"with {PAIR}, s as (select contig, pos, x = 0 or y = 0 as z, sum(x) over w / 5 as x, sum(y) over w / 5 as y from p window w as (partition by contig order by pos range between 2 preceding and 2 following)) select contig, pos, round(case when z then 0 else x - y end, 6) as value from s")
def track_ratio_smoothed(t):
    return rounded(op.track_ratio(t.tracks, "R", "A", lambda x, y: x - y, smooth=5))


@query(f"with {PAIR} select contig, pos from p where x = 0 or y = 0")
def invalid_positions(t):
    return op.invalid_positions(t.tracks, "R", "A", either=True)


@query("""with s as (select track, min(value) filter (value <> 0) as s from tracks group by 1), c as (select track, contig, pos, least(round(value / s), 40) as v from tracks join s using (track)), r as (select *, sum(v) over (partition by track, contig order by pos) as r from c)
    select track, contig, pos, floor(r / 2) - floor((r - v) / 2) as value from r""")
def signal_to_counts(t):
    return op.halved(op.to_counts(t.tracks, 40))


@query("""with s as (select contig, min(value) filter (value <> 0) as s from signal group by 1), c as (select contig, pos, least(round(value / (select min(value) filter (value <> 0) from signal)), 1e6) as v from signal),
    q as (select quantile_cont(v, 0.99) as q from c), k as (select i, exp(-0.5 * pow(i / 15.0::double, 2)) as w from (select unnest(range(-45, 46)) as i)), kn as (select i, w / (select sum(w) from k) as w from k),
    m as (select a.contig, a.pos, sum(least(b.v, q) * w) as v from c a join kn on true join c b on b.contig = a.contig and b.pos = a.pos + kn.i, q group by 1, 2)
    select contig, pos, round((v - min(v) over p) / (max(v) over p - min(v) over p), 6) as value from m window p as (partition by contig)""")
def label_pipeline(t):
    return rounded(op.label_pipeline(t.signal.withColumn("track", F.lit("s"))).drop("track"))


@query("""with c as (select contig, pos, round(value / (select min(value) filter (value <> 0) from signal)) as v from signal), r as (select *, sum(v) over (partition by contig order by pos) as r from c),
    h as (select contig, pos, floor(r / 2) - floor((r - v) / 2) as v from r), q as (select quantile_cont(v, 0.9) as q from h where v <> 0), k as (select i, exp(-0.5 * pow(i / 15.0::double, 2)) as w from (select unnest(range(-45, 46)) as i)), kn as (select i, w / (select sum(w) from k) as w from k),
    m as (select a.contig, a.pos, sum(least(b.v, q) * w) as v from h a join kn on true join h b on b.contig = a.contig and b.pos = a.pos + kn.i, q group by 1, 2), q2 as (select quantile_cont(v, 0.9) as q from m where v <> 0), p as (select contig, pos, least(v, q) as v from m, q2)
    select contig, pos, round((v - min(v) over w) / (max(v) over w - min(v) over w), 6) as value from p window w as (partition by contig)""")
def label_pipeline_postclip(t):
    """Counts of pairs, quantiles without zeros, clipped before and after smoothing."""
    return rounded(op.label_pipeline(t.signal.withColumn("track", F.lit("s")), 0.9, halve=True, remove_zero=True, postclip=True).drop("track"))


@query("""with s as (select track, min(value) filter (value <> 0) as s from tracks group by 1), c as (select contig, pos, sum(least(round(value / s), 40)) as v from tracks join s using (track) group by 1, 2),
    k as (select i, exp(-0.5 * pow(i / 3.0::double, 2)) as w from (select unnest(range(-10, 11)) as i)), kn as (select i, w / (select sum(w) from k) as w from k),
    m as (select a.contig, a.pos, sum(b.v * w) as v from c a join kn on true join c b on b.contig = a.contig and b.pos = a.pos + kn.i group by 1, 2), q as (select 1.2::double * quantile_cont(v, 0.9) as top from m)
    select contig, pos, round(least(v, top) / top, 6) as value from m, q""")
def label_replicates(t):
    """The tracks as replicates."""
    return rounded(op.label_replicates(t.tracks, 40, 21, 3.0, 0.9, 1.2))


@query("with v as (select track, contig, pos, case when value > 90 then null else value end as v, value > 90 as i from tracks), q as (select track, quantile_cont(v, 0.995) as q from v group by 1) select track, contig, pos, round(log2(case when i then q else v end + 1), 6) as value from v join q using (track)")
def log_saturating(t):
    return rounded(op.log_saturating(t.tracks.withColumn("value", F.when(F.col("value") > 90, float("inf")).otherwise(F.col("value")))))


@query("select contig, pos, round(avg(value), 6) as mean, round(exp(avg(ln(value))), 6) as geometric, max(value) as most, sum(value) as own from tracks group by 1, 2")
def combine_on_index(t):
    out = None
    for name, how in (("mean", "mean"), ("geometric", "geometric"), ("most", "max"), ("own", lambda: F.sum("value"))):
        one = rounded(op.combine(t.tracks, how)).withColumnRenamed("value", name)
        out = one if out is None else out.join(one, ["contig", "pos"])
    return out


@query("with e as (select contig || case when pos % 2 = 0 then '' else '_rev' end as c, avg(value) as v from signal group by 1) select replace(c, '_rev', '') as contig, round(avg(v), 6) as value from e group by 1")
def mean_by_contig(t):
    rows = t.signal.withColumn("contig", F.concat("contig", F.when(F.col("pos") % 2 == 0, "").otherwise("_rev")))
    return rounded(op.mean_by_contig(rows))


@query("with v as (select track, contig, pos, greatest(value - 20, 0) as value from tracks), l as (select track, min(value) filter (value <> 0) as l from v group by 1) select track, contig, pos, case when value = 0 then l else value end as value from v join l using (track)")
def clip_to_nonzero_min(t):
    return op.clip_to_least(t.tracks.withColumn("value", F.greatest(F.col("value") - 20, F.lit(0.0))))


@query("select id, label, pred, round(count(*) over () / (2.0::double * count(*) over (partition by label)), 9) as weight from preds")
def class_weights(t):
    return rounded(op.class_weights(t.preds), 9, "weight")


@query("with b as (select *, least(cast(floor(pred * 8) as bigint), 7) as b from preds) select id, label, pred as value, round(count(*) over () / (8.0::double * count(*) over (partition by b)), 9) as weight from b")
def histogram_weights(t):
    return rounded(op.histogram_weights(t.preds.withColumnRenamed("pred", "value"), 8), 9, "weight")


@query("with i as (select *, contig = 'O' and pos >= 10 and pos < 60 as i from tracks) select track, round(4 * max(value) filter (i) / median(value) filter (not i), 6) as most, round(4 * median(value) filter (i) / median(value) filter (not i), 6) as middle from i group by 1")
def copy_number_estimate(t):
    a, b = (rounded(op.copy_number(t.tracks, "O", 10, 60, 4, how), 6, "estimate") for how in ("max", "median"))
    return a.withColumnRenamed("estimate", "most").join(b.withColumnRenamed("estimate", "middle"), "track")
