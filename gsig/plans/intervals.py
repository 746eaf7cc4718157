"""Queries over intervals."""

from pyspark.sql import functions as F

from ..operators import intervals as op, windows
from .registry import query

DAYS = """days as (select contig, pos, value from (select 'O' as contig, l_partkey as pos, sum(l_quantity) as value from lineitem where l_linestatus = 'O' group by 2 union all select 'F', l_partkey, sum(l_quantity) from lineitem where l_linestatus <> 'O' group by 2))"""


def days(t):
    return t.lineitem.groupBy(F.when(F.col("l_linestatus") == "O", "O").otherwise("F").alias("contig"), F.col("l_partkey").alias("pos")).agg(F.sum("l_quantity").alias("value"))


PEAKS = """a as (select contig, pos, pos - lag(pos) over (partition by contig order by pos) as gap from signal where value > 5000), r as (select *, sum(case when gap <= 3 then 0 else 1 end) over (partition by contig order by pos) as run from a),
    p as (select contig, min(pos) as start, max(pos) + 1 as "end" from r group by contig, run)"""


@query(f"with {PEAKS} select * from p where \"end\" - start >= 3")
def find_peaks(t):
    return op.find_peaks(t.signal, 5000, 2, 3, block=64)


@query("""select id, contig, greatest(start, 200) as start, least("end", 900) as "end", score from intervals_a where start < 900 and "end" > 200""")
def clip_intervals(t):
    return op.clip_intervals(t.intervals_a, 200, 900)


CLOSED = 'exists (select 1 from intervals_b b where b.contig = a.contig and a.start <= b."end" + 2 and b.start <= a."end" + 2)'


@query(f"select a.* from intervals_a a where {CLOSED}")
def interval_overlap(t):
    return op.overlapping(t.intervals_a, t.intervals_b, 2)


@query(f"select a.* from intervals_a a where not {CLOSED}")
def interval_no_overlap(t):
    return op.overlapping(t.intervals_a, t.intervals_b, 2, keep=False)


@query('select count(*) as n, count(*) filter (h) as overlapping, round(count(*) filter (h) * 100.0::double / count(*), 6) as percent from (select exists (select 1 from intervals_b b where b.contig = a.contig and a.start <= b."end" and b.start <= a."end") as h from intervals_a a)')
def interval_overlap_summary(t):
    return op.overlap_summary(t.intervals_a, t.intervals_b).withColumn("percent", F.round("percent", 6))


def merged(table, tol):
    test = f'start {"<=" if tol else "<"} max("end") over (partition by contig order by start, "end" rows between unbounded preceding and 1 preceding)'
    return f'(select contig, min(start) as start, max("end") as "end" from (select *, sum(n) over (partition by contig order by start, "end" rows unbounded preceding) as g from (select *, case when {test} then 0 else 1 end as n from {table})) group by contig, g)'


@query("select * from " + merged("intervals_a", 1))
def self_overlap_merge(t):
    return op.merge(t.intervals_a, 1, span=100)


@query('select id, contig, start, "end", score from (select *, lead(start) over (partition by contig order by start, "end", id) as n from intervals_a) where "end" > n - 1')
def self_overlaps(t):
    from pyspark.sql import Window as W

    nxt = F.lead("start").over(W.partitionBy("contig").orderBy("start", "end", "id"))
    return t.intervals_a.withColumn("_n", nxt).filter(F.col("end") > F.col("_n") - 1).drop("_n")


@query("with a as " + merged("intervals_a", 0) + ", b as " + merged("intervals_b", 0) + """, s as (select cast((select sum("end" - start) from a) as bigint) as bases_a, cast((select sum("end" - start) from b) as bigint) as bases_b,
    cast((select sum(least(a."end", b."end") - greatest(a.start, b.start)) from a join b on a.contig = b.contig and a.start < b."end" and b.start < a."end") as bigint) as shared)
    select *, round(shared * 100.0::double / bases_a, 6) as percent_a, round(shared * 100.0::double / bases_b, 6) as percent_b from s""")
def base_overlap(t):
    return op.base_overlap(t.intervals_a, t.intervals_b).withColumns({c: F.round(c, 6) for c in ("percent_a", "percent_b")})


@query('select "end" - start as length, count(*) as n from intervals_a group by 1')
def interval_lengths(t):
    return op.interval_lengths(t.intervals_a)


@query("""with g as (select contig, unnest(range(0, (m // 10) + 1)) as bin from (select contig, max("end") as m from intervals_a group by 1)) select *, exists (select 1 from intervals_a a where a.contig = g.contig and a.start < g.bin * 10 + 10 and a."end" > g.bin * 10) as marked from g""")
def mark_bins(t):
    lengths = t.intervals_a.groupBy("contig").agg((F.max("end") + 1).alias("length"))
    return op.mark_bins(windows.grid(lengths, 10), t.intervals_a, 10)


@query(f'with tr as (select * from tracks) select id, track, sum(value) as total from intervals_a a join tr t on a.contig = t.contig and t.pos >= a.start and t.pos < a."end" group by 1, 2')
def interval_signal(t):
    return op.interval_signal(t.intervals_a, t.tracks)


@query("""with q as (select track, quantile_cont(value, 0.99) as top from tracks group by 1), c as (select id, contig, (start + "end") // 2 - 15 as s from intervals_a)
    select id, t.track, round(sum(least(value, top)), 4) as total from c join tracks t on c.contig = t.contig and t.pos >= s and t.pos < s + 30 join q on q.track = t.track group by 1, 2""")
def interval_signal_clipped(t):
    return op.interval_signal(t.intervals_a, t.tracks, centred=30, clip=0.99).withColumn("total", F.round("total", 4))


@query("""with i as (select id, track, sum(value) as total from intervals_a a join tracks t on a.contig = t.contig and t.pos >= a.start and t.pos < a."end" group by 1, 2), s as (select track, sum(value) as a from tracks group by 1),
    p as (select track, sum(c) as sum, avg(c) as mean, stddev_samp(c) as std, count(*) as n from (select i.track, total * 1e6 / a as c from i join s using (track)) group by 1)
    select track, round(sum, 3) as sum, round(mean, 4) as mean, round(std, 4) as std, n, round(log2((select sum from p where track = 'R') / (select sum from p where track = 'A')), 8) as log2_fold, round((select sum from p where track = 'R') * 100 / (select sum from p where track = 'A'), 6) as percent from p""")
def interval_enrichment(t):
    totals = t.tracks.groupBy("track").agg(F.sum("value").alias("total"))
    out = op.interval_enrichment(op.interval_signal(t.intervals_a, t.tracks), totals, "R", "A")
    return out.withColumns({c: F.round(c, d) for c, d in (("sum", 3), ("mean", 4), ("std", 4), ("log2_fold", 8), ("percent", 6))})


@query("""with w as (select *, lead(start) over o as ns, lead("end") over o as ne, lag(start) over o as ps, lag("end") over o as pe from intervals_a window o as (partition by contig order by start, "end", id))
    select id, contig, start, "end", score from w where not coalesce(ns < "end" and "end" - start >= ne - ns, false) and not coalesce(pe > start and "end" - start > pe - ps, false)""")
def resolve_nested_matches(t):
    return op.resolve_nested(t.intervals_a)


@query("""with w as (select *, lead(start) over o as s2, lead("end") over o as e2 from intervals_a window o as (partition by contig order by start, "end", id)), f as (select * from w where s2 < "end"),
    c as (select id, contig, start as s, "end" as e from f union all select id, contig, start, e2 from f union all select id, contig, s2, "end" from f union all select id, contig, s2, e2 from f)
    select contig, id, s as start, e as "end" from c where e > s qualify row_number() over (partition by id order by e - s, s, e) = 1""")
def crossed_matches(t):
    return op.crossed(t.intervals_a)


@query("""with l as (select contig, max("end") as length from intervals_a group by 1), h as (select a.*, length, greatest(10, cast(ceil((50 - ("end" - start)) / 2.0) as bigint)) as h from intervals_a a join l using (contig)),
    e as (select *, start - h as s, "end" + h as e from h), f as (select *, case when s < 0 then -s when e > length then length - e else 0 end as k from e)
    select id, contig, greatest(0, s + k) as start, least(length, e + k) as "end", score from f""")
def extend_intervals(t):
    lengths = t.intervals_a.groupBy("contig").agg(F.max("end").alias("length"))
    return op.extend(t.intervals_a, lengths, 10, 50)


@query(f'with {DAYS} select id, round(avg(value), 6) as mean, count(*) as n from intervals_a a join days d on a.contig = d.contig and d.pos >= a.start and d.pos < a."end" group by 1')
def interval_features(t):
    return op.interval_features(t.intervals_a, days(t)).withColumn("mean", F.round("mean", 6))


@query(f"""with {DAYS}, c as (select id, contig, (start + "end") // 2 as m from intervals_a) select pos - m as offset, round(avg(value), 6) as mean, count(*) as n from c join days d on c.contig = d.contig and d.pos between m - 12 and m + 12 group by 1""")
def metaprofile(t):
    return op.metaprofile(t.intervals_a, days(t), 12).withColumn("mean", F.round("mean", 6))


@query(f"""with {DAYS}, r as (select id, pos - start as o, value from intervals_a a join days d on a.contig = d.contig and d.pos between start - 8 and start + 8), m as (select o, avg(value) as mean from r group by 1)
    select id, round(corr(value, mean), 6) as corr from r join m using (o) group by 1 having count(*) > 2""")
def profile_correlation(t):
    rows = op.anchored(t.intervals_a, days(t), 8, "start", 64).groupBy("id").count().filter("count > 2")
    return op.profile_correlation(t.intervals_a, days(t), 8, "start").join(rows, "id", "left_semi").withColumn("corr", F.round("corr", 6))
