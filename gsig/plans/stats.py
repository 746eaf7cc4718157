"""Queries over tests, correlations and models."""

from pyspark.sql import functions as F

from ..operators import stats as op, windows
from .registry import query

#: Binomial tails by log-gamma terms, ranks and q values, over a relation b(…, ip_count, ctrl_count).
def tail(name, count):
    """name(k, n, pval): the chance of k or more of n, for the distinct pairs of b."""
    return f"""{name} as (select k, n, case when k = 0 then 1 else least(1, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))) end as pval
    from (select k, n, p, unnest(range(k, n + 1)) as i from (select distinct {count} as k, ip_count + ctrl_count as n from b), (select cast(sum({count}) as double) / sum(ip_count + ctrl_count) as p from b)) group by k, n)"""


TAIL = tail("t", "ip_count")
TESTED = "x as (select b.*, pval from b join t on b.ip_count = t.k and b.ip_count + b.ctrl_count = t.n)"
BH = "q as (select *, least(1, min(pval * m / r) over (order by pval desc range between unbounded preceding and current row)) as qval from (select *, count(*) over () as m, count(*) over (order by pval range between unbounded preceding and current row) as r from x))"


def rounded(df, digits=8, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(f"with b as (select * from bins), {TAIL}, {TESTED} select contig, pos, ip_count, ctrl_count, round(pval, 8) as pval from x")
def binom_pvalue(t):
    return rounded(op.binom_pvalue(t.bins), 8, "pval")


@query("with x as (select o_orderkey as id, cast(o_custkey * 7919 % 10007 as double) / 10007 as pval from orders), " + BH + " select id, round(pval, 8) as pval, round(qval, 8) as qval from q")
def fdr_bh(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), ((F.col("o_custkey") * 7919 % 10007).cast("double") / 10007).alias("pval"))
    return rounded(op.fdr_bh(rows), 8, "pval", "qval")


FULL = "round(pval, 8) as pval, round(qval, 8) as qval, round(-log10(pval), 6) as log_p, round(-log10(qval), 6) as log_q, qval < 0.5 as significant"


def shown(df):
    return rounded(rounded(df, 8, "pval", "qval"), 6, "log_p", "log_q")


@query(f"with b as (select * from bins), {TAIL}, {TESTED}, {BH} select contig, pos, ip_count, ctrl_count, {FULL} from q")
def enrichment(t):
    return shown(op.enrichment(t.bins, 0.5))


def fragment_lengths(t):
    return t.fragments.groupBy("contig").agg((F.max("end") + 1).alias("length"))


@query(f"""with l as (select contig, max("end") + 1 as length from fragments group by 1), g as (select contig, unnest(range(0, cast(ceil(length / 25.0) as bigint))) as bin from l),
    c as (select contig, (start + "end") // 2 // 25 as bin, count(*) filter (sample = 'R') as i, count(*) filter (sample = 'A') as c from fragments group by 1, 2),
    b as (select g.contig, g.bin, coalesce(i, 0) as ip_count, coalesce(c, 0) as ctrl_count from g left join c on g.contig = c.contig and g.bin = c.bin), {TAIL}, {TESTED}, {BH} select contig, bin, ip_count, ctrl_count, {FULL} from q""")
def genome_enrichment(t):
    f = t.fragments
    return shown(op.genome_enrichment(f.filter("sample = 'R'"), f.filter("sample = 'A'"), fragment_lengths(t), 25, alpha=0.5))


@query(f"with b as (select contig, pos, 2 * ip_count as ip_count, 2 * ctrl_count as ctrl_count from bins), {TAIL}, {TESTED}, {BH} select contig, pos, cast(ip_count as bigint) as ip_count, cast(ctrl_count as bigint) as ctrl_count, {FULL.replace('0.5', '0.05')} from q")
def pool_experiments(t):
    return shown(op.pool_experiments(t.bins, t.bins))


@query("""with s as (select *, ip_count / (select sum(ip_count) from bins) as ip_share, ctrl_count / (select sum(ctrl_count) from bins) as ctrl_share from bins)
    select contig, pos, ip_count, ctrl_count, round(ip_share, 9) as ip_share, round(ctrl_share, 9) as ctrl_share, round(case when ctrl_count = 0 then 0 else ip_share / ctrl_share end, 6) as ratio from s""")
def compare_coverage(t):
    return rounded(rounded(op.compare_coverage(t.bins), 9, "ip_share", "ctrl_share"), 6, "ratio")


FLAGS = "f as (select contig, pos, ip_count > ctrl_count as b1, ip_count > 3 as b2, ctrl_count > 3 as b3 from bins)"


def flags(t):
    return t.bins.select("contig", "pos", (F.col("ip_count") > F.col("ctrl_count")).alias("b1"), (F.col("ip_count") > 3).alias("b2"), (F.col("ctrl_count") > 3).alias("b3"))


@query(f"with {FLAGS}, a as (select *, cast(b1 as int) + cast(b2 as int) + cast(b3 as int) as agreeing from f) select size, agreeing, count(*) as n from (select 'b1' as size, agreeing, b1 as x from a union all select 'b2', agreeing, b2 from a union all select 'b3', agreeing, b3 from a) where x group by 1, 2")
def significance_coincidence(t):
    return op.coincidence(flags(t), ["b1", "b2", "b3"])


@query(f"with {FLAGS} select b1, b2, b3, count(*) as n from f group by 1, 2, 3")
def flag_patterns(t):
    return op.flag_patterns(flags(t), ["b1", "b2", "b3"])


@query(f"with {FLAGS} select contig, count(*) filter (b1 and not coalesce(l, false)) as clusters from (select *, lag(b1) over (partition by contig order by pos) as l from f) group by 1")
def count_clusters(t):
    return op.count_clusters(flags(t), ["contig"], "b1")


BOTH = """x as (select b.*, t.pval as p1, t2.pval as p2 from b join t on b.ip_count = t.k and b.ip_count + b.ctrl_count = t.n join t2 on b.ctrl_count = t2.k and b.ip_count + b.ctrl_count = t2.n),
    r as (select *, count(*) over () as m, count(*) over (order by p1 range between unbounded preceding and current row) as r1, count(*) over (order by p2 range between unbounded preceding and current row) as r2 from x),
    q as (select *, min(p1 * m / r1) over (order by p1 desc range between unbounded preceding and current row) < 0.6 as i, min(p2 * m / r2) over (order by p2 desc range between unbounded preceding and current row) < 0.6 as c from r),
    f as (select *, i and not coalesce(lag(i) over w and lag(pos) over w = pos - 1, false) as i_start, c and not coalesce(lag(c) over w and lag(pos) over w = pos - 1, false) as c_start from q window w as (partition by contig order by pos))"""


@query(f"""with b as (select contig, pos // 4 as pos, cast(sum(ip_count) as bigint) as ip_count, cast(sum(ctrl_count) as bigint) as ctrl_count from bins group by 1, 2 having sum(ip_count + ctrl_count) > 0), {TAIL}, {tail("t2", "ctrl_count")}, {BOTH}
    select 4 as binsize, 1.0::double as frac, count(*) as n, cast(sum(ip_count) as bigint) as ip_cov, cast(sum(ctrl_count) as bigint) as ctrl_cov, count(*) filter (i) as ip, count(*) filter (c) as ctrl, count(*) filter (not i and not c) as undetermined,
    count(*) filter (i_start) as ip_clusters, count(*) filter (c_start) as ctrl_clusters from f""")
def saturation_full(t):
    return op.saturation(t.bins, [4], [1.0], alpha=0.6)


@query()
def saturation(t):
    return op.saturation(t.bins, [1, 4, 16], [0.25, 0.5, 1.0])


@query()
def saturation_percent(t):
    return op.saturation_percent(op.saturation(t.bins, [1, 4, 16], [0.25, 0.5, 1.0]))


CORR = "select contig, a, b, round(corr(x, y), 6) as corr from (select p.contig, p.track as a, q.track as b, p.value as x, q.value as y from {0} p join {0} q on p.contig = q.contig and p.pos = q.pos and p.track < q.track) group by 1, 2, 3"


@query("with m as (select track, contig, pos // 5 as pos, avg(value) as value from tracks group by 1, 2, 3) " + CORR.format("m"))
def pearson_by_contig(t):
    return rounded(op.pearson_by_contig(t.tracks, 5), 6, "corr")


@query("with m as (select track, contig, pos, rank() over w + (count(*) over (partition by track, contig, value) - 1) / 2.0::double as value from tracks window w as (partition by track, contig order by value)) " + CORR.format("m"))
def spearman_by_contig(t):
    return rounded(op.spearman_by_contig(t.tracks), 6, "corr")


@query("select l_linestatus as contig, round(corr(l_quantity, l_extendedprice), 6) as corr from lineitem where cast(l_quantity as int) % 5 <> 0 group by 1")
def nan_pearson(t):
    rows = t.lineitem.withColumn("q", F.when(F.col("l_quantity").cast("int") % 5 == 0, float("nan")).otherwise(F.col("l_quantity")))
    return rounded(op.nan_pearson(rows.withColumnRenamed("l_linestatus", "contig"), ["contig"], "q", "l_extendedprice"), 6, "corr")


DAYS = "x as (select contig, pos, value from tracks where track = 'N'), y as (select contig, pos, value from tracks where track = 'R')"


@query(f"with {DAYS} select x.contig, cast(y.pos - x.pos as integer) as offset, round(corr(x.value, y.value), 6) as corr from x join y on x.contig = y.contig and y.pos - x.pos between -3 and 3 group by 1, 2")
def lagged_correlation(t):
    x, y = (t.tracks.filter(F.col("track") == k) for k in "NR")
    return rounded(op.lagged_correlation(x, y, list(range(-3, 4))), 6, "corr")


@query(f"with {DAYS}, s as (select x.contig, cast(y.pos - x.pos as integer) as lag, sum(x.value * y.value) as s from x join y on x.contig = y.contig and y.pos - x.pos between -5 and 5 group by 1, 2) select contig, arg_max(lag, s * 1000 + lag) as lag from s group by 1")
def best_lag(t):
    x, y = (t.tracks.filter(F.col("track") == k) for k in "NR")
    return op.best_lag(x, y, list(range(-5, 6)))


@query("""with s as (select contig, pos // 100 as block, pos, sum(value) over (partition by contig order by pos range between 4 preceding and 3 following) / 8 as value from signal),
    st as (select contig, block, avg(value) as m, count(*) as n, var_pop(value) as v from s group by 1, 2 having count(*) >= 80), c as (select s.contig, s.block, pos, value - m as value, n, v from s join st on s.contig = st.contig and s.block = st.block),
    r as (select a.contig, a.block, b.pos - a.pos as lag, round(sum(a.value * b.value) / any_value(a.n * a.v), 9) as r from c a join c b on a.contig = b.contig and a.block = b.block and b.pos - a.pos between 10 and 29 group by 1, 2, 3),
    p as (select contig, block, cast(lag as integer) as lag from r qualify row_number() over (partition by contig, block order by r desc, lag) = 1) select contig, block, case when lag > 10 and lag < 29 then lag end as period from p""")
def autocorr_period(t):
    return op.autocorr_period(t.signal, 100, 80, (10, 30))


@query("select l_linestatus as contig, round(sum(least(abs(a), abs(b)) * case when sign(a) = sign(b) then 1.0::double else -1 end) / sum(greatest(abs(a), abs(b))), 6) as jaccard from (select l_linestatus, l_quantity - 25 as a, l_discount * 100 - 5 as b from lineitem) group by 1")
def continuous_jaccard(t):
    rows = t.lineitem.select(F.col("l_linestatus").alias("contig"), (F.col("l_quantity") - 25).alias("a"), (F.col("l_discount") * 100 - 5).alias("b"))
    return rounded(op.continuous_jaccard(rows, ["contig"], "a", "b"), 6, "jaccard")


@query("with e as (select l_linestatus as contig, avg(abs(l_quantity - l_discount)) as mae, sqrt(avg(pow(l_quantity - l_discount, 2))) as rmse, corr(l_quantity, l_discount) as corr from lineitem group by 1) select contig, round(mae, 6) as mae, round(rmse, 6) as rmse, round(corr, 6) as corr, round(1 - corr + mae, 6) as loss from e")
def profile_error(t):
    return rounded(op.profile_error(t.lineitem.withColumnRenamed("l_linestatus", "contig"), ["contig"], "l_quantity", "l_discount"), 6, "mae", "rmse", "corr", "loss")


@query("select l_linestatus as contig, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem group by 1")
def linear_models(t):
    return rounded(rounded(op.line_fit(t.lineitem.withColumnRenamed("l_linestatus", "contig"), ["contig"], "l_quantity", "l_extendedprice"), 4, "slope"), 3, "intercept")


@query("select l_orderkey as id, l_linenumber as line, l_quantity as q, round(a + b * l_quantity, 2) as prediction from lineitem, (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from lineitem)")
def linear_predictions(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("q"), "l_extendedprice")
    model = op.least_squares(rows.select("q", "l_extendedprice"), ["q"], "l_extendedprice")
    return rounded(model.transform(rows), 2, "prediction").select("id", "line", "q", "prediction")


@query("""with n as (select least(cast(floor(pred * 50) as bigint), 49) as b, count(*) filter (label) as t, count(*) filter (not label) as f from preds group by 1), c as (select b, sum(t) over w as ct, sum(f) over w as cf, sum(t) over () as tt, sum(f) over () as ff from n window w as (order by b)),
    a as (select b, cast(cf + tt - ct as double) / (tt + ff) as r from c) select (b + 1) / 50.0::double as threshold, round(greatest(r, 1 - r), 9) as accuracy, r >= 0.5 as above from a order by greatest(r, 1 - r) desc, b limit 1""")
def best_threshold(t):
    return rounded(op.best_threshold(t.preds, 50), 9, "accuracy")
