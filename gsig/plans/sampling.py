"""Queries over samples and splits."""

from pyspark.sql import functions as F

from ..operators import sampling as op
from .adapters import genome_parts
from .registry import query


def counts(t):
    return t.bins.select("contig", "pos", F.col("ip_count").alias("n"))


@query()
def thin_counts(t):
    return op.thin_exact(counts(t), 0.3)


@query("select cast(round(0.3 * sum(ip_count)) as bigint) as kept, count(*) as bins from bins")
def thin_counts_total(t):
    return op.thin_exact(counts(t), 0.3).agg(F.sum("kept").alias("kept"), F.count("*").alias("bins"))


@query()
def thin_binomial(t):
    return op.thin_binomial(counts(t), [0.1, 0.5, 0.9])


@query("select l_orderkey // 100 as g, count(*) as n from lineitem group by 1")
def random_rounding(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("value"), F.col("l_extendedprice").alias("v"))
    out = op.random_rounding(rows, ["l_orderkey", "l_linenumber", "l_partkey"])
    return out.filter(F.abs(F.col("value") - F.col("v")) < 1).groupBy(F.floor(F.col("l_orderkey") / 100).alias("g")).agg(F.count("*").alias("n"))


@query("select p as part, n // 7 + cast(p < n % 7 as int) as ids from (select count(distinct qname) as n from alignments), (select unnest(range(0, 7)) as p)")
def balanced_split(t):
    return op.balanced_split(t.alignments, "qname", 7).groupBy("part").agg(F.countDistinct("qname").alias("ids"))


@query()
def sample_pairs(t):
    return op.sample_pairs(t.alignments, "qname", 0.25)


@query("select count(distinct qname) // 4 as ids from alignments")
def sample_pairs_exact(t):
    return op.sample_exact(t.alignments, "qname", 0.25).agg(F.countDistinct("qname").alias("ids"))


@query("select count(*) as n, count(*) as places, count(*) - 1 as last from orders")
def shuffle_reads(t):
    out = op.shuffle_reads(t.orders, "o_orderkey")
    return out.agg(F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.max("place").alias("last"))


@query("""with r as (select id, label, row_number() over (partition by label order by id * 7919 % 10007 / 10007.0::double, id) - 1 as r, count(*) over (partition by label) as n from preds)
    select id, label, case when r < round(n * 0.7::double) then 'train' when r < round(n * (0.7::double + 0.2::double)) then 'valid' else 'test' end as split from r""")
def train_valid_test_split(t):
    order = (F.col("id") * 7919 % 10007).cast("double") / 10007
    return op.train_valid_test(t.preds, order, 0.7, 0.2).select("id", "label", "split")


#: Reads of two sides, from three files each, with their place there.
READS = "rows as (select l_orderkey * 10 + l_linenumber as id, l_returnflag = 'R' as label, l_linenumber % 3 as file, l_orderkey as place from lineitem where l_returnflag in ('R', 'A'))"
TURNS = """t as (select id, label, row_number() over (partition by label order by {}) - 1 as turn from (select *, row_number() over (partition by label, file order by place, id) as r from rows)),
    n as (select min(n) as pairs from (select label, count(*) as n from rows group by 1)), p as (select id, label, turn * 2 + case when label then 0 else 1 end as place from t, n where turn < pairs)"""
SHARDS = "select *, case when place < 200 then 'test' when place < 300 then 'valid' else 'train' end as split, (place - case when place < 200 then 0 when place < 300 then 200 else 300 end) // 64 as shard from p"


def reads(t):
    flag = F.col("l_returnflag")
    return t.lineitem.filter(flag.isin("R", "A")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (flag == "R").alias("label"), (F.col("l_linenumber") % 3).alias("file"), F.col("l_orderkey").alias("place"))


@query(f"with {READS}, {TURNS.format('r, file')} {SHARDS}")
def interleave_shards(t):
    return op.interleave_shards(reads(t), 64, 200, 100)


@query(f"with {READS}, {TURNS.format('file, r')} {SHARDS} where place < 300 + 1000")
def interleave_shards_capped(t):
    """Files one after another, and a cap on train."""
    return op.interleave_shards(reads(t), 64, 200, 100, train=1000, alternate=False)


@query("select label, (r // 20) as epoch, count(*) as n from (select label, row_number() over (partition by label) - 1 as r from preds) group by 1, 2")
def class_balanced_sample(t):
    return op.class_balanced(t.preds, 20).groupBy("label", "epoch").agg(F.count("*").alias("n"))


@query()
def random_sequences(t):
    return op.random_sequences(t.spark, t.documents.count(), 200, op.fitted_frequencies(genome_parts(t, 2), 3))


@query("select i as id, 41 as n, 9 as a, 12 as c, 8 as t, 24 as strong from (select unnest(range(0, (select count(*) from documents))) as i)")
def strict_gc_sequences(t):
    out = op.strict_gc_sequences(t.spark, t.documents.count(), 41, 0.6)
    n = lambda x: F.regexp_count("seq", F.lit(x)).cast("long")
    return out.select("id", F.length("seq").cast("long").alias("n"), n("A").alias("a"), n("C").alias("c"), n("T").alias("t"), n("[GC]").alias("strong"))


@query("select contig, cast(c as integer) as copy, length(seq) as n, length(replace(seq, 'A', '')) as not_a from genome, (select unnest([0, 1]) as c)")
def shuffle_sequences(t):
    out = op.shuffle_sequences(t.genome, 2)
    return out.select("contig", "copy", F.length("seq").cast("long").alias("n"), F.length(F.replace("seq", F.lit("A"), F.lit(""))).cast("long").alias("not_a"))


@query("select contig, cast(length(seq) as bigint) as n, (select count(*) from (select unnest(range(1, length(seq))) as i) where substring(seq, i, 2) = 'AC') as ac from genome")
def shuffle_dinucleotides(t):
    out = op.shuffle_sequences(t.genome, 1, dinucleotides=True)
    return out.select("contig", F.length("seq").cast("long").alias("n"), F.regexp_count("seq", F.lit("AC")).cast("long").alias("ac"))


@query("""with e as (select o_custkey as id, o_orderkey as option, o_totalprice as energy from orders), m as (select *, exp((min(energy) over (partition by id) - energy) / 50000) as x from e) select id, option, energy, round(x / sum(x) over (partition by id), 8) as prob from m""")
def softmin_probabilities(t):
    rows = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("option"), F.col("o_totalprice").alias("energy"))
    return op.softmin_probabilities(rows, 50000.0).withColumn("prob", F.round("prob", 8))


@query()
def softmin_choice(t):
    rows = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("option"), F.col("o_totalprice").alias("energy"))
    return op.softmin_choice(rows, 50000.0)
