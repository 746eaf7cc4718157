"""Queries over reads."""

from pyspark.sql import functions as F

from ..operators import reads as op
from .adapters import _SEQ, READ, as_bases
from .registry import query




@query("select * from reads where length(seq) - length(replace(seq, 'N', '')) + 101 - length(seq) <= 20")
def filter_n_reads(t):
    return op.filter_n_reads(t.reads, 20, READ)


SIXES = "with p as (select contig as read_id, substring(seq, cast(k * 6 + 1 as bigint), 6) as seq from (select contig, seq, unnest(range(0, greatest(1, (length(seq) + 5) // 6))) as k from genome))"


def sixes(t):
    return op.chunk_reads(t.genome.withColumnRenamed("contig", "read_id"), 6).drop("piece")


@query(f"{SIXES} select * from p where length(seq) >= 6 and seq not like '%N%'")
def filter_n_reads_strict(t):
    return op.filter_n_reads(sixes(t), 0, 6)


@query(f"{SIXES} select * from p where length(seq) = 6 and seq not like '%N%'")
def filter_full_reads(t):
    return op.full_reads(sixes(t), 6)


@query("""with p as (select read_id, seq, substring(seq, 1, 60) as a, substring(seq, 42, 60) as b from (select read_id, replace(seq, 'N', 'A') as seq from reads)),
    ok as (select read_id from p where length(a) = 60 and length(b) = 60 and a not like '%N%' and b not like '%N%')
    select read_id, a as seq, 1 as mate from p where read_id in (select read_id from ok) union all select read_id, b, 2 from p where read_id in (select read_id from ok)""")
def filter_full_read_pairs(t):
    r = t.reads.withColumn("seq", F.replace("seq", F.lit("N"), F.lit("A")))
    first, second = (r.select("read_id", F.substring("seq", at, 60).alias("seq")) for at in (1, 42))
    return op.full_read_pairs(first, second, 60)


@query("select sample, cast(length(seq) as integer) as length, count(*) as n from reads group by 1, 2")
def read_length_histogram(t):
    return op.length_histogram(t.reads, "sample")


@query("select seq, count(*) as n from reads group by 1")
def duplicate_counts(t):
    return op.duplicate_counts(t.reads)


@query("select n as copies, count(*) as n_seqs from (select count(*) as n from reads group by seq) group by 1")
def duplicate_levels(t):
    return op.duplicate_levels(t.reads)


@query("select distinct seq from reads")
def dedup_reads(t):
    return op.dedup_reads(t.reads)


@query("""select sample, contig, start, "end", mapq, is_reverse from (select *, row_number() over (partition by contig, start, "end" order by mapq, sample, is_reverse) as n from fragments) where n <= 2""")
def cap_duplicates(t):
    return op.cap_duplicates(t.fragments, ["contig", "start", "end"], ["mapq", "sample", "is_reverse"], 2)


@query(f"with p as (select {_SEQ} as s from conversations where text is not null), q as (select distinct substring(s, cast(k * {READ} + 1 as bigint), {READ}) as seq from (select s, unnest(range(0, greatest(1, (length(s) + {READ - 1}) // {READ}))) as k from p)), f as (select seq, count(*) as n from reads group by 1) select q.seq, coalesce(n, 0) as n from q left join f on q.seq = f.seq")
def probe_lookup(t):
    probes = op.chunk_reads(t.conversations.filter("text is not null").select(F.col("conv_id").alias("read_id"), as_bases(F.col("text")).alias("seq")), READ)
    return op.probe_lookup(t.reads, probes)


@query(f"with p as (select {_SEQ} as s from benchmark), q as (select distinct substring(s, cast(k * {READ} + 1 as bigint), {READ}) as seq from (select s, unnest(range(0, greatest(1, (length(s) + {READ - 1}) // {READ}))) as k from p)), f as (select seq, count(*) as n from reads group by 1) select q.seq, coalesce(n, 0) as n from q left join f on q.seq = f.seq")
def probe_lookup_whole(t):
    probes = op.chunk_reads(t.benchmark.select(F.col("item_id").alias("read_id"), as_bases(F.col("text")).alias("seq")), READ)
    return op.probe_lookup(t.reads, probes)


@query("select * from reads where seq in (select seq from reads group by 1 having count(*) > 1)")
def select_by_sequence(t):
    return op.select_by_sequence(t.reads, op.duplicate_counts(t.reads).filter("n > 1"))


@query("select * from alignments where qname in (select o_orderkey from orders where o_orderpriority like '1%')")
def select_by_id(t):
    names = t.orders.filter(F.col("o_orderpriority").startswith("1")).select(F.concat(F.lit("@"), F.col("o_orderkey").cast("string"), F.lit(" extra")).alias("name"))
    return op.select_by_id(t.alignments, names, "qname")


@query("select * from alignments where qname not in (select o_orderkey from orders where o_orderpriority like '1%')")
def reject_by_id(t):
    names = t.orders.filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").cast("string").alias("name"))
    return op.select_by_id(t.alignments, names, "qname", keep=False)


@query("select contig as read_id, cast(k as integer) as piece, substring(seq, cast(k * 101 + 1 as bigint), 101) as seq from (select contig, seq, unnest(range(0, greatest(1, (length(seq) + 100) // 101))) as k from genome)")
def chunk_reads(t):
    return op.chunk_reads(t.genome.withColumnRenamed("contig", "read_id"), READ)


@query("select sample, count(*) filter (contains(seq, 'GATTA')) as hits, count(*) as reads from reads group by 1")
def adapter_hits(t):
    return op.adapter_hits(t.reads, "GATTA", "sample")


@query("select unnest(['A','C','G','T','N']) as base, unnest([a, c, g, t, n]) as n from (select " + ", ".join(f"cast(sum(length(seq) - length(replace(seq, '{b}', ''))) as bigint) as {b.lower()}" for b in "ACGTN") + " from genome)")
def base_composition(t):
    return op.base_composition(t.genome)


@query("select qname, contig, count(*) as hits, cast(sum(count(*)) over (partition by qname) as bigint) as total from alignments group by 1, 2")
def hits_by_contig(t):
    return op.hits_by_contig(t.alignments)


@query("select mapq, count(*) as n from alignments group by 1 order by 1")
def mapq_histogram(t):
    return op.mapq_histogram(t.alignments)


@query("select pos, value, 'chr_' || contig as contig from signal where contig <> (select min(contig) from signal)")
def rename_contigs(t):
    first = t.events.agg(F.min("event_type").alias("m"))
    names = t.events.select(F.col("event_type").alias("from")).distinct().join(first).select("from", F.when(F.col("from") == F.col("m"), "").otherwise(F.concat(F.lit("chr_"), "from")).alias("to"))
    return op.rename_contigs(t.signal, names)


#: The signs of roman numerals by digit.
NUMERALS = """numerals as (select n, repeat('M', n // 1000)
    || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][n % 1000 // 100 + 1]
    || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][n % 100 // 10 + 1]
    || ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1] as r from (select unnest(range(1, 4000)) as n))"""


@query(f"with {NUMERALS} select p_partkey, r as roman, cast(n as integer) as arabic, 'chr' || lpad(cast(n as varchar), cast(greatest(2, length(cast(n as varchar))) as integer), '0') as padded from part join numerals on p_partkey % 3999 + 1 = n")
def roman_contigs(t):
    n = F.col("p_partkey") % 3999 + 1
    rows = t.part.select("p_partkey", op.roman(n).alias("roman"), n.alias("n"))
    padded = F.when(F.col("n") < 100, op.padded_contig(F.col("n"))).otherwise(F.concat(F.lit("chr"), F.col("n").cast("string")))
    return rows.select("p_partkey", "roman", op.arabic(F.col("roman")).alias("arabic"), padded.alias("padded"))


@query("select * from signal where not (contig in ('click') or contig like 'p%')")
def drop_contigs(t):
    return op.drop_contigs(t.signal, ["click"], prefix="p")
