"""Queries over sequences."""

from pyspark.sql import functions as F

from ..operators import physical, sequences as op
from .registry import query

CODED = "regexp_replace(translate(seq, 'ACGT', '0123'), '[^0-3]', '4', 'g')"
RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"


@query(f"select read_id, rpad({CODED}, 101, '4') as tokens, length(seq) <> 101 as mismatch from reads")
def encode_tokens(t):
    return t.reads.select("read_id", F.array_join(op.tokens(F.col("seq"), length=101), "").alias("tokens"), (F.length("seq") != 101).alias("mismatch"))


@query("select read_id, seq from reads")
def decode_tokens(t):
    return t.reads.select("read_id", op.decode(op.tokens(F.col("seq"))).alias("seq"))


@query("select read_id, array_to_string(list_transform(string_split(seq, ''), lambda b: concat(cast(b = 'A' as int), cast(b = 'T' as int), cast(b = 'C' as int), cast(b = 'G' as int))), ' ') as bits, seq from reads")
def one_hot_export(t):
    hot = op.one_hot(op.tokens(F.col("seq"), "ATCG"))
    return t.reads.select("read_id", op.one_hot_text(hot).alias("bits"), op.from_one_hot(hot, "ATCG").alias("seq"))


@query(f"select contig, {RC} as seq from genome")
def reverse_complement(t):
    return t.genome.select("contig", op.reverse_complement(F.col("seq")).alias("seq"))


@query("select contig, case when known > 0 then round(gc / known, 9) end as gc from (select contig, length(seq) - length(replace(seq, 'N', '')) as n, length(replace(seq, 'N', '')) as known, cast(2 * length(seq) - length(replace(seq, 'G', '')) - length(replace(seq, 'C', '')) as double) as gc from genome)")
def gc_content(t):
    return t.genome.select("contig", F.round(op.gc_content(F.col("seq")), 9).alias("gc"))


@query("with w as (select contig, cast(i as integer) as pos, substring(seq, cast(i + 1 as bigint), 5) as m from (select contig, seq, unnest(range(0, length(seq) - 4)) as i from genome)) select contig, pos, case when m = 'GATAC' then 'fwd' else 'rev' end as strand from w where m in ('GATAC', 'GTATC')")
def find_motif(t):
    return op.find_motif(t.genome, "GATAC")


@query("""with recursive g as (select contig, '+' as strand, seq from genome union all select contig, '-', reverse(translate(seq, 'ACGT', 'TGCA')) from genome),
    c as (select contig, strand, i as pos, substring(seq, cast(i + 1 as bigint), 3) as codon from (select *, unnest(range(0, length(seq) - 2)) as i from g)),
    m as (select * from c where codon in ('ATG', 'TAA', 'TAG', 'TGA')),
    s as (select *, min(case when codon <> 'ATG' then pos end) over (partition by contig, strand, pos % 3 order by pos rows between 1 following and unbounded following) + 3 as stop from m),
    f as (select contig, strand, pos as start, stop from s where codon = 'ATG' and stop is not null),
    w as (select contig, strand, min(start) as start, arg_min(stop, start) as stop from f group by 1, 2
          union all select w.contig, w.strand, min(f.start), arg_min(f.stop, f.start) from w join f on f.contig = w.contig and f.strand = w.strand and f.start >= w.stop group by 1, 2)
    select contig, strand, cast(start as integer) as start, cast(stop as integer) as stop from w""")
def find_orfs(t):
    return op.find_orfs(t.genome)


@query(f"""with p as (select contig, a, b, list_filter(range(0, length(a)), lambda i: substring(a, i + 1, 1) <> substring(b, i + 1, 1)) as d from (select contig, seq as a, {RC} as b from genome))
    select contig, array_to_string(d, ' ') as positions, cast(coalesce(d[1], length(a)) as integer) as prefix from p""")
def seq_diff(t):
    other = t.genome.select("contig", op.reverse_complement(F.col("seq")).alias("seq"))
    return op.seq_diff(t.genome, other).select("contig", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"), "prefix")


@query("""select o_orderkey as id, contig, substring(seq, cast(greatest(s - 20, 0) + 1 as bigint), cast(s - greatest(s - 20, 0) as bigint)) as left, substring(seq, cast(s + 31 as bigint), 20) as right
    from (select o_orderkey, o_custkey % n as contig, o_orderkey % 2000 as s from orders, (select count(*) as n from documents)) join genome using (contig)""")
def flank_extract(t):
    n = t.documents.count()
    sites = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % n).alias("contig"), (F.col("o_orderkey") % 2000).alias("start")).withColumn("end", F.col("start") + 30)
    return op.flanks(sites, t.genome, 20).select("id", "contig", "left", "right")


@query("select read_id, right(repeat(seq, 1 + 150 // length(seq)), 150) || seq || left(repeat(seq, 1 + 150 // length(seq)), 150) as padded, right('GGATCC', 4) || seq || left('AACCTT', 4) as flanked from reads where length(seq) > 0")
def pad_flanks(t):
    s, a, b = F.col("seq"), F.lit("AACCTT"), F.lit("GGATCC")
    return t.reads.filter(F.length("seq") > 0).select("read_id", op.pad(s, 150).alias("padded"), op.pad(s, 4, a, b, reverse=True).alias("flanked"))


@query("""with m as (select read_id as contig, seq, unnest([0, 7, 50]) as pos from reads), s as (select *, unnest([1, 2, 3]) as step, instr('ACGT', substring(seq, pos + 1, 1)) - 1 as i from m where pos < length(seq)),
    r as (select contig, pos, substring(seq, pos + 1, 1) as base, substring('ACGT', (i + step) % 4 + 1, 1) as mutant, seq from s where i >= 0)
    select contig, pos, base, mutant, left(seq, pos) || mutant || substring(seq, pos + 2) as seq from r""")
def all_mutations(t):
    at = F.filter(F.array(*map(F.lit, (0, 7, 50))), lambda i: i < F.length("seq"))
    return op.all_mutations(t.reads.withColumnRenamed("read_id", "contig"), at)


@query("""with h as (select read_id as contig, seq from reads union all select read_id, left(seq, 7) || 'A' || substring(seq, 9) from reads where length(seq) > 8),
    p as (select read_id as contig, seq, length(seq) // 2 as pos, 7 as other from reads), q as (select contig, seq, unnest([pos, other]) as pos from p), s as (select distinct contig, seq, pos, unnest([1, 2, 3]) as step, instr('ACGT', substring(seq, cast(pos + 1 as bigint), 1)) - 1 as i from q where pos < length(seq)),
    m as (select contig, pos, substring('ACGT', (i + step) % 4 + 1, 1) as mutant, seq from s where i >= 0), n as (select contig, pos, mutant, left(seq, pos) || mutant || substring(seq, cast(pos + 2 as bigint)) as seq from m)
    select contig, cast(pos as integer) as pos, mutant, (select count(*) from h where h.contig = n.contig and h.seq = n.seq) as seen, (select count(*) from h where h.contig = n.contig and substring(h.seq, cast(n.pos + 1 as bigint), 1) = n.mutant) as base_seen from n""")
def mutations_seen(t):
    """Mutations of the middle and of base 7 of every read, looked up in a history of reads and of their copies with an A there."""
    rows = physical.shared(t.reads.withColumnRenamed("read_id", "contig").select("contig", "seq"))
    at = F.filter(F.array_distinct(F.array(F.floor(F.length("seq") / 2).cast("int"), F.lit(7))), lambda i: i < F.length("seq"))
    earlier = rows.filter(F.length("seq") > 8).withColumn("seq", F.overlay("seq", F.lit("A"), F.lit(8)))
    return op.mutations_seen(rows, at, rows.union(earlier))
