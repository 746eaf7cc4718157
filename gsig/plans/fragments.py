"""Queries over alignments and fragments."""

from pyspark.sql import functions as F

from ..operators import fragments as op
from .registry import query


@query('select contig, start, start + tlen as "end" from alignments where tlen > 0 and tlen <= 1200 and mapq >= 10')
def fragments_from_alignments(t):
    return op.from_alignments(t.alignments, most=1200, least_mapq=10)


@query('select contig, start, start + 150 as "end" from alignments where mapq >= 20')
def fragments_single(t):
    return op.from_alignments(t.alignments, paired=False, length=150, least_mapq=20)


@query("select count(*) filter (not (tlen > 0 and tlen <= 1200 and mapq >= 10)) as rejected, count(*) as total from alignments")
def fragments_rejected(t):
    return op.rejected(t.alignments, 1200, 10)


@query("""select qname, contig, min(start) filter (not is_reverse) as start1, min("end") filter (not is_reverse) as end1, min(start) filter (is_reverse) as start2, min("end") filter (is_reverse) as end2
    from alignments group by 1, 2 having count(*) filter (is_reverse) = 1 and count(*) filter (not is_reverse) = 1""")
def pair_mates(t):
    return op.pair_mates(t.alignments)


@query("""select contig, start - 100 as first, "end" - 101 as last, case when flag & 128 <> 0 then '-' else '+' end as strand from alignments where start >= 100 and "end" <= 1900""")
def fragment_ends(t):
    return op.ends(t.alignments, 100, 1900, relative=True)


@query("""with f as (select contig, ((start - 12) % 167 + 167) % 167 as a, (("end" - 12) % 167 + 167) % 167 as b from alignments) select contig, a as first, b + cast(greatest(0, ceil((a + 50 - b) / 167.0)) as bigint) * 167 as last from f""")
def repeat_fold(t):
    return op.fold_fragments(t.alignments, 12, 167, 50)


@query("""select contig, pos, cast(sum(s) as bigint) as starts, cast(sum(e) as bigint) as ends from (select contig, start as pos, 1 as s, 0 as e from fragments union all select contig, "end" - 1, 0, 1 from fragments) group by 1, 2""")
def fragment_end_histogram(t):
    return op.end_histogram(t.fragments)


@query("""with h as (select "end" - start as length, count(*) as n from fragments group by 1) select *, length = (select length from h order by n desc, length limit 1) as is_mode from h""")
def fragment_length_histogram(t):
    return op.length_histogram(t.fragments)


@query("""select contig, start + (tlen - 2 - tlen % 2) // 2 + tlen % 2 as start, start + (tlen - 2 - tlen % 2) // 2 + tlen % 2 + 2 + tlen % 2 as "end" from alignments where not is_reverse and tlen between 130 and 900""")
def center_fragments(t):
    return op.centres(t.alignments, 130, 900)


@query("""select contig, start + tlen // 2 as start, start + tlen // 2 + 1 as "end" from (select distinct contig, start, tlen from alignments where not is_reverse and tlen > 0)""")
def midpoint_fragments(t):
    return op.midpoints(t.alignments, skip_duplicates=True)


SPLICED = """b as (select *, row_number() over () as r, flag & 16 <> 0 as rev, start + n // 2 as mid, "end" + 10 as last from (select *, "end" - start as n from alignments)),"""
CUT = """c as (select r, qname, contig, unnest((case when rev then list_reverse(p) else p end)[{}]) as pos from e), i as (select *, pos - row_number() over (partition by r order by pos) as g from c)
    select qname, contig, min(pos) as start, max(pos) + 1 as "end" from i group by r, qname, contig, g"""


def spliced(t):
    """Each alignment in two halves, the second 10 bases further."""
    half = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2)
    block = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    return t.alignments.withColumn("blocks", F.filter(F.array(block(F.col("start"), half), block(half + 10, F.col("end") + 10)), lambda b: b["start"] < b["end"]))


@query(f"with {SPLICED} e as (select r, qname, contig, rev, list_concat(range(start, mid), range(mid + 10, last)) as p from b), {CUT.format('5:25')}")
def offset_fragments(t):
    return op.offsets(spliced(t), 5, 25)


@query(f"""with {SPLICED} f as (select * exclude (rev, flag), xor(flag, case when mapq % 3 = 0 then 48 else 0 end) as flag from b), x as (select *, flag & 16 <> 0 as rev, n >= 40 as pair, case when n >= 40 then 3 * n else 90 end as size, start - mapq as mate from f where flag & 144 = 128 or flag & 96 = 64),
    e as (select r, qname, contig, rev, list_concat(case when rev then range(case when pair then mate else greatest(0, start - 90 + n) end, start) else [] end, range(start, mid), range(mid + 10, last), case when rev then [] else range(last, last + size - n) end) as p from x where n > 1),
    {CUT.format('3:60')}""")
def offset_fragments_extended(t):
    """Alignments of the forward RNA strand (a third, whose mates are swapped), extended to the mate (pairs) or to 90 bases (reads of under 40)."""
    n = F.col("end") - F.col("start")
    flag = F.col("flag").bitwiseXOR(F.when(F.col("mapq") % 3 == 0, 48).otherwise(0))
    rows = spliced(t).filter(n > 1).withColumn("flag", F.when(n >= 40, flag).otherwise(flag - 2)).withColumn("next_pos", F.col("start") - F.col("mapq")).withColumn("tlen", n * 3)
    return op.offsets(rows, 3, 60, extend=90, max_pair=10_000, rna_strand="forward")


@query("""select qname, contig, start, "end", count(*) as hits, bool_and(mapq % 3 = 0) as exact from alignments group by 1, 2, 3, 4""")
def match_positions(t):
    return op.match_positions(t.alignments.withColumn("score", F.col("mapq") % 3))


@query("select track, contig, pos, value * 2.5::double as value from tracks")
def scale_coverage(t):
    return op.scale(t.tracks, 2.5)
