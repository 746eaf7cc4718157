"""Queries over text formats: tables are written to the shared folder in a format and read back."""

from pyspark.sql import functions as F

from ..operators import sampling
from ..sources import text as io
from .registry import query


def staged(t, name, df, write):
    path = io.fresh_path(t.spark, name)
    write(df, path)
    return path


def as_lines(df, path):
    df.write.text(path)


@query("select cast(read_id as varchar) as read_id, seq, '+' as sep, repeat('I', length(seq)) as qual from reads")
def read_fastq(t):
    path = staged(t, "fastq", t.reads, io.write_fastq)
    return io.read_fastq(t.spark, path).select("read_id", "seq", "sep", "qual")


@query("select count(*) as plus, 0::bigint as minus from reads")
def fastq_separators(t):
    return io.separators(io.read_fastq(t.spark, staged(t, "fastq", t.reads, io.write_fastq)))


@query("select 101 as read_length, 1::bigint as lengths")
def infer_read_length(t):
    path = staged(t, "fastq", t.reads, io.write_fastq)
    longest = io.infer_read_length(io.read_fastq(t.spark, path))
    return longest.agg(F.max("read_length").alias("read_length"), F.countDistinct("read_length").alias("lengths"))


@query("with c as (select contig, seq, unnest(range(0, (length(seq) + 999) // 1000)) as chunk from genome) select cast(contig as varchar) as contig, chunk, chunk * 1000 as start, substring(seq, cast(chunk * 1000 + 1 as bigint), 1000) as seq from c")
def read_fasta(t):
    path = staged(t, "fasta", t.genome.withColumn("contig", F.concat(F.col("contig").cast("string"), F.lit(" from text"))), lambda d, p: io.write_fasta(d, p, 60))
    return io.read_fasta(t.spark, path, chunk=1000)


@query("select count(*) as headers, cast(sum(1 + (length(seq) + 59) // 60) as bigint) as lines from genome where length(seq) > 0")
def write_fasta(t):
    path = staged(t, "fasta", t.genome.filter("length(seq) > 0"), lambda d, p: io.write_fasta(d, p, 60))
    return t.spark.read.text(path).agg(F.count_if(F.col("value").startswith(">")).alias("headers"), F.count("*").alias("lines"))


@query("""select contig, start - 6 as start, "end" - 6 as "end", cast(id as varchar) as name, score from intervals_a""")
def read_bed(t):
    rows = t.intervals_a.select("contig", "start", "end", F.col("id").alias("name"), "score")
    return io.read_bed(t.spark, staged(t, "bed", rows, lambda d, p: d.write.csv(p, sep="\t")), window=10, based1=True)


@query("""select contig, start, "end", 'f' || score as family from intervals_a""")
def read_repeats(t):
    row = F.concat_ws("  ", *(F.lit(str(i)) for i in range(4)), F.concat(F.lit("chr"), "contig"), "start", "end", F.lit("a"), F.lit("b"), F.lit("c"), F.concat(F.lit("f"), "score"))
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # each file begins with the three header lines
    rows = t.intervals_a.select(F.concat(F.when(first, "h\nh\n\n").otherwise(""), row).alias("v"))
    return io.read_repeats(t.spark, staged(t, "repeats", rows, as_lines))


@query('select contig, start + 1 as start, start + 1 + tlen as "end" from alignments where tlen > 0')
def read_sam(t):
    rows = t.alignments.select(F.concat_ws("\t", "qname", "flag", "contig", F.col("start") + 1, "mapq", F.lit("50M"), F.lit("="), F.lit(1), "tlen", F.lit("ACGT"), F.lit("IIII")).alias("v"))
    head = t.nation.select(F.concat(F.lit("@SQ\tSN:"), "n_name").alias("v"))
    return io.sam_fragments(io.read_sam(t.spark, staged(t, "sam", head.union(rows), as_lines)))


@query("select 'chr' || score as contig, start, \"end\", id * 0.5::double as value from intervals_a where score > 5")
def read_bedgraph(t):
    rows = t.intervals_a.select(F.concat(F.when(F.col("score") > 5, "chr").otherwise("other"), "score").alias("contig"), "start", "end", (F.col("id") * F.lit(0.5)).alias("value"))
    return io.read_bedgraph(t.spark, staged(t, "bedgraph", rows, io.write_bedgraph))


@query("""select contig, start, "end", 'g' || id as gene from intervals_a where score > 5""")
def read_gff(t):
    rows = t.intervals_a.select("contig", F.lit("made"), F.when(F.col("score") > 5, "gene").otherwise("exon"), "start", "end", F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID=g"), "id", F.lit(";Note=n;")))
    out = io.read_gff(t.spark, staged(t, "gff", rows, lambda d, p: d.write.csv(p, sep="\t")), "gene")
    return out.select("contig", "start", "end", F.col("attributes")["ID"].alias("gene"))


@query("""select 'gi|' || id as element, contig, start - 1 as start, "end" - 1 as "end" from intervals_a""")
def read_elements(t):
    rows = t.intervals_a.select(F.concat(F.lit("# x\n"), F.concat_ws("\t", F.concat(F.lit("gi|"), "id"), "contig", "start", "end")).alias("v"))
    return io.read_elements(t.spark, staged(t, "elements", rows, lambda d, p: d.write.option("compression", "gzip").text(p)))


@query("select event_type as contig, count(*) as length from events group by 1")
def read_contig_sizes(t):
    sizes = t.events.groupBy(F.col("event_type").alias("contig")).agg(F.count("*").alias("length"))
    return io.read_contig_sizes(t.spark, staged(t, "sizes", sizes.select(F.to_json(F.create_map("contig", "length"))), as_lines))


@query("select event_type as contig, count(*) as length from events group by 1")
def read_fai(t):
    sizes = t.events.groupBy(F.col("event_type").alias("contig")).agg(F.count("*").alias("length"))
    return io.read_contig_sizes(t.spark, staged(t, "fai", sizes, lambda d, p: d.write.csv(p, sep="\t")), fai=True)


@query("select contig, pos, ip_count as a_count, ctrl_count as b_count from bins")
def read_table(t):
    one = lambda c: staged(t, "table", t.bins.select("contig", "pos", F.col(c).alias("n")), io.write_table)
    a, b = (io.read_table(t.spark, one(c), "contig string, pos bigint, n bigint", rename={"n": name}) for c, name in (("ip_count", "a_count"), ("ctrl_count", "b_count")))
    return io.side_by_side([a, b], ["contig", "pos"])


@query("""with r as (select id, label, row_number() over (partition by label order by id * 7919 % 10007 / 10007.0::double, id) - 1 as r, count(*) over (partition by label) as n from preds)
    select case when r < round(n * 0.7::double) then 'train' when r < round(n * (0.7::double + 0.2::double)) then 'valid' else 'test' end as split, cast(id % 3 as integer) as shard, count(*) as n from r group by 1, 2""")
def write_dataset_shards(t):
    order = (F.col("id") * 7919 % 10007).cast("double") / 10007
    rows = sampling.train_valid_test(t.preds, order, 0.7, 0.2).select("id", "label", "split", (F.col("id") % 3).alias("shard"))
    path = staged(t, "dataset", rows, io.write_dataset_shards)
    return t.spark.read.parquet(path).groupBy("split", F.col("shard").cast("int").alias("shard")).agg(F.count("*").alias("n"))
