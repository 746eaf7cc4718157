"""Readers and writers of the text formats of sequencing: each gives a DataFrame and reads files split over tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators import physical
from ..operators.physical import shared_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0 in each file), value. Splits are counted, and a line's number is its place in its split plus the
    lines of the file's earlier splits; nothing is sorted and only one row per split is gathered."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return lines.join(splits.drop("_n"), ["file", "_at"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """file, record, read_id, seq, sep, qual: four lines a record."""
    part = lambda i: F.max(F.when(F.col("line_no") % 4 == i, F.col("value")))
    rows = numbered_lines(spark, path).groupBy("file", F.floor(F.col("line_no") / 4).alias("record")).agg(part(0).alias("read_id"), part(1).alias("seq"), part(2).alias("sep"), part(3).alias("qual"))
    return rows.withColumn("read_id", F.regexp_replace("read_id", "^@", ""))


def separators(reads: DataFrame) -> DataFrame:
    """Records whose third line starts with + and with -."""
    return reads.agg(F.count_if(F.col("sep").startswith("+")).alias("plus"), F.count_if(F.col("sep").startswith("-")).alias("minus"))


def infer_read_length(reads: DataFrame, records: int = 100) -> DataFrame:
    """file, read_length: the longest of the first records of each file."""
    return reads.filter(F.col("record") < records).groupBy("file").agg(F.max(F.length("seq")).alias("read_length"))


def write_fastq(reads: DataFrame, path: str) -> None:
    """Records of read_id, seq (and qual, else I for each base)."""
    qual = F.col("qual") if "qual" in reads.columns else F.regexp_replace("seq", ".", "I")
    reads.select(F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), qual)).write.text(path)


def read_fasta(spark: SparkSession, path: str, names: DataFrame | None = None, first_word: bool = True, chunk: int = 1 << 20) -> DataFrame:
    """contig, chunk, start, seq: sequences in chunks of `chunk` bases, so that a chromosome is no single row.

    A line's record is the number of headers up to it and its offset the bases before it in the record, both running sums
    over blocks of lines. names (id, contig) renames and filters.
    """
    lines = numbered_lines(spark, path)
    header = F.col("value").startswith(">")
    lines = physical.running_sum(lines, ["file"], header.cast("long"), "record", pos="line_no")
    name = F.substring_index(F.expr("substring(value, 2)"), " ", 1) if first_word else F.expr("substring(value, 2)")
    heads = lines.filter(header).select("file", "record", name.alias("contig"))
    if names is not None:
        heads = heads.join(names.select(F.col("id").alias("contig"), F.col("contig").alias("_new")), "contig").select("file", "record", F.col("_new").alias("contig"))
    body = lines.filter(~header & (F.length("value") > 0))
    body = physical.running_sum(body, ["file", "record"], F.length("value").cast("long"), "_end", pos="line_no").withColumn("_at", F.col("_end") - F.length("value"))
    body = body.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_at") / chunk), F.floor((F.col("_end") - 1) / chunk))))
    lo, hi = F.greatest("_at", F.col("chunk") * chunk), F.least("_end", (F.col("chunk") + 1) * chunk)
    piece = F.substring("value", (lo - F.col("_at") + 1).cast("int"), (hi - lo).cast("int"))
    parts = body.select("file", "record", "chunk", F.struct(lo.alias("at"), piece.alias("s")).alias("p")).groupBy("file", "record", "chunk").agg(F.array_sort(F.collect_list("p")).alias("p"))
    parts = parts.select("file", "record", "chunk", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"))
    return parts.join(heads, ["file", "record"]).select("contig", "chunk", (F.col("chunk") * chunk).alias("start"), "seq")


def write_fasta(rows: DataFrame, path: str, width: int | None = None) -> None:
    """Rows of contig, seq as records, optionally wrapped; one file per partition."""
    seq: Column = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n") if width else F.col("seq")
    rows.select(F.concat(F.lit(">"), F.col("contig").cast("string"), F.lit("\n"), seq)).write.text(path)


def read_bed(spark: SparkSession, path: str, window: int = 0, based1: bool = False, distinct: bool = False) -> DataFrame:
    """contig, start, end, name, score: -1 without a fifth column; both ends less half a window, and less 1 if the file counts from 1."""
    rows = spark.read.csv(path, sep="\t", schema="contig string, start bigint, end bigint, name string, score int")
    off = int(based1) + window // 2
    rows = rows.withColumn("start", F.col("start") - off).withColumn("end", F.col("end") - off).withColumn("score", F.coalesce("score", F.lit(-1)))
    return rows.dropDuplicates(["contig", "start", "end"]) if distinct else rows


def read_repeats(spark: SparkSession, path: str, window: int = 0) -> DataFrame:
    """contig (without chr), start, end, family of a table with three header lines and columns parted by blanks."""
    rows = numbered_lines(spark, path).filter("line_no >= 3 and trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("c"))
    at = lambda i: (F.col("c")[i].cast("bigint") - window // 2)
    return rows.select(F.regexp_replace(F.col("c")[4], "^chr", "").alias("contig"), at(5).alias("start"), at(6).alias("end"), F.col("c")[10].alias("family"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """All alignments: qname, flag, contig, pos (from 1), mapq, cigar, rnext, pnext, tlen, seq, qual, without header lines."""
    names = (("qname", "string"), ("flag", "int"), ("contig", "string"), ("pos", "bigint"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "bigint"), ("tlen", "bigint"), ("seq", "string"), ("qual", "string"))
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^@(HD|SQ|RG|PG|CO)\t")).select(F.split("value", "\t").alias("c"))
    return rows.select(*(F.col("c")[i].cast(kind).alias(n) for i, (n, kind) in enumerate(names)))


def sam_fragments(rows: DataFrame) -> DataFrame:
    """contig, start, end of leftmost mates, as positions of the file."""
    return rows.filter("tlen > 0").select("contig", F.col("pos").alias("start"), (F.col("pos") + F.col("tlen")).alias("end"))


def read_bedgraph(spark: SparkSession, path: str, contigs: str | None = "^chr[0-9]+") -> DataFrame:
    rows = spark.read.csv(path, sep="\t", schema="contig string, start bigint, end bigint, value double")
    return rows.filter(F.col("contig").rlike(contigs)) if contigs else rows


def write_bedgraph(rows: DataFrame, path: str) -> None:
    """contig, start, end, value in order of contig and start over all files."""
    rows.select("contig", "start", "end", "value").repartitionByRange("contig", "start").sortWithinPartitions("contig", "start").write.csv(path, sep="\t")


def read_gff(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The nine columns, start and end as numbers, and attributes as a map."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="contig string, source string, type string, start bigint, end bigint, score string, strand string, phase string, attributes string")
    rows = rows.filter(F.col("type") == kind) if kind else rows
    return rows.withColumn("attributes", F.str_to_map(F.regexp_replace("attributes", ";\\s*$", ""), F.lit(";"), F.lit("=")))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """element, contig, start, end (from 0) of the rows that begin with gi, up to the first line with >; gzip is read as such."""
    lines = numbered_lines(spark, path)
    stop = lines.filter(F.col("value").startswith(">")).groupBy("file").agg(F.min("line_no").alias("_stop"))
    rows = lines.join(stop, "file", "left").filter((F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop"))) & F.col("value").startswith("gi"))
    c = F.split(F.trim("value"), r"\s+")
    return rows.select(c[0].alias("element"), c[1].alias("contig"), (c[2].cast("bigint") - 1).alias("start"), (c[3].cast("bigint") - 1).alias("end"))


def read_contig_sizes(spark: SparkSession, path: str, fai: bool = False, multiline: bool = False) -> DataFrame:
    """contig, length from JSON objects, one a line or one a file, or the first two columns of an index."""
    if fai:
        return spark.read.csv(path, sep="\t").select(F.col("_c0").alias("contig"), F.col("_c1").cast("bigint").alias("length"))
    return spark.read.text(path, wholetext=multiline).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("contig", "length"))


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ",", rename: dict[str, str] | None = None) -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, schema=schema).withColumnsRenamed(rename or {})


def side_by_side(tables: list[DataFrame], index: list[str]) -> DataFrame:
    """Tables joined on their index columns; an index that is missing in one gives nulls."""
    out = tables[0]
    for other in tables[1:]:
        out = out.join(other, index, "full")
    return out


def write_table(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.csv(path, sep=sep, header=True)


def write_dataset_shards(rows: DataFrame, path: str) -> None:
    """Parquet by split and shard; a shard's rows meet in one task, so it is one file."""
    rows.repartition("split", "shard").write.partitionBy("split", "shard").parquet(path)
