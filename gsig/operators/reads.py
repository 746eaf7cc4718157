"""Filters and quality counts of sequencing reads: rows of read_id, sample, seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def n_count(seq: str = "seq") -> Column:
    return F.length(seq) - F.length(F.replace(F.col(seq), F.lit("N"), F.lit("")))


def filter_n_reads(reads: DataFrame, tolerance: int = 0, read_length: int | None = None, max_size: int | None = None, order: str = "read_id") -> DataFrame:
    """Reads with at most `tolerance` unknown bases; missing bases to `read_length` count as unknown. With max_size, so many at most, the
    first by `order`."""
    missing = F.lit(read_length) - F.length("seq") if read_length else F.lit(0)
    kept = reads.filter(n_count() + missing <= tolerance)
    if tolerance == 0:
        full = F.length("seq") >= read_length if read_length else F.lit(True)
        kept = reads.filter(~F.col("seq").contains("N") & full)
    return kept if max_size is None else kept.orderBy(order).limit(max_size)


def full_reads(reads: DataFrame, read_length: int) -> DataFrame:
    """Reads of exactly this length without unknown bases."""
    return reads.filter((F.length("seq") == read_length) & ~F.col("seq").contains("N"))


def full_read_pairs(first: DataFrame, second: DataFrame, read_length: int, key: str = "read_id") -> DataFrame:
    """Reads of both ends whose id qualifies in both."""
    ids = full_reads(first, read_length).select(key).join(full_reads(second, read_length).select(key), key, "left_semi")
    return first.withColumn("mate", F.lit(1)).unionByName(second.withColumn("mate", F.lit(2))).join(ids, key, "left_semi")


def length_histogram(reads: DataFrame, *by: str) -> DataFrame:
    return reads.groupBy(*by, F.length("seq").alias("length")).agg(F.count("*").alias("n"))


def duplicate_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("seq").agg(F.count("*").alias("n"))


def duplicate_levels(reads: DataFrame) -> DataFrame:
    """How many distinct sequences occur so many times."""
    return duplicate_counts(reads).groupBy(F.col("n").alias("copies")).agg(F.count("*").alias("n_seqs"))


def dedup_reads(reads: DataFrame) -> DataFrame:
    return reads.select("seq").distinct()


def cap_duplicates(rows: DataFrame, keys: list[str], order: list[str], most: int = 1) -> DataFrame:
    """At most `most` rows of each key, the first by `order`."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def probe_lookup(reads: DataFrame, probes: DataFrame) -> DataFrame:
    """Occurrences of each probe, 0 when absent. Probes are a given list; Spark sends it to all tasks if it is small."""
    return probes.select("seq").distinct().join(duplicate_counts(reads), "seq", "left").select("seq", F.coalesce("n", F.lit(0)).alias("n"))


def select_by_sequence(reads: DataFrame, wanted: DataFrame) -> DataFrame:
    return reads.join(wanted.select("seq"), "seq", "left_semi")


def select_pairs_by_sequence(first: DataFrame, second: DataFrame, wanted: DataFrame, key: str = "read_id") -> tuple[DataFrame, DataFrame]:
    """Both ends of the pairs of which either end has a wanted sequence."""
    ids = select_by_sequence(first, wanted).select(key).union(select_by_sequence(second, wanted).select(key)).distinct()
    return first.join(ids, key, "left_semi"), second.join(ids, key, "left_semi")


def select_by_id(rows: DataFrame, names: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows whose id is, or is not, in a list of names; a name ends at its first blank and loses a leading @."""
    clean = names.select(F.substring_index(F.regexp_replace("name", "^@", ""), " ", 1).alias("_name"))
    return rows.join(clean, F.col(key).cast("string") == F.col("_name"), "left_semi" if keep else "left_anti")


def pieces(seq: Column, size: int) -> Column:
    """A sequence cut from left to right, the last piece may be short; an empty one is its own piece.

    One pass makes all pieces: to look each up by its place would go through the sequence again, and carry it along with every piece.
    """
    return F.when(F.length(seq) > 0, F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).otherwise(F.array(seq))


def chunk_reads(reads: DataFrame, size: int) -> DataFrame:
    """Long reads in pieces; the last may be short."""
    return reads.select("read_id", F.posexplode(pieces(F.col("seq"), size)).alias("piece", "seq"))


def adapter_hits(reads: DataFrame, adapter: str, *by: str) -> DataFrame:
    return reads.groupBy(*by).agg(F.count_if(F.col("seq").contains(adapter)).alias("hits"), F.count("*").alias("reads"))


def base_composition(rows: DataFrame, alphabet: str = "ACGTN") -> DataFrame:
    """Count of each base: lengths are summed per row, so no base becomes a row."""
    sums = rows.agg(*(F.sum((F.length("seq") - F.length(F.replace(F.col("seq"), F.lit(b), F.lit("")))).cast("long")).alias(b) for b in alphabet))
    return sums.unpivot([], list(alphabet), "base", "n")


def hits_by_contig(alignments: DataFrame) -> DataFrame:
    """Per read name: alignments in all and on each contig."""
    each = alignments.groupBy("qname", "contig").agg(F.count("*").alias("hits"))
    return each.withColumn("total", F.sum("hits").over(W.partitionBy("qname")))


def mapq_histogram(alignments: DataFrame) -> DataFrame:
    return alignments.groupBy("mapq").agg(F.count("*").alias("n")).orderBy("mapq")


def rename_contigs(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Contigs renamed by a (from, to) table; rows without a name or with an empty one are dropped."""
    names = names.filter(F.coalesce("to", F.lit("")) != "").select(F.col("from").alias("contig"), "to")
    return rows.join(names, "contig").drop("contig").withColumnRenamed("to", "contig")


#: Roman numerals.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(n: Column) -> Column:
    """Roman numeral of 1..3999: places are written in turn from the largest."""
    out, rest = F.lit(""), n.cast("int")
    for value, mark in ROMAN:
        out, rest = F.concat(out, F.repeat(F.lit(mark), F.floor(rest / value).cast("int"))), rest % value
    return out


def arabic(text: Column) -> Column:
    """Number of a roman numeral: a mark before a larger one is subtracted."""
    value = lambda c: F.element_at(F.map_from_arrays(F.array(*map(F.lit, "MDCLXVI")), F.array(*map(F.lit, (1000, 500, 100, 50, 10, 5, 1)))), c)
    marks = F.filter(F.split(text, ""), lambda c: c != "")
    signed = F.transform(F.transform(marks, value), lambda v, i: v)
    nxt = F.concat(F.slice(signed, 2, 100), F.array(F.lit(0)))
    return F.aggregate(F.zip_with(signed, nxt, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda s, v: s + v)


def padded_contig(n: Column) -> Column:
    return F.concat(F.lit("chr"), F.lpad(n.cast("string"), 2, "0"))


def drop_contigs(rows: DataFrame, names: list[str] = (), prefix: str | None = None, keep: bool = False) -> DataFrame:
    hit = F.col("contig").isin(list(names))
    if prefix is not None:
        hit = hit | F.col("contig").startswith(prefix)
    return rows.filter(hit if keep else ~hit)
