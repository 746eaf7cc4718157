"""Functions of sequences: rows of contig (or read id) and seq."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import physical

#: Long sequences are searched in parts of so many bases.
CHUNK = 4096


def _lists(values: pa.Array, sizes: np.ndarray, null: np.ndarray) -> pa.Array:
    """Lists of these sizes from values one after another."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values, mask=pa.array(null))


def _parts(x: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Values of lists one after another, sizes, and which are null."""
    return x.flatten(), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False), x.is_null().to_numpy(zero_copy_only=False)


def _texts(codes: np.ndarray, sizes: np.ndarray, null: np.ndarray) -> pa.Array:
    """Texts of these sizes from ASCII codes one after another."""
    texts = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(codes, np.uint8)))
    return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), texts) if null.any() else texts


def tokens(seq: Column, order: str = "ACGT", length: int | None = None) -> Column:
    """Indices of bases in `order`, anything else 4, as array<tinyint>; cut or padded with 4 to `length`. The bases of a batch are looked up at once."""
    table = np.full(256, 4, np.int8)
    for word in (order.upper(), order.lower()):
        table[np.frombuffer(word.encode(), np.uint8)] = range(4)

    @F.arrow_udf("array<tinyint>")
    def looked_up(seqs: pa.Array) -> pa.Array:
        null, sizes = seqs.is_null().to_numpy(zero_copy_only=False), pc.fill_null(pc.utf8_length(seqs), 0).to_numpy(zero_copy_only=False)
        seqs = pc.replace_substring_regex(seqs, r"[^\x00-\x7F]", "?") if not pc.all(pc.string_is_ascii(seqs)).as_py() else seqs
        tok = table[np.frombuffer("".join(seqs.drop_null().to_pylist()).encode(), np.uint8)]
        if length is not None:
            place = np.arange(len(tok)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            padded = np.full((len(sizes), length), 4, np.int8)
            padded[np.repeat(np.arange(len(sizes)), sizes)[place < length], place[place < length]] = tok[place < length]
            tok, sizes = padded[~null].ravel(), np.where(null, 0, length)
        return _lists(pa.array(tok), sizes, null)

    return looked_up(seq)


def mismatched(rows: DataFrame, length: int) -> DataFrame:
    return rows.agg(F.count_if(F.length("seq") != length).alias("mismatched"))


def decode(tok: Column, order: str = "ACGT") -> Column:
    """Bases of tokens, N for 4."""
    letters = np.frombuffer((order + "N").encode(), np.uint8)

    @F.arrow_udf("string")
    def bases(toks: pa.Array) -> pa.Array:
        values, sizes, null = _parts(toks)
        return _texts(letters[values.to_numpy()], sizes, null)

    return bases(tok)


def one_hot(tok: Column) -> Column:
    """Of each token, which of 0..3 it is."""

    @F.arrow_udf("array<array<boolean>>")
    def bits(toks: pa.Array) -> pa.Array:
        values, sizes, null = _parts(toks)
        each = values.to_numpy()[:, None] == np.arange(4)
        return _lists(_lists(pa.array(each.ravel()), np.full(len(each), 4), np.zeros(len(each), bool)), sizes, null)

    return bits(tok)


def _rows(hot: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The one-hot rows of a batch, one below another, and how many each value has, and which are null."""
    rows, sizes, null = _parts(hot)
    bits, widths, _ = _parts(rows)
    table = np.zeros((len(widths), max(widths, default=0)), bool)
    table[np.arange(table.shape[1]) < widths[:, None]] = pc.fill_null(bits, False).to_numpy(zero_copy_only=False)
    return table, sizes, null


def from_one_hot(rows: Column, order: str = "ACGT") -> Column:
    """Bases of one-hot rows, N unless exactly one bit is set."""
    letters = np.frombuffer(order.encode(), np.uint8)

    @F.arrow_udf("string")
    def bases(hot: pa.Array) -> pa.Array:
        table, sizes, null = _rows(hot)
        return _texts(np.where(table.sum(axis=1) == 1, letters[table.argmax(axis=1)] if table.size else 0, ord("N")), sizes, null)

    return bases(rows)


def one_hot_text(rows: Column) -> Column:
    """One-hot rows as digits, with blanks between rows."""

    @F.arrow_udf("string")
    def text(hot: pa.Array) -> pa.Array:
        table, sizes, null = _rows(hot)
        digits = np.full((len(table), table.shape[1] + 1), ord(" "), np.uint8)
        digits[:, :-1] = ord("0") + table
        kept = np.ones(digits.shape, bool)
        kept[np.cumsum(sizes)[sizes > 0] - 1, -1] = False
        return _texts(digits[kept], np.maximum(sizes * digits.shape[1] - 1, 0), null)

    return text(rows)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def count_of(seq: Column, bases: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, bases, ""))


def gc_content(seq: Column) -> Column:
    """Share of G and C among known bases; null without any."""
    known = count_of(seq, "ACGT")
    return F.when(known > 0, count_of(seq, "GC").cast("double") / known)


def find_motif(rows: DataFrame, motif: str, chunk: int = 512) -> DataFrame:
    """contig, pos, strand of all overlapping hits of a motif and its reverse complement; a palindrome is forward only.

    Sequences are read in chunks with the motif's length less one of halo, so long contigs are spread over tasks.
    """
    back = motif[::-1].translate(str.maketrans("ACGT", "TGCA"))
    k = len(motif)
    chunks = rows.select("contig", "seq", F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(chunk))).alias("at"))
    chunks = chunks.select("contig", "at", F.substring("seq", F.col("at") + 1, F.lit(chunk + k - 1)).alias("part")).filter(F.col("part").contains(motif) | F.col("part").contains(back))
    starts = F.filter(F.sequence(F.lit(0), F.least(F.length("part") - k, F.lit(chunk - 1))), lambda i: F.substring(F.col("part"), i + 1, F.lit(k)).isin(motif, back))
    hits = chunks.filter(F.length("part") >= k).select("contig", "at", "part", F.explode(starts).alias("i"))
    return hits.select("contig", (F.col("at") + F.col("i")).alias("pos"), F.when(F.substring("part", F.col("i") + 1, F.lit(k)) == motif, "fwd").otherwise("rev").alias("strand"))


@F.pandas_udf(ArrayType(IntegerType()))
def codons_of(parts: pd.Series) -> pd.Series:
    """Offsets of ATG as they are, those of stop codons as -1 - offset."""

    def one(part: str) -> np.ndarray:
        a, b, c = (np.frombuffer(part.encode("utf-32-le"), np.uint32)[i : max(0, len(part) - 2) + i] for i in range(3))
        A, G, T = map(ord, "AGT")
        start = (a == A) & (b == T) & (c == G)
        stop = (a == T) & ((b == A) & ((c == A) | (c == G)) | (b == G) & (c == A))
        at = np.flatnonzero(start | stop).astype(np.int32)
        return np.where(start[at], at, -1 - at)

    return parts.map(one)


def find_orfs(rows: DataFrame, block: int = physical.BLOCK) -> DataFrame:
    """contig, strand, start, stop: from ATG to the first stop codon in frame; starts inside an accepted frame are skipped.

    Codons are found in parts of CHUNK bases. Stops are looked for in blocks of positions, and beyond a block in the first stops of the blocks after it. The skipping depends
    on what was accepted before, but not over a place that no candidate spans: runs of candidates that overlap are told apart by
    Spark, and those that begin in the same block are gone through in one pass.
    """
    strands = rows.select("contig", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("seq")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("seq")).alias("seq")))).alias("x")).select("contig", "x.*")
    parts = strands.select("contig", "strand", F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("parts"))
    halo = F.transform("parts", lambda x, i: F.concat(x, F.coalesce(F.left(F.get("parts", i + 1), F.lit(2)), F.lit(""))))
    codons = parts.select("contig", "strand", F.posexplode(halo).alias("i", "part")).select("contig", "strand", "i", F.explode(codons_of("part")).alias("at"))
    begins = F.col("at") >= 0
    codons = codons.select("contig", "strand", (F.col("i") * CHUNK + F.when(begins, F.col("at")).otherwise(-1 - F.col("at"))).alias("pos"), begins.alias("begins"))
    keys = ["contig", "strand", "_frame"]
    codons = codons.withColumn("_frame", F.col("pos") % 3).withColumn("_block", F.floor(F.col("pos") / block))
    stop = F.min(F.when(~F.col("begins"), F.col("pos")))
    later = codons.groupBy(*keys, "_block").agg(stop.alias("_t"))
    later = later.select(*keys, "_block", F.min("_t").over(W.partitionBy(*keys).orderBy("_block").rowsBetween(1, W.unboundedFollowing)).alias("_later"))
    here = stop.over(W.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(1, W.unboundedFollowing))
    found = codons.withColumn("_here", here).filter("begins").join(later, [*keys, "_block"])
    found = found.select("contig", "strand", F.col("pos").alias("start"), (F.coalesce("_here", "_later") + 3).alias("stop")).filter("stop is not null")
    found = physical.run_starts(found, ["contig", "strand"], 0, end="stop", block=block)
    found = found.select("contig", "strand", "start", "stop", F.floor(F.col("_run.start") / block).alias("_part"))

    def accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order, so of what was accepted only the last key and stop are carried on."""
        last, until = None, -1
        for batch in batches:
            kept = np.zeros(len(batch), bool)
            for i, (*key, start, stop) in enumerate(zip(*(batch[c] for c in ("contig", "strand", "_part", "start", "stop")), strict=True)):
                if key != last:
                    last, until = key, -1
                if start >= until:
                    kept[i], until = True, stop
            yield batch.loc[kept, ["contig", "strand", "start", "stop"]]

    keys = ["contig", "strand", "_part"]
    return found.repartition(*keys).sortWithinPartitions(*keys, "start").mapInPandas(accept, found.drop("_part").schema)


def seq_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two tables by contig: equal lengths -> positions that differ, else lengths of the common ends and of both middles."""
    j = a.select("contig", F.col("seq").alias("a")).join(b.select("contig", F.col("seq").alias("b")), "contig")
    n, m = F.length("a"), F.length("b")
    letters = lambda c: F.array_remove(F.split(c, ""), "")
    unequal = lambda x, y: F.zip_with(F.slice(letters(x), F.lit(1), F.least(n, m)), F.slice(letters(y), F.lit(1), F.least(n, m)), lambda p, q: p != q)
    places = lambda flags: F.filter(F.transform(flags, lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
    j = j.withColumn("diff", places(unequal(F.col("a"), F.col("b")))).withColumn("back", places(unequal(F.reverse("a"), F.reverse("b"))))
    prefix = F.when(F.size("diff") > 0, F.element_at("diff", 1)).otherwise(F.least(n, m))
    suffix = F.least(F.when(F.size("back") > 0, F.element_at("back", 1)).otherwise(F.least(n, m)), F.least(n, m) - prefix)
    return j.select("contig", F.when(n == m, F.col("diff")).alias("positions"), prefix.alias("prefix"), suffix.alias("suffix"), (n - prefix - suffix).alias("middle_a"), (m - prefix - suffix).alias("middle_b"))


def flanks(sites: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """left and right: `size` bases before start and from end on, shorter at the ends of a contig."""
    j = sites.join(rows.select("contig", "seq"), "contig")
    first = F.greatest(F.col("start") - size, F.lit(0))
    return j.withColumn("left", F.substring("seq", (first + 1).cast("int"), (F.col("start") - first).cast("int"))).withColumn("right", F.substring("seq", (F.col("end") + 1).cast("int"), F.lit(size))).drop("seq")


def pad(seq: Column, size: int, left: Column | None = None, right: Column | None = None, reverse: bool = False) -> Column:
    """seq with `size` bases on each side: from the given flanks, cut or swapped for the reverse strand, or from seq itself, tiled."""
    times = F.ceil(F.lit(size) / F.length(seq)).cast("int")
    left = F.repeat(seq, times) if left is None else left
    right = F.repeat(seq, times) if right is None else right
    if reverse:
        left, right = right, left
    return F.concat(F.right(left, F.lit(size)), seq, F.left(right, F.lit(size)))


def all_mutations(rows: DataFrame, positions: Column, order: str = "ACGT") -> DataFrame:
    """Every single substitution at `positions` (0-based array): base + 1, 2, 3 in `order`; unknown bases are left alone."""
    each = rows.select("contig", "seq", F.explode(positions).alias("pos")).select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("step"))
    base = F.substring("seq", F.col("pos") + 1, F.lit(1))
    each = each.withColumn("index", F.instr(F.lit(order), base) - 1).filter("index >= 0")
    new = F.substring(F.lit(order), (F.col("index") + F.col("step")) % 4 + 1, F.lit(1))
    return each.select("contig", "pos", base.alias("base"), new.alias("mutant"), F.overlay("seq", new, F.col("pos") + 1).alias("seq"))


def with_occurrences(mutations: DataFrame, history: DataFrame) -> DataFrame:
    """mutations (contig, pos, mutant, seq, ...) with seen: how many sequences of the contig's history (contig, seq) are the mutated one, and
    base_seen: how many have the new base at the position.

    Sequences are looked up by hash and compared; bases are counted only at positions that mutations have.
    """
    whole = history.groupBy("contig", F.xxhash64("seq").alias("_h"), "seq").agg(F.count("*").alias("seen"))
    places = mutations.select("contig", "pos").distinct()
    base = history.join(places, "contig").groupBy("contig", "pos", F.substring("seq", F.col("pos") + 1, F.lit(1)).alias("mutant")).agg(F.count("*").alias("base_seen"))
    out = mutations.withColumn("_h", F.xxhash64("seq")).join(whole, ["contig", "_h", "seq"], "left").join(base, ["contig", "pos", "mutant"], "left")
    return out.withColumn("seen", F.coalesce("seen", F.lit(0))).withColumn("base_seen", F.coalesce("base_seen", F.lit(0))).drop("_h")


def mutations_seen(rows: DataFrame, positions: Column, history: DataFrame, order: str = "ACGT") -> DataFrame:
    """contig, pos, mutant of all_mutations(rows, positions), with seen and base_seen as of with_occurrences; equal rows give them once.

    A mutation is in the history if that sequence is the same but for the base at its position. So no mutated sequence is made: what
    is left of sequences without that base is told apart by 128 bits of hash, once for the three mutations of a position, and rows and
    history are counted by it and by base in one pass.
    """
    base = F.substring("seq", F.col("pos") + 1, F.lit(1))
    index = F.when(base != "", F.instr(F.lit(order), base) - 1).alias("index")  # of the empty string, instr is 1
    left, right = F.left("seq", F.col("pos")), F.substring("seq", F.col("pos") + 2, F.length("seq"))
    rest = [F.xxhash64(left, right).alias("_a"), F.xxhash64(F.lit(1), right, left).alias("_b")]
    each = rows.select("contig", "seq", F.explode(positions).alias("pos")).select("contig", "pos", index, *rest, F.lit(1).alias("own")).filter("index >= 0")
    places = each.select("contig", "pos").repartition("contig").distinct()
    at = history.join(places, "contig").select("contig", "pos", index, *rest, F.lit(0).alias("own")).filter("index >= 0")
    count = lambda own: [F.count_if((F.col("own") == own) & (F.col("index") == i)).alias(f"_{own}{i}") for i in range(len(order))]
    counts = each.union(at).groupBy("contig", "pos", "_a", "_b").agg(*count(0), *count(1))
    here = W.partitionBy("contig", "pos")
    of = lambda some: F.array(*some)
    numbers = range(len(order))
    counts = counts.select("contig", "pos", of([f"_0{i}" for i in numbers]).alias("n"), of([f"_1{i}" for i in numbers]).alias("own"), of([F.sum(f"_0{i}").over(here) for i in numbers]).alias("all"))
    mutants = F.array(*(F.when((F.col("own")[i] > 0), (i + step) % 4) for i in numbers for step in (1, 2, 3)))
    out = counts.select("contig", "pos", "n", "all", F.explode(mutants).alias("new")).filter("new is not null")
    return out.select("contig", "pos", F.substring(F.lit(order), F.col("new") + 1, F.lit(1)).alias("mutant"), F.get("n", "new").alias("seen"), F.get("all", "new").alias("base_seen"))
