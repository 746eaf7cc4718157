"""Line dedup: an exact set-similarity join of lines by rarity-ordered prefixes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, bucketed, lean, written

#: Counters of word frequency, one for each value of a hash's top bits; a word is as frequent as all words of its counter together.
#: So many fit the table that Spark's tasks count in at first, beyond which counting takes more than twice the time.
TOP_BITS = 16
#: White space, whose characters begin and end words.
SPACE = " \t\n\r\x0b\f"
#: A word is a number: its frequency in steps of a quarter of an octave, then so many bits of its hash.
HASH_BITS = 53
#: Lines of so many words have a signature of twice the size.
LONG = 100
#: Lines of so many words also have a signature of WIDE times 64 bits, for each other.
LONGER, WIDE = 192, 8
SIGNATURES = ("parity", "more", "wide")
PLACE = ("d", "key", "pos")


def pieces(text: Column) -> Column:
    """What stands between white space (space and ASCII controls 9-13) of a line, which has no line feed, in lower case; empty strings among it."""
    plain, odd = text, F.lit(False)
    for c in "\t\r\x0b\f":
        plain, odd = F.replace(plain, F.lit(c), F.lit(" ")), odd | F.contains(text, F.lit(c))
    # To look for characters costs less than to replace them, and most lines have none.
    return F.split(F.lower(F.when(odd, plain).otherwise(text)), " ")


def words_of(line: Column) -> Column:
    """Distinct 64-bit hashes of the words of a line."""
    return F.array_except(F.transform(pieces(line), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))


def lines_of(docs: DataFrame) -> DataFrame:
    """d, key (of doc_id and text), pos, lid, line: the lines of each text that have words. Lines end at line feeds.

    (d, key, pos) orders lines: by doc_id, null ids first, texts of one id by their hash, then by position. lid is the hash of the line.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.filter(F.ltrim("line", F.lit(SPACE)) != "").select(*PLACE, F.xxhash64("line").alias("lid"), "line")


def earlier(a: str, b: str) -> Column:
    """Whether the place in the row a is before that in b."""
    return F.struct(*(F.col(f"{a}.{c}") for c in PLACE)) < F.struct(*(F.col(f"{b}.{c}") for c in PLACE))


def counter(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - TOP_BITS).cast("int")


def rarity(lines: DataFrame) -> Column:
    """For each counter the number of lines' words, over all texts, that fall to it: 4 times its binary logarithm and 1, at most 127.

    An array literal of fixed length, whatever the input. Numbers up to 127 are objects that the JVM keeps, so that a look-up stays in the processor's cache.
    """
    counts = lines.select(F.explode("h").alias("x")).groupBy(counter(F.col("x")).alias("c")).count()
    step = F.least(F.lit(127), F.floor(F.log2("count") * 4) + 1).cast("bigint")
    rows = counts.groupBy(F.shiftright("c", 10)).agg(F.collect_list(F.col("c") * 128 + step).alias("codes"))
    size = [0] * (1 << TOP_BITS)
    with lean(lines.sparkSession):
        for row in rows.select("codes").collect():
            for code in row["codes"]:
                size[code >> 7] = code & 127
    return F.split(F.lit(",".join(map(str, size))), ",").cast("array<bigint>")


def overlap_needed(a: Column, b: Column, similarity: float) -> Column:
    return F.ceil((a + b) * (similarity / (1 + similarity)) - 1e-9)


def alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether two word sets have the similarity."""
    return F.size(F.array_intersect(a, b)) >= overlap_needed(F.size(a), F.size(b), similarity)


def close(n: Column, m: Column, similarity: float) -> Column:
    """The test of lines x and y, of n and m words, by size and parity signatures; what settles most pairs comes first.

    At most (n + m)(1 - s)/(1 + s) words can differ, and each differing bit needs a differing word.
    """
    whole, second = F.col("x.parity").bitwiseXOR(F.col("y.parity")), F.col("x.more").bitwiseXOR(F.col("y.more"))
    few_enough = lambda bits: bits * (1 + similarity) <= (n + m) * (1 - similarity) + 1e-6
    halves = F.bit_count(whole.bitwiseXOR(second)) + F.bit_count(second)
    parts = sum((F.bit_count(F.col("x.wide")[i].bitwiseXOR(F.col("y.wide")[i])) for i in range(WIDE)), F.lit(0))
    sizes = F.least(n, m) >= F.greatest(n, m) * similarity - 1e-6
    return few_enough(F.bit_count(whole)) & sizes & ((F.least(n, m) < LONG) | few_enough(halves)) & ((F.least(n, m) < LONGER) | few_enough(parts))


def meeting(rows: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined to others that are few for each lid; these go into a table in memory, so that the rows needn't be sorted."""
    return rows.join(few.hint("shuffle_hash"), "lid", how)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The later line (lid) of each (x, y) pair whose word sets have the similarity, once. One y can stand in very many pairs."""
    met = pairs.join(sets.alias("a"), F.col("x") == F.col("a.lid")).join(sets.alias("b"), F.col("y") == F.col("b.lid"))
    later = F.when(earlier("b", "a"), F.col("x")).when(earlier("a", "b"), F.col("y"))
    return met.filter(alike(F.col("a.h"), F.col("b.h"), similarity)).select(later.alias("lid")).filter("lid is not null").distinct()


def prefixed(lines: DataFrame, similarity: float) -> DataFrame:
    """lid, d, n (words), parity, more, wide (signatures), prefix: the rarest words of each line, of which similar lines share one at least."""
    sizes = rarity(lines)
    # Never null, so that arrays are sorted as primitives.
    code = lambda x: F.coalesce(F.shiftleft(F.get(sizes, counter(x)), HASH_BITS).bitwiseOR(F.shiftrightunsigned(x, 64 - HASH_BITS)), F.lit(0))
    rows = lines.select("lid", "d", F.size("h").alias("n"), F.sort_array(F.transform("h", code)).alias("t"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    # Never null, so that no join has a filter put before it that makes signatures once more.
    parity = lambda words: F.coalesce(F.aggregate(words, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(bit(x))), F.lit(0).cast("long"))
    # A long line has two halves of 64 bits, and a word flips a bit of one of them; `parity` is both together, `more` the second.
    more = F.when(F.col("n") >= LONG, parity(F.filter("t", lambda x: x.bitwiseAND(F.lit(64)) != 0))).otherwise(F.lit(0).cast("long"))
    part = lambda i: F.filter("t", lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(WIDE - 1)) == i)
    wide = F.when(F.col("n") >= LONGER, F.array(*(parity(part(i)) for i in range(WIDE))))
    prefix = F.slice("t", 1, (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int"))
    return rows.select("lid", "d", "n", parity(F.col("t")).alias("parity"), more.alias("more"), wide.alias("wide"), F.transform(prefix, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("prefix"))


def candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """w, lid, d, n, signatures: the lists (words w of its prefix) of each line that hold another line close to it.

    A semi join, which stops at the first such line, and gives a row for each (line, list), never a pair.
    """
    # Size and position in one number; both sides of the join have the same columns, so that the rows are made and sent once.
    code = F.col("n").cast("long") * (1 << 32) + F.col("i")
    # No prefix is empty. An inner posexplode would have a filter put before it that makes each prefix once more.
    rows = rows.select("lid", "d", "n", *SIGNATURES, F.posexplode_outer("prefix").alias("i", "w")).select("w", "lid", "d", *SIGNATURES, code.alias("c"))
    n, m, i, j = (f(F.col(f"{s}.c")) for f in (lambda c: F.shiftright(c, 32), lambda c: c.bitwiseAND(F.lit((1 << 32) - 1))) for s in "xy")
    other = (F.col("x.lid") != F.col("y.lid")) | (F.col("x.d") != F.col("y.d"))
    hit = (F.col("x.w") == F.col("y.w")) & close(n, m, similarity) & other & (F.least(n - i, m - j) >= overlap_needed(n, m, similarity))
    met = rows.alias("x").join(rows.alias("y"), hit, "left_semi")
    return met.select("w", "lid", "d", F.shiftright("c", 32).alias("n"), *SIGNATURES)


def listed(similarity: float) -> Column:
    """Whether lines x and y are two that are close and share a list."""
    return (F.col("x.w") == F.col("y.w")) & close(F.col("x.n"), F.col("y.n"), similarity) & (F.col("x.lid") != F.col("y.lid"))


def led(found: DataFrame, similarity: float) -> DataFrame:
    """(x, y): each candidate with the earliest one in each of its lists, if they are close; at most one pair for a line and list."""
    leader = found.groupBy("w").agg(F.min_by(F.struct("lid", "n", *SIGNATURES), F.struct("d", "lid")).alias("l")).select("w", "l.*")
    met = found.alias("x").join(leader.alias("y"), listed(similarity))
    return met.select(F.col("x.lid").alias("x"), F.col("y.lid").alias("y")).distinct()


def later_lines(docs: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(lines, matched): the distinct lines with the place where each first occurs and the number of its places, and the lid of those that match an earlier one.

    Words of a line are ordered from rare to frequent by counts over all texts; lines of similarity s share a word among the
    first n - ceil(s n) + 1. Candidates share such a word and pass filters of length, of the word's positions, and of
    a parity signature (64 bits, 128 or 512 for long lines). Then word sets decide. Lines and their word sets are written once, in buckets
    of their hash; the sets of candidates are taken from there once.

    1. Each line looks for a candidate in each of its lists (`candidates`).
    2. Every line found is held against the earliest one of its lists (`led`), which settles large groups of near copies.
    3. Lines still open that are close to an earlier one in a list, and those earlier ones, get their word sets, and a last semi join
       decides inside the lists: it, too, stops at the first match, so a group of any size adds rows in proportion to its lines.
    """
    rows = lines_of(docs).groupBy("lid").agg(F.min(F.struct(*PLACE, "line")).alias("l"), F.count("*").alias("places"))
    lines, path = bucketed(rows.select("lid", *(f"l.{c}" for c in PLACE), "places", words_of(F.col("l.line")).alias("h")), "lid", dictionary=False)
    found = written(candidates(prefixed(lines, similarity), similarity))
    sets, _ = bucketed(meeting(lines, found.select("lid").distinct()), "lid", dictionary=False)
    matched = written(verified(led(found, similarity), sets, similarity))

    still = found.join(matched, "lid", "left_anti")
    # Of lines of one document either may be the later one.
    pair = listed(similarity) & (F.col("y.d") <= F.col("x.d"))
    late = written(still.alias("x").join(found.alias("y"), pair, "left_semi"))
    early = found.alias("y").join(late.alias("x"), pair, "left_semi")
    x, y = (meeting(sets, rows.select("lid", "w", "n", *SIGNATURES)) for rows in (late, early))
    same = listed(similarity) & earlier("y", "x") & alike(F.col("x.h"), F.col("y.h"), similarity)
    more = x.alias("x").join(y.alias("y"), same, "left_semi").select("lid")
    return docs.sparkSession.read.schema(lines.schema).parquet(path).select("lid", *PLACE, "places"), written(matched.union(more).distinct())


def removals(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """key, removed: the positions (from 0) of lines of each document that match an earlier line; documents without any are absent."""
    lines, matched = later_lines(docs, similarity)
    # Lines of one place that match no other have nothing to remove.
    again = lines.join(matched.withColumn("m", F.lit(True)), "lid", "left").filter("m or places > 1").select("lid", "m", F.struct(*PLACE).alias("first"))
    rows = meeting(lines_of(docs).select("lid", *PLACE), again)
    gone = rows.filter(F.col("m").isNotNull() | (F.col("first") != F.struct(*PLACE)))
    return gone.groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def report(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (positions from 0) for every row.

    A line is removed if an earlier line has a word set (in lower case) of Jaccard similarity `similarity` or more, whether that one is
    itself removed or not. Earlier: by doc_id, nulls first, then by the hash of id and text, then by position. Lines without words
    stay. Null texts have no line, empty ones one. Rows that repeat both doc_id and text count as one document, and have the same
    result. An empty table gives no rows. Extra columns are not read.
    """
    gone = removals(docs, similarity)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias("n_lines"))
    rows = rows.join(gone, "key", "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))


def without_repeats(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs with the removed lines cut from text (and n_chars, if there, counted anew); a text that loses all its words goes."""
    gone = removals(docs, similarity).withColumnsRenamed({"key": "__key", "removed": "__removed"})
    rows = docs.withColumn("__key", F.xxhash64("doc_id", "text")).join(gone, "__key", "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("__removed", i))
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    rows = rows.withColumn("text", text).filter(F.col("__removed").isNull() | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
