"""What bounds the work and the memory of a task, whatever a batch or a sequence holds."""

from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gsig.operators import fragments, kmers, reads, sampling, scoring, sequences, windows
from gsig.plans import adapters, registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_are_cut_in_one_pass(spark):
    """No piece is looked up by its place, and no sequence is carried along with its pieces."""
    rows = spark.createDataFrame([(1, "ACGTACGTA"), (2, ""), (3, None), (4, "ACG\nTé\U0001f600A")], "read_id long, seq string")
    got = reads.chunk_reads(rows, 4)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 0, "ACGT"), (1, 1, "ACGT"), (1, 2, "A"), (2, 0, ""), (3, 0, None), (4, 0, "ACG\n"), (4, 1, "Té\U0001f600A")]
    assert "substring" not in plan(got)


def test_bases_are_made_once(spark):
    """Also where a filter looks at them; a batch is mapped as bytes."""
    docs = spark.createDataFrame([("abzAZ",), ("é\U0001f600 c",), ("",), (None,)], "text string")
    got = docs.select(adapters.as_bases(F.col("text")).alias("seq"))
    assert [r.seq for r in got.collect()] == ["ACCAC", "NNNG", "", None]
    assert plan(got.filter("length(seq) > 1")).count("ArrowEvalPython") == 1


def test_parts_are_taken_in_small_groups():
    batch = pd.DataFrame({"contig": range(100), "part": ["ACGT" * 25] * 100})
    groups = list(windows.joined([batch, batch.iloc[:0], batch], 1000))
    assert sum(len(g.rows) for g in groups) == 200 and max(len(g.bases) for g in groups) <= 1100


def test_gc_of_windows_is_summed_without_rows(spark):
    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACGTN"), n)) for n in (0, 1, 7, 8, 9, 200, 65_543, 65_544)] + ["N" * 12, "NN"]
    rows = spark.createDataFrame(list(enumerate(seqs)), "contig long, seq string")
    want = {}
    for c, s in enumerate(seqs):
        for w in [s[i : i + 8] for i in range(max(1, len(s) - 7))] if s else []:
            known = len(w) - w.count("N")
            want.setdefault(c, []).append((w.count("G") + w.count("C")) / known if known else None)
    got = {r.contig: r for r in windows.gc_totals(rows, 8).collect()}
    assert set(got) == set(want)
    for c, values in want.items():
        known = [v for v in values if v is not None]
        assert (got[c].n, got[c].known, got[c].low, got[c].high) == (len(values), len(known), min(known, default=None), max(known, default=None))
        assert not known or abs(got[c].total - sum(known)) < 1e-9
    energy = {r.contig: r.energy for r in windows.gc_energy(rows, 8, 0.4, 0.05).collect()}
    for c, values in want.items():
        d = [abs(v - 0.4) for v in values if v is not None]
        assert energy[c] is None if not d else abs(energy[c] - np.sqrt(np.mean([0 if x < 0.05 else x * x for x in d]))) < 1e-9
    assert "Generate" not in plan(windows.gc_energy(rows, 8, 0.4)).split("MapInPandas")[0]


def random_rows(spark, lengths):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(c, "".join(rng.choice(list("ACGTN"), n, p=[0.4, 0.3, 0.1, 0.15, 0.05]))) for c, n in enumerate(lengths)], "contig long, seq string")


def test_totals_of_scores_equal_sums_of_rows(spark):
    rows, scorer = random_rows(spark, (0, 2, 3, 4, 50, 90)), scoring.linear_scorer(np.random.default_rng(5).integers(-3, 4, (3, 5)))
    totals = {"total": lambda pos, value: value, "placed": lambda pos, value: value * (pos % 7)}
    sums = [F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * (F.col("pos") % 7)).alias("placed")]
    key = lambda df: sorted((r[0], r[1], r.n, round(r.total, 6), round(r.placed, 6)) for r in df.collect())
    assert key(scoring.score_windows(rows, scorer, 3, 2, "+-", totals=totals)) == key(scoring.score_windows(rows, scorer, 3, 2, "+-").groupBy("contig", "strand").agg(*sums))
    for chunk in (8, 4096):
        assert key(scoring.substitution_scores(rows, scorer, 3, chunk, totals=totals)) == key(scoring.substitution_scores(rows, scorer, 3, chunk).groupBy("contig", "mutant").agg(*sums))


def test_sliding_totals_equal_sums_of_runs(spark):
    rows = random_rows(spark, (0, 1, 11, 12, 13, 40, 300))
    for k, size in ((2, 12), (3, 3), (1, 5)):
        n = F.col("end") - F.col("start")
        want = kmers.sliding_kmer_runs(rows, k, size).groupBy("contig", "kmer").agg(F.sum(F.col("n") * n).alias("total"), F.sum(F.col("n") * F.col("n") * n).alias("squares"))
        assert sorted(map(tuple, kmers.sliding_kmer_totals(rows, k, size).collect())) == sorted(map(tuple, want.collect()))


def test_every_window_has_its_counts(spark, monkeypatch):
    """Windows across chunks and without any known k-mer, too; the query gives them all, and no sums over them."""
    chunks = windows.chunks
    monkeypatch.setattr(windows, "chunks", lambda rows, size, stride: chunks(rows, size, stride, chunk=8))
    rows = random_rows(spark, (0, 1, 11, 12, 13, 300)).unionByName(spark.createDataFrame([(6, None), (7, "N" * 20), (8, "ACGT" * 80)], "contig long, seq string"))
    for k, size, with_n in ((2, 12, False), (2, 2, True), (1, 5, True), (2, 300, False)):
        got = {(r.contig, r.start): r.asDict() for r in kmers.sliding_kmer_table(rows, k, size, with_n).collect()}
        want = {}
        for contig, seq in rows.collect():
            for i in range(len(seq or "") - size + 1):
                n = dict.fromkeys(("".join(x) for x in product("ACGTN" if with_n else "ACGT", repeat=k)), 0)
                for m in (seq[j : j + k] for j in range(i, i + size - k + 1)):
                    n |= {m: n[m] + 1} if m in n else {}
                want[contig, i] = {"contig": contig, "start": i} | n
        assert got == want
    with pytest.raises(ValueError):
        kmers.sliding_kmer_table(rows, 3, 2)


def test_query_of_sliding_kmers_gives_windows(spark, tmp_path):
    spark.createDataFrame([(1, "abcdefghijklmn"), (2, "a b c d e f g h"), (3, "abc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["sliding_kmer_counts"](spark, str(tmp_path)).orderBy("contig", "start").collect()
    assert [(r.contig, r.start) for r in got] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3)]
    assert [sum(r[2:]) for r in got] == [11] * 3 + [0] * 4 and (got[0].AC, got[0].TA, got[1].AC, got[1].CG) == (3, 2, 2, 3)


def test_windows_kmers_are_counted_in_their_task(spark):
    rows = random_rows(spark, (0, 2, 3, 10, 11, 95))
    got = kmers.window_kmers(rows, 3, 10)
    want = {}
    for c, s in rows.collect():
        for i in range(len(s) - 2):
            if i % 10 <= 7 and "N" not in s[i : i + 3]:
                counts = want.setdefault((c, i // 10), {})
                counts[s[i : i + 3]] = counts.get(s[i : i + 3], 0) + 1
    assert {(r.contig, r.win): r.kmers for r in got.collect()} == want
    assert "Exchange" not in plan(got)


def test_summary_of_constant_windows(spark):
    """GC that doesn't vary has no correlation; it isn't an error."""
    rows = spark.createDataFrame([(0, "G" * 60), (1, "GA" * 10 + "C" * 40)], "contig long, seq string")
    out = kmers.sliding_summary(rows, lambda pos: (pos * 37 % 101).cast("double"), 20).groupBy("contig").agg(F.count("*").alias("n"), kmers.correlation("gc", "value").alias("corr"))
    got = {r.contig: (r.n, r.corr) for r in out.collect()}
    assert got[0][0] == got[1][0] == 41 and np.isnan(got[0][1]) and -1 <= got[1][1] <= 1


def test_offsets_work_on_arrays_of_blocks(spark):
    """Alignments without blocks have no bases and don't move those of others; no function is called block by block."""
    schema = "qname string, contig string, flag int, tlen long, next_pos long, blocks array<struct<start:long,end:long>>"
    rows = [("none", "c", 16, 0, 0, None), ("f", "c", 0, 0, 0, [(10, 15), (15, 18), (20, 25)]), ("empty", "c", 0, 0, 0, []), ("r", "d", 16, 0, 0, [(10, 15), (20, 25)])]
    out = fragments.offsets(spark.createDataFrame(rows, schema).coalesce(1), 2, 20, extend=16)
    assert sorted(map(tuple, out.collect())) == [("f", "c", 11, 18), ("f", "c", 20, 28), ("r", "d", 4, 15), ("r", "d", 20, 24)]
    assert "lambda" not in plan(out)


def test_contrasts_are_counted_in_their_task(spark):
    """No occurrence is a row; sequences of neither kind count for neither, but their k-mers are there."""
    rows = random_rows(spark, (0, 2, 3, 70, 95, 80))
    got = kmers.contrast_counts(rows, 3, F.col("contig") == 3, F.col("contig") == 4)
    want = {}
    for c, s in rows.collect():
        for i in range(len(s) - 2):
            if "N" not in s[i : i + 3]:
                want.setdefault(s[i : i + 3], [0, 0, 0])[{3: 0, 4: 1}.get(c, 2)] += 1
    assert {r.kmer: (r.high, r.low) for r in got.collect()} == {m: (a, b) for m, (a, b, _) in want.items()}
    assert plan(got).split("Initial Plan")[0].count("Generate explode") == 1


def test_batches_of_parts_become_objects_in_small_groups(spark):
    """However many rows a batch has."""

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"rows": [len(batch)], "bases": [batch["part"].str.len().sum()]})

    rows = spark.createDataFrame([("ACGT" * 25,)] * 500 + [(None,), ("",)], "part string").coalesce(1)
    got = windows.over_parts(rows, sizes, "rows long, bases long", 1000).collect()
    assert sum(r.rows for r in got) == 502 and sum(r.bases for r in got) == 50_000 and max(r.bases for r in got) <= 1100


def test_bases_of_long_batches(spark):
    """Texts are mapped some bytes at a time; a character may lie across two steps."""
    texts = ["a" * (1 << 20), "é" * 700_001, None, "", "b\U0001f600" * 300_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1).select("i", adapters.as_bases(F.col("text")).alias("seq"))
    assert [r.seq for r in got.orderBy("i").collect()] == ["A" * (1 << 20), "N" * 700_001, None, "", "CN" * 300_000]


def test_windows_of_given_bases(spark):
    rows = random_rows(spark, (0, 9, 10, 25, 65_560))
    want = {(c, i): sum(b in "GC" for b in s[i : i + 10]) for c, s in rows.collect() for i in range(0, len(s) - 9, 10)}
    got = windows.windows_holding(rows, 10, 10)
    assert {(r.contig, r.start): r.n for r in got.collect()} == want


def test_no_window_or_kmer_is_looked_up_by_its_place(spark):
    """What queries read are chunks; these are the only rows made of a sequence before Python."""
    for name in ("dinucleotide_order", "gc_bins"):
        assert plan(registry.queries()[name](spark, "/root/testdata/sf0.001")).count("Generate explode") == 1


def test_frames_are_accepted_in_order_without_groups(spark):
    rows = spark.createDataFrame([(c, "ATGAAATAA" * 3 + "ATG" * c) for c in range(6)], "contig long, seq string")
    got = sequences.find_orfs(rows, 8)
    assert sorted((r.contig, r.start, r.stop) for r in got.filter("strand = '+'").collect()) == [(c, i, i + 9) for c in range(6) for i in (0, 9, 18)]
    assert "FlatMapGroups" not in plan(got)


def test_bits_of_bases(spark):
    """Tokens and bits are made of a batch at once; null and empty ones among them."""
    rows = spark.createDataFrame([(0, "ACgtN"), (1, None), (2, ""), (3, "é\U0001f600T")], "i int, seq string").coalesce(1)
    hot = sequences.one_hot(sequences.tokens(F.col("seq"), "ATCG"))
    got = rows.select("i", hot.alias("hot"), sequences.one_hot_text(hot).alias("bits"), sequences.from_one_hot(hot, "ATCG").alias("seq"), sequences.tokens(F.col("seq"), length=3).alias("tok"))
    by = {r.i: r for r in got.collect()}
    assert [by[i].bits for i in range(4)] == ["1000 0010 0001 0100 0000", None, "", "0000 0000 0100"]
    assert [by[i].seq for i in range(4)] == ["ACGTN", None, "", "NNT"] and [by[i].tok for i in range(4)] == [[0, 1, 2], None, [4, 4, 4], [4, 4, 3]]
    assert by[3].hot == [[False] * 4, [False] * 4, [False, True, False, False]] and "lambda" not in plan(got)
    uneven = spark.createDataFrame([([[True], [False, True], [True, True], []],)], "hot array<array<boolean>>")
    assert uneven.select(sequences.from_one_hot(F.col("hot"))).first()[0] == "ACNN"


def test_listed_mutations_meet_chunks(spark):
    """Not whole sequences."""
    rows, scorer = random_rows(spark, (2, 3, 40)), scoring.linear_scorer(np.random.default_rng(6).normal(size=(2, 3, 5)))
    every = scoring.substitution_scores(rows, scorer, 3)
    got = scoring.mutation_scores(rows, every.drop("value"), scorer, 3, chunk=8)
    key = lambda df: sorted((r.contig, r.pos, r.mutant, round(r.value, 9)) for r in df.collect())
    assert key(got) == key(every) and "_chunk" in plan(got)


def test_shuffled_sequences_of_any_letters(spark):
    rows = spark.createDataFrame([(1, None), (2, "é\U0001f600a" * 5), (3, ""), (4, "ACGT" * 9)], "contig long, seq string").coalesce(1)
    for two in (False, True):
        got = {(r.contig, r.copy): r.seq for r in sampling.shuffle_sequences(rows, 2, two).collect()}
        assert len(got) == 8
        for c, s in rows.collect():
            assert all(got[c, i] is None if s is None else sorted(got[c, i]) == sorted(s) for i in (0, 1))


def test_shuffles_are_dealt_out(spark):
    """However few row groups a file has, each sequence once for all its copies; the result doesn't depend on where it is made."""
    rows = random_rows(spark, range(40, 104)).coalesce(1)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, False)
    try:
        for two in (False, True):
            got = sampling.shuffle_sequences(rows, 2, two)
            assert got.select(F.spark_partition_id()).distinct().count() > 1 and "Generate" not in plan(got)
            assert sorted(got.collect()) == sorted(sampling.shuffle_sequences(rows.repartition(3), 3, two).filter("copy < 2").collect()) and got.distinct().count() == 128
    finally:
        spark.conf.unset(coalesce)


def test_reads_are_cut_before_they_become_bases(spark, tmp_path):
    """So Python gets a batch of reads, not of whole texts; characters of any width and null texts among them."""
    texts = ["a\U0001f600é c" * 50, "", None, "x" * 202, "b\n" * 51]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.Tables(spark, str(tmp_path)).reads
    bases = lambda x: x and "".join(adapters.BASES[adapters.LETTERS.index(c)] if c in adapters.LETTERS else "N" for c in x)
    want = [(i * 1_000_000 + k, "s", bases(x and x[101 * k : 101 * k + 101])) for i, x in enumerate(texts) for k in range(max(1, -(-len(x or "") // 101)))]
    assert sorted(map(tuple, got.collect())) == want
    assert plan(got).count("ArrowEvalPython") == 1 and plan(got).index("ArrowEvalPython") < plan(got).index("Generate")


def test_random_sequences_grow_a_letter_at_a_time(spark):
    """All of a batch together, with the draws of each; contexts that no k-mer has are followed by any letter."""
    freqs, k, length = {"AC": 0.5, "CA": 0.25, "CN": 0.25, "NA": 0.0}, 2, 60
    got = {r.id: r.seq for r in sampling.random_sequences(spark, 300, length, freqs, 3).collect()}
    for i in (0, 1, 299):
        rng = np.random.default_rng([3, i])
        seq = sorted(freqs)[int(np.searchsorted([0.5, 0.75, 1, 1], rng.random(), side="right"))]
        for u in rng.random(length - k):
            letters, steps = {"A": ("C", [1]), "C": ("AN", [0.5, 1]), "N": ("A", [1])}[seq[-1]]
            seq += letters[min(int(np.searchsorted(steps, u, side="right")), len(letters) - 1)]
        assert got[i] == seq
    assert {len(s) for s in got.values()} == {length}


def test_parts_of_contigs_hold_every_kmer_once(spark, tmp_path):
    """They are cut before they become bases, so what is counted of them takes small batches."""
    texts = ["abcdefg é\U0001f600" * n for n in (0, 1, 51, 52, 300)] + [None, "a" * 512, "b" * 513, "ab" * 257]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    t = registry.Tables(spark, str(tmp_path))
    parts = adapters.genome_parts(t, 2)
    assert kmers.kmer_counts(parts, 3).collect() == kmers.kmer_counts(t.genome, 3).collect()
    assert max(len(r.seq or "") for r in parts.collect()) == 514 and plan(parts).index("ArrowEvalPython") < plan(parts).index("Generate")


def test_mutations_are_looked_up_without_being_made(spark):
    """As looked up one by one in histories of many sequences, of other lengths, and of none; unknown bases, nulls and equal rows among them."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("ACGTN"), n, p=[0.3, 0.3, 0.2, 0.15, 0.05]))
    rows = [(c, word(n)) for c, n in enumerate((0, 1, 3, 5, 5, 9)) for _ in range(2)] + [(7, "ACGT"), (7, "ACGT"), (8, None)]
    changed = [(c, s[:i] + b + s[i + 1 :]) for c, s in rows if s and c != 3 for i in range(len(s)) for b in "ACN"]
    history = rows + changed + changed[::2] + [(7, "ACG"), (7, "ACGTA"), (7, None), (5, ""), (99, "A")]
    df = lambda some: spark.createDataFrame(some, "contig long, seq string")
    at = F.filter(F.array(*map(F.lit, (0, 2, 4))), lambda i: i < F.length("seq"))
    got = sequences.mutations_seen(df(rows), at, df(history))
    want = []
    for c, s in {r for r in rows if r[1]}:
        for i in (0, 2, 4):
            for b in "ACGT" if i < len(s) and s[i] != "N" else "":
                if b != s[i]:
                    mine = [h for d, h in history if d == c and h is not None]
                    want.append((c, i, b, mine.count(s[:i] + b + s[i + 1 :]), sum(h[i : i + 1] == b for h in mine)))
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(w[3] for w in want)
    made = sequences.with_occurrences(sequences.all_mutations(df(rows).distinct(), at), df(history))
    assert sorted(map(tuple, made.select(got.columns).collect())) == sorted(want)
    assert "ArrowEvalPython" not in plan(registry.queries()["mutations_seen"](spark, "/root/testdata/sf0.001"))
