"""Worked examples and properties.

Fixed values: the inputs and results of the worked examples are those that a right implementation has to give.
"""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gsig.operators import fragments, intervals, kmers, physical, reads, sampling, scoring, sequences, stats, tracks, windows
from gsig.sources import text


def values(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).orderBy(*(["contig", "pos"] if "pos" in df.columns else cols)).collect()]


@pytest.fixture
def ten(spark):
    return spark.createDataFrame([("c", i, float(i)) for i in range(10)], "contig string, pos long, value double")


def test_moving_sum_example(ten):
    assert values(windows.moving_sum(ten, 2), "value") == [1, 3, 5, 7, 9, 11, 13, 15, 17]
    with pytest.raises(ValueError):
        windows.moving_sum(ten, 0)


def test_frames_do_not_depend_on_blocks(spark):
    rows = spark.range(500).select(F.lit("c").alias("contig"), F.col("id").alias("pos"), (F.col("id") * 37 % 11).cast("double").alias("value"))
    f = {"s": lambda w: F.sum("value").over(w)}
    a, b = (values(physical.frame(rows, ["contig"], 4, 3, f, block=n), "s") for n in (16, 1 << 20))
    assert a == b
    a, b = (values(physical.running_sum(rows, ["contig"], F.col("value"), "s", block=n), "s") for n in (16, 1 << 20))
    assert a == b


def test_sliding_gc_example(spark):
    rows = spark.createDataFrame([(1, "".join("ACGTN"[t] for t in (3, 2, 2, 1, 1, 0, 0, 0, 0, 3)))], "contig long, seq string")
    assert [r.gc for r in windows.sliding_gc(rows, 4).orderBy("start").collect()] == [0.75, 1.0, 0.75, 0.5, 0.25, 0.0, 0.0]


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("with_n", [False, True])
def test_kmer_counts_match_plain_counts(spark, k, with_n):
    seqs = ["ACCGGGTTTTNNNNN", "ACCGGGTTTT", "NTNCNANCGTTNGGT", "GTTTGTGACC", "GNCNANTNNN"]
    rows = spark.createDataFrame(list(enumerate(seqs)), "contig long, seq string")
    plain = Counter(s[i : i + k] for s in seqs for i in range(len(s) - k + 1) if with_n or "N" not in s[i : i + k])
    got = {r.kmer: r.n for r in kmers.kmer_counts(rows, k, with_n).collect()}
    assert len(got) == (5 if with_n else 4) ** k
    assert {m: n for m, n in got.items() if n} == dict(plain)


@pytest.mark.parametrize("size", [4, 7])
def test_windowed_kmers_equal_sliding_kmers(spark, size):
    seqs = {1: "ACCGGGTTTTNACA", 2: "GTTTGTGACCNNA", 3: "AC"}
    rows = spark.createDataFrame(list(seqs.items()), "contig long, seq string")
    plain = Counter((c, i, s[j : j + 2]) for c, s in seqs.items() for i in range(len(s) - size + 1) for j in range(i, i + size - 1) if "N" not in s[j : j + 2])
    got = {(r.contig, r.start, r.kmer): r.n for r in kmers.sliding_kmer_counts(rows, 2, size).collect()}
    assert got == dict(plain)


def test_nan_pearson_example(spark):
    nan = float("nan")
    pairs = {"x": ((nan, 2, 3, 5, nan), (nan, 1, 4, 5, 3)), "y": ((2, 3, 5, 1, 4), (3, 3, 5, 1, 2))}
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (p, q) in pairs.items() for a, b in zip(p, q, strict=True)], "k string, a double, b double")
    got = {r.k: r["corr"] for r in stats.nan_pearson(rows, ["k"], "a", "b").collect()}
    assert got["x"] == pytest.approx(np.corrcoef([2, 3, 5], [1, 4, 5])[0, 1])
    assert got["y"] == pytest.approx(np.corrcoef(*pairs["y"])[0, 1])


def test_spearman_ranks(spark):
    rows = spark.createDataFrame([("t", "c", i, float(v)) for i, v in enumerate((2, 4, 8, 4, 2, 4, 8, 4))], "track string, contig string, pos long, value double")
    assert values(stats.average_ranks(rows, ["track", "contig"]), "value") == [1.5, 4.5, 7.5, 4.5, 1.5, 4.5, 7.5, 4.5]


def test_binomial_tail_paths_meet():
    for k, n, p in ((10, 50, 0.3), (300, 1000, 0.25), (2000, 4000, 0.49), (1, 4000, 0.001)):
        assert stats._tail(k, n, p) == pytest.approx(stats.incomplete_beta(k, n - k + 1, p), rel=1e-9)
    assert stats._tail(0, 5, 0.3) == 1.0
    assert stats._tail(5, 5, 0.5) == pytest.approx(1 / 32)


def test_bh_by_hand(spark):
    rows = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5)], "id int, pval double")
    got = {r.id: r.qval for r in stats.fdr_bh(rows).collect()}
    assert got == pytest.approx({1: 0.04, 2: 0.16 / 3, 3: 0.16 / 3, 4: 0.5})


def test_merge_takes_nested_intervals(spark):
    rows = spark.createDataFrame([("c", 0, 100), ("c", 10, 20), ("c", 50, 60), ("c", 100, 110), ("c", 120, 130)], "contig string, start long, end long")
    get = lambda df: sorted(tuple(r) for r in df.select("start", "end").collect())
    assert get(intervals.merge(rows, span=16)) == [(0, 100), (100, 110), (120, 130)]
    assert get(intervals.merge(rows, 1, span=16)) == [(0, 110), (120, 130)]


def test_coverage_total_is_sum_of_lengths(spark):
    rows = spark.createDataFrame([("c", i * 7 % 50, i * 7 % 50 + 1 + i % 9) for i in range(60)], "contig string, start long, end long")
    runs = windows.coverage(rows).collect()
    assert sum((r.end - r.start) * r.depth for r in runs) == sum(r.end - r.start + 1 for r in rows.collect())
    assert windows.densify(windows.coverage(rows)).count() == sum(r.end - r.start for r in runs)


def test_range_join_equals_plain_join(spark):
    rng = np.random.default_rng(1)
    make = lambda n: [("c", int(s), int(s + l)) for s, l in zip(rng.integers(0, 300, n), rng.integers(1, 40, n), strict=True)]
    a, b = make(80), make(70)
    got = physical.range_join(*(spark.createDataFrame(x, "contig string, start long, end long") for x in (a, b)), 16)
    assert Counter((r.start, r.end, r.b_start, r.b_end) for r in got.collect()) == Counter((x[1], x[2], y[1], y[2]) for x in a for y in b if x[1] < y[2] and y[1] < x[2])


def test_runs_of_intervals_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [("c", int(a), int(a + n)) for a, n in zip(rng.integers(0, 2000, 150), rng.integers(1, 60, 150), strict=True)] + [("c", 3000, 3900), ("c", 3010, 3020)]
    table = spark.createDataFrame(rows, "contig string, start long, end long")
    for tolerance in (0, 1, 5):
        expected = []
        for _, a, b in sorted(rows):
            if expected and a < expected[-1][1] + tolerance:
                expected[-1][1] = max(expected[-1][1], b)
            else:
                expected.append([a, b])
        for span in (16, 10_000):
            assert sorted([r.start, r.end] for r in intervals.merge(table, tolerance, span).collect()) == expected


def test_peaks_across_blocks(spark):
    rows = spark.createDataFrame([("c", i, float(i % 10 < 7)) for i in range(100)], "contig string, pos long, value double")
    for block in (4, 1000):
        assert sorted((r.start, r.end) for r in intervals.find_peaks(rows, 0.5, 0, 3, block).collect()) == [(i, i + 7) for i in range(0, 100, 10)]
        assert [(r.start, r.end) for r in intervals.find_peaks(rows, 0.5, 3, 3, block).collect()] == [(0, 97)]


def test_encode_decode_round_trip(spark):
    rows = spark.createDataFrame([("ACGTNacgtx",)], "seq string")
    r = rows.select(sequences.tokens(F.col("seq"), "ATCG").alias("t")).select("t", sequences.decode(F.col("t"), "ATCG").alias("s"), sequences.from_one_hot(sequences.one_hot(F.col("t")), "ATCG").alias("o")).first()
    assert r.t == [0, 2, 3, 1, 4, 0, 2, 3, 1, 4]
    assert r.s == r.o == "ACGTNACGTN"


def test_orfs_against_plain_scan(spark):
    rng = np.random.default_rng(3)
    seq = "".join(rng.choice(list("ACGT"), 9000))
    comp = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    expected = []
    for strand, s in (("+", seq), ("-", comp)):
        until = -1
        for i in range(len(s) - 2):
            if s[i : i + 3] == "ATG" and i >= until:
                stop = next((j for j in range(i + 3, len(s) - 2, 3) if s[j : j + 3] in ("TAA", "TAG", "TGA")), None)
                if stop is not None:
                    expected.append((strand, i, stop + 3))
                    until = stop + 3
    for block in (64, 65_536):
        got = sequences.find_orfs(spark.createDataFrame([(1, seq)], "contig long, seq string"), block).collect()
        assert sorted((r.strand, r.start, r.stop) for r in got) == sorted(expected)


def test_motif_palindrome_is_forward_only(spark):
    rows = spark.createDataFrame([(1, "GAATTCGAATTC" + "A" * 4090 + "GATACGTATC")], "contig long, seq string")
    assert [(r.pos, r.strand) for r in sequences.find_motif(rows, "GAATTC").orderBy("pos").collect()] == [(0, "fwd"), (6, "fwd")]
    assert [(r.pos, r.strand) for r in sequences.find_motif(rows, "GATAC", 8).orderBy("pos").collect()] == [(4102, "fwd"), (4107, "rev")]


def test_seq_diff_with_insertion(spark):
    a, b = (spark.createDataFrame([(1, s)], "contig long, seq string") for s in ("AACCGGTT", "AACCTTTGGTT"))
    r = sequences.seq_diff(a, b).first()
    assert (r.positions, r.prefix, r.suffix, r.middle_a, r.middle_b) == (None, 4, 4, 0, 3)


def test_roman_round_trip(spark):
    n = spark.range(1, 4000).select("id", reads.roman(F.col("id")).alias("r"))
    assert n.filter(reads.arabic(F.col("r")) != F.col("id")).count() == 0
    assert n.filter("id = 1994").first().r == "MCMXCIV"


def test_offsets_of_spliced_read(spark):
    rows = spark.createDataFrame([("q", "c", f, [(10, 15), (20, 25)]) for f in (0, 16)], "qname string, contig string, flag int, blocks array<struct<start:long,end:long>>")
    get = lambda *a: sorted((r.start, r.end) for r in fragments.offsets(rows, *a).collect())
    assert get(1) == [(10, 11), (24, 25)]
    assert get(-1) == [(10, 11), (24, 25)]
    assert get(4, 7, "+") == [(13, 15), (20, 22)]
    assert get(1, 3, "-") == [(22, 25)]


def test_thinning(spark):
    rows = spark.createDataFrame([("c", i, 5 + i % 7) for i in range(200)], "contig string, pos long, n long")
    total = sum(r.n for r in rows.collect())
    out = sampling.thin_exact(rows, 0.4).collect()
    assert sum(r.kept for r in out) == round(total * 0.4)
    assert all(0 <= r.kept <= r.n for r in out)
    assert all(0 <= r.kept <= r.n for r in sampling.thin_binomial(rows, [0.1, 0.9]).collect())


def test_split_keeps_pairs_together(spark):
    rows = spark.range(300).select((F.col("id") % 101).alias("q"))
    parts = sampling.balanced_split(rows, "q", 4).groupBy("q").agg(F.countDistinct("part").alias("k"), F.first("part").alias("part")).collect()
    assert {r.k for r in parts} == {1}
    assert sorted(Counter(r.part for r in parts).values()) == [25, 25, 25, 26]


def test_random_sequences_follow_frequencies(spark):
    out = sampling.random_sequences(spark, 50, 40, {"AA": 0.0, "AC": 0.5, "CA": 0.5, "CC": 0.0}).collect()
    assert all(r.seq in ("AC" * 20, "CA" * 20) for r in out)
    again = sampling.random_sequences(spark, 50, 40, {"AA": 0.0, "AC": 0.5, "CA": 0.5, "CC": 0.0}).collect()
    assert out == again


def test_shuffles_keep_counts(spark):
    rows = spark.createDataFrame([(1, "ACGGTTACGTNACGGA"), (2, "A"), (3, "")], "contig long, seq string")
    for two in (False, True):
        for r in sampling.shuffle_sequences(rows, 3, two).join(rows.withColumnRenamed("seq", "own"), "contig").collect():
            assert Counter(r.seq) == Counter(r.own)
            if two:
                assert Counter(zip(r.seq, r.seq[1:], strict=False)) == Counter(zip(r.own, r.own[1:], strict=False))


def test_smooth_modes(ten):
    plain = np.convolve(np.arange(10.0), [0.25, 0.5, 0.25], "full")
    w = [0.25, 0.5, 0.25]
    assert values(windows.smooth(ten, w), "value") == pytest.approx(list(plain[1:-1]))
    assert values(windows.smooth(ten, w, mode="valid"), "value") == pytest.approx(list(plain[2:-2]))
    assert values(windows.smooth(ten, w, mode="full"), "value") == pytest.approx(list(plain))


def test_nan_smooth_without_values(spark):
    rows = spark.createDataFrame([("c", i, v) for i, v in enumerate([None, None, None, 3.0, float("nan"), 5.0])], "contig string, pos long, value double")
    assert values(windows.nan_smooth(rows, 3, pad_masked=True), "value") == [None, None, 3.0, 3.0, 4.0, 5.0]
    assert values(windows.nan_smooth(rows, 3), "value")[-1] == 2.5


def test_halving_keeps_totals(spark):
    rows = spark.createDataFrame([("t", "c", i, float(i % 3)) for i in range(30)], "track string, contig string, pos long, value double")
    assert sum(values(tracks.halved(rows), "value")) == 30 // 2


def test_linear_scorer_heads(spark):
    rows = spark.createDataFrame([(1, "ACGTACGT")], "contig long, seq string")
    w = np.zeros((2, 4, 5))
    w[0, 0, :4] = (1, 2, 3, 4)
    w[1, 3, :4] = (1, 2, 3, 4)
    out = scoring.score_windows(rows, scoring.linear_scorer(w), 4, 4, "+", head_interval=2)
    assert {(r.pos, r.value) for r in out.collect()} == {(1, 1.0), (3, 4.0), (5, 1.0), (7, 4.0)}


@pytest.mark.parametrize("edge, offset, flanks", [("valid", 0, ("", "")), ("pad", 0, ("", "")), ("valid", 5, ("", "")), ("valid", 0, ("GATTACA", "CC")), ("pad", 3, ("", ""))])
@pytest.mark.parametrize("stride", [1, 3])
def test_score_windows_against_plain_loops(spark, monkeypatch, edge, offset, flanks, stride):
    monkeypatch.setattr(windows.chunks, "__defaults__", (0, 16))
    rng = np.random.default_rng(1)
    w = rng.standard_normal((4, 5))
    seqs = {i: "".join(rng.choice(list("ACGTN"), n)) for i, n in enumerate((0, 3, 4, 50, 97))}
    rows = spark.createDataFrame(list(seqs.items()), "contig long, seq string")
    got = {(r.contig, r.pos, r.strand): r.value for r in scoring.score_windows(rows, scoring.linear_scorer(w), 4, stride, "+-", offset=offset, flanks=flanks, edge=edge).collect()}
    left, right = ("NN", "N") if edge == "pad" else flanks
    expected = {}
    for c, s in seqs.items():
        s = left + s + right
        for i in range(offset, len(s) - 3, stride):
            part = s[i : i + 4]
            for strand, x in (("+", part), ("-", part[::-1].translate(str.maketrans("ACGT", "TGCA")))):
                expected[c, i + 2 - len(left), strand] = sum(w[j, "ACGTN".index(b)] for j, b in enumerate(x))
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_dinucleotides_in_their_order(spark):
    rows = spark.createDataFrame([(a + b,) for a in "ACGTN" for b in "ACGTN"], "kmer string")
    got = [(r.kmer, r.place, r.kind) for r in kmers.dinucleotide_order(rows).collect()]
    assert [k for k, _, _ in got] == "AC GT CA TG AG CT GA TC AA TT AT TA CC GG CG GC".split()
    assert [p for _, p, _ in got] == list(range(1, 17)) and [k for _, _, k in got] == ["alt"] * 8 + ["same"] * 8


def test_blocks_of_values_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(physical, "BLOCK", 64)
    rng = np.random.default_rng(2)
    x = [0.0, -0.0, float("inf"), -float("inf"), 1e-300, -1e-300, 1e300, *rng.standard_normal(300), *(rng.integers(-5, 5, 200).astype(float)), *10 ** rng.uniform(-30, 0, 300)]
    rows = spark.createDataFrame([("k", float(v)) for v in x], "track string, value double")
    got, several = physical.in_blocks(rows, ["value"])
    order = sorted(got.collect(), key=lambda r: (r.value, r["_block"]))
    assert several and all(a["_block"] <= b["_block"] for a, b in zip(order, order[1:], strict=False))
    finite = rows.filter("abs(value) < 1e10")
    q = tracks.quantiles(finite, [0.0, 0.05, 0.5, 0.77, 1.0]).first()
    assert list(q)[1:] == pytest.approx(np.quantile([v for v in x if abs(v) < 1e10], [0.0, 0.05, 0.5, 0.77, 1.0]).tolist())
    p = sorted(rng.uniform(0, 1, 400) ** 3)
    out = stats.fdr_bh(spark.createDataFrame([(float(v),) for v in p], "pval double")).orderBy("pval").collect()
    plain = np.minimum(1, np.minimum.accumulate((np.array(p) * 400 / np.arange(1, 401))[::-1])[::-1])
    assert [r.qval for r in out] == pytest.approx(plain.tolist())


def test_options_of_reads_and_fragments(spark):
    rows = spark.createDataFrame([(i, "s", q) for i, q in enumerate(("ACGT", "ANGT", "AC", "GGGG", "TTTT"))], "read_id long, sample string, seq string")
    assert [r.read_id for r in reads.filter_n_reads(rows, max_size=2).collect()] == [0, 2]
    assert {r.read_id for r in reads.filter_n_reads(rows, 2, 4, max_size=3).collect()} == {0, 1, 2}
    other = rows.withColumn("seq", F.reverse("seq"))
    wanted = spark.createDataFrame([("TGCA",), ("GGGG",)], "seq string")
    a, b = reads.select_pairs_by_sequence(rows, other, wanted)
    assert {r.read_id for r in a.collect()} == {r.read_id for r in b.collect()} == {0, 3}
    f = spark.createDataFrame([("c", 1, 5, True), ("c", 1, 6, False), ("c", 1, 5, True)], "contig string, start long, end long, is_reverse boolean")
    got = {(r.is_reverse, r.pos): (r.starts, r.ends) for r in fragments.end_histogram(f, ["contig", "is_reverse"]).collect()}
    assert got == {(True, 1): (2, 0), (True, 4): (0, 2), (False, 1): (1, 0), (False, 5): (0, 1)}
    n = spark.createDataFrame([("c", i, i % 4) for i in range(40)], "contig string, pos long, n long")
    out = sampling.thin_exact(n, 0.5, complement=True).collect()
    assert sum(r.kept for r in out) == 30 and all(r.kept + r.rest == r.n and r.kept >= 0 and r.rest >= 0 for r in out)


def test_options_of_correlations(spark):
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal(200), rng.standard_normal(200)
    y[::7], x[::11] = 0, 0
    rows = [(t, "c", i, float(v)) for t, z in (("a", x), ("b", y)) for i, v in enumerate(z)]
    table = spark.createDataFrame(rows, "track string, contig string, pos long, value double")
    corr = lambda **o: stats.pearson_by_contig(table, **o).first().corr
    both = (x != 0) & (y != 0)
    assert corr(subset="nonzero") == pytest.approx(np.corrcoef(x[both], y[both])[0, 1])
    assert corr(clip=0.8) == pytest.approx(np.corrcoef(np.minimum(x, np.quantile(x, 0.8)), np.minimum(y, np.quantile(y, 0.8)))[0, 1])
    odd = table.withColumn("value", F.when((F.col("pos") == 3) & (F.col("track") == "a"), float("nan")).when(F.col("pos") == 5, float("inf")).otherwise(F.col("value")))
    kept = np.delete(np.arange(200), [3, 5])
    assert stats.pearson_by_contig(odd, subset="finite").first().corr == pytest.approx(np.corrcoef(x[kept], y[kept])[0, 1])
    one = table.filter("track = 'a'").drop("track")
    got = {(r.track, r.offset): r.corr for r in stats.lagged_correlation(one, table, [-2, 0, 3], ["track"]).collect()}
    for name, z in (("a", x), ("b", y)):
        for o in (-2, 0, 3):
            u, v = (x[: 200 - o], z[o:]) if o >= 0 else (x[-o:], z[:o])
            assert got[name, o] == pytest.approx(np.corrcoef(u, v)[0, 1])


def test_neighbours_across_blocks(spark):
    pos = [0, 1, 9, 10, 11, 35, 36, 70]
    rows = spark.createDataFrame([(c, p, None if p == 10 else p * 2) for c in "ab" for p in pos], "contig string, pos long, v long")
    for ahead in (False, True):
        got = physical.beside(rows, ["contig"], ["pos"], "v", "n", ahead, block=10).filter("contig = 'a'").orderBy("pos").collect()
        other = [None, *pos[:-1]] if not ahead else [*pos[1:], None]
        assert [r.n for r in got] == [None if o in (None, 10) else o * 2 for o in other]


def test_binomial_tail_of_very_large_counts():
    n = 4 * 10**9
    assert stats.binom_tail(np.array([n // 2 + 1]), np.array([n]), 0.5)[0] == pytest.approx(0.5, abs=1e-4)
    assert stats.binom_tail(np.array([n // 2 + 31623 * 2]), np.array([n]), 0.5)[0] == pytest.approx(0.02275, rel=1e-3)


def test_fastq_and_fasta_round_trip(spark, tmp_path):
    rows = [(f"r{i}", "ACGTN"[i % 5] * (i % 50 + 1), "@" + "I" * (i % 50)) for i in range(300)]
    path = tmp_path / "a.fastq"
    path.write_text("".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = text.read_fastq(spark, f"file://{path}").orderBy("record").collect()
        assert [(r.read_id, r.seq, r.qual) for r in got] == rows
        assert text.infer_read_length(text.read_fastq(spark, f"file://{path}")).first().read_length == 50
        fasta = tmp_path / "a.fa"
        seqs = {f"c{i}": "ACGT" * (i * 100 + 3) + "A" * i for i in range(5)}
        fasta.write_text("".join(f">{n} words\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for n, s in seqs.items()))
        out = text.read_fasta(spark, f"file://{fasta}", chunk=100).orderBy("contig", "chunk").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for n, s in seqs.items():
        assert "".join(r.seq for r in out if r.contig == n) == s
        assert all(r.start == r.chunk * 100 for r in out)


@pytest.mark.parametrize("pad_masked", [False, True])
def test_weighted_nan_smooth_against_plain(spark, pad_masked):
    values = [1.0, None, 3.0, float("nan"), None, None, None, 8.0, 9.0, -2.0]
    weights = windows.kernel("triangle", 5)
    assert weights == [0.0, 0.25, 0.5, 0.25, 0.0]
    rows = spark.createDataFrame([("c", i, v) for i, v in enumerate(values)], "contig string, pos long, value double")
    got = {r.pos: r.value for r in windows.nan_smooth(rows, 5, pad_masked=pad_masked, weights=weights).collect()}
    for i in range(len(values)):
        total, missing = 0.0, 0.0
        for k, w in zip(range(i + 2, i - 3, -1), weights, strict=True):
            inside = 0 <= k < len(values)
            if (inside and (values[k] is None or math.isnan(values[k]))) or (not inside and pad_masked):
                missing += w
            elif inside:
                total += w * values[k]
        assert got[i] is None if missing > 0.8 else got[i] == pytest.approx(total / (1 - missing))


def test_saturation_replicates(spark):
    bins = spark.createDataFrame([("c", i, 40, 40) for i in range(30)], "contig string, pos long, ip_count long, ctrl_count long")
    rows = stats.saturation(bins, [1], [0.5, 1.0], replicates=3).collect()
    assert sorted((r.frac, r.rep) for r in rows) == [(f, i) for f in (0.5, 1.0) for i in range(3)]
    assert all((r.ip_cov, r.ctrl_cov) == (1200, 1200) for r in rows if r.frac == 1.0)
    assert len({(r.ip_cov, r.ctrl_cov) for r in rows if r.frac == 0.5}) > 1


def test_saturation_fraction_one_is_plain(spark):
    bins = spark.createDataFrame([("c", i, 3 + (40 if i % 25 < 2 else 0), 3) for i in range(100)], "contig string, pos long, ip_count long, ctrl_count long")
    r = stats.saturation(bins, [1], [1.0], only_ip=True).first()
    assert (r.n, r.ip, r.ip_clusters) == (100, 8, 4)
    p = stats.saturation_percent(stats.saturation(bins, [1], [1.0])).first()
    assert p.ip == 8.0


def test_gc_energy_and_softmin(spark):
    rows = spark.createDataFrame([(1, "GCGCAATT")], "contig long, seq string")
    assert windows.gc_energy(rows, 8, 0.5, 0.01).first().energy == 0
    e = spark.createDataFrame([(1, i, float(i)) for i in range(4)], "id long, option int, energy double")
    p = {r.option: r.prob for r in sampling.softmin_probabilities(e, 1.0).collect()}
    assert p[0] == pytest.approx(1 / sum(math.exp(-i) for i in range(4)))
    assert sampling.softmin_choice(e, 0.001).first().option == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "contig string, pos long, value double")
    assert windows.moving_average(empty, 3).count() == 0
    assert intervals.find_peaks(empty, 0.0).count() == 0
    none = spark.createDataFrame([], "contig string, start long, end long")
    assert intervals.merge(none).count() == 0
    assert windows.coverage(none).count() == 0
    assert isinstance(stats.fdr_bh(spark.createDataFrame([], "pval double")).toPandas(), pd.DataFrame)


def test_probe_lookup_of_whole_reads(spark, tmp_path):
    from gsig.plans import registry

    a, b, c = "A" * 100 + "C", "A" * 100 + "G", "A" * 101
    text = lambda bases: bases.translate(str.maketrans("ACGT", "ABCD"))
    spark.createDataFrame([(1, text(a + b + a), "s"), (2, text(b + "ACG"), "s"), (3, "", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text(a + c + "ACG")), (2, text(b)), (3, text(b + "AC"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.seq, r.n) for r in registry.queries()["probe_lookup_whole"](spark, str(tmp_path)).collect())
    assert got == sorted([(a, 2), (b, 2), (c, 0), ("ACG", 1), ("AC", 0)])
