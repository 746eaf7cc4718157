"""Ranks, samples and tests when blocks are small, one key holds all rows, and tables grow."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gsig.operators import fragments, kmers, physical, sampling, scoring, stats, tracks, windows


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(physical, "BLOCK", 16)


def sizes(df):
    return [r["n"] for r in df.groupBy("_block").agg(F.count("*").alias("n")).collect()]


@pytest.mark.parametrize("value", ["id", "id * id", "exp(-id / 50.0)", "if(id % 10 > 0, 0.5, id)"])
def test_blocks_stay_small_when_the_table_grows(spark, value):
    """Also for dense whole numbers, values in a narrow range, and ties told apart by id."""
    for n in (2_000, 32_000):
        rows, several = physical.in_blocks(spark.range(n).withColumn("v", F.expr(value).cast("double")), ["v", "id"], 500)
        found = sizes(rows)
        assert several and sum(found) == n and max(found) <= 500


def test_ranks_inside_one_key(spark, small_blocks):
    rows = spark.range(500).select("id", F.lit(0.5).alias("gc"), (F.col("id") * 7919 % 101).cast("double").alias("value"))
    got = {r["id"]: (r["_r"], r["_all"]) for r in physical.ranked(rows, ["gc"], ["value", "id"]).collect()}
    order = sorted(range(500), key=lambda i: (i * 7919 % 101, i))
    assert got == {i: (r, 500) for r, i in enumerate(order)}
    strata = {r["id"]: r["group"] for r in kmers.gc_strata(rows, 10, 3).collect()}
    assert strata == {i: "low" for i in order[:50]} | {i: "high" for i in order[450:]}
    thirds = {r["id"]: r["group"] for r in kmers.terciles(rows).collect()}
    assert thirds == {i: "low" if r < 167 else "mid" if r < 334 else "high" for r, i in enumerate(order)}
    assert max(sizes(physical.in_blocks(rows, ["gc", "value", "id"])[0])) <= 16


def test_quantiles_and_q_values_by_blocks(spark, small_blocks):
    rng = np.random.default_rng(1)
    values = np.round(rng.random(400) ** 3, 3)
    rows = spark.createDataFrame([("t", int(i), float(v)) for i, v in enumerate(values)], "track string, pos long, value double")
    got = tracks.quantiles(rows, [0.0, 0.3, 0.99]).first()
    assert [got.q0, got.q1, got.q2] == pytest.approx(np.quantile(values, [0.0, 0.3, 0.99]).tolist())
    order = np.argsort(values, kind="stable")
    q = np.minimum.accumulate((values[order] * 400 / np.arange(1, 401))[::-1])[::-1].clip(max=1)
    found = {r["pos"]: r["q"] for r in stats.fdr_bh(rows, p="value", q="q").collect()}
    assert [found[int(i)] for i in order] == pytest.approx(q.tolist())


def test_splits_of_one_label_by_blocks(spark, small_blocks):
    rows = spark.range(300).select("id", F.lit(True).alias("label"))
    split = sampling.train_valid_test(rows, F.lit(0.25), 0.7, 0.2).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 210, "valid": 60, "test": 30}
    part = sampling.balanced_split(rows, "id", 7).groupBy("part").count().collect()
    assert sorted(r["count"] for r in part) == [42] * 1 + [43] * 6
    assert sorted(r["place"] for r in sampling.shuffle_reads(rows, "id").collect()) == list(range(300))


def test_split_exact_is_hypergeometric():
    rng = np.random.default_rng(2)
    for size, k in (([10**15, 3 * 10**15, 0, 7], 10**15), ([5, 0, 9], 14), ([1000] * 50, 20_000), ([3, 4], 0)):
        got = sampling.split_exact(rng, np.array(size), k)
        assert got.sum() == k and (got <= size).all() and (got >= 0).all()
    drawn = Counter(int(sampling.split_exact(rng, np.array([600, 900]), 500)[0]) for _ in range(4000))
    mean, var = 500 * 0.4, 500 * 0.4 * 0.6 * 1000 / 1499
    z = [(x - mean) / var**0.5 for x in drawn.elements()]
    assert abs(np.mean(z)) < 0.06 and abs(np.std(z) - 1) < 0.05


def test_thinning_is_exact_with_a_row_for_a_bin(spark):
    rows = spark.createDataFrame([("c", p, n) for p, n in enumerate((0, 5, 10**12, 3, 0, 7 * 10**11, 1))] + [("d", 10**6, 4), ("d", 10**6, 4), ("e", 1, None)], "contig string, pos long, n long")
    total = 17 * 10**11 + 17
    for fraction in (0.0, 0.3, 1.0):
        out = sampling.thin_exact(rows, fraction, complement=True)
        got = out.collect()
        assert len(got) == 10 and sum(r.kept for r in got) == int(total * fraction + 0.5)
        assert all(0 <= r.kept <= (r.n or 0) and (r.n is None or r.rest == r.n - r.kept) for r in got)
        assert sorted(map(str, out.collect())) == sorted(map(str, got))
    assert abs(next(r for r in sampling.thin_exact(rows, 0.3).collect() if r.n == 10**12).kept - 3 * 10**11) < 3 * 10**6
    assert sampling.thin_exact(rows.filter("false"), 0.5).count() == 0


def test_saturation_plan_and_nesting(spark):
    rng = np.random.default_rng(4)
    bins = spark.createDataFrame([("c", i, int(a), int(b)) for i, (a, b) in enumerate(zip(rng.poisson(4, 600), rng.poisson(3, 600), strict=True))], "contig string, pos long, ip_count long, ctrl_count long")
    kept = {(r.pos, r.frac): (r.ip_count, r.ctrl_count) for r in stats.thinned(bins, [1.0, 0.25, 0.5]).collect()}
    whole = {r.pos: (r.ip_count, r.ctrl_count) for r in bins.collect()}
    for p in range(600):
        for side in range(2):
            assert kept[p, 0.25][side] <= kept[p, 0.5][side] <= kept[p, 1.0][side] == whole[p][side]
    assert abs(sum(kept[p, 0.25][0] for p in range(600)) / sum(a for a, _ in whole.values()) - 0.25) < 0.05
    out = stats.saturation(bins, [1, 4], [0.5, 1.0], replicates=2)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") < 20
    rows = {(r.binsize, r.frac, r.rep): r for r in out.collect()}
    assert len(rows) == 8 and rows[4, 1.0, 0].ip_cov == sum(a for a, _ in whole.values()) == rows[1, 1.0, 1].ip_cov
    assert rows[4, 0.5, 0].ip_cov == rows[1, 0.5, 0].ip_cov != rows[1, 0.5, 1].ip_cov
    again = stats.saturation(bins.repartition(5), [1, 4], [0.5, 1.0], replicates=2)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_saturation_by_blocks_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    bins = spark.createDataFrame([("c", i, int(a), int(b)) for i, (a, b) in enumerate(zip(rng.poisson(9, 800), rng.poisson(9, 800), strict=True))], "contig string, pos long, ip_count long, ctrl_count long")
    want = sorted(map(str, stats.saturation(bins, [1, 2], [0.5, 1.0], alpha=0.9).collect()))
    monkeypatch.setattr(physical, "BLOCK", 16)
    assert sorted(map(str, stats.saturation(bins, [1, 2], [0.5, 1.0], alpha=0.9).collect())) == want


def test_permutations_of_strict_gc_once_each(spark):
    counts = {"A": 2, "C": 1, "G": 1, "T": 1}
    every = [sampling.permutation(counts, r) for r in range(60)]
    assert every == sorted({"".join(p) for p in itertools.permutations("AACGT")})
    made = [r.seq for r in sampling.strict_gc_sequences(spark, 60, 5, 0.5, seed=None).collect()]
    assert sorted(made) == every
    drawn = sampling.strict_gc_sequences(spark, 300, 30, 0.4).collect()
    assert all(Counter(r.seq) == Counter({"A": 9, "C": 6, "G": 6, "T": 9}) for r in drawn) and len({r.seq for r in drawn}) == 300
    assert sampling.strict_gc_sequences(spark, 300, 30, 0.4).repartition(7).orderBy("id").collect() == sorted(drawn)


def test_round_robin_of_files_against_a_plain_one(spark, small_blocks):
    rng = np.random.default_rng(7)
    sizes = {True: [30, 0, 4, 61], False: [9, 70]}
    rows, queues = [], {}
    for label, files in sizes.items():
        for f, n in enumerate(files):
            order = rng.permutation(n * 3)[:n]
            rows += [(int(f * 1000 + i + 10_000 * label), label, f, int(p)) for i, p in enumerate(order)]
            queues[label, f] = [int(f * 1000 + i + 10_000 * label) for i in np.argsort(order)]
    table = spark.createDataFrame(rows, "id long, label boolean, file int, place long")
    for alternate in (True, False):
        turns = {}
        for label, files in sizes.items():
            own = [queues[label, f] for f in range(len(files))]
            turns[label] = [x for r in itertools.zip_longest(*own) for x in r if x is not None] if alternate else [x for q in own for x in q]
        plain = [x for pair in zip(turns[True], turns[False], strict=False) for x in pair]
        for train in (None, 50):
            kept = plain if train is None else plain[: 20 + 10 + train]
            got = sampling.interleave_shards(table, 8, 20, 10, train, alternate).orderBy("place").collect()
            assert [r.id for r in got] == kept
            want = [("test", i // 8) if i < 20 else ("valid", (i - 20) // 8) if i < 30 else ("train", (i - 30) // 8) for i in range(len(kept))]
            assert [(r.split, r.shard) for r in got] == want
    assert sampling.interleave_shards(table.filter("label"), 8, 20, 10).count() == 0


def test_kmer_runs_across_chunks(spark, monkeypatch):
    """Runs joined over borders of chunks, and windows by hand."""
    rng = np.random.default_rng(3)
    seqs = {1: "A" * 60, 2: "".join(rng.choice(list("ACGTN"), 90, p=[0.5, 0.2, 0.1, 0.15, 0.05])), 3: "ACG", 4: ""}
    chunks = windows.chunks
    monkeypatch.setattr(windows, "chunks", lambda rows, size, stride, offset=0, chunk=8, keep=(): chunks(rows, size, stride, offset, chunk, keep=keep))
    table = spark.createDataFrame(list(seqs.items()), "contig long, seq string")
    got = {(r.contig, r.kmer, r.start): r.n for r in kmers.sliding_kmer_counts(table, 2, 10).collect()}
    want = {}
    for contig, seq in seqs.items():
        for start in range(len(seq) - 9):
            for m, n in Counter(seq[i : i + 2] for i in range(start, start + 9) if "N" not in seq[i : i + 2]).items():
                want[contig, m, start] = n
    assert got == want
    assert [(r.start, r.end, r.n) for r in kmers.sliding_kmer_runs(table.filter("contig = 1"), 2, 10).collect()] == [(0, 51, 9)]
    assert {(r.contig, r.start): r.gc for r in windows.sliding_gc(table.filter("contig < 4"), 10).collect()} == {(c, s): None if set(w) == {"N"} else (w.count("G") + w.count("C")) / (len(w) - w.count("N")) for c, q in seqs.items() if q for s in range(max(1, len(q) - 9)) for w in (q[s : s + 10],)}
    counts = {(r.contig, r.kmer): r.n for r in kmers.kmer_counts_by_seq(table, 3).collect()}
    assert counts == {(c, m): n for c, q in seqs.items() for m, n in Counter(q[i : i + 3] for i in range(len(q) - 2) if "N" not in q[i : i + 3]).items()}


def test_autocorrelation_by_hand(spark):
    rng = np.random.default_rng(8)
    x = {(c, p): float(np.sin(p / (3 + c)) * 50 + rng.normal()) for c in range(2) for p in range(1000) if rng.random() < 0.97}
    table = spark.createDataFrame([(c, p, v) for (c, p), v in x.items()], "contig long, pos long, value double")
    got = {(r.contig, r.block): r.period for r in stats.autocorr_period(table, 300, 100, (5, 60)).collect()}
    for c in range(2):
        smooth = {p: sum(x.get((c, q), 0.0) for q in range(p - 4, p + 4)) / 8 for k, p in x if k == c}
        for b in range(4):
            own = {p: v for p, v in smooth.items() if p // 300 == b}
            if len(own) < 100:
                assert (c, b) not in got
                continue
            m = np.mean(list(own.values()))
            r = {lag: round(sum((v - m) * (own[p + lag] - m) for p, v in own.items() if p + lag in own), 6) for lag in range(5, 60)}
            best = min(r, key=lambda lag: (-r[lag], lag))
            assert got[c, b] == (best if 5 < best < 59 else None)


def test_extension_and_folding_by_hand(spark):
    schema = "qname string, flag int, contig string, tlen long, next_pos long, blocks array<struct<start: long, end: long>>"
    rows = [("f", 99, "c", 60, 120, [(100, 110), (110, 120)]), ("r", 147, "c", -60, 70, [(100, 110), (130, 140)]), ("s", 0, "c", 0, 0, [(5, 15)]), ("t", 16, "c", 0, 0, [(5, 15)])]
    table = spark.createDataFrame(rows, schema)

    def spans(**options):
        out = {}
        for r in fragments.offsets(table, 1, -1, **options).collect():
            out.setdefault(r.qname, []).append((r.start, r.end))
        return out

    assert spans() == {"f": [(100, 120)], "r": [(100, 110), (130, 140)], "s": [(5, 15)], "t": [(5, 15)]}
    assert spans(extend=30) == {"f": [(100, 160)], "r": [(70, 110), (130, 140)], "s": [(5, 35)], "t": [(0, 15)]}
    assert spans(extend=30, max_pair=10) == {"f": [(100, 130)], "r": [(90, 110), (130, 140)], "s": [(5, 35)], "t": [(0, 15)]}
    assert spans(extend=30, center=True)["s"] == [(15, 25)] and spans(extend=30, center=True)["f"] == [(120, 140)]
    assert set(spans(rna_strand="forward")) == {"t"} and set(spans(rna_strand="reverse")) == {"f", "r", "s"}


def test_substitutions_across_chunks(spark):
    scorer = scoring.linear_scorer(np.arange(15.0).reshape(3, 5) % 7)
    seqs = [(i, "".join(np.random.default_rng(i).choice(list("ACGTN"), n))) for i, n in enumerate((2, 3, 4, 9, 40))]
    table = spark.createDataFrame(seqs, "contig long, seq string")
    each = table.filter("length(seq) > 0").select("contig", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("pos")).withColumn("mutant", F.explode(F.array(*map(F.lit, "ACGT"))))
    each = each.filter(F.substring("seq", F.col("pos") + 1, F.lit(1)) != F.col("mutant")).drop("seq")
    key = lambda df: {(r.contig, r.pos, r.mutant): pytest.approx(r.value) for r in df.collect()}
    want = key(scoring.mutation_scores(table, each, scorer, 3))
    for chunk in (1, 7, 1 << 12):
        assert key(scoring.substitution_scores(table, scorer, 3, chunk)) == want
    assert len(want) > 150
