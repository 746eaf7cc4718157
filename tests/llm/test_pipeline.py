"""The corpus pipeline, stage by stage on small tables."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from gsig.llm import bpe, mixing, quality
from gsig.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] <= sizes[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == sizes[-1]
    assert last.filter("n_tokens <> size(ids)").count() == 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r.doc_id for r in corpus_pipeline.good(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert sum(i in good for i, q in labels.items() if q == 1) >= 0.98 * sum(labels.values())
    assert sum(i in good for i, q in labels.items() if q == 0) <= 0.25 * sum(q == 0 for q in labels.values())


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns with clashing names pass all stages; an empty table stays empty."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, `held.out` string, row int, bands string, removed string"
    prose = "The committee met in spring and agreed on a plan for the bridge over the river."
    rows = [(i, f"{prose} {i} {i * 7} {i * 31}", "en", "a", 1, 42.0, 7, "h", 3, "b", "r") for i in range(6)]
    rows += [(None, None, None, None, None, None, None, None, None, None, None), (9, "", "en", "b", 0, 42.0, 7, "h", 3, "b", "r"), (9, "", "en", "b", 0, 42.0, 7, "h", 3, "b", "r")]
    docs = spark.createDataFrame(rows, schema)
    for part in (docs, docs.filter("false"), docs.filter("doc_id is null")):
        left = part
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = written(stage(spark, left, SF))
            assert left.columns == docs.columns
            assert {(r.score, r.predicted, r["held.out"], r.row, r.bands, r.removed) for r in left.collect()} <= {(42.0, 7, "h", 3, "b", "r"), (None,) * 6}
        assert corpus_pipeline.STAGES[-1][1](spark, left, SF).count() == left.count()


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares of all words by weight, none above `most` times its source's size; sources by code point, null last."""
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode("utf-32-be")))
    weight, total, out = {x: weights[i % 3] for i, x in enumerate(names)}, sum(sizes.values()), {}
    while True:
        free = [x for x in names if x not in out]
        left = total - sum(out.values())
        share = {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
        over = [x for x in free if share[x] > most * sizes[x]]
        if not over:
            return out | share
        out |= {x: most * sizes[x] for x in over}


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def drawn_plainly(spark, rows, targets, block_words, seed=7):
    """(key, copy) -> words taken: whole passes over each source, then blocks in the order of their hash until the rest is reached."""
    parts, taken = [], Counter()
    totals = Counter()
    for r in rows:
        totals[r.source] += r.size
    for r in rows:
        goal = int(targets[r.source] + 0.5)
        full = goal // totals[r.source] if totals[r.source] else 0
        taken[r.key, r.copy] += full * r.size
        n = -(-r.size // block_words) if block_words else 1
        parts += [(r.source, r.key, r.copy, b, full, min(block_words, r.size - b * block_words) if block_words else r.size) for b in range(n if r.size else 0)]
    hashed = spark.createDataFrame(parts, "source string, key long, copy int, block long, pass long, words long").withColumn("u", F.xxhash64("key", "copy", "block", "pass", F.lit(seed))).collect()
    for source in totals:
        left = int(targets[source] + 0.5) - (int(targets[source] + 0.5) // totals[source] if totals[source] else 0) * totals[source]
        for r in sorted((x for x in hashed if x.source == source), key=lambda x: (x.u, x.key, x.copy, x.block)):
            got = min(r.words, max(left, 0)) if block_words else r.words if left * 2 >= r.words else 0
            taken[r.key, r.copy] += got
            left -= r.words
    return +taken


def test_mix_against_a_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(20))
    rows = mixing.sized(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    targets = plain_targets(sizes)
    got = mixing.targets(mixing.sized(docs)).collect()
    assert {r.source: r.target for r in got} == {k: pytest.approx(v) for k, v in targets.items()}
    names = ("key", "copy")
    mixed = mixing.mix(mixing.sized(docs), mixing.targets(mixing.sized(docs)), shard_blocks=16)
    assert {tuple(r[c] for c in names): r.n for r in mixed.groupBy(*names).agg(F.sum("taken").alias("n")).collect()} == drawn_plainly(spark, rows, targets, 256)
    assert mixed.select("shard").distinct().count() > 4


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_each_stage_against_a_plain_version(spark):
    """On its own input: what the classifier keeps, which lines go, one document of each component, the draws of whole documents, ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    said = {r.doc_id: r.predicted for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    good = written(corpus_pipeline.good(spark, docs, SF))
    assert sorted(tuple(r) for r in good.collect()) == sorted(tuple(r) for r in docs.collect() if said[r.doc_id] == 1)

    seen, want = [], {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        lines, kept, cut = r.text.split("\n"), [], False
        for line in lines:
            words = frozenset(line.lower().encode().split())
            repeat = bool(words) and any(len(words & x) >= 0.8 * len(words | x) - 1e-9 for x in seen)
            cut |= repeat
            kept += [] if repeat else [line]
            seen += [words] if words else []
        if not cut or any(line.split() for line in kept):
            want[r.doc_id] = "\n".join(kept)
    lines = written(corpus_pipeline.fresh_lines(spark, good, SF))
    assert {r.doc_id: r.text for r in lines.collect()} == want

    sets = {r.doc_id: shingles(r.text) for r in lines.collect()}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                group[root(a)] = root(b)
    once = written(corpus_pipeline.one_of_each(spark, lines, SF))
    kept = [r.doc_id for r in once.collect()]
    assert len(kept) == len(set(kept)) and sorted(root(i) for i in kept) == sorted({root(i) for i in ids})

    mixed = written(corpus_pipeline.mixed(spark, once, SF))
    rows = mixing.sized(once).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    taken = drawn_plainly(spark, rows, plain_targets(sizes), None)
    times = Counter(r.doc_id for r in mixed.collect())
    assert times == +Counter({r.doc_id: taken[r.key, r.copy] // r.size for r in rows if r.size})

    with open(corpus_pipeline.RANKS, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(f.read()), special_tokens={})
    text = {r.doc_id: r.text for r in once.collect()}
    last = corpus_pipeline.encoded(spark, mixed, SF).collect()
    assert all(np.array_equal(r.ids, library.encode_ordinary(text[r.doc_id])) for r in last) and len(last) == sum(times.values())
