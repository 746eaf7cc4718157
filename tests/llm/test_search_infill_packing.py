"""Ranked lexical search, fill-in-middle and packing against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gsig.llm import infill, packing, queries, search

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, item string, rank string, length string, data string, units string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "a", "x", "y", "z", "d", "u") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, "ONE two-two ß é"), (None, "two one"), (5, "long " * 30_000 + "end"), (6, "... ---"), (7, "a<P>b"), (8, "x" * 70_000)]


# ---- ranked lexical search


def plain_search(docs, items, k=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: pattern.findall((t or "").translate(low))
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        asked, rows = Counter(terms(text)), []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // total
            score = sum(a * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, a in asked.items() if t in c)
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item_id, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_equals_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = sorted(duck.sql(f"select item_id, rank, doc_id, score from ({queries.oracle_sql()['op11_search']})").fetchall(), key=str)
    got = found(queries.op11_search(spark, SF))
    assert got == want and len(got) > 100


@pytest.mark.parametrize("size", [(1 << 15, 1 << 21), (7, 1 << 21), (1 << 15, 40)])
def test_search_brute_force(spark, monkeypatch, size):
    """Also in tiny blocks, with many ties, long items (more than 64 terms), repeated terms and several passes over the items."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(150)]
    chosen = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.03)), 149)] for _ in range(n))
    docs = [(i // 2, chosen(rng.choice((1, 2, 5, 30, 200)))) for i in range(300)] + [(900 + i, "w1 w2") for i in range(40)] + ODD
    items = [(i, chosen(n)) for i, n in enumerate((1, 2, 4, 4, 20, 90, 400))] + [(50, None), (51, "..."), (52, "unknown"), (53, "w1 w1 w2"), (None, "two")]
    monkeypatch.setattr(search, "BLOCK_DOCS", size[0])
    monkeypatch.setattr(search, "BLOCK_POSTINGS", size[1])
    frame = spark.createDataFrame(items + items[:1], "item_id long, text string")
    want = plain_search(docs, items)
    assert found(search.search(docs_of(spark, docs).repartition(3), frame)) == want
    assert found(search.search(docs_of(spark, docs).coalesce(1), frame, pass_chars=300)) == want


def test_search_evaluates_few_documents():
    """Blocks in memory: an item whose terms lie in few documents settles without scoring the rest."""
    rng = np.random.default_rng(2)
    n, terms = 20_000, []
    for i in range(n):
        terms.append(np.unique(np.r_[rng.integers(0, 40, 12), [1000 + i % 500] if i % 50 == 0 else []]).astype(int))
    lengths = np.array([(len(t), 12) for t in terms])
    block = search.Block(list(range(n)), lengths, np.concatenate(terms), np.ones(lengths[:, 0].sum(), np.int64), n, 12 * n)
    weights = {t: 30 for t in range(20)} | {1000: 6000, 1050: 6000, 1100: 6000}
    scored, scores = [], block.scores
    block.scores = lambda docs, *rest: scored.append(len(docs)) or scores(docs, *rest)
    best = search.Best(10)
    block.search(weights, best)
    every = scores(np.arange(n), [block.place[t] for t in weights], np.array(list(weights.values())))
    assert [s for s, _ in best.rows] == sorted(every.tolist())[::-1][:10]
    assert sum(scored) < n / 20


def test_search_odd(spark):
    items = spark.createDataFrame([(1, "two"), (2, None)], "item_id long, text string")
    rows = search.search(docs_of(spark, ODD), items).collect()
    assert {(r.item_id, r.doc_id) for r in rows} == {(1, 3), (1, 4), (1, None)} and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert search.search(docs_of(spark, []), items).count() == 0
    assert search.search(docs_of(spark, ODD), items.filter("false")).count() == 0
    assert search.search(docs_of(spark, ODD[:2]), items).count() == 0


# ---- fill-in-middle


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return n, *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_infill_equals_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    names = "doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256"
    want = duck.sql(f"select {names} from ({queries.oracle_sql()['op12_infill']})").fetchall()
    assert sorted(map(tuple, queries.op12_infill(spark, SF).select(*names.split(", ")).collect())) == sorted(want)


TEXTS = st.text(st.sampled_from("abZ <PSM>\n.éŁ\U0001f600" + "xyz"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 10**6), st.integers(1, 9))
def test_infill_by_frames_of_any_size(text, doc_id, frame):
    archive = infill.Archive(*infill.Archive.of(text, frame))
    n, form, p, m, out = plain_infill(doc_id, text)
    assert int(archive.units[-1]) == n and "".join(archive.stream()) == text
    ends = np.cumsum([0, *map(len, re.findall("[A-Za-z]+|[^A-Za-z]", text))])
    assert [archive.cut(u) for u in range(n + 1)] == ends.tolist()
    got, a, b = infill.plan(archive, doc_id)
    assert got == form and (form == "plain" or (a, b - a) == (p, m))
    written = infill.rewritten(infill.output(archive, form, a, b))
    assert "".join(written.stream()) == out and "".join(infill.restored(written, form)) == text


def test_infill_marks_across_frames():
    for i in range(1, 5):
        assert infill.Archive(*infill.Archive.of("ab<M>cd", i)).holds("<P>", "<S>", "<M>")
        assert not infill.Archive(*infill.Archive.of("ab<M cd>", i)).holds("<P>", "<S>", "<M>")


def test_infill_reads_few_frames(monkeypatch):
    text = "some words of a text that is long enough. " * 20_000
    archive, read = infill.Archive(*infill.Archive.of(text)), []
    frame = infill.Archive.frame
    monkeypatch.setattr(infill.Archive, "frame", lambda self, i: read.append(i) or frame(self, i))
    archive.cut(int(archive.units[-1]) // 2)
    assert len(archive.ends) > 20 and len(set(read)) <= 2


def test_infill_odd(spark):
    frames = infill.stored(docs_of(spark, ODD))
    rows = infill.report(frames).collect()
    want = sorted((str(i), *plain_infill(i, t)[:4], sha(plain_infill(i, t)[4]), sha(t or "")) for i, t in ODD)
    assert sorted((str(r.doc_id), *r[1:]) for r in rows) == want
    assert sorted((str(r.doc_id), r.text) for r in infill.transformed(frames).collect()) == sorted((str(i), plain_infill(i, t)[4]) for i, t in ODD)
    assert infill.report(infill.stored(docs_of(spark, []))).count() == 0


# ---- packing

VOCABULARY = Path(queries.TOKENIZER).read_text(encoding="utf-8")

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.TOKENIZER)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab'sS tTdDlLreRv<|>0 9\n\t\r\x0b\x1c\x85\xa0.,!éÉßİıſKΣσςΑ²¾ªʰ́ͅ​　中"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_equal_the_library(text):
    words = packing.words_of(VOCABULARY)
    assert np.frombuffer(words.encode(text), "<u4").tolist() == words.splits.tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_special_strings(library):
    words = packing.Words(library)
    for text in ("a<|endoftext|>b", "<|endoftext|>", "x <|startoftext|> y", "<|end of text|>", "it's IT'S I'll we've", "don't'sx"):
        assert np.frombuffer(words.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def check_packing(rows, docs, library, capacity):
    """Every document whole, in pieces with the right ids, every sequence without gaps."""
    want = Counter()
    for i, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4")
            want[(i, k // capacity, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), -(-sum(r.length for r in rows) // capacity)


def test_packing_of_the_table(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    used, least = check_packing(queries.op13_packing(spark, SF).collect(), docs, library, 4096)
    assert used <= least + 1


def test_packing_in_many_groups(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "LEAST", 48)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(1000 + i, "word " * (i % 40)) for i in range(300)]
    rows = packing.pack_documents(docs_of(spark, docs), queries.TOKENIZER).collect()
    assert len({r.sequence_id >> 23 for r in rows}) > 8
    used, least = check_packing(rows, docs, library, 4096)
    assert used <= least + 4


def test_sum_of_squares_against_a_plain_search():
    rng = np.random.default_rng(3)
    for capacity in (10, 37):
        lengths = rng.integers(1, capacity + 1, 200)
        bins, offsets = packing.placed(lengths, capacity)
        gaps, count = {}, Counter()
        for i in np.argsort(-lengths, kind="stable").tolist():
            s, fits = int(lengths[i]), [g for g in range(int(lengths[i]), capacity) if count[g]]

            def squares(g, s=s):
                after = count + Counter()
                after[g] -= 1
                after[g - s] += 1
                return sum(n * n for gap, n in after.items() if 0 < gap < capacity)

            b = int(bins[i])
            if fits:
                assert squares(gaps[b]) == min(map(squares, fits))
                count[gaps[b]] -= 1
            else:
                assert b not in gaps
            assert offsets[i] == capacity - gaps.get(b, capacity)
            gaps[b] = gaps.get(b, capacity) - s
            count[gaps[b]] += 1
        assert min(gaps.values()) >= 0


def test_packing_odd(spark, library):
    rows = packing.pack_documents(docs_of(spark, ODD), queries.TOKENIZER, capacity=512).collect()
    check_packing(rows, ODD, library, 512)
    assert [(r.piece, r.length) for r in rows if r.doc_id == 1] == [(0, 1)]
    assert packing.pack_documents(docs_of(spark, []), queries.TOKENIZER).count() == 0
    held = packing.sequences(docs_of(spark, ODD), queries.TOKENIZER, capacity=512).collect()
    assert sum(len(r.ids) for r in held) == sum(r.length for r in rows) and max(len(r.ids) for r in held) == 512
