"""Ranked lexical search: documents of a block are grouped by which of an item's terms they hold, and masks are evaluated best first."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import written

#: Letters and digits of ASCII and all bytes of other characters make terms; A-Z become a-z, the rest become spaces.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents and postings of a block that a task searches at a time.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 15, 1 << 21
#: Characters of items that are searched in one pass over the documents.
PASS_CHARS = 1 << 23
#: Documents whose scores are computed first; each later step takes twice as many.
FIRST = 64


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERMS).split()


class Block:
    """Inverted lists of some documents: for each term the documents that hold it, ascending, and what one occurrence in the item adds.

    `part` is the quotient of the score, which depends on the document and the term's occurrences in it but not on the item.
    """

    def __init__(self, doc_ids: list, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, total: int):
        self.doc_ids, self.n = doc_ids, len(doc_ids)
        doc = np.repeat(np.arange(self.n), lengths[:, 0])
        m = np.array([25 + 75 * n * n_docs // total for n in lengths[:, 1].tolist()])
        part = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[doc])
        order = np.argsort(terms, kind="stable")
        self.doc, self.part = doc[order], part[order]
        self.terms, self.start = np.unique(terms[order], return_index=True)
        self.end = np.append(self.start[1:], len(terms))
        self.most = np.maximum.reduceat(self.part, self.start) if len(terms) else np.zeros(0, np.int64)
        self.place = {t: i for i, t in enumerate(self.terms.tolist())}
        self.bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, i: int) -> np.ndarray:
        """The documents of a list as packed bits; those of long lists are kept."""
        if i in self.bitmaps:
            return self.bitmaps[i]
        flags = np.zeros(self.n, bool)
        flags[self.doc[self.start[i] : self.end[i]]] = True
        out = np.packbits(flags)
        if (self.end[i] - self.start[i]) * 64 > self.n:
            self.bitmaps[i] = out
        return out

    def scores(self, docs: np.ndarray, lists: list[int], weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents, ascending."""
        out = np.zeros(len(docs), np.int64)
        for i, w in zip(lists, weights.tolist(), strict=True):
            held, part = self.doc[self.start[i] : self.end[i]], self.part[self.start[i] : self.end[i]]
            at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            out += np.where(held[at] == docs, part[at] * w, 0)
        return out

    def masks(self, docs: np.ndarray, lists: list[int]) -> np.ndarray:
        """(document, word): the terms a document holds, as bits in the order of lists."""
        out = np.zeros((len(docs), -(-len(lists) // 64)), np.uint64)
        for j, i in enumerate(lists):
            held = self.bitmap(i)[docs >> 3] >> (7 - (docs & 7)).astype(np.uint8) & 1
            out[:, j // 64] |= held.astype(np.uint64) << np.uint64(63 - j % 64)
        return out

    def search(self, weights: dict[int, int], best: Best) -> None:
        """Adds to `best` every document that belongs there. weights: of the item's terms, times their occurrences in it."""
        known = [(self.place[t], w) for t, w in weights.items() if t in self.place and w > 0]
        if not known:
            return
        known.sort(key=lambda x: (-int(self.most[x[0]]) * x[1], x[0]))
        lists, weight = [i for i, _ in known], np.array([w for _, w in known], np.int64)
        top = self.most[lists] * weight
        beyond = np.append(np.cumsum(top[::-1])[::-1], 0)  # what the terms from here on can add at most
        # Documents with the strongest terms set a floor before any grouping.
        some, j = np.zeros(-(-self.n // 8), np.uint8), 0
        while best.floor == 0 and j < len(lists) and np.bitwise_count(some).sum() < best.k:
            some |= self.bitmap(lists[j])
            j += 1
        done = np.flatnonzero(np.unpackbits(some, count=self.n))[: FIRST * 4]
        best.add(self, done, self.scores(done, lists, weight))
        # A document without any of the first `e` terms stays below the floor.
        e = int(np.argmax(beyond < best.floor)) if best.floor and beyond[-1] < best.floor else len(lists)
        some = np.bitwise_or.reduce([self.bitmap(i) for i in lists[:e]]) if e else some[:0]
        docs = np.setdiff1d(np.flatnonzero(np.unpackbits(some, count=self.n if e else 0)), done, assume_unique=True)
        if not len(docs):
            return
        masks = self.masks(docs, lists)
        order = np.lexsort(masks.T[::-1])
        masks, docs = masks[order], docs[order]
        start = np.flatnonzero(np.r_[True, (masks[1:] != masks[:-1]).any(axis=1)])
        size = np.diff(np.append(start, len(docs)))
        held = np.unpackbits(masks[start].byteswap().view(np.uint8), axis=1, count=len(lists))
        bound = held @ top
        order = np.argsort(-bound, kind="stable")
        at, step = 0, FIRST
        while at < len(order) and bound[order[at]] >= best.floor:
            to = at + max(1, int(np.searchsorted(np.cumsum(size[order[at:]]), step)))
            to = max(at + 1, min(to, at + int(np.count_nonzero(bound[order[at:to]] >= best.floor))))
            chosen = order[at:to]
            some = np.sort(docs[np.repeat(start[chosen] - np.cumsum(size[chosen]) + size[chosen], size[chosen]) + np.arange(size[chosen].sum())])
            best.add(self, some, self.scores(some, lists, weight))
            at, step = to, step * 2


class Best:
    """The k best documents of an item so far: highest score first, equal scores by ascending doc_id, nulls last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> int:
        """Scores below this have no place any more."""
        return self.rows[-1][0] if len(self.rows) == self.k else 0

    def add(self, block: Block, docs: np.ndarray, scores: np.ndarray) -> None:
        enough = np.flatnonzero(scores >= max(1, self.floor))
        if len(enough) > self.k:
            # Ties with the k-th all stay until their ids are compared.
            enough = enough[scores[enough] >= np.partition(scores[enough], -self.k)[-self.k]]
        if len(enough):
            new = [(int(scores[i]), block.doc_ids[docs[i]]) for i in enough]
            self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.k]


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms, tfs: what each document with at least one term holds of the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = known.value
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                if words := terms_of(text):
                    held = [(place[w], c) for w, c in Counter(words).items() if w in place]
                    rows.append((doc_id, len(words), [t for t, _ in held], [c for _, c in held]))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "tfs"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def ranked_pass(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """item (place in `items`), doc_id, score: the k best of each item in each task. items: (item_id, terms) of one pass."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    spark = docs.sparkSession
    held = written(postings(docs, vocabulary))
    n_docs, total = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row for each term of this pass at most.
    frequency = {r[0]: r[1] for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in frequency.items()}
    wanted = [{vocabulary[t]: c * weight.get(vocabulary[t], 0) for t, c in Counter(terms).items()} for _, terms in items]
    sent = spark.sparkContext.broadcast(wanted)

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(k) for _ in sent.value]

        def run(ids: list, lengths: list, terms: list, tfs: list) -> None:
            if ids:
                block = Block(ids, np.array(lengths), np.concatenate(terms), np.concatenate(tfs), n_docs, total)
                for weights, b in zip(sent.value, best, strict=True):
                    block.search(weights, b)

        ids, lengths, terms, tfs, size = [], [], [], [], 0
        for part in parts:
            for doc_id, n, t, c in zip(part["doc_id"], part["n"], part["terms"], part["tfs"], strict=True):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                lengths.append((len(t), n))
                terms.append(t)
                tfs.append(c)
                size += len(t)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    run(ids, lengths, terms, tfs)
                    ids, lengths, terms, tfs, size = [], [], [], [], 0
        run(ids, lengths, terms, tfs)
        rows = [(i, doc_id, score) for i, b in enumerate(best) for score, doc_id in b.rows]
        yield pd.DataFrame(rows, columns=["item", "doc_id", "score"]).astype({"doc_id": "Int64"})

    return held.filter(F.size("terms") > 0).mapInPandas(search, "item int, doc_id long, score long")


def passes(items: DataFrame, chars: int) -> Iterator[list[tuple]]:
    """(item_id, terms) of each different item with terms, about `chars` characters of them at a time."""
    rows = written(items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct())
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // chars))
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        part = [(r["item_id"], terms) for r in part if (terms := terms_of(r["text"]))]
        if part:
            yield part


def search(docs: DataFrame, items: DataFrame, k: int = 10, pass_chars: int = PASS_CHARS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents with a score above 0.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case. N documents have
    terms, L of them with repeats; a term in df documents weighs floor(1000 ln((2N+2)/(2df+1))), and adds for each of its
    occurrences in the item weight * (10^9 tf div (1000 tf + 8 m)), where m = 25 + (75 n N div L) for a document of n terms.

    One pass over the texts writes what documents hold of the items' terms; counts over all of them give the weights.
    Each task then inverts its documents in blocks. For an item, bitmaps of its strongest terms give the documents that can still
    reach the k-th score; these are grouped by the mask of the item's terms they hold, and masks are evaluated from the highest
    attainable score downwards until none left can reach the k-th. Tasks return k rows for each item. Items are searched
    in passes of about `pass_chars` characters, so that what is broadcast stays bounded; the results are the same.

    Null and empty texts have no terms: such items have no rows, such documents don't count. Equal scores go by
    ascending doc_id, nulls last; documents that repeat wholly each have a rank. Items that repeat wholly count once; different
    items of one item_id are ranked apart. Empty tables give no rows. Extra columns are not read.
    """
    out = None
    for at, part in enumerate(passes(items, pass_chars)):
        names = docs.sparkSession.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(part)], "item int, item_id long")
        found = ranked_pass(docs, part, k).withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
        rows = found.filter(F.col("rank") <= k).join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = rows if at == 0 else out.union(rows)
    return nothing(docs.sparkSession) if out is None else out


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
