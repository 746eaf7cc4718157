"""Best-fit packing: token ids cut into pieces, placed by the sum of squares of open bins per residual gap."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import written

CACHED = 600_000
#: Pieces that are packed together, at most on average; of a small table at least.
GROUP, LEAST = 1 << 16, 1 << 10
#: A small table is dealt to so many groups.
GROUPS = 64
#: Sequences with a larger share of free room are opened again, and their pieces packed with those of other groups.
LOOSE = 1 / 16
#: Rounds at most; each leaves about a sequence a group.
LEVELS = 5
#: Printable characters up to U+02AF: no white space, nothing that combines, so that lower case goes by character.
SIMPLE = re.compile("[!-~¡-ʯ]*")
#: The splits that the tokenizer's file names, in an order that lets words be found first.
SPLITS = regex.compile(r"\p{L}+|\p{N}|'(?:s|t|re|ve|m|ll|d)|[^\s\p{L}\p{N}]+")


class Splits(dict):
    """Packed ids of splits, the parts of a text that merges stay inside. Emptied when full."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, split: str) -> bytes:
        out = np.array([t.id for t in self.tokenizer.model.tokenize(split)], "<u4").tobytes() if split.isascii() else self.whole(split)
        if len(split) <= 40:
            if len(self) >= CACHED:
                self.clear()
            self[split] = out
        return out


class Words(dict):
    """Packed ids of words. White space is dropped, so a text's ids are those of its words in order. Emptied when full.

    Simple words are put in lower case and split here; others go to the tokenizer as they are, and so do its special tokens.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.splits = Splits(tokenizer)

    def __missing__(self, word: str) -> bytes:
        small = word.lower()
        if small.isascii() and small.isalpha():
            out = self.splits[small]
        elif "<|" in word or not SIMPLE.fullmatch(word) or not SIMPLE.fullmatch(small):
            out = self.splits.whole(word)
        else:
            out = b"".join(map(self.splits.__getitem__, SPLITS.findall(small)))
        if len(word) <= 40:
            if len(self) >= CACHED:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(1)
def words_of(tokenizer: str) -> Words:
    """The words that a worker process knows, which outlive its tasks."""
    return Words(Tokenizer.from_str(tokenizer))


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids: each document's token ids and an end id, cut after every `capacity`.

    The tokenizer's file is read on the driver and sent once to each executor (a few MB).
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = words_of(sent.value)
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                packed = words.encode(text or "") + end
                for i, at in enumerate(range(0, len(packed), 4 * capacity)):
                    piece = packed[at : at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(piece) // 4, zlib.crc32(piece), *[np.frombuffer(piece, "<i4")] * ids))
                if ids and len(rows) >= 256:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]).astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def placed(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. Longest first, each goes to the gap after which the sum over gaps g of N(g)^2 is least,
    N(g) the number of open bins with so much room; of equal ones to the smallest gap. Only what no open bin can take opens one.

    To move a bin from gap g to g - s changes the sum by 2 (N(g-s) - N(g)) + 2, or by 1 - 2 N(s) if it closes the bin.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        change = 2 * (count[: capacity - s] - count[s:capacity]) + 2
        if len(change):
            change[0] = 1 - 2 * count[s]
            change[count[s:capacity] == 0] = np.iinfo(np.int64).max
            g = s + int(change.argmin())
        if len(change) and count[g]:
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            g, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def grouped(rows: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """rows (of a written table) with sequence_id, offset, and loose: whether their sequence has much room left. Rows are dealt evenly by
    their place in the table, so equal rows lie in different groups."""
    columns = rows.columns
    dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        lengths = part["length"].to_numpy()
        bins, offsets = placed(lengths, capacity)
        fill = np.bincount(bins, weights=lengths)
        return part[columns].assign(sequence_id=((part["group"].to_numpy() << 20) + bins) * 8 + level, offset=offsets, loose=capacity - fill[bins] > LOOSE * capacity)

    return dealt.groupBy("group").applyInPandas(pack, f"{schema}, sequence_id long, offset long, loose boolean")


def packed(rows: DataFrame, capacity: int = 4096) -> DataFrame:
    """Pieces with sequence_id and offset: sequences of at most `capacity`, without gaps between pieces.

    Pieces of full length are sequences of their own. All others are dealt to groups of at most about GROUP and packed there by
    sum of squares. Sequences that stay loose (about one a group) are opened and their pieces packed again in fewer groups, until it is one.
    Packing has no state beyond its group, so a lost task is run again alone.
    """
    rows = written(rows)
    place = [*rows.columns, "sequence_id", "offset"]
    out = rows.filter(F.col("length") >= capacity).withColumns({"sequence_id": F.monotonically_increasing_id() * 8, "offset": F.lit(0).cast("long")}).select(*place)
    left = rows.filter(F.col("length") < capacity)
    for level in range(1, LEVELS + 1):
        n = left.count()
        groups = max(-(-n // GROUP), min(GROUPS, -(-n // LEAST)), 1)
        found = grouped(left, groups, capacity, level)
        if groups == 1 or level == LEVELS:
            return out.union(found.select(*place))
        found = written(found)
        out = out.union(found.filter("not loose").select(*place))
        left = found.filter("loose").select(*rows.columns)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    A document is the ids of its whole text and the end id. Null texts count as empty: one piece, the end id. Only documents of more than
    `capacity` ids are cut; a last piece is never empty. Rows that repeat, and rows without a doc_id, are packed one by one like
    others. An empty table gives no rows. Extra columns are not read.
    """
    return packed(pieces(docs, tokenizer_file, capacity, end_id), capacity)


def sequences(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """sequence_id, doc_ids, ids: the sequences themselves, the ids of their pieces in order and the documents these are of."""
    rows = packed(pieces(docs, tokenizer_file, capacity, end_id, ids=True), capacity)
    held = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return held.select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("ids"))
