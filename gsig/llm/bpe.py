"""Byte-level BPE by tree reduction: halves are encoded, and neighbours joined over growing windows."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

LEAF = 32
#: Pieces in either half of what a task remembers.
CACHED = 100_000
#: No merge.
NONE = (1 << 31) - 1
#: Pieces of so many bytes in all are merged together.
GROUP = 1 << 16
#: Texts of so many characters are encoded together.
NEW = 1 << 20
#: Texts whose ids a task holds at a time.
SLICE = 128


class Pieces:
    """Encoded pieces as packed ids. When the newer half is full it becomes the older one, from which pieces that are met again come back, so its size is bounded."""

    def __init__(self):
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def get(self, piece: str) -> bytes | None:
        out = self.newer.get(piece)
        if out is None and (out := self.older.get(piece)) is not None:
            self.hold(piece, out)
        return out

    def hold(self, piece: str, out: bytes) -> None:
        if len(piece) <= 40:
            if len(self.newer) >= CACHED:
                self.newer, self.older = {}, self.newer
            self.newer[piece] = out


class Merges:
    """The merges of pairs of tokens as arrays: a table of keys that is looked up for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.width = 1 + max(ranks.values(), default=0)
        pairs = [(ranks[t[:i]] * self.width + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = np.array(pairs, np.int64).reshape(-1, 2).T
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.probes, at = 0, self.slot(keys)
        while len(keys):
            # Of the pairs that want a free slot one gets it; the others go on to the next.
            free = self.keys[at] < 0
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of what each pair makes, NONE if it makes no token."""
        keys = a.astype(np.int64) * self.width + b
        at, out = self.slot(keys), np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == keys
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (held >= 0)
            if not on.any():
                break
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """merge() of each: in a round, each piece merges its lowest-ranked adjacent pair, the first of equal ones, until none has any."""
        sizes = np.array([len(p) for p in pieces])
        out: list[list[int]] = [[]] * len(pieces)
        order = np.argsort(sizes, kind="stable")
        for some in np.array_split(order, 1 + int(sizes.sum()) // GROUP):
            n = sizes[some]
            width = int(n.max(initial=0))
            if not width:
                continue
            ids = np.full((len(some), width + 1), -1, np.int32)
            inside = np.arange(width + 1) < n[:, None]
            ids[inside] = self.single[np.frombuffer(b"".join([pieces[i] for i in some]), np.uint8)]
            if (ids[inside] < 0).any():
                raise KeyError("the ranks lack a byte")
            ranks = np.full((len(some), width), NONE, np.int32)
            two = inside[:, 1:]
            ranks[two] = self.ranks_of(ids[:, :-1][two], ids[:, 1:][two])
            row = np.arange(len(some))
            while len(row):
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(row)), at]
                done = best == NONE
                if done.any():
                    for i, tokens, size in zip(some[row[done]].tolist(), ids[done].tolist(), n[row[done]].tolist(), strict=True):
                        out[i] = tokens[:size]
                    row, ids, ranks, at, best = (x[~done] for x in (row, ids, ranks, at, best))
                    if not len(row):
                        break
                each = np.arange(len(row))
                # What stands behind the pair moves up by one place.
                place = np.arange(ids.shape[1] - 1)
                ids = np.where(place <= at[:, None], ids[:, :-1], ids[:, 1:])
                ids[each, at] = best
                ranks = np.where(place[: ranks.shape[1] - 1] <= at[:, None], ranks[:, :-1], ranks[:, 1:])
                n[row] -= 1
                last = ranks.shape[1]
                for first in (at - 1, at):
                    ok = (first >= 0) & (first < last)
                    both = ok & (first + 1 < n[row])
                    ranks[each[ok], first[ok]] = NONE
                    ranks[each[both], first[both]] = self.ranks_of(ids[each[both], first[both]], ids[each[both], first[both] + 1])
        return out


class Codec:
    """Encodes and decodes by merge ranks. Token sequences form a monoid: join() is its product, [] its unit."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes = ranks, {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pieces, self.merges = Pieces(), Merges(ranks)
        self.fits = lru_cache(1 << 16)(self._fits)

    def merge(self, piece: bytes) -> list[int]:
        """The lowest-ranked adjacent pair is merged until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        pairs = [rank(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (low := min(pairs)) < 1 << 60:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], 1 << 60)
        return [self.ranks[p] for p in parts]

    def _fits(self, a: int, b: int) -> bool:
        """Whether a, b is how their bytes are encoded. A sequence whose neighbours all fit is the encoding of its bytes."""
        return self.merge(self.bytes[a] + self.bytes[b]) == [a, b]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of what a and b encode: a window about their border is encoded anew and doubled until it fits both sides.

        Inside a and b all neighbours fit already, so once the window's ends fit too, no token outside can change.
        """
        if not a or not b or self.fits(a[-1], b[0]):
            return a + b
        n = 2
        while True:
            left, right = a[-n:], b[:n]
            window = b"".join(self.bytes[t] for t in left + right)
            new = self.merge(window)
            before, after = a[: -len(left)], b[len(right) :]
            if (not before or self.fits(before[-1], new[0])) and (not after or self.fits(new[-1], after[0])):
                return before + new + after
            n *= 2

    def leaves(self, piece: bytes) -> list[bytes]:
        """Halves of halves, down to LEAF bytes, from left to right."""
        if len(piece) <= LEAF:
            return [piece]
        mid = len(piece) // 2
        return self.leaves(piece[:mid]) + self.leaves(piece[mid:])

    def joined(self, size: int, leaves: Iterator[list[int]]) -> list[int]:
        """Up the tree of a piece of so many bytes, from its encoded leaves."""
        if size <= LEAF:
            return next(leaves)
        mid = size // 2
        left = self.joined(mid, leaves)
        return self.join(left, self.joined(size - mid, leaves))

    def tree(self, piece: bytes) -> list[int]:
        return self.joined(len(piece), iter(self.merges.merged(self.leaves(piece))))

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each, packed. The leaves of all are merged together, then the trees are joined."""
        data = [p.encode() for p in pieces]
        whole = list(map(self.ranks.get, data))
        cut = [self.leaves(d) if w is None else [] for d, w in zip(data, whole, strict=True)]
        merged = iter(self.merges.merged([leaf for leaves in cut for leaf in leaves]))
        ids = [self.joined(len(d), merged) if w is None else [w] for d, w in zip(data, whole, strict=True)]
        packed = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        return [packed[4 * i : 4 * j] for i, j in pairwise([0, *accumulate(map(len, ids))])]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """encode() of each; the new pieces of about NEW characters of texts are encoded together."""
        at = 0
        while at < len(texts):
            found, size = [], 0
            while at < len(texts) and size < NEW:
                found.append(self.find(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            known = {p: self.pieces.get(p) for p in set().union(*found)}
            new = [p for p, ids in known.items() if ids is None]
            for piece, ids in zip(new, self.encode_pieces(new), strict=True):
                known[piece] = ids
                self.pieces.hold(piece, ids)
            yield from [b"".join(map(known.__getitem__, pieces)) for pieces in found]

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian 32-bit integers. Matches of the pattern are encoded apart, so across them the product is concatenation."""
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        """Concatenates up the tree of halves."""
        if len(ids) <= 1 << 16:
            return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        mid = len(ids) // 8 * 4
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def ranks_of(data: bytes) -> dict[bytes, int]:
    """The ranks in a rank file: a line is a token in base64 and its rank."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines())}


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, digest: bool = False) -> DataFrame:
    """The rows of docs with n_tokens and ids (array<int>); with `digest`, only doc_id, n_tokens and SHA-256 of ids and of decoded bytes.

    Null texts count as empty; an empty text has no ids and the digests of no bytes. Texts of any length are taken whole, one at a
    time; a long run without a break of the pattern is halved down to leaves of 32 bytes. The rank file is read on the driver and
    sent once to each executor (under 1 MB). Rows, repeated or not, are independent; an empty table gives no rows; extra columns
    stay as they are, unless they are called like the new ones, which replace them.
    """
    with open(rank_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    held: list[Codec] = []

    def codec() -> Codec:
        if not held:
            held.append(Codec(ranks_of(data.value), pattern))
        return held[0]

    if digest:

        def digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = codec()
            for part in parts:
                rows = []
                for ids in c.encode_all(part["text"].tolist()):
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=part.index).assign(doc_id=part["doc_id"])[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec()
        for part in texts:
            for at in range(0, len(part), SLICE):
                packed = list(c.encode_all(part.slice(at, SLICE).to_pylist()))
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
                yield pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), "<i4")))

    ids = F.arrow_udf(ids, "array<int>")

    return docs.withColumn("ids", ids(F.coalesce("text", F.lit("")))).withColumn("n_tokens", F.size("ids").cast("long"))
