"""N-gram Jaccard join: MinHash bands propose, full n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed
from .words import Hashes, mixed, shingles


def bands_for(similarity: float, recall: float, rows: int = 4) -> int:
    """The least number of bands of `rows` minima that proposes a pair of this similarity with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def band_hashes(grams: np.ndarray, bands: int, rows: int, seed: int = 2) -> np.ndarray:
    """One hash per band over `rows` minima of the n-gram hashes."""
    factors = np.random.default_rng(seed).integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 8192):
        part = grams[at : at + 8192, None] * factors
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0))
    steps = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return mixed((mixed(least).reshape(bands, rows) * steps).sum(axis=1, dtype=np.uint64)).view(np.int64)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: n-grams that two sets share, column by column in blocks, as a matrix product."""
    n = len(sets)
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.r_[True, grams[1:] != grams[:-1]]
    column = np.cumsum(first) - 1
    shared = np.bincount(column) > 1
    new = np.cumsum(shared) - 1
    kept = shared[column]
    owner, column = owner[kept], new[column[kept]]
    out = np.zeros((n, n), np.float32)
    width = 2048
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for lo, hi, at in zip(cuts, cuts[1:], range(0, 1 << 62, width), strict=False):
        m = np.zeros((n, width), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        used = np.flatnonzero(m.any(axis=1))
        part = m[used]
        out[np.ix_(used, used)] += part @ part.T
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the least row that it is joined to by any path."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) edges to (node, root): the least node of each connected component, by large and small stars in turn.

    Each round joins neighbours to a lesser one; the number of rounds grows with the logarithm of a component's
    size. Edges are cut from their lineage each round and never leave the cluster; the driver sees a count and a sum.
    """
    edges = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = checkpointed(small)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """key (of doc_id and text), doc_id, set_id (of the n-gram set; null without words), bands."""

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for part in parts:
            sets = [shingles(text, words, known) for text in part["text"]]
            ids = [None if not len(s) else xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
            signs = [None if not len(s) else band_hashes(s, bands, rows) for s in sets]
            yield pd.DataFrame({"key": part["key"], "doc_id": part["doc_id"], "set_id": pd.array(ids, "Int64"), "bands": signs}).astype({"doc_id": "Int64"})

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keyed.mapInPandas(sign, "key long, doc_id long, set_id long, bands array<long>")


def join(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.999, rows: int = 4, block: int = 512) -> DataFrame:
    """key, doc_id, root, class_id, n_links for every row: documents whose sets of `words`-word n-grams have a Jaccard similarity of at least `similarity`.

    n_links counts the other rows that a document is linked to, root names all that are joined by links, class_id is the least
    doc_id of these. Ids needn't be unique, so only root tells two components apart; it is null without words.
    Equal sets are one class from the start and are never paired. Bands of minima, as many as `recall` asks for at the
    threshold, propose pairs of classes; the rest is exact. A bucket of any size is cut into blocks of about `block`
    classes; each pair of blocks is one group, which compares full n-gram sets and returns per class a number of links and
    one edge, so pairs are counted but never become rows. Buckets with the same members are compared once, and a pair
    that meets in several buckets counts in the first of them.

    Texts without words (null, empty, white space) are linked to nothing, and each is a class of its own. Fewer than `words` words
    form one n-gram. Repeated rows are linked documents. Null ids count as links but name no class unless all are null. An empty
    table gives no rows. Extra columns are not read.
    """
    signed = checkpointed(signatures(docs, words, bands_for(similarity, recall, rows), rows))
    classes = signed.filter("set_id is not null").groupBy("set_id").agg(F.min("key").alias("key"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = checkpointed(classes)
    met = classes.select("set_id", "key", "copies", F.posexplode("bands").alias("band", "bucket"))
    buckets = met.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("members")).filter("n > 1")
    kept = buckets.groupBy("members", "n").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.band", "b.bucket", "n", F.xxhash64("b.band", "b.bucket").alias("bucket_id"))
    # A class goes to every pair of blocks of its buckets that holds its own block.
    placed = met.join(kept, ["band", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("blocks")).cast("int"))
    places = placed.groupBy("set_id", "key", "copies").agg(F.collect_list(F.struct("bucket_id", "blocks", "own")).alias("places"))
    texts = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    sent = texts.join(places, "key").withColumn("ids", F.array_sort(F.col("places.bucket_id"))).withColumn("place", F.explode("places"))
    sent = sent.select("set_id", "copies", "text", "ids", F.col("place.bucket_id").alias("bucket_id"), F.col("place.own").alias("own"), F.explode(F.sequence(F.lit(0), F.col("place.blocks") - 1)).alias("other"))
    sent = sent.select("set_id", "copies", "text", "ids", "bucket_id", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("set_id")
        names, copies, own = (part[c].to_numpy() for c in ("set_id", "copies", "own"))
        known = Hashes()
        sets = [shingles(text, words, known) for text in part["text"]]
        sizes = np.array([len(s) for s in sets], float)
        shared = overlaps(sets)
        linked = shared * (1 + similarity) >= similarity * (sizes[:, None] + sizes[None, :]) - 1e-6
        np.fill_diagonal(linked, False)
        if part["i"].iat[0] != part["j"].iat[0]:
            linked &= own[:, None] != own[None, :]
        here, ids = part["bucket_id"].iat[0], [frozenset(x) for x in part["ids"]]
        rows, cols = np.nonzero(np.triu(linked))
        first = np.fromiter((min(ids[r] & ids[c]) == here for r, c in zip(rows, cols, strict=True)), bool, len(rows))
        linked = np.zeros_like(linked)
        linked[rows[first], cols[first]] = True
        linked |= linked.T
        any_link = linked.any(axis=1)
        root = names[roots(linked)]
        return pd.DataFrame({"set_id": names, "links": linked @ copies, "root": root})[any_link]

    found = checkpointed(sent.groupBy("bucket_id", "i", "j").applyInPandas(compare, "set_id long, links long, root long"))
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    joined = components(found, "set_id", "root")
    labelled = classes.join(links, "set_id", "left").join(joined, classes["set_id"] == joined["node"], "left")
    labelled = labelled.select("set_id", F.coalesce("root", "set_id").alias("root"), "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    heads = labelled.groupBy("root").agg(F.min("least").alias("class_id"))
    labelled = labelled.join(heads, "root").select("set_id", "root", "class_id", "n_links")
    out = signed.select("key", "doc_id", "set_id").join(labelled, "set_id", "left")
    return out.select("key", "doc_id", "root", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, of each component the one of least doc_id (of equal ones the least key, null ids last); rows without words stay."""
    joined = join(docs, **options)
    wordless = docs.filter(F.coalesce(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")), F.lit(0)) == 0)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    keep = joined.filter("root is not null").groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.key").alias("__key"))
    own = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    rest = own.join(wordless.select(F.xxhash64("doc_id", "text").alias("__key")).distinct(), "__key", "left_anti")
    kept = rest.join(keep, "__key", "left_semi").dropDuplicates(["__key"])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(wordless)
