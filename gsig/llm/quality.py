"""Quality classifier: a linear-chain conditional random field labels lines; its marginals make a document's score."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .words import Hashes

#: Shape measures of a line; the next two groups are the same measures of the lines before and after it.
SHAPES = 12
FEATURES = 3 * SHAPES + 3
#: Words are features too, by so many top bits of their hash.
WORD_BITS = 14
#: Characters of the texts that are measured together; a longer text is measured alone.
SLICE = 1 << 19
MARKS = "#$%&*!|<>{}@~^=_"
ALPHA, DIGIT, UPPER, LOWER, SPACE, MARK = (1 << i for i in range(6))


@cache
def kinds() -> np.ndarray:
    """Kinds of the characters of the planes that hold letters."""
    tests = ((ALPHA, str.isalpha), (DIGIT, str.isdigit), (UPPER, str.isupper), (LOWER, lambda c: c.islower() or (c.istitle() and not c.isupper())), (SPACE, str.isspace), (MARK, MARKS.__contains__))
    return np.array([sum(bit for bit, test in tests if test(c)) for c in map(chr, range(0x40000))], np.uint8)


@dataclass
class Lines:
    """Lines of some texts: features, lengths, number of lines of each text, and buckets and lines of their words."""

    x: np.ndarray
    size: np.ndarray
    texts: np.ndarray
    bucket: np.ndarray
    owner: np.ndarray

    def potential(self, model: Model) -> np.ndarray:
        words = np.bincount(self.owner, weights=model.words[self.bucket], minlength=len(self.x)) / self.n_words
        return self.x @ model.weights + np.c_[np.zeros(len(self.x)), words]

    @property
    def n_words(self) -> np.ndarray:
        return np.maximum(1, np.bincount(self.owner, minlength=len(self.x)))


@dataclass
class Model:
    """Weights of features (FEATURES, 2) and of words (for the label 1), and of moves between labels (2, 2)."""

    weights: np.ndarray
    words: np.ndarray
    moves: np.ndarray


def measured(texts: list[str], known: Hashes) -> Lines:
    """The lines of texts. A line's features hold the shapes of its neighbours, its length, whether it is the first, and a constant.

    Shapes do not depend on language: shares of upper-case words, letters, digits, marks, repeated and distinct words, length of words,
    bars and exclamation marks, the end of a sentence, a capital at the start, emptiness. Whole lines are measured.
    """
    text = "\n".join(texts)
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kind = np.where(code < 0x40000, kinds()[np.minimum(code, 0x3FFFF)], 0).astype(np.uint8)
    breaks = np.flatnonzero(code == 10)
    start, end = np.r_[0, breaks + 1], np.r_[breaks, len(code)]
    n = len(start)
    per_text = np.array([t.count("\n") + 1 for t in texts])

    def among(at: np.ndarray) -> np.ndarray:
        """How many of the places `at` each line has."""
        return np.diff(np.searchsorted(at, np.r_[start, len(code) + 1])).astype(float)

    filled = np.r_[False, (kind & SPACE) == 0, False]
    begin, stop = (np.flatnonzero(filled[1:] & ~filled[:-1]), np.flatnonzero(filled[:-1] & ~filled[1:]))
    words = np.fromiter(map(known.__getitem__, text.split()), np.uint64, len(begin))
    owner = np.searchsorted(start, begin, side="right") - 1
    k = np.maximum(1, np.bincount(owner, minlength=n)).astype(float)
    inside = lambda bit: np.diff(np.searchsorted(np.flatnonzero(kind & bit), np.c_[begin, stop]), axis=1)[:, 0] > 0
    of_line = lambda chosen: np.bincount(owner[chosen], minlength=n)
    again = np.r_[False, (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])][: len(words)]
    order = np.lexsort((words, owner))
    new = np.r_[True, (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])][: len(words)]
    size = (end - start).astype(float)
    some, each = size > 0, np.maximum(1.0, size)
    last, first = np.where(some, code[np.maximum(end - 1, 0)] if len(code) else 0, 0), np.zeros(n, bool)
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
    first[owner[heads]] = (kind[begin[heads]] & UPPER) > 0
    own = np.c_[
        of_line(inside(UPPER) & ~inside(LOWER)) / k,
        among(np.flatnonzero(kind & ALPHA)) / each,
        among(np.flatnonzero(kind & DIGIT)) / each,
        np.minimum(among(np.flatnonzero(kind & MARK)) / k, 4.0),
        of_line(again) / k,
        of_line(order[new]) / k,
        np.minimum(size / k, 20.0) / 10,
        among(np.flatnonzero(code == ord("|"))) / k,
        among(np.flatnonzero(code == ord("!"))) / k,
        np.isin(last, [ord(c) for c in ".!?"]),
        first,
        ~some,
    ]
    own[~some, : SHAPES - 1] = 0.0
    head = np.zeros(n, bool)
    head[np.cumsum(per_text)[:-1]] = True
    head[0] = True
    none = np.zeros((1, SHAPES))
    before = np.where(head[:, None], 0.0, np.r_[none, own[:-1]])
    after = np.where(np.r_[head[1:], True][:, None], 0.0, np.r_[own[1:], none])
    x = np.c_[own, before, after, np.log1p(size) / 8, head, np.ones(n)]
    return Lines(x, size, per_text, (words >> np.uint64(64 - WORD_BITS)).astype(np.int64), owner)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines, FEATURES) and the lengths of the lines of one text."""
    lines = measured([text], Hashes())
    return lines.x, lines.size


def shape(line: str) -> tuple[float, ...]:
    return tuple(line_features(line)[0][0, :SHAPES].tolist())


def marginals(potential: np.ndarray, moves: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over chains of `sizes` lines that follow one another (None: one chain), all chains in step.

    P(label) per line, expected moves between labels and log of the normaliser, the latter two summed over chains.
    """
    sizes = np.array([len(potential)]) if sizes is None else np.asarray(sizes)
    order = np.argsort(-sizes, kind="stable")
    start, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # chains of more than i lines
    forward, backward = potential.astype(float), np.zeros((len(potential), 2))
    for i in range(1, longest):
        at = start[: active[i]] + i
        was = forward[at - 1]
        for y in range(2):
            forward[at, y] += np.logaddexp(was[:, 0] + moves[0, y], was[:, 1] + moves[1, y])
    for i in range(longest - 1, 0, -1):
        at = start[: active[i]] + i
        after = potential[at] + backward[at]
        for y in range(2):
            backward[at - 1, y] = np.logaddexp(after[:, 0] + moves[y, 0], after[:, 1] + moves[y, 1])
    ends = np.cumsum(sizes) - 1
    norms = np.logaddexp(forward[ends, 0], forward[ends, 1])
    norm = np.repeat(norms, sizes)
    inner = np.delete(np.arange(len(potential)), np.cumsum(sizes) - sizes)  # lines with one before
    pairs = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            pairs[a, b] = np.exp(forward[inner - 1, a] + moves[a, b] + potential[inner, b] + backward[inner, b] - norm[inner]).sum()
    return np.exp(forward + backward - norm[:, None]), pairs, float(norms.sum())


def joined(parts: list[Lines]) -> Lines:
    """Lines of several texts as one."""
    offset = np.cumsum([0, *(len(p.x) for p in parts)])
    return Lines(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("x", "size", "texts", "bucket")), np.concatenate([p.owner + o for p, o in zip(parts, offset, strict=False)]))


def fit(chains: list[tuple[Lines, np.ndarray]], steps: int = 60, batch: int = 400, l2: float = 1e-4, seed: int = 5) -> Model:
    """The model that maximises the likelihood of chains of (lines, labels), by Adam over batches."""
    dense, n_words = FEATURES * 2, 1 << WORD_BITS
    theta = np.zeros(dense + n_words + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    rng = np.random.default_rng(seed)
    model = lambda: Model(theta[:dense].reshape(FEATURES, 2), theta[dense:-4], theta[-4:].reshape(2, 2))
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(chains), min(batch, len(chains)))
        lines, y = joined([chains[i][0] for i in chosen]), np.concatenate([chains[i][1] for i in chosen])
        p, pairs, _ = marginals(lines.potential(model()), model().moves, lines.texts)
        truth = np.eye(2)[y]
        inner = np.delete(np.arange(len(y)), np.cumsum(lines.texts) - lines.texts)
        missed = (truth - p)[:, 1] / lines.n_words
        grad = np.r_[(lines.x.T @ (truth - p)).ravel(), np.bincount(lines.bucket, weights=missed[lines.owner], minlength=n_words), (truth[inner - 1].T @ truth[inner] - pairs).ravel()] / len(y) - l2 * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return model()


def relabelled(chains: list[tuple[Lines, np.ndarray]], model: Model, sure: float = 0.95) -> list[tuple[Lines, np.ndarray]]:
    """Lines that the model is sure of go over to the other label; the half of each text (by length) that suits its label best keeps it."""
    out = []
    for lines, y in chains:
        p, _, _ = marginals(lines.potential(model), model.moves)
        suits = p[np.arange(len(y)), y]
        order = np.argsort(-suits, kind="stable")
        before = np.cumsum((lines.size + 1)[order]) - (lines.size + 1)[order]
        free = np.zeros(len(y), bool)
        free[order] = before >= (lines.size + 1).sum() / 2
        out.append((lines, np.where(free & (suits < 1 - sure), 1 - y, y)))
    return out


def scores(texts: list[str], model: Model, known: Hashes) -> np.ndarray:
    """For each text the mean over its lines of P(good), weighted by length."""
    lines = measured(texts, known)
    p, _, _ = marginals(lines.potential(model), model.moves, lines.texts)
    of = np.repeat(np.arange(len(texts)), lines.texts)
    weight = lines.size + 1
    return np.clip(np.bincount(of, p[:, 1] * weight) / np.bincount(of, weight), 0.0, 1.0)


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, train_docs: int) -> Model | None:
    """A model from at most `train_docs` labelled documents of each label that are not held out, those of lowest hash; whole texts.

    Every line takes its document's label first; after one fit lines may change sides (`relabelled`), and the field is fitted again.
    Labels are counted, and a threshold on the hash leaves about twice the documents wanted of each, of which the lowest are taken:
    the order of a whole label is never made. None if a label is missing.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)").groupBy("__id").agg(F.max("quality").alias("quality"))
    rows = docs.select("doc_id", "text").filter(~held_out() & F.col("text").isNotNull()).join(known, F.col("doc_id") == F.col("__id"))
    rows = rows.select("doc_id", "text", "quality", F.xxhash64("doc_id", "text", F.lit(7)).alias("h"))
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    taken = []
    for quality, n in counts.items():
        share = min(1.0, 2 * train_docs / n) if n > 4 * train_docs else 1.0
        few = rows.filter((F.col("quality") == quality) & (F.col("h") <= int(-(2**63) + share * (2**64 - 2048))))
        taken.append(few.orderBy("h", "doc_id").limit(train_docs))

    def featured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Hashes()
        for part in parts:
            made = [measured([t], words) for t in part["text"]]
            yield pd.DataFrame({"h": part["h"], "quality": part["quality"], "size": [m.size for m in made], "x": [m.x.astype(np.float32).ravel() for m in made], "bucket": [m.bucket for m in made], "owner": [m.owner for m in made]})

    sample = reduce(DataFrame.unionByName, taken).repartition(8)
    got = sample.mapInPandas(featured, "h long, quality int, size array<double>, x array<float>, bucket array<long>, owner array<long>").toPandas()
    got = got.sort_values(["h", "quality"], kind="stable")
    chains = [(Lines(np.asarray(r.x, float).reshape(len(r.size), FEATURES), np.asarray(r.size), np.array([len(r.size)]), np.asarray(r.bucket, np.int64), np.asarray(r.owner, np.int64)), np.full(len(r.size), r.quality)) for r in got.itertuples(index=False, name="Row")]
    return fit(relabelled(chains, fit(chains)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_docs: int = 1500) -> DataFrame:
    """The rows of docs with held_out, score (0 to 1) and predicted (1 from `threshold`).

    The field is fitted on a bounded sample of labelled documents (at most train_docs for each label, with their whole texts) and its
    weights, of fixed number, go to the tasks; every whole text is scored. Only the text is an input. Null and empty texts are one
    empty line. A table without labels of both kinds gives 0.5 to all. A row repeated is scored alike; an empty table gives no rows.
    Columns of docs that are called like the new ones are replaced.
    """
    model = train(docs, labels, train_docs)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Hashes()
        for part in texts:
            out = np.full(len(part), 0.5)
            if model:
                texts = part.fillna("").tolist()
                ends = np.cumsum([len(t) + 1 for t in texts])
                at = 0
                while at < len(texts):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE)))
                    out[at:to] = scores(texts[at:to], model, known)
                    at = to
            yield pd.Series(out)

    out = docs.withColumn("held_out", held_out()).withColumn("score", scored(F.coalesce("text", F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def crc_check(doc_id: int | None) -> bool:
    """The held-out rule in plain Python, for tests."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0
