"""LM scoring: a backoff automaton of n-grams, learnt from all training texts and traversed once, left to right, by every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .words import Hashes, mixed, word_hashes

#: States of one word are hashes of 63 bits; longer ones have this bit.
LONGER = np.uint64(1 << 63)
#: Stand-ins for the state at the start of a text and for the end token; no hash of a word is expected to equal them.
START, END = (np.uint64(x) & ~LONGER for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))
#: States that may be parted over shards, at most.
HOT = 1 << 16
LOW = np.uint64((1 << 48) - 1)
#: Tokens of the texts whose arcs are loaded together, if those are more than one text.
TOKENS = 1 << 15


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each distinct value stands, in the order of values, and the number of each element's value."""
    by = np.argsort(x)
    of = x[by]
    new = np.r_[True, of[1:] != of[:-1]]
    number = np.empty(len(x), np.int64)
    number[by] = np.cumsum(new) - 1
    return by[new], number


class Block:
    """The moves of a block of texts: for every token the states it may leave and the word.

    A state is the start, or the last 1 to `order` - 1 words (and the start). Distinct moves and states are in the order of their length,
    then of their hash, whatever the order of texts.
    """

    def __init__(self, texts: pd.Series, training: pd.Series, known: Hashes, order: int):
        words = [word_hashes(t, known) & ~LONGER for t in texts]
        self.size = np.array([len(w) + 1 for w in words])
        self.ends = ends = np.cumsum(self.size)
        word = np.full(ends[-1], END)
        for w, end in zip(words, ends, strict=True):
            word[end - 1 - len(w) : end - 1] = w
        del words
        state = np.r_[START, word[:-1]]
        state[ends[:-1]] = START
        one, number = numbered(state)
        hashes, tokens, levels = state[one], np.arange(len(word)), []
        place = tokens - np.repeat(ends - self.size, self.size)
        for level in range(1, order):
            if level > 1:
                # A state of one word more is the move that led to it; those to the end lead to none.
                leads = word[tokens[first]] != END
                longer = np.zeros(len(word), np.int64)
                longer[tokens] = np.cumsum(leads)[move] - 1
                tokens = np.flatnonzero(place >= level - 1)
                number, hashes = longer[tokens - 1], key[first][leads] | LONGER
            key = mixed(hashes[number] * np.uint64(3) + word[tokens])
            first, move = numbered(key)
            levels.append((tokens, number, hashes, move, first))
        tokens, number, hashes, move, first = zip(*levels, strict=True)
        stacked = lambda parts, sizes: np.concatenate([x + n for x, n in zip(parts, np.cumsum([0, *map(len, sizes[:-1])]), strict=True)])
        #: Where the moves from states of each number of words begin, and how many states have one word or are the start.
        self.cuts, self.one_word = np.cumsum([0, *map(len, tokens)]), len(hashes[0])
        self.token, self.states = np.concatenate(tokens), np.concatenate(hashes)
        self.state, self.move, self.first = stacked(number, hashes), stacked(move, first), stacked(first, tokens)
        self.move_state, self.move_word = self.state[self.first], word[self.token[self.first]]
        counts = np.repeat(training.to_numpy().astype(np.int64), self.size)[self.token]
        self.count = np.bincount(self.move, counts, len(self.first)).astype(np.int64)
        #: Number of each token's word: that of the state it leads to; the end has the number after all states.
        self.word = np.r_[self.state[1 : len(word)], 0]
        self.word[ends - 1] = len(self.states)

    def dealt(self, hot: Hot, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, states, moves): what goes where, for shards that get something. A state is kept whole unless it is hot; then its moves are parted by word."""
        k = hot.parts(self.states).astype(np.uint64)
        at = lambda s, part: (mixed(s + part * np.uint64(0x9E3779B9)) % np.uint64(shards)).astype(np.int64)
        of_move = at(self.states[self.move_state], mixed(self.move_word) % k[self.move_state])
        asked, shard = [], []
        for part in range(int(k.max(initial=1))):
            rows = np.flatnonzero(k > part)
            asked.append(rows)
            shard.append(at(self.states[rows], np.uint64(part)))
        asked, shard = np.concatenate(asked), np.concatenate(shard)
        # Two parts of one state can fall to the same shard; it is asked once.
        small = np.uint16 if shards <= 1 << 16 else np.int64  # sorted by digits
        by = np.argsort(shard.astype(small), kind="stable")
        shard, asked = shard[by], asked[by]
        moves = np.argsort(of_move.astype(small), kind="stable")
        told, begin = np.unique(shard, return_index=True)
        cuts = np.searchsorted(of_move[moves], np.r_[told, shards])
        for i, (s, part) in enumerate(zip(told.tolist(), np.split(asked, begin[1:]), strict=True)):
            yield s, np.unique(part), moves[cuts[i] : cuts[i + 1]]


class Hot:
    """States that leave more moves than one shard should get, and over how many shards each is parted."""

    def __init__(self, states: np.ndarray, parts: np.ndarray):
        by = np.argsort(states)
        self.states, self.n = states[by], parts[by]

    def parts(self, states: np.ndarray) -> np.ndarray:
        out = np.ones(len(states), np.int64)
        if len(self.states):
            at = np.searchsorted(self.states, states).clip(max=len(self.states) - 1)
            out = np.where(self.states[at] == states, self.n[at], out)
        return out


class Automaton:
    """The states and arcs that the texts of a block can reach; arcs are loaded for some texts at a time.

    A state has an arc for each word that followed it in training, with the log10 of the word's interpolated share and the state it leads
    to, and one failure arc to the state without its first word, with the log10 of what the discounts left over. The root has no
    history and an arc for every word.
    """

    def __init__(self, block: Block, weights: Weights):
        self.block, self.weights = block, weights
        #: The root has the number after all states, and so has the end among words.
        self.root = len(block.states)
        self.back, self.failure = weights.back.tolist(), weights.failure.tolist()
        # A state that training never left has no arcs and is none. States of one word are the first in order, as are words.
        one_word = block.one_word
        self.after = np.where(weights.seen[:one_word] > 0, np.arange(one_word), self.root).tolist()
        self.share, self.end = weights.share[:one_word].tolist(), float(weights.end)
        self.start = self.after[int(np.searchsorted(block.states[:one_word], START))]
        self.met = np.zeros(len(block.first), bool)
        self.move_next = block.word[block.token[block.first]]

    def load(self, low: int, high: int) -> None:
        """The arcs that the tokens low to high of the block can take."""
        b, w = self.block, self.weights
        for start, stop in zip(b.cuts[:-1], b.cuts[1:], strict=True):
            a, z = start + np.searchsorted(b.token[start:stop], (low, high))
            self.met[b.move[a:z]] = True
        moves = np.flatnonzero(self.met)
        self.met[moves] = False
        moves = moves[w.times[moves] > 0]
        keys = b.move_state[moves] * (self.root + 1) + self.move_next[moves]
        self.arcs = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.weight, self.target = w.arc[moves].tolist(), w.target[moves].tolist()

    def score(self, words: list[int]) -> float:
        """Log10 probability of a text of these words, from the start: a state is carried from word to word."""
        find, weight, target, back, failure, root, step = self.arcs.get, self.weight, self.target, self.back, self.failure, self.root, self.root + 1
        total, state = 0.0, self.start
        for word in words:
            arc = None
            while state != root and (arc := find(state * step + word)) is None:
                total += failure[state]
                state = back[state]
            if arc is not None:
                total += weight[arc]
                state = target[arc]
            elif word != root:
                total += self.share[word]
                state = self.after[word]
            else:
                total += self.end
        return total

    def scores(self) -> list[float]:
        """Of the block's texts in order."""
        ends, out = self.block.ends, []
        starts = ends - self.block.size
        while len(out) < len(ends):
            low = starts[len(out)]
            until = max(len(out) + 1, int(np.searchsorted(ends, low + TOKENS, side="right")))
            self.load(low, ends[until - 1])
            out += [self.score(self.block.word[starts[i] : ends[i]].tolist()) for i in range(len(out), until)]
        return out


class Weights:
    """Weights of the arcs of a block, from totals over all training texts."""

    def __init__(self, b: Block, times: np.ndarray, tallies: np.ndarray, n: int, v: int, discounts: tuple):
        root = len(b.states)
        self.times, self.seen = times, tallies[0]
        seen, d = tallies[0].astype(float), np.array((0.0, *discounts))
        left = np.divide(d[1:] @ tallies[1:], seen, out=np.ones_like(seen), where=seen > 0)
        own = np.divide(times - d[np.minimum(times, 3)], seen[b.move_state], out=np.zeros(len(times)), where=times > 0)
        # Every word of the block is a state of the block; the end has the count of the start.
        self.counts = np.r_[tallies[0], tallies[0][np.searchsorted(b.states[: b.one_word], START)]]
        share = (self.counts + 0.1) / (n + 0.1 * (v + 1))
        # The same token's move from the shorter state, and the longest state after the move.
        self.back, self.target = np.full(root, root), np.full(len(times), root)
        token_moves, token_states = np.full(len(b.word), -1), np.r_[b.state[: len(b.word)], root]
        total = np.zeros(len(times))
        for level, (start, stop) in enumerate(zip(b.cuts[:-1], b.cuts[1:], strict=True)):
            tokens, moves, states = b.token[start:stop], b.move[start:stop], b.state[start:stop]
            if level:
                self.back[states] = token_states[tokens]
                shorter = total[token_moves[tokens]]
            else:
                shorter = share[b.word]
            total[moves] = own[moves] + left[states] * shorter
            token_moves[tokens] = moves
            # States of one more word, where the next token has one.
            longest = level + 2 == len(b.cuts)
            ahead = np.full(len(b.word) + 1, root)
            a, z = (start, stop) if longest else (stop, b.cuts[level + 2])
            ahead[b.token[a:z]] = b.state[a:z]
            self.target[moves] = np.where(b.word[tokens] < root, ahead[tokens + 1], root)
            token_states[tokens] = states
        with np.errstate(divide="ignore"):
            self.arc, self.failure, share = np.log10(total), np.log10(left), np.log10(share)
        self.share, self.end = share[:root], share[root]


def planes(x: np.ndarray, width: int) -> bytes:
    """Integers as planes of their bytes, the lowest first: small ones then compress to almost nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def integers(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def gathered(part: pd.DataFrame) -> tuple:
    """What the blocks sent to a shard, as one: states, index of each sent state, index and total of each sent move, tallies by state."""
    sent = np.concatenate([integers(x, 8) for x in part["states"]])
    states, state = np.unique(sent, return_inverse=True)
    sizes = [len(x) // 8 for x in part["states"]]
    offsets = np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], [len(x) // 6 for x in part["words"]])
    of_move = state[np.concatenate([integers(x, 4) for x in part["owners"]]).astype(np.int64) + offsets]
    word = np.concatenate([integers(x, 6) for x in part["words"]])
    count = np.concatenate([integers(x, 6) for x in part["counts"]]).astype(np.float64)
    _, first, move = np.unique(mixed(states[of_move] * np.uint64(5) + word), return_index=True, return_inverse=True)
    total = np.bincount(move, count, len(first)).astype(np.int64)
    owner, n = of_move[first], len(states)
    tallies = [np.bincount(owner, total, n)] + [np.bincount(owner[x], minlength=n) for x in (total == 1, total == 2, total > 2)]
    return states, state, move, total, [t.astype(np.int64) for t in tallies]


def score_documents(docs: DataFrame, discounts: tuple = (0.9, 1.2, 1.5), order: int = 2, block_bytes: int = 9 << 20, sample_docs: int = 2000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    States are the runs of up to `order` - 1 words met in training, and the start; a state has an arc for each word that followed it
    there, and one failure arc to the state without its first word, weighted by what the discounts left over (absolute discounting by
    count 1, 2, more, interpolated); the state without history has an arc for every word with its smoothed unigram share, the one of
    base_score. A text is one pass from the start to its end token, which carries the state and adds log10 weights of arcs (`Automaton`).

    Texts are dealt to blocks of about `block_bytes`. A block sends its distinct moves with their counts in training, once per block,
    to the shards of their states, and gets back totals over all training texts: so it holds the part of the automaton that its own
    texts can reach, and nothing of the corpus is on the driver or in a broadcast. A shard that gets none of a block's states gets no
    message, so there are never more messages than moves. States that a sample of `sample_docs` documents shows to be frequent are
    parted over shards by the next word; the sample moves work only, not results.

    Null texts count as empty: one end token. Null ids count as the text '' in the hash, which holds them out. Without training texts all
    shares are 1. Repeated rows are scored alike and count as often as they occur. An empty table gives no rows.
    Extra columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-size // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))
    hot = docs.sparkSession.sparkContext.broadcast(hot_states(docs, sample_docs, order, n_blocks))
    known: list[Hashes] = [Hashes()]

    def send(part: pd.DataFrame) -> pd.DataFrame:
        b, out = Block(part["text"], ~part["held_out"], known[0], order), []
        for shard, states, moves in b.dealt(hot.value, n_blocks):
            place = np.searchsorted(states, b.move_state[moves])
            out.append((shard, part["block"].iat[0], planes(b.states[states], 8), planes(place, 4), planes(b.move_word[moves] & LOW, 6), planes(b.count[moves], 6)))
        return pd.DataFrame(out, columns=["shard", "block", "states", "owners", "words", "counts"])

    def total(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        _, state, move, sums, tallies = gathered(part)
        s, m, out = 0, 0, []
        for block, states, words in zip(part["block"], part["states"], part["words"], strict=True):
            ns, nm = len(states) // 8, len(words) // 6
            out.append((block, part["shard"].iat[0], planes(sums[move[m : m + nm]], 6), b"".join(planes(t[state[s : s + ns]], 6) for t in tallies)))
            s, m = s + ns, m + nm
        return pd.DataFrame(out, columns=["block", "shard", "totals", "tallies"])

    def census(part: pd.DataFrame) -> pd.DataFrame:
        states, _, _, _, tallies = gathered(part)
        words = states < LONGER
        states, tallies = states[words], [t[words] for t in tallies]
        split = hot.value.parts(states) > 1
        whole = pd.DataFrame({"state": [0], "v": [int((tallies[0][~split] > 0).sum())], "n": [int(tallies[0][~split].sum())]})
        return pd.concat([whole, pd.DataFrame({"state": states[split].view(np.int64), "v": 0, "n": tallies[0][split]})])

    sent = rows.groupBy("block").applyInPandas(send, "shard int, block int, states binary, owners binary, words binary, counts binary")
    sent = sent.repartition("shard")
    counted = sent.groupBy("shard").applyInPandas(census, "state long, v long, n long").groupBy("state").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    # The start has as many moves as there are end tokens, and so stands for the end in N and V.
    counted = counted.agg(F.struct(F.sum("n").alias("n"), F.sum(F.when(F.col("state") == 0, F.col("v")).otherwise((F.col("n") > 0).cast("long"))).alias("v")).alias("all"))
    answers = sent.groupBy("shard").applyInPandas(total, "block int, shard int, totals binary, tallies binary")
    answers = answers.withColumn("all", counted.scalar()).select("block", "shard", "totals", "tallies", F.col("all.n").alias("n"), F.col("all.v").alias("v"))

    def traverse(texts: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        b = Block(texts["text"], ~texts["held_out"], known[0], order)
        by_shard = answer.set_index("shard")
        n, v = int(answer["n"].iat[0]), int(answer["v"].iat[0])
        times = np.zeros(len(b.move_state), np.int64)
        tallies = np.zeros((4, len(b.states)), np.int64)
        for shard, states, moves in b.dealt(hot.value, n_blocks):
            got = by_shard.loc[shard]
            times[moves] = integers(got["totals"], 6)
            each = len(got["tallies"]) // 4
            for i in range(4):
                tallies[i, states] += integers(got["tallies"][i * each : (i + 1) * each], 6).astype(np.int64)
        weights = Weights(b, times, tallies, n, v, discounts)
        score, starts = Automaton(b, weights).scores(), b.ends - b.size
        base = np.add.reduceat(np.r_[weights.share, weights.end][b.word], starts)
        n_known = np.add.reduceat((weights.counts[b.word] > 0).astype(np.int64), starts)
        return pd.DataFrame({"doc_id": texts["doc_id"].astype("Int64"), "held_out": texts["held_out"], "n_tokens": b.size, "n_known": n_known, "train_tokens": n, "base_score": base, "score": score})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(traverse, schema)


def hot_states(docs: DataFrame, sample_docs: int, order: int, shards: int) -> Hot:
    """States that leave more than a quarter of an even shard's moves in the documents of lowest hash, at most HOT of them."""
    sample = docs.select("doc_id", F.substring("text", 1, 20_000).alias("text")).orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(sample_docs)

    def tally(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for part in parts:
            if len(part):
                b = Block(part["text"], pd.Series([True] * len(part)), known, order)
                yield pd.DataFrame({"state": b.states.view(np.int64), "n": np.bincount(b.state, minlength=len(b.states))})

    counts = sample.select("text").mapInPandas(tally, "state long, n long").groupBy("state").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.partitionBy())
    parts = F.least(F.lit(4096), F.ceil(F.col("n") * (4 * shards) / total)).alias("parts")
    # What occurs a few times in the sample says nothing of its share.
    got = counts.select("state", "n", parts).filter("parts > 1 and n >= 16").orderBy(F.desc("n"), "state").limit(HOT).collect()
    return Hot(np.array([r["state"] for r in got], np.int64).view(np.uint64), np.array([r["parts"] for r in got], np.int64))
