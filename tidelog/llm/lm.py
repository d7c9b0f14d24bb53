"""Operator 6: language-model scoring with a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing, P(w | h) = (c(hw) + mu * P(w | h')) /
(c(h) + mu), where h' drops the first word of h and, without a history, P(w) = (c(w) + 1) /
(N + V + 1). As an automaton: every n-gram of less than ``order`` words seen in training is a state, and
every n-gram hw seen is an arc from state h that reads w, weighs log P(w | h) and leads to the
longest suffix of hw that is a state. A state's failure arc reads nothing, leads to the state of h'
and weighs log(mu / (c(h) + mu)). The root has an arc for every word. A text is read once from
left to right: the state before a word is all that is carried, the word's arc is taken, after as many
failure arcs as lead to a state that has one, and the weights add up to the text's score.

No task holds the model. Documents are dealt into chunks; a chunk asks for the counts of
the n-grams in it, bucketed by their hash, with its own training counts; each bucket sums
what the chunks sent and answers each; a chunk then builds the part of the automaton that its
texts can reach, states, arcs and failure arcs, and runs it. What travels is each chunk's distinct
n-grams twice, packed. Chunks and buckets are both as many as ``chunk_bytes`` and the size of the
corpus give, so neither grows with it; messages get smaller as there are more of them.

Words fold A-Z and end at ASCII white space. Every text has one more token, its end; null
and empty texts have that alone. Words are known by 64-bit hashes. Without training
documents every count is 0. Repeated rows count and are scored each; rows of one key and text share a
chunk. A very long text is one chunk's; nothing of it is cut. Rows without key are training rows. Only
the key, the text and what ``held_out`` reads are read, so other columns may have any names. There
are no ties to decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .text import Words, combine, slices

END, START = np.uint64(0x5EED0E4D), np.uint64(0x5EED57A7)
LN10 = float(np.log(10.0))


def sequences(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """START, words and END of each text in turn; and each text's first position, with the total last."""
    parts, sizes = [], []
    batch = pa.table({"t": texts}).combine_chunks()
    for record in batch.to_batches():
        for part in slices(record, "t"):
            w = Words(part.column("t"))
            n = np.diff(w.first)
            at = np.cumsum(n + 2) - (n + 2)
            seq = np.empty(int((n + 2).sum()), np.uint64)
            seq[at], seq[at + n + 1] = START, END
            fill = np.ones(len(seq), bool)
            fill[at] = fill[at + n + 1] = False
            seq[fill] = w.hash
            parts.append(seq)
            sizes.append(n + 2)
    if not parts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def grams(seq: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order: the n-gram that ends at each position, and where there is one."""
    depth = np.arange(len(seq)) - np.repeat(first[:-1], np.diff(first))
    out = [(seq, np.ones(len(seq), bool))]
    for n in range(2, order + 1):
        last = out[-1][0]
        g = np.zeros(len(seq), np.uint64)
        g[1:] = combine([last[:-1], seq[1:]], 0x6A09 + n)
        out.append((g, depth >= n - 1))
    return out


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, after a byte that says how many."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _ask(order: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        seq, first = sequences(table.column("text"))
        train = np.repeat(~np.array(table.column("held_out").combine_chunks()), np.diff(first))
        rows = {k: [] for k in ("bucket", "chunk", "n", "grams", "counts")}
        chunk = table.column("chunk")[0].as_py()
        for n, (g, there) in enumerate(grams(seq, first, order), 1):
            uniq, of = np.unique(g[there], return_inverse=True)
            count = np.bincount(of, train[there], len(uniq)).astype(np.uint64)
            b = _bucket(uniq, buckets)
            cuts = np.searchsorted(b, np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(cuts)):
                part = uniq[cuts[i] : cuts[i + 1]]
                rows["bucket"].append(int(i))
                rows["chunk"].append(chunk)
                rows["n"].append(n)
                rows["grams"].append(pack(np.diff(part, prepend=np.uint64(0))))
                rows["counts"].append(pack(count[cuts[i] : cuts[i + 1]]))
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "chunk": pa.array(rows["chunk"], pa.int32()), "n": pa.array(rows["n"], pa.int32()), "grams": pa.array(rows["grams"], pa.binary()), "counts": pa.array(rows["counts"], pa.binary())})

    return run


def _answer(table: pa.Table) -> pa.Table:
    out = {k: [] for k in ("chunk", "bucket", "n", "counts", "tokens", "words")}
    chunk, order = table.column("chunk").to_numpy(), table.column("n").to_numpy()
    grams_, counts = table.column("grams").to_pylist(), table.column("counts").to_pylist()
    bucket = table.column("bucket")[0].as_py()
    for n in np.unique(order):
        at = np.flatnonzero(order == n)
        parts = [np.cumsum(unpack(grams_[i]), dtype=np.uint64) for i in at]
        uniq, of = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(of, np.concatenate([unpack(counts[i]) for i in at]), len(uniq)).astype(np.uint64)
        stop = np.cumsum([len(p) for p in parts])
        for i, a, b in zip(at, stop - [len(p) for p in parts], stop, strict=True):
            for k, v in (("chunk", int(chunk[i])), ("bucket", bucket), ("n", int(n)), ("counts", pack(total[of[a:b]])), ("tokens", 0), ("words", 0)):
                out[k].append(v)
        if n == 1:
            real = total[uniq != START]
            for k, v in (("chunk", -1), ("bucket", bucket), ("n", 0), ("counts", b""), ("tokens", int(real.sum())), ("words", int((real > 0).sum()))):
                out[k].append(v)
    kinds = {"chunk": pa.int32(), "bucket": pa.int32(), "n": pa.int32(), "counts": pa.binary(), "tokens": pa.int64(), "words": pa.int64()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})


class Arcs:
    """Numbers of arcs by their keys, state << 32 | word, which are sorted when one is first asked for."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.order = keys, None

    def get(self, key: int) -> int | None:
        if self.order is None:
            self.order = np.argsort(self.keys)
            self.keys = self.keys[self.order]
        i = int(np.searchsorted(self.keys, key))
        return int(self.order[i]) if i < len(self.keys) and self.keys[i] == key else None

    def __getitem__(self, key: int) -> int:
        if (at := self.get(key)) is None:
            raise KeyError(key)
        return at


class Automaton:
    """The states, arcs and failure arcs that a chunk's texts can reach.

    ``levels[n - 1]`` describes the chunk's distinct n-grams: their training counts, and for each the numbers of
    its last word, of its suffix and of its history (the n-grams of one word less at its end and its start).
    State 0 is the root."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], tokens: int, words: int, mu: float):
        self.floor = float(np.log(tokens + words + 1.0))
        order, states = len(levels), 1
        self.failure, self.backoff = [np.zeros(1, np.int64)], [np.zeros(1)]
        depths, arcs, keys, weights, targets = [np.zeros(1, np.int8)], 0, [], [], []
        self.taken = []  # for each level, the arc that reads the n-gram's last word after its history, or -1
        state_of = logp = below = None
        for n, (count, word, suffix, history) in enumerate(levels, 1):
            count = count.astype(np.float64)
            if n == 1:
                logp = np.log(count + 1.0) - self.floor
                source, there = np.zeros(len(count), np.int64), np.ones(len(count), bool)
            else:
                logp = np.log(count + mu * np.exp(logp[suffix])) - np.log(below[history] + mu)
                source, there = state_of[history], count > 0
            # Only a seen n-gram is a state; any other leads where its suffix does.
            lead = np.zeros(len(count), np.int64) if n == 1 else state_of[suffix]
            if n < order:
                real = np.flatnonzero(count > 0)
                self.failure.append(lead[real])
                self.backoff.append(np.log(mu) - np.log(count[real] + mu))
                depths.append(np.full(len(real), n, np.int8))
                lead = lead.copy()
                lead[real] = states + np.arange(len(real))
                states += len(real)
            taken = np.full(len(count), -1, np.int64)
            taken[there] = arcs + np.arange(np.count_nonzero(there))
            arcs += np.count_nonzero(there)
            self.taken.append(taken)
            keys.append((source << 32 | word)[there])
            weights.append(logp[there])
            targets.append(lead[there])
            state_of, below = lead, count
        self.states = states
        # Arrays read through memoryviews: a chunk has as many arcs as words, and lists of them take ten times the memory.
        self.depth, self.failure, self.backoff, self.weight, self.target = (memoryview(np.concatenate(x)) for x in (depths, self.failure, self.backoff, weights, targets))
        self.arc = Arcs(np.concatenate(keys))

    def step(self, state: int, word: int) -> tuple[int, float]:
        """The state after a word, and the word's natural log-probability."""
        total, at = 0.0, self.arc.get(state << 32 | word)
        while at is None:
            total += self.backoff[state]
            state = self.failure[state]
            at = self.arc.get(state << 32 | word)
        return self.target[at], total + self.weight[at]

    def run(self, state: int, start: int, end: int, arcs: list[memoryview]) -> tuple[float, int]:
        """Reads the words at start..end - 1 from a state on; the log-probability of them all, and the state behind them.
        ``arcs[d]`` has the arc that a state of d words has at each place, or -1."""
        depth, weight, target, failure, backoff = self.depth, self.weight, self.target, self.failure, self.backoff
        total = 0.0
        for i in range(start, end):
            at = arcs[depth[state]][i]
            while at < 0:
                total += backoff[state]
                state = failure[state]
                at = arcs[depth[state]][i]
            total += weight[at]
            state = target[at]
        return total, state


def machine(by_order: list[tuple[np.ndarray, np.ndarray]], counts: list[np.ndarray], tokens: int, words: int, mu: float) -> tuple[Automaton, np.ndarray]:
    """The automaton of a chunk's n-grams, with the arcs of each length of state at each place, and its texts as numbers of
    words. ``counts`` go by ascending n-gram."""
    levels, number, numbers = [], None, []
    for (g, there), count in zip(by_order, counts, strict=True):
        at = np.flatnonzero(there)
        uniq, first, of = np.unique(g[at], return_index=True, return_inverse=True)
        place = at[first]  # a place where each stands
        before = number
        number = np.full(len(g), -1, np.int64)
        number[at] = of
        numbers.append(number)
        if before is None:
            word, none = number, np.zeros(len(uniq), np.int64)
            levels.append((count, word[place], none, none))
        else:
            levels.append((count, word[place], before[place], before[place - 1]))
    auto = Automaton(levels, tokens, words, mu)
    auto.places = [memoryview(np.append(taken, -1)[n]) for taken, n in zip(auto.taken, numbers, strict=True)]
    return auto, word


def _score(order: int, tokens: int, words: int, mu: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        seq, first = sequences(docs.column("text"))
        by_order = grams(seq, first, order)
        level, bucket, packed = answers.column("n").to_numpy(), answers.column("bucket").to_numpy(), answers.column("counts").to_pylist()
        counts = []
        for n in range(1, order + 1):
            at = np.flatnonzero(level == n)
            parts = [unpack(packed[i]) for i in at[np.argsort(bucket[at])]]
            counts.append(np.concatenate(parts) if parts else np.empty(0, np.uint64))
        auto, word = machine(by_order, counts, tokens, words, mu)
        real = np.ones(len(seq), bool)
        real[first[:-1]] = False  # START is read, not predicted
        c = counts[0][word].astype(np.float64)
        sums = lambda x: np.add.reduceat(np.where(real, x, 0.0), first[:-1]) if len(seq) else np.empty(0)
        base = sums((np.log(c + 1.0) - auto.floor) / LN10)
        known = sums((c > 0).astype(float)).astype(np.int64)
        score = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            start = auto.target[auto.places[0][a]]
            score.append(auto.run(start, a + 1, b, auto.places)[0] / LN10)
        n = docs.num_rows
        return pa.table({"key": docs.column("key"), "held_out": docs.column("held_out"), "n_tokens": pa.array(np.diff(first) - 1, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([tokens] * n, pa.int64()), "base_score": pa.array(base), "score": pa.array(score, pa.float64())})

    return run


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", order: int = 2, mu: float = 20.0, chunk_bytes: int = 4_000_000) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; the model learns from the rows where ``held_out`` is not true."""
    kind = docs.schema[key].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(F.col(text)) + F.lit(20))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    buckets = chunks
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key", "text"), F.lit(chunks)).cast("int"))
    asked = rows.groupBy("chunk").applyInArrow(_ask(order, buckets), "bucket int, chunk int, n int, grams binary, counts binary")
    answered = asked.groupBy("bucket").applyInArrow(_answer, "chunk int, bucket int, n int, counts binary, tokens long, words long")
    spark = docs.sparkSession
    with shared.scratch(spark) as keep:
        answered = shared.settle(answered, "counts")
        out = shared.settle(_scored(rows, answered, kind, order, mu), "scores")
        keep(out)
    return out.withColumnRenamed("key", key)


def _scored(rows: DataFrame, answered: DataFrame, kind: str, order: int, mu: float) -> DataFrame:
    n = answered.filter("chunk < 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("words"), F.lit(0)).alias("w")).first()
    return rows.groupBy("chunk").cogroup(answered.filter("chunk >= 0").groupBy("chunk")).applyInArrow(_score(order, n["t"], n["w"], mu), f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(7)) == 2, F.lit(False))
