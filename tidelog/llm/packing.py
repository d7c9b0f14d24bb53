"""Operator 4: best-fit packing with large-item matching.

Documents become token ids, each followed by one end id. A document longer than the
capacity is cut into pieces of the capacity, and the remainder, if any, comes first. Pieces
longer than a third of the capacity are large: at most two fit a bin, and each, from the
longest on, is paired with the longest large piece that still fits it. Every smaller piece,
from the longest on, goes into the fullest bin that has room.

Lengths are integers up to the capacity, so the plan needs only how many pieces
have each length: the driver packs that histogram (at most ``capacity`` entries, whatever the
corpus) into groups of like bins, and a piece finds its bin from its rank among the pieces
of its length. Ranks are counted within salted parts of a length and shifted by the counts
before them, so no task holds a length as a whole.

A null text is an empty document: its end id alone. A special token's name in a text becomes its id, as
the library has it. Repeated rows are packed each, and ties between them are open to any of their
places. A very long text is cut into many pieces, none left out. An empty table gives no rows. Only the
key and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import itertools
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .text import BEYOND, LATIN, by_slice

KEEP = 1_000_000
_PIECE = "piece int, start long, length long, ids_crc32 long"

class Tokens:
    """Token ids by the tokenizers library. A byte-level tokenizer treats the pieces that its
    pattern finds apart from each other, so a text below U+0250 without a special token's name is
    split here and only pieces not met before are given to the library; any other text is given whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        #: A text that holds a special token's name has its id there, so the library gets it whole.
        self.special = re.compile("|".join(special) or "(?!)")
        self.forget()

    def forget(self) -> None:
        self.number = defaultdict(itertools.count().__next__)
        self.flat = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > KEEP:
            self.forget()
        of, out, odd = self.number.__getitem__, [], {}
        for i, t in enumerate(texts):
            if BEYOND.search(t) or self.special.search(t):
                odd[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.int32)
                out.append(None)
            else:
                pieces = LATIN.findall(t)
                out.append(np.fromiter(map(of, pieces), np.int32, len(pieces)))
        fresh = list(itertools.islice(self.number, len(self.ends) - 1, None))
        flat, sizes = [self.flat], []
        for at in range(0, len(fresh), 5000):
            part = fresh[at : at + 5000]
            got = self.library.encode(part, is_pretokenized=True, add_special_tokens=False)
            sizes.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
            flat.append(np.array(got.ids, np.int32))
        if fresh:
            self.flat = np.concatenate(flat)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])
        return [odd[i] if n is None else self._gather(n) for i, n in enumerate(out)]

    def _gather(self, n: np.ndarray) -> np.ndarray:
        begin, size = self.ends[n], self.ends[n + 1] - self.ends[n]
        stop = np.cumsum(size)
        return self.flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - size), size)]


def _tokens(path: str) -> Tokens:
    kept = globals().setdefault("_kept", {})
    if path not in kept:
        kept[path] = Tokens(path)
    return kept[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def tokenize(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32, and the ids if asked for."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, rows, ids = [], [], []
        texts = pc.fill_null(batch.column("text"), "").to_pylist()
        for i, got in enumerate(_tokens(path).encode(texts)):
            got = np.append(got, np.int32(end_id)).astype("<u4")
            for p, (s, n) in enumerate(cuts(len(got), capacity)):
                keys.append(i)
                rows.append((p, s, n, zlib.crc32(got[s : s + n].tobytes())))
                if with_ids:
                    ids.append(got[s : s + n].astype(np.int32))
        piece, start, length, crc = zip(*rows, strict=True)
        columns = [batch.column("key").take(pa.array(keys, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
        names = ["key", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.record_batch(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(by_slice("text", make), f"key {kind}, {_PIECE}" + ", ids array<int>" * with_ids).withColumnRenamed("key", key)


class Plan:
    """Where the r-th piece of each length goes: runs of ranks with their first bin and offset."""

    def __init__(self, counts: dict[int, int], capacity: int):
        left = {n: c for n, c in counts.items() if c > 0}
        small = sorted((n for n in left if 3 * n <= capacity), reverse=True)
        large = sorted(n for n in left if 3 * n > capacity)
        groups: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # gap: (bins, lengths)
        while large:
            a = large[-1]
            at = bisect_left(large, capacity - a + 1) - 1
            if at < 0:
                groups[capacity - a].append((left.pop(a), (a,)))
                large.pop()
                continue
            b = large[at]
            if a == b:
                pairs, odd = divmod(left.pop(a), 2)
                large.pop()
                if pairs:
                    groups[capacity - 2 * a].append((pairs, (a, a)))
                if odd:
                    left[a] = 1
                    partner = bisect_left(large, capacity - a + 1) - 1
                    if partner < 0:
                        groups[capacity - a].append((1, (a,)))
                        del left[a]
                    else:
                        large.append(a)
                        b = large[partner]
                        self._pair(a, b, 1, left, large, groups, capacity)
                continue
            self._pair(a, b, min(left[a], left[b]), left, large, groups, capacity)
        gaps = sorted(groups)
        for n in small:
            todo = left[n]
            while todo:
                at = bisect_left(gaps, n)
                if at == len(gaps):
                    fit = capacity // n
                    full, rest = divmod(todo, fit)
                    made = [(full, fit)] * (full > 0) + [(1, rest)] * (rest > 0)
                    for bins, k in made:
                        self._put(groups, gaps, capacity - k * n, (bins, (n,) * k))
                    break
                gap = gaps[at]
                bins, items = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap]
                    gaps.pop(at)
                fit = gap // n
                full = min(bins, todo // fit)
                if full:
                    self._put(groups, gaps, gap - fit * n, (full, items + (n,) * fit))
                    todo -= full * fit
                    bins -= full
                if bins and todo and todo < fit:
                    self._put(groups, gaps, gap - todo * n, (1, items + (n,) * todo))
                    bins, todo = bins - 1, 0
                if bins:
                    self._put(groups, gaps, gap, (bins, items))
        runs = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        self.bins = 0
        for gap in sorted(groups):
            for bins, items in groups[gap]:
                offset = 0
                for n in items:
                    runs[n].append((used[n], self.bins, offset))
                    used[n] += bins
                    offset += n
                self.bins += bins
        self.runs = {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}

    @staticmethod
    def _pair(a, b, n, left, large, groups, capacity):
        groups[capacity - a - b].append((n, (a, b)))
        for x in (a, b):
            left[x] -= n
            if not left[x]:
                del left[x]
                large.remove(x)

    @staticmethod
    def _put(groups, gaps, gap, group):
        if gap not in groups:
            insort(gaps, gap)
        groups[gap].append(group)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bin_, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            first, start, off = self.runs[int(n)]
            i = np.searchsorted(first, rank[at], side="right") - 1
            bin_[at] = start[i] + rank[at] - first[i]
            offset[at] = off[i]
        return bin_, offset


def pack(pieces: DataFrame, capacity: int = 2048, key: str = "doc_id", per_part: int = 2000) -> DataFrame:
    """``pieces`` (key, piece, length and any others) with sequence_id and offset. ``pieces``
    must be a settled table: it is read twice, and ranks must come out alike."""
    by = F.xxhash64(key, "piece", "start")
    n = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    plan = Plan({r["length"]: r["n"] for r in n}, capacity)
    # Each length has parts of about ``per_part`` pieces.
    parts = pieces.sparkSession.createDataFrame([(r["length"], max(1, r["n"] // per_part)) for r in n], "length long, parts int")
    placed = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(by, "parts").cast("int"))
    sizes = placed.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "part").orderBy(key, "piece", "start", F.col("ids_crc32"))
    ranked = placed.join(shared.settle(sizes, "sizes"), ["length", "part"]).withColumn("rank", F.row_number().over(order) - 1 + F.col("before"))
    names = list(pieces.columns)
    frame = ranked.select(*names, F.col("rank").cast("long").alias("rank"))

    def run(batches):
        for b in batches:
            bin_, offset = plan.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            keep = [b.column(c) for c in names]
            yield pa.record_batch([*keep, pa.array(bin_), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return frame.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def best_fit(docs: DataFrame, path: str, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    with shared.scratch(docs.sparkSession) as keep:
        out = shared.settle(pack(shared.settle(tokenize(docs, path, capacity, 0, key, text), "pieces"), capacity, key), "packed")
        keep(out)
    return out
