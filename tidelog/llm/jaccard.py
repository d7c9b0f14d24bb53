"""Operator 8: exact Jaccard join of n-gram sets by pivots and triangle-inequality windows.

Two documents link when 100 * |A & B| >= percent * |A | B|; below, t = percent / 100 (0.9 in the
operator's query, 0.8 on 5-word shingles in the pipeline). The join splits the metric space until
its regions are small or settled:

* Sizes. The distance to the empty set's neighbourhood is a set's size, so pivots on a
  geometric ladder of sizes cut the space into regions, and the window t <= |A| / |B|
  replicates a boundary document into the region below its own.
* Sub-spaces. Pivots that are documents can't cut further by themselves: distances between
  unrelated documents are all near 1, which puts every document into every window of
  width 2 * (1 - t). So a region of sizes up to h, where linked sets differ in at most
  d = h * (1 - t) / t shingles, is cut into d + 1 + s sub-spaces by the hash of a shingle. Linked
  sets are equal in at least 1 + s of them. Each distinct sub-set is the pivot of a cell
  of radius 0: documents that share one meet there. (An empty sub-set is a pivot only for
  documents with more than s empty sub-spaces; s is SPARE, or more where sub-spaces are so many
  that a set would often leave more of them empty.)
* Documents. Each cell's smallest member is its pivot p, and the members of all cells of one
  pivot are its region. A member x is known by its difference E(x) from p, and by the triangle
  inequality x and y lie |E(x)| + |E(y)| - 2 |E(x) & E(y)| shingles apart. If their
  differences are disjoint and they link, both link with p and are one component. So only pairs
  that share a part of their difference are left, one of them outside p's radius, and the part
  they share is bounded from below. The region is cut once more, by the elements of the
  differences: x and y must share one of the first elements of their differences, rarest
  first, at places that leave room for the part they share. Pairs of one component are settled.

Pairs are verified on whole sets of 64-bit shingle hashes, so results are exact but for
hash collisions; documents with equal sets are one, known by a 64-bit hash of the set. A document
without words links with nothing. Rows without doc_id are left out, and of several rows
with one doc_id each counts; the id is returned once with its largest set size. Null, empty and short
texts have the sets that the operator's query defines; a very long text is a slice and a set of its own. Of equally
small ids and equally rare elements the smaller hash comes first, which changes no result. Only the key and the
text are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, shared
from .text import Words, by_slice, combine, lists, mix

SPARE = 2
ROUNDS = 4  # parts in which cells are counted and texts are read, and at least in which sets are compared
FEW = 50_000  # sets, or rows, that are never worth a round less


def ladder(most: int = 1 << 40) -> np.ndarray:
    """The least size of each region."""
    at = [1]
    while at[-1] < most:
        at.append(max(at[-1] + 1, at[-1] * 5 // 4))
    return np.array(at, np.int64)


_LADDER = ladder()


def regions(n: int, percent: int) -> range:
    """The regions in which a set of size n meets sets of its size or below, within the window."""
    low = -(-percent * n // 100)
    return range(int(np.searchsorted(_LADDER, low, side="right")) - 1, int(np.searchsorted(_LADDER, n, side="right")))


def differ(region: int, percent: int) -> int:
    """The most shingles in which two linked sets differ if the smaller is of this region."""
    return (100 - percent) * int(_LADDER[region + 1] - 1) // percent


@lru_cache(maxsize=None)
def spare(region: int, percent: int) -> int:
    """Sub-spaces beyond one more than differences: as many as the region's smallest sets seldom leave empty."""
    least, d = int(_LADDER[region]), differ(region, percent)
    for s in range(SPARE, d + 1):
        empty = (d + 1 + s) * math.exp(-least / (d + 1 + s))
        if empty + 2 * math.sqrt(empty) <= s:
            return s
    return SPARE


def unique_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each document, and their documents."""
    h, doc = Words(texts).shingles(k, short=True)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def signatures(h: np.ndarray, doc: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document) for the sub-sets of each document in each of its regions."""
    rows = [(i, r) for i in np.flatnonzero(n) for r in regions(int(n[i]), percent) if differ(r, percent)]
    if not rows:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    of, region = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    spares = np.array([spare(int(r), percent) for r in region], np.int64)
    cells = np.array([differ(int(r), percent) + 1 for r in region], np.int64) + spares
    begin = np.cumsum(n) - n
    size = n[of]
    stop = np.cumsum(size)
    row = np.repeat(np.arange(len(of)), size)
    at = np.arange(stop[-1]) + np.repeat(begin[of] - (stop - size), size)
    x = h[at]
    with np.errstate(over="ignore"):
        cell = ((mix(x + region[row].astype(np.uint64)) >> np.uint64(32)) * cells[row].astype(np.uint64)) >> np.uint64(32)
        base = np.cumsum(cells) - cells
        place = base[row] + cell.astype(np.int64)
        total = np.zeros(int(cells.sum()), np.uint64)
        np.add.at(total, place, mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    used = np.zeros(len(total), bool)
    used[place] = True
    owner = np.repeat(np.arange(len(of)), cells)
    empty = np.bincount(owner, ~used, len(of))
    emit = used | (empty > spares)[owner]
    index = np.arange(len(total)) - base[owner]
    sig = combine([region[owner].astype(np.uint64), index.astype(np.uint64), total], 0x8A8A)
    return sig[emit], of[owner][emit]


def set_hashes(h: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each document's whole set."""
    whole = np.zeros(len(n), np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(whole, doc, mix(h))
        return mix(whole + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _prints(k: int, percent: int):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, doc = unique_sets(batch.column("text"), k)
        n = np.bincount(doc, minlength=batch.num_rows)
        whole = set_hashes(h, doc, n)
        sig, of = signatures(h, doc, n, percent)
        return pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(whole), lists(sig.view(np.int64), of, batch.num_rows, pa.int64())], names=["id", "n", "rep", "sigs"])

    return by_slice("text", make)


def _sets(k: int):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, doc = unique_sets(batch.column("text"), k)
        at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        raw = h.astype("<u8").tobytes()
        out = pa.record_batch([batch.column("rep"), pa.array([raw[8 * a : 8 * b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["rep", "set"])
        # An id may stand on rows of several texts; one of them has the set.
        return out.filter(pa.array(set_hashes(h, doc, np.diff(at)) == batch.column("rep").to_numpy()))

    return by_slice("text", make)


def _measure(percent: int):
    """mapInArrow: whether each pair links, b's size and, where it is asked for, b's difference from a."""

    def run(batches):
        for b in batches:
            linked, size, diff = [], [], []
            for x, y, region in zip(b.column("set_a"), b.column("set_b"), b.column("region").to_pylist(), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = int(np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p)) if len(q) else 0
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
                size.append(len(q))
                diff.append(np.setxor1d(p, q, assume_unique=True).view(np.int64) if region else None)
            yield pa.record_batch([b.column("a"), b.column("b"), pa.array(linked), pa.array(size, pa.int64()), pa.array(diff, pa.list_(pa.int64()))], names=["a", "b", "linked", "n", "diff"])

    return run


def _measured(pairs: DataFrame, sets: DataFrame, percent: int, least: int = ROUNDS) -> DataFrame:
    """a, b, linked, n, diff for pairs (a, b, region); with region, a is b's pivot. Sets travel in parts of the
    pairs, one after the other, of no more pairs than there are sets, which bounds the disk that they take; of the first sides only those that pairs have."""
    pairs = shared.settle(pairs, "pairs")
    turns = max(least, -(-pairs.count() // max(FEW, sets.count())))
    left = shared.settle(sets.join(pairs.select(F.col("a").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "left")
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
    parts = []
    for i in range(turns):
        turn = F.pmod(F.col("b"), F.lit(turns)) == i
        both = pairs.filter(turn).join(left, "a").join(right.filter(turn), "b").select("a", "b", "region", "set_a", "set_b")
        parts.append(shared.settle(both.mapInArrow(_measure(percent), "a long, b long, linked boolean, n long, diff array<long>"), "measured"))
    shared.drop(pairs.sparkSession, left, pairs)
    out = reduce(DataFrame.union, parts)
    out.settled_parts = parts
    return out


def _components(links: DataFrame) -> DataFrame:
    return shared.settle(graph.components(links.select("a", "b")).withColumnRenamed("node", "rep"), "components")


def _within_regions(star: DataFrame, first: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of a region that may link though not both do with its pivot."""
    named = first.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), (~F.col("linked")).alias("far"), "n").join(star.filter("region").select(F.col("a").alias("pivot"), F.col("b").alias("rep")), ["pivot", "rep"])
    named = shared.settle(named.join(comp, "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component"), "region")
    # A region whose members all link with its pivot, or are one component, is settled.
    live = shared.settle(named.groupBy("pivot").agg(F.max("far").alias("far"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("far and c0 != c1").select("pivot"), "live")
    # Only the others' members need their differences. Regions overlap; a pair is left to the first live one that holds both
    # (in a settled one they are one component), so each member knows its regions before this one, no more than its cells.
    inside = named.join(live, "pivot")
    before = inside.groupBy("rep").agg(F.collect_set("pivot").alias("all"))
    inside = inside.join(before, "rep").withColumn("before", F.filter("all", lambda p: p < F.col("pivot"))).drop("all")
    inside = shared.settle(inside, "inside")
    members = shared.settle(sets.join(inside.select("rep").union(inside.select("pivot")).distinct(), "rep", "left_semi"), "inside_sets")
    rounds = max(1, -(-4 * inside.count() // max(FEW, sets.count())))
    # Regions don't depend on each other; a round has differences of a fourth as many members on disk as there are sets.
    parts = [_shared_parts(inside.filter(F.pmod(F.xxhash64("pivot"), F.lit(rounds)) == i), members, percent) for i in range(rounds)]
    return reduce(DataFrame.union, parts).select("a", "b", F.lit(False).alias("region")).distinct()


def _shared_parts(inside: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of these regions that share enough of their differences to link."""
    asked = inside.select(F.col("pivot").alias("a"), F.col("rep").alias("b"), F.lit(True).alias("region"))
    measured = _measured(asked, sets, percent, 1)
    diffs = measured.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), "diff")
    spread = diffs.select("pivot", "rep", F.explode("diff").alias("element"))
    often = spread.groupBy("pivot", "element").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    often = shared.settle(often, "often")
    met = spread.join(often, ["pivot", "element"])
    # Elements of one member alone come first in its order; they only take up places.
    per = met.groupBy("pivot", "rep").agg(F.sort_array(F.collect_list(F.struct("often", "element"))).alias("order"))
    per = per.join(inside, ["pivot", "rep"]).join(diffs.select("pivot", "rep", F.size("diff").alias("size")), ["pivot", "rep"])
    per = per.withColumn("alone", F.col("size") - F.size("order"))
    place = F.col("alone") + F.col("i")
    # Beyond the radius a partner shares all but n * (1 - t) / t elements or more, within it more than t / (1 + t) of them.
    most = F.when(F.col("far"), F.least(F.col("size"), F.floor((100 - percent) * F.col("n") / percent) + 1)).otherwise(F.col("size") - F.floor(percent * F.col("size") / (100 + percent)))
    rows = per.select("pivot", "rep", "far", "n", "c", "before", "size", "alone", F.posexplode("order").alias("i", "o")).withColumn("place", place).filter(F.col("place") < most)
    rows = shared.settle(rows.select("pivot", F.col("o.element").alias("element"), "rep", "far", "n", "c", "before", "size", "place"), "places")
    x = rows.select("pivot", "element", *(F.col(c).alias(f"{c}_a") for c in ("rep", "far", "n", "c", "before", "size", "place")))
    y = rows.select("pivot", "element", *(F.col(c).alias(f"{c}_b") for c in ("rep", "far", "n", "c", "before", "size", "place")))
    room = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    needed = F.col("size_a") + F.col("size_b") - F.floor((100 - percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    may = (F.col("rep_a") < F.col("rep_b")) & (F.col("far_a") | F.col("far_b")) & (F.col("c_a") != F.col("c_b")) & (2 * room >= needed) & ~F.arrays_overlap("before_a", "before_b")
    out = shared.settle(x.join(y, ["pivot", "element"]).filter(may).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct(), "near")
    shared.drop(inside.sparkSession, *measured.settled_parts, often, rows)
    return out


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of the operator's query. ``percent`` is at least 90;
    ``near_components`` goes lower."""
    if percent < 90:
        raise ValueError("the query links at a similarity of 0.9 or more")
    return near_components(docs, key, text, k, percent)


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for k-word shingles and a similarity of ``percent``, 80 to 100."""
    if not 80 <= percent <= 100:
        raise ValueError("the windows are laid out for a similarity of 0.8 or more")
    with shared.scratch(docs.sparkSession) as keep:
        out = shared.settle(_joined(docs, key, text, k, percent), "joined")
        keep(out)
    return out


def _joined(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    prints = shared.settle(rows.mapInArrow(_prints(k, percent), "id long, n long, rep long, sigs array<long>"), "prints")
    parts = []
    for i in range(ROUNDS):
        # The signatures of a part, so that no more of them than that are on disk for a shuffle at a time.
        spread = prints.select(F.explode(F.filter("sigs", lambda c: F.pmod(c, F.lit(ROUNDS)) == i)).alias("cell"), "rep")  # noqa: B023
        cells = shared.settle(spread.groupBy("cell").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo != hi").select("cell"), "cells")
        parts.append(shared.settle(spread.join(cells, "cell").select("cell", "rep").distinct(), "members"))
    members = reduce(DataFrame.union, parts)
    ids = shared.settle(prints.select("id", "n", "rep"), "ids")
    shared.drop(docs.sparkSession, prints)
    # One row's text for each distinct set that shares a cell.
    heads = ids.filter("n > 0").groupBy("rep").agg(F.min("id").alias("head"))
    needed = shared.settle(heads.join(members.select("rep").distinct(), "rep", "left_semi").withColumnRenamed("head", "id"), "needed")
    # The list of ids grows with the corpus, so it is never broadcast; the texts meet it in parts, so that no more than one is on
    # disk for a shuffle at a time.
    parts, turns = [], max(1, min(ROUNDS, ids.count() // FEW))
    for i in range(turns):
        turn = F.pmod(F.xxhash64("id"), F.lit(turns)) == i
        texts = rows.filter(turn).withColumn("h", F.xxhash64("text")).join(needed.filter(turn).hint("merge"), "id").dropDuplicates(["id", "h"])
        parts.append(shared.settle(texts.select("rep", "text").mapInArrow(_sets(k), "rep long, set binary"), "sets"))
    sets = reduce(DataFrame.union, parts)
    pivots = members.groupBy("cell").agg(F.min("rep").alias("lo"), F.count(F.lit(1)).alias("n"))
    star = members.join(shared.settle(pivots, "pivots"), "cell").filter("rep != lo")
    star = star.groupBy(F.col("lo").alias("a"), F.col("rep").alias("b")).agg((F.max("n") > 2).alias("region"))
    star = shared.settle(star, "star")
    first = _measured(star.withColumn("region", F.lit(False)), sets, percent)
    links = first.filter("linked").select("a", "b")
    comp = _components(links)
    more = _measured(_within_regions(star, first, comp, sets, percent), sets, percent).filter("linked").select("a", "b")
    if not more.isEmpty():
        comp = _components(links.union(more))
    # A component by set hashes becomes the smallest id of its documents.
    named = ids.join(comp, "rep", "left").withColumn("c", F.when(F.col("n") > 0, F.coalesce("component", "rep")))
    lowest = shared.settle(named.filter("c is not null").groupBy("c").agg(F.min("id").alias("low")), "lowest")
    out = named.join(lowest, "c", "left").groupBy("id").agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("low", "id")).alias("component_id"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id")
