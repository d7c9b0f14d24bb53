"""Operator 10: exact top-k inner products by a three-phase uniform threshold.

Each component x becomes floor(256 * x); a score is the integer inner product. Vectors are
cut into ``parts`` ranges of dimensions, and each range is scored by tasks of its own, in a grid
of blocks of candidates and of queries: such a task knows partial scores only.

1. Every range lists, for each query, the k candidates of the best partial scores. The scores
   of the candidates listed, and of no others, are resolved; the k-th best is the query's cutoff
   T, which is safe, as k candidates reach it.
2. T goes to the ranges. A candidate of score T or more has a range of T / parts or more (the
   mean can't exceed the largest), so the entries from T / parts on hold the whole result; they alone
   leave their tasks, as pairs of row keys.
3. The scores of these pairs are resolved on whole vectors, those below T go, and the k best of
   each query are its result. How many pairs are left depends on how far a query's neighbours
   stand out; no case is dropped, and a block bounds what a task holds.

Queries take the phases in rounds of ``query_round``, whose entries and copies of vectors go before the next
round, so the disk grows with the candidates only; the work grows with candidates times queries. Vectors travel in
the narrowest integers that hold them. Fewer ranges ship fewer entries, as T / parts lies nearer to T; two are the default.

Null vectors and vectors holding null or non-finite components take no part; only
vectors of a query's length are its candidates; rows that share the query's id are its
own. Repeated rows count as rows, but a query id on several rows is one query, with the row of the
smallest vector. Equal scores go to the smaller id. Products are exact: in double while no sum can
pass 2**53, in Python integers beyond, and scores outside the long range are held at its ends.
Rows without id are left out; an empty table gives no rows. Only ids and vectors are read, so other
columns may have any names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .vectors import matrices

_LONG = (-(2**63), 2**63 - 1)
_BYTES = {b"h": 2, b"w": 4, b"i": 8}


def _integers(ids: str, vector: str):
    """mapInArrow: usable vectors, tagged: b"h", b"w" or b"i" and little-endian integers of 2, 4 or 8 bytes, or b"t" and decimal text where a component needs more."""

    def run(batches):
        for b in batches:
            for at, m in matrices(b.column(ids), b.column(vector)):
                m = np.floor(256.0 * m)
                most = np.abs(m).max(axis=1)
                rows = [next((tag + x.astype(f"<i{_BYTES[tag]}").tobytes() for tag in _BYTES if top < 2 ** (8 * _BYTES[tag] - 2)), None) or b"t" + ",".join(str(int(y)) for y in x).encode() for x, top in zip(m, most, strict=True)]
                flag = b.column("is_query").take(pa.array(at))
                yield pa.record_batch([b.column(ids).take(pa.array(at)), flag, pa.array([m.shape[1]] * len(at), pa.int32()), pa.array(rows, pa.binary())], names=["vec_id", "is_query", "width", "vec"])

    return run


def _wide(batches):
    """mapInArrow: vectors of integers in 8 bytes each, in whose order one of several for a query is the smallest."""
    for b in batches:
        vec = [b"i" + _numbers(r).astype("<i8").tobytes() if r[:1] in _BYTES else r for r in b.column("vec").to_pylist()]
        yield pa.record_batch([b.column("vec_id"), b.column("width"), pa.array(vec, pa.binary())], names=["vec_id", "width", "vec"])


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{_BYTES[raw[:1]]}", offset=1)


def ranges(width: int, parts: int) -> list[tuple[int, int]]:
    """The ranges of dimensions, as equal as can be; none is empty."""
    cuts = np.linspace(0, width, min(parts, width) + 1).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _sliced(parts: int):
    """mapInArrow: a row for each range of a vector."""

    def run(batches):
        for b in batches:
            which, part, out = [], [], []
            for i, (raw, width) in enumerate(zip(b.column("vec").to_pylist(), b.column("width").to_pylist(), strict=True)):
                size = _BYTES.get(raw[:1])
                words = None if size else raw[1:].split(b",")
                for p, (lo, hi) in enumerate(ranges(width, parts)):
                    which.append(i)
                    part.append(p)
                    out.append(raw[:1] + raw[1 + size * lo : 1 + size * hi] if words is None else b"t" + b",".join(words[lo:hi]))
            names = [n for n in b.schema.names if n != "vec"]
            yield pa.record_batch([*(b.column(n).take(pa.array(which, pa.int32())) for n in names), pa.array(part, pa.int32()), pa.array(out, pa.binary())], names=[*names, "part", "vec"])

    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Float64 where every inner product of its rows stays exact; else Python integers."""
    rows = column.to_pylist()
    tags = {r[:1] for r in rows}
    if b"t" not in tags:
        if len(tags) == 1:
            m = np.frombuffer(b"".join(r[1:] for r in rows), f"<i{_BYTES[tags.pop()]}").reshape(len(rows), -1)
        else:
            m = np.stack([_numbers(r).astype(np.int64) for r in rows])
        if float(np.abs(m.astype(np.float64)).max()) ** 2 * m.shape[1] < 2**49:
            return m.astype(np.float64)
        return m.astype(object)
    return np.array([_numbers(r).tolist() if r[:1] in _BYTES else [int(y) for y in r[1:].split(b",")] for r in rows], object)


def _matrices(cand: pa.Table, query: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    c, q = _matrix(cand.column("vec")), _matrix(query.column("vec"))
    if c.dtype != q.dtype:
        c, q = (np.array([[int(y) for y in x] for x in m], object) for m in (c, q))
    return c, q


def _side(table: pa.Table, n: int) -> pa.Table:
    return table.filter(pa.array(table.column("side").to_numpy() == n))


ENTRY = "query_id long, row long, part long, partial long, width int"


def _entries(k: int, parts: int):
    """One range's partial scores of a block of candidates (side 0) for a block of queries (side 1): the k best for a
    query without cutoff (phase 1), all from cutoff / parts on for one with (phase 2)."""

    def run(table: pa.Table) -> pa.Table:
        cand, query = _side(table, 0), _side(table, 1)
        out_q, out_r, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        if cand.num_rows and query.num_rows:
            c, q = _matrices(cand, query)
            cid, qid, row = cand.column("vec_id").to_numpy(), query.column("vec_id").to_numpy(), cand.column("row").to_numpy()
            m = len(ranges(table.column("width")[0].as_py(), parts))
            cutoff, wanted = query.column("cutoff").to_pylist(), query.column("listing")[0].as_py()
            step = max(1, 500_000 // len(c))
            for lo in range(0, len(q), step):
                part = np.dot(q[lo : lo + step], c.T)
                own = qid[lo : lo + step, None] == cid[None, :]
                if part.dtype != object and not wanted:
                    least = np.array([-np.inf if x is None else x for x in cutoff[lo : lo + step]])
                    i, at = np.nonzero((part * m >= least[:, None]) & ~own)
                    out_q.append(qid[lo + i])
                    out_r.append(row[at])
                    continue
                for i in range(len(part)):
                    at = np.flatnonzero(~own[i])
                    p = part[i][at]
                    if wanted:
                        best = np.argsort(-p, kind="stable")[:k] if p.dtype == object else np.argpartition(-p, k - 1)[:k] if len(at) > k else np.arange(len(at))
                        out_s += [min(max(int(x), _LONG[0]), _LONG[1]) for x in p[best]]
                        at = at[best]
                    elif cutoff[lo + i] is not None:
                        at = at[(p * m >= cutoff[lo + i]).astype(bool)]
                    out_q.append(np.full(len(at), qid[lo + i]))
                    out_r.append(row[at])
        q, r = np.concatenate(out_q), np.concatenate(out_r)
        return pa.table({"query_id": pa.array(q, pa.int64()), "row": pa.array(r, pa.int64()), "part": pa.array(np.full(len(q), table.column("part")[0].as_py()), pa.int64()), "partial": pa.array(out_s, pa.int64()) if out_s else pa.nulls(len(q), pa.int64()), "width": pa.array(np.full(len(q), table.column("width")[0].as_py()), pa.int32())})

    return run


def _resolve(table: pa.Table) -> pa.Table:
    """The whole scores of the pairs (side 2) of one block of the grid, but for those below their query's cutoff."""
    cand, query, pairs = (_side(table, n) for n in range(3))
    score = []
    if cand.num_rows and query.num_rows and pairs.num_rows:
        c, q = _matrices(cand, query)
        keys = cand.column("row").to_numpy()
        names = query.column("vec_id").to_numpy()
        by_row, by_id = np.argsort(keys), np.argsort(names)
        i = by_row[np.searchsorted(keys, pairs.column("row").to_numpy(), sorter=by_row)]
        j = by_id[np.searchsorted(names, pairs.column("vec_id").to_numpy(), sorter=by_id)]
        # Several ranges may ship a pair.
        both = np.unique(i * len(names) + j)
        i, j = both // len(names), both % len(names)
        cutoff = query.column("cutoff").to_pylist()
        kept = []
        for lo in range(0, len(i), 20_000):
            at = slice(lo, lo + 20_000)
            x = (c[i[at]] * q[j[at]]).sum(axis=1)
            least = [cutoff[n] for n in j[at].tolist()]
            ok = [n for n, (y, t) in enumerate(zip(x.tolist(), least, strict=True)) if t is None or min(max(y, _LONG[0]), _LONG[1]) >= t]
            kept += [lo + n for n in ok]
            score += [min(max(int(x[n]), _LONG[0]), _LONG[1]) for n in ok]
        i, j = i[kept], j[kept]
        ids, copies, of = cand.column("vec_id").take(pa.array(i)), cand.column("copies").take(pa.array(i)), pa.array(names[j], pa.int64())
    else:
        ids = copies = of = pa.array([], pa.int64())
    return pa.table({"query_id": of, "vec_id": ids, "score": pa.array(score, pa.int64()), "copies": copies})


class TopK:
    """The three phases over one table; ``listed``, ``cutoff`` and ``entries`` are what each leaves."""

    def __init__(self, vectors: DataFrame, queries: Column, k: int, parts: int, ids: str, vector: str, block: int, query_block: int, query_round: int = 512):
        self.k, self.parts = k, parts
        flat = vectors.filter(F.col(ids).isNotNull()).select(F.col(ids).cast("long").alias("vec_id"), F.col(vector).alias("vec"), F.coalesce(queries, F.lit(False)).alias("is_query"))
        flat = flat.mapInArrow(_integers("vec_id", "vec"), "vec_id long, is_query boolean, width int, vec binary")
        # Equal rows are one with a count.
        once = flat.groupBy("vec_id", "width", "vec").agg(F.max("is_query").alias("is_query"), F.count(F.lit(1)).alias("copies"))
        self.rows = shared.settle(once.withColumn("row", F.xxhash64("vec_id", "vec")), "vectors")
        n = self.rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("is_query").cast("int")), F.lit(0)).alias("q")).first()
        self.rounds = max(1, -(-n["q"] // query_round))
        self.cbs, self.qbs = max(1, -(-n["n"] // block)), max(1, -(-min(n["q"], query_round) // query_block))
        asked = self.rows.filter("is_query").mapInArrow(_wide, "vec_id long, width int, vec binary")
        least = asked.groupBy("vec_id").agg(F.min(F.struct("vec", "width")).alias("v"))
        self.queries = shared.settle(least.select("vec_id", "v.width", "v.vec"), "queries")

    def _cb(self, row: str) -> Column:
        return F.pmod(F.col(row), F.lit(self.cbs)).cast("int")

    def _qb(self, query: str) -> Column:
        return F.pmod(F.xxhash64(query), F.lit(self.qbs)).cast("int")

    def _grid(self, cand: DataFrame, query: DataFrame, listing: bool) -> DataFrame:
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        c = cand.select(F.lit(0).alias("side"), self._cb("row").alias("cb"), every(self.qbs).alias("qb"), "vec_id", "row", "width", "vec", "copies", F.lit(None).cast("long").alias("cutoff"))
        q = query.select(F.lit(1).alias("side"), every(self.cbs).alias("cb"), self._qb("vec_id").alias("qb"), "vec_id", F.lit(0).cast("long").alias("row"), "width", "vec", F.lit(0).cast("long").alias("copies"), "cutoff")
        return c.union(q).withColumn("listing", F.lit(listing))

    def _parted(self, query: DataFrame, listing: bool) -> DataFrame:
        grid = self._grid(self.rows, query, listing)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grid.schema if f.name != "vec") + ", part int, vec binary"
        parted = grid.mapInArrow(_sliced(self.parts), kinds)
        return parted.groupBy("part", "cb", "qb", "width").applyInArrow(_entries(self.k, self.parts), ENTRY)

    def _ranked(self, scored: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.k)

    def resolved(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """query_id, vec_id, score, copies of the pairs (query_id, row, width) that reach their query's cutoff, if it has one; no other scores are computed."""
        blank = lambda kind: F.lit(None).cast(kind)
        asked = pairs.select(F.lit(2).alias("side"), self._cb("row").alias("cb"), self._qb("query_id").alias("qb"), F.col("query_id").alias("vec_id"), "row", "width", blank("binary").alias("vec"), F.lit(0).cast("long").alias("copies"), blank("long").alias("cutoff"), F.lit(False).alias("listing"))
        return self._grid(self.rows, queries, False).union(asked).groupBy("cb", "qb", "width").applyInArrow(_resolve, "query_id long, vec_id long, score long, copies long")

    def run(self) -> DataFrame:
        out = []
        for i in range(self.rounds):
            mine = self.queries.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(self.rounds)) == i) if self.rounds > 1 else self.queries
            out.append(shared.settle(self._round(mine), "round"))
            if self.rounds > 1:
                shared.drop(self.rows.sparkSession, self.listed, self.cutoff, self.shipped)
        return reduce(DataFrame.union, out)

    def _round(self, queries: DataFrame) -> DataFrame:
        """The three phases for these queries."""
        blank = queries.withColumn("cutoff", F.lit(None).cast("long"))
        lists = self._parted(blank, True)
        # Each block lists k, so the k best of a range are among them.
        best = Window.partitionBy("query_id", "part").orderBy(F.desc("partial"), "row")
        self.listed = shared.settle(lists.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= self.k).select("query_id", "row", "width").distinct(), "listed")
        kth = self._ranked(self.resolved(self.listed, blank)).filter(F.col("rank") == self.k)
        self.cutoff = shared.settle(kth.select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff")), "cutoff")
        limited = queries.join(self.cutoff, "vec_id", "left")
        self.shipped = shared.settle(self._parted(limited, False).select("query_id", "row", "width"), "entries")
        self.entries = self.shipped.select("query_id", "row").distinct()
        scored = self.resolved(self.shipped, limited)
        each = scored.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(self.k)).cast("int"))))
        return self._ranked(each).select("query_id", "rank", "vec_id", "score")


def exact_topk(vectors: DataFrame, queries: Column, k: int = 5, parts: int = 2, ids: str = "vec_id", vector: str = "embedding", block: int = 8192, query_block: int = 512, query_round: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates for the rows where ``queries`` holds."""
    with shared.scratch(vectors.sparkSession) as keep:
        out = shared.settle(TopK(vectors, queries, k, parts, ids, vector, block, query_block, query_round).run(), "topk")
        keep(out)
    return out
