"""Operator 9: embedding near-duplicates by int8 tile products with error bounds.

A vector is scaled to length 1 and quantised, u = s*q + e with q of int8 and the length
of e known. For two vectors u.v differs from s*t*(q.r) by no more than
|sq||f| + |e||tr| + |e||f|; with that bound a product of two int8 tiles shows which
pairs are surely linked, which surely not, and which alone must be recomputed in double.
Tiles hold a bounded number of vectors. A tile product reports sums of links and a
spanning forest of them, never the pairs themselves, so a large group of near copies
costs a tile as many rows as it has vectors. Equal vectors are one vector with a count.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; nor
do vectors of unlike length. A repeated vec_id is compared once for each row and returned
once, with the links of all its rows. Rows without vec_id are left out; an empty table
gives no rows. There are no ties: a link is a pair, and the smallest id is kept. Only the ids and vectors are
read, so other columns may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, shared
from .vectors import matrices

SLACK = 1e-9  # of double arithmetic on unit vectors; float32 holds the int8 products exactly


def _unit(batches):
    """mapInArrow: usable vectors in double, little-endian, with their quantised form."""
    for b in batches:
        for at, m in matrices(b.column("id"), b.column("vec")):
            peak = np.abs(m).max(axis=1)
            m, at = m[peak > 0] / peak[peak > 0, None], at[peak > 0]
            length = np.sqrt((m * m).sum(axis=1))
            u = m / length[:, None]
            yield pa.record_batch([b.column("id").take(pa.array(at)), pa.array([r.tobytes() for r in u.astype("<f8")], pa.binary())], names=["id", "unit"])


def quantise(u: np.ndarray):
    """int8 rows as float32, scales, lengths of s*q, and lengths of the errors, each with slack."""
    scale = np.abs(u).max(axis=1) / 127.0
    q = np.rint(u / scale[:, None])
    held = q * scale[:, None]
    return q.astype(np.int8).astype(np.float32), scale, np.sqrt((held**2).sum(axis=1)) + SLACK, np.sqrt(((u - held) ** 2).sum(axis=1)) + SLACK


def _links(a, b, threshold: float, same: bool, rows: int = 512):
    """Positions (i, j) of linked rows of two tiles; in one tile only i < j."""
    (u, qa, sa, la, ea), (v, qb, sb, lb, eb) = a, b
    for lo in range(0, len(u), rows):
        hi = min(lo + rows, len(u))
        near = (qa[lo:hi] @ qb.T).astype(np.float32)
        near *= sa[lo:hi, None].astype(np.float32)
        near *= sb[None, :].astype(np.float32)
        worst = la[lo:hi] * eb.max() + ea[lo:hi] * (lb.max() + eb.max()) + 1e-5  # covers float32 scaling too
        i, j = np.nonzero(near >= (threshold - worst)[:, None].astype(np.float32))
        keep = i + lo < j if same else slice(None)
        i, j = i[keep], j[keep]
        bound = la[lo + i] * eb[j] + ea[lo + i] * (lb[j] + eb[j]) + 1e-5
        got = near[i, j].astype(np.float64)
        sure = got - bound >= threshold
        open_ = np.flatnonzero(~sure & (got + bound >= threshold))
        for x in range(0, len(open_), 200_000):
            p = open_[x : x + 200_000]
            sure[p] = np.einsum("ij,ij->i", u[lo + i[p]], v[j[p]]) >= threshold
        yield lo + i[sure], j[sure]


def _tile(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ta, tb = key[0].as_py(), key[1].as_py()
        ids, count, tile = (table.column(c).to_numpy() for c in ("rep", "copies", "tile"))
        units = np.frombuffer(b"".join(table.column("unit").to_pylist()), "<f8").reshape(len(ids), -1)
        parts = []
        for t in (ta, tb) if ta != tb else (ta,):
            at = np.flatnonzero(tile == t)
            parts.append((ids[at], count[at], (units[at], *quantise(units[at]))))
        out_a, out_b, sums = [], [], {}
        if all(len(p[0]) for p in parts):
            (ia, na, a), (ib, nb, b) = parts[0], parts[-1]
            la, lb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
            for i, j in _links(a, b, threshold, ta == tb):
                la += np.bincount(i, nb[j], len(ia)).astype(np.int64)
                lb += np.bincount(j, na[i], len(ib)).astype(np.int64)
                tree = graph.forest(ia[i], ib[j])
                out_a.append(ia[i][tree])
                out_b.append(ib[j][tree])
            if out_a:
                ea, eb = np.concatenate(out_a), np.concatenate(out_b)
                tree = graph.forest(ea, eb)
                out_a, out_b = [ea[tree]], [eb[tree]]
            sums = {"id": np.concatenate([ia[la > 0], ib[lb > 0]]), "n": np.concatenate([la[la > 0], lb[lb > 0]])}
        e = np.concatenate(out_a) if out_a else np.empty(0, np.int64)
        f = np.concatenate(out_b) if out_b else np.empty(0, np.int64)
        s, n = (sums["id"], sums["n"]) if sums else (np.empty(0, np.int64),) * 2
        none = lambda k: pa.nulls(k, pa.int64())
        join = lambda x, y: pa.chunked_array([pa.array(x, pa.int64()), y])
        return pa.table({"a": join(e, pa.array(s, pa.int64())), "b": join(f, none(len(s))), "n": pa.chunked_array([none(len(e)), pa.array(n, pa.int64())])})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, ids: str = "vec_id", vector: str = "embedding", tile: int = 6000) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    with shared.scratch(vectors.sparkSession) as keep:
        out = shared.settle(_near(vectors, threshold, ids, vector, tile), "near")
        keep(out)
    return out


def _near(vectors: DataFrame, threshold: float, ids: str, vector: str, tile: int) -> DataFrame:
    rows = vectors.filter(F.col(ids).isNotNull()).select(F.col(ids).cast("long").alias("id"), F.col(vector).alias("vec"))
    units = rows.mapInArrow(_unit, "id long, unit binary")
    # Vectors of one direction share a row; ``reps`` is settled since many tiles read it.
    reps = shared.settle(units.groupBy("unit").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")
    # As many tiles as their size asks for, and of few vectors enough pairs of them for all cores.
    n, cores = reps.count(), vectors.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, -(-n // tile), min(math.isqrt(4 * cores) + 1, n // 500))
    placed = reps.withColumn("tile", F.pmod(F.xxhash64("unit"), F.lit(tiles)).cast("int")).withColumn("width", F.length("unit"))
    # A unit's own row is known by (rep): one id may stand for several vectors only if its rows differ.
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")
    grid = placed.select("*", other).withColumns({"ta": F.least("tile", "other"), "tb": F.greatest("tile", "other")})
    found = grid.groupBy("ta", "tb", "width").applyInArrow(_tile(threshold), "a long, b long, n long")
    found = shared.settle(found, "found")
    # Links of a direction and of each row behind it.
    links = found.filter("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    linked = shared.settle(reps.join(links, "rep", "left").select("unit", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")), "linked")
    member = units.join(linked, "unit").select("id", "rep", "n")
    per_id = member.groupBy("id").agg(F.sum("n").alias("n_links"))
    edges = found.filter("b is not null").select("a", "b").union(member.filter("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    comp = graph.components(edges)
    out = rows.select("id").distinct().join(per_id, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
