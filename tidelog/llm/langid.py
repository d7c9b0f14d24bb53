"""Operator 1: language identification by nearest centroid.

A text is a bag of byte 2- and 3-grams of its letters (A-Z folded, every run of other
ASCII one space), hashed into ``DIMS`` buckets; the vector is (1 + log tf) * idf, of length 1.
The document frequencies behind idf cover every training document. Spherical k-means
gives each language several centroids, fitted on a bounded sample: the rows whose hash
of doc_id falls below a rate set so that about ``per_language`` rows of each language
remain. A text gets the language of the centroid of largest cosine, and is rejected
where its distance passes its language's radius or it has no letter. The radius comes from a low
quantile of the cosines of labelled rows held back from the centroids; as a short text has a small
cosine in any language, texts of fewer than ``FULL`` distinct n-grams need less of it, by the square root.

Null and empty texts, and texts without a letter, get ``und``, score 0 and are rejected. Whole texts are
read, however long; memory is bounded by the longest and by SLICE bytes and ROWS rows of others.
Without training rows every text is ``und``. Of equally near centroids the first language
in alphabetical order wins. Repeated rows are predicted each. The ``keep`` columns may have any names.
Rows without doc_id belong to the training rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import by_slice, slices

DIMS = 8192
FULL = 100
SLICE, ROWS = 400_000, 512  # bytes of text and rows that are weighed at once, which bounds a task's matrix
_LETTER = r"\p{L}"
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def grams(texts: pa.Array):
    """Sparse counts of a slice: (document, bucket, count), in order of document and bucket."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[int(at[0]) : int(at[-1])] if data is not None else np.empty(0, np.uint8)
    b = _KEEP[raw]
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(at))
    if len(b):
        keep = np.ones(len(b), bool)
        keep[1:] = ~((b[1:] == 32) & (b[:-1] == 32) & (doc[1:] == doc[:-1]))
        b, doc = b[keep].astype(np.uint32), doc[keep]
    else:
        b = b.astype(np.uint32)
    keys = []
    for n, odd in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        m = len(b) - n + 1
        if m > 0:
            x = b[:m].copy()
            for i in range(1, n):
                x = x * np.uint32(257) + b[i : m + i]
            bucket = (x * np.uint32(odd)) >> np.uint32(19)  # 13 bits: DIMS
            same = doc[:m] == doc[n - 1 :]
            keys.append(doc[:m][same] * DIMS + bucket[same])
    if not keys:
        return (np.empty(0, np.int64),) * 3
    cells = np.bincount(np.concatenate(keys), minlength=len(texts) * DIMS) if len(texts) <= 512 else None
    if cells is None:
        key, count = np.unique(np.concatenate(keys), return_counts=True)
    else:
        key = np.flatnonzero(cells)
        count = cells[key]
    return key // DIMS, key % DIMS, count


def _frequencies(batches):
    """mapInArrow: each task's document frequencies; bucket -1 is the number of documents."""
    df, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for part in slices(batch, "text", SLICE, ROWS):
            df += np.bincount(grams(part.column("text"))[1], minlength=DIMS)
            n += part.num_rows
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.concatenate([[-1], at]), pa.int32()), pa.array(np.concatenate([[n], df[at]]), pa.int64())], names=["bucket", "n"])


def _weights(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    d, k, n = grams(texts)
    w = np.zeros((len(texts), DIMS), np.float32)
    w[d, k] = (1 + np.log(n)) * idf[k]
    length = np.sqrt((w * w).sum(axis=1, keepdims=True))
    return w / np.where(length > 0, length, 1)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the mean's farthest rows, so it needs no chance."""
    mean = x.mean(axis=0)
    picks = [int(np.argmax(x @ mean))]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin((x @ x[picks].T).max(axis=1))))
    c = x[picks]
    for _ in range(rounds):
        of = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[of == i].sum(axis=0) if (of == i).any() else c[i] for i in range(len(c))])
        new = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


class Model:
    """idf, centroids, the language of each, and the least cosine each accepts."""

    def __init__(self, idf, centroids, langs, least):
        self.idf, self.centroids, self.langs, self.least = idf, centroids, langs, least

    def predict(self, texts: pa.Array):
        letters = pc.fill_null(pc.match_substring_regex(texts, _LETTER), False).to_numpy(zero_copy_only=False)
        if not len(self.langs):
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        w = _weights(texts, self.idf)
        near = w @ self.centroids.T
        share = np.sqrt(np.minimum(1, (w > 0).sum(axis=1) / FULL))
        at = np.argmax(near, axis=1)
        score = np.where(letters, np.clip(near[np.arange(len(at)), at], 0, 1), 0.0)
        lang = [self.langs[i] if ok else "und" for i, ok in zip(at, letters, strict=True)]
        return lang, score.astype(np.float64), ~letters | (score < self.least[at] * share)


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 400, most_languages: int = 1000, clusters: int = 4, reach: float = 0.7, low: float = 0.01) -> Model:
    """Fits on the rows of ``train`` with a language and a letter. Of more than ``most_languages`` labels the most
    frequent are learned, so that dirty labels can't fill the driver. ``per_language`` bounds the
    sample that centroids are fitted on (twice that is held at most), a fifth of which is held back for
    the radius if there are 200 rows; a text needs ``reach`` of the cosine that a share ``low`` of them stays below."""
    train = train.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).alias("key")).filter(F.col("lang").isNotNull() & F.col("text").rlike(_LETTER))
    per = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    counts = {r["lang"]: r["n"] for r in per.collect()}
    df = np.zeros(DIMS)
    n = 0
    for r in train.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + n) / (1 + df)) + 1
    draw = F.pmod(F.xxhash64("key"), F.lit(1_000_000))
    rates = [(name, int(1_000_000 * min(1.0, 1.5 * per_language / c)) + 1) for name, c in sorted(counts.items())]
    rates = train.sparkSession.createDataFrame(rates, "lang string, rate long")  # most_languages rows at most
    sample = train.join(F.broadcast(rates), "lang").filter(draw < F.col("rate")).select("lang", "text")

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = _weights(batch.column("text"), idf)
        return pa.record_batch([batch.column("lang"), pa.array([r.astype("<f2").tobytes() for r in w], pa.binary())], names=["lang", "vec"])

    seen: dict[str, list[bytes]] = {name: [] for name in counts}
    rows = sample.mapInArrow(by_slice("text", vectors, SLICE, ROWS), "lang string, vec binary")
    for r in rows.toLocalIterator():
        if len(seen[r["lang"]]) < 2 * per_language:
            seen[r["lang"]].append(bytes(r["vec"]))
    centroids, langs, least = [], [], []
    for name in sorted(counts):
        if not seen[name]:
            continue
        x = np.frombuffer(b"".join(sorted(seen[name])), "<f2").astype(np.float32).reshape(-1, DIMS)
        back = np.arange(len(x)) % 5 == 0 if len(x) >= 200 else np.zeros(len(x), bool)
        c = cluster(x[~back], clusters)
        # One radius for a language's clusters: a small tight one says nothing about how far a
        # text may lie. Short rows count as far as they are asked for.
        share = np.sqrt(np.minimum(1, (x > 0).sum(axis=1) / FULL))
        like = (x @ c.T).max(axis=1) / np.maximum(share, 1e-6)
        radius = float(np.quantile(like[back] if back.any() else like, low))
        centroids += list(c)
        langs += [name] * len(c)
        least += [reach * radius] * len(c)
    return Model(idf, np.stack(centroids).astype(np.float32) if centroids else np.empty((0, DIMS), np.float32), langs, np.array(least))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """The ``keep`` columns of each row, and lang_pred, score, rejected, their names after ``prefix``."""

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, out = model.predict(batch.column("text"))
        return pa.record_batch([*(batch.column(c) for c in own), pa.array(lang, pa.string()), pa.array(score), pa.array(out)], names=[*own, "lang", "score", "out"])

    names = [prefix + n for n in ("lang_pred", "score", "rejected")]
    own = {f"k{i}": c for i, c in enumerate(keep)}  # by number, so that their names can't clash
    frame = docs.select(*(F.col(c).alias(k) for k, c in own.items()), F.col(text).alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema if f.name != "text")
    out = frame.mapInArrow(by_slice("text", label, SLICE, ROWS), f"{kinds}{', ' if own else ''}lang string, score double, out boolean")
    return out.select(*(F.col(k).alias(c) for k, c in own.items()), *(F.col(c).alias(n) for c, n in zip(("lang", "score", "out"), names, strict=True)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(5)) == 0, F.lit(False))
