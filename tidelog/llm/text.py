"""Word and batch kernels shared by the corpus operators.

Texts arrive as Arrow string arrays and are processed as one run of bytes, so
the cost of a document does not depend on Python objects. Words are maximal runs
of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return, with A-Z folded; a word is known by a 64-bit polynomial hash, and two
different words share one with probability about 2**-64.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.full(size, _U(base))
            have[0] = _U(1)
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def combine(columns: list[np.ndarray], salt: int) -> np.ndarray:
    """A hash of several hashes in order."""
    with np.errstate(over="ignore"):
        out = np.full(len(columns[0]), _U(salt))
        for c in columns:
            out = mix(out * _U(0xD1342543DE82EF95) + c)
    return out


class Words:
    """The words of a slice: ``hash``, byte ranges ``start``/``end`` in ``data``, and ``first``,
    where document i owns words first[i]:first[i+1]. ``base`` holds each document's first byte."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low = int(at[0]) if len(at) else 0
        raw = np.frombuffer(data, np.uint8)[low : int(at[-1])] if data is not None and len(at) else np.empty(0, np.uint8)
        self.base = at - low
        self.data = _FOLD[raw]
        n = len(raw)
        solid = ~_SPACE[raw]
        cut = np.zeros(n + 1, bool)
        cut[self.base] = True
        before = np.concatenate([[False], solid[:-1]]) & ~cut[:-1] if n else np.empty(0, bool)
        after = np.concatenate([solid[1:], [False]]) & ~cut[1:] if n else np.empty(0, bool)
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        with np.errstate(over="ignore"):
            run = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _power(_BASE, n)[:n], out=run[1:])
            self.hash = mix((run[self.end] - run[self.start]) * _power(_BASE_INV, n)[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, self.base)

    def shingles(self, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and the document of each. With ``short``, a
        document of 1 to k-1 words has its whole sequence as its one shingle."""
        n = np.diff(self.first)
        doc = np.repeat(np.arange(len(n)), n)
        whole = max(0, len(self.hash) - k + 1)
        keep = doc[:whole] == doc[k - 1 :] if whole else np.empty(0, bool)
        out = combine([self.hash[i : whole + i] for i in range(k)], k)[keep] if whole else np.empty(0, np.uint64)
        of = doc[:whole][keep]
        if short and (few := np.flatnonzero((n > 0) & (n < k))).size:
            more = np.array([combine([self.hash[j : j + 1] for j in range(self.first[i], self.first[i + 1])], int(n[i]))[0] for i in few], np.uint64)
            out, of = np.concatenate([out, more]), np.concatenate([of, few])
            order = np.argsort(of, kind="stable")
            out, of = out[order], of[order]
        return out, of


# A byte-level tokenizer's splitting pattern restated for `re` where a text has only characters below U+0250:
# there the letters and numbers are these (fixed values, from the Unicode categories L* and N*).
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = r"\t-\r \x85\xa0"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BEYOND = re.compile("[^\0-ɏ]")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each and ``rows`` rows at most; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.concatenate([[0], np.cumsum(size)[:-1]]) // most if len(size) else np.empty(0, np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for at in range(a, b, rows):
            yield batch.slice(at, min(rows, b - at))


def by_slice(column: str, make: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = SLICE_BYTES, rows: int = 1 << 20):
    """A mapInArrow function that gives ``make`` bounded parts of each batch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, most, rows):
                out = make(part)
                if out is not None and out.num_rows:
                    yield out

    return run


def lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list column of n rows from values whose owners ascend."""
    at = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
