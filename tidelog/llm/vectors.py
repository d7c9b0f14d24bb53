"""Reading embedding columns in Arrow form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(ids: pa.Array, vectors: pa.Array):
    """(positions, matrix in double) for each length that the usable vectors of a batch have.
    A vector is usable unless it is null, empty, or holds a null or non-finite component."""
    if len(vectors) == 0:
        return
    lengths = np.array(pc.fill_null(pc.list_value_length(vectors), 0))
    flat = pc.list_flatten(vectors)
    values = np.array(pc.fill_null(flat.cast(pa.float64()), float("nan")))
    ends = np.cumsum(lengths)
    known = ~np.array(pc.is_null(ids))
    for width in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero((lengths == width) & known)
        m = values[(ends[at] - width)[:, None] + np.arange(width)]
        fine = np.isfinite(m).all(axis=1)
        if fine.any():
            yield at[fine], m[fine]
