"""Digests and canonical forms."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable(value: object) -> str:
    """The sha256 of a driver-side value's JSON, without absent fields."""

    def lean(v):
        if isinstance(v, dict):
            return {k: lean(x) for k, x in v.items() if x is not None}
        return [lean(x) for x in v] if isinstance(v, (list, tuple)) else v

    return hashlib.sha256(json.dumps(lean(value), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def struct_digest(*columns: Column) -> Column:
    """The sha256 of columns as a JSON object, without nulls."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}), 256)


def bytes_digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def valid_digest(x: Column) -> Column:
    return x.rlike(r"^sha256:[0-9a-f]{64}$")


def row_digest(*columns: Column) -> Column:
    """The sha256 of a row: each column's length and text, nulls as a mark of their own."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("|", *(part(c) for c in columns)), 256)


def ordered_digest(rows, by: list[str], order: list[str], digest: str):
    """One digest for each group: its rows' digests in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(digest).alias("__d"))))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.transform(items, lambda x: x["__d"]), ","), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
