"""Replaying changes into table state.

Changes are flat rows with key columns, an operation, order columns (``bucket`` first: a
number that grows with the order, as a log file's) and values with presences. What depends on the
row before in its key is computed in two steps: a summary of each (key, bucket), carried over
the buckets, and then within buckets. A hot key's history so is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(changes: DataFrame, key: list[str], bucket: str, order: list[str], value: Column, name: str, inclusive: bool) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` in the row's key before the row, or up to it."""
    at = F.struct(*order)
    known = changes.withColumn("__v", value)
    last = F.max_by(F.struct(F.col("__v").alias("v")), F.when(F.col("__v").isNotNull(), at))
    per = known.groupBy(*key, bucket).agg(last.alias("s")).select(*key, bucket, F.col("s.v").alias("s"))
    over = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = per.withColumn("__carry", F.last("s", ignorenulls=True).over(over)).drop("s")
    joined = known.join(before, [*key, bucket])
    within = Window.partitionBy(*key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return joined.withColumn(name, F.coalesce(F.last("__v", ignorenulls=True).over(within), F.col("__carry"))).drop("__v", "__carry")


def latest_state(changes: DataFrame, key: list[str], order: list[str], columns: list[str], operation: str = "operation") -> DataFrame:
    """The last row of each key that isn't deleted, and how many changes it saw; an aggregation
    that combines before the shuffle, whatever a key's history."""
    row = F.struct(F.col(operation).alias("__op"), *columns)
    last = changes.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("r"), F.count(F.lit(1)).alias("changes"))
    return last.filter("r.__op != 'delete'").select(*key, *(F.col(f"r.{c}").alias(c) for c in columns), "changes")


def strict_violations(changes: DataFrame, key: list[str], bucket: str, order: list[str], operation: str = "operation", target: DataFrame | None = None) -> DataFrame:
    """Changes that a strict target refuses: an insert of a live key, an update or delete of a dead
    one. A key is live after an insert and dead after a delete; at the start it is live if ``target``
    has it."""
    op = F.col(operation)
    mark = F.when(op == "insert", F.lit(1)).when(op == "delete", F.lit(0))
    rows = carried(changes, key, bucket, order, mark, "live", False)
    if target is None:
        live = F.coalesce("live", F.lit(0))
    else:
        rows = rows.join(target.select(*key).distinct().withColumn("__there", F.lit(1)), key, "left")
        live = F.coalesce("live", "__there", F.lit(0))
    code = F.when((op == "insert") & (live == 1), "duplicate_key").when((op != "insert") & (live == 0), "missing_row")
    return rows.withColumn("rule_code", code).filter("rule_code is not null").drop("live", "__there")


def unchanged_carry(changes: DataFrame, key: list[str], bucket: str, order: list[str], column: str, presence: str, keep_missing: str | None = None) -> DataFrame:
    """Fills ``column`` where its presence is unchanged with the key's last present value. NULLs
    that were sent count as values. The key must not change within the history. With ``keep_missing``
    a column of that name says where the history holds no value, so that an older one may fill the gap."""
    sent = F.when(F.col(presence).isin("value", "null"), F.struct(F.col(column).alias("v")))
    out = carried(changes, key, bucket, order, sent, "__last", True)
    unchanged = F.col(presence) == "unchanged"
    if keep_missing:
        out = out.withColumn(keep_missing, unchanged & F.col("__last").isNull())
    return out.withColumn(column, F.when(unchanged, F.col("__last.v")).otherwise(F.col(column))).drop("__last")


def key_events(changes: DataFrame, before: list[str], after: list[str], order: list[str]) -> DataFrame:
    """Puts and removes of keys: an update removes its old key before it puts its new one."""
    old, new = F.struct(*(F.col(b).alias(f"k{i}") for i, b in enumerate(before))), F.struct(*(F.col(a).alias(f"k{i}") for i, a in enumerate(after)))
    step = lambda n, kind, k: F.struct(F.lit(n).alias("step"), F.lit(kind).alias("kind"), k.alias("key"))
    steps = F.when(F.col("operation") == "insert", F.array(step(1, "put", new))).when(F.col("operation") == "delete", F.array(step(0, "remove", old))).otherwise(F.array(step(0, "remove", old), step(1, "put", new)))
    return changes.select("*", F.explode(steps).alias("e")).select(*changes.columns, "e.step", "e.kind", F.col("e.key").alias("row_key"))


def fold(target: DataFrame | None, changes: DataFrame, key: list[str], columns: list[str], order: list[str], old_key: list[str] | None = None) -> DataFrame:
    """Target rows after the changes. With ``old_key`` an update may move a row to another key."""
    if old_key:
        events = key_events(changes, old_key, key, order)
        live = events.select(*(F.col(f"row_key.k{i}").alias(k) for i, k in enumerate(key)), *[c for c in columns if c not in key], F.struct(*order, "step").alias("at"), F.when(F.col("kind") == "remove", "delete").otherwise("put").alias("operation"))
    else:
        live = changes.select(*key, *columns, F.struct(*order, F.lit(1).alias("step")).alias("at"), "operation")
    last = live.groupBy(*key).agg(F.max_by(F.struct("operation", *columns), F.col("at")).alias("r"))
    put = last.filter("r.operation != 'delete'").select(*key, *(F.col(f"r.{c}").alias(c) for c in columns))
    if target is None:
        return put
    return target.select(*key, *columns).join(last.select(*key), key, "left_anti").unionByName(put)


def components_of(moves: DataFrame) -> DataFrame:
    """(node, component) for the keys (a, b) that changes move rows between: labels are lowered to the least neighbour's
    until none changes. Moves are few beside the changes of a batch."""
    from ..storage import settle

    edges = settle(moves.select("a", "b").union(moves.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settle(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        # A key takes the least label around it, and the label of that label.
        near = edges.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        hop = label.select(F.col("node").alias("component"), F.col("component").alias("far"))
        lower = label.join(near, "node").join(hop, "component", "left").select("node", F.col("component").alias("was"), F.least("component", "low", "far").alias("component"))
        after = settle(lower)
        changed = not after.filter("was != component").isEmpty()
        label = after.select("node", "component")
        if not changed:
            return label


def _replay(key: list[str], columns: list[str], strict: bool):
    """Replays the rows of one component of keys in order: kind 0 are rows of the target, kind 1 changes."""

    def run(rows):
        import pandas as pd

        state: dict[tuple, dict] = {}
        out = []
        for r in rows.sort_values(["kind", "file_no", "pos", "sequence"], kind="stable").to_dict("records"):
            new, old = tuple(r[k] for k in key), tuple(r[f"old_{k}"] for k in key)
            if r["kind"] == 0:
                state[new] = {c: r[c] for c in columns}
                continue
            code, op = None, r["operation"]
            if op == "insert":
                code = "duplicate_key" if new in state else None
            else:
                code = "missing_row" if old not in state else "duplicate_key" if op == "update" and new != old and new in state else None
            if code and strict:
                out.append({**r, "rule_code": code})
                continue
            before = state.pop(old, {}) if op != "insert" else {}
            if op != "delete":
                state[new] = {c: before.get(c) if r[f"presence_{c}"] == "unchanged" else r[c] for c in columns}
        out += [dict(zip(key, k, strict=True)) | v | {"rule_code": None} for k, v in state.items()]
        names = [*key, *columns, "file_no", "pos", "sequence", "rule_code"]
        return pd.DataFrame([{n: o.get(n) for n in names} for o in out], columns=names)

    return run


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Inserts, updates and deletes that turn one snapshot into another; NULLs compare as equal."""
    a = old.select(*key, F.struct(*columns).alias("__old"))
    b = new.select(*key, F.struct(*columns).alias("__new"))
    changed = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").when(~F.col("__old").eqNullSafe(F.col("__new")), "update")
    both = a.join(b, key, "full_outer").withColumn("operation", changed).filter("operation is not null")
    return both.select(*key, "operation", *(F.col(f"__old.{c}").alias(f"old_{c}") for c in columns), *(F.col(f"__new.{c}").alias(f"new_{c}") for c in columns))


def handoff(snapshot: DataFrame, changes: DataFrame, boundary: Column) -> DataFrame:
    """A snapshot's rows and, behind its boundary, the changes: each row from one side only."""
    return snapshot.withColumn("phase", F.lit("snapshot")).unionByName(changes.filter(boundary).withColumn("phase", F.lit("incremental")))


def ranked(rows: DataFrame, bucket: Column, order: list[str], name: str = "rank") -> DataFrame:
    """Numbers all rows from 0 in order. ``bucket`` grows with the order and is small; its counts
    are summed up apart, so no task sorts the table as a whole."""
    placed = rows.withColumn("__b", bucket)
    counts = placed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__b", before.alias("__o"))
    inside = Window.partitionBy("__b").orderBy(*order)
    return placed.join(offsets, "__b").withColumn(name, F.row_number().over(inside) - 1 + F.col("__o")).drop("__b", "__o")


def keyset_pages(rows: DataFrame, bucket: Column, key: list[str], size: int = 256) -> DataFrame:
    """Pages of a keyset scan: page number, rows, first and last key."""
    numbered = ranked(rows, bucket, key).withColumn("page", F.floor(F.col("rank") / size).cast("long"))
    k = F.struct(*key)
    out = numbered.groupBy("page").agg(F.count(F.lit(1)).alias("page_rows"), F.min(k).alias("lo"), F.max(k).alias("hi"))
    return out.select("page", "page_rows", *(F.col(f"lo.{c}").alias(f"first_{c}") for c in key), *(F.col(f"hi.{c}").alias(f"last_{c}") for c in key))


def next_page(rows: DataFrame, key: list[str], after: tuple | None, size: int = 256) -> DataFrame:
    """The rows of a keyset scan after a key."""
    if after is not None:
        rows = rows.filter(F.struct(*key) > F.struct(*(F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(key, after, strict=True))))
    return rows.orderBy(*key).limit(size)
