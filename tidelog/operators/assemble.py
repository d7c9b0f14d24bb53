"""Whole transactions out of records, and the rules of a record stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model


def assemble(log: DataFrame) -> DataFrame:
    """One row for each committed transaction, its changes in sequence order. A transaction is
    bounded (64 MiB, 100 000 rows), so its changes fit an array."""
    per = log.groupBy("source", F.col("transaction.id").alias("id"))
    row = F.col("payload.type") == model.ROW
    steps = F.array_sort(F.collect_list(F.when(row, F.struct(F.col("transaction.sequence").alias("sequence"), F.col("payload")))))
    out = per.agg(
        F.first("transaction.begin_cursor").alias("begin_cursor"),
        F.first("transaction.commit_cursor").alias("commit_cursor"),
        F.max("payload.change_count").alias("change_count"),
        F.max((F.col("payload.type") == model.COMMIT).cast("int")).alias("committed"),
        F.sum("bytes").alias("bytes"),
        steps.alias("steps"),
    )
    return out.filter("committed = 1").select("source", "id", "begin_cursor", "commit_cursor", "change_count", "bytes", F.transform("steps", lambda s: s["payload"]).alias("changes"))


def summaries(changes: DataFrame, tx: str, operation: str, order: Column, counted: dict[str, str] | None = None) -> DataFrame:
    """Counts and bounds of each transaction of flat changes."""
    aggs = [F.count(F.lit(1)).alias("changes"), F.min(order).alias("first_pos"), F.max(order).alias("last_pos")]
    aggs += [F.sum((F.col(operation) == op).cast("long")).alias(f"{op}s") for op in model.OPERATIONS]
    return changes.groupBy(tx).agg(*aggs)


def change_count_mismatches(changes: DataFrame, tx: str, declared: Column) -> DataFrame:
    """Transactions whose rows differ in number from what their commit declares."""
    return changes.groupBy(tx).agg(F.count(F.lit(1)).alias("changes"), F.max(declared).cast("long").alias("declared")).filter("changes != declared")


def sequence_violations(changes: DataFrame, tx: str, sequence: str, order: list[str]) -> DataFrame:
    """Rows whose sequence isn't one more than that of the row before in their transaction."""
    w = Window.partitionBy(tx).orderBy(*order)
    expected = F.coalesce(F.lag(sequence).over(w) + 1, F.lit(1))
    return changes.withColumn("expected", expected.cast("long")).filter(F.col(sequence) != F.col("expected"))


def stream_violations(log: DataFrame, limit: int = model.MAX_TRANSACTION_BYTES) -> DataFrame:
    """(line_no, rule_code): interleaved or nested transactions, gaps in sequence, oversize."""
    w = Window.partitionBy("file").orderBy("line_no")
    begin = (F.col("payload.type") == model.BEGIN).cast("int")
    tagged = log.withColumns({"tx_ordinal": F.sum(begin).over(w), "prior": F.lag("payload.type").over(w)})
    inside = Window.partitionBy("file", "tx_ordinal").orderBy("line_no")
    head = F.struct("source", F.col("transaction.id"), F.col("transaction.begin_cursor"), F.col("transaction.commit_cursor"))
    tagged = tagged.withColumns({"differs": head != F.first(head).over(inside), "step": F.row_number().over(inside) - 1, "size": F.sum("bytes").over(inside)})
    is_ = lambda kind: F.col("payload.type") == kind
    rules = F.array_compact(
        F.array(
            F.when(F.col("differs"), F.lit("interleaved_transaction")),
            F.when(is_(model.BEGIN) & F.col("prior").isin(model.BEGIN, model.ROW), F.lit("nested_transaction")),
            F.when(~is_(model.BEGIN) & ((F.col("tx_ordinal") == 0) | F.col("prior").eqNullSafe(model.COMMIT)), F.lit("row_without_begin")),
            F.when(F.col("transaction.sequence") != F.col("step"), F.lit("sequence_gap")),
            F.when(is_(model.COMMIT) & (F.col("payload.change_count") != F.col("step") - 1), F.lit("change_count_mismatch")),
            F.when(F.col("size") > limit, F.lit("transaction_too_large")),
        )
    )
    return tagged.select("file", "line_no", F.col("transaction.id").alias("transaction_id"), F.explode(rules).alias("rule_code"))
