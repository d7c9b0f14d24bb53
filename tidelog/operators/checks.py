"""Small checks and sums over transactions, images and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values

#: Native types that a snapshot may carry; fixed values.
SNAPSHOT_TYPES = ("tinyint", "smallint", "mediumint", "int", "bigint", "decimal", "float", "double", "char", "varchar", "text", "mediumtext", "longtext", "tinytext", "binary", "varbinary", "blob", "tinyblob", "mediumblob", "longblob", "date", "datetime", "timestamp", "time", "year", "json", "enum", "set", "bit")


def tables_of(transactions: DataFrame) -> DataFrame:
    """How many tables each transaction changes, and how many changes it has."""
    names = F.array_distinct(F.transform("changes", lambda c: F.struct(c["schema"], c["table"])))
    return transactions.select("id", F.size(names).cast("long").alias("tables"), F.size("changes").cast("long").alias("changes"))


def checked_sum(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sums of integers with 64 bits; a sum beyond them is no value but a code. Sums run in 38 digits, so none wraps."""
    total = F.sum(F.col(value).cast("decimal(38,0)"))
    out = rows.groupBy(*by).agg(total.alias("__t"))
    fits = F.col("__t").try_cast("long")
    return out.select(*by, fits.alias("total"), F.when(fits.isNull() & F.col("__t").isNotNull(), "integer_overflow").alias("rule_code"))


def pinned(rows: DataFrame) -> list[tuple[str, str]]:
    """A table's column names and types, from a plan that reads no row."""
    return [(f.name, f.dataType.simpleString()) for f in rows.limit(0).schema]


def json_round_trips(x: Column) -> Column:
    """Whether a JSON text's normal form reads as itself again."""
    once = values.normal_json_text(x)
    return F.coalesce(values.normal_json_text(once) == once, F.lit(False))


def with_matches(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows for which the other table has a match (EXISTS); no row is doubled."""
    return rows.join(other.select(*on), on, "left_semi")


def attribute_types(attributes: DataFrame, types: DataFrame, namespaces: DataFrame, classes: DataFrame) -> DataFrame:
    """Attributes of relations with the names of their relation, its namespace and their type."""
    out = attributes.join(types, "type_oid").join(classes, "class_oid").join(namespaces, "namespace_oid")
    return out.select("namespace_name", "class_name", "attribute_name", "type_name")


def tasks_by_instance(tasks: DataFrame, instances: DataFrame) -> DataFrame:
    """Tasks with their instance's name; a task of an unknown instance has none."""
    return tasks.join(instances, "instance_id", "left")


def cursor_of(envelope: Column, event: Column) -> Column:
    """The code of an envelope whose cursor isn't that of its event."""
    return F.when(~envelope["cursor"].eqNullSafe(event["source_cursor"]), "source_representation.cursor_mismatch")


def snapshot_type_allowed(native: Column) -> Column:
    return F.regexp_extract(F.lower(native), r"^([a-z]+)", 1).isin(*SNAPSHOT_TYPES)


def generated_mismatches(rows: DataFrame, by: list[str], stored: Column, computed: Column) -> DataFrame:
    """How many rows hold what their generated column's expression gives, and how many don't."""
    same = stored.eqNullSafe(computed)
    return rows.groupBy(*by).agg(F.sum(same.cast("long")).alias("matched"), F.sum((~same).cast("long")).alias("mismatched"))


def presences(rows: DataFrame, by: list[str], presence: str = "presence") -> DataFrame:
    """Counts of the presences of a column."""
    n = lambda p: F.sum((F.col(presence) == p).cast("long")).alias(f"n_{p}")
    return rows.groupBy(*by).agg(n("value"), n("unchanged"), n("unavailable"))


def progress(changes: DataFrame, task: str, tx: str, order: list[str]) -> DataFrame:
    """What each task has applied: transactions, rows and its last position. Transactions are counted before
    they are summed up, so a task's rows combine on both levels."""
    per = changes.groupBy(task, tx).agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct(*order)).alias("at"))
    out = per.groupBy(task).agg(F.count(F.lit(1)).alias("applied_transactions"), F.sum("rows").alias("applied_rows"), F.max("at").alias("at"))
    return out.select(task, "applied_transactions", "applied_rows", *(F.col(f"at.{o}").alias(o) for o in order))


def emptied(changes: DataFrame, tx: str, kept: Column, position: str) -> DataFrame:
    """How many transactions a filter leaves empty, and the last position that they are observed at."""
    per = changes.groupBy(tx).agg(F.max(position).alias("last"), F.max(kept.cast("int")).alias("kept"))
    return per.filter("kept = 0").agg(F.count(F.lit(1)).alias("emptied"), F.max("last").alias("observed"))
