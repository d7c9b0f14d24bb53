"""Routes: tables, columns, presence and row locators of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESERVED = ("mysql", "sys", "information_schema", "performance_schema", "cdc")


def project(transactions: DataFrame, routes: dict[tuple[str, str], list[str] | None]) -> DataFrame:
    """Keeps mapped tables, and of their images the listed columns (None: all). A transaction
    whose changes all go stays, empty, so that its position still counts."""
    if not routes:
        return transactions.withColumn("changes", F.slice("changes", 1, 0))
    of = lambda c, s, t: (c["schema"] == s) & (c["table"] == t)

    def image(c: Column, name: str) -> Column:
        out = c[name]
        for (s, t), columns in routes.items():
            if columns is not None:
                out = F.when(of(c, s, t), F.filter(c[name], lambda d: d["name"].isin(*columns))).otherwise(out)  # noqa: B023
        return out

    def kept(c: Column) -> Column:
        cond = F.lit(False)
        for s, t in routes:
            cond |= of(c, s, t)
        return cond

    changes = F.transform(F.filter("changes", kept), lambda c: c.withField("before", image(c, "before")).withField("after", image(c, "after")))
    return transactions.withColumn("changes", changes)


def capture_scope(log: DataFrame, tables: list[tuple[str, str]]) -> DataFrame:
    """Rows of the captured tables and all transaction marks; filters before images are touched."""
    cond = F.col("payload.table").isNull()
    for s, t in tables:
        cond |= (F.col("payload.schema") == s) & (F.col("payload.table") == t)
    return log.filter(cond)


def writable(image: Column) -> Column:
    """The columns of an image that may be written."""
    return F.filter(image, lambda d: ~F.coalesce(d["generated"], F.lit(False)) & ~d["presence"].isin("unavailable", "unchanged"))


def locator(image: Column) -> Column:
    """Primary-key data of an image in key order."""
    keys = F.filter(image, lambda d: d["primary_key_ordinal"].isNotNull())
    return F.transform(F.array_sort(F.transform(keys, lambda d: F.struct(d["primary_key_ordinal"].alias("o"), d.alias("d")))), lambda s: s["d"])


def keys_covered(selected: list[str], key: list[str]) -> list[str]:
    """Key columns that a selection lacks; a scan needs them all."""
    return [k for k in key if k not in selected]


def locator_probe(changes: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """For each change how many target rows its locator finds: none, one or many. The target is
    counted for each key before the join, so no change meets more than one row."""
    found = target.groupBy(*on).agg(F.count(F.lit(1)).alias("matches"))
    n = F.coalesce("matches", F.lit(0))
    return changes.join(found, on, "left").withColumn("matches", n.cast("long")).withColumn("verdict", F.when(n == 0, "missing").when(n == 1, "one").otherwise("many"))


def overlapping(tasks: DataFrame, task: str, sink: list[str]) -> DataFrame:
    """Pairs of tasks that write one sink table, each pair once, by an equi-join on the sink."""
    a, b = tasks.select(F.col(task).alias("first_task"), *sink), tasks.select(F.col(task).alias("second_task"), *sink)
    return a.join(b, sink).filter("first_task < second_task")


def allowed_schema(name: Column) -> Column:
    return ~F.lower(name).isin(*RESERVED)


def publication_eligible(relkind: Column, persistence: Column, has_key: Column, row_security: Column, row_filter: Column, column_list: Column, identity: Column) -> Column:
    """Ordinary permanent keyed tables without row security, filters or column lists, identity d or f."""
    return (relkind == "r") & (persistence == "p") & has_key & ~row_security & row_filter.isNull() & column_list.isNull() & identity.isin("d", "f")
