"""Row changes of one table as flat rows: what replay, strict checks and targets read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import codec
from . import cursors


def value_text(value: Column) -> Column:
    """The text of a scalar logical value given as JSON; the JSON itself for a structured one."""
    get = lambda k: F.get_json_object(value, f"$.{k}")
    kind, pad = get("type"), lambda k, n: F.lpad(get(k), n, "0")
    day = F.concat_ws("-", pad("year", 4), pad("month", 2), pad("day", 2))
    clock = F.concat(F.concat_ws(":", pad("hour", 2), pad("minute", 2), pad("second", 2)), F.when(get("microsecond").cast("int") > 0, F.concat(F.lit("."), pad("microsecond", 6))).otherwise(F.lit("")))
    # A text may come as bytes of its character set.
    raw = codec.from_base64url(get("bytes"))
    text = F.when(get("charset").isin("latin1", "ascii"), F.decode(raw, "ISO-8859-1")).otherwise(F.decode(raw, "UTF-8"))
    return (
        F.when((kind == "text") & get("value").isNull(), text)
        .when(kind.isin("text", "integer", "enum", "boolean", "uuid", "year", "binary", "xml", "invalid_temporal"), F.coalesce(get("value"), get("raw")))
        .when(kind == "decimal", F.when(get("unscaled").isin("NaN", "Infinity", "-Infinity"), get("unscaled")).otherwise(codec.decimal_text(get("unscaled"), get("scale").cast("int"))))
        .when(kind == "float", get("ieee754_hex"))
        .when(kind == "date", day)
        .when(kind == "local_datetime", F.concat(day, F.lit(" "), clock))
        .when(kind == "local_time", clock)
        .when(kind == "instant", F.concat(get("seconds"), F.lit("."), pad("nanoseconds", 9)))
        .when(kind == "set", F.array_join(F.from_json(get("value"), "array<string>"), ","))
        .when(kind == "json", get("value"))
        .otherwise(value)
    )


def position(source_kind: Column, cursor: Column) -> Column:
    """struct<prefix, file_no, pos>: where a cursor lies in its source's order. A PostgreSQL position is one number."""
    at = cursors.mysql_decode(cursor["value"])
    mysql = cursors.mysql_key(at["file"], at["position"])
    lsn = F.coalesce(F.when(cursor["value"].contains("/"), cursors.lsn_value(cursor["value"])), cursor["value"].try_cast("decimal(20,0)"))
    pg = F.struct(F.lit("").alias("prefix"), F.lit(0).cast("long").alias("file_no"), lsn.cast("long").alias("pos"))
    return F.when(source_kind == "postgresql", pg).otherwise(mysql)


def flat_changes(transactions: DataFrame, schema: str, table: str, key: list[str], columns: list[str]) -> DataFrame:
    """A row for each change of a table in whole transactions: tx_id, place, operation, the row's key, its key before the
    change (old_*), its values and their presences (presence_*)."""
    placed = transactions.withColumn("at", position(F.col("source.kind"), F.col("commit_cursor")))
    rows = placed.select(F.col("id").alias("tx_id"), "at", F.posexplode("changes").alias("i", "c"))
    rows = rows.filter((F.col("c.schema") == schema) & (F.col("c.table") == table))
    image = lambda name: F.coalesce(F.col(f"c.{name}"), F.array().cast(model.IMAGE))
    datum = lambda name, column: F.try_element_at(F.filter(image(name), lambda d: d["name"] == column), F.lit(1))
    text = lambda name, column: F.when(datum(name, column)["presence"] == "value", value_text(datum(name, column)["value"]))
    out = {"prefix": F.col("at.prefix"), "file_no": F.col("at.file_no"), "pos": F.col("at.pos"), "sequence": (F.col("i") + 1).cast("long"), "operation": F.col("c.operation")}
    for k in key:
        out[k], out[f"old_{k}"] = F.coalesce(text("after", k), text("before", k)), F.coalesce(text("before", k), text("after", k))
    for n in columns:
        out[n] = text("after", n)
        out[f"presence_{n}"] = F.when(F.col("c.operation") == "delete", "unavailable").otherwise(F.coalesce(datum("after", n)["presence"], F.lit("unchanged")))
    return rows.select("tx_id", *(v.alias(k) for k, v in out.items()))
