"""SQL and diagnostic text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import decimal_text  # noqa: F401  (part of the rendering surface)


def quote_identifier(name: Column, dialect: str) -> Column:
    q = "`" if dialect == "mysql" else '"'
    return F.concat(F.lit(q), F.replace(name, F.lit(q), F.lit(q + q)), F.lit(q))


def quote_text(x: Column, dialect: str = "postgresql") -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\\\")) if dialect == "mysql" else x
    return F.coalesce(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def bytes_literal(x: Column, dialect: str) -> Column:
    return F.concat(F.lit("X'"), F.hex(x), F.lit("'")) if dialect == "mysql" else F.concat(F.lit("'\\x"), F.lower(F.hex(x)), F.lit("'::bytea"))


def insert(table: Column, columns: dict[str, Column], dialect: str) -> Column:
    """An INSERT; ``columns`` maps names to rendered values."""
    names = F.concat_ws(", ", *(quote_identifier(F.lit(c), dialect) for c in columns))
    return F.concat(F.lit("INSERT INTO "), table, F.lit(" ("), names, F.lit(") VALUES ("), F.concat_ws(", ", *columns.values()), F.lit(");"))


def locator(keys: dict[str, Column], nulls: dict[str, Column], dialect: str) -> Column:
    """A row locator: equal keys, IS NULL where a key is null; MySQL compares text by its bytes."""
    name = lambda k: quote_identifier(F.lit(k), dialect)
    left = (lambda k: F.concat(F.lit("BINARY "), name(k))) if dialect == "mysql" else name
    return F.concat_ws(" AND ", *(F.when(nulls[k], F.concat(name(k), F.lit(" IS NULL"))).otherwise(F.concat(left(k), F.lit(" = "), v)) for k, v in keys.items()))


def update(table: Column, columns: dict[str, Column], where: Column, dialect: str) -> Column:
    sets = F.concat_ws(", ", *(F.concat(quote_identifier(F.lit(c), dialect), F.lit(" = "), v) for c, v in columns.items()))
    return F.concat(F.lit("UPDATE "), table, F.lit(" SET "), sets, F.lit(" WHERE "), where, F.lit(";"))


def delete(table: Column, where: Column) -> Column:
    return F.concat(F.lit("DELETE FROM "), table, F.lit(" WHERE "), where, F.lit(";"))


def script(statements: Column) -> Column:
    """A diagnostic script around ordered statements."""
    return F.concat(F.lit("BEGIN;\n"), F.array_join(statements, "\n"), F.lit("\nCOMMIT;"))


def comment(x: Column) -> Column:
    """Text that can't leave a line comment."""
    return F.concat(F.lit("-- "), F.regexp_replace(x, r"[\x00-\x1F\x7F]", " "))


def cause(x: Column) -> Column:
    """A failure's cause: no control characters, at most 512 of them."""
    return F.substring(F.regexp_replace(x, r"\p{Cntrl}", " "), 1, 512)


def pg_array(items: Column) -> Column:
    """A PostgreSQL array literal of texts."""
    q = F.transform(items, lambda x: F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("NULL")))
    return F.concat(F.lit("{"), F.array_join(q, ","), F.lit("}"))


def pg_range(lower: Column, upper: Column, lower_inc: Column, upper_inc: Column, empty: Column) -> Column:
    body = F.concat(F.when(lower_inc, "[").otherwise("("), F.coalesce(lower, F.lit("")), F.lit(","), F.coalesce(upper, F.lit("")), F.when(upper_inc, "]").otherwise(")"))
    return F.when(empty, F.lit("empty")).otherwise(body)


def mysql_placeholder(kind: str, charset: str = "utf8mb4", srid: int = 0) -> str:
    """The placeholder of a bound value."""
    if kind == "text":
        return f"CONVERT(CAST(? AS BINARY) USING {charset})"
    return f"ST_GeomFromWKB(?, {srid})" if kind == "spatial" else "?"


def mysql_bound(x: Column, kind: str) -> Column:
    """A value as MySQL binds it: booleans as 0/1, instants as UTC datetimes, sets joined by commas."""
    if kind == "boolean":
        return x.cast("int").cast("string")
    if kind == "instant":
        return F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.array_join(x, ",") if kind == "set" else x.cast("string")
