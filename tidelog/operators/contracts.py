"""What each source promises about its transactions, as violation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MYSQL_VERSIONS = ("5.7", "8.0", "8.4")
PG_VERSIONS = ("15", "16", "17")
_UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"

#: Which logical types a native type's first word may carry; fixed values.
MYSQL_TYPES = {
    "integer": ("tinyint", "smallint", "mediumint", "int", "integer", "bigint", "bool", "boolean"),
    "decimal": ("decimal", "numeric", "dec", "fixed"),
    "float": ("float", "double", "real"),
    "text": ("char", "varchar", "tinytext", "text", "mediumtext", "longtext"),
    "binary": ("binary", "varbinary", "tinyblob", "blob", "mediumblob", "longblob"),
    "bit_string": ("bit",),
    "date": ("date",),
    "local_datetime": ("datetime",),
    "instant": ("timestamp",),
    "duration": ("time",),
    "year": ("year",),
    "json": ("json",),
    "enum": ("enum",),
    "set": ("set",),
    "spatial": ("geometry", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon", "geometrycollection", "geomcollection"),
}
PG_TYPES = {
    "boolean": ("boolean", "bool"),
    "integer": ("smallint", "integer", "bigint", "int2", "int4", "int8", "oid", "xid", "cid", "xid8"),
    "decimal": ("numeric", "decimal"),
    "float": ("real", "double", "float4", "float8"),
    "text": ("text", "character", "varchar", "bpchar", "name", "char"),
    "binary": ("bytea",),
    "uuid": ("uuid",),
    "xml": ("xml",),
    "bit_string": ("bit", "varbit"),
    "date": ("date",),
    "json": ("json", "jsonb"),
    "network": ("inet", "cidr", "macaddr", "macaddr8"),
    "calendar_interval": ("interval",),
}


def native_agrees(native: Column, kind: Column, vendor: str) -> Column:
    """Whether a native type's declaration may carry a logical type; types without a rule may."""
    table = MYSQL_TYPES if vendor == "mysql" else PG_TYPES
    word = F.regexp_extract(F.lower(native), r"^([a-z0-9_]+)", 1)
    out = F.lit(True)
    for logical, names in table.items():
        out = F.when(word.isin(*names), kind.isin(logical, "null", "invalid_temporal", "temporal_infinity", "domain")).otherwise(out)
    return out


def mysql_identity(source: Column, tx_id: Column) -> Column:
    """Codes of what a MySQL transaction's identity breaks."""
    family = F.regexp_extract(source["version"], r"^(\d+\.\d+)", 1)
    gtid = tx_id.rlike(rf"^{_UUID}:[1-9]\d*$")
    tagged = tx_id.rlike(rf"^{_UUID}:[a-z_][a-z0-9_]{{0,31}}:[1-9]\d*$")
    anonymous = tx_id.rlike(r"^.+:\d+$") & ~tx_id.rlike(rf"^{_UUID}:")
    return F.array_compact(
        F.array(
            F.when(~family.isin(*MYSQL_VERSIONS), "version_unsupported"),
            F.when(~source["id"].rlike(rf"^{_UUID}$"), "server_uuid_invalid"),
            F.when(tagged & (family != "8.4"), "tagged_gtid_unsupported"),
            F.when(~(gtid | tagged | anonymous), "transaction_id_invalid"),
        )
    )


def pg_identity(source: Column, tx_id: Column) -> Column:
    major = F.regexp_extract(source["version"], r"^(\d+)", 1)
    return F.array_compact(F.array(F.when(~major.isin(*PG_VERSIONS), "version_unsupported"), F.when(~tx_id.rlike(r"^pg:\d+:[0-9A-F]{1,8}/[0-9A-F]{1,8}$"), "transaction_id_invalid")))


def position_violations(rows: DataFrame, tx: str, file: str, pos: str, begin: str, commit: str) -> DataFrame:
    """Rows out of place: all of a transaction lie in one file, behind its begin, each not before the
    last, and before its commit."""
    order = Window.partitionBy(tx).orderBy("sequence")
    first = F.first(file).over(order)  # the file of the row of least sequence
    codes = F.array_compact(
        F.array(
            F.when(F.col(file) != first, "file_changes"),
            F.when(F.col(pos) <= F.col(begin), "row_before_begin"),
            F.when(F.col(pos) < F.lag(pos).over(order), "row_goes_back"),
            F.when(F.col(pos) >= F.col(commit), "row_after_commit"),
        )
    )
    return rows.withColumn("codes", codes).select(*rows.columns, F.explode("codes").alias("rule_code"))


def full_image(image: Column) -> Column:
    """Whether an image is complete: ordinals 0..n-1 in order, and a key."""
    n = F.size(image)
    return (n > 0) & (F.transform(image, lambda d: d["ordinal"]) == F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)) & F.exists(image, lambda d: d["primary_key_ordinal"].isNotNull())


def synthesise_before(after: Column) -> Column:
    """The before-image of an update under default identity: keys as after, the rest unavailable."""
    return F.transform(after, lambda d: F.when(d["primary_key_ordinal"].isNotNull(), d).otherwise(d.withField("presence", F.lit("unavailable")).withField("value", F.lit(None).cast("string"))))


def at_commit(changes: Column, end_cursor: Column) -> Column:
    """Changes whose cursor is their transaction's end."""
    return F.transform(changes, lambda c: c.withField("source_cursor", end_cursor))
