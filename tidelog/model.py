"""Schemas and vocabularies of the change log."""

from __future__ import annotations

from pyspark.sql import types as T

CURSOR = T.StructType([T.StructField(n, T.StringType()) for n in ("format", "value", "display")])
DATUM = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("native_type", T.StringType()),
        T.StructField("primary_key_ordinal", T.LongType()),
        T.StructField("generated", T.BooleanType()),
        T.StructField("collation", T.StringType()),
        T.StructField("presence", T.StringType()),
        T.StructField("value", T.StringType()),  # a logical value as JSON
    ]
)
IMAGE = T.ArrayType(DATUM)
SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "version", "id", "server_uuid")])
TRANSACTION = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("begin_cursor", CURSOR), T.StructField("commit_cursor", CURSOR)]
)
PAYLOAD = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("change_count", T.LongType()),
        *(T.StructField(n, T.StringType()) for n in ("database", "operation", "schema", "table")),
        T.StructField("source_cursor", CURSOR),
        T.StructField("source_timestamp", T.LongType()),
        T.StructField("schema_basis", T.StringType()),
        T.StructField("before", IMAGE),
        T.StructField("after", IMAGE),
    ]
)
RECORD = T.StructType([T.StructField("format", T.StringType()), T.StructField("source", SOURCE), T.StructField("transaction", TRANSACTION), T.StructField("payload", PAYLOAD)])

#: Fixed values of the contract.
FORMAT = "cdc.change-event-json.v0.3"
ANY_SOURCE_FORMATS = (FORMAT, "cdc.change-event-json.v0.2")
MYSQL_FORMATS = ("cdc.change-event-json.v0.1", "cdc.change-event-json.v0")
OPERATIONS = ("insert", "update", "delete")
PRESENCES = ("unavailable", "unchanged", "null", "value", "source_representation_envelope")
BEGIN, ROW, COMMIT = "transaction_begin", "row_change", "transaction_commit"
MAX_TRANSACTION_BYTES = 64 * 1024 * 1024
MAX_ROWS = 100_000
PAGE_ROWS = 256
