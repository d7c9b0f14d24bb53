"""JSON Lines change logs: reading, format gate, end-of-input check, writing, following."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model

#: Fields each record may have at its top level and in its payload; others are denied.
_TOP = ["format", "source", "transaction", "payload"]
_PAYLOAD = ["type", "change_count", "database", "operation", "schema", "table", "source_cursor", "source_timestamp", "schema_basis", "before", "after"]


def _parsed(lines: DataFrame) -> DataFrame:
    # A datum's ``value`` is any JSON; the schema keeps it as its text.
    record = F.from_json("value", model.RECORD)
    unknown = F.size(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, _TOP)))) > 0
    unknown |= F.size(F.array_except(F.json_object_keys(F.get_json_object("value", "$.payload")), F.array(*map(F.lit, _PAYLOAD)))) > 0
    out = lines.select("*", record.alias("r"), F.coalesce(unknown, F.lit(True)).alias("unknown_fields"), F.octet_length("value").alias("bytes"))
    return out.select(*[c for c in lines.columns if c != "value"], "bytes", "unknown_fields", "r.*").withColumn("source", _source())


def _source() -> Column:
    s = F.col("source")
    return F.struct(s["kind"].alias("kind"), s["version"].alias("version"), F.coalesce(s["id"], s["server_uuid"]).alias("id"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A batch scan: the records with their file and physical order (``line_no``) within it.
    Order comes from the file's own offsets, never from the order of reading."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("within"))
    return _parsed(lines.filter("value != ''")).withColumn("line_no", F.struct("block", "within"))


def from_lines(lines: DataFrame) -> DataFrame:
    """Records of a frame with ``value`` (a JSON line) and ``line_no``."""
    return _parsed(lines)


def stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of complete lines from files that appear in a folder."""
    return _parsed(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).filter("value != ''"))


def format_supported() -> Column:
    """Whether a record's format may be read: the newest two from any source, older ones from MySQL."""
    f = F.col("format")
    return f.isin(*model.ANY_SOURCE_FORMATS) | (f.isin(*model.MYSQL_FORMATS) & (F.col("source.kind") == "mysql"))


def gate(log: DataFrame) -> DataFrame:
    """The log, failing on the first record whose format isn't supported or that has unknown fields."""
    bad = ~F.coalesce(format_supported(), F.lit(False)) | F.coalesce(F.col("unknown_fields"), F.lit(False))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("change_event.validation_failed: unsupported format or fields: "), F.coalesce("format", F.lit("?"))))).otherwise(F.col("format"))
    return log.withColumn("format", checked)


def unfinished(log: DataFrame) -> DataFrame:
    """Transactions without their commit at the end of the input."""
    per = log.groupBy(F.col("source.id").alias("source_id"), F.col("transaction.id").alias("transaction_id"))
    seen = per.agg(F.count(F.lit(1)).alias("records"), F.max((F.col("payload.type") == model.COMMIT).cast("int")).alias("done"))
    return seen.filter("done = 0").select("source_id", "transaction_id", "records")


def lines(transactions: DataFrame) -> DataFrame:
    """JSON lines of transactions (source, id, begin_cursor, commit_cursor, changes: array of
    payload structs): begin, a row for each change, commit; ``tx`` orders transactions."""
    n = F.size("changes")
    steps = F.concat(
        F.array(F.struct(F.lit(0).cast("long").alias("sequence"), F.lit(None).cast(model.PAYLOAD).alias("row"))),
        F.transform("changes", lambda c, i: F.struct((i + 1).cast("long").alias("sequence"), c.alias("row"))),
        F.array(F.struct((n + 1).cast("long").alias("sequence"), F.lit(None).cast(model.PAYLOAD).alias("row"))),
    )
    rows = transactions.select("*", n.cast("long").alias("n"), F.explode(steps).alias("step"))
    kind = F.when(F.col("step.sequence") == 0, model.BEGIN).when(F.col("step.sequence") > F.col("n"), model.COMMIT).otherwise(model.ROW)
    fields = {f.name: F.col(f"step.row.{f.name}") for f in model.PAYLOAD}
    fields |= {"type": kind, "change_count": F.when(kind == model.COMMIT, F.col("n"))}
    payload = F.struct(*(fields[f.name].alias(f.name) for f in model.PAYLOAD))
    head = F.struct(F.col("id"), F.col("step.sequence").alias("sequence"), F.col("begin_cursor"), F.col("commit_cursor"))
    record = F.struct(F.lit(model.FORMAT).alias("format"), F.col("source"), head.alias("transaction"), payload.alias("payload"))
    return rows.select("tx", F.col("step.sequence").alias("sequence"), F.to_json(record, {"ignoreNullFields": "true"}).alias("value"))


def write(transactions: DataFrame, path: str) -> None:
    """Writes transactions as JSON Lines; records of one transaction stay together and in order."""
    lines(transactions).repartition("tx").sortWithinPartitions("tx", "sequence").select("value").write.text(path)
