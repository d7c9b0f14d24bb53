"""Source positions: parsing, order, transaction-id sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mysql_encode(file: Column, position: Column) -> Column:
    """base64url of file, NUL and the position as four big-endian bytes, without padding."""
    raw = F.concat(F.encode(file, "UTF-8"), F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(position.cast("long")), 8, "0")))
    return F.rtrim(F.translate(F.base64(raw), "+/=", "-_ "))


def mysql_decode(value: Column) -> Column:
    """struct<file, position> of an encoded position."""
    padded = F.rpad(F.translate(value, "-_", "+/"), ((F.length(value) + 3) / 4).cast("int") * 4, "=")
    raw = F.unbase64(padded)
    n = F.octet_length(raw)
    return F.struct(F.decode(raw.substr(F.lit(1), n - 5), "UTF-8").alias("file"), F.conv(F.hex(raw.substr(n - 3, F.lit(4))), 16, 10).cast("long").alias("position"))


def mysql_key(file: Column, position: Column) -> Column:
    """A sortable key: file prefix, file number, position."""
    return F.struct(F.regexp_extract(file, r"^(.*?)(\d+)$", 1).alias("prefix"), F.regexp_extract(file, r"(\d+)$", 1).cast("long").alias("file_no"), position.cast("long").alias("pos"))


def lsn_value(text: Column) -> Column:
    """The number behind X/Y: two hexadecimal halves of 32 bits."""
    half = lambda i: F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast("decimal(20,0)")
    return (half(1) * F.lit(4294967296).cast("decimal(11,0)") + half(2)).cast("decimal(20,0)")


def lsn_text(high: Column, low: Column) -> Column:
    return F.concat_ws("/", F.hex(high), F.hex(low))


def gtid_islands(ids: DataFrame, source: str, number: str) -> DataFrame:
    """Merged intervals of transaction numbers of each source. Ends are found by joins on the
    neighbouring number; only they, not all numbers, are then put in order."""
    n = ids.select(source, F.col(number).cast("long").alias("gno")).distinct()
    starts = n.join(n.select(source, (F.col("gno") + 1).alias("gno")), [source, "gno"], "left_anti").select(source, "gno", F.lit(0).alias("last"))
    ends = n.join(n.select(source, (F.col("gno") - 1).alias("gno")), [source, "gno"], "left_anti").select(source, "gno", F.lit(1).alias("last"))
    w = Window.partitionBy(source).orderBy("gno", "last")
    paired = starts.union(ends).withColumn("interval_end", F.lead("gno").over(w)).filter("last = 0")
    return paired.select(source, F.col("gno").alias("interval_start"), "interval_end")


def gtid_text(islands: DataFrame, source: str) -> DataFrame:
    """The canonical text of each source's set: uuid:a-b:c."""
    part = F.when(F.col("interval_start") == F.col("interval_end"), F.col("interval_start").cast("string")).otherwise(F.concat_ws("-", "interval_start", "interval_end"))
    per = islands.groupBy(source).agg(F.array_sort(F.collect_list(F.struct("interval_start", part.alias("t")))).alias("p"))
    return per.select(source, F.concat_ws(":", F.col(source), F.array_join(F.transform("p", lambda x: x["t"]), ":")).alias("gtid_set"))


def contained(ids: DataFrame, intervals: DataFrame, source: str, number: str, block: int = 4096) -> DataFrame:
    """Rows of ids whose number lies in an interval of their source. Intervals are cut at blocks of
    numbers, so the range join is an equi-join on the block with a filter."""
    cut = intervals.select(source, "interval_start", "interval_end", F.explode(F.sequence(F.floor(F.col("interval_start") / block), F.floor(F.col("interval_end") / block))).alias("block"))
    return ids.withColumn("block", F.floor(F.col(number) / block)).join(cut, [source, "block"]).filter(F.col(number).between(F.col("interval_start"), F.col("interval_end"))).drop("block", "interval_start", "interval_end")


def beyond(changes: DataFrame, checkpoint: tuple[int, int], file_no: str = "file_no", pos: str = "pos") -> DataFrame:
    """Changes behind a checkpoint's position; all others are applied already."""
    f, p = checkpoint
    return changes.filter((F.col(file_no) > f) | ((F.col(file_no) == f) & (F.col(pos) > p)))
