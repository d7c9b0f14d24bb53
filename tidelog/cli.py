"""Command line: apply a change log to a target, or follow a recording into a change log.

python -m tidelog.cli apply LOG TARGET --schema s --table t --key id --columns name,value [--follow]
python -m tidelog.cli capture RECORDING LOG --source ID [--version 8.0.36] [--follow]
python -m tidelog.cli pg-tail RECORDING LOG --source ID [--version 16.2] [--follow]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .sources import decode, jsonl, protocol
from .streaming.runner import Route

STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def records(decoded: DataFrame, kind: str, version: str) -> DataFrame:
    """JSON lines of decoded transactions, one text for each transaction so that its records stay together."""

    def run(batches):
        import pandas as pd

        for rows in batches:
            yield pd.DataFrame({"value": [lines(json.loads(b), kind, version, s) for b, s in zip(rows["body"], rows["source_id"], strict=True)]})

    return decoded.mapInPandas(run, "value string")


def cursor(kind: str, at) -> dict:
    """A position in the form of a record."""
    import base64

    if kind == "mysql":
        raw = at[0].encode() + b"\0" + int(at[1]).to_bytes(4, "big")
        return {"format": "mysql_binlog", "value": base64.urlsafe_b64encode(raw).decode().rstrip("="), "display": f"{at[0]}:{at[1]}"}
    text = f"{at >> 32:X}/{at & 0xFFFFFFFF:X}"
    return {"format": "postgresql_lsn", "value": text, "display": text}


def lines(tx: dict, kind: str, version: str, source: str) -> str:
    """The records of a transaction: begin, its changes, commit."""
    end = cursor(kind, tx["commit"])
    begin = end if kind == "postgresql" else cursor(kind, tx["begin"])
    out = [{"type": model.BEGIN}]
    for c in tx["changes"]:
        images = {n: None if c[n] is None else [d | {"value": None if d["value"] is None else json.dumps(d["value"])} for d in c[n]] for n in ("before", "after")}
        out.append({"type": model.ROW, "operation": c["operation"], "schema": c["schema"], "table": c["table"], "source_cursor": cursor(kind, c["cursor"]), "schema_basis": "table_map" if kind == "mysql" else "relation", **images})
    out.append({"type": model.COMMIT, "change_count": len(tx["changes"])})
    head = {"format": model.FORMAT, "source": {"kind": kind, "version": version, "id": source}}
    return "\n".join(json.dumps(head | {"transaction": {"id": tx["id"], "sequence": i, "begin_cursor": begin, "commit_cursor": end}, "payload": p}, ensure_ascii=False) for i, p in enumerate(out))


def capture(spark: SparkSession, recording: str, log: str, kind: str, source: str, version: str, follow: bool = False):
    """A streaming query from a recording of protocol events to a folder of change records."""
    protocol.register(spark)
    events = spark.readStream.format("tidelog-binlog" if kind == "mysql" else "tidelog-pgoutput").load(recording)
    make = (lambda: decode.Binlog(version)) if kind == "mysql" else decode.PgOutput
    decoded = decode.decode_stream(events.withColumn("source_id", F.lit(source)), make)
    writer = records(decoded, kind, version).writeStream.format("text").option("path", log).option("checkpointLocation", f"{log}/_capture").outputMode("append")
    return (writer.trigger(processingTime="250 milliseconds") if follow else writer.trigger(availableNow=True)).start()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidelog")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("apply", help="apply a folder of JSON Lines to a versioned target")
    a.add_argument("log")
    a.add_argument("target")
    for name in ("--schema", "--table", "--key", "--columns"):
        a.add_argument(name, required=True)
    a.add_argument("--follow", action="store_true")
    for name, version in (("capture", "8.0.36"), ("pg-tail", "16.2")):
        c = sub.add_parser(name, help="follow a recording of protocol events into a folder of JSON Lines")
        c.add_argument("recording")
        c.add_argument("log")
        c.add_argument("--source", required=True)
        c.add_argument("--version", default=version)
        c.add_argument("--follow", action="store_true")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("tidelog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE)
    if args.command != "apply":
        capture(spark, args.recording, args.log, "mysql" if args.command == "capture" else "postgresql", args.source, args.version, args.follow).awaitTermination()
        return
    route = Route(spark, args.target, args.key.split(","), args.columns.split(","))
    log = jsonl.gate(jsonl.stream(spark, args.log))
    route.start_log(log, args.schema, args.table, f"{args.target}/stream", args.follow).awaitTermination()
    route.stop()


if __name__ == "__main__":
    main()
