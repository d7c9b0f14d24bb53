"""Recorded protocol events as streaming sources.

No database is reachable from here; the sources read recordings: folders of JSON Lines, a protocol
event each, named so that their order is the source's. Offsets are cursors (file and line),
and what a query committed is acknowledged in the recording folder's place of a replication slot.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, line long, kind string, body string"
#: Events that the decoders know, and those that stop a capture; fixed values.
BINLOG = ("ROTATE", "FORMAT_DESCRIPTION", "PREVIOUS_GTIDS", "GTID", "ANONYMOUS_GTID", "QUERY", "TABLE_MAP", "WRITE_ROWS", "UPDATE_ROWS", "DELETE_ROWS", "XID", "HEARTBEAT", "ROWS_QUERY", "STOP")
BINLOG_REFUSED = ("XA_PREPARE", "TRANSACTION_PAYLOAD", "PARTIAL_UPDATE_ROWS", "GTID_TAGGED")
PGOUTPUT = ("Begin", "Commit", "Relation", "Type", "Origin", "Insert", "Update", "Delete")
PGOUTPUT_REFUSED = ("Truncate", "StreamStart", "Message")


class _Part(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict, known: tuple[str, ...], refused: tuple[str, ...]):
        self.root, self.known, self.refused = options["path"], known, refused
        self.per_batch = int(options.get("maxEventsPerTrigger", 100_000))
        self.start = options.get("start")

    def _sizes(self) -> list[tuple[str, int]]:
        out = []
        for name in sorted(os.listdir(self.root)):
            if not name.startswith((".", "_")):
                with open(os.path.join(self.root, name), "rb") as f:
                    out.append((name, f.read().count(b"\n")))  # a last line without its end isn't complete
        return out

    def initialOffset(self) -> dict:
        if self.start:
            file, line = self.start.rsplit(":", 1)
            return {"file": file, "line": int(line)}
        return {"file": "", "line": 0}

    def latestOffset(self) -> dict:
        sizes = self._sizes()
        return {"file": sizes[-1][0], "line": sizes[-1][1]} if sizes else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        out = []
        for name, n in self._sizes():
            if start["file"] <= name <= end["file"]:
                first = start["line"] if name == start["file"] else 0
                last = end["line"] if name == end["file"] else n
                if last > first:
                    out.append(_Part(name, first, last))
        return out

    def read(self, part: _Part) -> Iterator[tuple]:
        with open(os.path.join(self.root, part.path)) as f:
            for i, line in enumerate(f):
                if i >= part.last:
                    break
                if i >= part.first:
                    kind = json.loads(line)["kind"]
                    if kind not in self.known:
                        raise ValueError(f"source_contract.invalid: {'refused' if kind in self.refused else 'unknown'} event {kind}")
                    yield part.path, i, kind, line.rstrip("\n")

    def commit(self, end: dict) -> None:
        """Acknowledges a position; it never goes back."""
        path = os.path.join(self.root, "_acknowledged")
        done = json.loads(open(path).read()) if os.path.exists(path) else {"file": "", "line": 0}
        if (end["file"], end["line"]) > (done["file"], done["line"]):
            with open(path + ".new", "w") as f:
                json.dump(end, f)
            os.replace(path + ".new", path)


class BinlogRecording(DataSource):
    """``spark.readStream.format("tidelog-binlog").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "tidelog-binlog"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options, BINLOG, BINLOG_REFUSED)


class PgOutputRecording(DataSource):
    """``spark.readStream.format("tidelog-pgoutput").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "tidelog-pgoutput"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options, PGOUTPUT, PGOUTPUT_REFUSED)


def register(spark) -> None:
    spark.dataSource.register(BinlogRecording)
    spark.dataSource.register(PgOutputRecording)


def start_position(explicit: str | None, gtid_enabled: bool, gtid_set: str | None, current: str) -> tuple[str, str]:
    """Where a capture starts: the explicit position, else the executed ids, else the current position."""
    if explicit:
        return "position", explicit
    return ("gtid", gtid_set) if gtid_enabled and gtid_set is not None else ("position", current)
