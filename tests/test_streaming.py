"""Streams, commits and recordings."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_change_log import ROW, change, log
from tidelog.sources import jsonl, protocol
from tidelog.storage import VersionedTable, resolve_commit
from tidelog.streaming import runner

SCHEMA = "tx_id long, file_no long, pos long, sequence long, operation string, id long, v string"


def batch(spark, *rows):
    return spark.createDataFrame([(t, 1, p, 1, op, i, v) for t, p, op, i, v in rows], SCHEMA)


def test_route_applies_once_and_counts(spark, tmp_path):
    route = runner.Route(spark, str(tmp_path / "t"), ["id"], ["v"])
    first = batch(spark, (1, 10, "insert", 1, "a"), (2, 20, "insert", 2, "b"))
    assert route.apply(first) == "applied" and route.apply(first) == "already_applied"
    assert route.apply(batch(spark, (2, 20, "insert", 2, "b"), (3, 30, "delete", 1, None))) == "applied"
    assert [tuple(r) for r in route.table.read().select("id", "v").collect()] == [(2, "b")]
    cp = route.checkpoint()
    assert (cp["cursor"], cp["applied_transactions"], cp["applied_rows"], cp["revision"]) == ([1, 30], 3, 3, 2)
    assert route.resolve("3", (1, 30)) == "APPLIED" and route.resolve("9", (1, 30)) == "UNPROVABLE" and route.resolve("9", (1, 40)) == "NOT_APPLIED"
    with pytest.raises(ValueError, match="duplicate_key"):
        route.apply(batch(spark, (4, 40, "insert", 2, "x")))
    assert route.checkpoint() == cp


def test_commit_conflict_leaves_the_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(spark.range(2).toDF("id"), {"n": 0}, None)
    with pytest.raises(RuntimeError, match="checkpoint_conflict"):
        t.commit(spark.range(9).toDF("id"), {"n": 1}, None)
    assert t.read().count() == 2 and t.manifest()["checkpoint"] == {"n": 0}
    assert resolve_commit(None, "a", "c", False) == "NOT_APPLIED"


def test_retries_wait_and_give_up():
    waits, turns = [], []

    def step():
        turns.append(1)
        raise ConnectionError

    with pytest.raises(ConnectionError):
        runner.with_retries(step, lambda e: "connection_failed", sleep=waits.append)
    assert len(turns) == 4 and waits == [0.1, 0.2, 0.4]
    turns.clear()
    with pytest.raises(ConnectionError):
        runner.with_retries(step, lambda e: "sql_error", sleep=waits.append)
    assert len(turns) == 1


def test_stream_assembly_survives_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()

    def run():
        stream = runner.assemble_stream(jsonl.stream(spark, str(tmp_path / "in")), F.col("transaction.id"))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["transaction_id"], r["change_count"], len(json.loads(r["records"]))) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    lines = [v for _, _, v in log("a", [change("insert", after=ROW), change("delete", before=ROW)]) + log("b", [change("insert", after=ROW)])]
    (tmp_path / "in" / "1.jsonl").write_text("\n".join(lines[:5]) + "\n")
    assert run() == [("a", 2, 2)]
    (tmp_path / "in" / "2.jsonl").write_text("\n".join(lines[5:]) + "\n")
    assert run() == [("a", 2, 2), ("b", 1, 1)]


def test_recordings_resume_and_refuse(spark, tmp_path):
    protocol.register(spark)
    root = tmp_path / "rec"
    root.mkdir()
    (root / "binlog.000001").write_text('{"kind":"GTID"}\n{"kind":"XID"}\n{"kind":"QUE')
    run = lambda: spark.readStream.format("tidelog-binlog").load(str(root)).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    (root / "binlog.000001").write_text('{"kind":"GTID"}\n{"kind":"XID"}\n{"kind":"QUERY"}\n')
    run()
    assert sorted(r["line"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [0, 1, 2]
    with open(root / "binlog.000001", "a") as f:
        f.write('{"kind":"XA_PREPARE"}\n')
    with pytest.raises(Exception, match="refused event XA_PREPARE"):
        run()
    assert protocol.start_position(None, True, "u:1-5", "f:4") == ("gtid", "u:1-5")
