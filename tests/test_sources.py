"""Decoders, catalogs, tasks and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_change_log import UUID, change, datum
from tidelog import cli, control, model
from tidelog.functions import values
from tidelog.operators import cursors
from tidelog.sources import catalog, decode
from tidelog.streaming.runner import Route

CATALOG = {"mood": {"kind": "enum", "labels": ["ok", "sad"]}, "positive": {"kind": "domain", "of": "integer"}, "address": {"kind": "composite", "fields": [("street", "text"), ("no", "integer")]}, "span": {"kind": "range", "of": "integer"}, "spans": {"kind": "multirange", "of": "integer"}}


@pytest.mark.parametrize(
    "name, text, want",
    [
        ("integer[]", '[0:1]={1,NULL}', {"dimensions": 1, "lower_bounds": [0], "dimension_lengths": [2]}),
        ("integer[]", "{{1,2},{3,4}}", {"dimensions": 2, "dimension_lengths": [2, 2]}),
        ("text[]", '{"a,b","NULL",NULL,""}', {"dimension_lengths": [4]}),
        ("integer[]", "{}", {"dimensions": 0, "elements": []}),
        ("address", '("Long ""A"" st",12)', {"type": "struct"}),
        ("address", '(,)', {"value": [{"name": "street", "value": {"type": "null"}}, {"name": "no", "value": {"type": "null"}}]}),
        ("span", "[1,5)", {"lower_inc": True, "upper_inc": False}),
        ("span", "empty", {"empty": True}),
        ("spans", "{[1,2),[4,)}", {"type": "multi_range"}),
        ("positive", "5", {"type": "domain"}),
        ("mood", "sad", {"value": "sad"}),
        ("timestamptz", "2024-01-02 03:04:05.5+01", {"seconds": 1704161045, "nanoseconds": 500000000}),
        ("timestamp", "0044-03-15 00:00:00 BC", {"year": -43}),
        ("date", "-infinity", {"type": "temporal_infinity", "negative": True}),
        ("interval", "P1Y2M3DT4H5M6.5S", {"months": 14, "days": 3, "microseconds": 14706500000}),
        ("numeric", "-0.50", {"unscaled": "-50", "scale": 2}),
        ("hstore", '"a"=>"b\\"c"', {"type": "map"}),
        ("money", "$1", {"type": "raw"}),
    ],
)
def test_pg_values(name, text, want):
    got = decode.pg_value(name, text, CATALOG)
    assert want.items() <= got.items()
    values.check(got)


def test_mysql_values():
    v = decode.mysql_value
    assert v("set('a','b','c')", 5)["value"] == ["a", "c"] and v("enum('x','y')", 2)["value"] == "y"
    assert v("date", "0000-00-00") == {"type": "invalid_temporal", "kind": "date", "raw": "0000-00-00"}
    assert v("time(3)", "-838:59:59.000")["hours"] == 838
    assert v("bit(9)", 257)["bytes"] == "AQE"
    assert v("int", None) == {"type": "null"}
    for bad in (("enum('x')", 2), ("set('a')", 2)):
        with pytest.raises(ValueError):
            v(*bad)


EVENTS = [
    {"kind": "ROTATE", "file": "binlog.000001"}, {"kind": "GTID", "gtid": f"{UUID}:1", "pos": 4}, {"kind": "QUERY", "sql": "BEGIN", "pos": 5},
    {"kind": "TABLE_MAP", "table_id": 7, "schema": "s", "table": "t", "columns": [{"name": "id", "type": "int", "key": 0}, {"name": "v", "type": "varchar(9)", "charset": "utf8mb4"}], "pos": 6},
    {"kind": "WRITE_ROWS", "table_id": 7, "rows": [{"after": [1, "a"]}, {"after": [2, None]}], "pos": 7}, {"kind": "XID", "pos": 9},
]


def test_binlog_decoder_over_batches():
    d, out = decode.Binlog(), []
    for e in EVENTS:
        out += d.feed(e)
        again = decode.Binlog()
        again.load(d.dump())
        d = again
    (tx,) = out
    assert (tx["id"], tx["begin"], tx["commit"]) == (f"{UUID}:1", ["binlog.000001", 4], ["binlog.000001", 9])
    assert [c["after"][1]["presence"] for c in tx["changes"]] == ["value", "null"]
    with pytest.raises(ValueError, match="partial"):
        d.feed(EVENTS[1]), d.feed(EVENTS[3]), d.feed(EVENTS[4] | {"rows": [{"after": [1]}]})
    with pytest.raises(ValueError, match="statement"):
        decode.Binlog().feed({"kind": "QUERY", "sql": "DROP TABLE t"})


def test_pgoutput_decoder():
    d = decode.PgOutput(CATALOG)
    cols = [{"name": "id", "type": "bigint", "key": 0}, {"name": "note", "type": "text"}]
    out = []
    for e in ({"kind": "Begin", "xid": 42, "lsn": 200}, {"kind": "Relation", "id": 1, "schema": "s", "name": "t", "columns": cols}, {"kind": "Update", "relation": 1, "new": ["1", {"unchanged": True}]}, {"kind": "Delete", "relation": 1, "old": ["1", None]}, {"kind": "Commit", "lsn": 200, "end_lsn": 210}):
        out += d.feed(e)
    (tx,) = out
    assert tx["id"] == "pg:42:0/C8" and [c["cursor"] for c in tx["changes"]] == [210, 210]
    assert [x["presence"] for x in tx["changes"][0]["before"]] == ["value", "unavailable"] and tx["changes"][0]["after"][1]["presence"] == "unchanged"
    with pytest.raises(ValueError, match="out of order"):
        d.feed({"kind": "Begin", "xid": 43, "lsn": 100})


def test_catalogs(spark):
    cols = spark.createDataFrame([("s", "t", "id", 1, "bigint", "NO", "", None), ("s", "t", "v", 2, "text", "YES", "", "utf8mb4_bin")], "table_schema string, table_name string, column_name string, ordinal_position int, column_type string, is_nullable string, generation_expression string, collation_name string")
    keys = spark.createDataFrame([("s", "t", "id", 1, "PRIMARY")], "table_schema string, table_name string, column_name string, ordinal_position int, constraint_name string")
    got = catalog.mysql_columns(cols, keys, "s", "t")
    assert [(r["name"], r["primary_key_ordinal"], r["nullable"]) for r in got.collect()] == [("id", 0, False), ("v", None, True)]
    other = got.withColumn("nullable", F.lit(False)).filter("name = 'v'")
    assert {(r["name"], r["rule_code"]) for r in catalog.pairs(got, other).collect()} == {("id", "target_column_missing"), ("v", "nullable_into_required")}
    types = spark.createDataFrame([(1,), (2,), (3,)], "oid int")
    ranges = spark.createDataFrame([(1, 2, 23)], "rngtypid int, rngmultitypid int, rngsubtype int")
    assert sorted((r["oid"], r["role"]) for r in catalog.ranges_of(types, ranges).fillna("").collect()) == [(1, "range"), (2, "multirange"), (3, "")]
    s = spark.createDataFrame([("a", "1"), ("connections", "5")], "name string, value string")
    assert catalog.fingerprint(s).first() == catalog.fingerprint(s.filter("name = 'a'")).first()


def test_tasks():
    t = control.TableMapping("s", "t")
    task = lambda i, **k: control.Task(i, "src", "dst", (t,), **k)
    m = control.Manager(lambda task: object(), {("s", "t"): ["id"]})
    m.add(task("a"))
    m.add(task("b"))
    assert m.start("a") == "running" and m.start("b") == "blocked" and "target_overlap" in m.failures[0]["cause"]
    with pytest.raises(ValueError):
        m.delete("a")
    m.failed("a", "conversion_failed", "bad\nvalue")
    assert m.tasks["a"].state == "blocked" and "\n" not in m.failures[-1]["cause"]
    m.tasks["a"].revise(tables=(control.TableMapping("s", "t", ("v",)),))
    assert m.tasks["a"].revision == 1 and m.start("a") == "blocked" and "selected_columns_lack_key" in m.failures[-1]["cause"]
    with pytest.raises(ValueError):
        m.stop("b")


def test_command_line_path(spark, tmp_path):
    at = lambda n: spark.range(1).select(cursors.mysql_encode(F.lit("binlog.000001"), F.lit(n))).first()[0]
    row = lambda i, v: [datum(0, "id", i, key=0), datum(1, "v", v)]
    out = []
    for n, (tx, c) in enumerate([("a", change("insert", after=row("1", "x"))), ("b", change("update", row("1", "x"), row("1", "y"))), ("c", change("insert", after=row("2", "z")))]):
        cur = {"format": "mysql", "value": at(100 * (n + 1)), "display": ""}
        head = lambda i: {"id": tx, "sequence": i, "begin_cursor": cur, "commit_cursor": cur}  # noqa: B023, E731
        for i, p in enumerate([{"type": "transaction_begin"}, c, {"type": "transaction_commit", "change_count": 1}]):
            out.append(json.dumps({"format": model.FORMAT, "source": {"kind": "mysql", "version": "8.0", "id": UUID}, "transaction": head(i), "payload": p}))
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.jsonl").write_text("\n".join(out) + "\n")
    for _ in range(2):  # the second run finds nothing new
        cli.main(["apply", str(tmp_path / "log"), str(tmp_path / "t"), "--schema", "s", "--table", "t", "--key", "id", "--columns", "v"])
    route = Route(spark, str(tmp_path / "t"), ["id"], ["v"])
    assert sorted(tuple(r) for r in route.table.read().select("id", "v").collect()) == [("1", "y"), ("2", "z")]
    assert route.checkpoint()["applied_transactions"] == 3
