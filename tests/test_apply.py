"""Whole transactions into a target: unchanged columns, split deliveries, moved keys, the command line."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_change_log import UUID
from tidelog import cli, model
from tidelog.operators import apply
from tidelog.sources import decode
from tidelog.streaming.runner import Route

FLAT = "tx_id string, file_no long, pos long, sequence long, operation string, id string, old_id string, v string, presence_v string, w string, presence_w string"


def rows(spark, *changes):
    """(tx, pos, sequence, operation, old key, key, v, w); "=" is an unchanged value."""
    out = []
    for tx, pos, seq, op, old, new, v, w in changes:
        there = lambda x: "unavailable" if op == "delete" else "unchanged" if x == "=" else "null" if x is None else "value"  # noqa: B023, E731
        out.append((tx, 1, pos, seq, op, new, old, None if v == "=" else v, there(v), None if w == "=" else w, there(w)))
    return spark.createDataFrame(out, FLAT)


def route(spark, path, **more):
    return Route(spark, str(path / "t"), ["id"], ["v", "w"], buckets=8, **more)


def held(r):
    return sorted(tuple(x) for x in r.table.read().select("id", "v", "w").collect())


def test_unchanged_columns_keep_their_value(spark, tmp_path):
    r = route(spark, tmp_path)
    r.apply(rows(spark, ("a", 10, 1, "insert", "1", "1", "x", "keep"), ("a", 10, 2, "insert", "2", "2", "p", None)))
    r.apply(rows(spark, ("b", 20, 1, "update", "1", "1", "y", "="), ("b", 20, 2, "update", "2", "2", "=", "q"), ("b", 20, 3, "update", "2", "2", "=", "=")))
    assert held(r) == [("1", "y", "keep"), ("2", "p", "q")]
    r.apply(rows(spark, ("c", 30, 1, "update", "1", "1", None, "="), ("c", 30, 2, "delete", "2", "2", None, None), ("c", 30, 3, "insert", "2", "2", "n", None), ("c", 30, 4, "update", "2", "2", "=", "=")))
    assert held(r) == [("1", None, "keep"), ("2", "n", None)]


def test_a_transaction_in_parts_is_refused(spark, tmp_path):
    r = route(spark, tmp_path)
    first = rows(spark, ("a", 10, 1, "insert", "1", "1", "x", "x"))
    r.apply(first)
    with pytest.raises(ValueError, match="came in parts"):
        r.apply(rows(spark, ("a", 10, 2, "insert", "2", "2", "y", "y")))
    assert r.apply(first) == "already_applied" and held(r) == [("1", "x", "x")]
    with pytest.raises(ValueError, match="another name"):
        r.apply(rows(spark, ("b", 20, 1, "insert", "3", "3", "x", "x")).withColumn("prefix", F.lit("other.")))


def test_rows_move_to_other_keys(spark, tmp_path):
    r = route(spark, tmp_path)
    r.apply(rows(spark, ("a", 10, 1, "insert", "1", "1", "one", "w1"), ("a", 10, 2, "insert", "2", "2", "two", "w2"), ("a", 10, 3, "insert", "9", "9", "nine", "w9")))
    # 1 -> 3 -> 4, 2 -> 1, and then another row with key 2.
    r.apply(rows(spark, ("b", 20, 1, "update", "1", "3", "=", "="), ("b", 20, 2, "update", "2", "1", "TWO", "="), ("b", 20, 3, "insert", "2", "2", "new", None), ("b", 20, 4, "update", "3", "4", "=", "W1"), ("b", 20, 5, "update", "9", "9", "=", "W9")))
    assert held(r) == [("1", "TWO", "w2"), ("2", "new", None), ("4", "one", "W1"), ("9", "nine", "W9")]
    before = r.checkpoint()
    for bad, code in ((("c", 30, 1, "update", "1", "4", "=", "="), "duplicate_key"), (("c", 30, 1, "update", "7", "8", "=", "="), "missing_row"), (("c", 30, 1, "update", "7", "7", "=", "="), "missing_row")):
        with pytest.raises(ValueError, match=code):
            r.apply(rows(spark, bad))
    assert r.checkpoint() == before


def test_moves_equal_a_plain_replay(spark, tmp_path):
    import random

    n, state, r, pos = random.Random(3), {}, route(spark, tmp_path, strict=False), 0
    for _ in range(3):
        batch = []
        for _ in range(60):
            pos += 10
            keys = sorted(state)
            op = n.choice(["insert", "update", "update", "delete"]) if keys else "insert"
            free = [k for k in map(str, range(12)) if k not in state]
            if op == "insert" and not free:
                op = "delete"
            old = n.choice(free if op == "insert" else keys)
            new = n.choice([old, *free]) if op == "update" else old
            v, w = (n.choice(["=", None, "a", "b"]) if op == "update" else n.choice([None, "c"]) for _ in range(2))
            row = state.pop(old, (None, None))
            if op != "delete":
                state[new] = (row[0] if v == "=" else v, row[1] if w == "=" else w)
            batch.append((str(pos), pos, 1, op, old, new, v, w))
        r.apply(rows(spark, *batch))
        assert held(r) == sorted((k, *x) for k, x in state.items())


def test_only_changed_buckets_are_written(spark, tmp_path):
    r = route(spark, tmp_path)
    r.apply(rows(spark, *[("a", 10, i + 1, "insert", str(i), str(i), "x", "x") for i in range(60)]))
    before = r.table.manifest()["folders"]
    for turn in range(5):
        r.apply(rows(spark, ("b", 20 + turn, 1, "update", "7", "7", str(turn), "=")))
    after = r.table.manifest()["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert len(held(r)) == 60 and ("7", "4", "x") in held(r)
    folders = {f.name for f in (tmp_path / "t").iterdir() if f.name.startswith("v=")}
    assert set(after.values()) <= folders and len(folders) <= 4  # those of the last three manifests
    assert len(list((tmp_path / "t" / "manifests").glob("*.json"))) == 3


def test_components_of_keys(spark):
    moves = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "c"), ("x", "y"), *[(f"k{i:03}", f"k{i + 1:03}") for i in range(40)]], "a string, b string")
    got = {r["node"]: r["component"] for r in apply.components_of(moves).collect()}
    assert {got[x] for x in "abcd"} == {"a"} and got["y"] == "x" and {got[f"k{i:03}"] for i in range(41)} == {"k000"}


def value(kind, **more):
    return json.dumps({"type": kind, **more})


CANONICAL = [  # name, native type, key, value of the insert, value after the update
    ("id", "bigint", 0, value("integer", signed=True, bits=64, value="1"), value("integer", signed=True, bits=64, value="2")),
    ("tenant", "int", 1, value("integer", signed=True, bits=32, value="7"), None),
    ("message", "varchar(255)", None, value("text", value="中文'\\"), value("text", value="updated")),
    ("amount", "decimal(30,6)", None, value("decimal", unscaled="12345678901234567890123456", scale=6), value("decimal", unscaled="-123456", scale=6)),
    ("ratio", "double", None, value("float", bits=64, ieee754_hex="3ff8000000000000"), None),
    ("bytes", "varbinary(32)", None, value("binary", value="AP8"), None),
    ("birthday", "date", None, value("date", year=2026, month=9, day=14), None),
    ("changed_at", "datetime(6)", None, value("local_datetime", year=2026, month=9, day=14, hour=1, minute=2, second=3, microsecond=123456), None),
    ("published_at", "timestamp(6)", None, value("instant", seconds=1700000000, nanoseconds=123456000), None),
    ("payload", "json", None, value("json", value={"type": "object", "value": []}), None),
]


def canonical(upto=3, kind="mysql"):
    """Insert, update with another key, delete: whole, or up to some change."""
    image = lambda after, gap=False: [
        {"ordinal": i, "name": n, "native_type": t, "primary_key_ordinal": k, "generated": False, "presence": "unchanged" if gap and i > 2 and new is None else "value", "value": None if gap and i > 2 and new is None else new if after and new else old}
        for i, (n, t, k, old, new) in enumerate(CANONICAL)
    ]
    at = lambda n: cli.cursor(kind, ["binlog.000001", n] if kind == "mysql" else n)
    c = lambda op, before, after, n: {"type": model.ROW, "operation": op, "schema": "shop", "table": "matrix", "source_cursor": at(n), "schema_basis": "catalog", "before": before, "after": after}
    changes = [c("insert", None, image(False), 110), c("update", image(False), image(True, True), 120), c("delete", image(True), None, 130)][:upto]
    payloads = [{"type": model.BEGIN}, *changes, {"type": model.COMMIT, "change_count": len(changes)}]
    source = {"kind": kind, "version": "8.0.36" if kind == "mysql" else "16.2", "id": UUID}
    tx = f"{UUID}:42" if kind == "mysql" else "pg:42:0/C8"
    return [json.dumps({"format": model.FORMAT, "source": source, "transaction": {"id": tx, "sequence": i, "begin_cursor": at(100), "commit_cursor": at(200)}, "payload": p}) for i, p in enumerate(payloads)]


@pytest.mark.parametrize("kind", ["mysql", "postgresql"])
def test_the_canonical_transaction_through_the_command_line(spark, tmp_path, kind):
    (tmp_path / "log").mkdir()
    columns = [n for n, *_ in CANONICAL[2:]]
    run = lambda: cli.main(["apply", str(tmp_path / "log"), str(tmp_path / "t"), "--schema", "shop", "--table", "matrix", "--key", "id,tenant", "--columns", ",".join(columns)])
    lines = canonical(2, kind)
    (tmp_path / "log" / "1.jsonl").write_text("\n".join(lines[:2]) + "\n")  # a transaction that isn't committed yet
    run()
    r = Route(spark, str(tmp_path / "t"), ["id", "tenant"], columns)
    assert r.table.manifest() is None
    (tmp_path / "log" / "2.jsonl").write_text("\n".join(lines[2:]) + "\n")
    run()
    run()
    (row,) = r.table.read().collect()
    assert (row["id"], row["tenant"], row["message"], row["amount"], row["ratio"], row["bytes"]) == ("2", "7", "updated", "-0.123456", "3ff8000000000000", "AP8")
    assert (row["birthday"], row["changed_at"], row["published_at"]) == ("2026-09-14", "2026-09-14 01:02:03.123456", "1700000000.123456000")
    cp = r.checkpoint()
    assert (cp["applied_transactions"], cp["applied_rows"], cp["revision"]) == (1, 2, 1)


def test_a_captured_recording_reaches_the_target(spark, tmp_path):
    (tmp_path / "rec").mkdir()
    columns = [{"name": "id", "type": "int", "key": 0}, {"name": "v", "type": "varchar(9)", "charset": "utf8mb4"}, {"name": "f", "type": "float(24)"}]
    tx = lambda n, *e: [{"kind": "GTID", "gtid": f"{UUID}:{n}", "pos": 100 * n}, {"kind": "TABLE_MAP", "table_id": 7, "schema": "s", "table": "t", "columns": columns, "pos": 100 * n + 1}, *e, {"kind": "XID", "pos": 100 * n + 9}]
    events = [{"kind": "ROTATE", "file": "binlog.000001"}, *tx(1, {"kind": "WRITE_ROWS", "table_id": 7, "rows": [{"after": [1, "a", 0.5]}, {"after": [2, "b", 1.5]}], "pos": 105}), *tx(2, {"kind": "UPDATE_ROWS", "table_id": 7, "rows": [{"before": [1, "a", 0.5], "after": [3, None, 0.5]}], "pos": 205})]
    (tmp_path / "rec" / "binlog.000001").write_text("".join(json.dumps(e) + "\n" for e in events))
    for _ in range(2):
        cli.main(["capture", str(tmp_path / "rec"), str(tmp_path / "log"), "--source", UUID, "--version", "5.7.44"])
    lines = [json.loads(x) for f in (tmp_path / "log").glob("*.txt") for x in f.read_text().splitlines()]
    assert len(lines) == 2 + 2 + 2 + 1 and {x["source"]["version"] for x in lines} == {"5.7.44"}
    assert decode.Binlog("5.7.44").version == "5.7.44"
    bits = {json.loads(d["value"])["bits"] for x in lines for d in (x["payload"].get("after") or []) if d["name"] == "f"}
    assert bits == {64}  # FLOAT(24) is double before 8.0
    (tmp_path / "in").mkdir()
    for i, f in enumerate(sorted((tmp_path / "log").glob("*.txt"))):
        (tmp_path / "in" / f"{i}.jsonl").write_text(f.read_text())
    cli.main(["apply", str(tmp_path / "in"), str(tmp_path / "t"), "--schema", "s", "--table", "t", "--key", "id", "--columns", "v"])
    r = Route(spark, str(tmp_path / "t"), ["id"], ["v"])
    assert sorted(tuple(x) for x in r.table.read().select("id", "v").collect()) == [("2", "b"), ("3", None)]
