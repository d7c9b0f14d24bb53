"""Records, transactions, rules and routes on small logs."""

import json

import pytest
from pyspark.sql import functions as F

from tidelog import model
from tidelog.operators import apply, assemble, contracts, project, validate
from tidelog.sources import jsonl

UUID = "3e11fa47-71ca-11e1-9e33-c80aa9429562"


def cursor(n):
    return {"format": "mysql", "value": f"c{n}", "display": f"binlog.000001:{n}"}


def datum(i, name, value=None, key=None, presence=None, **more):
    v = None if value is None else json.dumps({"type": "text", "value": value})
    return {"ordinal": i, "name": name, "native_type": "text", "primary_key_ordinal": key, "generated": False, "presence": presence or ("null" if value is None else "value"), "value": v} | more


def change(op, before=None, after=None, table="t"):
    return {"type": "row_change", "operation": op, "schema": "s", "table": table, "source_cursor": cursor(5), "source_timestamp": 1, "schema_basis": "b", "before": before, "after": after}


def log(tx, changes, fmt=model.FORMAT, kind="mysql", start=0):
    head = lambda i: {"id": tx, "sequence": i, "begin_cursor": cursor(1), "commit_cursor": cursor(9)}
    source = {"kind": kind, "version": "8.0.36", "server_uuid": UUID}
    payloads = [{"type": "transaction_begin"}, *changes, {"type": "transaction_commit", "change_count": len(changes)}]
    return [(start + i, "f", json.dumps({"format": fmt, "source": source, "transaction": head(i), "payload": p})) for i, p in enumerate(payloads)]


def frame(spark, rows):
    return jsonl.from_lines(spark.createDataFrame(rows, "line_no long, file string, value string"))


ROW = [datum(0, "id", "1", key=0), datum(1, "note")]


def test_assembly_keeps_whole_transactions_in_order(spark):
    rows = log("a", [change("insert", after=ROW), change("delete", before=ROW)]) + log("b", [change("insert", after=ROW)], start=10)[:-1]
    out = assemble.assemble(frame(spark, rows)).collect()
    assert [(r["id"], [c["operation"] for c in r["changes"]]) for r in out] == [("a", ["insert", "delete"])]
    assert out[0]["source"]["id"] == UUID  # the old name of the field
    assert [r["transaction_id"] for r in jsonl.unfinished(frame(spark, rows)).collect()] == ["b"]


def test_round_trip_of_lines(spark, tmp_path):
    rows = log("a", [change("update", ROW, ROW)]) + log("b", [change("insert", after=ROW)], start=10)
    first = assemble.assemble(frame(spark, rows)).withColumn("tx", F.col("id"))
    jsonl.write(first, str(tmp_path / "log"))
    again = assemble.assemble(jsonl.read(spark, str(tmp_path / "log")))
    pick = lambda d: sorted((r["id"], r["changes"]) for r in d.collect())
    assert pick(again) == pick(first)


def test_format_gate(spark):
    ok = frame(spark, log("a", [change("insert", after=ROW)]) + log("b", [change("insert", after=ROW)], fmt=model.MYSQL_FORMATS[0]))
    assert jsonl.gate(ok).count() == 6
    for rows in (log("a", [], fmt="other"), log("a", [], fmt=model.MYSQL_FORMATS[1], kind="postgresql"), [(0, "f", '{"format":"%s","more":1}' % model.FORMAT)]):
        with pytest.raises(Exception, match="validation_failed"):
            jsonl.gate(frame(spark, rows)).collect()


def test_stream_rules(spark):
    a, b = log("a", [change("insert", after=ROW)]), log("b", [change("insert", after=ROW)])
    mixed = [(i, f, v) for i, (_, f, v) in enumerate([a[0], b[1], a[1], a[2], b[0], b[0], b[2]])]
    codes = {r["rule_code"] for r in assemble.stream_violations(frame(spark, mixed)).collect()}
    assert {"interleaved_transaction", "nested_transaction"} <= codes
    clean = [(i, f, v) for i, (_, f, v) in enumerate(a + b)]
    assert assemble.stream_violations(frame(spark, clean)).count() == 0


@pytest.mark.parametrize(
    "bad, code",
    [
        (change("insert", after=[]), "after_image_empty"),
        (change("insert", before=ROW, after=ROW), "operation_images_mismatch"),
        (change("insert", after=ROW, table=""), "table_name_invalid"),
        (change("insert", after=[datum(0, "id", "1", key=0), datum(0, "id", "2")]), "after_columns_not_unique"),
        (change("insert", after=[datum(0, "id", "1", key=1)]), "after_key_ordinals_invalid"),
        (change("insert", after=[datum(0, "id", key=0)]), "after_key_value_missing"),
        (change("insert", after=[datum(0, "id", "1", key=0), datum(1, "x", presence="unchanged")]), "after_presence_invalid"),
        (change("update", ROW, [datum(0, "id", "1", key=0), datum(1, "other")]), "update_definitions_differ"),
        (change("insert", after=[datum(0, "id", "1", key=0) | {"value": '{"type":"integer","bits":8,"signed":true,"value":"200"}'}]), "logical_value.integer_range"),
    ],
)
def test_each_rule_reports_its_code(spark, bad, code):
    found = validate.violations(assemble.assemble(frame(spark, log("a", [bad])))).collect()
    assert code in {r["rule_code"] for r in found}


def test_a_valid_transaction_has_no_violation(spark):
    good = assemble.assemble(frame(spark, log("a", [change("insert", after=ROW), change("update", ROW, [datum(0, "id", "1", key=0), datum(1, "note", presence="unchanged")])])))
    assert validate.violations(good).count() == 0
    assert validate.strict(good).count() == 1


@pytest.mark.parametrize("field, codes", [("display", []), ("format", ["cursor_incomplete"]), ("value", ["cursor_incomplete"])])
def test_a_cursor_needs_a_format_and_a_value(spark, field, codes):
    rows = [(n, f, json.loads(x)) for n, f, x in log("a", [change("insert", after=ROW)])]
    for _, _, x in rows:
        x["transaction"]["commit_cursor"][field] = ""
    found = validate.violations(assemble.assemble(frame(spark, [(n, f, json.dumps(x)) for n, f, x in rows]))).collect()
    assert [r["rule_code"] for r in found] == codes


def test_projection_keeps_emptied_transactions(spark):
    tx = assemble.assemble(frame(spark, log("a", [change("insert", after=ROW), change("insert", after=ROW, table="u")]) + log("b", [change("insert", after=ROW, table="u")], start=10)))
    out = {r["id"]: r["changes"] for r in project.project(tx, {("s", "t"): ["id"]}).collect()}
    assert [[d["name"] for d in c["after"]] for c in out["a"]] == [["id"]] and out["b"] == []


def test_mysql_identity(spark):
    s = F.struct(F.lit("mysql").alias("kind"), F.col("v").alias("version"), F.lit(UUID).alias("id"))
    rows = spark.createDataFrame([("8.0.1", f"{UUID}:42"), ("8.0.1", f"{UUID}:tag:42"), ("8.4.0", f"{UUID}:tag:42"), ("9.0", "x")], "v string, t string")
    got = [r[0] for r in rows.select(contracts.mysql_identity(s, F.col("t"))).collect()]
    assert got == [[], ["tagged_gtid_unsupported"], [], ["version_unsupported", "transaction_id_invalid"]]


def test_strict_apply_and_fold_with_key_change(spark):
    rows = [(1, 1, "insert", None, 1, "a"), (1, 2, "update", 1, 2, "b"), (1, 3, "insert", None, 1, "c"), (2, 1, "delete", 2, None, None)]
    c = spark.createDataFrame(rows, "file_no long, pos long, operation string, old long, id long, v string")
    out = apply.fold(None, c, ["id"], ["v"], ["file_no", "pos"], old_key=["old"]).collect()
    assert [(r["id"], r["v"]) for r in out] == [(1, "c")]


def test_hot_key_history_over_buckets(spark):
    ops = ["insert", "update", "delete", "insert", "insert", "delete", "update"] * 20
    rows = [(i // 7, i, "k", op) for i, op in enumerate(ops)]
    c = spark.createDataFrame(rows, "bucket long, pos long, k string, operation string")
    got = sorted((r["pos"], r["rule_code"]) for r in apply.strict_violations(c, ["k"], "bucket", ["pos"]).collect())
    live, want = 0, []
    for i, op in enumerate(ops):
        if op == "insert" and live:
            want.append((i, "duplicate_key"))
        if op != "insert" and not live:
            want.append((i, "missing_row"))
        live = {"insert": 1, "delete": 0}.get(op, live)
    assert got == want


def test_keyset_scan_pages_are_complete(spark):
    df = spark.range(600).select(F.col("id").alias("a"), (F.col("id") % 3).alias("b"))
    seen, after = [], None
    while page := [tuple(r) for r in apply.next_page(df, ["a", "b"], after).collect()]:
        seen += page
        after = page[-1]
    assert len(seen) == 600 and seen == sorted(seen)
    assert [r["page_rows"] for r in apply.keyset_pages(df, F.floor(F.col("a") / 50), ["a", "b"]).orderBy("page").collect()] == [256, 256, 88]
    assert apply.keyset_pages(df.limit(0), F.floor(F.col("a") / 50), ["a", "b"]).count() == 0
