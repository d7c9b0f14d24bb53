"""Declarations, capabilities, plans and what they compile to."""

from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec, convert, values
from tidelog.plans import manifest, planner
from tidelog.plans.types import FieldDefinition, LogicalType, members, mysql_type, pg_type

MYSQL, PG = manifest.build("mysql"), manifest.build("postgresql")


def field(name, t, **more):
    return FieldDefinition(name, 0, "x", t, **more)


def test_mysql_declarations():
    assert mysql_type("bigint unsigned") == LogicalType("integer", bits=64, signed=False)
    assert mysql_type("TINYINT(1)") == LogicalType("integer", bits=8, signed=True)
    assert mysql_type("decimal(30,6)") == LogicalType("decimal", precision=30, scale=6)
    assert mysql_type("float(24)").bits == 32 and mysql_type("float(24)", version="8.4").bits == 64
    assert mysql_type("varchar(255)", "utf8mb4").length == 255
    assert mysql_type("enum('a','b''c')").members == ("a", "b'c")
    assert mysql_type("datetime(6)").precision == 6
    for bad in ("decimal(70)", "varchar(3)", "what", "enum('a' 'b')"):
        with pytest.raises(ValueError):
            mysql_type(bad)
    assert members("'a',  'b'") == ("a", "b")


def test_pg_declarations():
    catalog = {"mood": {"kind": "enum", "labels": ["ok", "sad"]}, "positive": {"kind": "domain", "of": "integer"}, "loop": {"kind": "domain", "of": "loop"}}
    assert pg_type("timestamp(3) with time zone") == LogicalType("instant", precision=3)
    assert pg_type("character varying(20)").length == 20
    assert pg_type("numeric").family == "decimal_unbounded"
    assert pg_type("mood[]", catalog).element.members == ("ok", "sad")
    assert pg_type("positive", catalog).element.bits == 32
    assert pg_type("money").family == "raw"
    with pytest.raises(ValueError):
        pg_type("loop", catalog)


def test_statuses():
    i32, i8 = LogicalType("integer", bits=32, signed=True), LogicalType("integer", bits=8, signed=True)
    assert planner.plan_field(field("a", i8), field("a", i32), MYSQL).status == "COMPATIBLE"
    narrow = planner.plan_field(field("a", i32), field("a", i8), MYSQL)
    assert (narrow.status, narrow.level) == ("NEEDS_CONFIRMATION", "RANGE_CHECKED")
    sure = planner.plan_field(field("a", i32), field("a", i8), MYSQL, confirmed={narrow.digest})
    assert sure.status == "COMPATIBLE" and sure.digest == narrow.digest
    assert planner.plan_field(field("a", i32, key_ordinal=0), field("a", i8, key_ordinal=0), MYSQL).code == "target_capability.lossy_key_conversion"
    assert planner.plan_field(field("a", i32, key_ordinal=0), field("a", i32), MYSQL).code == "target_capability.primary_key_mismatch"
    assert planner.plan_field(field("a", LogicalType("range")), field("a", LogicalType("text", length=9)), MYSQL).code == "target_capability.explicit_carrier_selection_required"
    assert planner.plan_field(field("a", LogicalType("duration")), field("a", LogicalType("uuid")), PG).status == "UNSUPPORTED"
    local, instant = LogicalType("local_datetime", precision=6), LogicalType("instant", precision=6)
    assert planner.plan_field(field("a", local), field("a", instant), PG).code == "target_capability.missing_parameters"
    given = planner.plan_field(field("a", local), field("a", instant), PG, {"strategy": "fixed_offset", "offset": "+08:00"})
    assert given.parameters["offset_seconds"] == 28800 and given.status == "NEEDS_CONFIRMATION"
    assert manifest.problems(MYSQL) == [] and manifest.problems(MYSQL[:1] * 2) != []


def test_staleness():
    i32, i64 = LogicalType("integer", bits=32, signed=True), LogicalType("integer", bits=64, signed=True)
    s, t = field("a", i32), field("a", i64)
    p = planner.plan_field(s, t, PG)
    assert planner.stale(p, s, t, PG) is None
    assert planner.stale(replace(p, rule="other"), s, t, PG) == "compatibility.plan_digest_mismatch"
    assert planner.stale(p, s, t, PG[:-1]) == "compatibility.target_probe_changed"
    assert planner.stale(p, field("a", i64), t, PG) == "compatibility.plan_inputs_changed"


def test_compiled_plan_converts_and_reports(spark):
    i32, i8 = LogicalType("integer", bits=32, signed=True), LogicalType("integer", bits=8, signed=True)
    first = planner.plan_field(field("a", i32), field("b", i8), MYSQL)
    plan = planner.plan_field(field("a", i32), field("b", i8), MYSQL, confirmed={first.digest})
    rows = planner.compile_plan(spark.createDataFrame([(1,), (200,), (None,)], "a int"), [plan])
    got = [(r["b"], [x["code"] for x in r["conversion_failures"]]) for r in rows.collect()]
    assert got == [(1, []), (None, ["target_capability.integer_overflow"]), (None, [])]
    with pytest.raises(Exception, match="conversion_failed"):
        planner.reject_failures(rows).collect()


def test_range_checks_never_lose(spark):
    d = spark.createDataFrame([(Decimal("123.45"),), (Decimal("123.456"),), (Decimal("99999.00"),)], "x decimal(18,4)")
    assert [r[0] for r in d.select(convert.decimal_fits(F.col("x"), 5, 2)).collect()] == [True, False, False]
    t = spark.createDataFrame([("12300", 2), ("12345", 2), ("-0", 0), ("1" + "0" * 60, 0)], "u string, s int")
    assert [r[0] for r in t.select(convert.decimal_text_fits(F.col("u"), F.col("s"), 5, 1)).collect()] == [True, False, True, False]
    f = spark.createDataFrame([(1.5,), (0.1,), (1e300,), (float("nan"),)], "x double")
    assert [r[0] for r in f.select(convert.float_fits(F.col("x"))).collect()] == [True, False, False, False]


def test_codecs(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(codec.decimal_parts(F.lit("-001.50"))).asDict() == {"unscaled": "-150", "scale": 2}
    assert one(codec.decimal_parts(F.lit("x"))) is None
    assert one(codec.decimal_text(F.lit("-5"), F.lit(3))) == "-0.005" and one(codec.decimal_text(F.lit("5"), F.lit(-2))) == "500"
    assert one(codec.pg_date(F.lit("0001-02-03 BC")))["year"] == 0
    assert one(codec.iso_interval(F.lit("P1Y2M3DT4H5M6.5S"))).asDict() == {"months": 14, "days": 3, "microseconds": 14706500000}
    assert one(F.hex(codec.bit_text(F.lit("1010000011")))) == "A0C0"
    assert one(codec.network(F.lit("10.0.0.0/8"))).asDict() == {"family": "ipv4", "address": "10.0.0.0", "prefix_length": 8}
    assert one(F.hex(convert.reorder_bits(F.unhex(F.lit("01F0"))))) == "800F"
    assert one(codec.gtid(F.unhex(F.lit("3E11FA4771CA11E19E33C80AA9429562")), F.lit(7))) == "3e11fa47-71ca-11e1-9e33-c80aa9429562:7"
    assert one(codec.from_base64url(codec.to_base64url(F.unhex(F.lit("00FFFB"))))) == b"\x00\xff\xfb"
    header = one(codec.spatial_header(F.unhex(F.lit("0101000000" + "00" * 16))))
    assert header.asDict() == {"little_endian": True, "geometry_type": 1, "dimensions": 2, "srid": None}


def test_logical_values():
    good = [{"type": "date", "year": -44, "month": 2, "day": 29}, {"type": "local_time", "hour": 24, "minute": 0, "second": 0, "microsecond": 0}, {"type": "set", "value": ["b", "a"]}]
    for v in good:
        values.check(v)
    bad = [{"type": "date", "year": 2023, "month": 2, "day": 29}, {"type": "local_time", "hour": 24, "minute": 1, "second": 0, "microsecond": 0}, {"type": "set", "value": ["a", "a"]}, {"type": "bit_string", "bit_length": 9, "bytes": "AAE"}, {"type": "nope"}]
    for v in bad:
        with pytest.raises(values.Invalid):
            values.check(v)
    deep = {"type": "null"}
    for _ in range(101):
        deep = {"type": "array", "value": [deep]}
    with pytest.raises(values.Invalid):
        values.check(deep)
    assert values.normal_json('{"b":1.10,"a":[true,null]}') == '{"a":[true,null],"b":1.10}'
    with pytest.raises(values.Invalid):
        values.normal_json('{"a":1,"a":2}')
    assert values.canonical({"type": "set", "value": ["b", "a"]}) == values.canonical({"value": ["a", "b"], "type": "set"})
