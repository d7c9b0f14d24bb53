"""The registered queries of the change-log engine, each beside its SQL.

A change log is derived from ``events`` without outside state: five changes to a transaction,
400 to a log file; see ``changes`` and ``CHANGES``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import model, storage
from .functions import codec, convert, digest, render, values
from .operators import apply, assemble, checks, contracts, cursors, project, validate
from .plans import manifest, planner, types
from .sources import catalog, jsonl
from .streaming import runner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ORDER = ["file_no", "pos"]

CHANGES = """
    SELECT event_id, ts, user_id, value, props, event_type, event_id // 5 AS tx_id, event_id % 5 + 1 AS sequence,
      event_id // 400 AS file_no, 4 + (event_id % 400) * 10 AS pos,
      CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS operation,
      CASE WHEN event_type = 'view' THEN 'unchanged' WHEN event_type = 'error' THEN 'unavailable' ELSE 'value' END AS presence
    FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    presence = F.when(F.col("event_type") == "view", "unchanged").when(F.col("event_type") == "error", "unavailable").otherwise("value")
    div = lambda x, k: ((x - x % k) / k).cast("long")
    return e.withColumns({"tx_id": div(n, 5), "sequence": n % 5 + 1, "file_no": div(n, 400), "pos": 4 + (n % 400) * 10, "operation": op, "presence": presence})


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{changes}", f"({CHANGES})")
        return f

    return add


def values_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("SELECT tx_id, COUNT(*) AS changes, MIN(event_id) AS first_pos, MAX(event_id) AS last_pos, COUNT(*) FILTER (operation = 'insert') AS inserts, COUNT(*) FILTER (operation = 'update') AS updates, COUNT(*) FILTER (operation = 'delete') AS deletes FROM {changes} GROUP BY tx_id")
def tx_assembly(spark, sf_dir):
    return assemble.summaries(changes(spark, sf_dir), "tx_id", "operation", F.col("event_id"))


@query("SELECT tx_id, COUNT(*) AS changes, 5::BIGINT AS declared FROM (SELECT * FROM {changes} WHERE event_type <> 'signup') GROUP BY tx_id HAVING COUNT(*) <> 5")
def incomplete_transactions(spark, sf_dir):
    return assemble.change_count_mismatches(changes(spark, sf_dir).filter("event_type != 'signup'"), "tx_id", F.lit(5))


@query("SELECT tx_id, event_id, sequence, expected FROM (SELECT *, COALESCE(LAG(sequence) OVER (PARTITION BY tx_id ORDER BY pos, file_no) + 1, 1) AS expected FROM {changes} WHERE event_type <> 'signup') WHERE sequence <> expected")
def sequence_violations(spark, sf_dir):
    rows = changes(spark, sf_dir).filter("event_type != 'signup'")
    return assemble.sequence_violations(rows, "tx_id", "sequence", ORDER).select("tx_id", "event_id", "sequence", "expected")


@query("SELECT tx_id, event_id, user_id, operation FROM {changes} WHERE event_type IN ('signup', 'purchase', 'error')")
def route_projection(spark, sf_dir):
    """Each event type stands for a table; three are mapped."""
    rows = changes(spark, sf_dir).withColumn("c", F.struct(F.lit("s").alias("schema"), F.col("event_type").alias("table"), F.col("event_id"), F.col("user_id"), F.col("operation"), F.array(F.struct(F.lit("id").alias("name"))).alias("before"), F.array(F.struct(F.lit("id").alias("name"))).alias("after")))
    txs = rows.groupBy("tx_id").agg(F.collect_list("c").alias("changes"))  # five to a transaction
    kept = project.project(txs, {("s", t): None for t in ("signup", "purchase", "error")})
    return kept.select("tx_id", F.explode("changes").alias("c")).select("tx_id", "c.event_id", "c.user_id", "c.operation")


@query("SELECT event_id, operation, presence, CASE WHEN presence = 'value' THEN value END AS written, presence = 'value' AS writable FROM {changes}")
def writable_columns(spark, sf_dir):
    datum = lambda name, generated, presence, value: F.struct(F.lit(name).alias("name"), F.lit(generated).alias("generated"), presence.alias("presence"), value.alias("value"))
    image = F.array(datum("value", False, F.col("presence"), F.col("value")), datum("doubled", True, F.lit("value"), F.col("value") * 2))
    kept = project.writable(image)
    return changes(spark, sf_dir).select("event_id", "operation", "presence", F.try_element_at(kept, F.lit(1))["value"].alias("written"), (F.size(kept) > 0).alias("writable"))


@query("SELECT user_id, event_id AS last_event_id, value AS last_value, changes FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY file_no DESC, pos DESC) AS rn, COUNT(*) OVER (PARTITION BY user_id) AS changes FROM {changes}) WHERE rn = 1 AND operation <> 'delete'")
def replay_latest_state(spark, sf_dir):
    state = apply.latest_state(changes(spark, sf_dir), ["user_id"], ORDER, ["event_id", "value"])
    return state.select("user_id", F.col("event_id").alias("last_event_id"), F.col("value").alias("last_value"), "changes")


@query(
    """SELECT rule_code, COUNT(*) AS n, SUM(event_id)::BIGINT AS ids FROM (SELECT event_id, CASE WHEN operation = 'insert' AND live = 1 THEN 'duplicate_key' WHEN operation <> 'insert' AND live = 0 THEN 'missing_row' END AS rule_code
       FROM (SELECT *, COALESCE(LAST_VALUE(CASE operation WHEN 'insert' THEN 1 WHEN 'delete' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY file_no, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS live FROM {changes}))
       WHERE rule_code IS NOT NULL GROUP BY rule_code"""
)
def strict_apply_violations(spark, sf_dir):
    bad = apply.strict_violations(changes(spark, sf_dir), ["user_id"], "file_no", ORDER)
    return bad.groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    """SELECT event_id, user_id, CASE WHEN presence = 'unchanged' THEN LAST_VALUE(CASE WHEN presence = 'value' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY file_no, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE value END AS carried FROM {changes}"""
)
def unchanged_carry(spark, sf_dir):
    out = apply.unchanged_carry(changes(spark, sf_dir), ["user_id"], "file_no", ORDER, "value", "presence")
    return out.select("event_id", "user_id", F.col("value").alias("carried"))


@query("WITH bound AS (SELECT MAX(event_id) // 2 AS b FROM events) SELECT event_id, tx_id, operation FROM {changes}, bound WHERE (file_no, pos) > (b // 400, 4 + (b % 400) * 10)")
def exactly_once_dedupe(spark, sf_dir):
    rows = changes(spark, sf_dir)
    b = rows.agg(F.max("event_id")).first()[0] // 2
    # The log is delivered whole again; what the checkpoint covers is skipped.
    return cursors.beyond(rows, (b // 400, 4 + (b % 400) * 10)).select("event_id", "tx_id", "operation")


@query("SELECT event_type AS task, COUNT(DISTINCT tx_id) AS applied_transactions, COUNT(*) AS applied_rows, MAX(file_no) AS file_no, arg_max(pos, file_no * 100000 + pos) AS pos FROM {changes} GROUP BY event_type")
def checkpoint_counters(spark, sf_dir):
    return checks.progress(changes(spark, sf_dir).withColumnRenamed("event_type", "task"), "task", "tx_id", ORDER)


@query(
    "SELECT COUNT(*) AS emptied, MAX(last) AS observed FROM (SELECT tx_id, MAX(event_id) AS last, COUNT(*) FILTER (event_type = 'signup') AS kept FROM {changes} GROUP BY tx_id) WHERE kept = 0"
)
def filtered_observe(spark, sf_dir):
    return checks.emptied(changes(spark, sf_dir), "tx_id", F.col("event_type") == "signup", "event_id")


@query("SELECT event_id, 'binlog.' || lpad(file_no::VARCHAR, 6, '0') AS file, ROW_NUMBER() OVER (ORDER BY file_no, pos) - 1 AS place FROM {changes}")
def cursor_order(spark, sf_dir):
    rows = changes(spark, sf_dir).withColumn("file", F.concat(F.lit("binlog."), F.lpad(F.col("file_no").cast("string"), 6, "0")))
    keyed = rows.withColumn("k", cursors.mysql_key(F.col("file"), F.col("pos")))
    return apply.ranked(keyed, F.col("k.file_no"), ["k.pos"], "place").select("event_id", "file", F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey, lsn, (('0x' || split_part(lsn, '/', 1))::UBIGINT * 4294967296 + ('0x' || split_part(lsn, '/', 2))::UBIGINT)::DECIMAL(20,0) AS lsn_value FROM (SELECT o_orderkey, printf('%X/%X', o_orderkey % 7, o_orderkey * 16 + o_custkey) AS lsn FROM orders)")
def lsn_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("lsn", cursors.lsn_text(F.col("o_orderkey") % 7, F.col("o_orderkey") * 16 + F.col("o_custkey")))
    return rows.select("o_orderkey", "lsn", cursors.lsn_value(F.col("lsn")).alias("lsn_value"))


@query("SELECT event_type, MIN(event_id) AS interval_start, MAX(event_id) AS interval_end FROM (SELECT event_type, event_id, event_id - ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id) AS island FROM events) GROUP BY event_type, island")
def gtid_merge(spark, sf_dir):
    return cursors.gtid_islands(table(spark, sf_dir, "events"), "event_type", "event_id")


@query(
    """WITH i AS (SELECT event_type, MIN(event_id) AS a, MAX(event_id) AS b FROM (SELECT event_type, event_id, event_id - ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id) AS island FROM events) GROUP BY event_type, island)
       SELECT o_orderkey, event_type FROM orders JOIN i ON o_orderkey BETWEEN a AND b AND event_type = CASE o_orderstatus WHEN 'F' THEN 'view' WHEN 'O' THEN 'click' ELSE 'error' END"""
)
def gtid_contains(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "view").when(F.col("o_orderstatus") == "O", "click").otherwise("error").alias("event_type"))
    return cursors.contained(ids, gtid_merge(spark, sf_dir), "event_type", "o_orderkey").select("o_orderkey", "event_type")


@query(
    """SELECT page, COUNT(*) AS page_rows, arg_min(l_orderkey, rn) AS first_l_orderkey, arg_min(l_linenumber, rn) AS first_l_linenumber, arg_max(l_orderkey, rn) AS last_l_orderkey, arg_max(l_linenumber, rn) AS last_l_linenumber
       FROM (SELECT *, (rn - 1) // 256 AS page FROM (SELECT l_orderkey, l_linenumber, ROW_NUMBER() OVER (ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem)) GROUP BY page"""
)
def keyset_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return apply.keyset_pages(rows, F.floor(F.col("l_orderkey") / 4096), ["l_orderkey", "l_linenumber"])


@query(
    """WITH old AS (SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 5 <> 0),
            new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 7 <> 0)
       SELECT COALESCE(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS operation,
         o.o_orderstatus AS old_o_orderstatus, o.o_custkey AS old_o_custkey, n.o_orderstatus AS new_o_orderstatus, n.o_custkey AS new_o_custkey
       FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_custkey IS DISTINCT FROM n.o_custkey"""
)
def snapshot_diff(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), F.col("o_orderkey")
    new = o.filter(k % 7 != 0).withColumn("o_orderstatus", F.when(k % 11 == 0, "X").when(k % 13 == 0, None).otherwise(F.col("o_orderstatus")))
    return apply.snapshot_diff(o.filter(k % 5 != 0), new, ["o_orderkey"], ["o_orderstatus", "o_custkey"])


@query("WITH b AS (SELECT MAX(event_id) // 2 AS b FROM events) SELECT event_id, CASE WHEN event_id <= b THEN 'snapshot' ELSE 'incremental' END AS phase FROM events, b")
def snapshot_handoff(spark, sf_dir):
    rows = changes(spark, sf_dir)
    b = rows.agg(F.max("event_id")).first()[0] // 2
    f, p = b // 400, 4 + (b % 400) * 10
    behind = (F.col("file_no") > f) | ((F.col("file_no") == f) & (F.col("pos") > p))
    return apply.handoff(rows.filter(F.col("event_id") <= b), rows, behind).select("event_id", "phase")


@query(
    """SELECT o_orderkey, COUNT(l_orderkey) AS matches, CASE WHEN COUNT(l_orderkey) = 0 THEN 'missing' WHEN COUNT(l_orderkey) = 1 THEN 'one' ELSE 'many' END AS verdict
       FROM orders LEFT JOIN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 OR l_quantity > 45) ON o_orderkey = l_orderkey GROUP BY o_orderkey"""
)
def row_locator_probe(spark, sf_dir):
    target = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 or l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return project.locator_probe(table(spark, sf_dir, "orders").select("o_orderkey"), target, ["o_orderkey"])


@query("SELECT n_nationkey, n_name, 'target_capability.plan_missing_for_column' AS rule_code FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 7 = 0)")
def plan_coverage(spark, sf_dir):
    plans = table(spark, sf_dir, "supplier").filter("s_suppkey % 7 = 0").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    return planner.uncovered(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), plans, ["n_nationkey"])


@query("SELECT lang, COUNT(*) FILTER (n_chars IS NOT DISTINCT FROM length(text)) AS matched, COUNT(*) FILTER (n_chars IS DISTINCT FROM length(text)) AS mismatched FROM documents GROUP BY lang")
def generated_verification(spark, sf_dir):
    return checks.generated_mismatches(table(spark, sf_dir, "documents"), ["lang"], F.col("n_chars"), F.char_length("text").cast("long"))


@query("SELECT a.s_suppkey AS first_task, b.s_suppkey AS second_task, a.s_nationkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE a.s_acctbal > 5000 AND b.s_acctbal > 5000")
def target_overlap(spark, sf_dir):
    # A supplier stands for a task, its nation for the sink table.
    return project.overlapping(table(spark, sf_dir, "supplier").filter("s_acctbal > 5000"), "s_suppkey", ["s_nationkey"])


@query(
    """SELECT width, COUNT(*) FILTER (x BETWEEN lo AND hi) AS fits, COUNT(*) FILTER (x NOT BETWEEN lo AND hi) AS integer_overflow FROM
       (SELECT o_orderkey * o_custkey - 20000 AS x FROM orders), (VALUES ('i8', -128, 127), ('i16', -32768, 32767), ('i24', -8388608, 8388607), ('i32', -2147483648, 2147483647), ('u8', 0, 255), ('u16', 0, 65535), ('u32', 0, 4294967295)) w(width, lo, hi) GROUP BY width"""
)
def integer_range_check(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * F.col("o_custkey") - 20000).alias("x"))
    widths = [("i8", 8, True), ("i16", 16, True), ("i24", 24, True), ("i32", 32, True), ("u8", 8, False), ("u16", 16, False), ("u32", 32, False)]
    checks = F.explode(F.array(*(F.struct(F.lit(n).alias("width"), convert.integer_fits(F.col("x"), b, s).alias("ok")) for n, b, s in widths)))
    return x.select(checks.alias("c")).groupBy("c.width").agg(F.sum(F.col("c.ok").cast("long")).alias("fits"), F.sum((~F.col("c.ok")).cast("long")).alias("integer_overflow"))


@query("SELECT COUNT(*) FILTER (TRY_CAST(x AS DECIMAL(7,2)) = x) AS fits, COUNT(*) FILTER (TRY_CAST(x AS DECIMAL(7,2)) IS DISTINCT FROM x) AS rejected FROM (SELECT (l_extendedprice::DECIMAL(18,4) * l_discount::DECIMAL(4,2))::DECIMAL(18,4) AS x FROM lineitem)")
def decimal_range_check(spark, sf_dir):
    x = (F.col("l_extendedprice").cast("decimal(18,4)") * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,4)")
    ok = convert.decimal_fits(F.col("x"), 7, 2)
    return table(spark, sf_dir, "lineitem").select(x.alias("x")).agg(F.sum(ok.cast("long")).alias("fits"), F.sum((~F.coalesce(ok, F.lit(False))).cast("long")).alias("rejected"))


@query("SELECT c_custkey, c_acctbal::FLOAT::DOUBLE = c_acctbal AS fits FROM customer")
def float_narrowing(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", convert.float_fits(F.col("c_acctbal")).alias("fits"))


@query("SELECT lang, COUNT(*) FILTER (NOT regexp_matches(text, '[^\\x00-\\x7F]')) AS ascii, COUNT(*) FILTER (NOT regexp_matches(text, '[^\\x00-\\xFF]')) AS latin1, COUNT(*) FILTER (NOT regexp_matches(text, '[^\\x00-\\x{FFFF}]')) AS utf8 FROM documents GROUP BY lang")
def charset_representable(spark, sf_dir):
    n = lambda c: F.sum(convert.text_fits(F.col("text"), c).cast("long")).alias(c)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(n("ascii"), n("latin1"), n("utf8"))


@query("SELECT doc_id, length(text) <= 1000 AS chars_ok, strlen(text) <= 1000 AS bytes_ok FROM documents")
def text_length_bounds(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", convert.text_fits(t, "utf8mb4", 1000).alias("chars_ok"), convert.text_fits(t, "utf8mb4", 1000, "bytes").alias("bytes_ok"))


@query("SELECT p_partkey, CASE WHEN strlen(p_brand) <= 12 THEN rpad(hex(encode(p_brand)), 24, '0') END AS padded FROM part")
def binary_fixed_pad(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(convert.pad_binary(F.col("p_brand").cast("binary"), 12)).alias("padded"))


@query("SELECT n_nationkey, ((n_nationkey & 1) << 7) | ((n_nationkey & 2) << 5) | ((n_nationkey & 4) << 3) | ((n_nationkey & 8) << 1) | ((n_nationkey & 16) >> 1) | ((n_nationkey & 32) >> 3) | ((n_nationkey & 64) >> 5) | ((n_nationkey & 128) >> 7) AS reordered FROM nation")
def bit_reorder(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", convert.reverse_bits(F.col("n_nationkey")).alias("reordered"))


@query("SELECT o_orderkey, epoch_us(o_orderdate - INTERVAL 8 HOUR) AS instant_us FROM orders")
def temporal_local_instant(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(convert.local_to_instant(F.col("o_orderdate"), 8 * 3600)).alias("instant_us"))


@query("SELECT digits, COUNT(*) FILTER (epoch_us(ts) % (10 ** (6 - digits))::BIGINT = 0) AS exact, COUNT(*) FILTER (epoch_us(ts) % (10 ** (6 - digits))::BIGINT <> 0) AS temporal_precision_loss FROM events, (VALUES (0), (3), (6)) d(digits) GROUP BY digits")
def temporal_precision(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    checks = F.explode(F.array(*(F.struct(F.lit(d).alias("digits"), convert.precision_fits(us, d).alias("ok")) for d in (0, 3, 6))))
    return table(spark, sf_dir, "events").select(checks.alias("c")).groupBy("c.digits").agg(F.sum(F.col("c.ok").cast("long")).alias("exact"), F.sum((~F.col("c.ok")).cast("long")).alias("temporal_precision_loss"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS normal FROM events""")
def json_normalized(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", values.normal_json_text(F.col("props")).alias("normal"))


@query("SELECT c_mktsegment, COUNT(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) AS known, COUNT(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) AS enum_unknown_label FROM customer GROUP BY c_mktsegment")
def enum_membership(spark, sf_dir):
    ok = convert.enum_fits(F.col("c_mktsegment"), ["BUILDING", "MACHINERY", "HOUSEHOLD"]).cast("long")
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.sum(ok).alias("known"), F.sum(1 - ok).alias("enum_unknown_label"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY list_position(['signup', 'purchase', 'view', 'click', 'error'], event_type)) AS members FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def set_canonical(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("m"))
    return per.select("user_id", F.array_join(convert.set_members(F.col("m"), ["signup", "purchase", "view", "click", "error"]), ",").alias("members"))


@query("SELECT n_nationkey, sha256(strlen(n_nationkey::VARCHAR) || ':' || n_nationkey || '|' || strlen(n_name) || ':' || n_name || '|' || strlen(n_regionkey::VARCHAR) || ':' || n_regionkey) AS digest FROM nation")
def row_digest(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", digest.row_digest(*(F.col(c) for c in ("n_nationkey", "n_name", "n_regionkey"))).alias("digest"))


@query("SELECT tx_id, sha256(string_agg(sha256(strlen(event_id::VARCHAR) || ':' || event_id || '|' || strlen(operation) || ':' || operation), ',' ORDER BY sequence)) AS digest, COUNT(*) AS n FROM {changes} GROUP BY tx_id")
def content_digest_tx(spark, sf_dir):
    rows = changes(spark, sf_dir).withColumn("d", digest.row_digest(F.col("event_id"), F.col("operation")))
    return digest.ordered_digest(rows, ["tx_id"], ["sequence"], "d")


@query(
    """SELECT vendor, code, connected, 'target_apply.' || kind AS kind, kind IN ('connection_failed', 'lock_timeout') AS retry FROM (SELECT *, CASE WHEN NOT connected THEN 'connection_failed' WHEN code IN ('1205', '1213', '40001', '40P01', '55P03') THEN 'lock_timeout'
       WHEN code IN ('1062', '1452', '23505') THEN 'constraint_failed' WHEN code = '08006' THEN 'connection_failed' ELSE 'sql_error' END AS kind
       FROM (VALUES ('mysql', '1205', true), ('mysql', '1213', true), ('mysql', '1062', true), ('mysql', '1452', true), ('mysql', '1064', true), ('mysql', '2006', false), ('postgresql', '40001', true), ('postgresql', '40P01', true), ('postgresql', '55P03', true), ('postgresql', '23505', true), ('postgresql', '08006', true), ('postgresql', '42601', true)) v(vendor, code, connected))"""
)
def retry_classification(spark, sf_dir):
    rows = [("mysql", "1205", True), ("mysql", "1213", True), ("mysql", "1062", True), ("mysql", "1452", True), ("mysql", "1064", True), ("mysql", "2006", False)]
    rows += [("postgresql", c, True) for c in ("40001", "40P01", "55P03", "23505", "08006", "42601")]
    v = values_table(spark, rows, "vendor string, code string, connected boolean").withColumn("kind", runner.classify(F.col("vendor"), F.col("code"), F.col("connected")))
    return v.withColumn("retry", runner.retryable(F.col("kind")))


@query(
    """SELECT p_partkey, code FROM (SELECT p_partkey, code, ROW_NUMBER() OVER (PARTITION BY p_partkey ORDER BY q, r, code) AS rn FROM part JOIN
       (VALUES ('exact.int', 0, 0, 1, 50), ('range.int8', 1, 2, 1, 20), ('range.int16', 1, 2, 1, 40), ('carrier', 2, 3, 1, 50), ('exact.small', 0, 1, 1, 10)) c(code, q, r, lo, hi) ON p_size BETWEEN lo AND hi AND NOT (code = 'exact.int' AND p_size % 2 = 0)) WHERE rn = 1"""
)
def capability_ranking(spark, sf_dir):
    rows = [("exact.int", 0, 0, 1, 50), ("range.int8", 1, 2, 1, 20), ("range.int16", 1, 2, 1, 40), ("carrier", 2, 3, 1, 50), ("exact.small", 0, 1, 1, 10)]
    caps = values_table(spark, rows, "code string, qualification_rank int, risk_rank int, lo int, hi int")
    # The manifest's size is its release's, so it can go to every task.
    met = table(spark, sf_dir, "part").join(F.broadcast(caps), F.col("p_size").between(F.col("lo"), F.col("hi")) & ~((F.col("code") == "exact.int") & (F.col("p_size") % 2 == 0)))
    return planner.best_candidates(met, ["p_partkey"]).select("p_partkey", "code")


@query(
    """SELECT level, key_like, level IN ('EXPLICIT_CONVERSION', 'UNSUPPORTED') AS loses_value, level = 'UNSUPPORTED' OR (level = 'EXPLICIT_CONVERSION' AND key_like) AS loses_comparison, level = 'UNSUPPORTED' OR (level = 'EXPLICIT_CONVERSION' AND key_like) AS loses_ordering, level IN ('EXPLICIT_CONVERSION', 'UNSUPPORTED') AS constraints
       FROM (VALUES ('EXACT'), ('RANGE_CHECKED'), ('EXPLICIT_CONVERSION'), ('UNSUPPORTED')) l(level), (VALUES (true), (false)) k(key_like)"""
)
def loss_assessment(spark, sf_dir):
    rows = []
    for level in ("EXACT", "RANGE_CHECKED", "EXPLICIT_CONVERSION", "UNSUPPORTED"):
        for key in (True, False):
            x = planner.loss(level, key)
            rows.append((level, key, x["value"], x["comparison"], x["ordering"], x["constraints"]))
    return values_table(spark, rows, "level string, key_like boolean, loses_value boolean, loses_comparison boolean, loses_ordering boolean, constraints boolean")


@query(
    """SELECT n_regionkey, 'BEGIN;' || chr(10) || string_agg('INSERT INTO "nation" ("n_nationkey", "n_name") VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''');', chr(10) ORDER BY n_nationkey) || chr(10) || 'COMMIT;' AS script FROM nation GROUP BY n_regionkey"""
)
def sql_script(spark, sf_dir):
    stmt = render.insert(render.quote_identifier(F.lit("nation"), "postgresql"), {"n_nationkey": F.col("n_nationkey").cast("string"), "n_name": render.quote_text(F.col("n_name"))}, "postgresql")
    per = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", stmt.alias("s")))).alias("x"))
    return per.select("n_regionkey", render.script(F.transform("x", lambda s: s["s"])).alias("script"))


@query("SELECT (n_nationkey - 10) AS ordinal, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN (n_nationkey - 10) // 2 END AS primary_key_ordinal, n_nationkey % 3 = 0 AS nullable, n_nationkey % 5 = 0 AS generated FROM nation WHERE n_nationkey >= 10")
def catalog_key_join(spark, sf_dir):
    """Nations from 10 on stand for the columns of a table, the even ones for its key; others belong to another table."""
    k = F.col("n_nationkey")
    own = F.when(k >= 10, "t").otherwise("u")
    columns = table(spark, sf_dir, "nation").select(F.lit("s").alias("table_schema"), own.alias("table_name"), F.col("n_name").alias("column_name"), (k - 9).alias("ordinal_position"), F.lit("int").alias("column_type"), F.when(k % 3 == 0, "YES").otherwise("NO").alias("is_nullable"), F.when(k % 5 == 0, "a + 1").alias("generation_expression"), F.lit(None).cast("string").alias("collation_name"))
    keys = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.lit("s").alias("table_schema"), own.alias("table_name"), F.col("n_name").alias("column_name"), F.floor((k - 10) / 2 + 1).cast("int").alias("ordinal_position"), F.lit("PRIMARY").alias("constraint_name"))
    return catalog.mysql_columns(columns, keys, "s", "t").select("ordinal", "name", "primary_key_ordinal", "nullable", "generated")


@query("SELECT COALESCE(a.n_name, i.n_name) AS identity, CASE WHEN i.n_name IS NULL THEN 'Available' WHEN a.n_name IS NULL THEN 'Detected' ELSE 'Installed' END AS status, r_name AS namespace FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM nation WHERE n_nationkey >= 10) i ON a.n_name = i.n_name LEFT JOIN region ON i.n_regionkey = r_regionkey")
def extension_catalog(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    available = n.filter("n_nationkey < 15").select(F.col("n_name").alias("name"), F.lit("1.0").alias("default_version"))
    installed = n.filter("n_nationkey >= 10").select(F.col("n_name").alias("extname"), F.lit("1.0").alias("extversion"), F.col("n_regionkey").alias("extnamespace"))
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("oid"), F.col("r_name").alias("nspname"))
    return catalog.extensions(available, installed, names).select("identity", "status", "namespace")


@query("SELECT n_regionkey AS enumtypid, string_agg(n_name, ',' ORDER BY n_nationkey) AS labels FROM nation GROUP BY n_regionkey")
def enum_catalog(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("enumtypid"), F.col("n_nationkey").alias("enumsortorder"), F.col("n_name").alias("enumlabel"))
    return catalog.enum_labels(rows).select("enumtypid", F.array_join("labels", ",").alias("labels"))


@query("SELECT n_nationkey AS oid, r_regionkey AS rngsubtype, CASE WHEN n_nationkey = r_regionkey THEN 'range' WHEN n_nationkey = r_regionkey + 10 THEN 'multirange' END AS role FROM nation LEFT JOIN region ON n_nationkey = r_regionkey OR n_nationkey = r_regionkey + 10")
def range_catalog(spark, sf_dir):
    ranges = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rngsubtype"), F.col("r_regionkey").alias("rngtypid"), (F.col("r_regionkey") + 10).alias("rngmultitypid"))
    return catalog.ranges_of(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("oid")), ranges).select("oid", "rngsubtype", "role")


@query("SELECT c_custkey AS type_oid, c_name AS attribute_name, n_name AS class_name, r_name AS namespace_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def attribute_catalog(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    attributes = c.select(F.col("c_custkey").alias("type_oid"), F.col("c_nationkey").alias("class_oid"), F.col("c_name").alias("attribute_name"))
    types_ = c.select(F.col("c_custkey").alias("type_oid"), F.col("c_custkey").alias("type_name"))
    classes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("class_oid"), F.col("n_name").alias("class_name"), F.col("n_regionkey").alias("namespace_oid"))
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("namespace_oid"), F.col("r_name").alias("namespace_name"))
    return checks.attribute_types(attributes, types_, names, classes).withColumnRenamed("type_name", "type_oid")


_TYPES = [("person", "address"), ("person", "text"), ("address", "text"), ("address", "postcode"), ("postcode", "integer"), ("mood", None), ("team", "person"), ("orphan", "team")]


@query(
    """WITH RECURSIVE t(type_name, uses) AS (VALUES ('person', 'address'), ('person', 'text'), ('address', 'text'), ('address', 'postcode'), ('postcode', 'integer'), ('mood', NULL), ('team', 'person'), ('orphan', 'team')),
       c(type_name, depth) AS (SELECT 'team', 0 UNION SELECT t.uses, depth + 1 FROM c JOIN t USING (type_name) WHERE t.uses IS NOT NULL) SELECT type_name, MIN(depth)::INTEGER AS depth FROM c GROUP BY type_name"""
)
def type_closure(spark, sf_dir):
    return types.type_closure(values_table(spark, _TYPES, "type_name string, uses string"), values_table(spark, [("team",)], "type_name string"))


@query("SELECT operation, COUNT(*) FILTER (presence = 'value') AS n_value, COUNT(*) FILTER (presence = 'unchanged') AS n_unchanged, COUNT(*) FILTER (presence = 'unavailable') AS n_unavailable FROM {changes} GROUP BY operation")
def presence_profile(spark, sf_dir):
    return checks.presences(changes(spark, sf_dir), ["operation"])


@query("SELECT o_orderkey, epoch_us(TRY_CAST(raw AS TIMESTAMP)) AS value_us, CASE WHEN TRY_CAST(raw AS TIMESTAMP) IS NULL THEN raw END AS invalid FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '0000-00-00 00:00:00' WHEN o_orderkey % 10 = 0 THEN '2024-02-30 01:02:03' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS raw FROM orders)")
def invalid_temporal(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 9 == 0, "0000-00-00 00:00:00").when(k % 10 == 0, "2024-02-30 01:02:03").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    t = codec.temporal(F.col("raw"))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", F.unix_micros(t["value"].cast("timestamp")).alias("value_us"), t["invalid"].alias("invalid"))


@query("SELECT o_orderkey, ltrim(split_part(t, '.', 1) || split_part(t, '.', 2), '0') AS unscaled, 2 AS scale, t AS rendered FROM (SELECT o_orderkey, o_totalprice::DECIMAL(15,2)::VARCHAR AS t FROM orders)")
def decimal_codec(spark, sf_dir):
    p = codec.decimal_parts(F.col("o_totalprice").cast("decimal(15,2)").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", p["unscaled"].alias("unscaled"), p["scale"].alias("scale"))
    return rows.withColumn("rendered", codec.decimal_text(F.col("unscaled"), F.col("scale")))


@query("SELECT event_id, file, pos FROM (SELECT event_id, 'binlog.' || lpad(file_no::VARCHAR, 6, '0') AS file, pos FROM {changes})")
def cursor_codec(spark, sf_dir):
    """Positions through their encoded form and back."""
    file = F.concat(F.lit("binlog."), F.lpad(F.col("file_no").cast("string"), 6, "0"))
    d = cursors.mysql_decode(cursors.mysql_encode(file, F.col("pos")))
    return changes(spark, sf_dir).select("event_id", d["file"].alias("file"), d["position"].alias("pos"))


@query("SELECT l_orderkey, l_linenumber, CASE ordinal WHEN 0 THEN '' WHEN 1 THEN 'alpha' WHEN 2 THEN 'beta' WHEN 3 THEN 'gamma' END AS label, array_to_string(list_filter(['a', 'b', 'c'], lambda m: (mask >> (list_position(['a', 'b', 'c'], m) - 1)::INTEGER) & 1 = 1), ',') AS members FROM (SELECT l_orderkey, l_linenumber, (l_orderkey % 5)::INTEGER AS ordinal, (l_partkey % 8)::INTEGER AS mask FROM lineitem)")
def enum_set_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 5).alias("ordinal"), (F.col("l_partkey") % 8).alias("mask"))
    return rows.select("l_orderkey", "l_linenumber", codec.enum_label(F.col("ordinal"), ["alpha", "beta", "gamma"]).alias("label"), F.array_join(codec.set_labels(F.col("mask"), ["a", "b", "c"]), ",").alias("members"))


@query("SELECT user_id, event_id AS event_id, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM {changes}) WHERE rn = 1 AND operation <> 'delete'")
def fold_into_target(spark, sf_dir):
    """The first half of the log makes the target; the second is folded into it."""
    rows = changes(spark, sf_dir)
    b = rows.agg(F.max("event_id")).first()[0] // 2
    target = apply.fold(None, rows.filter(F.col("event_id") <= b), ["user_id"], ["event_id", "value"], ORDER)
    return apply.fold(target, rows.filter(F.col("event_id") > b), ["user_id"], ["event_id", "value"], ORDER)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log as whole transactions with images. Events break rules by their number: 3 modulo 7
    has no schema, 5 modulo 11 no native type, 6 modulo 13 a value out of range, 8 modulo 17 an
    insert with a before-image."""
    n, op = F.col("event_id"), F.col("operation")
    native = F.when(n % 11 == 5, "").otherwise("decimal(12,2)")
    integer = F.when(n % 13 == 6, '{"type":"integer","signed":true,"bits":8,"value":"300"}').otherwise(F.concat(F.lit('{"type":"integer","signed":true,"bits":64,"value":"'), F.col("user_id").cast("string"), F.lit('"}')))
    decimal = F.concat(F.lit('{"type":"decimal","unscaled":"'), F.round(F.col("value") * 100).cast("long").cast("string"), F.lit('","scale":2}'))

    def datum(ordinal, name, type_, key, presence, value):
        parts = {"ordinal": F.lit(ordinal).cast("long"), "name": F.lit(name), "native_type": type_, "primary_key_ordinal": F.lit(key).cast("long"), "generated": F.lit(False), "collation": F.lit(None).cast("string"), "presence": presence, "value": value}
        return F.struct(*(v.alias(k) for k, v in parts.items()))

    key = datum(0, "id", F.lit("bigint"), 0, F.lit("value"), integer)
    image = lambda presence: F.array(key, datum(1, "value", native, None, presence, F.when(presence == "value", decimal)))
    none = F.lit(None).cast(model.IMAGE)
    before = F.when(op != "insert", image(F.lit("unavailable"))).when(n % 17 == 8, image(F.lit("value"))).otherwise(none)
    after = F.when(op == "insert", image(F.lit("value"))).when(op == "update", image(F.col("presence"))).otherwise(none)
    cursor = lambda x: F.struct(F.lit("mysql").alias("format"), x.cast("string").alias("value"), F.concat_ws(":", "file_no", x).alias("display"))
    fields = {"type": F.lit(model.ROW), "operation": op, "schema": F.when(n % 7 == 3, "").otherwise("shop"), "table": F.lit("users"), "source_cursor": cursor(F.col("pos")), "source_timestamp": F.unix_seconds(F.col("ts").cast("timestamp")), "schema_basis": F.lit("catalog"), "before": before, "after": after}
    payload = F.struct(*(fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in model.PAYLOAD))
    rows = changes(spark, sf_dir).select("tx_id", "sequence", payload.alias("c"))
    per = rows.groupBy("tx_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "c"))).alias("s"))
    source = F.struct(F.lit("mysql").alias("kind"), F.lit("8.0.36").alias("version"), F.lit("3e11fa47-71ca-11e1-9e33-c80aa9429562").alias("id"))
    out = per.select(F.col("tx_id").cast("string").alias("id"), F.transform("s", lambda x: x["c"]).alias("changes"), source.alias("source"))
    return out.withColumns({"begin_cursor": F.col("changes")[0]["source_cursor"], "commit_cursor": F.element_at("changes", -1)["source_cursor"]})


@query(
    """WITH c AS (SELECT *, CASE operation WHEN 'insert' THEN (event_id % 17 = 8)::INT ELSE 1 END AS b, (operation <> 'delete')::INT AS a FROM {changes}),
       v AS (SELECT 'table_name_invalid' AS rule_code, (event_id % 7 = 3)::INT AS n FROM c
         UNION ALL SELECT 'before_native_type_missing', b * (event_id % 11 = 5)::INT FROM c UNION ALL SELECT 'after_native_type_missing', a * (event_id % 11 = 5)::INT FROM c
         UNION ALL SELECT 'operation_images_mismatch', (operation = 'insert' AND event_id % 17 = 8)::INT FROM c UNION ALL SELECT 'logical_value.integer_range', (a + b) * (event_id % 13 = 6)::INT FROM c)
       SELECT rule_code, SUM(n)::BIGINT AS n FROM v GROUP BY rule_code HAVING SUM(n) > 0"""
)
def validation_rules(spark, sf_dir):
    return validate.violations(transactions(spark, sf_dir)).groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT tx_id::VARCHAR AS id, COUNT(*) FILTER (event_id % 7 <> 3) AS kept, COUNT(*) FILTER (event_id % 7 <> 3 AND operation <> 'delete') AS after_columns FROM {changes} GROUP BY tx_id")
def image_projection(spark, sf_dir):
    """One mapped table with one column of its images; transactions stay even if emptied."""
    out = project.project(transactions(spark, sf_dir), {("shop", "users"): ["id"]})
    columns = F.aggregate("changes", F.lit(0).cast("long"), lambda n, c: n + F.coalesce(F.size(F.when(c["after"].isNotNull(), c["after"])), F.lit(0)) * F.when(c["after"].isNull(), 0).otherwise(1))
    return out.select("id", F.size("changes").cast("long").alias("kept"), columns.alias("after_columns"))


@query("SELECT tx_id, COUNT(*) FILTER (event_id % 50 = 49) AS bad FROM {changes} GROUP BY tx_id HAVING COUNT(*) FILTER (event_id % 50 = 49) > 0")
def position_contract(spark, sf_dir):
    """Row positions between begin and commit; every tenth transaction's last row lies behind its commit."""
    rows = changes(spark, sf_dir).withColumns({"begin": F.col("tx_id") % 80 * 50 + 3, "commit": F.col("tx_id") % 80 * 50 + F.when(F.col("tx_id") % 10 == 9, 44).otherwise(45)})
    bad = contracts.position_violations(rows, "tx_id", "file_no", "pos", "begin", "commit")
    return bad.groupBy("tx_id").agg(F.count(F.lit(1)).alias("bad"))


@query(
    """SELECT version, id, CASE WHEN version NOT IN ('5.7', '8.0', '8.4') THEN 'version_unsupported' WHEN kind = 'tagged' AND version <> '8.4' THEN 'tagged_gtid_unsupported' WHEN kind = 'none' THEN 'transaction_id_invalid' ELSE '' END AS rule_code
       FROM (VALUES ('5.7'), ('8.0'), ('8.4'), ('9.1')) v(version), (VALUES ('3e11fa47-71ca-11e1-9e33-c80aa9429562:42', 'gtid'), ('3e11fa47-71ca-11e1-9e33-c80aa9429562:tag:42', 'tagged'), ('binlog.000001:4', 'anonymous'), ('x', 'none')) t(id, kind)
       WHERE NOT (version = '9.1' AND kind <> 'gtid')"""
)
def identity_contract(spark, sf_dir):
    uuid = "3e11fa47-71ca-11e1-9e33-c80aa9429562"
    rows = [(v, i) for v in ("5.7", "8.0", "8.4") for i in (f"{uuid}:42", f"{uuid}:tag:42", "binlog.000001:4", "x")] + [("9.1", f"{uuid}:42")]
    v = values_table(spark, rows, "version string, id string")
    source = F.struct(F.lit("mysql").alias("kind"), F.col("version"), F.lit(uuid).alias("id"))
    return v.select("version", "id", F.array_join(contracts.mysql_identity(source, F.col("id")), ",").alias("rule_code"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log as JSON lines with their order in their file."""
    txs = transactions(spark, sf_dir).withColumn("tx", F.col("id").cast("long"))
    out = jsonl.lines(txs)
    return out.select("value", (F.col("tx") * 10 + F.col("sequence")).alias("line_no"), F.floor(F.col("tx") / 80).cast("string").alias("file"), "tx", "sequence")


@query("SELECT kind, COUNT(*) AS n, COUNT(DISTINCT tx_id) AS transactions FROM (SELECT tx_id, 'row_change' AS kind FROM {changes} UNION ALL SELECT DISTINCT tx_id, 'transaction_begin' FROM {changes} UNION ALL SELECT DISTINCT tx_id, 'transaction_commit' FROM {changes}) GROUP BY kind")
def log_scan(spark, sf_dir):
    """The log through its lines, the format gate and the record schema."""
    log = jsonl.gate(jsonl.from_lines(log_lines(spark, sf_dir)))
    return log.filter("format is not null").groupBy(F.col("payload.type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("transaction.id").alias("transactions"))


@query("SELECT tx_id::VARCHAR AS transaction_id, COUNT(*) + 1 AS records FROM {changes} WHERE tx_id % 11 = 3 GROUP BY tx_id")
def unfinished_transactions(spark, sf_dir):
    """Every eleventh transaction lacks its commit record."""
    lines = log_lines(spark, sf_dir).withColumn("last", F.max("sequence").over(Window.partitionBy("tx"))).filter("not (tx % 11 = 3 and sequence = last)")
    return jsonl.unfinished(jsonl.from_lines(lines.drop("last"))).select("transaction_id", "records")


@query(
    """WITH t AS (SELECT tx_id, COUNT(*) AS n FROM {changes} GROUP BY tx_id)
       SELECT tx_id::VARCHAR AS transaction_id, 'sequence_gap' AS rule_code, n - 1 AS violations FROM t WHERE tx_id % 9 = 1 UNION ALL SELECT tx_id::VARCHAR, 'change_count_mismatch', 1 FROM t WHERE tx_id % 9 = 1"""
)
def stream_rules(spark, sf_dir):
    """Every ninth transaction lacks its second row: the rest of its sequence is out of step, and its count differs."""
    lines = log_lines(spark, sf_dir).filter("not (tx % 9 = 1 and sequence = 2)")
    bad = assemble.stream_violations(jsonl.from_lines(lines))
    return bad.groupBy("transaction_id", "rule_code").agg(F.count(F.lit(1)).alias("violations"))


@query("SELECT tx_id::VARCHAR AS id, 1::BIGINT AS tables, COUNT(*) AS changes FROM {changes} WHERE event_id % 7 <> 3 GROUP BY tx_id HAVING COUNT(*) FILTER (event_id % 7 <> 3) > 0")
def tables_in_transactions(spark, sf_dir):
    """Rows without a schema go first; the rest are of one table."""
    kept = project.project(transactions(spark, sf_dir), {("shop", "users"): None})
    return checks.tables_of(kept).filter("changes > 0")


@query("SELECT event_id, operation, 'id' AS key_columns, operation = 'insert' OR event_id % 11 <> 5 AS full FROM {changes} WHERE operation <> 'delete'")
def row_locators(spark, sf_dir):
    """The key of each image in key order, and whether the image is complete: every eleventh update lacks a column."""
    rows = transactions(spark, sf_dir).select(F.col("id").cast("long").alias("tx"), F.posexplode("changes").alias("i", "c")).filter("c.operation != 'delete'")
    n = F.col("tx") * 5 + F.col("i")
    cut = F.when((n % 11 == 5) & (F.col("c.operation") == "update"), F.slice("c.after", 2, 1)).otherwise(F.col("c.after"))
    keys = F.array_join(F.transform(project.locator(F.col("c.after")), lambda d: d["name"]), ",")
    return rows.select(n.alias("event_id"), F.col("c.operation").alias("operation"), keys.alias("key_columns"), contracts.full_image(cut).alias("full"))


@query(
    """SELECT rule_code, COUNT(*) AS n FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'after_columns_not_unique' WHEN 1 THEN 'after_key_ordinals_invalid' WHEN 2 THEN 'after_key_value_missing' WHEN 3 THEN 'after_presence_invalid' END AS rule_code FROM {changes} WHERE operation = 'update' AND event_id % 11 <> 5 AND event_id % 7 <> 3)
       WHERE rule_code IS NOT NULL GROUP BY rule_code UNION ALL SELECT 'update_definitions_differ', COUNT(*) FROM {changes} WHERE operation = 'update' AND event_id % 11 <> 5 AND event_id % 7 <> 3 AND event_id % 5 IN (0, 1, 4)"""
)
def image_rules(spark, sf_dir):
    """Updates whose after-image breaks one rule each, by their number: a name twice, keys not from 0, a key that
    isn't sent, a presence of the other image, and a column of another collation."""
    rows = transactions(spark, sf_dir).select(F.col("id").cast("long").alias("tx"), F.posexplode("changes").alias("i", "c")).filter("c.operation = 'update'")
    n = F.col("tx") * 5 + F.col("i")
    key, other = F.col("c.after")[0], F.col("c.after")[1]
    odd = (
        F.when(n % 5 == 0, F.array(key, other.withField("name", F.lit("id"))))
        .when(n % 5 == 1, F.array(key.withField("primary_key_ordinal", F.lit(1).cast("long")), other))
        .when(n % 5 == 2, F.array(key.withField("presence", F.lit("null")).withField("value", F.lit(None).cast("string")), other))
        .when(n % 5 == 3, F.array(key, other.withField("presence", F.lit("unavailable"))))
        .otherwise(F.array(key, other.withField("collation", F.lit("utf8mb4_bin"))))
    )
    rows = rows.filter((n % 11 != 5) & (n % 7 != 3)).select(F.col("c").withField("after", odd).alias("c"))
    return rows.select(F.explode(validate.change_rules(F.col("c"))).alias("rule_code")).groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE o_orderkey % 4 WHEN 1 THEN 'snapshot_presence_invalid' WHEN 2 THEN 'primary_key_required' WHEN 3 THEN 'snapshot_key_missing' END AS rule_code, COUNT(*) AS n, SUM(o_orderkey)::BIGINT AS rows FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY ALL")
def snapshot_rules(spark, sf_dir):
    k = F.col("o_orderkey")
    datum = lambda name, key, presence: F.struct(F.lit(name).alias("name"), key.cast("long").alias("primary_key_ordinal"), presence.alias("presence"))
    image = F.array(datum("id", F.when(k % 4 != 2, 0), F.when(k % 4 == 3, "null").otherwise("value")), datum("status", F.lit(None), F.when(k % 4 == 1, "unchanged").otherwise("value")))
    bad = validate.snapshot_violations(table(spark, sf_dir, "orders").select(k.alias("row_no"), image.alias("image")))
    return bad.groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"), F.sum("row_no").alias("rows"))


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, raw = F.col("c_custkey"), F.col("c_name").cast("binary")
    e = {
        "protocol": F.when(k % 5 == 1, "").otherwise("mysql"), "format": F.lit("binary"), "native_type": F.lit("blob"), "payload": codec.to_base64url(raw),
        "payload_length": F.octet_length(raw) + F.when(k % 5 == 2, 1).otherwise(0), "payload_digest": F.when(k % 5 == 3, "sha256:12").when(k % 5 == 4, digest.bytes_digest(F.encode(F.lit("x"), "UTF-8"))).otherwise(digest.bytes_digest(raw)),
    }
    return table(spark, sf_dir, "customer").select("c_custkey", F.struct(*(v.alias(n) for n, v in e.items())).alias("e"))


@query(
    """SELECT 'source_representation.' || r AS rule_code, COUNT(*) AS n FROM customer JOIN (VALUES (1, 'missing_evidence'), (2, 'payload_length_mismatch'), (3, 'invalid_digest'), (3, 'payload_digest_mismatch'), (4, 'payload_digest_mismatch')) v(m, r) ON c_custkey % 5 = m GROUP BY r"""
)
def envelope_contract(spark, sf_dir):
    rows = _envelopes(spark, sf_dir).select(F.explode(validate.envelope_rules(F.col("e"))).alias("rule_code"))
    return rows.groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'target_capability.carrier_invalid' END AS code, c_custkey % 5 = 0 AS stored FROM customer")
def source_carrier(spark, sf_dir):
    got = convert.RULES["source_representation_carrier"](F.col("e"), {})
    return _envelopes(spark, sf_dir).select("c_custkey", got["code"].alias("code"), got["value"].isNotNull().alias("stored"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 <> 1 THEN '{"type":"set","value":["' || least(c_mktsegment, c_name) || '","' || greatest(c_mktsegment, c_name) || '"]}' END AS value, CASE WHEN c_custkey % 6 = 1 THEN 'target_capability.carrier_invalid' END AS code, c_custkey % 6 <> 1 AS reads_back FROM customer""")
def value_carrier(spark, sf_dir):
    """Sets as their canonical JSON and back; every sixth has a member twice."""
    member = F.when(F.col("c_custkey") % 6 == 1, F.col("c_name")).otherwise(F.col("c_mktsegment"))
    sent = F.concat(F.lit('{"value":["'), F.col("c_name"), F.lit('","'), member, F.lit('"],"type":"set"}'))
    got = convert.RULES["logical_value_carrier"](F.col("sent"), {"length": 200})
    rows = table(spark, sf_dir, "customer").select("c_custkey", sent.alias("sent")).select("c_custkey", "sent", got.alias("got"))
    return rows.select("c_custkey", "got.value", "got.code", F.coalesce(convert.read_back(F.col("sent"), F.col("got.value")), F.lit(False)).alias("reads_back"))


@query("""SELECT event_id, CASE WHEN event_id % 10 <> 4 THEN '{"a":1.50,"k":' || json_extract_string(props, '$.k') || '}' END AS value, CASE WHEN event_id % 10 = 4 THEN 'target_capability.json_normalization_failed' END AS code, event_id % 10 <> 4 AS round_trips FROM events""")
def json_text_rule(spark, sf_dir):
    """JSON as normal text: keys in order, digits kept; a key that stands twice is refused."""
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 10 == 4, F.concat(F.lit('{"k":'), k, F.lit(',"k":1}'))).otherwise(F.concat(F.lit('{ "k" : '), k, F.lit(', "a": 1.50 }')))
    got = convert.RULES["json_text"](F.col("raw"), {"length": 100})
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", got["value"].alias("value"), got["code"].alias("code"), checks.json_round_trips(F.col("raw")).alias("round_trips"))


@query("SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN epoch_us(ts) - 3600000000 END AS instant_us, CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN 'target_capability.temporal_precision_loss' END AS code FROM events")
def instant_rule(spark, sf_dir):
    """Local times one hour east as instants of whole seconds."""
    got = convert.RULES["local_to_instant"](F.col("ts"), {"offset_seconds": 3600, "precision": 0})
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(got["value"]).alias("instant_us"), got["code"].alias("code"))


@query(
    """WITH x AS (SELECT (l_extendedprice * 10)::DECIMAL(12,2) AS p, l_partkey * 100 AS k, l_linestatus || l_returnflag AS s FROM lineitem)
       SELECT 'p' AS "column", 'target_capability.decimal_overflow' AS code, COUNT(*) AS n FROM x WHERE abs(p) >= 100000 UNION ALL SELECT 'k', 'target_capability.integer_overflow', COUNT(*) FROM x WHERE k > 32767 UNION ALL SELECT 's', 'target_capability.text_length_overflow', COUNT(*) FROM x WHERE length(s) > 1"""
)
def planned_conversion(spark, sf_dir):
    """Line items through the plans of four columns, three of which are narrower in the target."""
    t, f = types.LogicalType, types.FieldDefinition
    wide = [f("id", 0, "bigint", t("integer", bits=64, signed=True), False, 0), f("p", 1, "decimal(12,2)", t("decimal", precision=12, scale=2)), f("k", 2, "bigint", t("integer", bits=64, signed=True)), f("s", 3, "varchar(9)", t("text", length=9, unit="characters", charset="utf8mb4"))]
    narrow = [wide[0], f("p", 1, "decimal(7,2)", t("decimal", precision=7, scale=2)), f("k", 2, "smallint", t("integer", bits=16, signed=True)), f("s", 3, "varchar(1)", t("text", length=1, unit="characters", charset="utf8mb4"))]
    entries = [c for c in manifest.build("mysql") if c.code != "mysql.explicit.text"]
    asked = planner.plan_table(wide, narrow, entries)
    plans = planner.plan_table(wide, narrow, entries, confirmed={p.digest for p in asked})
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_extendedprice") * 10).cast("decimal(12,2)").alias("p"), (F.col("l_partkey") * 100).alias("k"), F.concat("l_linestatus", "l_returnflag").alias("s"))
    bad = planner.compile_plan(rows, plans).select(F.inline("conversion_failures")).withColumn("n", F.lit(1))
    # A narrower column that loses nothing counts 0.
    codes = {"p": "decimal_overflow", "k": "integer_overflow", "s": "text_length_overflow"}
    none = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(f"target_capability.{code}").alias("code"), F.lit(0).alias("n")) for c, code in codes.items()))))
    return bad.union(none).groupBy("column", "code").agg(F.sum("n").alias("n"))


@query("SELECT l_returnflag, SUM(l_orderkey)::BIGINT AS total, NULL::VARCHAR AS rule_code FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1 UNION ALL SELECT DISTINCT l_returnflag, NULL::BIGINT, 'integer_overflow' FROM lineitem WHERE l_returnflag = 'R'")
def overflow_checked_sum(spark, sf_dir):
    big = F.when(F.col("l_returnflag") == "R", F.lit(2**62)).otherwise(F.col("l_orderkey"))
    return checks.checked_sum(table(spark, sf_dir, "lineitem").withColumn("x", big), ["l_returnflag"], "x")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def exists_probe(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return checks.with_matches(table(spark, sf_dir, "orders").select("o_orderkey"), items, ["o_orderkey"])


@query("SELECT event_id, epoch_us(ts) AS instant_us, '3e11fa47-71ca-11e1-9e33-c80aa9429562:' || CASE WHEN event_id % 2 = 0 THEN 'tag:' ELSE '' END || event_id AS gtid, hex(props::BLOB) AS round_trip FROM events")
def wire_codecs(spark, sf_dir):
    """Unix time texts, transaction ids of binary sources, and base64url there and back."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    text = F.concat(F.floor(us / 1_000_000).cast("string"), F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0"))
    sid = F.unhex(F.lit("3e11fa4771ca11e19e33c80aa9429562"))
    tag = F.when(F.col("event_id") % 2 == 0, "tag").otherwise("")
    back = codec.from_base64url(codec.to_base64url(F.col("props").cast("binary")))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(codec.unix_instant(text)).alias("instant_us"), codec.gtid(sid, F.col("event_id"), tag).alias("gtid"), F.hex(back).alias("round_trip"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 1 - year(o_orderdate) ELSE year(o_orderdate) END AS year, CASE WHEN o_orderkey % 7 <> 0 THEN month(o_orderdate)::INTEGER END AS month, CASE WHEN o_orderkey % 7 <> 0 THEN day(o_orderdate)::INTEGER END AS day, CASE WHEN o_orderkey % 7 = 0 THEN 'infinity' END AS infinity, (o_orderkey % 30)::INTEGER AS months, (o_custkey % 40)::INTEGER AS days, o_custkey % 50 * 60000000 + 1500000 AS microseconds FROM orders")
def pg_temporal(spark, sf_dir):
    """Dates with era and infinity, and intervals whose parts stay apart."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    date = F.when(k % 7 == 0, "infinity").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 5 == 0, " BC").otherwise("")))
    interval = F.concat(F.lit("P"), F.floor(k % 30 / 12).cast("string"), F.lit("Y"), (k % 30 % 12).cast("string"), F.lit("M"), (c % 40).cast("string"), F.lit("DT"), (c % 50).cast("string"), F.lit("M1.5S"))
    return table(spark, sf_dir, "orders").select(k, date.alias("d"), interval.alias("i")).select("o_orderkey", codec.pg_date(F.col("d")).alias("d"), codec.iso_interval(F.col("i")).alias("i")).select("o_orderkey", "d.*", "i.*")


def _orders_route(spark: SparkSession) -> runner.Route:
    import uuid

    return runner.Route(spark, f"{storage.shared_folder(spark)}/route-{uuid.uuid4().hex}", ["id"], ["status", "total"], buckets=16)


def _order_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Inserts of all orders; and changes of them: every third moves to another key with its status unchanged,
    every fifth of the others goes, and the rest get another total."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    place = lambda tx: {"tx_id": F.lit(tx), "file_no": F.lit(1).cast("long"), "pos": F.lit(100 * tx).cast("long"), "sequence": k}
    first = o.select(*(v.alias(n) for n, v in place(1).items()), F.lit("insert").alias("operation"), k.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    op = F.when((k % 3 != 0) & (k % 5 == 0), "delete").otherwise("update")
    there = F.when((k % 3 != 0) & (k % 5 == 0), "unavailable")
    second = o.select(
        *(v.alias(n) for n, v in place(2).items()), op.alias("operation"), F.when(k % 3 == 0, k + 10_000_000).otherwise(k).alias("id"), k.alias("old_id"),
        F.lit(None).cast("string").alias("status"), F.coalesce(there, F.lit("unchanged")).alias("presence_status"), F.when(k % 3 != 0, F.col("o_totalprice") + 1).alias("total"), F.coalesce(there, F.when(k % 3 == 0, "unchanged").otherwise("value")).alias("presence_total"),
    )
    return first, second


_AFTER = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS total FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0"


@query(_AFTER)
def route_apply(spark, sf_dir):
    """Inserts, their delivery again, and moves, deletes and updates with unchanged columns, through a route."""
    route = _orders_route(spark)
    first, second = _order_changes(spark, sf_dir)
    assert [route.apply(b) for b in (first, first, second, second)] == ["applied", "already_applied", "applied", "already_applied"]
    return route.table.read().select("id", "status", "total")


@query(_AFTER)
def snapshot_start(spark, sf_dir):
    """A snapshot and its position in one commit; changes up to it are in it already, later ones follow."""
    route = _orders_route(spark)
    first, second = _order_changes(spark, sf_dir)
    route.snapshot(first, (1, 100))
    assert [route.apply(b) for b in (first, second)] == ["already_applied", "applied"]
    return route.table.read().select("id", "status", "total")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, assembly, projection and replay in one: the last live row of each user."""
    return replay_latest_state(spark, sf_dir)
