"""Streams of change records into a versioned target."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import model
from ..storage import VersionedTable, resolve_commit

ASSEMBLED = "source_id string, transaction_id string, change_count long, cursor string, head string, records string"


class Assembler(StatefulProcessor):
    """Buffers the records of a source until their transaction's commit and emits it whole.
    A record out of order is an error, never dropped."""

    def __init__(self, most_bytes: int = model.MAX_TRANSACTION_BYTES, most_rows: int = model.MAX_ROWS):
        self.most_bytes, self.most_rows = most_bytes, most_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", "record string")
        self.open = handle.getValueState("open", "id string, sequence long, bytes long, last string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.open.get() if self.open.exists() else None
        tx, seq, size, last = state if state is not None and state[0] else (None, -1, 0, state[3] if state is not None else "")
        fresh: list[tuple[str]] = []
        out = []
        records = pd.concat(list(rows), ignore_index=True).sort_values(["order_key", "sequence"], kind="stable")
        for r in records.itertuples(index=False):
            if r.kind == model.BEGIN:
                if tx is not None or r.sequence != 0:
                    raise ValueError("change_event.validation_failed: nested transaction or invalid begin sequence")
                if last and r.order_key <= last:
                    raise ValueError("change_event.validation_failed: transaction out of order")
                tx, seq, size = r.transaction_id, 0, 0
                self.pending.clear()
                fresh = []
                continue
            if tx is None or r.transaction_id != tx or r.sequence != seq + 1:
                raise ValueError("change_event.validation_failed: interleaved transaction or inconsistent sequence")
            seq, size = int(r.sequence), size + len(r.record)
            if size > self.most_bytes or seq > self.most_rows + 1:
                raise ValueError("change_event.validation_failed: transaction too large")
            if r.kind == model.ROW:
                fresh.append((r.record,))
                continue
            kept = [x[0] for x in self.pending.get()] + [x[0] for x in fresh]
            if r.change_count != len(kept):
                raise ValueError("change_event.validation_failed: change count differs")
            out.append((key[0], tx, len(kept), r.order_key, r.head, "[" + ",".join(kept) + "]"))
            self.pending.clear()
            fresh, tx, last = [], None, r.order_key
        if fresh:
            self.pending.appendList(fresh)
        self.open.update((tx or "", seq, size, last))
        if out:
            yield pd.DataFrame(out, columns=["source_id", "transaction_id", "change_count", "cursor", "head", "records"])

    def close(self) -> None:
        pass


def assemble_stream(log: DataFrame, order_key: Column, head: Column | None = None) -> DataFrame:
    """Whole transactions of a stream of records; ``order_key`` is text that sorts as the source's cursors do, and
    ``head`` a text that the transaction keeps from its commit record."""
    flat = log.select(
        F.col("source.id").alias("source_id"),
        F.col("transaction.id").alias("transaction_id"),
        F.col("transaction.sequence").alias("sequence"),
        F.col("payload.type").alias("kind"),
        F.coalesce("payload.change_count", F.lit(-1)).alias("change_count"),
        order_key.alias("order_key"),
        (F.lit("") if head is None else head).alias("head"),
        F.to_json("payload").alias("record"),
    )
    return flat.groupBy("source_id").transformWithStateInPandas(statefulProcessor=Assembler(), outputStructType=ASSEMBLED, outputMode="append", timeMode="none")


#: Driver error codes by what they mean; fixed values.
CODES = {
    "mysql": {"lock_timeout": ("1205", "1213"), "constraint_failed": ("1022", "1048", "1062", "1216", "1217", "1451", "1452")},
    "postgresql": {"lock_timeout": ("40001", "40P01", "55P03")},
}
RETRYABLE = ("connection_failed", "lock_timeout")


def classify(vendor: Column, code: Column, connected: Column) -> Column:
    """The class of a target's failure."""
    out = F.lit("sql_error")
    for v, kinds in CODES.items():
        for kind, codes in kinds.items():
            out = F.when((vendor == v) & code.isin(*codes), kind).otherwise(out)
    out = F.when((vendor == "postgresql") & code.startswith("23"), "constraint_failed").when((vendor == "postgresql") & code.startswith("08"), "connection_failed").otherwise(out)
    return F.concat(F.lit("target_apply."), F.when(~connected, "connection_failed").otherwise(out))


def retryable(kind: Column) -> Column:
    return kind.isin(*(f"target_apply.{k}" for k in RETRYABLE))


def with_retries(step: Callable[[], None], kind_of: Callable[[Exception], str], most: int = 3, first_wait: float = 0.1, sleep: Callable[[float], None] = time.sleep) -> None:
    """Runs a step again after a failure that may pass: at most ``most`` times, waiting twice as long each."""
    for turn in range(most + 1):
        try:
            return step()
        except Exception as e:
            if turn == most or kind_of(e) not in RETRYABLE:
                raise
            sleep(first_wait * 2**turn)


class Route:
    """Applies the changes of whole transactions to a versioned target with its checkpoint.

    ``changes`` carry tx_id, file_no, pos (those of the commit), sequence, operation, key columns and
    values; and, where the source has them, ``old_<key>`` (the key before the change), ``presence_<column>`` and
    ``prefix`` (of the log files' names). Changes at or before the checkpoint are applied already and skipped; more
    of the last transaction is an error, as it was no whole one. A batch left empty moves only the position in memory
    (``observed``), which the next commit takes along.

    An unchanged column keeps the row's value, from the batch or from the target. An update
    may move a row to another key; the keys that moves connect are replayed in order, all other keys by
    aggregations. Only buckets of changed keys are read and written.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], columns: list[str], strict: bool = True, buckets: int = 256):
        self.spark, self.table = spark, VersionedTable(spark, path, key, buckets)
        self.key, self.columns, self.strict = key, columns, strict
        self.observed: tuple[int, int] | None = None

    def checkpoint(self) -> dict:
        m = self.table.manifest()
        return m["checkpoint"] if m else {"cursor": None, "prefix": None, "last_transaction_id": None, "last_sequence": 0, "applied_transactions": 0, "applied_rows": 0, "revision": 0}

    def _whole(self, changes: DataFrame) -> DataFrame:
        """Changes with the columns they may lack."""
        more = {f"old_{k}": F.col(k) for k in self.key} | {f"presence_{c}": F.when(F.col("operation") == "delete", "unavailable").otherwise("value") for c in self.columns} | {"prefix": F.lit("")}
        return changes.withColumns({n: v for n, v in more.items() if n not in changes.columns})

    def apply(self, changes: DataFrame, batch_id: int = 0) -> str:
        from .. import storage
        from ..operators import apply, cursors

        changes = self._whole(changes)
        m, cp = self.table.manifest(), self.checkpoint()
        fresh = changes
        if cp["cursor"]:
            cursor = tuple(cp["cursor"])
            same = (F.col("file_no") == cursor[0]) & (F.col("pos") == cursor[1])
            wrong = changes.agg(F.max((same & (F.col("tx_id").cast("string") == cp["last_transaction_id"]) & (F.col("sequence") > cp["last_sequence"])).cast("int")).alias("split"), F.max((F.col("prefix") != (cp["prefix"] or "")).cast("int")).alias("other")).first()
            if wrong["other"]:
                raise ValueError("target_apply.sql_error: the source's log files have another name")
            if wrong["split"]:
                raise ValueError("target_apply.sql_error: a transaction came in parts")
            fresh = cursors.beyond(changes, cursor)
        head = fresh.agg(F.max(F.struct("file_no", "pos", "tx_id", "sequence", "prefix")).alias("top"), F.countDistinct("tx_id").alias("txs"), F.count(F.lit(1)).alias("n")).first()
        if not head["n"]:
            top = changes.agg(F.max(F.struct("file_no", "pos")).alias("top")).first()["top"]
            if top is not None:
                self.observed = max(self.observed or (0, 0), tuple(top))
            return "already_applied"
        fresh = storage.settle(fresh)
        old = [F.col(f"old_{k}").alias(k) for k in self.key]
        keys = storage.settle(fresh.select(*self.key).union(fresh.select(*old)).distinct())
        touched = {r[0] for r in keys.select(self.table.bucket(m)).distinct().collect()}  # as many as buckets
        target = self.table.read(touched)
        order = ["file_no", "pos", "sequence"]
        rows = self._moved(target, fresh, keys, order)
        cursor = max((head["top"]["file_no"], head["top"]["pos"]), self.observed or (0, 0))
        top = head["top"]
        after = {"cursor": list(cursor), "prefix": top["prefix"], "last_transaction_id": str(top["tx_id"]), "last_sequence": top["sequence"], "applied_transactions": cp["applied_transactions"] + head["txs"], "applied_rows": cp["applied_rows"] + head["n"], "revision": cp["revision"] + 1, "phase": "incremental"}
        self.table.commit(rows, after, m["version"] if m else None, touched if m else None)
        self.observed = None
        return "applied"

    def _moved(self, target: DataFrame | None, fresh: DataFrame, keys: DataFrame, order: list[str]) -> DataFrame:
        """The rows of the touched buckets after the changes."""
        from .. import storage
        from ..operators import apply

        name = F.to_json(F.struct(*self.key), {"ignoreNullFields": "false"})
        old_name = F.to_json(F.struct(*(F.col(f"old_{k}").alias(k) for k in self.key)), {"ignoreNullFields": "false"})
        moves = fresh.select(old_name.alias("a"), name.alias("b")).filter("a != b").distinct()
        if moves.isEmpty():
            return self._stay(target, fresh, order)
        comp = apply.components_of(moves)
        tied = fresh.join(comp.withColumnRenamed("node", "__n"), name == F.col("__n")).drop("__n")
        free = fresh.join(comp.withColumnRenamed("node", "__n"), name == F.col("__n"), "left_anti")
        parts = tied.select("component", F.lit(1).alias("kind"), *order, "operation", *self.key, *(f"old_{k}" for k in self.key), *self.columns, *(f"presence_{c}" for c in self.columns))
        rest = target
        if target is not None:
            held = target.join(comp.withColumnRenamed("node", "__n"), name == F.col("__n")).drop("__n")
            rest = target.join(comp.withColumnRenamed("node", "__n"), name == F.col("__n"), "left_anti")
            parts = parts.unionByName(held.select("component", F.lit(0).alias("kind"), *(F.lit(0).cast("long").alias(o) for o in order), F.lit("insert").alias("operation"), *self.key, *(F.col(k).alias(f"old_{k}") for k in self.key), *self.columns, *(F.lit("value").alias(f"presence_{c}") for c in self.columns)))
        kinds = ", ".join(f"`{n}` {fresh.schema[n].dataType.simpleString()}" for n in [*self.key, *self.columns, *order])
        # A replay takes any number of whole components; some thousand rows at a time, unless one has more.
        parts = storage.settle(parts)
        groups = max(1, -(-parts.count() // 5000))
        done = storage.settle(parts.groupBy(F.pmod(F.xxhash64("component"), F.lit(groups)).alias("g")).applyInPandas(apply._replay(self.key, self.columns, self.strict), f"{kinds}, rule_code string"))
        self._refuse(done.filter("rule_code is not null").orderBy(*order))
        return self._stay(rest, free, order).unionByName(done.select(*self.key, *self.columns))

    def _stay(self, target: DataFrame | None, changes: DataFrame, order: list[str]) -> DataFrame:
        """Changes that move no row to another key."""
        from ..operators import apply

        if self.strict:
            self._refuse(apply.strict_violations(changes, self.key, "file_no", order, target=target).orderBy(*order))
        carried = changes
        for c in self.columns:
            # The carry names a value's history; what the target holds comes before all of it.
            carried = apply.unchanged_carry(carried.withColumn("__new", F.col(f"presence_{c}")), self.key, "file_no", order, c, "__new", keep_missing="__gap").withColumnRenamed("__gap", f"gap_{c}").drop("__new")
        last = apply.fold(None, carried, self.key, [*self.columns, *(f"gap_{c}" for c in self.columns)], order)
        if target is None:
            return last.select(*self.key, *self.columns)
        held = target.select(*self.key, *(F.col(c).alias(f"held_{c}") for c in self.columns))
        put = last.join(held, self.key, "left").select(*self.key, *(F.when(F.col(f"gap_{c}"), F.col(f"held_{c}")).otherwise(F.col(c)).alias(c) for c in self.columns))
        return target.select(*self.key, *self.columns).join(changes.select(*self.key).distinct(), self.key, "left_anti").unionByName(put)

    @staticmethod
    def _refuse(bad: DataFrame) -> None:
        first = bad.limit(1).collect()
        if first:
            raise ValueError(f"target_apply.constraint_failed: {first[0]['rule_code']}")

    def apply_transactions(self, transactions: DataFrame, schema: str, table: str, plans: list | None = None, batch_id: int = 0) -> str:
        """Whole transactions of a source: contract rules first, then projection to the route's table, the values'
        conversion by ``plans`` if there are any, and the target."""
        from .. import storage
        from ..operators import flatten, project, validate
        from ..plans import planner

        whole = validate.strict(storage.settle(transactions))
        flat = flatten.flat_changes(project.project(whole, {(schema, table): None}), schema, table, self.key, self.columns)
        if plans:
            flat = planner.reject_failures(planner.compile_plan(flat, plans))
        done = self.apply(flat, batch_id)
        if done == "already_applied":
            # Transactions that no route's table is part of count by their position.
            at = whole.select(flatten.position(F.col("source.kind"), F.col("commit_cursor")).alias("at")).agg(F.max(F.struct("at.file_no", "at.pos")).alias("top")).first()["top"]
            if at is not None:
                self.observed = max(self.observed or (0, 0), tuple(at))
        return done

    def snapshot(self, rows: DataFrame, cursor: tuple[int, int], prefix: str = "") -> int:
        """Starts an empty target with a consistent snapshot: rows and the position they were read at are one commit, behind
        which changes go on. A null or repeated key, or a target that has rows, is an error."""
        from .. import storage

        if self.table.manifest() is not None:
            raise ValueError("target_apply.constraint_failed: the target isn't empty")
        rows = storage.settle(rows.select(*self.key, *self.columns))
        null = F.lit(False)
        for k in self.key:
            null |= F.col(k).isNull()
        self._refuse(rows.filter(null).select(F.lit("snapshot_key_missing").alias("rule_code")))
        twice = rows.groupBy(*self.key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        self._refuse(twice.select(F.lit("duplicate_key").alias("rule_code")))
        n = rows.count()
        cp = self.checkpoint() | {"cursor": list(cursor), "prefix": prefix, "applied_rows": n, "revision": 1, "phase": "incremental"}
        self.table.commit(rows, cp, None)
        return n

    def resolve(self, tx_id: str, cursor: tuple[int, int]) -> str:
        """What became of a commit whose answer was lost."""
        cp = self.checkpoint()
        have = tuple(cp["cursor"]) if cp["cursor"] else None
        return resolve_commit({"last_transaction_id": cp["last_transaction_id"], "cursor": have} if have else None, tx_id, cursor, have is None or have < cursor)

    def stop(self) -> None:
        """Commits the position of the last emptied batch."""
        m = self.table.manifest()
        if self.observed and m and tuple(m["checkpoint"]["cursor"]) < self.observed:
            self.table.commit(self.table.read(set()), m["checkpoint"] | {"cursor": list(self.observed), "last_sequence": 0, "revision": m["checkpoint"]["revision"] + 1}, m["version"], set())
            self.observed = None

    def start(self, changes: DataFrame, checkpoint: str, follow: bool = False):
        """A streaming query of flat changes into the target: all there is, or following every 250 ms."""
        return self._started(changes, lambda df, i: self.apply(df, i), checkpoint, follow)

    def start_log(self, log: DataFrame, schema: str, table: str, checkpoint: str, follow: bool = False, plans: list | None = None):
        """A streaming query of change records into the target. Records are assembled first, so that only whole
        transactions, those with a commit record, reach it; failures that may pass are retried."""
        flat = log.withColumn("head", F.struct("source", F.col("transaction.id").alias("id"), F.col("transaction.begin_cursor").alias("begin_cursor"), F.col("transaction.commit_cursor").alias("commit_cursor")))
        whole = assemble_stream(flat, order_text(flat), F.to_json("head"))

        def step(df: DataFrame, i: int) -> None:
            head = F.from_json("head", flat.schema["head"].dataType)
            txs = df.select(head.alias("h"), F.from_json("records", T.ArrayType(model.PAYLOAD)).alias("changes")).select("h.source", "h.id", "h.begin_cursor", "h.commit_cursor", "changes")
            with_retries(lambda: self.apply_transactions(txs, schema, table, plans, i), lambda e: "connection_failed" if "connect" in str(e).lower() else "sql_error")

        return self._started(whole, step, checkpoint, follow)

    @staticmethod
    def _started(changes: DataFrame, step, checkpoint: str, follow: bool):
        writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime="250 milliseconds") if follow else writer.trigger(availableNow=True)).start()


def order_text(log: DataFrame) -> Column:
    """Text that sorts as the commit cursors of a log's records do: file number and position, or LSN."""
    from ..operators import flatten

    at = flatten.position(F.col("source.kind"), F.col("transaction.commit_cursor"))
    return F.concat(F.lpad(at["file_no"].cast("string"), 20, "0"), F.lit(":"), F.lpad(at["pos"].cast("string"), 20, "0"))
