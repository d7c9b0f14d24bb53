"""Tasks: routes with their plans, their states, and who runs them."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from .functions import digest
from .plans.planner import Plan

MAX_RUNNING, MAX_TABLES = 16, 100
#: Which state may follow which; fixed values.
NEXT = {
    "stopped": ("starting",),
    "starting": ("running", "failed", "blocked", "stopped"),
    "running": ("stopping", "failed", "blocked"),
    "stopping": ("stopped", "failed"),
    "failed": ("starting",),
    "blocked": ("starting",),
}
BLOCKING = ("conversion_failed", "capability_failed", "constraint_failed", "checkpoint_conflict")


@dataclass(frozen=True)
class TableMapping:
    schema: str
    table: str
    columns: tuple[str, ...] | None = None


@dataclass
class Task:
    id: str
    source: str
    sink: str
    tables: tuple[TableMapping, ...]
    start: str = "snapshot"
    plans: tuple[Plan, ...] = ()
    revision: int = 0
    state: str = "stopped"
    history: list = field(default_factory=list)

    def binding(self) -> str:
        """A digest of what a checkpoint is bound to."""
        return digest.stable({"source": self.source, "sink": self.sink, "tables": [asdict(t) for t in self.tables]})

    def move(self, state: str) -> None:
        if state not in NEXT[self.state]:
            raise ValueError(f"task can't go from {self.state} to {state}")
        self.state = state

    def revise(self, **changes) -> None:
        """A new desired revision; the one before stays in the history."""
        if self.state in ("starting", "running", "stopping"):
            raise ValueError("a running task can't be revised")
        self.history.append({"revision": self.revision, "tables": self.tables, "plans": self.plans})
        for k, v in changes.items():
            setattr(self, k, v)
        self.revision += 1


def preflight(task: Task, others: list[Task], keys: dict[tuple[str, str], list[str]], reserved: tuple[str, ...] = ("mysql", "sys", "information_schema", "performance_schema", "cdc")) -> list[str]:
    """Why a task can't start: codes in order, none if it can."""
    out = []
    if not 1 <= len(task.tables) <= MAX_TABLES:
        out.append("table_count_out_of_range")
    if task.source == task.sink:
        out.append("source_is_target")
    if len({(t.schema, t.table) for t in task.tables}) != len(task.tables):
        out.append("table_mapped_twice")
    for t in task.tables:
        if t.schema.lower() in reserved:
            out.append("reserved_schema")
        key = keys.get((t.schema, t.table))
        if not key:
            out.append("target_capability.primary_key_required")
        elif t.columns is not None and not set(key) <= set(t.columns):
            out.append("selected_columns_lack_key")
    mine = {(task.sink, t.schema, t.table) for t in task.tables}
    if any(o.id != task.id and o.state in ("starting", "running", "stopping") and mine & {(o.sink, t.schema, t.table) for t in o.tables} for o in others):
        out.append("target_overlap")
    out += [p.code for p in task.plans if p.status != "COMPATIBLE"]
    return list(dict.fromkeys(out))


def failure(task: Task, kind: str, transaction_id: str | None, cause: str, vendor_code: str | None = None, phase: str = "apply") -> dict:
    """A failure with its context and no row value."""
    return {
        "code": f"target_apply.{kind}", "route": task.id, "binding": task.binding(), "transaction_id": transaction_id, "plan_set_digest": digest.stable([p.digest for p in task.plans]),
        "phase": phase, "retry": kind in ("connection_failed", "lock_timeout"), "vendor_code": vendor_code, "cause": re.sub(r"[\x00-\x1f\x7f]", " ", cause)[:512], "at": time.time(),
    }


class Manager:
    """Runs tasks, at most MAX_RUNNING at once; a task that fails takes no other with it."""

    def __init__(self, start: Callable[[Task], object], keys: dict[tuple[str, str], list[str]] | None = None):
        self.start_query, self.keys = start, keys or {}
        self.tasks: dict[str, Task] = {}
        self.queries: dict[str, object] = {}
        self.failures: list[dict] = []

    def add(self, task: Task) -> None:
        if task.id in self.tasks:
            raise ValueError("task exists")
        self.tasks[task.id] = task

    def start(self, task_id: str) -> str:
        task = self.tasks[task_id]
        if sum(t.state in ("starting", "running", "stopping") for t in self.tasks.values()) >= MAX_RUNNING:
            raise ValueError("too many running tasks")
        why = preflight(task, list(self.tasks.values()), self.keys)
        task.move("starting")
        if why:
            task.move("blocked")
            self.failures.append(failure(task, "capability_failed", None, ", ".join(why), phase="preflight"))
            return task.state
        try:
            self.queries[task_id] = self.start_query(task)
            task.move("running")
        except Exception as e:
            self.failed(task_id, "sql_error", str(e))
        return task.state

    def failed(self, task_id: str, kind: str, cause: str, transaction_id: str | None = None) -> None:
        task = self.tasks[task_id]
        task.move("blocked" if kind in BLOCKING else "failed")
        self.failures.append(failure(task, kind, transaction_id, cause))

    def stop(self, task_id: str) -> None:
        task = self.tasks[task_id]
        task.move("stopping")
        query = self.queries.pop(task_id, None)
        if query is not None and hasattr(query, "stop"):
            query.stop()
        task.move("stopped")

    def delete(self, task_id: str) -> None:
        if self.tasks[task_id].state in ("starting", "running", "stopping"):
            raise ValueError("task is running")
        del self.tasks[task_id]
