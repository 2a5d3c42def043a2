"""Run locks over the task table, and the cost of a query."""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.sources.tables import Store

_ROW = "experiment string, scope string, process_type string, status string, started_at timestamp, updated_at timestamp, locked_by string, error_message string, timeout_seconds int"


def _claims(store: Store, experiment: str, scope: str, process: str) -> list:
    """The last state of every claim.  Claims and their ends are appended, never rewritten, so none is lost."""
    store.create("tasks")
    return store.read("tasks").filter((F.col("experiment") == experiment) & (F.col("scope") == scope) & (F.col("process_type") == process)).collect()


def _holder(claims: list, now: datetime):
    """The earliest claim that is running and not stale."""
    live = [r for r in claims if r["status"] == "running" and r["started_at"] + timedelta(seconds=r["timeout_seconds"]) > now]
    return min(live, key=lambda r: (r["started_at"], r["locked_by"]), default=None)


def active(store: Store, experiment: str, scope: str = "all", process: str = "run", now: datetime | None = None):
    """The lock's row if it is running and not stale."""
    return _holder(_claims(store, experiment, scope, process), now or datetime.now())


def _put(store: Store, experiment: str, scope: str, process: str, status: str, started: datetime, updated: datetime, token: str, error: str | None, timeout: int) -> None:
    store.append("tasks", store.spark.createDataFrame([(experiment, scope, process, status, started, updated, token, error, timeout)], _ROW))


def acquire(store: Store, experiment: str, scope: str = "all", process: str = "run", timeout: int = 3600, now: datetime | None = None, settle: float = 0.0) -> str | None:
    """A token, or None while another run holds the lock.  Advisory: a file table has no compare-and-set.

    The claim is appended; after ``settle`` seconds, in which claims made at the same time
    come to be seen, all are read back, and the earliest (time, token) wins.  A claim that
    lost is ended.
    """
    now = now or datetime.now()
    if active(store, experiment, scope, process, now):
        return None
    token = uuid.uuid4().hex
    _put(store, experiment, scope, process, "running", now, now, token, None, timeout)
    time.sleep(settle)
    won = active(store, experiment, scope, process, now)
    if won is not None and won["locked_by"] == token:
        return token
    _put(store, experiment, scope, process, "lost", now, now + timedelta(microseconds=1), token, None, timeout)
    return None


def release(store: Store, token: str, experiment: str, scope: str = "all", process: str = "run", status: str = "done", error: str | None = None, force: bool = False) -> bool:
    """End a run; only its owner may, unless forced."""
    held = [r for r in _claims(store, experiment, scope, process) if r["status"] == "running"]
    own = [r for r in held if r["locked_by"] == token] or (held if force else [])
    for r in own:
        _put(store, experiment, scope, process, status, r["started_at"], max(datetime.now(), r["updated_at"] + timedelta(microseconds=1)), r["locked_by"], error, r["timeout_seconds"])
    return bool(own)


def scanned_rows(df: DataFrame) -> int:
    """Rows that the scans of an executed DataFrame have read."""
    total = 0
    stack = [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            stack.append(node.plan())
            continue
        children = node.children()
        if name.startswith("Scan") and node.metrics().contains("numOutputRows"):
            total += node.metrics().apply("numOutputRows").value()
        for i in range(children.size()):
            stack.append(children.apply(i))
    return total
