"""The task store as tables: events in, states, pages, evictions and a tail of log lines out.

``events``: task_id, ts, kind (created, status, progress, log, error) and value.  Batch functions
work on any frame; :func:`tail` is the streaming form of the log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import duration

TERMINAL = ("completed", "failed", "cancelled")


def task_states(events: DataFrame) -> DataFrame:
    """One row a task: created_at, started_at (first processing), completed_at (last end), status (last), progress
    (last), n_logs, n_errors, duration.  One aggregation with map-side combine."""
    at = lambda test: F.when(test, F.col("ts"))
    kind, value = F.col("kind"), F.col("value")
    state = F.struct("ts", "seq")
    ended = (kind == "status") & value.isin("completed", "failed")
    return (
        events.groupBy("task_id")
        .agg(
            F.min("ts").alias("created_at"),
            F.min(at((kind == "status") & (value == "processing"))).alias("started_at"),
            F.max(at(ended)).alias("completed_at"),
            F.coalesce(F.max_by(value, F.when(kind == "status", state)), F.lit("pending")).alias("status"),
            F.max_by(value, F.when(kind == "progress", state)).cast("double").alias("progress"),
            F.count_if(kind == "log").alias("n_logs"),
            F.count_if(kind == "error").alias("n_errors"),
        )
        .withColumn("duration", duration(F.col("started_at"), F.col("completed_at")))
    )


def list_tasks(tasks: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page, newest first."""
    return tasks.orderBy(F.desc("created_at"), "task_id").offset(offset).limit(limit)


def evict(tasks: DataFrame, capacity: int = 1000) -> DataFrame:
    """The newest ``capacity`` tasks.  The oldest that stays is found by a bounded top-k; no global window."""
    newest = tasks.select("created_at", "task_id").orderBy(F.desc("created_at"), F.desc("task_id")).limit(capacity)
    edge = newest.agg(F.min(F.struct("created_at", "task_id")).alias("edge"))
    return tasks.crossJoin(F.broadcast(edge)).where(F.struct("created_at", "task_id") >= F.col("edge")).drop("edge")


def clean_up(tasks: DataFrame, now: Column, max_age: int = 3600) -> DataFrame:
    """Tasks that didn't end more than ``max_age`` seconds ago."""
    old = (F.unix_micros(now) - F.unix_micros(F.col("completed_at").cast("timestamp"))) > max_age * 1_000_000
    return tasks.where(F.col("completed_at").isNull() | ~old)


def log_tail(logs: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` lines of each task, in order."""
    last = Window.partitionBy("task_id").orderBy(F.desc("ts"), F.desc("seq"))
    return logs.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= n).drop("_r")


def log_sessions(logs: DataFrame, gap: str) -> DataFrame:
    """What a reader of the tail sees in batch: stretches of lines without a longer pause than ``gap``."""
    return logs.groupBy("task_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("lines")).select("task_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("idle_at"), "lines")


def tail(stream: DataFrame, idle_ms: int = 30_000) -> DataFrame:
    """Stateful tail of a stream (task_id, ts, kind, value): each log line as it comes; at a terminal status the errors
    so far and ``done``; ``timeout`` after ``idle_ms`` without news."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors, over = state.get if state.exists else ([], False)
        errors, rows = list(errors), []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], None, "info", "timeout")], columns=["task_id", "ts", "level", "message"])
            return
        for row in pd.concat(batches).sort_values("ts").itertuples():
            if over:
                continue
            if row.kind == "log":
                rows.append((key[0], row.ts, "info", row.value))
            elif row.kind == "error":
                errors.append(str(row.value))
            elif row.kind == "status" and row.value in TERMINAL:
                rows += [(key[0], row.ts, "error", f"ERROR: {x}") for x in errors]
                rows.append((key[0], row.ts, "info", "done"))
                over = True
        state.update((errors, over))
        if not over:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["task_id", "ts", "level", "message"])

    return stream.groupBy("task_id").applyInPandasWithState(
        step,
        "task_id string, ts timestamp, level string, message string",
        "errors array<string>, over boolean",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
