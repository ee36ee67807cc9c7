"""Views of the driver's tables as audit data, and golden rows joined to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the audit view, as expressions that Spark and the oracle both read.
_COLUMNS = {
    "event_id": "event_id",
    "kind": "CASE WHEN event_type = 'signup' THEN 'heartbeat' ELSE 'event' END",
    "ts": "ts",
    "user_name": "concat('u', CAST(user_id AS STRING))",
    "host": "concat('h', CAST(user_id % 7 AS STRING))",
    "session_id": "concat('s', CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING))",
    "agent_id": "CASE WHEN event_id % 11 = 0 THEN concat('agent-', CAST(event_id % 3 AS STRING)) END",
    "event": "CASE event_type WHEN 'error' THEN 'PreToolUse' WHEN 'click' THEN 'PostToolUse' WHEN 'view' THEN 'ConfigChange' ELSE 'SessionStart' END",
    "rule": "CASE event_id % 8 WHEN 0 THEN 'command-sudo' WHEN 1 THEN 'git-reset-hard' WHEN 2 THEN 'git-push-force-other' WHEN 3 THEN 'path-ssh-key' WHEN 4 THEN 'injection-role-hijack' WHEN 5 THEN 'command-chmod-world' WHEN 6 THEN 'command-history-clear' END",
    "class": "CASE event_id % 8 WHEN 0 THEN 'privilege' WHEN 1 THEN 'git-destructive' WHEN 2 THEN 'git-destructive' WHEN 3 THEN 'path-sensitive' WHEN 4 THEN 'injection' WHEN 5 THEN 'command-destructive' WHEN 6 THEN 'anti-forensics' END",
    "severity": "CASE event_id % 8 WHEN 0 THEN 'CRITICAL' WHEN 2 THEN 'MEDIUM' WHEN 6 THEN 'MEDIUM' WHEN 7 THEN 'LOW' ELSE 'HIGH' END",
    "action": "CASE event_id % 5 WHEN 0 THEN 'denied' WHEN 1 THEN 'asked' WHEN 2 THEN 'warned' WHEN 3 THEN 'logged' END",
    "target": "concat('t', CAST(event_id % 4 AS STRING))",
    "latency_ms": "CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value * 3) AS INT) END",
    "policy_tampered": "event_id % 17 = 0",
    "wsl": "event_id % 6 <> 0",
}

AUDIT_SQL = "audit AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _COLUMNS.items()) + " FROM events)"
WITH = f"WITH {AUDIT_SQL} "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*(F.expr(e).alias(n) for n, e in _COLUMNS.items()))


def literal(value: object) -> str:
    """A value in SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]" if value else "CAST([] AS VARCHAR[])"
    return "'" + str(value).replace("'", "''") + "'"


def golden(spark: SparkSession, sf_dir: str, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """Every event with one of the given inputs: event_id and the columns of schema. The inputs are a constant, so they are broadcast."""
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"idx long, {schema}")
    events = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(rows)).alias("idx"))
    return events.join(F.broadcast(given), "idx").drop("idx")


def expected(columns: Sequence[str], rows: Sequence[tuple]) -> str:
    """The oracle of a golden query: event_id and the expected columns, written by hand."""
    values = ", ".join(f"({i}, {', '.join(map(literal, r))})" for i, r in enumerate(rows))
    return f"SELECT event_id, {', '.join('g.' + c for c in columns)} FROM events JOIN (VALUES {values}) AS g(idx, {', '.join(columns)}) ON event_id % {len(rows)} = g.idx"
