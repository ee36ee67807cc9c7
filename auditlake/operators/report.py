"""Fleet reports over audit records: counts, percentiles, gaps and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import scalars as S


def split_kind(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and heartbeats."""
    beat = F.col("kind").eqNullSafe("heartbeat")
    return df.where(~beat), df.where(beat)


def since(df: DataFrame, bound: str, ts: str = "ts") -> DataFrame:
    """Compares the ISO strings, as the log holds them; a missing time is before any bound."""
    return df.where(F.coalesce(F.col(ts), F.lit("")) >= bound)


def would_block(df: DataFrame) -> DataFrame:
    """P09."""
    return df.where(F.col("severity").isin("CRITICAL", "HIGH"))


def by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows by value, null as '-'."""
    return df.groupBy(F.coalesce(column, F.lit("-")).alias(column)).agg(F.count(F.lit(1)).alias(name))


def counts(df: DataFrame) -> DataFrame:
    """A01."""
    return df.agg(F.count_if(F.col("kind") != "heartbeat").alias("events"), F.count_if(F.col("kind") == "heartbeat").alias("heartbeats"))


def latency_pct(df: DataFrame, *dims: str, value: str = "latency_ms") -> DataFrame:
    """Nearest-rank p50 and p95 of the numbers that are there.

    A histogram by value is built first, so that what is ranked is bounded by the
    number of distinct values, not by the rows.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*dims, value).agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(*dims).orderBy(value)
    ranked = hist.withColumn("_to", F.sum("_n").over(up)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*dims)))
    # 0-based places n // 2 and floor(0.95 n), the last at most n - 1.
    at50, at95 = F.expr("_all div 2"), F.least(F.expr("_all * 95 div 100"), F.col("_all") - 1)
    pick = lambda at: F.min(F.when(F.col("_to") > at, F.col(value)))
    return ranked.groupBy(*dims).agg(pick(at50).alias("p50"), pick(at95).alias("p95"), F.max("_all").alias("n"))


def top(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Values by count, the largest first."""
    ranked = by(df, column).orderBy(F.desc("n"), column)
    return ranked.limit(n) if n else ranked


def heartbeat_gaps(beats: DataFrame, roster: DataFrame, days: DataFrame) -> DataFrame:
    """User and day without a heartbeat. Days are one a calendar day, so the roster times days is the size of the answer's frame."""
    return roster.join(F.broadcast(days.distinct())).join(beats.select("user_name", "day").distinct(), ["user_name", "day"], "left_anti")


def fp_rate(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of false findings by rule over the reviewed ones; above 5 % a rule is demoted."""
    reviewed = findings.join(labels, "event_id")
    rated = reviewed.groupBy("rule").agg(F.count(F.lit(1)).alias("reviewed"), F.round(F.avg(F.when(F.col("false_positive"), 1.0).otherwise(0.0)), 6).alias("fp_rate"))
    return rated.withColumn("demote", F.col("fp_rate") > 0.05)


def never_fired(rules: DataFrame, events: DataFrame, classes: list[str]) -> DataFrame:
    """A18."""
    return rules.where(F.col("class").isin(classes)).join(events.select("rule").distinct(), "rule", "left_anti")


def fleet_rollup(df: DataFrame, *dims: str) -> DataFrame:
    """Counts by user, host, day, class and action, or other dimensions, with subtotals."""
    return df.rollup(*(dims or ("user_name", "host", "day", "class", "action"))).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level_id"))


def cap_rows(df: DataFrame, n: int, by_: list[str], order: list[Column | str]) -> DataFrame:
    """At most n rows of each group, in order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by_).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


# What a record says where its caller doesn't.
RECORD = {"kind": "event", "session_id": None, "agent_id": None, "user_name": None, "host": None, "cwd": None, "repo": None, "git_branch": None, "event": None, "tool": None, "rule": "-", "class": "internal", "severity": "LOW", "level": None, "action": "logged", "target": None}


def to_audit_record(df: DataFrame, evidence: Column, hook: str) -> DataFrame:
    """A full record: defaults, then the given fields, evidence cut and redacted."""
    from auditlake.operators.injection import sanitize_evidence

    field = lambda k, v: F.coalesce(F.col(k), F.lit(v)).alias(k) if k in df.columns else F.lit(v).cast("string").alias(k)
    return df.select("event_id", F.lit(1).alias("v"), F.lit(hook).alias("hook"), *(field(k, v) for k, v in RECORD.items()), sanitize_evidence(evidence).alias("evidence"))


def applicable(df: DataFrame, control: str, controls: dict[str, tuple[str, list[str], str | None]]) -> DataFrame:
    """The rows that a control looks at: its event, one of its tools, and a field that isn't blank. Others get no decision."""
    event, tools, field = controls[control]
    rows = df.where((F.col("event") == event) & F.col("tool").isin(tools))
    return rows.where(F.coalesce(F.trim(field), F.lit("")) != "") if field else rows


def injection_action(confidence: Column, level: Column) -> Column:
    """(action, emitted) of an injection finding: low confidence is only logged, and an audit level says nothing in the context."""
    sure = confidence != "low"
    return F.struct(F.when(sure, "warned").otherwise("logged").alias("action"), (sure & (level != "audit")).alias("emitted"))


def normalise_unless_secret(injections: DataFrame, secrets: DataFrame) -> DataFrame:
    """Injection findings of tool calls (session_id, tool_use_id) without a secret finding."""
    return injections.join(secrets.select("session_id", "tool_use_id").distinct(), ["session_id", "tool_use_id"], "left_anti")


def secret_leaks(raw: DataFrame, column: str, secrets: list[tuple]) -> DataFrame:
    """For every secret rule the number of raw lines that hold one; all rules in one pass over the lines."""
    found = raw.agg(*(F.count_if(F.col(column).rlike(pattern)).alias(kind) for kind, _, pattern in secrets))
    return found.select(F.explode(F.array(*(F.struct(F.lit(kind).alias("rule"), F.col(kind).alias("n")) for kind, _, _ in secrets))).alias("x")).select("x.*")


def weekly_review(audit: DataFrame, labels: DataFrame, most: int = 20) -> DataFrame:
    """(list, name, n): users by days without a heartbeat, and rules by reviewed findings that were false; the first of each."""
    beats, days = split_kind(audit)[1], audit.select("day")
    gaps = heartbeat_gaps(beats, audit.select("user_name").distinct(), days).groupBy(F.col("user_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    false = audit.join(labels.where("false_positive").select("event_id"), "event_id", "left_semi").where("rule is not null").groupBy(F.col("rule").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    first = lambda df, kind: df.orderBy(F.desc("n"), "name").limit(most).select(F.lit(kind).alias("list"), "name", "n")
    return first(gaps, "silent users").unionByName(first(false, "false rules"))


def retention(days: DataFrame, keep: int, today: str) -> DataFrame:
    """Names of day files strictly older than the bound; none if keep is not positive; names that aren't dates stay."""
    if keep <= 0:
        return days.limit(0)
    return days.where(F.expr("try_cast(day AS DATE)") < F.date_sub(F.lit(today).cast("date"), keep))
