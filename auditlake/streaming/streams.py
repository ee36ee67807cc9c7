"""Structured Streaming forms of the audit jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditlake.functions import scalars as S
from auditlake.sources.audit import stream_audit
from auditlake.sources.tables import ship, stored
from auditlake.sources.tail import drain

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_ingest(spark: SparkSession, source: str, lake: str, checkpoint: str):
    """The log into a lake of days, as far as it is there."""
    rows = stream_audit(spark, source).withColumn("day", F.left("ts", F.lit(10)))
    return drain(rows.writeStream.format("parquet").option("path", lake).option("checkpointLocation", checkpoint).partitionBy("day"))


def rule_counts(df: DataFrame, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts of rules by day, or by days that begin every slide; rows later than the watermark allows are dropped."""
    when = F.window("event_time", "1 day", slide) if slide else F.window("event_time", "1 day")
    return df.withWatermark("event_time", late).groupBy(when.alias("w"), F.coalesce("rule", F.lit("-")).alias("rule")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "rule", "n")


def count_days(df: DataFrame, path: str, late: str = "1 hour"):
    """X02 without loss: a writer of each batch's counts (day, rule, n, late) below `path`, and of its late rows.

    A day's count is the sum over batches, so a late row corrects its day whenever it comes, and no state is kept. Rows that a
    watermark would have dropped, `late` behind the newest time of the batches before, are also written to `path/late`. A
    batch that is repeated replaces what it wrote.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = f"{path}/marks"
        newest = None
        if number:
            newest = spark.read.parquet(marks).where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        limit = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {late}")
        rows = batch.where("event_time IS NOT NULL").withColumn("late", F.coalesce(F.col("event_time").cast("timestamp") < limit, F.lit(False)))
        rows = stored(rows, "counted-batch")
        rows.where("late").drop("late").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        rows.groupBy(F.to_date("event_time").alias("day"), F.coalesce("rule", F.lit("-")).alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late")).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        rows.agg(F.max(F.col("event_time").cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch={number}")

    return df.writeStream.foreachBatch(put)


def counted_days(spark: SparkSession, path: str) -> DataFrame:
    """The counts that count_days has written, corrected by what came late: day, rule, n, late."""
    return spark.read.parquet(f"{path}/counts").groupBy("day", "rule").agg(F.sum("n").alias("n"), F.sum("late").alias("late"))


class _Memory(StatefulProcessor):
    """The time of the last emitted warning of a key; it expires two days after it was written."""

    ttl_ms = 24 * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchor = handle.getValueState("anchor", "t bigint", 48 * 3_600_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["t", "event_id"])
        last = self.anchor.get()[0] if self.anchor.exists() else None
        quiet = []
        for t in batch["t"].tolist():
            hold = last is not None and t - last < self.ttl_ms * 1000
            quiet.append(hold)
            last = last if hold else t
        self.anchor.update((int(last),))
        yield pd.DataFrame({"event_id": batch["event_id"], "suppressed": quiet})

    def close(self) -> None:
        pass


def session_memory(df: DataFrame) -> DataFrame:
    """Warnings of one (session, rule, target, agent) within the time to live of the last emitted one are suppressed.

    State that expires needs processing time; with availableNow also set
    spark.sql.streaming.noDataMicroBatches.enabled to false, or empty batches go on.
    """
    key = S.memory_key(F.col("rule"), F.col("target"), F.col("agent_id"))
    rows = df.where(F.col("decision").isin("warn", "ask")).select("session_id", key.alias("key"), "event_id", F.unix_micros("event_time").alias("t"))
    ship(df.sparkSession)
    return rows.groupBy("session_id", "key").transformWithStateInPandas(_Memory(), "event_id bigint, suppressed boolean", "Append", "ProcessingTime")


class _Trust(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("baseline", "status string, fingerprint string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        status, known = self.state.get() if self.state.exists() else (None, None)
        out = []
        for e in pd.concat(rows).sort_values("seq").itertuples():
            if e.kind == "approve":
                status = "trusted"
            else:
                if status is None:
                    status = "pending" if e.findings else "trusted"
                elif known is not None and e.fingerprint != known:
                    status = "quarantined"
                known = e.fingerprint
            out.append((key[0], e.seq, status))
        self.state.update((status, known))
        yield pd.DataFrame(out, columns=["repo", "seq", "status"])

    def close(self) -> None:
        pass


def trust(df: DataFrame) -> DataFrame:
    """The status of a repository after each of its events (repo, seq, kind, fingerprint, findings)."""
    ship(df.sparkSession)
    return df.groupBy("repo").transformWithStateInPandas(_Trust(), "repo string, seq bigint, status string", "Append", "None")


class _Silence(StatefulProcessor):
    def __init__(self, days: int):
        self.wait = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        seen = max(int(p["t"].max()) for p in rows)
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or seen > before:
            if before is not None:
                self.handle.deleteTimer(before + self.wait)
            self.last.update((seen,))
            self.handle.registerTimer(seen + self.wait)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"user": [key[0]], "silent_since": [since]})

    def close(self) -> None:
        pass


def heartbeat_gap(df: DataFrame, days: int = 3) -> DataFrame:
    """Users without a heartbeat for some days of event time."""
    beats = df.where("kind = 'heartbeat'").withWatermark("event_time", "1 hour").select("user", "event_time", F.unix_millis("event_time").alias("t"))
    ship(df.sparkSession)
    return beats.groupBy("user").transformWithStateInPandas(_Silence(days), "user string, silent_since bigint", "Append", "EventTime")


def conflict(injections: DataFrame, secrets: DataFrame) -> DataFrame:
    """Injection findings whose tool call has no secret finding within an hour, as a stream-stream outer join."""
    a = injections.withWatermark("event_time", "1 hour").alias("a")
    b = secrets.withWatermark("event_time", "1 hour").select(F.col("session_id").alias("s"), F.col("tool_use_id").alias("u"), F.col("event_time").alias("at")).alias("b")
    near = (F.col("a.session_id") == F.col("s")) & (F.col("a.tool_use_id") == F.col("u")) & F.col("at").between(F.col("a.event_time") - F.expr("INTERVAL 1 HOUR"), F.col("a.event_time") + F.expr("INTERVAL 1 HOUR"))
    return a.join(b, near, "leftOuter").where("s IS NULL").select("a.*")


def activity(df: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Windows of activity of a session."""
    w = F.session_window("event_time", gap)
    return df.withWatermark("event_time", "1 hour").groupBy("session_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("session_id", F.col("w.start").alias("first"), F.col("w.end").alias("until"), "n")


def export_stream(spark: SparkSession, source: str, target: str, checkpoint: str):
    """What is new since the last run, each batch written once; a failed run is repeated by the next."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{target}/batch={number}")

    return drain(stream_audit(spark, source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(put))


def read_state(spark: SparkSession, checkpoint: str, variable: str = "anchor") -> DataFrame:
    """The keys and values that a stream holds."""
    spark.streams.active
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
