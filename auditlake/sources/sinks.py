"""Where audit rows go: the day-partitioned lake, per-host exports, an HTTP collector."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

RESULT = "ok boolean, sent long, skipped long, reason string"


def write_audit(df: DataFrame, path: str) -> None:
    """Append to the lake, one folder a day."""
    df.withColumn("day", F.left("ts", F.lit(10))).write.mode("append").partitionBy("day").json(path)


def result(spark: SparkSession, ok: bool, sent: int = 0, skipped: int = 0, reason: str | None = None) -> DataFrame:
    return spark.createDataFrame([(ok, sent, skipped, reason)], RESULT)


def export_files(df: DataFrame, path: str) -> DataFrame:
    """User, host, day folders, each replaced as a whole; a path that can't be written is a reported failure."""
    spark = df.sparkSession
    try:
        seen = Observation()
        rows = df.withColumn("day", F.left("ts", F.lit(10))).observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("user", "host", "day").json(path)
        return result(spark, True, seen.get["n"])
    except Exception as error:
        return result(spark, False, reason=type(error).__name__)


class HttpSink(DataSource):
    """Posts the rows of each partition, some hundreds at once, as {"records": [...]}; the token's variable is named, never given."""

    @classmethod
    def name(cls) -> str:
        return "audit_http"

    def writer(self, schema, overwrite):
        return _HttpWriter(self.options)


class _HttpWriter(DataSourceWriter):
    def __init__(self, options):
        self.url, self.token_env = options["url"], options.get("token_env", "")
        self.timeout, self.retries = float(options.get("timeout", "10")), int(options.get("retries", "2"))
        self.batch = int(options.get("batch", "500"))

    def write(self, rows: Iterator) -> WriterCommitMessage:
        rows = iter(rows)
        while records := [r.asDict(True) for r in islice(rows, self.batch)]:
            headers = {"Content-Type": "application/json"}
            if self.token_env and os.environ.get(self.token_env):
                headers["Authorization"] = f"Bearer {os.environ[self.token_env]}"
            body = json.dumps({"records": records}, default=str).encode()
            for attempt in range(self.retries + 1):
                try:
                    with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as answer:
                        if 200 <= answer.status < 300:
                            break
                except urllib.error.URLError:
                    if attempt == self.retries:
                        raise
                    time.sleep(0.2 * (attempt + 1))
        return WriterCommitMessage()


def export_http(df: DataFrame, url: str, token_env: str = "") -> DataFrame:
    spark = df.sparkSession
    spark.dataSource.register(HttpSink)
    try:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("audit_http").option("url", url).option("token_env", token_env).mode("append").save()
        return result(spark, True, seen.get["n"])
    except Exception as error:
        return result(spark, False, reason=type(error).__name__)


def export(df: DataFrame, cfg: dict) -> DataFrame:
    """K05."""
    kind = cfg.get("type", "none")
    if kind == "none" or df.isEmpty():
        return result(df.sparkSession, True, skipped=df.count())
    if kind == "file":
        return export_files(df, cfg["path"])
    if kind == "http":
        return export_http(df, cfg["url"], cfg.get("token_env", ""))
    return result(df.sparkSession, False, reason=f"unknown type {kind}")


def export_pending(spark: SparkSession, source: str, cfg: dict, checkpoint: str) -> DataFrame:
    """Exports what the checkpoint hasn't seen; a failed batch stays unseen, and the next run repeats it. One result row."""
    from auditlake.sources.audit import stream_audit
    from auditlake.sources.tail import drain

    if cfg.get("type", "none") == "none":
        return result(spark, True, reason="disabled")
    done: list[tuple] = []

    def put(batch: DataFrame, number: int) -> None:
        if cfg["type"] == "file":
            # A batch's folder is replaced as a whole when it is repeated.
            out = export_files(batch, f"{cfg['path'].rstrip('/')}/batch={number}")
        else:
            out = export(batch, cfg)
        row = out.first()
        done.append(tuple(row))
        if not row.ok:
            raise RuntimeError(row.reason)

    try:
        drain(stream_audit(spark, source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(put))
    except Exception:
        return result(spark, False, reason=done[-1][3] if done else "stream failed")
    return result(spark, True, sum(d[1] or 0 for d in done), sum(d[2] or 0 for d in done))


def save_baseline(rows: DataFrame, path: str) -> None:
    """A new version of each repository's baseline (repo_id, status, trusted_at, ...)."""
    rows.write.mode("append").parquet(path)


def latest_baselines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c != "repo_id"]
    return rows.groupBy("repo_id").agg(F.max_by(F.struct(*rest), "trusted_at").alias("x")).select("repo_id", "x.*")


def migrate_tsv(spark: SparkSession, source: str, target: str, dry_run: bool = False) -> DataFrame:
    """The old log into the lake; a dry run only counts and shows three rows."""
    from auditlake.sources.audit import read_audit_tsv

    rows = read_audit_tsv(spark, source)
    if dry_run:
        return rows.limit(3)
    write_audit(rows, target)
    return result(spark, True, rows.count(), spark.read.text(source).count() - rows.count())


def apply_retention(spark: SparkSession, path: str, days: int, today: str) -> int:
    """Removes the lake's day folders older than the bound; returns how many."""
    from auditlake.operators.report import retention

    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("day=")]
    if not names:
        return 0
    # One name a day: bounded by the log's age.
    old = [r["day"] for r in retention(spark.createDataFrame([(n[4:],) for n in names], "day string"), days, today).collect()]
    for day in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}"), True)
    return len(old)


def flush_summary(exported: DataFrame, rotated: int, states: int) -> DataFrame:
    """One row on a flush: day folders removed, states expired, and what the export did."""
    return exported.select(F.lit(rotated).cast("long").alias("rotated"), F.lit(states).cast("long").alias("states"), "sent", "skipped", "ok", "reason")
