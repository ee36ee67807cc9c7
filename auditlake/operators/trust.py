"""Repository configuration: fingerprints, drift and the trust machine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from auditlake.functions import scalars as S
from auditlake.operators.folds import in_order
from auditlake.sources.tables import stored


def dir_hash(files: DataFrame, cap: int | None = None) -> DataFrame:
    """A10: one hash of all of a directory's files (dir, rel, content), whatever order they come in.

    With a cap, as a guard against folders meant to be too large, the first files by name and
    a line that says so; without one every file counts.
    """
    lines = files.select("dir", "rel", F.concat("rel", F.lit(":"), S.content_hash(F.col("content"))).alias("line"))
    if cap:
        ranked = lines.withColumn("n", F.row_number().over(Window.partitionBy("dir").orderBy("rel"))).where(F.col("n") <= cap)
        lines = ranked.select("dir", F.explode(F.when(F.col("n") == cap, F.array("line", F.lit("truncated"))).otherwise(F.array("line"))).alias("line"))
    hashed = in_order(lines.select("dir", "line"), ["dir"], ["line"], _hash_lines(lines.schema["dir"].dataType), T.StructType([lines.schema["dir"], T.StructField("dir_hash", T.StringType())]))
    return hashed


def _hash_lines(kind: T.DataType):
    """The digest of each directory's lines, joined by line ends; a directory's lines go by and aren't kept."""
    schema = pa.schema([("dir", to_arrow_type(kind)), ("dir_hash", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for name, line in zip(batch.column("dir").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if digest is None or name != at:
                    if digest is not None:
                        done.append({"dir": at, "dir_hash": digest.hexdigest()})
                    at, digest = name, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"dir": at, "dir_hash": digest.hexdigest()}], schema=schema)

    return run


def diff_artifacts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, rel) whose hash differs; a missing side is 'absent'."""
    a, b = old.select("repo", "rel", F.col("hash").alias("before")), new.select("repo", "rel", F.col("hash").alias("after"))
    both = a.join(b, ["repo", "rel"], "full").na.fill("absent", ["before", "after"])
    return both.where("before <> after").select("repo", "rel", "before", "after")


def status(changed: Column, findings: Column, baseline: Column) -> Column:
    """Trusted, pending or quarantined, from the number of changed artifacts and of findings and the baseline's status (null: none)."""
    new = F.when(findings > 0, "pending").otherwise("trusted")
    return F.when(baseline.isNull(), new).when((baseline == "quarantined") | (changed > 0), "quarantined").otherwise(baseline)


def session_start(status_: Column, baseline: Column) -> Column:
    """What a session start reports: (rule, action)."""
    rule = F.when(status_ == "trusted", None).when(status_ == "quarantined", "config-quarantined").when(baseline.isNull(), "config-untrusted-new").otherwise("config-changed-hot")
    action = F.when(rule.isNull(), "logged").when(status_ == "quarantined", "blocked_config").otherwise("warned")
    return F.struct(rule.alias("rule"), action.alias("action"))


def config_change(changed: Column, hot: Column, before: Column, level: Column) -> Column:
    """(status, action) after a configuration change."""
    quiet = (changed == 0) & ~before.eqNullSafe("quarantined")
    after = F.when(quiet | ~hot, F.coalesce(before, F.lit("trusted"))).when(level == "strict", "quarantined").otherwise(F.coalesce(before, F.lit("trusted")))
    action = F.when(quiet, "none").when(~hot, "logged").when(level == "strict", "blocked_config").when(level == "warn", "warned").otherwise("logged")
    return F.struct(after.alias("status"), action.alias("action"))


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """status() event by event; between them a repository has a status and a fingerprint, and nothing more."""
    repo, state, known = None, None, None
    first = True
    for batch in batches:
        after = []
        for name, kind, print_, findings in zip(*(batch.column(c).to_pylist() for c in ("repo", "kind", "fingerprint", "findings")), strict=True):
            if first or name != repo:
                first, repo, state, known = False, name, None, None
            if kind == "approve":
                state, known = "trusted", known if known is not None else print_
            else:
                changed = known is not None and print_ is not None and known != print_
                if state is None:
                    state = "pending" if (findings or 0) > 0 else "trusted"
                elif state == "quarantined" or changed:
                    state = "quarantined"
                known = print_
            after.append(state)
        yield pa.RecordBatch.from_arrays([batch.column("repo"), batch.column("seq"), pa.array(after, pa.string())], names=["repo", "seq", "status"])


def trust_history(events: DataFrame) -> DataFrame:
    """R05, R07 over time: events (repo, seq, kind in snapshot | approve, fingerprint, findings) to the status after each.

    A fold over a repository's events in order, as the baseline moves with every one of them.
    """
    rows = events.select("repo", F.col("seq").cast("long").alias("seq"), "kind", "fingerprint", F.col("findings").cast("int").alias("findings"))
    return in_order(rows, ["repo"], ["seq", "kind", "fingerprint"], _transitions, "repo string, seq bigint, status string")


def start_sessions(artifacts: DataFrame, findings: DataFrame, path: str, at: str) -> DataFrame:
    """A session start in every repository: (repo, status, changed, rule, action), and the baselines that it leaves.

    artifacts: repo, rel, hash as they are; findings: repo, key. Each repository is judged by the version of its baseline in
    `path` that held at `at`. A clean repository without one is remembered in silence; what isn't trusted is remembered as it
    is now, with its new status, and so is reported again until it is approved. A trusted repository that hasn't changed is
    silent and leaves nothing. Versions are only ever added; repeating a call adds the same ones, which count once.
    """
    spark = artifacts.sparkSession
    known = baselines_at(spark, path, at)
    old = known.select("repo", "status", F.explode("artifacts").alias("rel", "hash"))
    # A baseline without artifacts still has a status.
    bare = known.where(F.size("artifacts") == 0).select("repo", "status", F.lit("").alias("rel"), F.lit("absent").alias("hash"))
    judged = evaluate_trust(artifacts, findings, old.unionByName(bare), artifacts)
    before = known.select("repo", F.col("status").alias("baseline"))
    judged = judged.join(before, "repo", "left")
    judged = stored(judged.select("repo", "status", "changed", "baseline", session_start(F.col("status"), F.col("baseline")).alias("x")).select("repo", "status", "changed", "baseline", "x.*"), "session-starts")
    new = judged.where("status <> 'trusted' OR baseline IS NULL").select("repo", "status")
    keys = findings.groupBy("repo").agg(F.array_sort(F.collect_set("key")).alias("hot_keys_present"))
    now = artifacts.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("rel", "hash"))).alias("artifacts"))
    rows = new.join(now, "repo").join(keys, "repo", "left").withColumn("hot_keys_present", F.coalesce("hot_keys_present", F.array().cast("array<string>")))
    rows.select("repo", F.lit(at).cast("timestamp").alias("trusted_at"), "status", "artifacts", "hot_keys_present").write.mode("append").parquet(path)
    return judged.select("repo", "status", "changed", "rule", "action")


_BASELINE = "repo string, trusted_at timestamp, status string, artifacts map<string, string>, hot_keys_present array<string>"


def baselines_at(spark: SparkSession, path: str, at: str | None = None) -> DataFrame:
    """Each repository's latest baseline, or the one that held at a time; of versions of one time an approval stands."""
    try:
        rows = spark.read.schema(_BASELINE).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], _BASELINE)
    if at is not None:
        rows = rows.where(F.col("trusted_at") <= F.lit(at).cast("timestamp"))
    rest = F.struct("trusted_at", "status", "artifacts", "hot_keys_present")
    return rows.groupBy("repo").agg(F.max_by(rest, F.struct("trusted_at", (F.col("status") == "trusted").alias("approved"))).alias("x")).select("repo", "x.*")


def approve(artifacts: DataFrame, findings: DataFrame, repos: list[str], path: str, at: str) -> None:
    """A person trusts repositories as they are now: a new version of each one's baseline."""
    chosen = artifacts.where(F.col("repo").isin(repos))
    keys = findings.groupBy("repo").agg(F.array_sort(F.collect_set("key")).alias("hot_keys_present"))
    rows = chosen.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("rel", "hash"))).alias("artifacts")).join(keys, "repo", "left")
    rows.select("repo", F.lit(at).cast("timestamp").alias("trusted_at"), F.lit("trusted").alias("status"), "artifacts", F.coalesce("hot_keys_present", F.array().cast("array<string>")).alias("hot_keys_present")).write.mode("append").parquet(path)


def fingerprint(artifacts: DataFrame, watched: list[str], folders: list[str] = (), cap: int | None = None) -> DataFrame:
    """(repo, rel, hash) of every watched file and folder of each repository, or 'absent'. The watched names are a short constant."""
    if folders:
        folder = F.get(F.filter(F.array(*map(F.lit, folders)), lambda d: F.col("rel").startswith(d)), F.lit(0))
        inside = artifacts.where(F.col("content").isNotNull()).withColumn("folder", folder).where("folder is not null")
        hashed = dir_hash(inside.select(F.struct("repo", "folder").alias("dir"), F.expr("substring(rel, length(folder) + 1)").alias("rel"), "content"), cap)
        hashed = hashed.select("dir.repo", F.col("dir.folder").alias("rel"), F.concat(F.lit("sha256:"), "dir_hash").alias("hash"))
        frame = artifacts.select("repo").distinct().join(F.broadcast(artifacts.sparkSession.createDataFrame([(w,) for w in folders], "rel string")))
        of_folders = frame.join(hashed, ["repo", "rel"], "left").na.fill("absent", ["hash"])
        return fingerprint(artifacts, watched).unionByName(of_folders)
    frame = artifacts.select("repo").distinct().join(F.broadcast(artifacts.sparkSession.createDataFrame([(w,) for w in watched], "rel string")))
    hashed = artifacts.where(F.col("rel").isin(watched)).select("repo", "rel", S.content_hash(F.col("content")).alias("hash"))
    return frame.join(hashed, ["repo", "rel"], "left").na.fill("absent", ["hash"])


def evaluate_trust(now: DataFrame, findings: DataFrame, baselines: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Repo, changed (names), n_findings, status and clean of every repository.

    now: repo; artifacts: repo, rel, hash as they are; baselines: repo, rel, hash, status as approved;
    findings: repo. A repository without a baseline changes nothing; one with findings is then pending.
    """
    old, known = baselines.select("repo", "rel", "hash"), baselines.groupBy("repo").agg(F.max("status").alias("baseline"))
    current = artifacts.select("repo", "rel", "hash").join(known.select("repo"), "repo", "left_semi")
    moved = diff_artifacts(old, current).groupBy("repo").agg(F.array_sort(F.collect_set("rel")).alias("changed"))
    counted = findings.groupBy("repo").agg(F.count(F.lit(1)).alias("n_findings"))
    rows = now.select("repo").distinct().join(known, "repo", "left").join(moved, "repo", "left").join(counted, "repo", "left")
    rows = rows.withColumn("changed", F.coalesce("changed", F.array().cast("array<string>"))).na.fill(0, ["n_findings"])
    state = status(F.size("changed"), F.col("n_findings"), F.col("baseline"))
    return rows.select("repo", "changed", "n_findings", state.alias("status"), (state == "trusted").alias("clean"))


def make_baseline(rows: DataFrame) -> DataFrame:
    """One row per repository: its artifacts as a map, and the hot keys present, sorted. rows: repo, rel, hash, hot_key."""
    return rows.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("rel", "hash"))).alias("artifacts"), F.array_sort(F.collect_set("hot_key")).alias("hot_keys_present"))
