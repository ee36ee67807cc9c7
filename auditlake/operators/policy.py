"""Policy resolution: levels, decisions, exemptions and repeat suppression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions import scalars as S
from auditlake.functions.paths import glob_to_regex, is_excluded
from auditlake.sources.tables import ship

# The default level of each class of rules.
CLASS_LEVELS = {
    "secret-egress": "strict",
    "secret-output": "strict",
    "command-destructive": "strict",
    "git-destructive": "strict",
    "config-trust": "warn",
    "path-sensitive": "warn",
    "injection": "warn",
    "platform": "warn",
    "privilege": "audit",
    "persistence": "audit",
    "anti-forensics": "audit",
    "internal": "audit",
}


def rule_levels(spark: SparkSession, more: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((CLASS_LEVELS | (more or {})).items()), "key string, level string")


def overlays(effective: DataFrame) -> DataFrame:
    """What users tighten, by time: (user_name, floor, own, since, until) of merge_overrides' effective rows.

    own: rule or class to level. A row with `since` holds until the user's next one; without the column it always holds.
    """
    if "since" not in effective.columns:
        effective = effective.withColumn("since", F.lit(None).cast("timestamp"))
    until = F.lead("since").over(Window.partitionBy("user_name").orderBy(F.asc_nulls_first("since")))
    return effective.select("user_name", "floor", F.col("rule_levels").alias("own"), F.col("since").cast("timestamp").alias("since"), until.cast("timestamp").alias("until"))


def with_overlay(rows: DataFrame, overlay: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows with their user's `floor` and `own` levels at their time; null where the user tightens nothing.

    A user has one row of the overlay for any time, so no row is lost or doubled.
    """
    o = overlay.select(F.col("user_name").alias("_user"), "floor", "own", "since", "until")
    at = F.col(ts).cast("timestamp")
    holds = (F.col("since").isNull() | (at >= F.col("since"))) & (F.col("until").isNull() | (at < F.col("until")))
    return rows.join(o, (F.col("user_name") == F.col("_user")) & holds, "left").drop("_user", "since", "until")


def effective_level(findings: DataFrame, levels: DataFrame, default: str = "warn", floor: Column | None = None, overlay: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """The rule's level, else its class's, else the global one; raised to a local floor.

    With an overlay (findings then have user_name and ts) each user's own levels come before those of all, and the user's floor
    holds for every rule.
    """
    of_rule = levels.select(F.col("key").alias("rule"), F.col("level").alias("_rule_level"))
    of_class = levels.select(F.col("key").alias("class"), F.col("level").alias("_class_level"))
    found = findings.join(of_rule, "rule", "left").join(of_class, "class", "left")
    level = F.coalesce("_rule_level", "_class_level", F.lit(default))
    if overlay is not None:
        found = with_overlay(found, overlay, ts)
        own = lambda k: F.try_element_at(F.col("own"), F.coalesce(F.col(k), F.lit("")))
        level = F.coalesce(own("rule"), F.col("_rule_level"), own("class"), F.col("_class_level"), F.lit(default))
        level = F.coalesce(S.harder(level, F.col("floor")), level)
    found = found.withColumn("level", S.harder(level, floor) if floor is not None else level)
    return found.drop("_rule_level", "_class_level", *(["floor", "own"] if overlay is not None else []))


def without_excluded(rows: DataFrame, patterns: list[str], path: str = "target", cwd: str = "cwd") -> DataFrame:
    """Rows but those whose path lies below the working directory where an exclusion of the policy fits; a null path stays."""
    if not patterns:
        return rows
    fits = is_excluded(F.col(path), F.col(cwd), F.array(*(F.lit(glob_to_regex(p)) for p in patterns)))
    return rows.where(~F.coalesce(fits, F.lit(False)))


def apply_exemptions(findings: DataFrame, exemptions: DataFrame, today: str, key: str = "event_id") -> DataFrame:
    """The first exemption in file order of the same rule whose pattern fits the target; expired ones are reported, not applied.

    exemptions: position, rule, target_regex (null fits all, but a null target fits no pattern), expires (text).
    """
    e = exemptions.withColumnRenamed("rule", "_rule")
    fits = (F.col("rule") == F.col("_rule")) & (F.col("target_regex").isNull() | F.coalesce(F.rlike("target", F.col("target_regex")), F.lit(False)))
    alive = F.coalesce(F.expr("try_cast(expires AS DATE)") >= F.lit(today).cast("date"), F.lit(False)) | F.col("expires").isNull()
    hits = findings.select(key, "rule", "target").join(e, fits).withColumn("_alive", alive)
    found = hits.groupBy(key, "rule").agg(F.min(F.when(F.col("_alive"), F.col("position"))).alias("exemption"), F.coalesce(F.bool_or(~F.col("_alive")), F.lit(False)).alias("expired_hit"))
    return findings.join(found, [key, "rule"], "left").withColumn("exempt", F.col("exemption").isNotNull()).withColumn("expired_hit", F.coalesce("expired_hit", F.lit(False)))


def _quiet(ttl: int):
    """Adds `suppressed` to rows that come by key and time. The last key and its anchor go from batch to batch, and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor = None, 0
        for batch in batches:
            held = np.flatnonzero(batch.column("_held").to_numpy(zero_copy_only=False))
            quiet = np.zeros(batch.num_rows, bool)
            if len(held):
                keys = batch.column("_group").take(pa.array(held))
                t = batch.column("_t").take(pa.array(held)).to_numpy()
                new = np.append(True, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))
                begins = np.flatnonzero(new)
                for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(t)], strict=True):
                    at = a
                    if a or keys[0].as_py() != last:
                        anchor, at = t[a], a + 1
                    # From anchor to anchor: the next one is the first row that is late enough.
                    while at < b:
                        late = a + int(np.searchsorted(t[a:b], anchor + ttl))
                        quiet[held[at:late]] = True
                        if late == b:
                            break
                        anchor, at = t[late], late + 1
                last = keys[len(keys) - 1].as_py()
            names = [n for n in batch.schema.names if n not in _FOLD]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(quiet)], names=[*names, "suppressed"])

    return run


_FOLD = ["_group", "_t", "_held", "_deal"]


def session_memory(df: DataFrame, ttl_hours: float = 24, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Warn and ask of one (session, rule, target, agent) are suppressed for a while after the last one that was not.

    The anchor moves only when a row is emitted, so this is a fold over the key's rows in order of time, not a lag. Rows are
    sorted within partitions and streamed: a key may have any number of rows, and no row is joined back. Other decisions and
    rows without a session pass by, dealt out evenly. An event may have a row for each of several rules.
    """
    key = S.memory_key(F.col("rule"), F.col("target"), F.col("agent_id"))
    held = F.col("decision").isin("warn", "ask") & (F.coalesce("session_id", F.lit("")) != "")
    if "exempt" in df.columns:
        held = held & ~F.coalesce(F.col("exempt"), F.lit(False))
    ttl = int(ttl_hours * 3_600_000_000) if ttl_hours > 0 else 86_400_000_000
    ship(df.sparkSession)
    rows = df.withColumn("_group", F.concat(F.coalesce("session_id", F.lit("")), F.lit("\x1f"), F.coalesce(key, F.lit(""))))
    rows = rows.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_held", F.coalesce(held, F.lit(False)) & F.col("_t").isNotNull())
    rows = rows.withColumn("_deal", F.when(F.col("_held"), F.lit(-1)).otherwise(F.pmod(F.xxhash64(order), F.lit(64))))
    dealt = rows.repartition("_group", "_deal").sortWithinPartitions("_group", "_deal", "_t", order)
    return dealt.mapInArrow(_quiet(ttl), T.StructType([*df.schema.fields, T.StructField("suppressed", T.BooleanType())]))


def resolve(findings: DataFrame, levels: DataFrame, exemptions: DataFrame, today: str, ttl_hours: float = 24, default: str = "warn", overlay: DataFrame | None = None, exclusions: list[str] | None = None) -> DataFrame:
    """Level, decision, exemption (which logs and leaves the memory alone), session memory, audit action.

    overlay: what users tighten (overlays); findings then have user_name. exclusions: globs of paths that aren't looked at;
    findings then have target, a path, and cwd.
    """
    found = without_excluded(findings, exclusions or [])
    found = effective_level(found, levels, default, overlay=overlay).withColumn("decision", S.decision_for(F.col("severity"), F.col("level")))
    found = apply_exemptions(found, exemptions, today).withColumn("decision", F.when(F.col("exempt"), "log").otherwise(F.col("decision")))
    found = session_memory(found, ttl_hours)
    return found.withColumn("outcome", S.audit_action(F.col("decision"), F.col("suppressed")))


def decide(matches: DataFrame, key: str = "event_id") -> DataFrame:
    """The most restrictive decision of an event; a suppressed one counts as log and of ties the first rule stays."""
    rank = F.when(F.col("suppressed"), S.decision_rank(F.lit("log"))).otherwise(S.decision_rank(F.col("decision")))
    return matches.groupBy(key).agg(F.max_by(F.struct("rule", "decision"), F.struct(rank, -F.col("rule_pos"))).alias("_best")).select(key, "_best.*")


def what_if(events: DataFrame, now: DataFrame, then: DataFrame) -> DataFrame:
    """Decisions by class under two level tables."""
    a = effective_level(events, now).select("event_id", "class", S.decision_for(F.col("severity"), F.col("level")).alias("before"))
    b = effective_level(events, then).select("event_id", S.decision_for(F.col("severity"), F.col("level")).alias("after"))
    return a.join(b, "event_id").groupBy("class", "before", "after").agg(F.count(F.lit(1)).alias("n"))


def first_match(df: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
