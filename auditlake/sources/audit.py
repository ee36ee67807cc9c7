"""Audit logs, rules, policies, overrides, snapshots and tool events as DataFrames."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.report import cap_rows
from auditlake.sources.tables import ship
from auditlake.sources.tail import RANGE, AppendLog

#: An audit record; keys beyond these stay in the raw line.
AUDIT = "v int, kind string, ts string, session_id string, prompt_id string, agent_id string, agent_type string, user string, host string, cwd string, repo string, git_branch string, hook string, event string, tool string, rule string, class string, severity string, level string, action string, target string, evidence string, masked array<struct<type: string, preview: string>>, latency_ms int, plugin_version string"

# Actions of the old log and of records.
LEGACY_ACTIONS = {"block": "denied", "ask": "asked", "warn": "warned", "redact": "redacted", "log": "logged"}
KINDS = ["command", "regex", "path", "entropy", "config_key"]


def _records(lines: DataFrame, *more: str) -> DataFrame:
    """Lines that hold an object; from_json rather than the JSON source, which can't count its good rows."""
    parsed = F.from_json("value", AUDIT + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.where("trim(value) <> ''").select(parsed.alias("x"), *more).where("x._corrupt IS NULL")
    return rows.select("x.*", *(m.split(" AS ")[-1].split(".")[-1] for m in more)).drop("_corrupt").withColumn("event_time", F.try_to_timestamp("ts"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """All records of a folder of day files; blank and broken lines are left out."""
    return _records(spark.read.text(path), "_metadata.file_name")


def stream_audit(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The log as a stream. Day files grow while they are read; each line comes once, when it is whole."""
    ship(spark)
    spark.dataSource.register(AppendLog)
    return _records(spark.readStream.format("append_log").option("rangeBytes", range_bytes).option("json", "true").load(path))


def legacy_fields(line: Column) -> Column:
    """The fields of a tab-separated line; all null if it has fewer than four."""
    part = F.split(line, "\t")
    pairs = F.filter(part, lambda p: p.rlike("^[a-z]+="))
    value = lambda k: F.regexp_extract(F.get(F.filter(pairs, lambda p: p.startswith(f"{k}=")), F.lit(0)), "=(.*)", 1)
    named = F.create_map(*[F.lit(x) for kv in LEGACY_ACTIONS.items() for x in kv])
    when = F.try_to_timestamp(part[0])
    masked = F.filter(F.split(F.get(part, F.lit(7)), "; ?"), lambda m: m.contains(":"))
    ok = F.size(part) >= 4
    field = lambda c: F.when(ok, c)
    return F.struct(
        field(F.coalesce(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), part[0])).alias("ts"),
        field(F.get(part, F.lit(1))).alias("event"),
        field(F.get(part, F.lit(2))).alias("tool"),
        field(F.coalesce(F.element_at(named, F.get(part, F.lit(3))), F.lit("logged"))).alias("action"),
        field(value("session")).alias("session_id"),
        field(F.coalesce(F.size(masked), F.lit(0))).alias("n_masked"),
        field(F.lit("tsv")).alias("migrated_from"),
    )


def read_audit_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The old log; what can't be read is left out (count it with the raw lines)."""
    return spark.read.text(path).select(legacy_fields(F.col("value")).alias("x")).select("x.*").where("ts IS NOT NULL")


def rule_problem(rule: Column) -> Column:
    """Why a rule is rejected; null for a good one."""
    get = lambda k: F.get_json_object(rule, f"$.{k}")
    missing = get("id").isNull() | get("class").isNull() | get("severity").isNull() | get("match.kind").isNull() | get("message").isNull()
    return (
        F.when(missing, "RULE_FIELD_MISSING")
        .when(~get("severity").isin("LOW", "MEDIUM", "HIGH", "CRITICAL"), "RULE_SEVERITY_UNKNOWN")
        .when(~get("match.kind").isin(KINDS), "RULE_KIND_UNKNOWN")
        .when(get("enabled") == "false", "RULE_DISABLED")
    )


def load_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rules (set, rule) and problems (set, rule, problem) of `{rules: [...]}` files."""
    docs = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("set"), F.explode_outer(F.from_json(F.get_json_object("value", "$.rules"), "array<string>")).alias("rule"))
    checked = docs.withColumn("problem", F.coalesce(rule_problem(F.col("rule")), F.when(F.col("rule").isNull(), "RULES_FILE_INVALID")))
    return checked.where("problem IS NULL").drop("problem"), checked.where("problem IS NOT NULL")


def bad_patterns(rules: DataFrame) -> DataFrame:
    """Rules (set, rule) whose regular expressions don't compile, with problem RULE_REGEX_INVALID.

    The rule table is small and comes to the driver, where each pattern is tried once.
    """
    spark, bad = rules.sparkSession, []
    fields = ("pattern", "args_regex_any", "charset")
    for row in rules.select("set", "rule").collect():
        match = json.loads(row["rule"]).get("match", {})
        given = [x for f in fields for x in (match.get(f) if isinstance(match.get(f), list) else [match.get(f)]) if isinstance(x, str)]
        try:
            for pattern in given:
                re.compile(pattern)
        except re.error:
            bad.append((row["set"], row["rule"], "RULE_REGEX_INVALID"))
    return spark.createDataFrame(bad, "set string, rule string, problem string")


def policy_problems(policy: Column) -> Column:
    """The names of the parts that are wrong."""
    get = lambda k: F.get_json_object(policy, f"$.{k}")
    levels = F.map_values(F.from_json(get("rule_levels"), "map<string, string>"))
    exempt = F.from_json(get("exemptions"), "array<struct<rule: string, reason: string, expires: string, approved_by: string>>")
    kind = F.coalesce(get("audit.export.type"), F.lit("none"))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    known = ["audit", "warn", "strict"]
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(get("schema_version") == "1", F.lit(False)), "schema_version"),
            F.when(~F.coalesce(get("level").isin(known), F.lit(False)), "level"),
            F.when(F.exists(levels, lambda x: ~x.isin(known)), "rule_levels"),
            F.when(~kind.isin("none", "file", "http"), "audit.export.type"),
            F.when((kind == "file") & empty(get("audit.export.path")), "audit.export.path"),
            F.when((kind == "http") & empty(get("audit.export.url")), "audit.export.url"),
            F.when(F.exists(exempt, lambda e: empty(e["rule"]) | empty(e["reason"]) | empty(e["approved_by"])), "exemptions"),
            F.when(F.exists(exempt, lambda e: F.try_to_date(e["expires"], "yyyy-MM-dd").isNull()), "exemptions.expires"),
        )
    )


# The policy where its file says nothing.
POLICY = {
    "schema_version": "1",
    "policy_version": "unknown",
    "level": "audit",
    "rule_levels": {},
    "protected_branches": '["main","master"]',
    "exclusions": "[]",
    "exemptions": "[]",
    "session_memory": {"enabled": "true", "ttl_hours": "24"},
    "llm": {"enabled": "false", "model": "haiku", "max_calls_per_session": "20"},
    "audit": {"retention_days": "30", "export": '{"type":"none","path":null,"url":null,"token_env":null}'},
    "ui": {"banner": "true", "verbosity": "normal"},
}


def load_policy(spark: SparkSession, path: str, defaults: dict[str, str]) -> DataFrame:
    """One row with every section: the file over the defaults, one level deep; keys that begin with $ are comments.

    Plain sections are text (lists as JSON), the others maps. `defaults` are the rule levels of the rules at hand.
    A file that is no object gives the defaults.
    """
    none = F.create_map().cast("map<string, string>")
    file = F.coalesce(F.from_json("value", "map<string, string>"), none)

    def section(name: str, base) -> Column:
        if not isinstance(base, dict):
            return F.coalesce(F.element_at(file, name), F.lit(base)).alias(name)
        base = base | defaults if name == "rule_levels" else base
        known = F.create_map(*[F.lit(x) for kv in base.items() for x in kv]).cast("map<string, string>") if base else none
        given = F.coalesce(F.from_json(F.element_at(file, name), "map<string, string>"), none)
        return F.map_zip_with(known, F.map_filter(given, lambda k, v: ~k.startswith("$")), lambda k, a, b: F.coalesce(b, a)).alias(name)

    return spark.read.text(path, wholetext=True).select(*(section(k, v) for k, v in POLICY.items()))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Each user's override file; what is no object is a problem row."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("user_name"), F.col("value").alias("body"))
    bad = ~F.coalesce(F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT"), F.lit(False))
    return raw.withColumn("problem", F.when(bad, "LOCAL_FILE_INVALID"))


def read_artifacts(spark: SparkSession, path: str, watched: list[str], folders: list[str] = (), most_bytes: int | None = None, most_files: int | None = None) -> DataFrame:
    """Repo, rel, content of the watched files of `path/<repo>/...` and of all files in its watched folders.

    A missing file is a row without content. Whole files are read; most_bytes cuts each, and most_files takes the first of each
    watched folder by name, as guards against what is meant to be too large.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = path.rstrip("/")
    tail = F.substring_index("path", f"{base}/", -1)
    found = files.select(F.substring_index(tail, "/", 1).alias("repo"), F.regexp_replace(tail, "^[^/]+/", "").alias("rel"), (F.substring("content", 1, most_bytes) if most_bytes else F.col("content")).alias("content"))
    frame = found.select("repo").distinct().join(F.broadcast(spark.createDataFrame([(w,) for w in watched], "rel string")))
    rows = frame.join(found, ["repo", "rel"], "left")
    for folder in folders:
        inside = found.where(F.col("rel").startswith(folder))
        rows = rows.unionByName(cap_rows(inside, most_files, ["repo"], ["rel"]) if most_files else inside)
    return rows


def read_tool_events(spark: SparkSession, path: str) -> DataFrame:
    """Tool calls with free-form input and response; empty and non-object lines are left out."""
    v = F.try_parse_json("value")
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string").alias(k)
    rows = spark.read.text(path).where(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    return rows.select(*map(get, ["session_id", "hook_event_name", "tool_name", "tool_use_id", "cwd", "agent_id"]), F.try_variant_get(v, "$.tool_input", "variant").alias("tool_input"), F.try_variant_get(v, "$.tool_response", "variant").alias("tool_response"))
