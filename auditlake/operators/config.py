"""Rules, policies, overrides and repository configuration as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.functions.paths import fnmatch_to_regex
from auditlake.operators import injection as I
from auditlake.operators import json as J

# What a user may and may not set, and what a rule must have.
LOCAL_ALLOWED = ["level", "rule_levels", "extra_rules", "ui"]
LOCAL_UI_ALLOWED = ["banner", "verbosity"]
LOCAL_FORBIDDEN = ["audit", "exemptions", "exclusions", "protected_branches", "llm", "session_memory", "policy_version", "schema_version"]
RULE_FIELDS = ["id", "class", "severity", "match", "message", "remediation", "reference"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

# Settings files, instruction files and folders of a repository, and keys that can run code.
SETTINGS = [".claude/settings.json", ".claude/settings.local.json", ".mcp.json"]
INSTRUCTIONS = ["CLAUDE.md", ".claude/CLAUDE.md"]
FOLDERS = [".claude/hooks/", ".claude/agents/", ".claude/skills/", ".claude/rules/", ".claude/commands/"]
RUN_FOLDERS = [".claude/hooks/", ".claude/agents/", ".claude/commands/"]
HOT_KEYS = ["hooks", "mcpServers", "apiKeyHelper", "env", "enabledPlugins", "extraKnownMarketplaces", "permissions.allow", "statusLine", "fileSuggestion.command", "awsCredentialExport", "awsAuthRefresh", "gcpAuthRefresh", "otelHeadersHelper", "autoMemoryDirectory", "outputStyle", "forceLoginMethod", "sandbox"]

_PROBLEM = "array<struct<problem: string, target: string>>"


def is_hot(key: Column, patterns: list[str] = HOT_KEYS) -> Column:
    """The first part of a dotted key, or all of it, fits a pattern."""
    rx = "|".join(f"(?:{fnmatch_to_regex(p)})" for p in patterns)
    return F.split(key, r"\.")[0].rlike(rx) | key.rlike(rx)


def key_set_changed(before: Column, after: Column) -> Column:
    """Whether a set of hot keys differs from that of the baseline."""
    return (F.size(F.array_except(before, after)) > 0) | (F.size(F.array_except(after, before)) > 0)


def hot_findings(artifacts: DataFrame, patterns: list[str] = HOT_KEYS) -> DataFrame:
    """(repo, file, key, detail) of whatever in a repository can run code or gives orders.

    artifacts: repo, rel, content (text). A settings file gives its hot first keys, each
    with the executable strings of the first place that fits, or, if it is no JSON, one
    finding; a folder of runnable files that isn't empty gives its first twenty names.
    """
    files = artifacts.where(F.col("rel").isin(SETTINGS) & F.col("content").isNotNull()).select("repo", F.col("rel").alias("file"), "content")
    nothing = F.array().cast("array<string>")
    broken = files.where(F.try_parse_json("content").isNull()).select("repo", "file", F.lit("<unreadable>").alias("key"), nothing.alias("detail"))
    # Equal contents are walked once.
    nodes = J.nodes(files.select("content").distinct(), "content")
    root = F.split("keys", r"\.")[0]
    hot = nodes.where(F.col("named") & is_hot(F.col("keys"), patterns)).groupBy("doc", root.alias("key")).agg(F.min("path").alias("at"))
    leaves = nodes.where("kind = 'STRING'").select("doc", F.col("path").alias("leaf"), F.col("v").cast("string").alias("s"))
    below = hot.join(leaves, "doc", "left").where(F.col("s").isNull() | (F.col("leaf") == F.col("at")) | F.col("leaf").startswith(F.concat("at", F.lit("/"))))
    texts = below.groupBy("doc", "key").agg(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("leaf", "s")))).alias("x"))
    hot = hot.select("doc", "key").join(texts, ["doc", "key"], "left")
    found = hot.select("doc", "key", J.executables(F.transform(F.coalesce("x", F.array().cast("array<struct<leaf: string, s: string>>")), lambda y: y["s"])).alias("detail"))
    of_files = files.withColumn("doc", J.document_key(F.col("content"))).join(found, "doc").select("repo", "file", "key", "detail")

    folder = F.get(F.filter(F.array(*map(F.lit, RUN_FOLDERS)), lambda d: F.col("rel").startswith(d)), F.lit(0))
    inside = artifacts.where(F.col("content").isNotNull()).withColumn("file", folder).where("file is not null")
    names = inside.select("repo", "file", F.split(F.expr("substring(rel, length(file) + 1)"), "/")[0].alias("name")).distinct()
    listed = names.groupBy("repo", "file").agg(F.slice(F.array_sort(F.collect_list("name")), 1, 20).alias("detail"))
    of_folders = listed.select("repo", "file", F.regexp_replace("file", "/$", "").alias("key"), "detail")
    return broken.unionByName(of_files).unionByName(of_folders).unionByName(doc_findings(artifacts))


def doc_findings(artifacts: DataFrame) -> DataFrame:
    """Instruction files with injected instructions of at least medium confidence: the classes as key, five evidences."""
    docs = artifacts.where(F.col("rel").isin(INSTRUCTIONS) & F.col("content").isNotNull()).select(F.struct("repo", F.col("rel").alias("file")).alias("id"), "content")
    sure = I.score(docs, "id", "content").where("confidence <> 'low'").select("id")
    seen = I.summarise(I.scan(docs, "id", "content"), evidences=5)
    return seen.join(sure, "id", "left_semi").select("id.repo", "id.file", F.concat(F.lit("injection:"), F.array_join("classes", ",")).alias("key"), F.col("evidences").alias("detail"))


def change_evidence(findings: DataFrame, changed: DataFrame, most: int = 10) -> DataFrame:
    """Per repository at most ten lines `key → item` of the findings in changed files. findings: repo, file, key, detail; changed: repo, file."""
    kept = findings.join(changed.select("repo", "file").distinct(), ["repo", "file"], "left_semi")
    lines = kept.select("repo", "file", "key", F.posexplode_outer("detail").alias("at", "item")).select("repo", F.struct("file", "key", F.coalesce("at", F.lit(0)).alias("at"), F.concat_ws(" → ", "key", "item").alias("line")).alias("x"))
    ranked = lines.groupBy("repo").agg(F.slice(F.array_sort(F.collect_list("x")), 1, most).alias("x"))
    return ranked.select("repo", F.transform("x", lambda y: y["line"]).alias("evidence"))


def format_report(repo: Column, status: Column, changed: Column, findings: Column) -> Column:
    """a repository's report in lines; changed: names, findings: array of (file, key)."""
    state = F.when(status == "trusted", "trusted").when(status == "pending", "not approved yet").otherwise("changed after it was approved")
    drift = F.when(F.size(changed) > 0, F.concat(F.lit("Differs from the baseline: "), F.array_join(changed, ", ")))
    runs = F.when(F.size(findings) > 0, F.concat(F.lit("Configuration that can run code:\n"), F.array_join(F.transform(findings, lambda f: F.concat(F.lit("  "), f["file"], F.lit(" → "), f["key"])), "\n"))).when(status == "trusted", "No configuration runs code.")
    return F.concat_ws("\n", F.concat(F.lit("Repository "), repo, F.lit(" ["), state, F.lit("]")), drift, runs, F.when(status != "trusted", "Approve it only after reading it."))


def scan_json(result: DataFrame) -> DataFrame:
    """One JSON line of a repository's scan: repo_id, remote, root, status, changed, findings."""
    return result.select(F.to_json(F.struct("repo_id", "remote", "root", "status", "changed", "findings")).alias("line"))


def complete_rule(rule: Column) -> Column:
    """An added rule has all fields, and a known severity."""
    has = [F.get_json_object(rule, f"$.{f}").isNotNull() for f in RULE_FIELDS]
    ok = F.get_json_object(rule, "$.severity").isin(SEVERITIES)
    for h in has:
        ok = ok & h
    return F.coalesce(ok, F.lit(False))


def extra_rules(overrides: DataFrame) -> DataFrame:
    """(user_name, kind, rule) of the complete command and regex rules that users add; they never replace one."""
    rules = overrides.select("user_name", F.explode(F.from_json(F.get_json_object("body", "$.extra_rules"), "array<string>")).alias("rule"))
    kind = F.get_json_object("rule", "$.match.kind")
    return rules.where(complete_rule(F.col("rule")) & kind.isin("command", "regex")).select("user_name", kind.alias("kind"), "rule")


def merge_overrides(overrides: DataFrame, rule_levels: dict[str, str], level: str = "audit") -> tuple[DataFrame, DataFrame]:
    """What of each user's file (user_name, body: JSON) tightens the policy, and what is a problem.

    Returns effective (user_name, level, floor, rule_levels, ui, extra_rules) and
    problems (user_name, problem, target). `level` is a floor, as it must also reach
    classes that rule_levels names.
    """
    top = F.from_json("body", "map<string, string>")
    rows = overrides.select("user_name", "body", F.schema_of_variant(F.try_parse_json("body")).alias("shape"), top.alias("m"))
    valid = F.coalesce(F.col("shape").startswith("OBJECT"), F.lit(False))
    base = F.create_map(*[F.lit(x) for kv in rule_levels.items() for x in kv]) if rule_levels else F.create_map().cast("map<string, string>")
    object_ = lambda k: F.coalesce(F.schema_of_variant(F.try_parse_json(F.col("m")[k])).startswith("OBJECT"), F.lit(False))
    entries = lambda k: F.coalesce(F.when(object_(k), F.map_entries(F.from_json(F.col("m")[k], "map<string, string>"))), F.array().cast("array<struct<key: string, value: string>>"))
    note = lambda p, t: F.struct(F.lit(p).alias("problem"), t.cast("string").alias("target"))
    known = lambda v: F.coalesce(S.level_rank(v) > 0, F.lit(False))
    harder = lambda v, than: known(v) & (S.level_rank(v) > S.level_rank(than))
    when = lambda test, p, t: F.when(test, F.array(note(p, t))).otherwise(F.array().cast(_PROBLEM))

    keys = F.coalesce(F.map_keys("m"), F.array().cast("array<string>"))
    rejected = F.transform(F.filter(keys, lambda k: k.isin(LOCAL_FORBIDDEN)), lambda k: note("LOCAL_OVERRIDE_REJECTED", k))
    unknown = F.transform(F.filter(keys, lambda k: ~k.isin(LOCAL_FORBIDDEN + LOCAL_ALLOWED)), lambda k: note("LOCAL_OVERRIDE_UNKNOWN", k))
    asked = F.col("m")["level"]
    of_level = F.concat(
        when(asked.isNotNull() & ~known(asked), "LOCAL_OVERRIDE_UNKNOWN", F.concat(F.lit("level="), asked)),
        when(known(asked) & ~harder(asked, F.lit(level)), "LOCAL_OVERRIDE_REJECTED", F.concat(F.lit("level="), asked)),
    )
    levels = entries("rule_levels")
    now = lambda k: F.coalesce(F.element_at(base, k), F.lit(level))
    name = lambda e: F.concat(F.lit("rule_levels."), e["key"])
    of_levels = F.concat(
        when(F.col("m")["rule_levels"].isNotNull() & ~object_("rule_levels"), "LOCAL_OVERRIDE_UNKNOWN", F.lit("rule_levels")),
        F.transform(F.filter(levels, lambda e: ~known(e["value"])), lambda e: note("LOCAL_OVERRIDE_UNKNOWN", name(e))),
        F.transform(F.filter(levels, lambda e: known(e["value"]) & ~harder(e["value"], now(e["key"]))), lambda e: note("LOCAL_OVERRIDE_REJECTED", name(e))),
    )
    given = F.coalesce(F.from_json(F.col("m")["extra_rules"], "array<string>"), F.array().cast("array<string>"))
    of_rules = when(F.exists(given, lambda r: ~complete_rule(r)), "LOCAL_OVERRIDE_UNKNOWN", F.lit("extra_rules"))
    ui = entries("ui")
    of_ui = F.concat(
        when(F.col("m")["ui"].isNotNull() & ~object_("ui"), "LOCAL_OVERRIDE_UNKNOWN", F.lit("ui")),
        F.transform(F.filter(ui, lambda e: ~e["key"].isin(LOCAL_UI_ALLOWED)), lambda e: note("LOCAL_OVERRIDE_UNKNOWN", F.concat(F.lit("ui."), e["key"]))),
    )
    problems = F.when(~valid, F.array(note("LOCAL_FILE_INVALID", F.lit(None)))).otherwise(F.concat(rejected, unknown, of_level, of_levels, of_rules, of_ui))
    found = rows.withColumn("problems", problems)
    tighter = F.map_from_entries(F.filter(levels, lambda e: harder(e["value"], now(e["key"]))))
    none = F.create_map().cast("map<string, string>")
    merged = F.map_zip_with(base, F.when(valid, tighter).otherwise(none), lambda k, a, b: F.coalesce(b, a))
    effective = found.select(
        "user_name",
        F.lit(level).alias("level"),
        F.when(valid & harder(asked, F.lit(level)), asked).alias("floor"),
        merged.alias("rule_levels"),
        F.when(valid, F.map_from_entries(F.filter(ui, lambda e: e["key"].isin(LOCAL_UI_ALLOWED)))).otherwise(none).alias("ui"),
        F.when(valid, F.filter(given, complete_rule)).otherwise(F.array().cast("array<string>")).alias("extra_rules"),
    )
    return effective, found.select("user_name", F.explode("problems").alias("p")).select("user_name", "p.*")


def problems_to_audit(problems: DataFrame) -> DataFrame:
    """Problem rows (problem, target) as audit events; disabled rules are silent."""
    action = F.when(F.col("problem") == "PARSER_ERROR", "error").otherwise("logged")
    rows = problems.where(~F.col("problem").eqNullSafe("RULE_DISABLED"))
    return rows.select(*[c for c in problems.columns if c not in ("problem", "class", "severity", "action", "rule")], F.col("problem").alias("rule"), F.lit("internal").alias("class"), F.lit("LOW").alias("severity"), action.alias("action"))


def seal_status(beats: DataFrame, locks: DataFrame) -> DataFrame:
    """Heartbeats (plugin_version, policy_sha) against the locked sum of their version: ok, tampered or unsealed."""
    sealed = locks.select("plugin_version", F.col("policy_sha").alias("_locked"))
    state = F.when(F.col("_locked").isNull(), "unsealed").when(F.col("_locked") == F.col("policy_sha"), "ok").otherwise("tampered")
    return beats.join(sealed, "plugin_version", "left").withColumn("seal", state).drop("_locked")


def rule_or_stub(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with severity and message of their rule; a rule that isn't loaded is a LOW stub."""
    known = rules.select("rule", F.col("severity").alias("_severity"), F.col("message").alias("_message"))
    joined = findings.join(known, "rule", "left")
    return joined.withColumn("severity", F.coalesce("_severity", F.lit("LOW"))).withColumn("message", F.coalesce("_message", F.concat(F.lit("rule "), "rule", F.lit(" isn't loaded")))).drop("_severity", "_message")


def with_repo(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Findings with the remote (normalised) and branch of their host and working directory."""
    known = repos.select("host", "cwd", S.normalize_remote(F.col("remote")).alias("repo"), "branch")
    return findings.join(known, ["host", "cwd"], "left")


def route(events: DataFrame, matchers: DataFrame) -> DataFrame:
    """(event_id, control) for every control whose event and whole-name tool pattern fit. matchers (event, matcher, control) is the table of hooks, a few dozen rows."""
    m = matchers.select(F.col("event").alias("_event"), "matcher", "control")
    fits = (F.col("event") == F.col("_event")) & F.rlike(F.coalesce("tool", F.lit("")), F.concat(F.lit(r"\A(?:"), "matcher", F.lit(r")\z")))
    return events.select("event_id", "event", "tool").join(F.broadcast(m), fits).select("event_id", "control")


def with_fail_mode(decision: Column, control: Column, blocking: list[str]) -> Column:
    """A row that can't be evaluated (null) asks where its control blocks, and is logged elsewhere."""
    return F.coalesce(decision, F.when(control.isin(blocking), "ask").otherwise("log"))


def evaluate_corpus(decisions: DataFrame) -> DataFrame:
    """Attacks, missed, legitimate, false_alarms and whether both gates hold, of (decision, attack)."""
    blocked = F.coalesce(F.col("decision").isin("deny", "ask"), F.lit(False))
    rows = decisions.agg(F.count_if(F.col("attack")).alias("attacks"), F.count_if(F.col("attack") & ~blocked).alias("missed"), F.count_if(~F.col("attack")).alias("legitimate"), F.count_if(~F.col("attack") & blocked).alias("false_alarms"))
    return rows.withColumn("passed", (F.col("missed") == 0) & (F.col("false_alarms") == 0))
