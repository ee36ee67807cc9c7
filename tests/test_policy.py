"""Policies of users over time, failing rules, long histories."""

import json
import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions import rules
from auditlake.operators import commands as C
from auditlake.operators import config as G
from auditlake.operators import policy as P
from auditlake.operators import trust as T
from tests.test_audit import _log


def effective(spark, *rows):
    files = spark.createDataFrame([(u, json.dumps(b)) for u, b in rows], "user_name string, body string")
    return G.merge_overrides(files, P.CLASS_LEVELS, "warn")[0]


def classified(spark, log, overlay=None, extra=None, table=None, level="warn"):
    none = spark.createDataFrame([], "position int, rule string, target_regex string, expires string")
    verdicts, records = C.classify_commands(log, table or C.rule_table(spark, rules.COMMANDS), [], P.rule_levels(spark), none, "2024-06-01", ["main"], level=level, overlay=overlay, extra=extra)
    return {r.event_id: (r.decision, r.rule) for r in verdicts.collect()}, records.collect()


def lines_of_users(spark, *rows):
    frames = [_log(spark, [line], session_id=f"s{i}").withColumn("event_id", F.lit(i).cast("long")).withColumn("user_name", F.lit(user)) for i, (user, line) in enumerate(rows)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def test_one_line_two_users_two_verdicts(spark):
    log = lines_of_users(spark, ("loose", "sudo ls"), ("strict", "sudo ls"), ("class", "sudo ls"), (None, "sudo ls"), ("loose", "$(cat x) y"), ("strict", "$(cat x) y"))
    overlay = P.overlays(effective(spark, ("strict", {"level": "strict"}), ("class", {"rule_levels": {"privilege": "strict", "git-destructive": "audit"}})))
    found, records = classified(spark, log, overlay)
    assert found[0] == found[3] == (None, None) and found[1] == found[2] == ("deny", "command-sudo")
    # A user's floor also makes what can't be resolved a question.
    assert found[4] == (None, None) and found[5] == ("ask", "PARSER_UNRESOLVED")
    assert {(r.event_id, r.level) for r in records if r.rule == "command-sudo"} == {(0, "audit"), (1, "strict"), (2, "strict"), (3, "audit")}


def test_overlays_hold_from_and_until(spark):
    rows = effective(spark, ("u", {"level": "strict"})).withColumn("since", F.lit("2024-01-10").cast("timestamp")).unionByName(effective(spark, ("u", {})).withColumn("since", F.lit("2024-01-20").cast("timestamp")))
    found = spark.createDataFrame([(i, "u", "command-sudo", "privilege", f"2024-01-{d:02}") for i, d in enumerate([9, 10, 19, 20, 25])], "event_id long, user_name string, rule string, class string, day string").withColumn("ts", F.col("day").cast("timestamp"))
    got = {r.event_id: r.level for r in P.effective_level(found, P.rule_levels(spark), overlay=P.overlays(rows)).collect()}
    assert got == {0: "audit", 1: "strict", 2: "strict", 3: "audit", 4: "audit"}


def test_exclusions_are_paths_below_the_working_directory(spark):
    rows = spark.createDataFrame([("/w/tests/a", "/w"), ("/x/tests/a", "/w"), ("tests/b", "/w"), ("src/b", "/w"), (None, "/w"), ("tests/c", None)], "target string, cwd string")
    assert sorted(r.target or "" for r in P.without_excluded(rows, ["tests/**"]).collect()) == ["", "/x/tests/a", "src/b"]


def extra_rule(name, kind="command", **match):
    rule = rules._rule(name, "privilege", "CRITICAL", "m", **match)
    return rule | {"match": rule["match"] | {"kind": kind}, "remediation": "r", "reference": "r"}


def test_rules_of_users_judge_their_own_lines(spark):
    bodies = [("a", {"extra_rules": [extra_rule("own-terraform", argv0=["terraform"]), extra_rule("own-word", "regex", pattern="secret-word")], "level": "strict"}), ("b", {})]
    files = spark.createDataFrame([(u, json.dumps(b)) for u, b in bodies], "user_name string, body string")
    log = lines_of_users(spark, ("a", "terraform apply"), ("b", "terraform apply"), ("a", "echo secret-word"), ("b", "echo secret-word"), (None, "terraform x"))
    found, _ = classified(spark, log, P.overlays(effective(spark, *bodies)), G.extra_rules(files))
    assert found == {0: ("deny", "own-terraform"), 1: (None, None), 2: ("deny", "own-word"), 3: (None, None), 4: (None, None)}


def test_a_broken_rule_asks_and_stops_nothing(spark):
    bodies = [("a", {"extra_rules": [extra_rule("own-broken", "regex", pattern="(")]}), ("b", {})]
    files = spark.createDataFrame([(u, json.dumps(b)) for u, b in bodies], "user_name string, body string")
    log = lines_of_users(spark, ("a", "ls"), ("b", "ls"), ("a", "rm -rf /"))
    found, records = classified(spark, log, extra=G.extra_rules(files))
    assert found == {0: ("ask", "PARSER_ERROR"), 1: (None, None), 2: ("deny", "command-rm-root")}
    assert {(r.event_id, r.outcome, r.error) for r in records if r.rule == "PARSER_ERROR"} == {(i, "error", "pattern doesn't compile: (") for i in (0, 2)}
    table = C.rule_table(spark, [*rules.COMMANDS, rules._rule("broken", "privilege", "HIGH", "m", args_regex_any=["[a"])])
    found, _ = classified(spark, lines_of_users(spark, ("a", "ls")), table=table)
    assert found == {0: ("ask", "PARSER_ERROR")}


def brute_memory(rows, ttl):
    last, out = {}, {}
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        out[i] = key in last and t - last[key] < ttl
        if not out[i]:
            last[key] = t
    return out


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_memory_over_batches(spark, batch):
    pick = random.Random(1)
    rows = [(pick.choice("abc"), pick.randint(0, 300), i) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        frame = spark.createDataFrame(rows, "target string, hour long, event_id long").select("*", F.timestamp_seconds(F.col("hour") * 3600).alias("ts"), F.lit("s").alias("session_id"), F.lit("r").alias("rule"), F.lit(None).cast("string").alias("agent_id"), F.lit("warn").alias("decision"))
        got = {r.event_id: r.suppressed for r in P.session_memory(frame).collect()}
        no_session = P.session_memory(frame.withColumn("session_id", F.lit(None).cast("string"))).where("suppressed").count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_memory(rows, 24) and no_session == 0


def test_a_key_with_a_million_events(spark):
    frame = spark.range(1_000_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("s").alias("session_id"), F.lit("r").alias("rule"), F.lit("t").alias("target"), F.lit(None).cast("string").alias("agent_id"), F.lit("warn").alias("decision"))
    assert P.session_memory(frame).where("NOT suppressed").count() == -(-1_000_000 // 1440)
    events = spark.range(300_000).select(F.lit("r").alias("repo"), F.col("id").alias("seq"), F.lit("snapshot").alias("kind"), F.when(F.col("id") < 299_999, "a").otherwise("b").alias("fingerprint"), F.lit(0).alias("findings"))
    assert {(r.status, r["count"]) for r in T.trust_history(events).groupBy("status").count().collect()} == {("trusted", 299_999), ("quarantined", 1)}


def test_session_starts_leave_baselines(spark, tmp_path):
    path = str(tmp_path / "baselines")
    see = lambda *rows: spark.createDataFrame(list(rows), "repo string, rel string, hash string")
    hot = lambda *rows: spark.createDataFrame(list(rows), "repo string, key string")
    start = lambda a, f, at: {r.repo: (r.status, r.rule, r.action) for r in T.start_sessions(a, f, path, at).collect()}
    clean, risky = ("clean", "CLAUDE.md", "h1"), ("risky", ".mcp.json", "h2")
    assert start(see(clean, risky), hot(("risky", "mcpServers")), "2024-01-01") == {"clean": ("trusted", None, "logged"), "risky": ("pending", "config-untrusted-new", "warned")}
    # Unchanged: the trusted one is silent and leaves nothing; the other one waits for an approval.
    before = spark.read.parquet(path).where("repo = 'clean'").count()
    assert start(see(clean, risky), hot(("risky", "mcpServers")), "2024-01-02")["clean"] == ("trusted", None, "logged")
    assert spark.read.parquet(path).where("repo = 'clean'").count() == before == 1
    T.approve(see(risky), hot(("risky", "mcpServers")), ["risky"], path, "2024-01-03")
    assert start(see(clean, risky), hot(("risky", "mcpServers")), "2024-01-04")["risky"] == ("trusted", None, "logged")
    # Changed: quarantined, and reported until someone approves, although the new state is the baseline's.
    moved = ("clean", "CLAUDE.md", "h9")
    for day in ("2024-01-05", "2024-01-06"):
        assert start(see(moved, risky), hot(("risky", "mcpServers")), day)["clean"] == ("quarantined", "config-quarantined", "blocked_config")
    assert {r.repo: r.status for r in T.baselines_at(spark, path, "2024-01-04").collect()} == {"clean": "trusted", "risky": "trusted"}
    assert {r.repo: r.status for r in T.baselines_at(spark, path).collect()} == {"clean": "quarantined", "risky": "trusted"}
