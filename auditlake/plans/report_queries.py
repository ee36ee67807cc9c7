"""Queries over the audit view that plain SQL can check."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditlake.functions import rules
from auditlake.functions import scalars as S
from auditlake.operators import config as G
from auditlake.operators import injection as I
from auditlake.operators import policy as P
from auditlake.operators import report as R
from auditlake.operators import sketches as K
from auditlake.plans.fixtures import WITH, audit, literal, table
from auditlake.sources.tables import shared_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def events(spark, d):
    return R.split_kind(audit(spark, d))[0]


@query("a01_counts", WITH + "SELECT count(*) FILTER (kind <> 'heartbeat') AS events, count(*) FILTER (kind = 'heartbeat') AS heartbeats FROM audit")
def _(spark, d):
    return R.counts(audit(spark, d))


@query("a02_by_rule", WITH + "SELECT coalesce(rule, '-') AS rule, count(*) AS n FROM audit WHERE kind = 'event' GROUP BY 1")
def _(spark, d):
    return R.by(events(spark, d), "rule")


@query("a03_by_action", WITH + "SELECT coalesce(action, '-') AS action, count(*) AS n FROM audit WHERE kind = 'event' GROUP BY 1")
def _(spark, d):
    return R.by(events(spark, d), "action")


_PCT = "SELECT {dims}list_sort(list(latency_ms))[count(latency_ms) // 2 + 1] AS p50, list_sort(list(latency_ms))[least(count(latency_ms) * 95 // 100, count(latency_ms) - 1) + 1] AS p95, count(latency_ms) AS n FROM audit WHERE kind = 'event' AND latency_ms IS NOT NULL {group}"


@query("a04_latency_pct", WITH + _PCT.format(dims="event, ", group="GROUP BY event"))
def _(spark, d):
    return R.latency_pct(events(spark, d), "event")


@query("t01_top_rules", WITH + ", pct AS (" + _PCT.format(dims="coalesce(rule, '-') AS rule, ", group="GROUP BY 1") + ") SELECT a.rule, a.n, p.p50, p.p95 FROM (SELECT coalesce(rule, '-') AS rule, count(*) AS n FROM audit WHERE kind = 'event' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15) a JOIN pct p ON a.rule = p.rule")
def _(spark, d):
    """Top rules with their latency: the flagship report."""
    e = events(spark, d).withColumn("rule", F.coalesce("rule", F.lit("-")))
    return R.top(e, "rule", 15).join(R.latency_pct(e, "rule").drop("n"), "rule")


@query("t02_top_actions", WITH + "SELECT coalesce(action, '-') AS action, count(*) AS n FROM audit WHERE kind = 'event' GROUP BY 1")
def _(spark, d):
    return R.top(events(spark, d), "action")


@query("a05_last_heartbeat", WITH + "SELECT user_name, max_by(event_id, ts) AS event_id, max_by(wsl, ts) AS wsl FROM audit WHERE kind = 'heartbeat' GROUP BY user_name")
def _(spark, d):
    beats = R.split_kind(audit(spark, d))[1]
    return beats.groupBy("user_name").agg(F.max_by(F.struct("event_id", "wsl"), F.struct("ts", "event_id")).alias("x")).select("user_name", "x.*")


@query("a06_tampered", WITH + "SELECT user_name, count(*) AS tampered FROM audit WHERE kind = 'heartbeat' AND policy_tampered GROUP BY 1")
def _(spark, d):
    return R.split_kind(audit(spark, d))[1].where("policy_tampered").groupBy("user_name").agg(F.count(F.lit(1)).alias("tampered"))


_RANK = "CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END"


@query("a07_worst_severity", WITH + f"SELECT session_id, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max({_RANK})] AS worst FROM audit GROUP BY 1")
def _(spark, d):
    rank = F.max(S.severity_rank(F.col("severity")))
    return audit(spark, d).groupBy("session_id").agg(F.get(F.array(*map(F.lit, S.SEVERITIES)), rank - 1).alias("worst"))


@query("a10_dir_hash", "SELECT source, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':sha256:' || sha256(text), chr(10) ORDER BY CAST(doc_id AS VARCHAR) || ':sha256:' || sha256(text))) AS dir_hash FROM documents WHERE text IS NOT NULL GROUP BY source")
def _(spark, d):
    from auditlake.operators import trust

    return trust.dir_hash(table(spark, d, "documents").where("text is not null").select(F.col("source").alias("dir"), F.col("doc_id").cast("string").alias("rel"), F.col("text").alias("content"))).withColumnRenamed("dir", "source")


@query("a11_masked", r"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9a-f]{40}\b')) AS v FROM documents) SELECT doc_id, 'HEX_TOKEN' AS type, left(v, 4) || '…' || right(v, 2) AS preview FROM f GROUP BY ALL""")
def _(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b([0-9a-f]{40})\b"), 1)).alias("v"))
    return found.select("doc_id", F.lit("HEX_TOKEN").alias("type"), S.mask(F.col("v")).alias("preview")).distinct()


@query("a13_field_names", "SELECT DISTINCT unnest(json_keys(props)) AS field FROM events")
def _(spark, d):
    return table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("field")).distinct()


@query("a15_fp_rate", WITH + ", j AS (SELECT rule, CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END AS fp FROM audit JOIN labels ON event_id = doc_id WHERE rule IS NOT NULL) SELECT rule, count(*) AS reviewed, round(avg(fp), 6) AS fp_rate, round(avg(fp), 6) > 0.05 AS demote FROM j GROUP BY rule")
def _(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("event_id"), (F.col("toxic") == 0).alias("false_positive"))
    return R.fp_rate(audit(spark, d).where("rule is not null"), labels)


_BUDGETS = [("PreToolUse", 30, 150), ("PostToolUse", 60, 300), ("SessionStart", 100, 500), ("ConfigChange", 50, 200)]


@query("a16_budget_breaches", WITH + ", p AS (" + _PCT.format(dims="event, ", group="GROUP BY event") + "), b(event, b50, b95) AS (VALUES " + ", ".join(map(lambda b: f"({literal(b[0])}, {b[1]}, {b[2]})", _BUDGETS)) + ") SELECT p.event, p50, p95, p50 > b50 AS over50, p95 > b95 AS over95 FROM p JOIN b ON p.event = b.event")
def _(spark, d):
    budgets = spark.createDataFrame(_BUDGETS, "event string, b50 int, b95 int")
    return R.latency_pct(events(spark, d), "event").join(F.broadcast(budgets), "event").select("event", "p50", "p95", (F.col("p50") > F.col("b50")).alias("over50"), (F.col("p95") > F.col("b95")).alias("over95"))


@query("a18_never_fired", WITH + "SELECT c.k AS rule FROM (SELECT DISTINCT rule AS k FROM audit WHERE class IN ('git-destructive', 'injection')) c WHERE k NOT IN (SELECT rule FROM audit WHERE rule IS NOT NULL AND user_name = 'u1' AND ts < TIMESTAMP '2024-01-03')")
def _(spark, d):
    a = audit(spark, d)
    return R.never_fired(a.select("rule", "class").distinct(), a.where("user_name = 'u1' AND ts < TIMESTAMP_NTZ '2024-01-03 00:00:00'"), ["git-destructive", "injection"]).select("rule")


@query("a20_escalation_share", WITH + "SELECT event, round(avg(CASE WHEN severity = 'MEDIUM' THEN 1.0 ELSE 0.0 END), 6) AS share, round(avg(CASE WHEN severity = 'MEDIUM' THEN 1.0 ELSE 0.0 END), 6) > 0.02 AS alarm FROM audit GROUP BY event")
def _(spark, d):
    share = F.round(F.avg(F.when(F.col("severity") == "MEDIUM", 1.0).otherwise(0.0)), 6)
    return audit(spark, d).groupBy("event").agg(share.alias("share")).withColumn("alarm", F.col("share") > 0.02)


@query("a21_sessions", WITH + "SELECT count(DISTINCT session_id) AS sessions, count(DISTINCT user_name) AS users, TRUE AS close FROM audit")
def _(spark, d):
    # Each distinct value once, before the sketch: beside exact counts in one aggregate Spark keeps a sketch for each session.
    a = audit(spark, d)
    exact = F.count("session_id")
    near = F.approx_count_distinct("session_id", 0.02)
    sessions = a.select("session_id").distinct().agg(exact.alias("sessions"), (F.abs(near - exact) <= exact * 0.1).alias("close"))
    users = a.select("user_name").distinct().agg(F.count("user_name").alias("users"))
    return sessions.crossJoin(users).select("sessions", "users", "close")


_BUCKET = "(v - v % CAST(pow(2, greatest(length(bin(v)) - 7, 0)) AS BIGINT))"


@query("a21_days", WITH + f""", a AS (SELECT coalesce(rule, '-') AS rule, session_id, CAST(latency_ms AS BIGINT) AS v FROM audit WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'), r AS (SELECT rule, v, row_number() OVER (PARTITION BY rule ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY rule) AS m FROM a WHERE v IS NOT NULL), q AS (SELECT rule, max({_BUCKET}) FILTER (i = m * 50 // 100) AS p50, max({_BUCKET}) FILTER (i = least(m * 95 // 100, m - 1)) AS p95 FROM r GROUP BY 1), t AS (SELECT rule, count(*) AS n, TRUE AS close FROM a GROUP BY 1) SELECT t.rule, n, p50, p95, close FROM t JOIN q USING (rule)""")
def _(spark, d):
    """A span of days from stored summaries of each day; distinct sessions are compared with their exact number."""
    a = audit(spark, d).withColumn("rule", F.coalesce("rule", F.lit("-"))).withColumn("day", F.col("ts").cast("date").cast("string"))
    path = shared_path(spark, "days")
    K.store_days(K.summarise_days(a, ["rule"]), path)
    found = K.over_days(K.read_days(spark, path, "2024-01-05", "2024-01-20"), ["rule"])
    exact = a.where(F.col("day").between("2024-01-05", "2024-01-20")).groupBy("rule").agg(F.count_distinct("session_id").alias("exact"))
    return found.join(exact, "rule").select("rule", "n", "p50", "p95", (F.abs(F.col("who") - F.col("exact")) <= 0.08 * F.col("exact")).alias("close"))


@query("p02_split_kind", WITH + "SELECT kind, count(*) AS n, min(event_id) AS first_id FROM audit GROUP BY kind")
def _(spark, d):
    e, h = R.split_kind(audit(spark, d))
    return e.unionByName(h).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("p03_since", WITH + "SELECT event_id FROM audit WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S') >= '2024-01-24'")
def _(spark, d):
    return R.since(audit(spark, d).withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), "2024-01-24", "iso").select("event_id")


@query("p09_would_block", WITH + "SELECT event_id, rule FROM audit WHERE severity IN ('CRITICAL', 'HIGH')")
def _(spark, d):
    return R.would_block(audit(spark, d)).select("event_id", "rule")


@query("p10_dialog_leaks", "SELECT count(*) AS leaks FROM events WHERE regexp_matches(props, '\"(prompt_text|messages|transcript)\"')")
def _(spark, d):
    return table(spark, d, "events").where(F.col("props").rlike('"(prompt_text|messages|transcript)"')).agg(F.count(F.lit(1)).alias("leaks"))


@query("p12_by_agent", WITH + "SELECT rule, target, count(DISTINCT severity) = 1 AS same FROM audit WHERE rule IS NOT NULL GROUP BY rule, target")
def _(spark, d):
    return audit(spark, d).where("rule is not null").groupBy("rule", "target").agg((F.count_distinct("severity") == 1).alias("same"))


@query("p13_off_platform", WITH + "SELECT event_id, user_name, 'platform-not-wsl' AS rule, 'MEDIUM' AS severity, 'warned' AS action FROM audit WHERE kind = 'heartbeat' AND NOT wsl")
def _(spark, d):
    beats = R.split_kind(audit(spark, d))[1].where(~F.col("wsl")).select("event_id", "user_name", F.lit("platform-not-wsl").alias("rule"), F.lit("platform").alias("class"), F.lit("MEDIUM").alias("severity"))
    level = P.effective_level(beats, P.rule_levels(spark))
    return level.select("event_id", "user_name", "rule", "severity", F.when(F.col("level") == "audit", "logged").otherwise("warned").alias("action"))


@query("p18_heartbeats", WITH + "SELECT ts, user_name, wsl, policy_tampered FROM audit WHERE kind = 'heartbeat'")
def _(spark, d):
    return R.split_kind(audit(spark, d))[1].select("ts", "user_name", "wsl", "policy_tampered")


_LEVELS = ", levels(k, l) AS (VALUES " + ", ".join(f"({literal(k)}, {literal(v)})" for k, v in (P.CLASS_LEVELS | {"git-reset-hard": "audit"}).items()) + ")"
_LEVEL = WITH + _LEVELS + ", lv AS (SELECT a.*, coalesce(r.l, c.l, 'warn') AS level FROM audit a LEFT JOIN levels r ON a.rule = r.k LEFT JOIN levels c ON a.class = c.k)"
_DECISION = "CASE level WHEN 'strict' THEN CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'deny' WHEN severity = 'MEDIUM' THEN 'ask' ELSE 'warn' END WHEN 'warn' THEN 'warn' ELSE 'log' END"


@query("j05_effective_level", _LEVEL + " SELECT event_id, CASE WHEN level = 'strict' THEN 'strict' WHEN event_id % 2 = 0 THEN 'strict' ELSE level END AS level FROM lv")
def _(spark, d):
    floor = F.when(F.col("event_id") % 2 == 0, "strict").otherwise("audit")
    return P.effective_level(audit(spark, d), P.rule_levels(spark, {"git-reset-hard": "audit"}), floor=floor).select("event_id", "level")


_EXEMPT = [(1, "git-reset-hard", "^t1$", "2024-01-10"), (2, "git-reset-hard", None, "2030-01-01"), (3, "command-chmod-world", "^t[01]$", "2030-01-01"), (4, "path-ssh-key", None, "not a date")]
_EXEMPT_SQL = ", ex(position, r, g, expires) AS (VALUES " + ", ".join(f"({', '.join(map(literal, e))})" for e in _EXEMPT) + ")"
_EX = ", hit AS (SELECT event_id, position, coalesce(TRY_CAST(expires AS DATE) >= DATE '2024-01-20', FALSE) AS alive FROM {src} JOIN ex ON rule = r AND (g IS NULL OR regexp_matches(target, g))), e2 AS (SELECT event_id, min(position) FILTER (alive) AS exemption, bool_or(NOT alive) AS expired_hit FROM hit GROUP BY 1)"


def exemptions(spark):
    return spark.createDataFrame(_EXEMPT, "position int, rule string, target_regex string, expires string")


@query("j06_exemptions", WITH + _EXEMPT_SQL + _EX.format(src="audit") + " SELECT a.event_id, exemption, exemption IS NOT NULL AS exempt, coalesce(expired_hit, FALSE) AS expired_hit FROM audit a LEFT JOIN e2 ON a.event_id = e2.event_id")
def _(spark, d):
    return P.apply_exemptions(audit(spark, d), exemptions(spark), "2024-01-20").select("event_id", "exemption", "exempt", "expired_hit")


@query("l02_resolve", _LEVEL + _EXEMPT_SQL + _EX.format(src="lv") + f", dd AS (SELECT lv.*, exemption IS NOT NULL AS exempt, CASE WHEN exemption IS NOT NULL THEN 'log' ELSE {_DECISION} END AS decision FROM lv LEFT JOIN e2 ON lv.event_id = e2.event_id) SELECT event_id, level, decision, exempt FROM dd")
def _(spark, d):
    found = P.resolve(audit(spark, d), P.rule_levels(spark, {"git-reset-hard": "audit"}), exemptions(spark), "2024-01-20")
    return found.select("event_id", "level", "decision", "exempt")


_TURN = "2024-01-15 00:00:00"
_OWN = "CASE WHEN user_id % 4 = 0 AND ts >= TIMESTAMP '" + _TURN + "' THEN 'strict' WHEN rule = 'git-reset-hard' THEN 'audit' WHEN class = 'privilege' AND user_id % 4 = 1 THEN 'strict' ELSE level END"


@query("l02_user_policy", _LEVEL + _EXEMPT_SQL + f", own AS (SELECT lv.* REPLACE ({_OWN} AS level) FROM lv JOIN (SELECT event_id, user_id FROM events) USING (event_id) WHERE target <> 't3')" + _EX.format(src="own") + f", dd AS (SELECT own.*, exemption IS NOT NULL AS exempt, CASE WHEN exemption IS NOT NULL THEN 'log' ELSE {_DECISION} END AS decision FROM own LEFT JOIN e2 ON own.event_id = e2.event_id) SELECT event_id, level, decision, exempt FROM dd")
def _(spark, d):
    """Every user's file as it was at the time: one in four tightens everything from a day on, another one a class; t3 is excluded."""
    users = table(spark, d, "events").select("user_id").distinct()
    user = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_name")
    before = users.where("user_id % 4 = 0").select(user, F.lit("{}").alias("body"), F.lit(None).cast("timestamp").alias("since"))
    after = users.where("user_id % 4 = 0").select(user, F.lit('{"level": "strict"}').alias("body"), F.lit(_TURN).cast("timestamp").alias("since"))
    one = users.where("user_id % 4 = 1").select(user, F.lit('{"rule_levels": {"privilege": "strict", "git-destructive": "audit"}}').alias("body"), F.lit(None).cast("timestamp").alias("since"))
    files = before.unionByName(after).unionByName(one)
    levels = P.CLASS_LEVELS | {"git-reset-hard": "audit"}
    effective = G.merge_overrides(files.select("user_name", "body").distinct(), levels, "warn")[0]
    # A file's content stands for what it makes of the policy.
    versions = effective.join(files.where("since IS NOT NULL").select("user_name", F.lit("strict").alias("floor"), "since"), ["user_name", "floor"], "left")
    rows = audit(spark, d).withColumn("cwd", F.lit("/w"))
    found = P.resolve(rows, P.rule_levels(spark, {"git-reset-hard": "audit"}), exemptions(spark), "2024-01-20", overlay=P.overlays(versions), exclusions=["t3"])
    return found.select("event_id", "level", "decision", "exempt")


@query("l03_what_if", _LEVEL + f", b AS (SELECT class, {_DECISION} AS before, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'deny' WHEN severity = 'MEDIUM' THEN 'ask' ELSE 'warn' END AS after FROM lv) SELECT class, before, after, count(*) AS n FROM b GROUP BY ALL")
def _(spark, d):
    levels = P.rule_levels(spark, {"git-reset-hard": "audit"})
    strict = levels.withColumn("level", F.lit("strict"))
    events_ = audit(spark, d)
    return P.what_if(events_.where("class is not null"), levels, strict).unionByName(events_.where("class is null").select(F.lit(None).cast("string").alias("class"), F.lit("warn").alias("before"), F.when(F.col("severity").isin("CRITICAL", "HIGH"), "deny").when(F.col("severity") == "MEDIUM", "ask").otherwise("warn").alias("after")).groupBy("class", "before", "after").agg(F.count(F.lit(1)).alias("n")))


@query("j07_artifact_drift", "WITH old AS (SELECT source AS repo, doc_id, 'sha256:' || sha256(text) AS h FROM documents WHERE text IS NOT NULL), new AS (SELECT source AS repo, doc_id, 'sha256:' || sha256(CASE WHEN doc_id % 7 = 0 THEN text || '#' ELSE text END) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 0) SELECT coalesce(o.repo, n.repo) AS repo, CAST(coalesce(o.doc_id, n.doc_id) AS VARCHAR) AS rel, coalesce(o.h, 'absent') AS before, coalesce(n.h, 'absent') AS after FROM old o FULL JOIN new n ON o.repo = n.repo AND o.doc_id = n.doc_id WHERE coalesce(o.h, 'absent') <> coalesce(n.h, 'absent')")
def _(spark, d):
    from auditlake.operators import trust

    docs = table(spark, d, "documents").where("text is not null").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("rel"), "doc_id", "text")
    old = docs.select("repo", "rel", S.content_hash(F.col("text")).alias("hash"))
    new = docs.where("doc_id % 10 <> 0").select("repo", "rel", S.content_hash(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("#"))).otherwise(F.col("text"))).alias("hash"))
    return trust.diff_artifacts(old, new)


@query("j09_missing_rules", "WITH want(rule) AS (VALUES ('error'), ('click'), ('refund')), have AS (SELECT DISTINCT user_id, event_type AS rule FROM events), users AS (SELECT DISTINCT user_id FROM events) SELECT user_id, want.rule FROM users, want WHERE NOT EXISTS (SELECT 1 FROM have WHERE have.user_id = users.user_id AND have.rule = want.rule)")
def _(spark, d):
    have = table(spark, d, "events").select("user_id", F.col("event_type").alias("rule")).distinct()
    want = spark.createDataFrame([("error",), ("click",), ("refund",)], "rule string")
    return have.select("user_id").distinct().join(F.broadcast(want)).join(have, ["user_id", "rule"], "left_anti")


_KINDS = ", ".join(f"({literal(k)}, {literal(v)})" for k, v in (("GITHUB_TOKEN", "CRITICAL"), ("AWS_ACCESS_KEY_ID", "CRITICAL"), ("PRIVATE_KEY", "CRITICAL"), ("ENV_SECRET", "HIGH")))


@query("j10_secret_severity", rf"""WITH f AS (SELECT source, t FROM documents, (VALUES ('GITHUB_TOKEN', '\bgh[pousr]_[A-Za-z0-9]{{36}}\b'), ('AWS_ACCESS_KEY_ID', '\b(AKIA|ASIA)[A-Z0-9]{{16}}\b'), ('PRIVATE_KEY', '-----BEGIN [A-Z ]*PRIVATE KEY-----'), ('ENV_SECRET', '(API_KEY|SECRET_ACCESS_KEY|PASSWORD|TOKEN)=[^\s''"]{{6,}}'), ('HEX_TOKEN', '\b[0-9a-f]{{40}}\b')) AS p(t, rx) WHERE regexp_matches(text, rx)), s(t, severity) AS (VALUES {_KINDS}) SELECT source, ['MEDIUM', 'HIGH', 'CRITICAL'][max(CASE coalesce(severity, 'MEDIUM') WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 ELSE 1 END)] AS severity FROM f LEFT JOIN s USING (t) GROUP BY 1""")
def _(spark, d):
    """Secrets found in every whole text, rated by a rule table that doesn't know hexadecimal tokens, by source."""
    docs = table(spark, d, "documents")
    found = I.secret_findings(docs.select(F.struct("doc_id", "source").alias("id"), "text"), "id", "text").select("id.source", "type")
    known = spark.createDataFrame([(t, s) for t, s, _ in rules.SECRETS if t != "HEX_TOKEN"], "rule string, severity string")
    return I.secret_severity(found, known, ["source"])



@query("j11_heartbeat_gaps", WITH + ", b AS (SELECT DISTINCT user_name, CAST(ts AS DATE) AS day FROM audit WHERE kind = 'heartbeat'), u AS (SELECT DISTINCT user_name FROM audit), dd AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM audit) SELECT user_name, day FROM u, dd WHERE (user_name, day) NOT IN (SELECT user_name, day FROM b)")
def _(spark, d):
    a = audit(spark, d).withColumn("day", S.day_key(F.col("ts")))
    return R.heartbeat_gaps(R.split_kind(a)[1], a.select("user_name").distinct(), a.select("day"))


@query("w03_cap_rows", WITH + "SELECT session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS rn FROM audit) WHERE rn <= 8")
def _(spark, d):
    return R.cap_rows(audit(spark, d), 8, ["session_id"], ["event_id"]).select("session_id", "event_id")


@query("w06_previous", WITH + "SELECT event_id, lag(action) OVER (PARTITION BY user_name ORDER BY ts, event_id) AS before FROM audit")
def _(spark, d):
    return audit(spark, d).select("event_id", F.lag("action").over(Window.partitionBy("user_name").orderBy("ts", "event_id")).alias("before"))


_HAVE = "WITH have AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS have FROM events GROUP BY 1)"


def _deny(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("have"))


@query("u02_merge_settings", _HAVE + " SELECT user_id, list_concat(have, list_filter(['click', 'refund'], lambda x: NOT list_contains(have, x))) AS deny FROM have")
def _(spark, d):
    return _deny(spark, d).select("user_id", F.array_union("have", F.array(F.lit("click"), F.lit("refund"))).alias("deny"))


@query("u03_template_applied", _HAVE + " SELECT user_id, list_contains(have, 'click') AND list_contains(have, 'signup') AND user_id % 2 = 0 AS applied FROM have")
def _(spark, d):
    want = F.array(F.lit("click"), F.lit("signup"))
    return _deny(spark, d).select("user_id", ((F.size(F.array_except(want, "have")) == 0) & (F.when(F.col("user_id") % 2 == 0, False)).eqNullSafe(False)).alias("applied"))


@query("u05_haystacks", "SELECT conv_id, turn, 0 AS haystack, length(text) AS n FROM conversations WHERE text IS NOT NULL UNION ALL SELECT conv_id, turn, 1, length(text) FROM conversations WHERE text LIKE '%' || chr(8203) || '%'")
def _(spark, d):
    raw, norm = F.col("text"), S.normalize_text(F.col("text"))
    c = table(spark, d, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.posexplode(F.array_distinct(F.array(raw, norm))).alias("haystack", "h")).select("conv_id", "turn", "haystack", F.length("h").alias("n"))


@query("k08_report_json", WITH + """SELECT '{"rule":"' || coalesce(rule, '-') || '","n":' || count(*) || '}' AS line FROM audit GROUP BY rule""")
def _(spark, d):
    return R.by(audit(spark, d), "rule").select(F.to_json(F.struct("rule", "n")).alias("line"))


@query("k09_retention", "WITH days AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events) SELECT day FROM days WHERE CAST(day AS DATE) < DATE '2024-01-20' - INTERVAL 7 DAY")
def _(spark, d):
    return R.retention(table(spark, d, "events").select(F.to_date("ts").cast("string").alias("day")).distinct(), 7, "2024-01-20")


@query("x08_session_windows", WITH + "SELECT session_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM audit GROUP BY 1")
def _(spark, d):
    return audit(spark, d).groupBy("session_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@query("d03_sql_functions", WITH + f", e AS (SELECT event_id, c, count(*) / 6.0 AS p FROM (SELECT event_id, unnest(string_split(left(session_id || 'aabbcc', 6), '')) AS c FROM audit) GROUP BY ALL), h AS (SELECT event_id, round(-sum(p * log2(p)), 6) AS entropy FROM e GROUP BY 1) SELECT event_id, {_DECISION.replace('level', chr(39) + 'strict' + chr(39))} AS decision, CASE WHEN length(session_id) <= 8 THEN repeat('*', length(session_id)) ELSE left(session_id, 4) || '…' || right(session_id, 2) END AS masked, 'git.example.com/' || host AS remote, entropy FROM audit JOIN h USING (event_id)")
def _(spark, d):
    S.register(spark)
    return audit(spark, d).select("event_id", F.expr("audit_decision(severity, 'strict')").alias("decision"), F.expr("audit_mask(session_id)").alias("masked"), F.expr("audit_remote(concat('git@git.example.com:', host, '.git'))").alias("remote"), F.expr("round(audit_entropy(left(concat(session_id, 'aabbcc'), 6)), 6)").alias("entropy"))


@query("f04_mask", r"SELECT doc_id, CASE WHEN length(text) <= 8 THEN repeat('*', length(text)) ELSE left(regexp_replace(text, '\s', ' ', 'g'), 4) || '…' || right(regexp_replace(text, '\s', ' ', 'g'), 2) END AS masked FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", S.mask(F.col("text")).alias("masked"))


@query("f08_f09_normalise", "WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN chr(8203) || text || chr(65279) || chr(1072) WHEN 1 THEN text || chr(1077) ELSE text END AS text FROM documents) SELECT doc_id, CAST(length(regexp_replace(text, '[\\x{200b}-\\x{200d}\\x{2060}\\x{feff}\\x{180e}]', '', 'g')) AS INT) AS n, md5(translate(regexp_replace(text, '[\\x{200b}-\\x{200d}\\x{2060}\\x{feff}\\x{180e}]', '', 'g'), '" + S.CYRILLIC + "', '" + S.LATIN + "')) AS plain FROM t")
def _(spark, d):
    # Some texts get characters of zero width or look-alikes.
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\u200b"), "text", F.lit("\ufeff\u0430"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("\u0435"))).otherwise(F.col("text")).alias("text"))
    return docs.select("doc_id", F.length(S.strip_zero_width(F.col("text"))).alias("n"), F.md5(S.normalize_text(F.col("text")).cast("binary")).alias("plain"))


@query("f13_line_number", "SELECT doc_id, CAST(length(left(text, length(text) // 2)) - length(replace(left(text, length(text) // 2), chr(10), '')) + 1 AS INT) AS middle, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS last FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", S.line_number(F.col("text"), F.expr("CAST(length(text) div 2 AS INT)")).alias("middle"), S.line_number(F.col("text"), F.length("text")).alias("last"))


@query("f16_entropy", "WITH c AS (SELECT event_id, unnest(string_split(event_type || props, '')) AS c, length(event_type || props) AS n FROM events), p AS (SELECT event_id, c, count(*) / any_value(n) AS p FROM c GROUP BY event_id, c) SELECT event_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY event_id")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(S.shannon_entropy(F.concat("event_type", "props")), 6).alias("entropy"))


@query("f19_reason", WITH + "SELECT event_id, concat_ws(chr(10) || chr(10), 'rule ' || rule, 'What to do: ' || action, 'See: ' || target) AS reason FROM audit")
def _(spark, d):
    return audit(spark, d).select("event_id", S.format_reason(F.concat(F.lit("rule "), "rule"), F.col("action"), F.col("target")).alias("reason"))


@query("f20_keys", WITH + "SELECT event_id, left(regexp_replace(session_id || '!/' || host, '[^A-Za-z0-9_-]', '', 'g'), 64) AS skey, coalesce(rule, '-') || '|' || target || '|' || coalesce(agent_id, '-') AS mkey FROM audit")
def _(spark, d):
    return audit(spark, d).select("event_id", S.session_key(F.concat("session_id", F.lit("!/"), "host")).alias("skey"), S.memory_key(F.col("rule"), F.col("target"), F.col("agent_id")).alias("mkey"))


@query("f27_f28_ids", r"WITH u AS (SELECT page_id, html, CASE page_id % 3 WHEN 0 THEN url || '.git' WHEN 1 THEN replace(url, '://', '://user@') ELSE url END AS url FROM pages) SELECT page_id, left(sha256(rtrim(regexp_replace(regexp_replace(regexp_replace(trim(url), '^https?://', ''), '^[^/@]*@', ''), '\.git$', ''), '/')), 16) AS repo, 'sha256:' || sha256(html) AS hash FROM u")
def _(spark, d):
    # Some addresses get a user or the ending of a repository.
    url = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".git"))).when(F.col("page_id") % 3 == 1, F.replace("url", F.lit("://"), F.lit("://user@"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", S.repo_id(url, F.lit("/")).alias("repo"), S.content_hash(F.col("html")).alias("hash"))


@query("f29_f30_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS iso, CAST(ts AS DATE) AS day, ts < TIMESTAMP '2024-01-16' AND epoch_us(TIMESTAMP '2024-01-16') - epoch_us(ts) < 86400000000 OR ts >= TIMESTAMP '2024-01-16' AS fresh FROM events")
def _(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", S.iso_ts(ts).alias("iso"), S.day_key(ts).alias("day"), S.within_ttl(ts, F.lit("2024-01-16 00:00:00").cast("timestamp"), -1).alias("fresh"))


@query("f31_f35_decisions", _LEVEL + f", x AS (SELECT event_id, severity, {_DECISION} AS decision FROM lv) SELECT event_id, decision, decision = 'deny' AND severity = 'CRITICAL' AS final, CASE WHEN event_id % 4 = 0 THEN 'logged' ELSE CASE decision WHEN 'deny' THEN 'denied' WHEN 'ask' THEN 'asked' WHEN 'warn' THEN 'warned' ELSE 'logged' END END AS outcome, CASE WHEN event_id % 7 >= 4 OR event_id % 3 >= 2 THEN 'high' WHEN event_id % 7 >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM x")
def _(spark, d):
    found = P.effective_level(audit(spark, d), P.rule_levels(spark, {"git-reset-hard": "audit"})).withColumn("decision", S.decision_for(F.col("severity"), F.col("level")))
    return found.select("event_id", "decision", S.is_final(F.col("severity"), F.col("decision")).alias("final"), S.audit_action(F.col("decision"), F.col("event_id") % 4 == 0).alias("outcome"), S.confidence(F.col("event_id") % 7, F.col("event_id") % 3).alias("confidence"))


@query("f37_event_target", WITH + "SELECT event_id, CASE event_id % 3 WHEN 0 THEN target WHEN 1 THEN host ELSE event END AS t FROM audit")
def _(spark, d):
    e = F.col("event_id") % 3
    return audit(spark, d).select("event_id", S.event_target(F.when(e == 0, F.col("target")), F.when(e == 1, F.col("host")), F.lit(None).cast("string"), F.col("event")).alias("t"))
