"""Column expressions for audit data. All are built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Ordered enumerations, lowest first.
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
LEVELS = ["audit", "warn", "strict"]
DECISIONS = ["log", "warn", "ask", "deny"]

# Characters without width (ZWSP, ZWNJ, ZWJ, word joiner, BOM, Mongolian vowel separator),
# and Cyrillic letters with the Latin letters that they look like.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u180e"
CYRILLIC = "аеорсхукмнтвіѕјАЕОРСХУКМНТВ"
LATIN = "aeopcxykmhtbisjAEOPCXYKMHTB"

EVIDENCE = 512


def _rank(values: list[str], col: Column) -> Column:
    """Place in an ordered enumeration from 1; unknown and null are 0."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, values)), col), F.lit(0)).cast("int")


def severity_rank(col: Column) -> Column:
    return _rank(SEVERITIES, col)


def level_rank(col: Column) -> Column:
    return _rank(LEVELS, col)


def decision_rank(col: Column) -> Column:
    return _rank(DECISIONS, col)


def harder(a: Column, b: Column) -> Column:
    """the stricter level; an unknown one ranks lowest and a tie keeps the first."""
    unknown = lambda c: F.greatest(level_rank(c), F.lit(1))
    return F.when(unknown(b) > unknown(a), b).otherwise(a)


def decision_for(severity: Column, level: Column) -> Column:
    """F31."""
    strict = F.when(severity.isin("CRITICAL", "HIGH"), "deny").when(severity == "MEDIUM", "ask").otherwise("warn")
    return F.when(level == "strict", strict).when(level == "warn", "warn").otherwise("log")


def is_final(severity: Column, decision: Column) -> Column:
    """F32: a denial that nobody may lift."""
    return F.coalesce((decision == "deny") & (severity == "CRITICAL"), F.lit(False))


def audit_action(decision: Column, suppressed: Column) -> Column:
    """F33."""
    named = F.when(decision == "deny", "denied").when(decision == "ask", "asked").when(decision == "warn", "warned").otherwise("logged")
    return F.when(suppressed, "logged").otherwise(named)


def confidence(score: Column, classes: Column) -> Column:
    """F35."""
    return F.when((score >= 4) | (classes >= 2), "high").when(score >= 2, "medium").otherwise("low")


def mask(col: Column) -> Column:
    """at most eight characters become stars; longer values keep the first four and the last two."""
    flat = F.regexp_replace(col, r"\s", " ")
    return F.when(F.length(flat) <= 8, F.repeat(F.lit("*"), F.length(flat))).otherwise(F.concat(F.left(flat, F.lit(4)), F.lit("…"), F.right(flat, F.lit(2))))


def strip_zero_width(col: Column) -> Column:
    """F08."""
    return F.translate(col, ZERO_WIDTH, "")


def normalize_text(col: Column) -> Column:
    """F09."""
    return F.translate(strip_zero_width(col), CYRILLIC, LATIN)


def homoglyph_word(col: Column) -> Column:
    """the first word of four or more letters that mixes Cyrillic and Latin."""
    words = F.regexp_extract_all(col, F.lit(r"(\p{L}{4,})"), 1)
    return F.get(F.filter(words, lambda w: w.rlike("[а-яёА-ЯЁ]") & w.rlike("[A-Za-z]")), F.lit(0))


def line_number(text: Column, position: Column) -> Column:
    """the line, from 1, of a 0-based position."""
    return F.regexp_count(F.left(text, position), F.lit("\n")) + 1


def shannon_entropy(col: Column) -> Column:
    """F16: bits per character; 0 for empty text. Sorted characters are walked once, a run at a time."""
    n = F.length(col)
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("bits"))
    share = lambda run: F.when(run > 0, -(run / n) * F.log2(run / n)).otherwise(0.0)

    def step(a: Column, c: Column) -> Column:
        same = c == a["last"]
        return F.struct(c.alias("last"), F.when(same, a["run"] + 1).otherwise(1).alias("run"), F.when(same, a["bits"]).otherwise(a["bits"] + share(a["run"])).alias("bits"))

    total = F.aggregate(F.array_sort(F.split(col, "")), start, step, lambda a: a["bits"] + share(a["run"]))
    return F.when(n > 0, total + F.lit(0.0)).otherwise(0.0)


def entropy_hit(col: Column, min_length: int = 20, min_entropy: float = 4.0, charset: str | None = None) -> Column:
    """F17."""
    hit = (F.length(col) >= min_length) & (shannon_entropy(col) >= min_entropy)
    return hit & col.rlike(f"^(?:{charset})$") if charset else hit


def session_key(col: Column) -> Column:
    """letters, digits, - and _ only, 64 characters, never empty."""
    safe = F.left(F.regexp_replace(F.coalesce(col, F.lit("")), "[^A-Za-z0-9_-]", ""), F.lit(64))
    return F.when(safe == "", "unknown").otherwise(safe)


def memory_key(rule: Column, target: Column, agent: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(c, F.lit("-")) for c in (rule, target, agent)))


def normalize_remote(col: Column) -> Column:
    """host/path of a remote address, whatever its form."""
    given = F.trim(col)
    scheme = r"^(?:ssh|git\+ssh|https|http|git)://"
    scp = F.regexp_replace(F.regexp_replace(given, r"^[^@]*@", ""), r"^([^:]*):", "$1/")
    bare = F.when(given.rlike(scheme), F.regexp_replace(given, scheme, "")).when(given.rlike("@") & given.rlike(":"), scp).otherwise(given)
    bare = F.regexp_replace(bare, r"^[^/@]*@", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, r"\.git$", ""), r"/+$", ""), F.lit(""))


def content_hash(col: Column) -> Column:
    """F28."""
    return F.concat(F.lit("sha256:"), F.sha2(col.cast("binary"), 256))


def repo_id(remote: Column, root: Column) -> Column:
    """F27."""
    return F.left(F.sha2(F.coalesce(normalize_remote(remote), root).cast("binary"), 256), F.lit(16))


def iso_ts(col: Column) -> Column:
    """with the offset of the session's time zone."""
    return F.date_format(col.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSxxx")


def day_key(col: Column) -> Column:
    return F.to_date(col)


def within_ttl(then: Column, now: Column, hours: float | None = 24) -> Column:
    """is less than hours past between the two times? A bad number counts as a day."""
    span = hours if isinstance(hours, (int, float)) and hours > 0 else 24
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return micros(now) - micros(then) < int(span * 3_600_000_000)


def format_reason(message: Column, remediation: Column, reference: Column) -> Column:
    """F19."""
    return F.concat_ws("\n\n", message, F.concat(F.lit("What to do: "), remediation), F.concat(F.lit("See: "), reference))


def event_target(file_path: Column, url: Column, command: Column, tool: Column) -> Column:
    """F37."""
    return F.coalesce(F.left(F.coalesce(file_path, url, command), F.lit(200)), tool)


def register(spark: SparkSession) -> None:
    """The functions most used from SQL, as temporary SQL functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION audit_decision(severity STRING, level STRING) RETURNS STRING RETURN CASE WHEN level = 'strict' THEN CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'deny' WHEN severity = 'MEDIUM' THEN 'ask' ELSE 'warn' END WHEN level = 'warn' THEN 'warn' ELSE 'log' END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION audit_mask(v STRING) RETURNS STRING RETURN CASE WHEN length(v) <= 8 THEN repeat('*', length(v)) ELSE concat(left(regexp_replace(v, r'\\s', ' '), 4), '…', right(regexp_replace(v, r'\\s', ' '), 2)) END")
    scheme, bare = "^(?:ssh|git\\\\+ssh|https|http|git)://", "regexp_replace(regexp_replace(trim(v), '^[^@]*@', ''), '^([^:]*):', '$1/')"
    form = f"CASE WHEN trim(v) RLIKE '{scheme}' THEN regexp_replace(trim(v), '{scheme}', '') WHEN trim(v) RLIKE '@' AND trim(v) RLIKE ':' THEN {bare} ELSE trim(v) END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION audit_remote(v STRING) RETURNS STRING RETURN nullif(regexp_replace(regexp_replace(regexp_replace({form}, '^[^/@]*@', ''), '\\\\.git$', ''), '/+$', ''), '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION audit_entropy(v STRING) RETURNS DOUBLE RETURN aggregate(array_distinct(split(v, '')), 0D, (a, c) -> a - (length(v) - length(replace(v, c, ''))) / length(v) * log2((length(v) - length(replace(v, c, ''))) / length(v)))")
