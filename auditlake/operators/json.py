"""Nested JSON without a fixed schema, level by level over VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.sources.tables import stored

# Words that run something.
RUNNERS = ["sh", "bash", "zsh", "node", "python", "python3", "perl", "ruby", "curl", "wget", "nc", "npx", "eval", "exec"]


def document_key(col: Column) -> Column:
    """What stands for a document in the rows of its nodes, which would each carry its text otherwise."""
    return F.unhex(F.sha2(col.cast("binary"), 256))


def nodes(docs: DataFrame, col: str) -> DataFrame:
    """(doc, path, keys, named, kind, v) of every node at any depth. doc: the document_key; keys: the dotted key path; named: it stands under a key.

    A level is opened once: it is written, and the next one comes from its objects and arrays, until a level is empty. VARIANT
    sorts keys; path keeps that order. Equal documents are walked as often as they are given.
    """
    now = docs.select(document_key(F.col(col)).alias("doc"), F.lit("").alias("path"), F.lit("").alias("keys"), F.lit(False).alias("named"), F.try_parse_json(col).alias("v"))
    levels = []
    while True:
        now = stored(now.withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)), "json-level")
        if levels and now.isEmpty():
            break
        levels.append(now)
        inner = now.where(F.col("kind").isin("OBJECT", "ARRAY")).lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key"), F.col("value")))
        keys = F.when(F.col("key").isNull(), F.col("keys")).otherwise(F.concat_ws(".", F.nullif(F.col("keys"), F.lit("")), "key"))
        now = inner.where("pos IS NOT NULL").select("doc", F.concat("path", F.format_string("/%09d", F.col("pos"))).alias("path"), keys.alias("keys"), F.col("key").isNotNull().alias("named"), F.col("value").alias("v"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every


def _with_text(docs: DataFrame, col: str, found: DataFrame) -> DataFrame:
    return docs.select(col, document_key(F.col(col)).alias("_doc")).join(found.withColumnRenamed("doc", "_doc"), "_doc").drop("_doc")


def strings(docs: DataFrame, col: str) -> DataFrame:
    """All strings of a document (distinct ones are given), depth first, one a line."""
    leaves = nodes(docs, col).where("kind = 'STRING'").select("doc", "path", F.col("v").cast("string").alias("s"))
    joined = leaves.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("path", "s"))).alias("x"))
    return _with_text(docs, col, joined.select("doc", F.array_join(F.transform("x", lambda y: y["s"]), "\n").alias("text")))


def keys(docs: DataFrame, col: str) -> DataFrame:
    """dotted paths of all keys of a document (distinct ones are given); array elements add no part."""
    found = nodes(docs, col).where("keys <> ''").groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("keys")), ",").alias("keys"))
    return _with_text(docs, col, found)


def executables(items: Column) -> Column:
    """the first ten distinct items that run something."""
    word = r"(?:^|[\s/])(?:" + "|".join(RUNNERS) + r")(?:\s|$)"
    runs = lambda s: s.rlike(r"^https?://") | s.rlike(r"\||&&|\$\(|`") | s.rlike(word)
    return F.slice(F.array_distinct(F.transform(F.filter(items, runs), lambda s: F.left(s, F.lit(200)))), 1, 10)


def candidate_paths(tool: Column, given: Column) -> Column:
    """the paths that a file tool's input names."""
    get = lambda k: F.get_json_object(given, f"$.{k}")
    return F.array_compact(F.array(get("file_path"), get("path"), get("notebook_path"), F.when(tool == "Glob", get("pattern")), F.when(tool == "Grep", get("glob"))))


#: A string value (a string that no colon follows), a key with its colon, or what stands between them.
_JSON_TOKEN = r'("(?:[^"\\]|\\.)*+"(?:\s*:)?+|[^"]++)'


def redact_json(doc: Column, redact) -> Column:
    """every string value of a JSON text redacted, at any depth; keys, numbers and layout stay. What is no JSON is redacted as text."""
    plain = lambda t: F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), F.lit(0))
    again = lambda v: F.regexp_replace(F.to_json(F.array(v)), r"\A\[|\]\z", "")
    value = lambda t: t.startswith('"') & t.endswith('"')

    def clean(t: Column) -> Column:
        new = redact(plain(t))
        # A string without a secret keeps its spelling.
        return F.when(value(t) & (new != plain(t)), again(new)).otherwise(t)

    tokens = F.regexp_extract_all(doc, F.lit(_JSON_TOKEN), 1)
    return F.when(F.try_parse_json(doc).isNotNull(), F.array_join(F.transform(tokens, clean), "")).otherwise(redact(doc))
