"""Rules on paths: files that tools name, and files that commands read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions import rules
from auditlake.functions.paths import expand_path, glob_fits, glob_match, glob_to_regex
from auditlake.operators.index import candidates, glob_key
from auditlake.operators.policy import first_match

_TABLE = "rule_pos int, rule string, severity string, glob string, fine array<string>, tools array<string>, readers array<string>, index array<string>"


def path_rules(spark: SparkSession, given: Sequence[tuple] = rules.PATHS) -> DataFrame:
    """Path rules, a row for each glob of a rule, with compiled globs and their index."""
    rows = [(i, id_, severity, glob_to_regex(g), [*map(glob_to_regex, fine)], tools, readers, [glob_key(g)]) for i, (id_, severity, globs, fine, tools, readers) in enumerate(given) for g in globs]
    return spark.createDataFrame(rows, T.StructType.fromDDL(_TABLE))


def _fits(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (v: a path) with the rules whose globs fit it and whose exceptions don't, once for each glob that fits."""
    found = candidates(rows, F.filter(F.split("v", "/"), lambda x: x != ""), table)
    return found.where(glob_fits(F.col("glob"), F.col("v")) & ~glob_match(F.col("fine"), F.col("v")))


def _both(path: Column, cwd: Column, home: Column) -> Column:
    # Outer, as Spark would expand the path a second time to filter empty lists; a null path fits nothing.
    return F.explode_outer(F.array_distinct(F.array_compact(F.array(path, expand_path(path, cwd, home)))))


def match_paths(rows: DataFrame, cwd: Column, home: Column, given: Sequence[tuple] = rules.PATHS) -> DataFrame:
    """(id, rule, severity) of the first rule that fits a path, as written or expanded. rows: id, tool, path."""
    both = rows.select("id", "tool", _both(F.col("path"), cwd, home).alias("v"))
    found = _fits(both, path_rules(rows.sparkSession, given)).where(F.array_contains("tools", F.col("tool")))
    return first_match(found, ["rule_pos", "v"], ["id"]).select("id", "rule", "severity")


def match_reads(cmds: DataFrame, cwd: Column, home: Column, given: Sequence[tuple] = rules.PATHS) -> DataFrame:
    """(id, rule, severity) of the first rule that a line breaks by reading a file. cmds: id, argv0, operands.

    Each rule has readers of its own; commands meet it by their name first, then by their operands.
    """
    spark = cmds.sparkSession
    table = path_rules(spark, [r for r in given if "Bash" in r[4]])
    readers = table.select(F.explode("readers").alias("argv0")).distinct()
    ops = cmds.join(readers, "argv0", "left_semi").select("id", "argv0", F.explode("operands").alias("o"))
    both = ops.select("id", "argv0", _both(F.col("o"), cwd, home).alias("v"))
    found = _fits(both, table).where(F.array_contains("readers", F.col("argv0")))
    return first_match(found, ["rule_pos", "v"], ["id"]).select("id", "rule", "severity")
