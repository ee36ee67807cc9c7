"""Globs and paths. Patterns are compiled to regular expressions where rules are loaded; paths are folded by expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a root or home directory.
ROOTS = ["/", "/.", "/*", "/**", "~", "~/", "~/*", "$HOME", "${HOME}", "$HOME/", "$HOME/*", "${HOME}/*", "..", "../", "../*", "../.."]


def glob_to_regex(pattern: str) -> str:
    """`**/` any directories, `**` anything, `*` and `?` within a name, `[...]` a class."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?|\[[^\]]*\])", pattern)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return r"(?s)\A" + "".join(known.get(p) or (p if p[:1] == "[" and len(p) > 1 else re.escape(p)) for p in parts if p) + r"\z"


def fnmatch_to_regex(pattern: str) -> str:
    """`*` also crosses slashes."""
    parts = re.split(r"(\*|\?|\[[^\]]*\])", pattern)
    known = {"*": ".*", "?": "."}
    return r"(?s)\A" + "".join(known.get(p) or (p.replace("[!", "[^", 1) if p[:1] == "[" and len(p) > 1 else re.escape(p)) for p in parts if p) + r"\z"


def glob_fits(pattern: Column, value: Column) -> Column:
    """Does a compiled glob fit the value, as it is or without leading slashes?"""
    return F.rlike(value, pattern) | (value.startswith("/") & F.rlike(F.ltrim(value, F.lit("/")), pattern))


def glob_match(patterns: Column, value: Column) -> Column:
    """Does any compiled glob fit the value, as it is or without leading slashes?"""
    return F.exists(patterns, lambda p: glob_fits(p, value))


def basename(col: Column) -> Column:
    """a command's name without path and escapes."""
    bare = F.regexp_replace(F.trim(col), r"^\\+", "")
    name = F.element_at(F.split(F.regexp_replace(bare, "/+$", ""), "/"), -1)
    return F.when(bare == "", "unknown").when(name == "", bare).otherwise(name)


def expand_path(path: Column, cwd: Column, home: Column) -> Column:
    """absolute, with ~ and $HOME filled in and . and .. folded. Symbolic links can't be seen in a log."""
    filled = F.regexp_replace(F.regexp_replace(path, r"^~(?=/|\z)", home), r"\$(?:HOME\b|\{HOME\})", home)
    whole = F.when(filled.startswith("/"), filled).otherwise(F.concat(cwd, F.lit("/"), filled))
    keep = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))
    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), keep)
    return F.when(path == "", path).otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))


def outside_cwd(expanded: Column, cwd: Column) -> Column:
    """F22."""
    return F.coalesce(~((expanded == cwd) | expanded.startswith(F.concat(cwd, F.lit("/")))), F.lit(False))


def is_root_target(raw: Column, expanded: Column, cwd: Column, home: Column) -> Column:
    """a root, the home directory or a directory above the working one."""
    above = (cwd != expanded) & cwd.startswith(F.concat(F.regexp_replace(expanded, "/+$", ""), F.lit("/")))
    return F.coalesce(raw.isin(ROOTS) | (expanded == "/") | (expanded == home) | above, F.lit(False))


def is_excluded(path: Column, cwd: Column, patterns: Column) -> Column:
    """Globs on the path below the working directory; an absolute path outside it is never excluded."""
    below = F.when(path.startswith(F.concat(cwd, F.lit("/"))), F.substring(path, F.length(cwd) + 2, F.length(path))).when(~path.startswith("/"), path)
    return F.coalesce(glob_match(patterns, below), F.lit(False))
