"""An index over rules' patterns, so that thousands of rules meet the rows by an equi join and only candidates are tested.

A pattern gives one key that whatever fits it must have: a whole name (`=name`), how a name begins (`^pre`) or ends (`$post`),
or `*` if it says nothing of that kind. A row has the keys of its names; beginnings and ends are cut at the lengths that
the rules have.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of rules that are broadcast: some MB.
FEW = 20_000

_WILD = re.compile(r"\*+|\?|\[[^\]]*\]")


def name_key(pattern: str) -> str:
    """The key of a pattern on one name, or on one part of a path."""
    parts = _WILD.split(pattern)
    if len(parts) == 1:
        return f"={pattern}"
    if parts[0]:
        return f"^{parts[0]}"
    return f"${parts[-1]}" if parts[-1] else "*"


def glob_key(pattern: str) -> str:
    """The key of a glob on a path: its longest whole part, else the longest beginning or end of one."""
    # A class may hold a slash, and then cuts no part.
    keys = [name_key(p) for p in pattern.split("/") if p] if "[" not in pattern else ["*"]
    return max(keys, key=lambda k: (k[0] == "=", len(k)), default="*")


def _row_keys(names: Column, sizes: Iterable[tuple[str, int]]) -> Column:
    """All keys that a row's names have, at the lengths of the rules' beginnings and ends."""
    cut = {"^": F.left, "$": F.right}

    def cutter(mark: str, size: int):
        return lambda x: F.concat(F.lit(mark), cut[mark](x, F.lit(size)))

    found = [F.transform(names, cutter(mark, size)) for mark, size in sizes]
    return F.array_distinct(F.concat(F.transform(names, lambda x: F.concat(F.lit("="), x)), *found, F.array(F.lit("*"))))


def candidates(rows: DataFrame, names: Column, rules: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Every row with every rule (`index`: the keys of its patterns) that shares a key, once. names: the row's names; on: columns that must be equal as well.

    The join is an equi join. Up to `FEW` keys of rules are broadcast, and a row then keeps only keys that a rule has; of more
    rules both sides are shuffled. Rows are never broadcast, whatever sizes Spark estimates.
    """
    keys = rules.select(F.explode("index").alias("k"))
    known = [r["k"] for r in keys.distinct().limit(FEW + 1).collect()]
    few = len(known) <= FEW and keys.count() <= FEW
    ends = keys.where(F.left("k", F.lit(1)).isin("^", "$")).select(F.left("k", F.lit(1)).alias("m"), (F.length("k") - 1).alias("n"))
    # As many pairs as names have lengths.
    sizes = {(k[0], len(k) - 1) for k in known if k[0] in "^$"} if few else {(r["m"], r["n"]) for r in ends.distinct().collect()}
    of_row = _row_keys(names, sorted(sizes))
    left = rows.withColumn("_keys", F.filter(of_row, lambda k: k.isin(known)) if few else of_row)
    # An outer explode, as Spark would compute the keys a second time to filter empty lists; the join drops the nulls.
    left = left.withColumn("_key", F.explode_outer("_keys"))
    right = rules.withColumn("_key", F.explode("index"))
    both = left.join(F.broadcast(right) if few else right.hint("merge"), ["_key", *(on or [])])
    # Of several shared keys the rule's first one counts.
    return both.where(F.col("_key") == F.get(F.filter("index", lambda k: F.array_contains(F.col("_keys"), k)), F.lit(0))).drop("_key", "_keys", "index")
