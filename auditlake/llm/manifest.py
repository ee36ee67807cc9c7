"""Merkle manifest of a dataset with a proof for every row (operator 12).

Every row is a leaf. Per source, leaves in order of their ids are the bottom of a tree
of 16 branches; the sources' roots, in order of their names, are the bottom of the
tree that ends in the dataset's root.

Leaves are ranked by ranges, so no source is sorted in one task, and cut into aligned
blocks of 16 x 16. A block is appended leaf by leaf: every node that is still open
keeps a partial witness for each leaf below it, and when a sibling is complete, the
witnesses below its run get its digest. Block roots are appended in turn, in blocks,
until each source has one root. Then the witnesses of the roots go back down, each
extending those of its block.

Defined results: a null field is `-`, so null and empty text differ; null ids come
first, equal ids follow by the leaf's digest, and repeated rows are leaves of their
own with proofs of their own; a null source comes before all others; texts may have
any length; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import UPPER, documents, fold, lower_ascii, ship, written

#: Children of a node, and levels of a block.
FAN = 16
LEVELS = 2
BLOCK = FAN**LEVELS

_GROUP = ["known", "source"]
_ROOTS = "known boolean, source string, block bigint, root binary"
_PATHS = "known boolean, source string, pos bigint, node binary, path array<struct<at: int, others: array<binary>>>"
_PROVED = "doc_id bigint, leaf binary, subroot binary, root binary, proof_sha256 binary, folded_root binary"
_PATH_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.binary()))]))


def _h(parts: list[bytes]) -> bytes:
    """H of digests, which are joined as hexadecimal text."""
    return hashlib.sha256("".join([x.hex() for x in parts]).encode()).digest()


class Appender:
    """A tree that grows leaf by leaf at its right edge.

    At each level the run that isn't full yet is open, and so is each witness of a leaf below it: it has the levels below
    that run and waits for siblings. A run that is full or, at the end, last becomes a node of the level above. Levels above
    `levels` aren't built; fewer are if `count`, the number of leaves of the whole tree, needs no more.
    """

    def __init__(self, count: int, levels: int = LEVELS):
        self.height = 0
        while self.height < levels and count > FAN**self.height:
            self.height += 1
        self.runs: list[list[bytes]] = [[] for _ in range(self.height)]
        #: For each child of an open run, the leaves below it.
        self.below: list[list[list[int]]] = [[] for _ in range(self.height)]
        self.witnesses: list[list[tuple[int, list[bytes]]]] = []
        self.roots: list[bytes] = []

    def append(self, leaf: bytes) -> None:
        self.witnesses.append([])
        self._put(0, leaf, [len(self.witnesses) - 1])

    def _put(self, level: int, node: bytes, leaves: list[int]) -> None:
        if level == self.height:
            self.roots.append(node)
            return
        self.runs[level].append(node)
        self.below[level].append(leaves)
        if len(self.runs[level]) == FAN:
            self._close(level)

    def _close(self, level: int) -> None:
        run, below = self.runs[level], self.below[level]
        self.runs[level], self.below[level] = [], []
        for at, leaves in enumerate(below):
            others = run[:at] + run[at + 1 :]
            for leaf in leaves:
                self.witnesses[leaf].append((at, others))
        self._put(level + 1, _h(run), [x for leaves in below for x in leaves])

    def close(self) -> bytes:
        """No more leaves: open runs end as they are, from below."""
        for level in range(self.height):
            if self.runs[level]:
                self._close(level)
        return self.roots[0]


def _grown(table: pa.Table) -> Appender:
    tree = Appender(table.column("count")[0].as_py())
    for leaf in table.column("node").to_pylist():
        tree.append(leaf)
    return tree


def _root_of(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    tree = _grown(table)
    return pa.table([table.column(c)[:1] for c in (*_GROUP, "block")] + [pa.array([tree.close()], pa.binary())], names=[*_GROUP, "block", "root"])


def _witnesses(table: pa.Table) -> list[list[dict]]:
    tree = _grown(table)
    tree.close()
    return [[{"at": at, "others": others} for at, others in w] for w in tree.witnesses]


def _extend(table: pa.Table, above: pa.Table) -> pa.Table:
    """The block's witnesses, each followed by that of the block's root."""
    table = table.sort_by("pos")
    rest = above.column("path")[0].as_py()
    paths = [w + rest for w in _witnesses(table)]
    return pa.table([table.column(c) for c in (*_GROUP, "pos", "node")] + [pa.array(paths, _PATH_TYPE)], names=[*_GROUP, "pos", "node", "path"])


def _prove(table: pa.Table, above: pa.Table) -> pa.Table:
    """For each leaf of a block the digest of its proof, and the root folded from the leaf, changed or not, over its path."""
    table = table.sort_by("pos")
    rest = above.column("path")[0].as_py()
    proofs, folded = [], []
    for node, changed, path in zip(table.column("node").to_pylist(), table.column("changed").to_pylist(), _witnesses(table), strict=True):
        digest = changed or node
        for step in path + rest:
            digest = _h([*step["others"][: step["at"]], digest, *step["others"][step["at"] :]])
        proofs.append(_h([x for step in path + rest for x in step["others"]]))
        folded.append(digest)
    same = [above.column(c).take(pa.array([0] * len(proofs))) for c in ("subroot", "root")]
    return pa.table([table.column("doc_id"), table.column("node"), *same, pa.array(proofs, pa.binary()), pa.array(folded, pa.binary())], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def _ranked(nodes: DataFrame, by: list[str]) -> DataFrame:
    """pos, the place of each row within its (known, source) in order of `by`, and count, the rows there.

    Rows are dealt by ranges that reach over sources, numbered in their range, and moved up by what earlier ranges hold.
    """
    order = [*_GROUP, *by]
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id())
    dealt = written(dealt.repartitionByRange(*order, "tie").withColumn("range", F.spark_partition_id()), "manifest-ranges")
    own = Window.partitionBy("range", *_GROUP).orderBy(*by, "tie")
    dealt = dealt.withColumn("n", F.row_number().over(own).cast("long") - 1)
    held = dealt.groupBy("range", *_GROUP).agg(F.count(F.lit(1)).alias("held"))
    every = Window.partitionBy(*_GROUP)
    before = F.sum("held").over(every.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("range", *_GROUP, F.coalesce(before, F.lit(0)).alias("before"), F.sum("held").over(every).alias("count"))
    return dealt.join(held, ["range", *_GROUP]).withColumn("pos", F.col("n") + F.col("before")).drop("range", "tie", "n", "before", "held")


def _tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (known, source, pos, node, count): the root of each source, the rows with their block, and each block's path to its root."""
    levels = []
    most = nodes.agg(F.max("count")).first()[0] or 0
    at = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    while True:
        levels.append(at)
        roots = at.select(*_GROUP, "block", "pos", "node", "count").groupBy(*_GROUP, "block").applyInArrow(_root_of, _ROOTS)
        # A source's nodes become one for each block.
        counts = at.where("pos = 0").select(*_GROUP, F.ceil(F.col("count") / BLOCK).alias("count"))
        at = written(roots.join(counts, _GROUP).select(*_GROUP, F.col("block").alias("pos"), F.col("root").alias("node"), "count", F.floor(F.col("block") / BLOCK).alias("block")), "manifest-roots")
        if most <= BLOCK:
            break
        most = -(-most // BLOCK)
    above = at.select(*_GROUP, F.col("pos").alias("block"), F.expr("CAST(array() AS array<struct<at: int, others: array<binary>>>)").alias("path"))
    for level in reversed(levels[1:]):
        above = written(_down(level, above).select(*_GROUP, F.col("pos").alias("block"), "path"), "manifest-paths")
    return at, levels[0], above


def _down(level: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes of a level with their whole paths, from those of their blocks."""
    return level.select(*_GROUP, "block", "pos", "node", "count").groupBy(*_GROUP, "block").cogroup(above.groupBy(*_GROUP, "block")).applyInArrow(_extend, _PATHS)


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)).cast("binary"), 256)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    tampered: says in which rows A-Z of the text are lower-cased before the root is folded; verified tells them from the others.
    """
    ship(docs.sparkSession)
    changed = F.when(F.coalesce(tampered, F.lit(False)) & F.col("text").rlike(f"[{UPPER}]"), F.unhex(_leaf(lower_ascii(F.col("text"))))) if tampered is not None else F.lit(None).cast("binary")
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("source"), F.unhex(_leaf(F.col("text"))).alias("node"), changed.alias("changed"))
    leaves = written(_ranked(written(leaves, "manifest-leaves"), ["doc_id", "node"]), "manifest-ranked")
    subroots, leaves, above = _tree(leaves)
    # The sources' roots, in order of their names, are one tree's leaves.
    named = subroots.select(F.lit(True).alias("known"), F.lit("").alias("source"), F.struct("known", "source").alias("name"), "node")
    named = written(_ranked(named, ["name"]), "manifest-sources")
    root, named, tops = _tree(named)
    top = root.first()
    # Of each source its root, and that root's path; the dataset's root is one digest.
    tops = _down(named, tops).select("pos", F.col("path").alias("top")).join(named, "pos").select("name.*", F.col("node").alias("subroot"), "top", F.lit(bytes(top["node"]) if top else None).cast("binary").alias("root"))
    above = above.join(tops, _GROUP).select(*_GROUP, "block", "subroot", "root", F.concat("path", "top").alias("path"))
    proved = leaves.groupBy(*_GROUP, "block").cogroup(above.groupBy(*_GROUP, "block")).applyInArrow(_prove, _PROVED)
    digests = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    return proved.select("doc_id", *digests, (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir), fold("doc_id", 5) == 0)


def _sql() -> str:
    """Levels are spelled out: six a tree, enough for 16 million rows a source."""
    start = {"d": "SELECT s, n, pos, h FROM leaves", "t": "SELECT 0 AS s, count(*) OVER () AS n, row_number() OVER (ORDER BY s) - 1 AS pos, h FROM d6"}
    parts = []
    for tree, first in start.items():
        parts.append(f"{tree}0 AS ({first})")
        for k in range(6):
            parts.append(f"{tree}{k + 1} AS (SELECT s, (n + 15) // 16 AS n, pos // 16 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {tree}{k} WHERE n > 1 GROUP BY s, n, pos // 16 UNION ALL SELECT s, n, pos, h FROM {tree}{k} WHERE n = 1)")
            parts.append(f"{tree}run{k} AS (SELECT s, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM {tree}{k} WHERE n > 1 GROUP BY s, pos // 16)")
    parts.append("f0 AS (SELECT row, s, pos, s AS name, coalesce(changed, h) AS f, '' AS proof FROM leaves)")
    last = "f0"
    for tree in start:
        for k in range(6):
            step = f"f{tree}{k}"
            at = f"{last}.pos % 16"
            parts.append(f"{step} AS (SELECT row, {last}.s, pos // 16 AS pos, name, CASE WHEN hs IS NULL THEN f ELSE sha256(array_to_string(hs[1 : {at}] || [f] || hs[{at} + 2 :], '')) END AS f, proof || CASE WHEN hs IS NULL THEN '' ELSE array_to_string(hs[1 : {at}] || hs[{at} + 2 :], '') END AS proof FROM {last} LEFT JOIN {tree}run{k} r ON r.s = {last}.s AND r.run = {last}.pos // 16)")
            last = step
        if tree == "d":
            parts.append(f"ft AS (SELECT row, 0 AS s, t0.pos, name, f, proof FROM {last} JOIN (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS place FROM t0) t0 ON t0.place = name)")
            last = "ft"
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    low = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    return f"""
WITH bytes AS (
  SELECT list(list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i)
), hashed AS (
  SELECT doc_id, source, {leaf("text")} AS h,
    CASE WHEN xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)]))) % 5 = 0 AND text IS NOT NULL THEN {leaf(low)} END AS changed
  FROM documents, bytes
), leaves AS (
  SELECT row_number() OVER () AS row, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, h, changed FROM hashed
), {", ".join(parts)}
SELECT doc_id, leaves.h AS leaf, d6.h AS subroot, t6.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t6.h AS verified
FROM leaves JOIN {last} ON {last}.row = leaves.row JOIN d6 ON d6.s = leaves.s, t6
"""


ORACLE_OP12 = _sql()
