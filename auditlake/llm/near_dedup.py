"""Near-duplicates by an inverted join of MinHash coordinates (operator 5).

A document's set holds its distinct 4-word shingles (fewer words: the whole
sequence). Documents with one set are one node. A node is posted under each of
its `HASHES` signature coordinates with its value. A pair is a candidate if at
least `MATCHES` coordinates agree. Such a pair must meet in the prefix of
HASHES - MATCHES + 1 coordinates that are rarest over the corpus, so only those
are joined and the long lists of frequent values are skipped; the signatures of
pairs that meet are then compared in full. Every candidate that could join two
groups is confirmed on the full sets.

Lists aren't expanded into all pairs. In `ROUNDS` rounds each member of a list
meets two pivots of it; the best candidate of each node is confirmed and the
confirmed links give groups. Only members of one list but different groups can
still be joined: they are compared by longer signatures, block by block, and
what agrees is confirmed.

A pair at the threshold is missed with a probability of about 3e-6 (fewer than
36 of 64 coordinates agreeing at a similarity of 0.8), and less above it.

Defined results: null text and text without words give an empty set, linked with
nothing; a text of any length is one set, held whole where two are compared; a null id is
kept as one and counts as the smallest; rows with one id may lie in several components;
repeated rows get one component; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import distinct, documents, resident, rolling, slices, unused, windows, words, written
from auditlake.llm.components import components

SHINGLE = 4
PERCENT = 80
HASHES = 64
MATCHES = 36
#: Coordinates of one byte compared of nodes of different groups, and how many must agree: at a similarity of 0.8
#: fewer do with a probability of about 5e-7.
LONG = 1024
LONG_MATCHES = 756
BLOCK = 2048
#: Rounds of confirming each node's best pivot of another group.
ROUNDS = 2

_ROWS = "doc_id bigint, n_shingles bigint, node bigint, signature array<bigint>"
_RANDOM = np.random.default_rng(811).integers(0, 2**32, (2, 1024), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    h, doc, _, _ = words(column, lower=True)
    at = np.searchsorted(doc, np.arange(len(column) + 1))
    grams, first = windows(h, doc, size)
    where = np.searchsorted(doc[first], np.arange(len(column) + 1))
    many = np.diff(at)
    short = np.flatnonzero((many > 0) & (many < size))
    whole = dict(zip(short.tolist(), rolling(h, at[short], at[short + 1]), strict=True)) if len(short) else {}
    return [distinct(grams[where[i] : where[i + 1]]) if many[i] >= size else np.array([whole[i]] if i in whole else [], np.uint64) for i in range(len(many))]


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """The least value of each hash function over every set that isn't empty, one row per set."""
    out = np.zeros((len(sets), hashes), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    a, b = _RANDOM[0, :hashes, None], _RANDOM[1, :hashes, None]
    block, held = [], 0
    for n, i in enumerate(full):
        block.append(i)
        held += len(sets[i])
        if held * hashes > 2_000_000 or n == len(full) - 1:
            x = np.concatenate([sets[j] for j in block])
            low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
            starts = np.cumsum([0, *(len(sets[j]) for j in block[:-1])])
            out[block] = np.minimum.reduceat(low[None] * a + high[None] * b, starts, axis=1).T
            block, held = [], 0
    return out


def _signed(size: int, hashes: int):
    coordinate = np.arange(hashes, dtype=np.int64) << 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sets = shingle_sets(part.column("text"), size)
                keys = signatures(sets, hashes).astype(np.int64) | coordinate
                nodes = [int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in sets]
                lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * hashes, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.int64()), lists], ["doc_id", "n_shingles", "node", "signature"])

    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(_similar(percent), "a bigint, b bigint")


def _matches(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Pairs with at least so many agreeing coordinates, and how many agree."""
    x, y = nodes.select(F.col("node").alias("a"), F.col("signature").alias("x")), nodes.select(F.col("node").alias("b"), F.col("signature").alias("y"))
    agree = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", agree.alias("agree")).where(F.col("agree") >= least)


def _across(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of lists(key, node, label) that share a list, have different labels and agree in `LONG_MATCHES` of LONG coordinates.

    Lists are cut into blocks of `BLOCK` nodes and pairs of blocks are tasks of
    their own. Pairs are compared there and only those that agree leave it, each
    from the least of its common lists.
    """
    keys = lists.groupBy("node", "label").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    rows = lists.join(lists.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node")
    full = rows.join(keys.join(sets.select("node", "long"), "node"), "node")
    return full.groupBy("key", "bi", "bj").applyInArrow(_agreeing, "a bigint, b bigint").distinct()


def _agreeing(table: pa.Table) -> pa.Table:
    key, bi, bj = (table.column(c)[0].as_py() for c in ("key", "bi", "bj"))
    node, label, block = (table.column(c).to_numpy() for c in ("node", "label", "block"))
    long = np.frombuffer(b"".join(table.column("long").to_pylist()), np.uint8).reshape(len(node), LONG)
    values, number, many = np.unique(label, return_inverse=True, return_counts=True)
    out = []
    if len(values) > 1:
        keys = [set(k) for k in table.column("keys").to_pylist()]
        most = number == many.argmax()
        for i in np.flatnonzero(~most):
            other = np.flatnonzero((label != label[i]) & (most | (np.arange(len(node)) > i)) & ((bi == bj) | (block != block[i])))
            other = other[(long[other, :HASHES] == long[i, :HASHES]).sum(axis=1) >= MATCHES]
            other = other[(long[other] == long[i]).sum(axis=1) >= LONG_MATCHES]
            out += [(node[i], node[j]) for j in other.tolist() if min(keys[i] & keys[j]) == key]
    return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, hashes: int = HASHES, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(source.mapInArrow(_signed(size, hashes), _ROWS), "signatures")
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("signature").alias("signature"), F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("lost"))

    posts = nodes.select("node", F.explode("signature").alias("key"))
    shared = posts.groupBy("key").count().where("count > 1")
    # Values that no other node has are the rarest; they fill the prefix first and join nothing.
    ranked = posts.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("count", "key"))).alias("keys"), F.sum("count").alias("fame"))
    prefix = F.slice("keys", 1, F.size("keys") - (matches - 1))
    lists = written(ranked.where(F.size("keys") >= matches).select("node", "fame", F.explode(prefix).alias("_k")).select("node", "fame", F.col("_k.key").alias("key")), "prefixes")
    active = written(nodes.join(lists.select("node").distinct(), "node").select("node", "signature"), "active")

    texts = rows.select("doc_id", "node").join(active.select("node"), "node").groupBy("node").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"))
    # One text of each node; an id may have several texts, so the node is found again from the text.
    sets = source.join(texts.select(F.col("doc_id").alias("wanted")).distinct(), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").mapInArrow(_signed_sets(size), "node bigint, shingles binary, long binary")
    sets = written(sets.join(active.select("node"), "node", "left_semi"), "sets").dropDuplicates(["node"])

    # In each round every list has two pivots: any one, and the member whose values are the most frequent, which copies resemble most.
    labels, links, tried = None, None, None
    grouped = lists.select("key", "node", "fame", F.col("node").alias("label"))
    for turn in range(ROUNDS):
        any_one, famous = F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("h"), "node", "label")), F.max(F.struct("fame", "node", "label"))
        pivots = grouped.groupBy("key").agg(any_one.alias("x"), famous.alias("y")).select("key", F.explode(F.array(F.struct("x.node", "x.label"), F.struct("y.node", "y.label"))).alias("p")).select("key", F.col("p.node").alias("b"), F.col("p.label").alias("label_b"))
        met = grouped.join(pivots, "key").where("label <> label_b").select(F.col("node").alias("a"), "b").distinct()
        if tried is not None:
            met = met.join(tried, ["a", "b"], "left_anti")
        best = _matches(met, active, matches).groupBy("a").agg(F.max_by("b", F.struct("agree", F.xxhash64("b", F.lit(turn)))).alias("b"))
        best = tried = written(best, "tried")
        found = written(_confirmed(best, sets, percent), "near-links")
        links = found if links is None else links.union(found)
        labels = components(links)
        grouped = lists.join(labels, "node", "left").select("key", "node", "fame", F.coalesce("label", "node").alias("label"))
        mixed = grouped.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        grouped = written(grouped.join(mixed, "key", "left_semi"), "grouped")
    more = written(_confirmed(_across(grouped, sets), sets, percent), "near-links")
    labels = components(links.union(more))

    named = nodes.select("node", "doc_id", "lost").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "doc_id", "lost")
    first = named.groupBy("label").agg(F.min("doc_id").alias("m"), F.max("lost").alias("lost"))
    first = first.select("label", F.when(~F.col("lost"), F.col("m")).alias("component_id"), F.lit(True).alias("has"))
    of_node = named.select("node", "label").join(first, "label").select("node", "component_id", "has")
    out = rows.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("has"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _signed_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sets = [s for s in shingle_sets(part.column("text"), size) if len(s)]
                nodes = [int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
                long = [row.tobytes() for row in (signatures(sets, LONG) >> np.uint32(13)).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(long, pa.binary())], ["node", "shingles", "long"])

    return run


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose id is their component's smallest; all columns stay as they are. An id with several texts stays if one of them does."""
    gone = unused("gone", docs)
    ids = near_duplicates(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias(gone))
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(gone)), "left_anti")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
