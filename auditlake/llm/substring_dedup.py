"""Removal of repeated word windows (operator 4).

Rabin-Karp hashes of every window of `size` words are counted over the corpus
(chunks.py); a word goes if a window that covers it also starts in a document
with a smaller id. Windows are judged on the input, so overlapping repeated
windows merge into maximal removal intervals.

Defined results: null text has no words; texts shorter than a window lose
nothing; a text of any length lies in one chunk, which is as large as that; repeated
rows with one id don't remove each other's words, as neither id is smaller; null ids
count as one that is the smallest; an empty table gives an empty result; further
columns are ignored. Two windows are taken as equal if 96 bits of two hashes are; even
among 10^13 windows no false match is likely (6 in 10,000).
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import chunks
from auditlake.llm.common import documents, mix, rolling, slices, windows, words

SIZE = 13
_SECOND = np.uint64(0xA24BAED4963EE407)
_RESULT = "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start: bigint, stop: bigint>>, kept_text string"


def _windows(table: pa.Table, size: int):
    """For parts of the chunk's documents: rows, words' documents, window hashes, four bytes of a second hash, first words."""
    for part in slices(table, "text", 1 << 20):
        h, doc, _, _ = words(part.column("text"))
        first_hash, first = windows(h, doc, size)
        second = rolling(mix(h ^ _SECOND), first, first + size) if len(first) else first_hash
        yield part, doc, first_hash, (second >> np.uint64(32)).astype(np.uint32), first


def _distinct(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    found = [(h, x) for _, _, h, x, _ in _windows(table, size)]
    h, x = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order, begins, _ = chunks.group(h, x)
    return h[order[begins]], x[order[begins]]


def _remove(table: pa.Table, bits: pa.Table, size: int, buckets: int) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_text", pa.string())])
    if not table.num_rows:
        return schema.empty_table()
    parts = list(_windows(table, size))
    ids = np.concatenate([part.column("doc_id").to_numpy()[doc[first]] for part, doc, _, _, first in parts])
    hashes = np.concatenate([p[2] for p in parts])
    order, begins, place = chunks.group(hashes, np.concatenate([p[3] for p in parts]))
    repeated = chunks.told(hashes[order[begins]], bits, buckets)[place]
    if len(ids):
        # An id of this chunk that is smaller than the window's own.
        repeated |= np.minimum.reduceat(ids[order], begins)[place] < ids
    out, done = [], 0
    for part, doc, _, _, first in parts:
        again = first[repeated[done : done + len(first)]]
        done += len(first)
        cover = np.zeros(len(doc) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + size, -1)
        gone = np.cumsum(cover[:-1]) > 0
        at = np.searchsorted(doc, np.arange(part.num_rows + 1))
        for i, (doc_id, known, text) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "known", "text")), strict=True)):
            own, raw = gone[at[i] : at[i + 1]], text.encode().split()
            n = int(own.sum())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).tolist() if n else []
            kept = b" ".join(compress(raw, (~own).tolist()) if n else raw)
            out.append((doc_id if known else None, len(own), n, [{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2], strict=True)], kept.decode()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, removed (maximal intervals of word numbers), kept_text."""
    cut = chunks.cut(docs)
    buckets = chunks.buckets_for(cut.size // 6)
    bits = chunks.answers(cut, lambda t: _distinct(t, size), buckets)
    return cut.rows.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(lambda t, b: _remove(t, b, size, buckets), _RESULT)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
