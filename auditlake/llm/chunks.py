"""Finding what occurs in an earlier part of a corpus, exactly and with one exchange of hashes.

Documents are cut by id into consecutive ranges (chunks), so an earlier chunk
holds smaller ids. A chunk sorts the distinct hashes of its windows and sends
them, as differences, to hash buckets; a bucket answers every chunk with one bit
for each hash: did a chunk of smaller ids send it? A value shared by a third of all
rows thus costs a bucket one hash for each chunk, however often it occurs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk, and hashes in a bucket, at most about.
CHUNK_BYTES = 12 << 20
BUCKET_HASHES = 2_000_000
LEAST_ID = -(1 << 63)

SENT = "bucket int, chunk int, hashes binary"
WIDE = "bucket int, chunk int, hashes binary, more binary"
ANSWER = "chunk int, bucket int, bits binary"


class Cut:
    """The rows (doc_id, known, text, chunk) dealt by chunk, the bytes of all texts, and which chunks hold the same ids."""

    def __init__(self, rows: DataFrame, size: int, bases: list[int]):
        self.rows, self.size, self.bases = rows, size, np.array(bases)

    def rank(self, chunk: np.ndarray) -> np.ndarray:
        """Chunks in order of their ids: chunks of the rows of one id have the same rank."""
        return np.searchsorted(self.bases, chunk, side="right")


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, pack: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Cut:
    """Chunks of about as many rows each. A null id (known is false) counts as the smallest.

    An id that fills more than a chunk has chunks of its own, dealt by the text's hash.
    pack: what is done to the rows, which have their chunk, before they are dealt.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("doc_id"), F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(docs.sparkSession.sparkContext.defaultParallelism * 2, -(-size // chunk_bytes))
    at = Counter(rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or [])
    hot = {v for v, k in at.items() if k > 1}
    bounds = sorted(set(at) | {v - 1 for v in hot if v > LEAST_ID})
    if not bounds:
        return Cut(pack(rows.withColumn("chunk", F.lit(0))).repartition(1, "chunk"), size, [0])
    # The number of bounds below an id, by bisection.
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    below = lambda n: F.get(F.lit(bounds), F.least(n, F.lit(len(bounds))) - 1) < F.col("doc_id")
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when((a + s <= len(bounds)) & below(a + s), a + s).otherwise(a))
    many = [at[v] if v in hot else 1 for v in bounds] + [1]
    bases = [sum(many[:i]) for i in range(len(many))] if hot else list(range(len(many)))
    if hot:
        own = F.pmod(F.xxhash64("text"), F.get(F.lit(many), F.col("chunk"))).cast("int")
        rows = rows.withColumn("chunk", place).withColumn("chunk", (F.get(F.lit(bases), F.col("chunk")) + own).cast("int"))
    else:
        rows = rows.withColumn("chunk", place)
    return Cut(pack(rows).repartition(sum(many), "chunk"), size, bases)


def buckets_for(hashes: int) -> int:
    return max(1, -(-hashes // BUCKET_HASHES))


def split(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes: buckets are ranges of the hash."""
    step = (1 << 64) // buckets
    return np.append(np.searchsorted(hashes, np.arange(buckets, dtype=np.uint64) * np.uint64(step) if buckets > 1 else np.zeros(1, np.uint64)), len(hashes))


def encode(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences of 6 bytes, or 8 if one doesn't fit."""
    gaps = np.diff(hashes)
    width = 6 if not len(gaps) or int(gaps.max()) < 1 << 48 else 8
    return bytes([width]) + hashes[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decode(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(raw) + 1, 8), np.uint8)
    out[1:, :width] = raw
    out = out.view(np.uint64).ravel()
    out[0] = np.frombuffer(blob, np.uint64, 1, 1)[0]
    return np.cumsum(out, dtype=np.uint64)


def send(chunk: int, hashes: np.ndarray, buckets: int) -> pa.Table:
    at = split(hashes, buckets)
    rows = [(b, chunk, encode(hashes[at[b] : at[b + 1]])) for b in range(buckets) if at[b] < at[b + 1]]
    return pa.table(list(map(list, zip(*rows, strict=True))) or [[], [], []], schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary())]))


def group(hashes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For values of 96 bits, a hash and four bytes more: an order by hash and these, which leaves equal values as they come, where each
    distinct value begins in it, and each value's place among the distinct ones."""
    order = np.argsort(hashes, kind="stable")
    h, x = hashes[order], more[order]
    same = h[1:] == h[:-1]
    if (same & (x[1:] != x[:-1])).any():
        # Two values with one hash: hardly ever.
        order = np.lexsort((more, hashes))
        h, x = hashes[order], more[order]
        same = h[1:] == h[:-1]
    new = np.ones(len(h), bool)
    new[1:] = ~(same & (x[1:] == x[:-1]))
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), place


def answer(sent: pa.Table, cut: Cut) -> pa.Table:
    """For each chunk's values in this bucket: a bit, set if a chunk of smaller ids sent the value too."""
    sent = sent.sort_by("chunk")
    runs = [decode(b) for b in sent.column("hashes").to_pylist()]
    order, begins, place = group(np.concatenate(runs), np.frombuffer(b"".join(sent.column("more").to_pylist()), np.uint32))
    # Equal values come in order of their chunks, so the first is of the chunk with the smallest ids.
    rank = np.repeat(cut.rank(sent.column("chunk").to_numpy()), [len(r) for r in runs])
    again = rank[order[begins]][place] < rank
    ends = np.cumsum([0, *map(len, runs)])
    bits = [np.packbits(again[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table([sent.column("chunk"), sent.column("bucket"), pa.array(bits, pa.binary())], names=["chunk", "bucket", "bits"])


def answers(cut: Cut, values: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """What every chunk is told about the distinct values (hashes, sorted, and four bytes more each) that `values` finds in it."""

    def sender(table: pa.Table) -> pa.Table:
        hashes, more = values(table)
        at = split(hashes, buckets)
        parts = [more[at[b] : at[b + 1]].tobytes() for b in range(buckets) if at[b] < at[b + 1]]
        return send(table.column("chunk")[0].as_py(), hashes, buckets).append_column("more", pa.array(parts, pa.binary()))

    ranks = Cut(None, cut.size, cut.bases.tolist())
    return cut.rows.groupBy("chunk").applyInArrow(sender, WIDE).groupBy("bucket").applyInArrow(lambda t: answer(t, ranks), ANSWER)


def told(hashes: np.ndarray, bits: pa.Table, buckets: int) -> np.ndarray:
    """The answer for each of the chunk's sorted distinct hashes."""
    at, out = split(hashes, buckets), np.zeros(len(hashes), bool)
    for b, x in zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True):
        n = at[b + 1] - at[b]
        out[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=n)
    return out

