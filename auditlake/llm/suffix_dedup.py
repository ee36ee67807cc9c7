"""Removal of repeated byte strings by a merge sort of suffixes (operator 10).

A byte goes if a string of `SIZE` bytes that covers it also starts in a document
with a smaller id. Of all suffixes only those at anchors are sorted. A window of
SIZE bytes has as its anchor the first place of its minimiser, the least hash of a
`GRAM`-byte string in it; equal windows have equal minimisers and lie alike around
their anchors. Windows with one anchor form a super-suffix: what follows from the
anchor on, and what stands before it.

1. Of the minimisers that only one chunk of documents holds, the chunk itself takes
   care (chunks.py tells which these are).
2. A chunk sorts its other super-suffixes, distinct, by what follows the anchor
   within ranges of the minimiser, and sends each range as a front-coded run: common
   prefix with the suffix before, and the rest.
3. A range merges the runs of all chunks with a loser tree in which every suffix
   carries the prefix it shares with the last winner, so that known prefixes
   aren't compared again. What comes out is the sorted order with the common prefix
   of each suffix and its neighbour. What stands before the anchors is sorted
   likewise, read backwards.
4. Two windows that begin k bytes before their anchors are equal if no neighbour
   between them has a common prefix of less than SIZE - k bytes in the first order,
   nor of less than k bytes in the second. So each window is told the first chunk
   that holds it, and a chunk is answered with a bit for each window: does an
   earlier chunk hold it?
5. Repeats within a chunk are found by the chunk in the same way, with document ids
   in place of chunks.

Defined results: null text is empty; texts shorter than SIZE lose nothing; a text
of any length lies in one chunk, which is as large as that; repeated rows with one
id don't remove each other's bytes; null ids count as one that is the smallest; an empty
table gives an empty result; further columns are ignored. Bytes are compared, not
hashes; hashes only choose anchors and ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import chunks
from auditlake.llm.common import distinct, documents, grouped, mix, slices, text_bytes

SIZE = 50
GRAM = 24
#: A range holds every window of its strings at once, so chunks and ranges are smaller here than for words.
CHUNK_BYTES = 8 << 20

_RUNS = "bucket int, chunk int, run binary"
_ANSWER = "kind int, chunk int, bucket int, bits binary"
_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, removed array<struct<start: bigint, stop: bigint>>, kept binary"
_ODD = np.random.default_rng(77).integers(0, 2**63, 8, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def _eight(data: np.ndarray) -> np.ndarray:
    """Eight bytes as a number, from every position."""
    padded = np.zeros(len(data) + SIZE + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + SIZE, np.uint64, padded, 0, (1,))


def super_suffixes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, windows, bytes before the anchor, minimiser) of the super-suffixes of texts that lie one after another."""
    n = len(data) - SIZE + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint64)
    e = _eight(data)[: len(data)]
    m = len(data) - GRAM + 1
    h = np.zeros(m, np.uint64)
    for k in range(GRAM // 8):
        h += e[8 * k : 8 * k + m] * _ODD[k]
    h ^= h >> np.uint64(29)
    h *= _ODD[7]
    least, reach, width = h, 1, SIZE - GRAM + 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:n], least[width - reach : width - reach + n])
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, np.maximum(at[1:-1] - SIZE + 1, at[:-2]), 1)
    np.add.at(inside, at[1:-1], -1)
    good = np.cumsum(inside[:n]) == 0
    # A window that begins at its anchor is the last one with that anchor.
    own = good & (h[:n] == least)
    new = good.copy()
    new[1:] &= ~good[:-1] | (least[1:] != least[:-1]) | own[:-1]
    # A window right behind a text's last byte begins a new text.
    starts = at[1:-1][(at[1:-1] < n)]
    new[starts] |= good[starts]
    first = np.flatnonzero(new)
    stop = good.copy()
    stop[:-1] &= ~good[1:] | new[1:]
    last = np.flatnonzero(stop)
    # The others have it behind the start of their last window.
    anchor = np.where(own[last], last, -1)
    open_ = np.flatnonzero(anchor < 0)
    for k in range(1, width):
        here = last[open_] + k
        hit = h[here] == least[last[open_]]
        anchor[open_[hit]] = here[hit]
        open_ = open_[~hit]
    # The least of many hashes is small; mixed again, ranges of it are even.
    return np.searchsorted(at, first, side="right") - 1, first, last + 1 - first, anchor - first, mix(least[first])


def common_prefixes(strings: list[bytes]) -> np.ndarray:
    """The length of the prefix that each of the sorted strings shares with the one before; none of them is longer than SIZE."""
    if not strings:
        return np.zeros(0, np.int64)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    wide = np.array(strings, f"S{SIZE}").view(np.uint8).reshape(-1, SIZE)
    out = np.zeros(len(strings), np.int64)
    differ = wide[1:] != wide[:-1]
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), SIZE)
    out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
    return out


def earliest(rank: np.ndarray, common: np.ndarray, before: list[bytes], many: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every window of every super-suffix the least `first` of those that hold an equal window.

    rank: place of what follows the anchor among all such suffixes, sorted, with `common`
    prefixes between neighbours; before: what stands before the anchor.
    """
    if not len(before):
        return np.zeros(0, first.dtype)
    back = [x[::-1] for x in before]
    order = sorted(set(back))
    place = dict(zip(order, range(len(order)), strict=True))
    behind, shared = np.fromiter(map(place.__getitem__, back), np.int64, len(back)), common_prefixes(order)
    which = np.repeat(np.arange(len(many)), many)
    ahead = np.fromiter(map(len, before), np.int64, len(before))[which] - (np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many))
    ahead = ahead.astype(np.uint8)
    out = np.empty(len(which), first.dtype)
    for k in range(int(ahead.max()) + 1):
        at = np.flatnonzero(ahead == k)
        if len(at):
            own = which[at]
            right, left = np.cumsum(common < SIZE - k), np.cumsum(shared < k)
            _, group, by, begins = grouped((right[rank[own]] * (len(order) + 1) + left[behind[own]]).astype(np.int64))
            out[at] = np.minimum.reduceat(first[own[by]], begins)[group]
    return out


def _slices(table: pa.Table) -> Iterator[tuple]:
    for part in slices(table, "text", 1 << 20):
        data, at = text_bytes(part.column("text"))
        yield (part, data, at, *super_suffixes(data, at))


def _minimisers(table: pa.Table) -> np.ndarray:
    return distinct(np.concatenate([x[-1] for x in _slices(table)]))


def _shared(sent: pa.Table) -> pa.Table:
    """For each chunk's minimisers in this bucket: a bit, set if another chunk sent it too."""
    runs = [chunks.decode(b) for b in sent.column("hashes").to_pylist()]
    every = np.concatenate(runs)
    order = np.argsort(every)
    same = every[order][1:] == every[order][:-1]
    both = np.zeros(len(every), bool)
    both[order[1:][same]] = True
    both[order[:-1][same]] = True
    ends = np.cumsum([0, *map(len, runs)])
    bits = [np.packbits(both[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table([pa.array([1] * len(runs), pa.int32()), sent.column("chunk"), sent.column("bucket"), pa.array(bits, pa.binary())], names=["kind", "chunk", "bucket", "bits"])


def front_code(strings: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run of (suffix from the anchor on, bytes before it): common prefixes, lengths and the rests."""
    suffixes, before = [x[0] for x in strings], [x[1] for x in strings]
    common = common_prefixes(suffixes)
    sizes = [np.fromiter(map(len, x), np.uint8, len(strings)).tobytes() for x in (suffixes, before)]
    rests = [x[n:] for x, n in zip(suffixes, common.tolist(), strict=True)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([len(strings).to_bytes(4, "little"), common.astype(np.uint8).tobytes(), *sizes, *rests, *before]))


def front_decode(run: bytes) -> tuple[list[bytes], list[int], list[bytes]]:
    """The suffixes of a run, how much each shares with the one before, and what stands before the anchors."""
    raw = zstandard.ZstdDecompressor().decompress(run)
    n = int.from_bytes(raw[:4], "little")
    common, size, behind = (np.frombuffer(raw, np.uint8, n, 4 + k * n).tolist() for k in range(3))
    at, last, out = 4 + 3 * n, b"", []
    for c, m in zip(common, size, strict=True):
        last = last[:c] + raw[at : at + m - c]
        at += m - c
        out.append(last)
    ends = [at, *(at + np.cumsum(behind)).tolist()]
    return out, common, [raw[a:b] for a, b in pairwise(ends)]


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, length of the prefix shared with the string before) over all runs in order, by a loser tree.

    Each contender carries the length of the prefix that it shares with the last
    winner. The one that shares more is the smaller; only at a tie are bytes
    compared, from the tie on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    texts, commons = [r[0] for r in runs], [r[1] for r in runs]
    place = [0] * len(runs)
    head: list[bytes | None] = [t[0] if t else None for t in texts] + [None] * (k - len(runs))
    share = [0] * k

    def beats(a: int, b: int) -> bool:
        """Does a come before b? The loser's shared prefix becomes that with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return y is None and x is not None
        h = share[a]
        if h != share[b]:
            return h > share[b]
        if x == y:
            share[b if a < b else a] = len(x)
            return a < b
        n = min(len(x), len(y))
        while h < n and x[h] == y[h]:
            h += 1
        less = x[h:] < y[h:]
        share[b if less else a] = h
        return less

    losers, winners = [0] * k, list(range(k))
    level = winners
    node = k
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            win, lose = (a, b) if beats(a, b) else (b, a)
            losers[(node + i) // 2] = lose
            up.append(win)
        node //= 2
        level = up
    win = level[0]
    while head[win] is not None:
        yield win, place[win], share[win]
        at = place[win] = place[win] + 1
        if at < len(texts[win]):
            head[win], share[win] = texts[win][at], commons[win][at]
        else:
            head[win] = None
        at = (k + win) // 2
        while at:
            other = losers[at]
            if beats(other, win):
                losers[at], win = win, other
            at //= 2


def _send_runs(table: pa.Table, bits: pa.Table, buckets: int) -> pa.Table:
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("run", pa.binary())])
    if not table.num_rows:
        return schema.empty_table()
    runs, _ = _runs(list(_slices(table)), bits, buckets)
    chunk = table.column("chunk")[0].as_py()
    rows = [(b, chunk, front_code(s)) for b, s in runs.items()]
    return pa.table(list(map(list, zip(*rows, strict=True))) or [[], [], []], schema=schema)


def _runs(parts: list[tuple], bits: pa.Table, buckets: int) -> tuple[dict[int, list[tuple[bytes, bytes]]], list[tuple]]:
    """The chunk's sorted distinct shared super-suffixes by bucket, and by part the shared ones (numbers, buckets, pairs of bytes)."""
    known = distinct(np.concatenate([p[-1] for p in parts]))
    shared = chunks.told(known, bits, buckets)
    found: dict[int, set[tuple[bytes, bytes]]] = {}
    own = []
    for _, data, _, _, begin, many, ahead, least in parts:
        where = np.flatnonzero(shared[np.searchsorted(known, least)]) if len(known) else np.zeros(0, np.int64)
        bucket = bucket_of(least[where], buckets)
        pairs = _pairs(data.tobytes(), begin[where], many[where], ahead[where])
        for b, x in zip(bucket.tolist(), pairs, strict=True):
            found.setdefault(b, set()).add(x)
        own.append((where, bucket, pairs))
    return {b: sorted(x, key=itemgetter(0)) for b, x in sorted(found.items())}, own


def _pairs(raw: bytes, begin: np.ndarray, many: np.ndarray, ahead: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(suffix from the anchor on, bytes before it) of super-suffixes."""
    anchor = begin + ahead
    return [(raw[p:z], raw[a:p]) for a, p, z in zip(begin.tolist(), anchor.tolist(), (begin + many + SIZE - 1).tolist(), strict=True)]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    step = np.uint64((1 << 64) // buckets) if buckets > 1 else np.uint64(0)
    return np.minimum(hashes // step, np.uint64(buckets - 1)).astype(np.int64) if buckets > 1 else np.zeros(len(hashes), np.int64)


def _windows(pairs: list[tuple[bytes, bytes]]) -> int:
    """How many windows super-suffixes have together."""
    return sum(len(a) + len(b) - SIZE + 1 for a, b in pairs)


def _merge_runs(sent: pa.Table, cut: chunks.Cut) -> pa.Table:
    """For every window of every chunk's super-suffixes in this bucket: a bit, set if a chunk of smaller ids holds it."""
    sent = sent.sort_by("chunk")
    number = cut.rank(sent.column("chunk").to_numpy())
    runs = [front_decode(r) for r in sent.column("run").to_pylist()]
    base = np.cumsum([0, *(len(r[0]) for r in runs)])
    rank, common = np.zeros(base[-1], np.int64), np.zeros(base[-1], np.int64)
    starts = base.tolist()
    for n, (run, at, share) in enumerate(merge([r[:2] for r in runs])):
        rank[starts[run] + at] = n
        common[n] = share
    before = list(chain.from_iterable(r[2] for r in runs))
    many = np.fromiter((len(a) + len(b) - SIZE + 1 for r in runs for a, b in zip(r[0], r[2], strict=True)), np.int64, len(before))
    first = np.repeat(number, np.diff(base))
    again = earliest(rank, common, before, many, first) < np.repeat(first, many)
    ends = np.concatenate([[0], np.cumsum(many)])[base]
    bits = [np.packbits(again[a:b]).tobytes() for a, b in pairwise(ends.tolist())]
    return pa.table([pa.array([2] * len(bits), pa.int32()), sent.column("chunk"), sent.column("bucket"), pa.array(bits, pa.binary())], names=["kind", "chunk", "bucket", "bits"])


def _remove(table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
    if not table.num_rows:
        return schema.empty_table()
    parts = list(_slices(table))
    kind = answers.column("kind").to_numpy()
    runs, own = _runs(parts, answers.filter(pa.array(kind == 1)), buckets)
    told = {r["bucket"]: r["bits"] for r in answers.filter(pa.array(kind == 2)).to_pylist()}
    flags, offset, total = [], {}, 0
    for b, pairs in runs.items():
        flags.append(np.unpackbits(np.frombuffer(told[b], np.uint8), count=_windows(pairs)).view(bool))
        for x in pairs:
            offset[x] = total
            total += len(x[0]) + len(x[1]) - SIZE + 1
    flags = np.concatenate(flags) if flags else np.zeros(0, bool)

    # Repeats within the chunk: super-suffixes of the minimisers that it holds more than once.
    _, place, _, begins = grouped(np.concatenate([p[-1] for p in parts]))
    often = (np.diff(np.append(begins, len(place))) > 1)[place] if len(place) else np.zeros(0, bool)
    suffixes, before, ids, sizes, wheres, done = [], [], [], [], [], 0
    for part, data, _, doc, begin, many, ahead, _ in parts:
        mine = np.flatnonzero(often[done : done + len(doc)])
        done += len(doc)
        pairs = _pairs(data.tobytes(), begin[mine], many[mine], ahead[mine])
        suffixes += [x[0] for x in pairs]
        before += [x[1] for x in pairs]
        m = many[mine]
        sizes.append(m)
        wheres.append(np.repeat(begin[mine] - (np.cumsum(m) - m), m) + np.arange(int(m.sum())))
        ids.append(part.column("doc_id").to_numpy()[doc[mine]])
    order = sorted(set(suffixes))
    place = dict(zip(order, range(len(order)), strict=True))
    rank = np.fromiter(map(place.__getitem__, suffixes), np.int64, len(suffixes))
    sizes, ids = np.concatenate(sizes), np.concatenate(ids)
    local = earliest(rank, common_prefixes(order), before, sizes, ids) < np.repeat(ids, sizes)

    out, done = [], 0
    for (part, data, at, _, begin, many, _, _), (where, _, pairs), mine in zip(parts, own, wheres, strict=True):
        again = mine[local[done : done + len(mine)]]
        done += len(mine)
        m = many[where]
        here = np.fromiter(map(offset.__getitem__, pairs), np.int64, len(pairs))
        ahead = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        again = np.concatenate([again, (np.repeat(begin[where], m) + ahead)[flags[np.repeat(here, m) + ahead]]])
        cover = np.zeros(len(data) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + SIZE, -1)
        gone = np.cumsum(cover[:-1]) > 0
        for i, (doc_id, known) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("known").to_pylist(), strict=True)):
            mask = gone[at[i] : at[i + 1]]
            n = int(mask.sum())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist() if n else []
            text = data[at[i] : at[i + 1]]
            out.append((doc_id if known else None, len(mask), n, [{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2], strict=True)], (text[~mask] if n else text).tobytes()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (maximal runs of byte positions), kept (the bytes that stay)."""
    cut = chunks.cut(docs, chunk_bytes=CHUNK_BYTES)
    buckets = chunks.buckets_for(cut.size // 3)
    by, ranks = cut.rows.groupBy("chunk"), chunks.Cut(None, cut.size, cut.bases.tolist())

    def sender(table: pa.Table) -> pa.Table:
        return chunks.send(table.column("chunk")[0].as_py(), _minimisers(table), buckets)

    shared = by.applyInArrow(sender, chunks.SENT).groupBy("bucket").applyInArrow(_shared, _ANSWER)
    runs = by.cogroup(shared.groupBy("chunk")).applyInArrow(lambda t, a: _send_runs(t, a, buckets), _RUNS)
    merged = runs.groupBy("bucket").applyInArrow(lambda t: _merge_runs(t, ranks), _ANSWER)
    return by.cogroup(shared.unionByName(merged).groupBy("chunk")).applyInArrow(lambda t, a: _remove(t, a, buckets), _RESULT)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
