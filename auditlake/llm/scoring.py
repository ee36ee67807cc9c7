"""Scoring texts with a Katz back-off model (operator 3).

Tokens are words with A-Z lowered, and one end token a document; end tokens are
also the history of the first words. The model interpolates nothing: a seen gram has
its Good-Turing discounted share; an unseen one falls back to the gram without its
first word, and so on down to the unigram, an unseen word to the mass that unigram
discounts leave, each times the weight that makes the histories' distributions sum
to one exactly. The order is that of `scores`; the query's model has trigrams.

Counts are partitioned by the hash of the word (unigrams) and, level by level, by
the history's number (longer grams; those of frequent histories are dealt over many
partitions, whose sums are added up). A partition numbers its words and its grams;
a number, not the text, is what the next level sends. A chunk of documents sends
each partition its distinct grams with their training counts, so that a frequent
gram costs one entry a chunk. It is answered with the corpus counts, with what the
back-off weights of the histories that it needs them for are made of (how many
grams were seen how often, and the mass that seen followers have one level below),
and with counts of counts, from which it knows the discounts. A history that no
other chunk has is settled in its chunk; only its counts of counts are sent.

Defined results: null text has the end token alone; a text of any length lies in one
chunk, which is as large as that; repeated rows are counted and
scored each; a null id belongs to the training rows; without training rows
every token has probability one half (base: as the formula, V = 0); an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import chunks
from auditlake.llm.common import documents, grouped, mix, slices, words

#: Words of the longest grams of the query's model.
ORDER = 3
#: Counts up to this are discounted.
LIMIT = 5
FOLDS, HELD = 5, 1
#: The followers of a history with more training tokens than this are dealt over several partitions.
HOT = 100_000
#: Larger chunks send a frequent gram less often, and take more memory.
CHUNK_BYTES = 8 << 20
_END = np.uint64(0x5BD1E995A7C15F4B)
_PACKED = "chunk int, rows binary"
_SENT = "bucket int, chunk int, grams binary"
_ANSWER = "kind int, chunk int, bucket int, counts binary, stats binary, hist array<bigint>"
_ANSWERS = pa.schema([("kind", pa.int32()), ("chunk", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary()), ("stats", pa.binary()), ("hist", pa.list_(pa.int64()))])
_SENTS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("grams", pa.binary())])
_RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, compressed: of numbers not below zero the bytes by planes, as many as the largest has; others as they are."""
    out = []
    press = zstandard.ZstdCompressor(level=3)
    for a in arrays:
        wide, body = 0, a
        if a.dtype.kind != "f":
            a = np.ascontiguousarray(a).astype(np.uint64, copy=False)
            wide = max(1, -(-int(a.max(initial=0)).bit_length() // 8))
            body = a.view(np.uint8).reshape(-1, 8)[:, :wide].T
        body = press.compress(np.ascontiguousarray(body).tobytes())
        out += [f"{wide}{len(a):12d}{len(body):12d}".encode(), body]
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at, press = [], 0, zstandard.ZstdDecompressor()
    while at < len(blob):
        wide, n, size = int(blob[at : at + 1]), int(blob[at + 1 : at + 13]), int(blob[at + 13 : at + 25])
        body = press.decompress(blob[at + 25 : at + 25 + size])
        if wide:
            a = np.zeros((n, 8), np.uint8)
            a[:, :wide] = np.frombuffer(body, np.uint8).reshape(wide, n).T
            out.append(a.view(np.uint64).ravel())
        else:
            out.append(np.frombuffer(body, np.float64))
        at += 25 + size
    return out


def _gaps(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Differences of neighbours, modulo 2^64, within runs of so many values; a run's first value as it is."""
    values = values.astype(np.uint64, copy=False)
    out = values.copy()
    out[1:] -= values[:-1]
    lead = (np.cumsum(many) - many)[many > 0]
    out[lead] = values[lead]
    return out


def _summed(gaps: np.ndarray, many: np.ndarray) -> np.ndarray:
    """What _gaps() was made of."""
    sums = np.append(np.uint64(0), np.cumsum(gaps, dtype=np.uint64))
    many = many.astype(np.int64)
    return sums[1:] - np.repeat(sums[np.cumsum(many) - many], many)


def _one(values: np.ndarray) -> np.ndarray:
    return np.array([len(values)])


def _packed(rows: DataFrame) -> DataFrame:
    """The rows of a chunk in a batch as one compressed value."""

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for chunk in pc.unique(batch.column("chunk")).to_pylist():
                own = batch.filter(pc.equal(batch.column("chunk"), chunk)).select(["doc_id", "known", "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as out:
                    out.write_batch(own)
                yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([press.compress(sink.getvalue())], pa.binary())], names=["chunk", "rows"])

    return rows.mapInArrow(pack, _PACKED)


class _Chunk:
    """The tokens of a chunk: distinct words, first by hash and then by number, and each token's place among them."""

    def __init__(self, table: pa.Table):
        hashes, docs, ids, base, press = [], [], [], 0, zstandard.ZstdDecompressor()
        for blob in table.column("rows"):
            rows = pa.ipc.open_stream(press.decompress(blob.as_py())).read_all()
            ids += [i if k else None for i, k in zip(rows.column("doc_id").to_pylist(), rows.column("known").to_pylist(), strict=True)]
            for part in slices(rows, "text", 1 << 20):
                h, doc, _, _ = words(part.column("text"), lower=True)
                at = np.searchsorted(doc, np.arange(1, part.num_rows + 1))
                hashes.append(np.insert(h, at, _END))
                docs.append((np.insert(doc, at, np.arange(part.num_rows)) + base).astype(np.int32))
                base += part.num_rows
        self.chunk, self.rows = table.column("chunk")[0].as_py(), ids
        self.held = np.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD for i in ids], bool)
        self.doc = np.concatenate(docs)
        self.first = np.ones(len(self.doc), bool)
        self.first[1:] = self.doc[1:] != self.doc[:-1]
        self.words, token, _, _ = grouped(np.concatenate(hashes))
        self.token = token.astype(np.int32)
        self.train = ~self.held[self.doc]
        self.end = int(np.searchsorted(self.words, _END))

    def told(self, answers: pa.Table, buckets: int) -> None:
        """From here on words are in order of their numbers, with their corpus counts."""
        at, hist = chunks.split(self.words, buckets), np.zeros(LIMIT + 4, np.int64)
        total, ids = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        for r in _of(answers, 1):
            here = slice(at[r["bucket"]], at[r["bucket"] + 1])
            total[here], ids[here] = _unpack(r["counts"])
            hist += r["hist"]
        order = np.argsort(ids)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.ids, self.total, self.token, self.end = ids[order], total[order], place[self.token], int(place[self.end])
        self.model = _Unigrams(hist)


def _of(answers: pa.Table, kind: int) -> list[dict]:
    return answers.filter(pc.equal(answers.column("kind"), kind)).to_pylist()


def _discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of counts 0..LIMIT+1 (the last: of all larger ones), from the numbers n[1..LIMIT+1] of grams seen so often."""
    d = np.ones(LIMIT + 2)
    cut = (LIMIT + 1) * n[LIMIT + 1] / n[1] if n[1] else 1.0
    for r in range(1, LIMIT + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut != 1 else 0.0
        # Small or odd corpora: half a count is taken away where the estimate is none.
        d[r] = good if 0 < good < 1 else (r - 0.5) / r
    return d


class _Unigrams:
    """Probabilities of words by their corpus count; seen and unseen sum to one."""

    def __init__(self, hist: np.ndarray):
        self.n, self.total, self.distinct = hist[: LIMIT + 2], int(hist[-2]), int(hist[-1])
        self.d = _discounts(self.n)
        r = np.arange(LIMIT + 1)
        lost = float(((1 - self.d[:-1]) * r * self.n[:-1]).sum())
        self.of = self.total + (1 if not lost else 0)
        self.unseen = (lost or 1.0) / self.of if self.total else 0.5

    def p(self, counts: np.ndarray) -> np.ndarray:
        seen = self.d[np.minimum(counts, LIMIT + 1)] * counts / max(self.of, 1)
        return np.where(counts > 0, seen, self.unseen)


def _hist(counts: np.ndarray) -> list[int]:
    n = np.bincount(np.minimum(counts, LIMIT + 2), minlength=LIMIT + 3)[: LIMIT + 2]
    n[0] = 0
    return [*n.tolist(), int(counts.sum()), int((counts > 0).sum())]


class _Level:
    """The distinct grams of one length of a chunk: their histories (places in the level below; one more stands before a text's first
    word), last words, own training counts, and the places in the level below of the grams without the first word."""

    def __init__(self, c: _Chunk, below: _Level | None):
        self.c, self.below = c, below
        if below is None:
            last, self.start, self.number, self.n = c.token, c.end, c.ids, c.total
        else:
            last, self.start = below.which, len(below.word)
            self.number, self.n = np.append(below.ids, 0), np.append(below.total, c.total[c.end])
        history = np.roll(last, 1)
        history[c.first] = self.start
        key = history.astype(np.uint64)
        key <<= np.uint64(32)
        key |= c.token.astype(np.uint64)
        gram, which, order, at = grouped(key)
        self.which = which.astype(np.int32)
        self.history = (gram >> np.uint64(32)).astype(np.int32)
        self.word = (gram & np.uint64(0xFFFFFFFF)).astype(np.int32)
        self.suffix = last[order[at]]
        self.own = np.bincount(self.which[c.train], minlength=len(gram))
        self.lower = (c if below is None else below).total[self.suffix]
        known = self.number[self.history] >= 0
        #: What partitions count, and what is settled here, as no other chunk has the history.
        self.sent, self.here = np.flatnonzero(known), np.flatnonzero(~known & (self.n[self.history] > 0))

    def layout(self, buckets: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each partition: which of the chunk's grams it gets, their histories, how many followers each has there, and which are dealt.

        A history lies in the partition that its number names. A frequent one lies in so many from
        there on, by its followers, that none has many of them; each of them is asked for the
        history, also without a follower, as its sums are added up.
        """
        home, spread = self.number % buckets, 1 + np.minimum(self.n // HOT, buckets - 1)
        history = self.history[self.sent]
        deal = mix(self.c.ids[self.word[self.sent]].astype(np.uint64)) % spread[history].astype(np.uint64)
        place = ((home[history] + deal.astype(np.int64)) % buckets).astype(np.int32)
        order = np.argsort(place, kind="stable")
        edge = np.searchsorted(place[order], np.arange(buckets + 1))
        asked: dict[int, list[int]] = {}
        for h in np.unique(history[spread[history] > 1]).tolist():
            for i in range(int(spread[h])):
                asked.setdefault((int(home[h]) + i) % buckets, []).append(h)
        out = []
        for b in range(buckets):
            mine = self.sent[order[edge[b] : edge[b + 1]]]
            own, many = _runs(self.history[mine])
            more = np.setdiff1d(np.array(asked.get(b, []), np.int64), own)
            own = np.concatenate([own, more])
            out.append((mine, own, np.concatenate([many, np.zeros(len(more), many.dtype)]), spread[own] > 1))
        return out

    def told(self, answers: pa.Table, kind: int, buckets: int, lower: tuple[np.ndarray, np.ndarray | float]) -> None:
        """Corpus counts and numbers of the grams, and from them, with the discounts and history sums of the level below, the model's terms."""
        layout, hist = self.layout(buckets), np.zeros(LIMIT + 4, np.int64)
        self.total, self.ids = np.zeros(len(self.word), np.int64), np.full(len(self.word), -1)
        self.seen, self.mass, lost = np.zeros((LIMIT, len(self.n)), np.int32), np.zeros(len(self.n)), np.zeros(len(self.n), bool)
        for r in _of(answers, kind):
            mine, own, _, _ = layout[r["bucket"]]
            total, loss, need, *numbers = _unpack(r["counts"])
            self.total[mine] = total
            lost[own] |= loss > 0
            own = own[need > 0]
            *seen, mass = _unpack(r["stats"])
            for k, s in enumerate(seen):
                self.seen[k, own] += s.astype(np.int32)
            self.mass[own] += mass
            if numbers:
                self.ids[mine[numbers[0] > 0]] = _summed(numbers[1], _one(numbers[1])).astype(np.int64)
            hist += r["hist"]
        d, here = lower[0], self.here
        self.total[here] = self.own[here]
        told = here[self.own[here] > 0]
        r = np.minimum(self.own[told], LIMIT + 1)
        for k in range(LIMIT):
            self.seen[k] += np.bincount(self.history[told[r == k + 1]], minlength=len(self.n)).astype(np.int32)
        self.mass += np.bincount(self.history[told], _share(d, self.lower[told]), minlength=len(self.n))
        lost |= (self.seen > 0).any(axis=0)
        self.d = _discounts(hist[: LIMIT + 2])
        # A history whose grams are all frequent loses nothing to discounts: one count is set aside.
        self.of = self.n + ((self.n > 0) & ~lost)
        self.mass /= lower[1]

    def sums(self) -> np.ndarray:
        """What the shares of this level's grams are divided by, for every history of the level above."""
        return np.append(self.of[self.suffix], self.of[self.start])

    def p(self, lower: np.ndarray) -> np.ndarray:
        """Probabilities of the grams, from those of the level below."""
        r = np.arange(1, LIMIT + 1)[:, None]
        kept = self.n + ((self.d[1 : LIMIT + 1, None] - 1) * r * self.seen).sum(axis=0)
        weight = np.where(self.n > 0, (1 - kept / np.maximum(self.of, 1)) / np.maximum(1 - self.mass, 1e-12), 1.0)
        return np.where(self.total > 0, _share(self.d, self.total) / np.maximum(self.of[self.history], 1), weight[self.history] * lower[self.suffix])


def _share(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, LIMIT + 1)] * counts


def _levels(table: pa.Table, answers: pa.Table, order: int, buckets: int, last: bool) -> tuple[_Chunk, list[_Level]]:
    """The chunk and its levels of two words and more; the last is answered only if so said."""
    c = _Chunk(table)
    c.told(answers, buckets)
    levels: list[_Level] = []
    for kind in range(2, order + 1):
        levels.append(_Level(c, levels[-1] if levels else None))
        if kind < order or last:
            levels[-1].told(answers, kind, buckets, _lower(c, levels[:-1]))
    return c, levels


def _lower(c: _Chunk, below: list[_Level]) -> tuple[np.ndarray, np.ndarray | float]:
    return (below[-1].d, np.maximum(below[-1].sums(), 1)) if below else (c.model.d, max(c.model.of, 1))


def _sent(chunk: int, blobs: list[bytes]) -> pa.Table:
    return pa.table([pa.array(range(len(blobs)), pa.int32()), pa.array([chunk] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], schema=_SENTS)


def _send_words(table: pa.Table, buckets: int) -> pa.Table:
    c = _Chunk(table)
    at, counts = chunks.split(c.words, buckets), np.bincount(c.token[c.train], minlength=len(c.words))
    parts = [slice(at[b], at[b + 1]) for b in range(buckets)]
    return _sent(c.chunk, [_pack(_gaps(c.words[x], _one(c.words[x])), counts[x]) for x in parts])


def _answered(sent: pa.Table, kind: int, hist: np.ndarray, told: list[tuple[bytes, bytes | None]]) -> pa.Table:
    n = len(told)
    columns = [[kind] * n, sent.column("chunk").to_pylist(), sent.column("bucket").to_pylist(), *map(list, zip(*told, strict=True)), [hist.tolist()] * n]
    return pa.table([pa.array(c, t) for c, t in zip(columns, _ANSWERS.types, strict=True)], schema=_ANSWERS)


def _count_words(sent: pa.Table, buckets: int) -> pa.Table:
    runs = [_unpack(b) for b in sent.column("grams").to_pylist()]
    _, place, order, first = grouped(np.concatenate([_summed(r[0], _one(r[0])) for r in runs]))
    sums = np.add.reduceat(np.concatenate([r[1] for r in runs]).astype(np.int64)[order], first) if len(first) else np.zeros(0, np.int64)
    # Frequent words have small numbers; a number modulo the partitions is the word's partition.
    ids = np.empty(len(sums), np.int64)
    ids[np.argsort(-sums, kind="stable")] = np.arange(len(sums)) * buckets + sent.column("bucket")[0].as_py()
    ends = np.cumsum([0, *(len(r[0]) for r in runs)])
    return _answered(sent, 1, np.array(_hist(sums)), [(_pack(sums[place[a:z]], ids[place[a:z]]), None) for a, z in zip(ends[:-1], ends[1:], strict=True)])


def _runs(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.flatnonzero(new)
    return ranked[at], np.diff(np.append(at, len(ranked)))


def _send_grams(table: pa.Table, answers: pa.Table, kind: int, buckets: int) -> pa.Table:
    if not table.num_rows:
        return _SENTS.empty_table()
    c, levels = _levels(table, answers, kind, buckets, False)
    level, (d, _) = levels[-1], _lower(c, levels[:-1])
    settled, blobs = np.array(_hist(level.own[level.here])), []
    for b, (mine, own, many, dealt) in enumerate(level.layout(buckets)):
        blobs.append(_pack(d, settled if not b else 0 * settled, _gaps(level.number[own], _one(own)), many, dealt, _gaps(c.ids[level.word[mine]], many), level.lower[mine], level.own[mine]))
    return _sent(c.chunk, blobs)


def _count_grams(sent: pa.Table, kind: int, numbered: bool, buckets: int) -> pa.Table:
    runs = [_unpack(b) for b in sent.column("grams").to_pylist()]
    d, bucket = runs[0][0], sent.column("bucket")[0].as_py()
    histories, where, _, _ = grouped(np.concatenate([_summed(r[2], _one(r[2])) for r in runs]))
    history = np.repeat(where, np.concatenate([r[3] for r in runs]).astype(np.int64))
    word = np.concatenate([_summed(r[5], r[3]) for r in runs])
    if len(word) and int(word.max()) >= 1 << 32:
        word = grouped(word)[1].astype(np.uint64)
    _, place, order, first = grouped(history.astype(np.uint64) << np.uint64(32) | word)
    sums = np.add.reduceat(np.concatenate([r[7] for r in runs]).astype(np.int64)[order], first) if len(first) else np.zeros(0, np.int64)
    # Of every distinct gram seen in training: its history's place, how often, and the share of the gram without the first word.
    one = order[first][sums > 0]
    group, often = history[one], np.minimum(sums[sums > 0], LIMIT + 1)
    n = len(histories)
    mass = np.bincount(group, _share(d, np.concatenate([r[6] for r in runs]).astype(np.int64)[one]), minlength=n)
    seen = [np.bincount(group[often == k], minlength=n) for k in range(1, LIMIT + 1)]
    loss = reduce(np.add, seen) > 0
    # Only grams that another chunk has as well are numbered, in order of their histories and words.
    common = (np.diff(np.append(first, len(place))) > 1) & (sums > 0)
    ids = np.cumsum(common) * buckets + bucket
    told, a, g = [], 0, 0
    for _, _, own, many, dealt, follower, _, _ in runs:
        at, own = place[a : a + len(follower)], where[g : g + len(own)]
        unseen = np.repeat(np.arange(len(own)), many.astype(np.int64))[sums[at] == 0]
        need = (np.bincount(unseen, minlength=len(own)) > 0) | (dealt > 0)
        both = common[at]
        numbers = [both, _gaps(ids[at[both]], np.array([int(both.sum())]))] if numbered else []
        told.append((_pack(sums[at], loss[own], need, *numbers), _pack(*(s[own[need]] for s in seen), mass[own[need]])))
        a, g = a + len(follower), g + len(own)
    hist = np.array(_hist(sums)) + np.sum([r[1] for r in runs], axis=0).astype(np.int64)
    return _answered(sent, kind, hist, told)


def _score(table: pa.Table, answers: pa.Table, order: int, buckets: int) -> pa.Table:
    names = [f.strip().split()[0] for f in _RESULT.split(",")]
    if not table.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
    c, levels = _levels(table, answers, order, buckets, True)
    p, which, model, rows = c.model.p(c.total), c.token, c.model, len(c.rows)
    for level in levels:
        p, which = level.p(p), level.which
    score = np.bincount(c.doc, np.log10(np.maximum(p, 1e-300))[which], minlength=rows)
    plain = np.log10((c.total + 0.5) / (model.total + 0.5 * (model.distinct + 1)))
    base = np.bincount(c.doc, plain[c.token], minlength=rows)
    n, known = np.bincount(c.doc, minlength=rows), np.bincount(c.doc[c.total[c.token] > 0], minlength=rows)
    return pa.table([pa.array(c.rows, pa.int64()), pa.array(c.held), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([model.total] * rows, pa.int64()), pa.array(base), pa.array(score)], names=names)


def _sender(kind: int, buckets: int) -> tuple[Callable[[pa.Table, pa.Table], pa.Table], str]:
    return lambda t, a: _send_grams(t, a, kind, buckets), _SENT


def _counter(kind: int, numbered: bool, buckets: int) -> tuple[Callable[[pa.Table], pa.Table], str]:
    return lambda t: _count_grams(t, kind, numbered, buckets), _ANSWER


def scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; order: words of the longest grams."""
    cut = chunks.cut(docs, chunk_bytes=CHUNK_BYTES, pack=_packed)
    buckets, parts = chunks.buckets_for(cut.size // 7), int(cut.bases[-1]) + 1
    by = cut.rows.groupBy("chunk")
    # Dealt as the chunks are, answers are shuffled once, and all later steps read that.
    answers = by.applyInArrow(lambda t: _send_words(t, buckets), _SENT).groupBy("bucket").applyInArrow(lambda t: _count_words(t, buckets), _ANSWER).repartition(parts, "chunk")
    for kind in range(2, order + 1):
        counted = by.cogroup(answers.groupBy("chunk")).applyInArrow(*_sender(kind, buckets)).groupBy("bucket").applyInArrow(*_counter(kind, kind < order, buckets))
        answers = answers.unionByName(counted.repartition(parts, "chunk"))
    return by.cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, a: _score(t, a, order, buckets), _RESULT)


def op3_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir), ORDER)
