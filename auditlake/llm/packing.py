"""Packing documents into fixed-length sequences (operator 1).

Cutting stock by column generation. Each document is tokenised once and cut only
at multiples of the capacity; the remainder is one piece. Piece lengths, rounded
up to a unit of 8 tokens, form a histogram with at most capacity/8 classes, and
only that histogram reaches the driver. A linear program over patterns is solved
there: its dual values price the classes, a knapsack recursion finds the pattern
worth most, and it enters the basis until none is worth more than a sequence.
Pattern counts are rounded down, the few pieces left over are packed first-fit.
Then Spark ranks the pieces of each class (in salted buckets, so that no class is
ranked by one task) and rank alone decides sequence and place.

Defined results: null text is empty text and packs as the end token alone; a text of
any length is tokenised as a whole and cut into pieces; repeated rows, and rows with
one id or none, are packed each; equal lengths are ranked by id and place; an empty table gives an empty result; a class
without pieces has no pattern; further columns are passed by.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import documents, resident, slices, text_bytes, written

CAPACITY = 4096
UNIT = 8
VOCABULARY = "word_bpe_49k.json"
END = 2
#: Pieces that a task ranks together, at least.
RANKED = 300
#: Words whose ids a worker remembers: about 200 bytes each.
CACHE = 400_000

_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_LETTER = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])"
_MARK = rb"[!-&(-/:-@\[-`{-~]"
#: Runs of ASCII marks between plain characters, which the vocabulary always splits off; an apostrophe can begin a suffix.
_MARKS = re.compile(_MARK + rb"(?:" + rb"|".join(rb"(?<=%s%s)" % (x, _MARK) for x in (rb"[a-z0-9 \t\n\r]", rb"\xc3[\x9f-\xb6\xb8-\xbf]", rb"\A")) + rb")" + _MARK + rb"*+(?=[a-z0-9 \t\n\r]|\xc3[\x9f-\xb6\xb8-\xbf]|\Z)")
#: Words of lower-case letters alone, or of marks alone: nothing to normalise and nothing to split.
_PLAIN = re.compile(_LETTER + rb"+|" + _MARK + rb"+")


def _byte_letters() -> str:
    """The letter by which a byte-level vocabulary writes each byte: itself if it can be seen, else the next free one from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return "".join(chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256))


class _Ids:
    """Token ids by word. The vocabulary drops white space and never joins across it, nor across a letter and a mark, so words are looked up one by one."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        path = name if "/" in name else public_tokenizers.path(name)
        self.whole = Tokenizer.from_file(path)
        # The same merges without normalising and splitting, for words that need neither.
        with open(path) as f:
            setup = json.load(f)
        self.special = [t["content"].encode() for t in setup["added_tokens"]]
        setup.update(normalizer=None, added_tokens=[], pre_tokenizer={"type": "CharDelimiterSplit", "delimiter": " "})
        self.merges = Tokenizer.from_str(json.dumps(setup))
        self.letters = _byte_letters()
        # A word that no plain word equals, with one id, stands between words that are encoded together.
        self.edge = self.letters[0]
        self.edge_id = self.merges.encode(self.edge, add_special_tokens=False).ids
        self.index: dict[bytes, bytes] = {}

    def learn(self, new: list[bytes]) -> None:
        plain = [w for w in new if _PLAIN.fullmatch(w)] if len(self.edge_id) == 1 else []
        for i in range(0, len(plain), 1000):
            some = plain[i : i + 1000]
            text = f" {self.edge} ".join([w.decode("latin-1").translate(self.letters) for w in some])
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.edge_id[0])
            raw = ids.tobytes()
            self.index.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(some, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True))
        rest = [w for w in new if w not in self.index]
        for i in range(0, len(rest), 1000):
            some = rest[i : i + 1000]
            for w, e in zip(some, self.whole.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                self.index[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of every text, four bytes each."""
        # Lower-casing ASCII is what the vocabulary does first; a special token is found before that.
        split = [(t if any(x in t for x in self.special) else _MARKS.sub(rb" \g<0> ", t.lower())).split() for t in texts]
        new = set(chain.from_iterable(split)).difference(self.index)
        if len(self.index) + len(new) > CACHE:
            self.index.clear()
            new = set(chain.from_iterable(split))
        if new:
            self.learn(list(new))
        get = self.index.__getitem__
        return [b"".join(map(get, x)) for x in split]


def _pieces(capacity: int, vocabulary: str):
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = resident(("packing", vocabulary), lambda: _Ids(vocabulary))
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, at = text_bytes(part.column("text"))
                raw, rows = data.tobytes(), []
                for doc, ids in zip(part.column("doc_id").to_pylist(), tokens.encode([raw[a:b] for a, b in pairwise(at.tolist())]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc, a, min(capacity, n - a), zlib.crc32(ids[4 * a : 4 * (a + capacity)]), n) for a in range(0, n, capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def tokenised(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: its document, first id, number of ids and their checksum."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(capacity, vocabulary), _PIECES)


def _knapsack(price: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The multiset of classes (1..size units) worth most within size units; price[w-1] for class w."""
    best, took = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for room in range(1, size + 1):
        worth = best[room - 1 :: -1][:room] + price[:room]
        w = int(worth.argmax())
        if worth[w] > best[room - 1] + 1e-12:
            best[room], took[room] = worth[w], w + 1
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(size, np.int64), size
    while room:
        if took[room]:
            pattern[took[room] - 1] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[size]), pattern


def _largest_first(left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A first basis, how often each pattern is used, and the class that it uses up.

    A sequence is filled with the largest classes left, and that is repeated until one of
    its classes is used up. No later pattern has that class, so the patterns are
    independent, and triangular in the order of these classes.
    """
    size, patterns, level, last = len(left), [], [], []
    open_ = left > 0
    while open_.any():
        pattern, room = np.zeros(size, np.int64), size
        for w in np.flatnonzero(open_)[::-1]:
            if w < room:
                pattern[w] = room // (w + 1)
                room -= pattern[w] * (w + 1)
        own = np.flatnonzero(pattern)
        times = left[own] / pattern[own]
        out = own[times.argmin()]
        patterns.append(pattern)
        level.append(times.min())
        last.append(out)
        left[own] = np.maximum(left[own] - times.min() * pattern[own], 0)
        open_[out] = False
    return np.array(patterns), np.array(level), np.array(last)


def _inverse(patterns: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Inverse of the basis whose columns are the patterns and whose rows the classes in ascending order, by substitution.

    Sums are written out: the driver of a Spark job shouldn't start threads of a linear algebra library.
    """
    n = len(last)
    basis, out = patterns[:, last].T.astype(float), np.zeros((n, n))
    for i in range(n):
        row = -(basis[i, :i, None] * out[:i]).sum(axis=0)
        row[i] += 1
        out[i] = row / basis[i, i]
    return out[:, np.argsort(last)]


def column_generation(demand: np.ndarray, rounds: int = 1500, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per row, over classes of 1..n units) and how often each is used, fractional, to cover demand with few sequences."""
    size = len(demand)
    have = np.flatnonzero(demand)
    if not len(have):
        return np.zeros((0, size), np.int64), np.zeros(0)
    patterns, level, last = _largest_first(demand.astype(float))
    inverse = _inverse(patterns, last)
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        price = np.full(size, -1.0)
        price[have] = dual
        worth, pattern = _knapsack(price, size)
        if worth <= 1 + gap:
            break
        column = (inverse * pattern[have]).sum(axis=1)
        usable = np.flatnonzero(column > 1e-9)
        if not len(usable):
            break
        out = usable[np.argmin(level[usable] / column[usable])]
        step = level[out] / column[out]
        level = np.maximum(level - step * column, 0)
        level[out] = step
        row = inverse[out] / column[out]
        inverse -= np.outer(column, row)
        inverse[out] = row
        patterns[out] = pattern
    return patterns, level


def plan(demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of patterns that cover the demand: rounded down, then first-fit for what is left."""
    patterns, level = column_generation(demand)
    times = np.floor(level + 1e-6).astype(np.int64)
    left = demand.astype(np.int64) - (times[:, None] * patterns).sum(axis=0)
    for w in np.flatnonzero(left < 0):
        left[w] = 0
    open_, room = [], []
    for w in range(len(demand) - 1, -1, -1):
        for _ in range(int(left[w])):
            at = next((i for i, r in enumerate(room) if r >= w + 1), None)
            if at is None:
                open_.append(np.zeros(len(demand), np.int64))
                room.append(len(demand))
                at = len(room) - 1
            open_[at][w] += 1
            room[at] -= w + 1
    used = times > 0
    return np.concatenate([patterns[used], np.array(open_, np.int64).reshape(-1, len(demand))]), np.concatenate([times[used], np.ones(len(open_), np.int64)])


def pack(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """The pieces with sequence_id and offset. pieces must be a written table: it is read for the histogram and again for the result."""
    spark = pieces.sparkSession
    classed = pieces.withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    demand = np.zeros(-(-capacity // unit), np.int64)
    for c, n in classed.groupBy("class").count().collect():
        demand[c - 1] = n
    # Buckets within a class are ranked on their own and then shifted; there are about as many buckets as a bucket has pieces.
    buckets = np.maximum(1, demand // max(RANKED, math.isqrt(int(demand.sum())))).tolist()
    patterns, times = plan(demand)
    rows, seen, base = [], np.zeros(len(demand), np.int64), 0
    for p, n in zip(patterns, times.tolist(), strict=True):
        slot = 0
        for w in np.flatnonzero(p):
            k = int(p[w])
            rows.append((int(w) + 1, int(seen[w]), int(seen[w]) + k * n, k, base, slot))
            seen[w] += k * n
            slot += k
        base += n
    slots = spark.createDataFrame(rows, "class int, low long, high long, each long, base long, slot0 long")
    salted = classed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.get(F.lit(buckets), F.col("class") - 1)).cast("int"))
    shift = salted.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    shift = shift.withColumn("shift", F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")).drop("n")
    order = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens", "length")
    ranked = salted.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(shift, ["class", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("shift"))
    # One row for each class of each pattern: bounded by the number of classes, whatever the input.
    placed = ranked.join(F.broadcast(slots), (ranked["class"] == slots["class"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    within = F.col("rank") - F.col("low")
    placed = placed.withColumn("sequence_id", F.col("base") + F.expr("(rank - low) div each")).withColumn("slot", F.col("slot0") + within % F.col("each"))
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot")) - F.col("length")
    return placed.withColumn("offset", offset).select(*pieces.columns, "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(written(tokenised(documents(spark, sf_dir)), "pieces"))
