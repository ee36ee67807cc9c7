"""Phrase collocations (operator 11).

A phrase is a run of 2 to 5 words within a piece of text, counted per language.
Every n-gram gets a Rabin-Karp fingerprint from prefix sums of a polynomial over
its word hashes.

1. Every task counts its fingerprints in hashed buckets; the counts add up to one
   bit a bucket, "may be frequent". The bit tables have a fixed largest size.
2. A fingerprint whose own bit and the bits of all its parts are set is compared word
   by word within a slice of text. It goes out with a second fingerprint of other
   word hashes, its count and the place of one occurrence; Spark adds up the counts.
3. The places of the frequent ones are read back from the text, and counts are added
   up by phrase: unequal phrases that share a fingerprint come apart by their words
   in a slice and by the second fingerprint over slices, and only what is frequent
   ever becomes text.

A bucket's count is no less than that of any phrase in it, so bits lose nothing; if
the corpus outgrows the tables, more passes them and the result stays the same.

Defined results: null text is empty; a null language is `und`; ids play no part, so
repeated rows count as often as they occur; texts and words may have any length;
an empty table gives an empty result; further columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import documents, grouped, lower_ascii, mix, rolling, ship, slices, text_bytes, words, written

#: Words of a phrase, at most; occurrences, at least; phrases of a language in the report.
LONGEST = 5
LEAST = 100
TOP = 2000
#: Bytes of text for each bucket, and buckets of an order, at most: 8 MB of bits.
BUCKET_BYTES = 128
MOST_BUCKETS = 1 << 26
#: Places, of about 40 bytes, that are broadcast to the texts; more are joined by a shuffle.
BROADCAST = 400_000
#: Buckets in a row, n-grams that a task holds before it sends them, rows in a batch that it sends, bytes of text
#: at once, and shares of a hot language.
_ROW = 1 << 14
_HELD = 1 << 19
_SENT = 1 << 16
_SLICE = 1 << 20
_SALT = 64

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True

_COUNTS = "k int, part int, counts binary"
_SPOT = "lang string, k int, print bigint, other bigint, n bigint, file string, row bigint, start int, length int"
_KEY = ["lang", "k", "print", "other"]
_SPOT_ARROW = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("print", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("file", pa.string()), ("row", pa.int64()), ("start", pa.int32()), ("length", pa.int32())])
#: The same within a task, which numbers languages and files; nulls are -1.
_HELD_ARROW = pa.schema([("lang", pa.int32()), ("k", pa.int8()), ("print", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("file", pa.int32()), ("row", pa.int64()), ("start", pa.int32()), ("length", pa.int32())])


class _Names(dict):
    """Numbers for strings, as they come."""

    def of(self, names: pa.Array) -> np.ndarray:
        return np.array([self.setdefault(x, len(self)) for x in names.to_pylist()], np.int32)

    def strings(self, numbers: pa.Array) -> pa.Array:
        at = numbers.to_numpy()
        return pa.array([*self], pa.string()).take(pa.array(np.where(at < 0, 0, at), mask=at < 0))


class _Slice:
    """The words of some texts, and the fingerprints of their n-grams."""

    def __init__(self, part: pa.RecordBatch | pa.Table, bits: int):
        self.part, self.bits = part, bits
        self.data, self.at = text_bytes(part.column("text"))
        self.hash, self.doc, self.first, self.last = words(part.column("text"), lower=True, ends=_ENDS)
        coded = part.column("lang")
        coded = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
        self.langs, self.lang = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        salt = np.array([_name_hash(x) for x in self.langs.to_pylist()], np.uint64)
        self.salt = salt[self.lang][self.doc] if len(self.doc) else np.zeros(0, np.uint64)
        # Pieces: what ends one lies between two words, or a text does.
        ended = np.cumsum(_ENDS[self.data], dtype=np.int32 if len(self.data) < 1 << 31 else np.int64)
        self.piece = ended[self.first] + self.doc if len(self.doc) else self.doc

    def grams(self, k: int) -> np.ndarray:
        """First words of all n-grams of k words."""
        n = len(self.hash) - k + 1
        return np.flatnonzero(self.piece[: max(0, n)] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def prints(self, k: int, first: np.ndarray) -> np.ndarray:
        found = mix(rolling(self.hash, first, first + k) ^ self.salt[first])
        return found >> np.uint64(64 - self.bits) if self.bits < 64 else found

    def same(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each word, equal for words that are equal byte for byte; and a hash of each word that owes nothing to self.hash."""
        _, place, order, begins = grouped(self.hash)
        lead = order[begins]
        raw = np.zeros(len(self.data) + 8, np.uint8)
        raw[: len(self.data)] = _lowered(self.data)
        eight = np.ndarray(len(self.data) + 1, np.uint64, raw, 0, (1,))
        size = self.last - self.first
        odd = size != size[lead[place]]
        rest, step = np.arange(len(size)), 0
        while len(rest):
            a, b, left = self.first[rest] + step, self.first[lead[place[rest]]] + step, size[rest] - step
            # A word that is longer than its lead is odd already.
            odd[rest] |= (eight[a] ^ eight[np.minimum(b, len(self.data))]) & _MASK[np.minimum(left, 8)] != 0
            step += 8
            rest = rest[(size[rest] > step) & ~odd[rest]]
        own: dict[bytes, int] = {}
        extra = []
        for i in np.flatnonzero(odd):
            key = raw[self.first[i] : self.last[i]].tobytes()
            if key not in own:
                own[key] = len(lead) + len(extra)
                extra.append(i)
            place[i] = own[key]
        lead = np.append(lead, np.array(extra, lead.dtype))
        at, left = self.first[lead], size[lead]
        other = mix(left.astype(np.uint64) + _OTHER)
        rest, step = np.arange(len(lead)), 0
        while len(rest):
            other[rest] = mix((other[rest] + (eight[at[rest] + step] & _MASK[np.minimum(left[rest] - step, 8)])) * _OTHER)
            step += 8
            rest = rest[left[rest] > step]
        return place, other[place]


_OTHER = np.uint64(0xA0761D6478BD642F)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _name_hash(name: str) -> int:
    value = np.uint64(0)
    for i, b in enumerate(name.encode()):
        value = mix(np.array([value ^ np.uint64((i + 1) * 257 + b)]))[0]
    return int(value)


def _parts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[_Slice]:
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            yield _Slice(part, bits)
            del part
        # Not kept while the next one is read, as it may hold tens of megabytes.
        del batch


def _count(buckets: int, bits: int):
    """A task's counts of fingerprints by bucket, up to 255, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((LONGEST, buckets), np.uint8)
        for part in _parts(batches, bits):
            for k in range(1, LONGEST + 1):
                at, n = np.unique((part.prints(k, part.grams(k)) & np.uint64(buckets - 1)).astype(np.uint32), return_counts=True)
                counts[k - 1, at] = np.minimum(counts[k - 1, at] + n, 255)
            del part
        for k in range(LONGEST):
            rows = counts[k].reshape(-1, min(_ROW, buckets))
            full = np.flatnonzero(rows.any(axis=1))
            blobs = [pa.compress(rows[i].tobytes(), "zstd", asbytes=True) for i in full]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), k + 1, np.int32)), pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], names=["k", "part", "counts"])

    return run


def _bits(least: int, width: int):
    """One bit for each bucket of a row: does it count to `least` over all tasks?"""

    def run(sent: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint32)
        for blob in sent.column("counts"):
            # A task's count of 255 stands for that or more.
            total = np.minimum(total + np.frombuffer(pa.decompress(blob.as_buffer(), width, "zstd"), np.uint8), 1 << 30)
        bits = np.packbits(total >= min(least, 255)).tobytes()
        return pa.table([sent.column("k")[:1], sent.column("part")[:1], pa.array([bits], pa.binary())], names=["k", "part", "counts"])

    return run


def _found(part: _Slice, tables: np.ndarray, langs: _Names, files: _Names) -> Iterator[pa.RecordBatch]:
    """A slice's n-grams that may be frequent, and for k = 0 its words by language."""
    number, other = part.same()
    before = np.ones(len(part.hash) + 1, bool)
    lang = langs.of(part.langs)
    coded = part.part.column("file").dictionary_encode()
    file = files.of(coded.dictionary)[coded.indices.to_numpy()]
    row = part.part.column("row").to_numpy()

    def rows(lang: np.ndarray, k: int, *rest) -> pa.RecordBatch:
        columns = [lang, np.full(len(lang), k), *(np.full(len(lang), x) if isinstance(x, int) else x for x in rest)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, _HELD_ARROW, strict=True)], schema=_HELD_ARROW)

    known, n = np.unique(part.lang[part.doc], return_counts=True)
    yield rows(lang[known], 0, 0, 0, n, -1, -1, -1, -1)
    for k in range(1, LONGEST + 1):
        first = part.grams(k)
        first = first[before[first] & before[first + 1]] if k > 1 else first
        prints = part.prints(k, first)
        at = (prints & np.uint64(8 * tables.shape[1] - 1)).astype(np.int64)
        may = tables[k - 1][at >> 3] >> (7 - (at & 7)) & 1 == 1
        first, prints = first[may], prints[may]
        before = np.zeros(len(part.hash) + 1, bool)
        before[first] = True
        if not len(first):
            return
        values, place, order, begins = grouped(prints)
        lead = np.minimum.reduceat(first[order], begins)
        odd = part.lang[part.doc[first]] != part.lang[part.doc[lead[place]]]
        for j in range(k):
            odd |= number[first + j] != number[lead[place] + j]
        own: dict[tuple, int] = {}
        extra = []
        for i in np.flatnonzero(odd):
            key = (int(prints[i]), int(part.lang[part.doc[first[i]]]), *number[first[i] : first[i] + k].tolist())
            if key not in own:
                own[key] = len(values) + len(extra)
                extra.append(i)
            place[i] = own[key]
        if extra:
            values, lead = np.append(values, prints[extra]), np.append(lead, first[extra])
        doc = part.doc[lead]
        counts = np.bincount(place, minlength=len(values))
        yield rows(lang[part.lang[doc]], k, values.view(np.int64), rolling(other, lead, lead + k).view(np.int64), counts, file[doc], row[doc], part.first[lead] - part.at[doc], part.last[lead + k - 1] - part.first[lead])


def _sum(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each n-gram, with the place that came first."""
    table = pa.Table.from_batches(held, _HELD_ARROW)
    summed = table.group_by(_KEY, use_threads=False).aggregate([("n", "sum"), *((c, "first") for c in ("file", "row", "start", "length"))])
    return pa.RecordBatch.from_arrays([summed.column(c).combine_chunks() for c in (*_KEY, "n_sum", "file_first", "row_first", "start_first", "length_first")], schema=_HELD_ARROW)


def _send(tables: np.ndarray, bits: int):
    """The n-grams that may be frequent: language, words, fingerprints, count and one occurrence, summed over what a task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, files = _Names(), _Names()
        held: list[pa.RecordBatch] = []

        def named(done: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, done.num_rows, _SENT):
                x = done.slice(at, _SENT)
                full = {"lang": langs.strings(x.column("lang")), "file": files.strings(x.column("file")) if files else pa.nulls(x.num_rows, pa.string())}
                yield pa.RecordBatch.from_arrays([full[f.name] if f.name in full else x.column(f.name).cast(f.type) for f in _SPOT_ARROW], schema=_SPOT_ARROW)

        for part in _parts(batches, bits):
            if len(part.hash):
                held += _found(part, tables, langs, files)
            if sum(map(len, held)) > _HELD:
                held = [_sum(held)]
                if len(held[0]) > _HELD // 2:
                    yield from named(held.pop())
            del part
        if held:
            yield from named(_sum(held))
        pa.default_memory_pool().release_unused()

    return run


def _source(docs: DataFrame) -> DataFrame:
    """lang, text and each row's place in its file; what doesn't come straight from Parquet files is written first."""
    at = lambda d: d.metadataColumn("_metadata")
    pick = lambda d: d.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), at(d)["file_path"].alias("file"), at(d)["row_index"].alias("row"))
    try:
        found = pick(docs)
        found.schema  # noqa: B018
        return found
    except AnalysisException:
        return pick(written(docs.select("lang", "text"), "phrases-input"))


def phrase_counts(docs: DataFrame, least: int = LEAST, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """All runs of 1 to 5 words with their counts, `least` or more (lang, k, phrase, f), and the words of each language (lang, n).

    bits: of a fingerprint; fewer make more collisions and the same result.
    """
    spark = docs.sparkSession
    ship(spark)
    source = _source(docs)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << 10
    while buckets < min(MOST_BUCKETS, size // BUCKET_BYTES):
        buckets *= 2
    # A task sends counts once, for all it reads: as many tasks as the cluster keeps busy, however large the corpus.
    few = source.coalesce(spark.sparkContext.defaultParallelism * 2)
    width = min(_ROW, buckets)
    rows = few.select("lang", "text").mapInArrow(_count(buckets, bits), _COUNTS).groupBy("k", "part").applyInArrow(_bits(least, width), _COUNTS).collect()
    tables = np.zeros((LONGEST, buckets // 8), np.uint8)
    for r in rows:
        tables[r["k"] - 1, r["part"] * width // 8 : (r["part"] + 1) * width // 8] = np.frombuffer(r["counts"], np.uint8)
    shared = spark.sparkContext.broadcast(tables)
    spots = written(few.mapInArrow(lambda batches: _send(shared.value, bits)(batches), _SPOT), "phrases")
    totals = spots.where("k = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    # A fingerprint's count is no less than that of any phrase that has it.
    often = spots.where("k > 0").groupBy(*_KEY).agg(F.sum("n").alias("n"), F.min(F.struct("file", "row", "start", "length")).alias("at")).where(F.col("n") >= least)
    # A text has fewer places than words times five.
    places = written(often.select("lang", "k", "n", "at.*").groupBy("file", "row").agg(F.collect_list(F.struct("lang", "k", "n", "start", "length")).alias("spots")), "phrase-places")
    texts = source.select("file", "row", lower_ascii(F.col("text")).cast("binary").alias("raw"))
    read = lambda x: F.struct(x["lang"].alias("lang"), x["k"].alias("k"), x["n"].alias("n"), F.regexp_replace(F.substring(F.col("raw"), x["start"] + 1, x["length"]).cast("string"), "[ \t]+", " ").alias("phrase"))
    # One place a phrase: mostly few beside the texts, which then needn't be shuffled.
    few_places = (places.agg(F.sum(F.size("spots"))).first()[0] or 0) <= BROADCAST
    found = (F.broadcast(places) if few_places else places).join(texts, ["file", "row"]).select(F.explode(F.transform("spots", read)).alias("s")).select("s.*")
    counts = found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return written(counts, "phrase-counts"), totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, absorb: int = 100, bits: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases whose weakest cut holds best.

    A phrase goes if a longer candidate that contains it occurs at least `absorb` percent as often.
    """
    counts, totals = phrase_counts(docs, least, bits)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    of = lambda low, high: F.array_join(F.slice("words", low, high), " ")
    candidates = counts.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("words"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select("lang", "phrase", "a", "cut", of(F.lit(1), F.col("cut")).alias("left"), of(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) * 1000BD) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst")).select("lang", "phrase", "a", "n", "worst.*")
    # Every shorter run inside a candidate, with the largest count of what contains it.
    runs = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    inner = candidates.where("k > 2").select("lang", "a", F.explode(runs).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    held = scored.join(inner, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.lit(100) * wide("around") < F.lit(absorb) * wide("a")))
    down = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First by shares of a language, as one may hold nearly all phrases.
    salted = held.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(_SALT)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*down))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*down)).cast("long")).where(F.col("rank") <= top)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT row, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), t AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) AS o(k))
), c AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
), cand AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE k > 1
), cuts AS (
  SELECT lang, phrase, k, a, ws, unnest(range(1, k)) AS cut FROM cand
), s AS (
  SELECT cuts.lang, cuts.phrase, a, cut, l.f AS l, r.f AS r, n, CAST((CAST(a AS HUGEINT) * n * 1000) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts JOIN c l ON l.lang = cuts.lang AND l.phrase = array_to_string(cuts.ws[1 : cut], ' ')
  JOIN c r ON r.lang = cuts.lang AND r.phrase = array_to_string(cuts.ws[cut + 1 : cuts.k], ' ') JOIN t ON t.lang = cuts.lang
), worst AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), around AS (
  SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, ws, a, k, m, unnest(range(1, k - m + 2)) AS i FROM cand, range(2, 5) AS o(m) WHERE m < k) GROUP BY ALL
)
SELECT * FROM (
  SELECT worst.lang, row_number() OVER (PARTITION BY worst.lang ORDER BY score DESC, a DESC, worst.phrase) AS rank, worst.phrase, a, l, r, n, score
  FROM worst LEFT JOIN around ON around.lang = worst.lang AND around.phrase = worst.phrase WHERE most IS NULL OR 100 * most < 100 * a
) WHERE rank <= 2000
"""
