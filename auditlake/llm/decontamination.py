"""Benchmark decontamination by joins on rare word pairs and Smith-Waterman alignment (operator 6).

A pair of a document and an item counts if the best local alignment of an item of n
words reaches `least` of the score of the item aligned with itself. An alignment that
does has at least need = n * least - 1 matched words whose next matched word follows
after one error at most, so both are one or two words apart in the item and in the
text; all of them lie within reach = n * (3 - 2 * least) words of the text. An item has
n - 1 words that begin such pairs, so any n - 1 - need + t of them hold t that the
alignment matches, whatever was edited. The rarest of that number, by how often their
word pairs occur in all documents, are the item's seeds; t is `TOGETHER`, or need where
that is less. Places of the documents that meet a seed are joined to the items; regions
around t of them within reach that hold enough of all the item's word pairs are aligned
word by word. No pair is lost to the search.

The documents are read three times: to count the pairs, to find the seeds' places, and
for the texts of what was found, which alone are shuffled. Tasks know the pairs sought by a bit of their hash: the
bits have a constant size however large the benchmark is, and the joins are exact.

Defined results: null texts and texts without words match nothing, nor do items
of fewer than `SHORTEST` words; repeated rows give one row for each document id and
item, the best; a text of any length is searched as a whole, and what is aligned is as
long as the regions that hold enough pairs; a null id is kept as one; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import distinct, documents, grouped, mix, resident, slices, unused, words, written

SHORTEST = 5
LEAST = 0.5
MATCH, MISS, GAP = 2, -1, 1
#: Seeds that must lie together for a region to be looked at.
TOGETHER = 4
#: Bits by which tasks know the pairs sought: 4 MB.
FILTER_BITS = 1 << 25
_STEP = np.uint64(0xD6E8FEB86659FD93)

_FOUND = "doc_id bigint, item_id bigint, seeds bigint, score double"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            h, doc, _, _ = words(part.column("text"), lower=True)
            at = np.searchsorted(doc, np.arange(part.num_rows + 1))
            said = pa.array([h[at[i] : at[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("item"), part.column("item_id"), said], ["item", "item_id", "words"])


def _pairs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every two words of one document that are one or two words apart."""
    first = [np.flatnonzero(doc[:-d] == doc[d:]) for d in (1, 2)]
    return np.concatenate([mix(h[f] * _STEP + h[f + d]) for d, f in zip((1, 2), first, strict=True)]), np.concatenate(first)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word pairs of items and the word that each begins with."""
    for batch in batches:
        for item, said in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist(), strict=True):
            h = np.frombuffer(said, np.uint64)
            pair, at = _pairs(h, np.zeros(len(h), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), item)), pa.array(at), pa.array(pair.view(np.int64))], ["item", "at", "pair"])


def _bits(keys: DataFrame) -> np.ndarray:
    """A bit for each hash class that holds a key (one column); at most FILTER_BITS / 64 rows come to the driver."""
    named = keys.toDF("key")
    rows = named.groupBy(F.expr(f"shiftright(key & {FILTER_BITS - 1}L, 6)").alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 AS int)))").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[rows.column("k").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bits


def _set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(FILTER_BITS - 1)
    return bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)


def _sought(bits: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(slice, pair, document of the slice, first word in it) of what may be among the pairs sought."""
    resident()
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            h, doc, _, _ = words(part.column("text"), lower=True)
            pair, at = _pairs(h, doc)
            hit = np.flatnonzero(_set(bits, pair))
            own = doc[at[hit]]
            yield part, pair[hit], own, at[hit] - np.searchsorted(doc, own)


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pair, _, _ in _sought(shared.value, batches):
            values, _, _, first = grouped(pair)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.diff(np.append(first, len(pair))))], ["pair", "n"])

    return run


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pair, own, at in _sought(shared.value, batches):
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), part.column("row").take(pa.array(own)), pa.array(at)], ["pair", "row", "at"])

    return run


def _keep(shared):
    """The rows whose key may be among those sought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_set(shared.value, batch.column("row").to_numpy().view(np.uint64)).astype(bool)))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of every region, one document at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            h, _, _, _ = words(batch.column("text").slice(i, 1), lower=True)
            regions = batch.column("regions").slice(i, 1).flatten()
            item, lo, hi = (regions.field(k) for k in range(3))
            lo, hi = np.maximum(lo.to_numpy(), 0), np.minimum(hi.to_numpy(), len(h))
            for a in range(0, len(item), 256):
                part = slice(a, a + 256)
                said = pa.array([h[x:y].tobytes() for x, y in zip(lo[part], hi[part], strict=True)], pa.binary())
                ids = pa.array([batch.column("doc_id")[i].as_py()] * len(said), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, item.slice(a, 256), said], ["doc_id", "item", "said"])


def align(item: np.ndarray, text: np.ndarray) -> int:
    """The best Smith-Waterman score of two word sequences, with linear gap costs."""
    best, row = 0, np.zeros(len(text) + 1, np.int64)
    slope = np.arange(len(text) + 1) * GAP
    for w in item:
        new = np.zeros(len(text) + 1, np.int64)
        np.maximum(row[:-1] + np.where(text == w, MATCH, MISS), row[1:] - GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        # Gaps within the row: the largest earlier value less the way from there.
        row = np.maximum.accumulate(new + slope) - slope
        best = max(best, int(row.max()))
    return best


def need(n: int, least: float) -> int:
    """Word pairs that an alignment of an item of n words must have."""
    return max(1, math.ceil(n * least - 1 - 1e-9))


def reach(n: int, least: float) -> int:
    """Words of the text that hold such an alignment."""
    return max(n, math.ceil(n * (3 - 2 * least)))


def best_match(item: np.ndarray, text: np.ndarray, least: float) -> tuple[int, float]:
    """(places of the item's pairs met, score) of the best part of a text that holds enough pairs to be aligned; (0, 0) without one."""
    n, far = need(len(item), least), reach(len(item), least)
    pair, place = _pairs(item, np.zeros(len(item), np.int64))
    met, at = _pairs(text, np.zeros(len(text), np.int64))
    hit = np.isin(met, pair)
    met, at = met[hit], at[hit]
    once = distinct(at)
    if len(once) < n:
        return 0, 0.0
    begin, end = once[: len(once) - n + 1], once[n - 1 :]
    begin = begin[end - begin < far]
    if not len(begin):
        return 0, 0.0
    lo, hi = np.maximum(begin - far, 0), np.minimum(begin + far + 1, len(text))
    edges = np.append(np.flatnonzero(np.append(True, lo[1:] > hi[:-1])), len(begin))
    best = (0, 0.0)
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        a, b = lo[x], hi[y - 1]
        seeds = len(np.unique(place[np.isin(pair, met[(at >= a) & (at < b)])]))
        if seeds >= n:
            best = max(best, (seeds, align(item, text[a:b]) / (MATCH * len(item))), key=lambda found: found[::-1])
    return best


def _score(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in zip(*(batch.column(c) for c in ("doc_id", "item_id", "words", "said")), strict=True):
                doc_id, item_id, item, said = (v.as_py() for v in r)
                seeds, score = best_match(np.frombuffer(item, np.uint64), np.frombuffer(said, np.uint64), least)
                if score >= least:
                    out.append({"doc_id": doc_id, "item_id": item_id, "seeds": seeds, "score": score})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("seeds", pa.int64()), ("score", pa.float64())]))

    return run


def rare_seeds(source: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """pair, item, reach, t: of each item the rarest pairs; every alignment reaching `least` holds t of them within reach."""
    n = (F.octet_length("words") / 8).cast("long")
    places = written(items.select("item", "words").mapInArrow(_places, "item bigint, at bigint, pair bigint"), "item-pairs")
    shared = source.sparkSession.sparkContext.broadcast(_bits(places.select("pair")))
    often = written(source.select("text").mapInArrow(_count(shared), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    shared.destroy()
    begun = places.join(often, "pair", "left").groupBy("item", "at").agg(F.sum(F.coalesce("n", F.lit(0))).alias("often"), F.collect_set("pair").alias("pairs"))
    ranked = begun.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("often", "at")))
    sizes = items.select("item", n.alias("n"), F.greatest(F.lit(1), F.ceil(n * least - 1 - 1e-9)).alias("need"), F.greatest(n, F.ceil(n * (3 - 2 * least))).alias("reach"))
    rare = ranked.join(sizes.withColumn("t", F.least("need", F.lit(TOGETHER))), "item").where("rank <= n - 1 - need + t")
    return written(rare.select(F.explode("pairs").alias("pair"), "item", "reach", "t").distinct(), "rare-seeds")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, seeds (places of the item's word pairs met), score (0 to 1) of every pair that reaches `least`, which is above 0.2."""
    spark = docs.sparkSession
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("item", F.xxhash64("item_id", "text"))
    items = written(named.mapInArrow(_items, "item bigint, item_id bigint, words binary").where(F.octet_length("words") >= 8 * SHORTEST).dropDuplicates(["item"]), "items")
    # Equal rows share a key, so a region of one is a region of each.
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    seeds = rare_seeds(source, items, least)
    shared = spark.sparkContext.broadcast(_bits(seeds.select("pair")))
    hits = source.select("row", "text").mapInArrow(_find(shared), "pair bigint, row bigint, at bigint")
    met = hits.join(seeds, "pair").select("row", "item", "reach", "t", "at").distinct()
    along = Window.partitionBy("row", "item").orderBy("at")
    # The last of t places from here on; regions begin where t places lie within reach.
    last = F.coalesce(*(F.when(F.col("t") == k + 1, F.lead("at", k).over(along) if k else F.col("at")) for k in range(TOGETHER)))
    dense = met.withColumn("last", last).where(F.col("last") - F.col("at") < F.col("reach"))
    apart = F.coalesce(F.col("at") - F.lag("at").over(along) > 2 * F.col("reach"), F.lit(True))
    parts = dense.withColumn("apart", apart.cast("int")).withColumn("part", F.sum("apart").over(along)).groupBy("row", "item", "part")
    regions = parts.agg(F.min(F.col("at") - F.col("reach")).alias("lo"), F.max(F.col("at") + F.col("reach") + 1).alias("hi"))
    # Regions are fewer than the words of their text times the items that share seeds.
    of_row = written(regions.groupBy("row").agg(F.collect_list(F.struct("item", "lo", "hi")).alias("regions")), "regions")
    shared.destroy()
    shared = spark.sparkContext.broadcast(_bits(of_row.select("row")))
    # Each step in Python is written: joins by broadcast would put all three into one stage, and every task would hold three workers.
    texts = written(source.mapInArrow(_keep(shared), "doc_id bigint, text string, row bigint"), "texts")
    shared.destroy()
    said = written(texts.join(of_row, "row").select("doc_id", "text", "regions").mapInArrow(_cut, "doc_id bigint, item bigint, said binary"), "said")
    scored = written(said.join(items, "item").select("doc_id", "item_id", "words", "said").mapInArrow(_score(least), _FOUND), "contaminated")
    return scored.groupBy("doc_id", "item_id").agg(F.max("seeds").alias("seeds"), F.max("score").alias("score"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item; all columns stay as they are."""
    found = unused("found", docs)
    ids = contaminated(docs, benchmark).select(F.col("doc_id").alias(found)).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(found)), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
