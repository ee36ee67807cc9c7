"""Shared pieces of the training-data operators."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern `[^\x20\x09-\x0D]+`.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_fallback: dict[str, str] = {}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application, give the executors this package, which they may not have on their path."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parents[2]
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='auditlake-')}/auditlake", "zip", root, "auditlake"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset in local mode, as in tests, one of our own."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _fallback.setdefault(app, tempfile.mkdtemp(prefix="auditlake-"))
    return base.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in the shared folder: cuts lineage and survives lost executors."""
    ship(df.sparkSession)
    path = table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(col: Column) -> Column:
    """A-Z to lower case, everything else unchanged; null counts as empty."""
    text = F.coalesce(col, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(col: str, hold: int) -> Column:
    """crc32 of the id as text, modulo hold: what learns and what is held out."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % hold


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_resident: dict[object, object] = {}


def resident(key: object = None, make: Callable[[], object] | None = None) -> object:
    """What all tasks of a Python worker share, made once; without arguments nothing.

    Workers outlive their stage, and an executor deals its tasks to all it has. So a
    worker holds what was asked for last and nothing of an earlier stage.
    """
    if key not in _resident:
        _resident.clear()
        if make:
            _resident[key] = make()
    return _resident.get(key)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        m = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inverse)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def rolling(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of values[start:stop] for every pair, by prefix sums modulo 2^64, then mixed with its length."""
    n = len(values)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (sorting is many times faster here than hashing)."""
    ranked = np.sort(values)
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return ranked[new]


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, each value's place among them, an order that sorts, and where each distinct value begins in it."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place, order, np.flatnonzero(new)


_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def words(column: pa.Array, lower: bool = False, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of every text: (64-bit hash, document index, first byte, past the last byte). ends: bytes that end words as well."""
    data, at = text_bytes(column)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    solid = ~(_SPACE if ends is None else _SPACE | ends)[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid
    ends[:-1] &= ~solid[1:] | edge[1:n]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    doc = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(first, at)))
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _LOWER[data] if lower else data
    # Eight bytes from any position.
    eight = np.ndarray(n + 1, np.uint64, padded, 0, (1,))
    left = last - first
    h = mix((eight[first] & _MASK[np.minimum(left, 8)]) * _BASE + left.astype(np.uint64))
    rest, step = np.flatnonzero(left > 8), 8
    while len(rest):
        h[rest] = mix(h[rest] ^ (eight[first[rest] + step] & _MASK[np.minimum(left[rest] - step, 8)]) * _BASE)
        step += 8
        rest = rest[left[rest] > step]
    return h, doc, first, last


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of size consecutive words of one document."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return rolling(hashes, first, first + size), first


def slices(table: pa.RecordBatch | pa.Table, text: str, most: int = 4 << 20):
    """Parts of a batch whose texts have about `most` bytes together; a longer text is a part of its own."""
    _, at = text_bytes(table.column(text))
    lo = 0
    while lo < table.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield table.slice(lo, hi - lo)
        lo = hi
