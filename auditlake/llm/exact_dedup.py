"""Exact de-duplication by a stateful stream (operator 7, native).

Every row becomes (digest, id, locator). A stream keyed by the digest keeps, in a
disk-backed RocksDB state that never expires, the largest id, its locator and
the number of rows. Whatever hits a key that another row has is checked in its call,
byte for byte, against the text at the key's locator.

With `state_dir`, rows, state and results stay in that folder: a later call reads
its own rows alone and meets the keys of all earlier ones. The state also keeps which
rows it has counted, by file, time of change and place in the file. So a call that is
repeated, overlaps another one or takes up one that was cut off at any point counts
no row twice. Rows that don't come straight from Parquet files have no lasting place
and are new in every call.

Defined results: null text is empty text; a null id counts as smaller than any
id; of rows with the same id and text the one with the greatest locator stays;
a text of any length is a digest and is compared only on a hit; an empty table
gives an empty result; further columns are passed by, whatever their names. A
digest shared by unequal texts raises an error instead of dropping a text.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import documents, lower_ascii, table_path, unused, written

#: Disk-backed state; changes are checkpointed as logs, and no file is allocated ahead, as there are many small stores.
#: A call has one batch, so a store is closed with its task, or each would keep its memory until long after the call;
#: those open at once share 128 MB an executor.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


_ROWS = "doc_id bigint, digest string, locator string, version string, call string"
_GROUPS = "digest string, keep struct<doc_id: bigint, locator: string>, group_size bigint, batch int"


def _where(docs: DataFrame) -> Column:
    at = docs.metadataColumn("_metadata")
    return F.concat_ws("#", at["file_path"], at["row_index"].cast("string"))


def _located(docs: DataFrame) -> tuple[DataFrame, Column]:
    """The documents and their locators; rows that don't come straight from Parquet files are written first."""
    try:
        docs.select(_where(docs)).schema  # noqa: B018
    except AnalysisException:
        docs = written(docs, "located")
    return docs, _where(docs)


def _fold(spark: SparkSession, base: str) -> DataFrame:
    """digest, keep (id, locator) and group_size of every key in the state, after the rows not read yet."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/groups/batch={number}")

    # A session of its own, so that no other query sees the store's settings.
    own = spark.newSession()
    for k, v in (_STATE | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
        own.conf.set(k, v)
    stream = own.readStream.schema(_ROWS).parquet(f"{base}/rows").dropDuplicates(["locator", "version"])
    state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    state.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    try:
        seen = spark.read.schema(_GROUPS).parquet(f"{base}/groups")
    except AnalysisException:
        return spark.createDataFrame([], _GROUPS).drop("batch")
    # A key is written once for each batch that touched it; the last one holds its whole group.
    return seen.groupBy("digest").agg(F.max_by("keep", "batch").alias("keep"), F.max("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None) -> DataFrame:
    """One row per input row: doc_id, locator, digest, keep_id, group_size, kept; groups reach over all calls with one state_dir."""
    spark = docs.sparkSession
    docs, where = _located(docs)
    base = state_dir or table_path(spark, "dedup")
    call = uuid4().hex
    version = docs.metadataColumn("_metadata")["file_modification_time"].cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(lower_ascii(F.col(text_col)).cast("binary"), 256).alias("digest"), where.alias("locator"), version.alias("version"), F.lit(call).alias("call"))
    rows.write.mode("append").parquet(f"{base}/rows")
    every = spark.read.schema(_ROWS).parquet(f"{base}/rows")
    mine = every.where(F.col("call") == call)
    texts = docs.select(where.alias("locator"), lower_ascii(F.col(text_col)).alias("norm"))
    state = written(_fold(spark, base), "dedup-groups")
    _verify(state.where("group_size > 1"), mine, texts, text_col)
    joined = mine.join(state, "digest")
    return joined.select("doc_id", "locator", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("keep.locator")).alias("kept"))


def _verify(hits: DataFrame, rows: DataFrame, texts: DataFrame, text_col: str) -> None:
    """Compare the whole text of every row of the hit groups with the text that its group keeps."""
    spark = hits.sparkSession
    wanted = rows.join(hits.select("digest", F.col("keep.locator").alias("kept_at")), "digest").select("digest", "locator", "kept_at")
    found = written(texts.join(wanted, "locator"), "dedup-hits")
    kept = found.where("locator = kept_at").select("digest", F.col("norm").alias("kept_norm"))
    others = found.where("locator <> kept_at").select("digest", "norm")
    # What an earlier call keeps is read from its own file.
    old = others.select("digest").distinct().join(kept.select("digest"), "digest", "left_anti").join(hits, "digest").select("digest", F.col("keep.locator").alias("locator"))
    files = [r[0] for r in old.select(F.substring_index("locator", "#", 1)).distinct().collect()]
    if files:
        source = spark.read.parquet(*files)
        kept = kept.union(source.select(_where(source).alias("locator"), lower_ascii(F.col(text_col)).alias("kept_norm")).join(old, "locator").select("digest", "kept_norm"))
    if others.join(kept, "digest").where("norm <> kept_norm").limit(1).count():
        raise ValueError("two different texts share a digest")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without exact copies; all columns stay as they are."""
    docs, where = _located(docs)
    gone, mark = unused("gone", docs), unused("mark", docs)
    copies = exact_dedup(docs).where("not kept").select(F.col("locator").alias(gone))
    return docs.withColumn(mark, where).join(copies, F.col(mark) == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("kept")).alias("kept"), F.col("digest").alias("text_sha256"))


ORACLE_OP7 = """
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""
