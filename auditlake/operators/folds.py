"""Folds over the rows of a key in order, as streams over sorted partitions: a key may have any number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from auditlake.sources.tables import ship


def in_order(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """fold over partitions that hold whole keys, sorted by key and order. It sees each batch once and keeps what it must of the key at hand."""
    ship(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, schema)
