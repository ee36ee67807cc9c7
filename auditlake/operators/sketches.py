"""Summaries of days that merge: what any span of days needs is read from one row a day and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A histogram keeps this many leading bits of a value: it is off by less than 1 in 2 ** (BITS - 1), downwards.
BITS = 7
#: log2 of the registers of a distinct count; its standard error is about 1.04 / sqrt(2 ** PRECISION).
PRECISION = 12


def bucket(value: Column) -> Column:
    """The largest number up to a whole value of 0 or more that has BITS leading bits and zeros after them."""
    v = F.greatest(value.cast("long"), F.lit(0).cast("long"))
    spare = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    unit = F.pow(F.lit(2.0), spare).cast("long")
    return F.when(value.isNotNull(), v - F.pmod(v, unit))


def summarise_days(df: DataFrame, dims: list[str], value: str = "latency_ms", who: str = "session_id") -> DataFrame:
    """One row for each day and key: day, dims, n, values (bucket to count) and who (a sketch of distinct ones). df: day, dims, value, who.

    A histogram has at most 2 ** (BITS - 1) buckets for each doubling of the value, however many rows there are.
    """
    keys = ["day", *dims]
    # Two steps, so that no group's rows are gathered: by bucket first.
    cells = df.groupBy(*keys, bucket(F.col(value)).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.hll_sketch_agg(who, PRECISION).alias("_who"))
    entry = F.when(F.col("_b").isNotNull(), F.struct("_b", "_n"))
    return cells.groupBy(*keys).agg(F.sum("_n").alias("n"), F.map_from_entries(F.collect_list(entry)).alias("values"), F.hll_union_agg("_who").alias("who"))


def store_days(summaries: DataFrame, path: str) -> None:
    """Days replace what was stored of them; others stay."""
    summaries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The stored rows of a span; its days' folders alone are read."""
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("string")).where(F.col("day").between(first, last))


def over_days(summaries: DataFrame, dims: list[str], quantiles: dict[str, int] | None = None) -> DataFrame:
    """dims, n, a nearest-rank quantile of the value for each name (in percent; p50 and p95 by default), and an estimate of the distinct ones."""
    quantiles = quantiles or {"p50": 50, "p95": 95}
    totals = summaries.groupBy(*dims).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("who")).alias("who"))
    cells = summaries.select(*dims, F.explode("values").alias("_b", "_n")).groupBy(*dims, "_b").agg(F.sum("_n").alias("_n"))
    ranked = cells.withColumn("_to", F.sum("_n").over(Window.partitionBy(*dims).orderBy("_b"))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*dims)))
    place = lambda q: F.least(F.expr(f"_all * {q} div 100"), F.col("_all") - 1)
    found = ranked.groupBy(*dims).agg(*(F.min(F.when(F.col("_to") > place(q), F.col("_b"))).alias(name) for name, q in quantiles.items()))
    same = [totals[d].eqNullSafe(found[d]) for d in dims]
    both = totals.join(found, same, "left") if dims else totals.crossJoin(found)
    return both.select(*(totals[d] for d in dims), "n", *quantiles, "who")
