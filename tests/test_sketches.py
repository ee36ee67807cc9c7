"""Summaries of days: error bounds, days that are replaced, late rows that are counted."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from auditlake.operators import sketches as K
from auditlake.sources.tail import drain
from auditlake.streaming import streams as X
from tests.test_tail import add, line


def test_quantiles_are_within_their_bound(spark):
    pick = random.Random(4)
    rows = [(f"2024-01-{d:02}", pick.choice("xy"), int(pick.lognormvariate(6, 2)), f"s{pick.randint(0, 3000)}") for d in range(1, 31) for _ in range(600)]
    df = spark.createDataFrame(rows, "day string, rule string, latency_ms int, session_id string")
    days = K.summarise_days(df, ["rule"])
    assert days.count() == 60
    for r in K.over_days(days, ["rule"], {"p50": 50, "p95": 95, "p100": 100}).collect():
        own = sorted(v for _, rule, v, _ in rows if rule == r.rule)
        n = len(own)
        for name, q in (("p50", 50), ("p95", 95), ("p100", 100)):
            exact = own[min(n * q // 100, n - 1)]
            assert exact * (1 - 2 ** -(K.BITS - 1)) < r[name] <= exact or exact < 2**K.BITS and r[name] == exact
        distinct = len({s for _, rule, _, s in rows if rule == r.rule})
        assert r.n == n and abs(r.who - distinct) <= 3 * 1.04 / 64 * distinct


def test_stored_days_are_replaced_and_pruned(spark, tmp_path):
    path = str(tmp_path / "days")
    day = lambda d, n: spark.range(n).select(F.lit(d).alias("day"), F.lit("r").alias("rule"), F.lit(None).cast("int").alias("latency_ms"), F.lit("s").alias("session_id"))
    K.store_days(K.summarise_days(day("2024-01-01", 5).unionByName(day("2024-01-02", 7)), ["rule"]), path)
    K.store_days(K.summarise_days(day("2024-01-02", 9), ["rule"]), path)
    whole = K.over_days(K.read_days(spark, path, "2024-01-01", "2024-01-31"), ["rule"]).first()
    assert (whole.n, whole.p50, whole.who) == (14, None, 1)
    assert K.over_days(K.read_days(spark, path, "2024-01-02", "2024-01-02"), ["rule"]).first().n == 9


def test_late_rows_correct_their_day(spark, tmp_path):
    from auditlake.sources import audit as A

    log, path = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    run = lambda: drain(X.count_days(A.stream_audit(spark, str(log)), path).option("checkpointLocation", str(tmp_path / "mark")))
    counts = lambda: {str(r.day): (r.n, r.late) for r in X.counted_days(spark, path).collect()}
    add(log / "a.jsonl", line(1, "2024-01-01") + line(2, "2024-01-01"))
    run()
    add(log / "a.jsonl", line(1, "2024-01-03"))
    run()
    # Two days behind: a watermark of an hour would have dropped it.
    add(log / "a.jsonl", line(3, "2024-01-01") + line(4, "2024-01-03"))
    run()
    assert counts() == {"2024-01-01": (3, 1), "2024-01-03": (2, 0)}
    assert [r.target for r in spark.read.parquet(f"{path}/late").collect()] == ["3"]


def test_sessions_are_counted_without_a_sketch_for_each(spark, capsys):
    """Spark gave every session of one aggregate a sketch of some kilobytes."""
    found = entry.queries()["a21_sessions"](spark, "/root/testdata/sf0.001")
    assert found.collect()[0].close
    found.explain()
    assert "Expand" not in capsys.readouterr().out
