"""Logs that grow while they are streamed."""

import json

from pyspark.sql import functions as F

from auditlake.sources import audit as A
from auditlake.sources import sinks as K
from auditlake.sources.tail import _AppendReader, drain
from auditlake.streaming import streams as X


def line(n, day="2024-01-01"):
    return json.dumps({"v": 1, "kind": "event", "ts": f"{day}T00:00:{n % 60:02d}Z", "target": str(n)}) + "\n"


def add(path, text):
    with open(path, "a", encoding="utf-8") as f:
        f.write(text)


def lake(spark, path):
    return sorted(int(r.target) for r in spark.read.parquet(str(path)).collect())


def test_appended_lines_arrive_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    run = lambda: X.start_ingest(spark, str(log), str(tmp_path / "lake"), str(tmp_path / "mark")).awaitTermination()
    add(log / "2024-01-01.jsonl", line(0))
    run()
    assert lake(spark, tmp_path / "lake") == [0]
    # Two whole lines more, one that isn't ended, and a file of the next day.
    add(log / "2024-01-01.jsonl", line(1) + line(2) + line(3)[:20])
    add(log / "2024-01-02.jsonl", line(4, "2024-01-02"))
    add(log / "_ignored", line(9))
    run()
    run()
    assert lake(spark, tmp_path / "lake") == [0, 1, 2, 4]
    add(log / "2024-01-01.jsonl", line(3)[20:])
    run()
    assert lake(spark, tmp_path / "lake") == [0, 1, 2, 3, 4]


def test_pending_export_sends_what_was_appended(spark, tmp_path):
    log, mark = tmp_path / "log", str(tmp_path / "mark")
    log.mkdir()
    cfg = {"type": "file", "path": str(tmp_path / "out")}
    add(log / "2024-01-01.jsonl", line(0))
    assert K.export_pending(spark, str(log), cfg, mark).first().sent == 1
    add(log / "2024-01-01.jsonl", line(1) + line(2))
    # What failed goes out with the next run, and what comes meanwhile as well.
    (tmp_path / "blocked").write_text("a file")
    assert not K.export_pending(spark, str(log), {"type": "file", "path": str(tmp_path / "blocked")}, mark).first().ok
    add(log / "2024-01-01.jsonl", line(3))
    assert K.export_pending(spark, str(log), cfg, mark).first().sent == 3
    assert K.export_pending(spark, str(log), cfg, mark).first().sent == 0
    assert sorted(r.target for r in spark.read.json(str(tmp_path / "out")).select("target").collect()) == ["0", "1", "2", "3"]


def test_export_stream_after_an_append(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    for n in range(3):
        add(log / "2024-01-01.jsonl", line(n))
        X.export_stream(spark, str(log), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_ranges_share_out_every_line_once(tmp_path):
    """Ranges of any size, lines longer than a range, blank lines and line ends of two bytes."""
    text = "".join("x" * (n % 7 * 5) + ("\r\n" if n % 3 else "\n") for n in range(60)) + "é" * 40 + "\ncut"
    (tmp_path / "a.jsonl").write_bytes(text.encode())
    want = text.replace("\r", "").split("\n")[:-1]
    for most in (1, 3, 17, 1 << 20):
        reader = _AppendReader(str(tmp_path), most)
        end = reader.latestOffset()
        parts = reader.partitions({}, end)
        got = [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()]
        assert got == want and end == {"a.jsonl": len(text.encode()) - 3}
        half = {"a.jsonl": text.encode().index(b"\n", 200) + 1}
        first = [v for p in reader.partitions({}, half) for b in reader.read(p) for v in b.column("value").to_pylist()]
        rest = [v for p in reader.partitions(half, end) for b in reader.read(p) for v in b.column("value").to_pylist()]
        assert first + rest == want


def test_stream_equals_batch(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    add(log / "2024-01-01.jsonl", "".join(line(n) for n in range(500)) + "broken\n\n")
    out = []
    drain(A.stream_audit(spark, str(log), 300).writeStream.option("checkpointLocation", str(tmp_path / "mark")).foreachBatch(lambda b, n: out.extend(b.select("target").collect())))
    assert sorted(int(r.target) for r in out) == sorted(int(r.target) for r in A.read_audit(spark, str(log)).select(F.col("target")).collect())
