"""Append-only logs as a stream: what was appended to a file since the last batch, from a byte mark a file."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

#: Bytes of a file that one task reads, and lines in a batch of rows.
RANGE = 64 << 20
ROWS = 10_000
_BLOCK = 1 << 16


@dataclass
class _Range(InputPartition):
    """Lines that begin from `begin` on and before `end`; `first` is the mark of the last batch, where a line begins."""

    name: str
    first: int
    begin: int
    end: int


class AppendLog(DataSource):
    """The lines of the files in a folder (value, file_name), each line once.

    An offset holds a byte mark for each file: the end of its last whole line. Lines appended to a file that was read before
    are read alone; a line that isn't ended yet waits. The checkpoint keeps the marks, so a restart repeats nothing, and a
    batch that failed is read again from the same marks. Files are append-only: what is cut from one isn't noticed.

    Options: `path`, a folder in a file system that pyarrow opens (local, HDFS, S3, GCS); `rangeBytes`, the most for a task;
    `json`: a last line that is a whole JSON object needs no end, as no part of one is an object.
    Hidden files and those that begin with an underscore are left out, as in Spark's own file sources.
    """

    @classmethod
    def name(cls) -> str:
        return "append_log"

    def schema(self) -> str:
        return "value string, file_name string"

    def streamReader(self, schema) -> _AppendReader:
        return _AppendReader(self.options["path"], int(self.options.get("rangeBytes", RANGE)), self.options.get("json", "false") == "true")


class _AppendReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int, objects: bool = False):
        self.path, self.most, self.objects = path, most, objects
        self.marks: dict[str, tuple[int, int]] = {}

    def _open(self) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.path)
        return system, base.rstrip("/")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, base = self._open()
        found = {}
        for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            name = info.path[len(base) :].lstrip("/")
            if info.type != fs.FileType.File or any(p[:1] in "._" for p in name.split("/")):
                continue
            if self.marks.get(name, (-1, 0))[0] != info.size:
                self.marks[name] = info.size, _last_end(system, info.path, info.size, self.objects)
            found[name] = self.marks[name][1]
        return found

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return [_Range(name, first, a, min(a + self.most, stop)) for name, stop in sorted(end.items()) for first in [start.get(name, 0)] for a in range(first, stop, self.most)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, base = self._open()
        lines: list[str] = []
        with io.BufferedReader(system.open_input_file(f"{base}/{partition.name}"), 1 << 20) as f:
            at = partition.begin
            if at > partition.first:
                # A line that began before belongs to the range before.
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                at += len(line)
                lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                if len(lines) == ROWS:
                    yield _batch(lines, partition.name)
                    lines = []
        if lines:
            yield _batch(lines, partition.name)


def _batch(lines: list[str], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([name.rsplit("/", 1)[-1]] * len(lines), pa.string())], names=["value", "file_name"])


def _last_end(system: fs.FileSystem, path: str, size: int, objects: bool) -> int:
    """Past the last whole line before `size`, found from behind."""
    end, at = 0, size
    with system.open_input_file(path) as f:
        while at > 0 and not end:
            begin = max(0, at - _BLOCK)
            f.seek(begin)
            last = f.read(at - begin).rfind(b"\n")
            end, at = begin + last + 1 if last >= 0 else 0, begin
        if objects and end < size:
            f.seek(end)
            if _is_object(f.read(size - end)):
                return size
    return end


def _is_object(line: bytes) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def drain(writer: DataStreamWriter) -> StreamingQuery:
    """Runs a stream over all that is there now, what an earlier run left undone first, and ends it.

    availableNow would end after a repeated batch: to Spark a source in Python has no end of its own.
    """
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query
