"""A stream of the lines that are appended to the files of a directory.

The offset of a query is a map of file to how far it has been read: a byte behind a line's end, and checksums of the
file's first bytes. Bytes behind the last line's end are not counted in, so an unfinished line waits in its file until
its end is written, however many appends that takes. A file that has become shorter, or whose first bytes are others,
has begun anew and is read from byte 0. That is told from two offsets alone: nothing else is kept, so a query that
restarts from its checkpoint goes on where it was, and a batch that runs again reads the same bytes.

Spark asks the driver for offsets; executors read the ranges, in parts of at most `part_bytes` that begin and end
anywhere (a line belongs to the part in which it begins). Paths are local ones or URIs that pyarrow opens; all
executors must reach them. A file that can't be read is left as it was until it can; only at a query's start that is
an error, as its place would be lost. Options: path, pattern (of file names, default *.log), source, part_bytes.
"""

from __future__ import annotations

import fnmatch
import json
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Those of logs.LANDED.
SCHEMA = "source string, file string, modified timestamp, at long, value string"
#: Lengths of the beginnings of a file that are remembered by checksums.
HEADS, STEP = [1 << i for i in range(9)], 1 << 16


class Part(InputPartition):
    def __init__(self, file: str, start: int, stop: int, end: int):
        self.file, self.start, self.stop, self.end = file, start, stop, end


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def line_end(stream: pa.NativeFile, size: int) -> int:
    """The byte behind the last line's end; 0 if there is none."""
    at = size
    while at > 0:
        low = max(0, at - STEP)
        stream.seek(low)
        found = stream.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def progress(stream: pa.NativeFile) -> list:
    """[byte behind the last line's end, checksums of the beginnings up to there]."""
    end = line_end(stream, stream.size())
    stream.seek(0)
    first = stream.read(HEADS[-1])
    return [end, [zlib.crc32(first[:n]) for n in HEADS if n <= end]]


def begins(before: list | None, after: list) -> int:
    """The byte from which a file is read that has got from one state to another."""
    if before is None or after[0] < before[0] or any(x != y for x, y in zip(before[1], after[1], strict=False)):
        return 0
    return before[0]


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*.log")
        self.source, self.part_bytes = options.get("source", "live"), int(options.get("part_bytes", 64 << 20))
        self.known: dict[str, list] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        """What the files hold now."""
        system, root = _opened(self.path)
        found = dict(self.known or {})
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.pattern):
                try:
                    with system.open_input_file(info.path) as stream:
                        found[info.base_name] = progress(stream)
                except OSError:
                    if self.known is None:
                        raise
        self.known = found
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for file, state in sorted(after.items()):
            for at in range(begins(before.get(file), state), state[0], self.part_bytes):
                out.append(Part(file, at, min(state[0], at + self.part_bytes), state[0]))
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the part."""
        system, root = _opened(self.path)
        path = f"{root.rstrip('/')}/{partition.file}"
        with system.open_input_file(path) as stream:
            info = system.get_file_info(path)
            modified = datetime.fromtimestamp(info.mtime_ns / 1e9, timezone.utc) if info.mtime_ns else None
            at, rest = partition.start, b""
            if at:
                stream.seek(at - 1)
                if stream.read(1) != b"\n":  # the line that is cut here is the part before's
                    at = self._behind_end(stream, at, partition.end)
            stream.seek(at)
            read_to = at
            while at < partition.stop:
                got = stream.read(min(1 << 20, partition.end - read_to))
                read_to += len(got)
                rest += got
                lines = rest.split(b"\n")
                rest = lines.pop()
                starts, values = [], []
                for line in lines:
                    if at >= partition.stop:
                        break
                    text = line.removesuffix(b"\r").decode("utf-8", "replace")
                    if text:
                        starts.append(at)
                        values.append(text)
                    at += len(line) + 1
                if starts:
                    yield self._batch(partition, modified, starts, values)
                if not got:
                    break

    def _behind_end(self, stream: pa.NativeFile, at: int, end: int) -> int:
        while at < end:
            stream.seek(at)
            got = stream.read(min(STEP, end - at))
            found = got.find(b"\n")
            if found >= 0 or not got:
                return at + found + 1 if got else end
            at += len(got)
        return end

    def _batch(self, partition: Part, modified: datetime | None, starts: list[int], values: list[str]) -> pa.RecordBatch:
        n = len(starts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.source] * n), pa.array([partition.file] * n), pa.array([modified] * n, pa.timestamp("us", "UTC")), pa.array(starts, pa.int64()), pa.array(values),
            ],
            ["source", "file", "modified", "at", "value"],
        )

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledgerline_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return TailReader(self.options)


def follow(spark: SparkSession, path: str, pattern: str = "*.log", source: str = "live", part_bytes: int = 64 << 20) -> DataFrame:
    """LANDED lines that are appended to the files of the directory."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("ledgerline_tail").options(path=path, pattern=pattern, source=source, part_bytes=str(part_bytes)).load()
