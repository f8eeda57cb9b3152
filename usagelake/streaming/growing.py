"""Log files that still grow, as a stream: the offset is the number of bytes read of each file.

A trigger looks up the sizes of the files under the watched folders and reads the whole lines that have been added; a line without its end
waits. Files are read in ranges, so a file of any size is many tasks. A file that has become shorter starts anew. Paths are in any store that pyarrow's file systems reach. The folders are those of
live sessions: the offset has an entry for each file below them, so finished files belong in the table of ``ingest``.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from usagelake.schema import LINES

#: Bytes of a task, and of one look for the last line's end.
SPLIT, LOOK = 64 << 20, 64 << 10
#: Bytes of lines handed to Spark at a time.
HANDED = 4 << 20

_ARROW = pa.schema([("file_path", pa.string()), ("block_start", pa.int64()), ("line_id", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC")), ("size", pa.int64()),
                    ("value", pa.string())])


@dataclass
class Range(InputPartition):
    """Lines that begin from ``low`` to before ``high``, of what has been written up to ``end``."""

    folder: str
    path: str
    low: int
    high: int
    end: int
    mtime: float

    def __post_init__(self) -> None:
        super().__init__(None)


def _whole_lines(store: fs.FileSystem, path: str, size: int) -> int:
    """The place after the last line end."""
    with store.open_input_file(path) as file:
        at = size
        while at > 0:
            low = max(0, at - LOOK)
            file.seek(low)
            found = file.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


def lines_of(store: fs.FileSystem, part: Range) -> Iterator[list[tuple[int, bytes]]]:
    """(place, line) of the range, some megabytes at a time."""
    with store.open_input_file(part.path) as file:
        at = part.low
        if at:  # a line that begins before the range is another's
            at = _after_line_end(file, at - 1, part.end)
        held, have, rest = [], 0, b""
        place = at
        file.seek(at)
        while place < part.high:
            read = file.read(min(HANDED, part.end - place - len(rest)))
            block = rest + read
            cut = block.rfind(b"\n") + 1
            if not cut and read:
                rest = block
                continue
            for line in block[:cut].split(b"\n")[:-1]:
                if place >= part.high:
                    break
                held.append((place, line.removesuffix(b"\r")))
                have += len(line)
                place += len(line) + 1
            if have >= HANDED:
                yield held
                held, have = [], 0
            rest = block[cut:]
            if not read:
                break
        if held:
            yield held


def _after_line_end(file, at: int, end: int) -> int:
    file.seek(at)
    while at < end:
        block = file.read(min(LOOK, end - at))
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return end


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folders = options["paths"].split("\n")
        self.glob, self.whole = options.get("glob", "*.jsonl"), options.get("whole", "false").lower() == "true"
        self.split = int(options.get("split", SPLIT))
        self._seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> Iterator[tuple[str, fs.FileSystem, fs.FileInfo]]:
        for folder in self.folders:
            store, root = fs.FileSystem.from_uri(folder)
            for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
                if info.is_file and fnmatch.fnmatch(info.base_name, self.glob):
                    yield folder, store, info

    def latestOffset(self) -> dict:
        out = {}
        for _, store, info in self._files():
            size, end = self._seen.get(info.path, (-1, 0))
            if size != info.size:
                end = _whole_lines(store, info.path, info.size)
                self._seen[info.path] = (info.size, end)
            if end:
                out[info.path] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for folder, _, info in self._files():
            before, after = start.get(info.path, 0), end.get(info.path, 0)
            if after == before or after > info.size:
                continue
            low = 0 if self.whole or after < before else before
            out += [Range(folder, info.path, at, min(at + self.split, after), after, info.mtime_ns / 1e9) for at in range(low, after, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(partition.folder)
        name = partition.folder.split("://")[0] + "://" + partition.path if "://" in partition.folder else partition.path
        for held in lines_of(store, partition):
            n = len(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array([0] * n, pa.int64()), pa.array([at for at, _ in held], pa.int64()),
                 pa.array([int(partition.mtime * 1e6)] * n, pa.timestamp("us", tz="UTC")), pa.array([partition.end] * n, pa.int64()),
                 pa.array([line.decode("utf-8", "replace") for _, line in held])], schema=_ARROW)


class GrowingFiles(DataSource):
    """Source ``growing_files``; options: paths (URIs, one a line), glob, whole (read changed files from their beginning), split (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(dict(self.options))


def read_growing(spark: SparkSession, paths: list[str], glob: str = "*.jsonl", whole: bool = False, split: int = SPLIT) -> DataFrame:
    """Lines (``schema.LINES``) as files below the paths grow; ``line_id`` is a line's place in bytes."""
    spark.dataSource.register(GrowingFiles)
    full = [p if "://" in p else "file://" + p for p in paths]
    return spark.readStream.format("growing_files").option("paths", "\n".join(full)).option("glob", glob).option("whole", str(whole)).option("split", str(split)).load()


def land(lines: DataFrame, extract: Callable[[DataFrame], DataFrame], landed: str, checkpoint: str, once: bool = False, interval: str = "2 seconds") -> StreamingQuery:
    """Write the usage records of each trigger's lines below ``landed``, for ``live.read_usage``.

    Formats that carry a value along a file (codex, openclaw) need ``whole=True`` in ``read_growing``: a changed file is read again, and its
    records that have landed before meet themselves in the deduplication. A trigger that is run again replaces what it had written.
    """
    def write(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{landed.rstrip('/')}/{number}")

    run = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (run.trigger(availableNow=True) if once else run.trigger(processingTime=interval)).start()
