"""Grown logs as a stream: a Python data source whose offsets are bytes of files.

A micro-batch holds the complete lines that were added since the last one, and reads those bytes only; what comes after
a file's last line feed waits for the next. Large additions are dealt out in pieces of at most ``PIECE`` bytes. A file
that has become shorter counts as a new one and is read from its start. seq is the byte at which a line begins, so lines
of a file are ordered however they were dealt out. Paths are any that pyarrow's file systems open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PIECE = 32 << 20
LOOK_BACK = 64 << 10
LINES = "file string, seq long, line string"


def opened(folder: str):
    """File system and path of a folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin in the bytes from first to last; start is where the batch's bytes begin."""

    file: str
    start: int
    first: int
    last: int

    def __init__(self, file: str, start: int, first: int, last: int):
        self.file, self.start, self.first, self.last = file, start, first, last


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, glob: str, piece: int):
        self.folder, self.glob, self.piece = folder, glob, piece
        self.seen: dict[str, tuple[int, int]] = {}  # size and end of the last complete line

    def initialOffset(self) -> dict:
        return {}

    def _end_of_lines(self, system, path: str, size: int) -> int:
        with system.open_input_file(path) as f:
            at = size
            while at > 0:
                begin = max(0, at - LOOK_BACK)
                f.seek(begin)
                found = f.read(at - begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                at = begin
        return 0

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, folder = opened(self.folder)
        out = {}
        for info in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or not fnmatch(info.base_name, self.glob):
                continue
            if self.seen.get(info.path, (-1, 0))[0] != info.size:
                self.seen[info.path] = info.size, self._end_of_lines(system, info.path, info.size)
            out[info.path] = self.seen[info.path][1]
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for file, last in sorted(end.items()):
            first = start.get(file, 0)
            first = 0 if last < first else first
            out += [Piece(file, first, at, min(at + self.piece, last)) for at in range(first, last, self.piece)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        with system.open_input_file(partition.file) as f:
            at = partition.first
            if at > partition.start:  # the line that the piece before has begun belongs to it
                f.seek(at - 1)
                rest = b""
                while (block := f.read(LOOK_BACK)) and b"\n" not in block:
                    rest += block
                at += len(rest) + block.find(b"\n") if block else len(rest)
            f.seek(at)
            rows: list[tuple[int, str]] = []
            held = b""
            while at < partition.last:
                block = f.read(1 << 20)
                *lines, held = (held + block).split(b"\n")
                for line in lines:
                    if at >= partition.last:
                        break
                    rows.append((at, line.rstrip(b"\r").decode("utf-8", "replace")))
                    at += len(line) + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["file", "seq", "line"])
                    rows = []
                if not block:
                    break

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """Options: path (a folder), glob (of file names) and piece (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("glob", "*.txt"), int(self.options.get("piece", PIECE)))


def tail(spark: SparkSession, folder: str, glob: str = "*.txt", piece: int = PIECE) -> DataFrame:
    """A stream of the lines (file, seq, line) that are added to the logs of a folder."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("glob", glob).option("piece", piece).load(folder)
