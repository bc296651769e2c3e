"""A stream source of access logs that grow, are rotated and truncated: a map of inode to (path, position) is its offset."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "line string, log_path string, line_offset long"
FOLDERS = ("nginx", "apache")
LIVE, ROTATED = re.compile(r".*access\.log"), re.compile(r"(.*access\.log)\.\d+")
#: Appended bytes that one task reads.
RANGE_BYTES = 32 << 20
_BLOCK, _ROWS = 1 << 16, 5000


@dataclass
class Appended(InputPartition):
    """The lines of a file that begin at begin or later and before end. From a begin within the file (mid), the line that is cut there is the task's before."""

    inode: int
    path: str
    begin: int
    end: int
    mid: bool


class AccessLogTail(DataSource):
    """spark.readStream.format("access_log_tail").load(root): line, log_path, line_offset (in bytes) of lines as they are appended to
    <root>/{nginx,apache}/*access.log, a local or mounted folder that the driver and all executors see.

    readExisting: true begins with all lines there are; by default, with what comes after the stream began (files that come later are read from
    their start). A line goes out once its newline is there. A file that is renamed to <name>.<digits> is read to its end under its old
    name, as it keeps its inode, and the file in its place from its start; one that got shorter is read from its start. Rotated files that
    were there before, and empty lines, are left out; bytes that aren't UTF-8 are replaced. failOnDataLoss: false passes over a
    file that went away between a batch's plan and its reading.
    """

    @classmethod
    def name(cls) -> str:
        return "access_log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        flag = lambda k, default: str(self.options.get(k, default)).lower() == "true"
        return TailReader(self.options["path"], flag("readExisting", "false"), flag("failOnDataLoss", "true"))


def _whole_lines(path: str, size: int) -> int:
    """Position behind the last newline among the first size bytes."""
    with open(path, "rb") as f:
        while size > 0:
            begin = max(0, size - _BLOCK)
            f.seek(begin)
            at = f.read(size - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            size = begin
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, root: str, read_existing: bool, fail_on_loss: bool):
        self.root, self.read_existing, self.fail_on_loss = root.removeprefix("file://"), read_existing, fail_on_loss

    def _files(self) -> Iterator[tuple[int, str, int]]:
        for folder in FOLDERS:
            for path in sorted(Path(self.root, folder).glob("*access.log*")):
                if LIVE.fullmatch(path.name) or ROTATED.fullmatch(path.name):
                    try:
                        found = path.stat()
                    except FileNotFoundError:  # it went away just now
                        continue
                    yield found.st_ino, str(path), found.st_size

    def initialOffset(self) -> dict:
        return {} if self.read_existing else self.latestOffset()

    def latestOffset(self) -> dict:
        out = {}
        for inode, path, size in self._files():
            try:
                out[str(inode)] = [path, _whole_lines(path, size)]
            except FileNotFoundError:
                continue
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for inode, (path, position) in end.items():
            rotated = ROTATED.fullmatch(path)
            if inode not in start and rotated:
                continue
            begin = start[inode][1] if inode in start else 0
            begin = 0 if position < begin else begin
            for at in range(begin, position, RANGE_BYTES):
                out.append(Appended(int(inode), path, at, min(at + RANGE_BYTES, position), at > begin))
        return out

    def read(self, partition: Appended) -> Iterator[pa.RecordBatch]:
        path = self._path_of(partition)
        if path is None:
            if self.fail_on_loss:
                raise FileNotFoundError(f"{partition.path} went away before its lines were read")
            return
        shown = ROTATED.fullmatch(partition.path)
        shown = shown[1] if shown else partition.path
        lines, places = [], []
        with open(path, "rb") as f:
            at = partition.begin - partition.mid
            f.seek(at)
            if partition.mid:
                at += len(f.readline())
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                if text := line.rstrip(b"\r\n"):
                    lines.append(text.decode("utf-8", "replace"))
                    places.append(at)
                at += len(line)
                if len(lines) >= _ROWS:
                    yield _rows(lines, shown, places)
                    lines, places = [], []
        yield _rows(lines, shown, places)

    def _path_of(self, partition: Appended) -> str | None:
        """Where the inode is now: a file may have been rotated since the batch was planned."""
        try:
            if os.stat(partition.path).st_ino == partition.inode:
                return partition.path
        except FileNotFoundError:
            pass
        return next((path for inode, path, _ in self._files() if inode == partition.inode), None)


def _rows(lines: list[str], path: str, places: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"line": pa.array(lines, pa.string()), "log_path": pa.array([path] * len(lines), pa.string()), "line_offset": pa.array(places, pa.int64())})
