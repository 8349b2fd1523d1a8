"""A stream of the lines that jobs append to their log files.

The format "joblogs" reads a folder of files `<job>.log`, rotated ones `<job>.log.1`, `<job>.log.2` and so on, and text files in
folders `job=<job>`. Its offset is, per file, the byte after the last line feed: a line that isn't written to its end waits for
the next batch. Files go by their number in the file system and their first line, so that one that is rotated away is read on
under its new name. A batch lists byte ranges, cut into chunks, and tasks read those; no line passes through the driver.

The first time that a file is seen it gets the next generation of its job, recorded in a registry beside, so that (generation,
byte) orders the lines of a job over rotations and restarts. A file whose content was replaced in place is a new one if its
first line is another one. Lines that were to be read and whose file is gone fail the batch.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sinks.versions import create_exclusively, local

NAME = re.compile(r"(?:^|/)(?:job=([^/]+)/[^/]+\.(?:txt|log)|([^/]+?)\.log)(?:\.([0-9]+))?$")
BLOCK, CHUNK, BATCH = 1 << 16, 32 << 20, 8192
#: Bytes of a generation: line numbers are generation * GENERATION + byte.
GENERATION = 1 << 42


def first_line(path: str) -> bytes | None:
    """The first line with its end, None as long as it has none."""
    with open(path, "rb") as f:
        line = f.readline()
    return line if line.endswith(b"\n") else None


def whole_lines(path: str) -> int:
    """The byte after the last line feed."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at:
            start = max(0, at - BLOCK)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return 0


@dataclass
class Range:
    """Lines of a file that start at `begin` or after it and before `stop`; `origin` is where a line is known to start."""

    path: str
    identity: str
    job: str
    generation: int
    origin: int
    begin: int
    stop: int


@dataclass
class Ranges(InputPartition):
    """What one task reads: ranges of about a chunk together, so that many small files are few tasks."""

    ranges: list[Range]


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = local(options["path"])
        self.registry = local(options.get("registry", os.path.join(self.folder, ".generations")))
        self.chunk = int(options.get("chunk", CHUNK))
        self.known: dict[str, tuple[str, int]] = {}
        self.read_to = ""

    def found(self) -> dict[str, tuple[str, str, int]]:
        """Of each file that has a line: identity, and path, job and number of its rotation."""
        out = {}
        for top, folders, names in os.walk(self.folder):
            folders[:] = [d for d in folders if not d.startswith((".", "_"))]
            for name in names:
                path = os.path.join(top, name)
                m = NAME.search(os.path.relpath(path, self.folder))
                try:
                    line = first_line(path) if m else None
                    if line is not None:
                        out[f"{os.stat(path).st_ino}-{zlib.crc32(line)}"] = (path, m[1] or m[2], int(m[3] or 0))
                except FileNotFoundError:
                    pass  # rotated meanwhile: the next scan has it
        return out

    def generations(self, files: dict) -> None:
        """Records the files that are new, the oldest of a job first, in one more file of the registry; it is read again if another
        stream has taken that file's number."""
        while any(i not in self.known for i in files):
            names = sorted(os.listdir(self.registry)) if os.path.isdir(self.registry) else []
            for name in (n for n in names if n.endswith(".json") and n > self.read_to):
                with open(os.path.join(self.registry, name)) as f:
                    self.known |= {i: tuple(x) for i, x in json.load(f).items()}
                self.read_to = name
            last: dict[str, int] = {}
            for job, generation in self.known.values():
                last[job] = max(last.get(job, -1), generation)
            new = {}
            for i in sorted((i for i in files if i not in self.known), key=lambda i: (files[i][1], -files[i][2], files[i][0])):
                job = files[i][1]
                last[job] = last.get(job, -1) + 1
                new[i] = job, last[job]
            if new:
                create_exclusively(os.path.join(self.registry, f"{int(self.read_to[:-5] or 0) + 1:012}.json"), json.dumps(new))

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files = self.found()
        self.generations(files)
        ends = {}
        for i, (path, _, _) in files.items():
            try:
                ends[i] = whole_lines(path)
            except FileNotFoundError:
                ends[i] = whole_lines(self.found()[i][0])
        return {"files": ends}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        files, out, size = None, [], self.chunk
        for i, stop in sorted(end["files"].items()):
            origin = start["files"].get(i, 0)
            if stop <= origin:
                continue
            if files is None:
                files = self.found()
                self.generations(files)
            if i not in files:
                raise RuntimeError(f"lines from byte {origin} on are gone with their file {i}")
            job, generation = self.known[i]
            for begin in range(origin, stop, self.chunk):
                part = Range(files[i][0], i, job, generation, origin, begin, min(begin + self.chunk, stop))
                if size + part.stop - begin > self.chunk:
                    out.append(Ranges([]))
                    size = 0
                out[-1].ranges.append(part)
                size += part.stop - begin
        return out

    def opened(self, part: Range):
        """The file of a range, under whatever name it has by now."""
        for _ in range(5):
            try:
                f = open(part.path, "rb")
                if f"{os.fstat(f.fileno()).st_ino}-{zlib.crc32(f.readline())}" == part.identity:
                    return f
                f.close()
            except FileNotFoundError:
                pass
            part.path = self.found().get(part.identity, (part.path,))[0]
        raise RuntimeError(f"lines from byte {part.begin} on are gone with their file {part.identity}")

    def read(self, partition: Ranges):
        for part in partition.ranges:
            yield from self.lines(part)

    def lines(self, part: Range):
        import pyarrow as pa

        def batch():
            n = len(lines)
            return pa.RecordBatch.from_arrays([pa.array([part.job] * n, pa.string()), pa.array([part.generation] * n, pa.int64()), pa.array(places, pa.int64()),
                                               pa.array(lines, pa.string())], names=["job", "generation", "at", "line"])

        with self.opened(part) as f:
            f.seek(part.begin)
            if part.begin > part.origin:  # a line that began before belongs to the range before
                f.seek(part.begin - 1)
                f.readline()
            at, lines, places = f.tell(), [], []
            while at < part.stop:
                line = f.readline()
                if not line.endswith(b"\n"):
                    raise RuntimeError(f"{part.path} has become shorter")
                text = line.rstrip(b"\r\n").decode(errors="replace")
                if text:
                    lines.append(text)
                    places.append(at)
                at += len(line)
                if len(lines) >= BATCH:
                    yield batch()
                    lines, places = [], []
            if lines:
                yield batch()

    def commit(self, end: dict) -> None:
        """Nothing is kept beside the offsets, which Spark has in its checkpoint."""


class JobLogs(DataSource):
    """The format "joblogs"; options `path`, `registry` (where generations are recorded) and `chunk` (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "joblogs"

    def schema(self) -> str:
        return "job string, generation long, at long, line string"

    def streamReader(self, schema) -> LogReader:
        return LogReader(dict(self.options))


def log_lines(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of (job, line_no, line) of the job logs in a folder; line numbers grow within a job. Empty lines are left out."""
    spark.dataSource.register(JobLogs)
    lines = spark.readStream.format("joblogs").options(**{k: str(v) for k, v in options.items()}).load(folder)
    return lines.select("job", (F.col("generation") * GENERATION + F.col("at")).alias("line_no"), "line")
