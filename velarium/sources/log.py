"""A segmented log on a shared file system, as a data source: written in two phases, read in batches or as a stream by offsets.

A log is a folder: `data/` has segments (a JSON text a line), `manifests/` the commits in order. A commit names its
segments with the offset of each one's first record; records without a commit don't exist. A job's tasks write segments
under names of their own; the driver then publishes all of them by creating the next manifest, whole and only if there is
none of that number; if another writer was first, it tries the one after. Nothing is renamed or written over, so a
job that is given up leaves at most files that no manifest names. These it deletes, but for those of tasks that
were killed while they wrote, which clean() takes away.

A stream's offset is the number of records that it has read. It goes on from its checkpoint, and records keep
their offsets for ever, so a restart neither loses nor repeats one. commit() notes how far a named reader has come.
"""

from __future__ import annotations

import bisect
import contextlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Records of a partition of a read, and of a segment.
PART_RECORDS = 100_000


@dataclass
class Segment(InputPartition):
    """Records low to high - 1 of a file whose first record has offset `first`."""

    file: str
    first: int
    low: int
    high: int


@dataclass
class Written(WriterCommitMessage):
    """A task's segments: (file, number of records)."""

    files: list


class Log:
    """The files of a log."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://").rstrip("/")

    def make(self) -> None:
        for folder in ("data", "manifests", "readers"):
            os.makedirs(f"{self.path}/{folder}", exist_ok=True)

    def manifests(self) -> list[str]:
        with contextlib.suppress(FileNotFoundError):
            return sorted(n for n in os.listdir(f"{self.path}/manifests") if n.endswith(".json"))
        return []

    def read(self, name: str) -> dict:
        with open(f"{self.path}/manifests/{name}") as file:
            return json.load(file)

    def end(self) -> int:
        """How many records there are. Reads the last manifest only."""
        names = self.manifests()
        return self.read(names[-1])["end"] if names else 0

    def segments(self, low: int, high: int) -> list[Segment]:
        """What holds records low to high - 1, in parts. The first manifest to read is found by halving, as they end in order."""
        names, parts = self.manifests(), []
        for name in names[bisect.bisect_right(names, low, key=lambda n: self.read(n)["end"]) :]:
            held = self.read(name)
            if held["start"] >= high:
                break
            for file, first, n in held["segments"]:
                a, b = max(low, first), min(high, first + n)
                parts += [Segment(file, first, at, min(b, at + PART_RECORDS)) for at in range(a, b, PART_RECORDS)]
        return parts

    def records(self, part: Segment) -> Iterator[tuple[int, str]]:
        with open(f"{self.path}/data/{part.file}") as file:
            for k, line in enumerate(file, part.first):
                if k >= part.high:
                    break
                if k >= part.low:
                    yield k, json.loads(line)

    def publish(self, files: list[tuple[str, int]]) -> int:
        """Make segments visible, after all there are; where they end."""
        own = f"{self.path}/manifests/{uuid.uuid4().hex}.own"
        while True:
            names = self.manifests()
            start = at = self.read(names[-1])["end"] if names else 0
            segments = []
            for file, n in files:
                segments.append((file, at, n))
                at += n
            with open(own, "w") as out:
                json.dump({"start": start, "end": at, "segments": segments}, out)
            number = int(names[-1][:-5]) + 1 if names else 0
            try:
                os.link(own, f"{self.path}/manifests/{number:012d}.json")  # whole, and only if there is none
            except FileExistsError:
                continue  # another writer was first: after its records, then
            finally:
                os.unlink(own)
            return at

    def clean(self, age: float = 86_400) -> int:
        """Delete files that no manifest names and nobody wrote to for so many seconds (those of tasks that were killed); how many went."""
        named = {file for name in self.manifests() for file, *_ in self.read(name)["segments"]}
        old = [f for f in os.listdir(f"{self.path}/data") if f not in named and time.time() - os.stat(f"{self.path}/data/{f}").st_mtime >= age]
        self.delete([(f, 0) for f in old])
        return len(old)

    def delete(self, files: list[tuple[str, int]]) -> None:
        for file, _ in files:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(f"{self.path}/data/{file}")


class _Reader(DataSourceReader):
    """Bounds come as options, not by pushFilters(): Spark 4.1 keeps what was pushed for the next scan of the same frame, which then misses rows."""

    def __init__(self, log: Log, low: int, high: int | None):
        self.log, self.low, self.high = log, low, log.end() if high is None else min(high, log.end())

    def partitions(self) -> list[Segment]:
        return self.log.segments(self.low, self.high) or [Segment("", 0, 0, 0)]

    def read(self, partition: Segment) -> Iterator[tuple]:
        return self.log.records(partition) if partition.file else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, log: Log, reader: str | None):
        self.log, self.name = log, reader

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def latestOffset(self) -> dict:
        return {"offset": self.log.end()}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return self.log.segments(start["offset"], end["offset"])

    def read(self, partition: Segment) -> Iterator[tuple]:
        return self.log.records(partition)

    def commit(self, end: dict) -> None:
        if self.name:
            with open(f"{self.log.path}/readers/{self.name}", "w") as file:
                json.dump(end, file)


class _Writer(DataSourceWriter):
    def __init__(self, log: Log, overwrite: bool):
        if overwrite:
            raise ValueError("a log can only be appended to")
        self.log = log

    def write(self, iterator) -> Written:
        """A task's rows in segments; nothing is visible yet. A task that fails takes its own away."""
        files: list = []
        try:
            for n, row in enumerate(iterator):
                if n % PART_RECORDS == 0:
                    if files:
                        out.close()  # noqa: F821
                    name = f"{uuid.uuid4().hex}.jsonl"
                    files.append([name, 0])
                    out = open(f"{self.log.path}/data/{name}", "w")
                out.write(json.dumps(row["payload"]) + "\n")
                files[-1][1] += 1
            if files:
                out.close()
        except BaseException:
            self.log.delete(files)
            raise
        return Written([tuple(f) for f in files])

    def commit(self, messages) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        if files:
            self.log.publish(files)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                self.log.delete(m.files)


class LogSource(DataSource):
    """Options: path; from and to, offsets without the last (only their segments are read); reader (a name to note progress under, for streams)."""

    @classmethod
    def name(cls) -> str:
        return "velarium_log"

    def schema(self) -> str:
        return "offset long, payload string"

    def _log(self) -> Log:
        return Log(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        high = self.options.get("to")
        return _Reader(self._log(), int(self.options.get("from", "0")), None if high is None else int(high))

    def streamReader(self, schema) -> DataSourceStreamReader:
        self._log().make()
        return _Stream(self._log(), self.options.get("reader"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if "payload" not in schema.fieldNames():
            raise ValueError("a log takes a column `payload`")
        self._log().make()
        return _Writer(self._log(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
