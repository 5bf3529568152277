"""Where others' code comes in: steps of a modelling run, indexes and loaders of a review, tools behind a process."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from velarium.session import materialize

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Pipeline:
    """A modelling run by four exchangeable steps; each is a function from a table to a table."""

    normalize: Step
    reconcile: Step
    generate: Step
    publish: Step

    def run(self, records: DataFrame) -> dict[str, DataFrame]:
        """The result of every step. Each is written once and read by the next, so none runs twice."""
        out, at = {}, records
        for name in ("normalize", "reconcile", "generate", "publish"):
            at = materialize(getattr(self, name)(at), name)
            out[name] = at
        return out


class ReviewIndex(Protocol):
    def page(self, after: int, size: int) -> DataFrame: ...


class BodyLoader(Protocol):
    def load(self, refs: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Review:
    """Pages of an index whose bodies come from a loader; both are given."""

    index: ReviewIndex
    loader: BodyLoader

    def read(self, after: int, size: int) -> DataFrame:
        page = self.index.page(after, size)
        return page.join(self.loader.load(page), "id", "left")


def through_process(df: DataFrame, command: list[str], schema: str) -> DataFrame:
    """Rows as JSON lines through a tool's standard input and output, one process for each partition; the tool answers each line by one of schema's columns."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")
        try:
            for batch in batches:
                out = []
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    tool.stdin.write(json.dumps(dict(zip(names, row, strict=True))) + "\n")
                    tool.stdin.flush()
                    line = tool.stdout.readline()
                    if not line:
                        raise RuntimeError(f"{command[0]} ended early")
                    out.append(json.loads(line))
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
            tool.stdin.close()
            if tool.wait():
                raise RuntimeError(f"{command[0]} failed: {tool.returncode}")
        finally:
            if tool.poll() is None:
                tool.kill()

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.mapInArrow(run, schema)
