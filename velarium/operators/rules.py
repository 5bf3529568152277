"""Business rules as verdicts by key: PASS, FAIL or UNKNOWN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("COMPARISON", "FILTER", "EXISTENCE", "COMPOSITE")


def check_mode(mode: str, on: str) -> None:
    """COMPARISON reads a metric; FILTER an entity or event; EXISTENCE an event; COMPOSITE other rules."""
    legal = {"COMPARISON": ("METRIC",), "FILTER": ("ENTITY", "EVENT"), "EXISTENCE": ("EVENT",), "COMPOSITE": ("RULE",)}
    if mode not in legal or on not in legal[mode]:
        raise ValueError(f"a {mode} rule can't be on {on}")


def compare(left: Column, operator: str, right: Column) -> Column:
    return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right, "=": left == right, "!=": left != right}[operator]


def verdict(condition: Column) -> Column:
    return F.when(condition.isNull(), "UNKNOWN").when(condition, "PASS").otherwise("FAIL")


def combine(frames: list[tuple[DataFrame, bool]], key: str, logic: str) -> DataFrame:
    """key, verdict of several verdict frames (key, verdict), each maybe negated: AND, OR, or NOT of one. Keys that one lacks are UNKNOWN there."""
    holds = F.when(F.col("verdict") == "PASS", True).when(F.col("verdict") == "FAIL", False)
    out = None
    for k, (frame, negated) in enumerate(frames):
        part = frame.select(key, (~holds if negated else holds).alias(f"v{k}"))
        out = part if out is None else out.join(part, key, "full_outer")
    columns = [F.col(f"v{k}") for k in range(len(frames))]
    joined = ~columns[0] if logic == "NOT" else reduce((lambda a, b: a & b) if logic == "AND" else (lambda a, b: a | b), columns)
    return out.select(key, verdict(joined).alias("verdict"))
