"""The twelve condition operators and their AND / OR combination, as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from velarium.plans.model import Condition

OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "IN", "NOT_IN", "BETWEEN", "LIKE", "IS_NULL", "NOT_NULL")


def parse_list(text: str) -> tuple[str, ...]:
    """A comma list, trimmed, empties dropped."""
    return tuple(v.strip() for v in text.split(",") if v.strip())


def compile_condition(condition: Condition, column: Callable[[str], Column] = F.col) -> Column:
    """NULL never matches, but for IS_NULL. LIKE keeps SQL's wildcards; BETWEEN includes both ends."""
    c, op, values = column(condition.attribute), condition.operator.upper(), condition.values
    need = {"IS_NULL": 0, "NOT_NULL": 0, "BETWEEN": 2}.get(op)
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    if need is not None and len(values) != need or need is None and not values:
        raise ValueError(f"{op} on {condition.attribute} can't take {len(values)} values")
    if op == "IS_NULL":
        return c.isNull()
    if op == "NOT_NULL":
        return c.isNotNull()
    if op == "IN":
        return c.isin(*values)
    if op == "NOT_IN":
        return ~c.isin(*values)
    if op == "BETWEEN":
        return c.between(*values)
    if op == "LIKE":
        return c.like(values[0])
    value = F.lit(values[0])
    return {"=": c == value, "!=": c != value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[op]


def combine(conditions: Iterable[Condition], logic: str = "AND", column: Callable[[str], Column] = F.col) -> Column:
    """All or any of the conditions; none of them is true of every row."""
    compiled = [compile_condition(c, column) for c in conditions]
    if not compiled:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if logic.upper() == "AND" else (lambda a, b: a | b), compiled)


def facets(column_values: dict[str, Iterable], text: str = "", searched: Iterable[str] = ()) -> Column:
    """Optional multi-select facets and a case-insensitive text search over some columns; what is empty doesn't restrict."""
    out = F.lit(True)
    for name, values in column_values.items():
        if values := list(values):
            out = out & F.col(name).isin(values)
    if text:
        out = out & F.lower(F.concat_ws(" ", *searched)).contains(text.lower())
    return out
