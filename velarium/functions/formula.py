"""Metric formulas: text to a syntax tree to a column. `*` and `/` bind tighter, from the left; no unary minus."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Ref:
    code: str


@dataclass(frozen=True)
class Binary:
    operator: str
    left: Number | Ref | Binary
    right: Number | Ref | Binary


Node = Number | Ref | Binary
_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|([-+*/×÷−()]))")
_SAME = {"×": "*", "÷": "/", "−": "-"}


def tokenize(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        match = _TOKEN.match(text, at)
        if not match:
            raise FormulaError(f"unexpected {text[at:].strip()[:1]!r}")
        out.append(_SAME.get(match[0].strip(), match[0].strip()))
        at = match.end()
    return out


def parse(text: str) -> Node:
    tokens = tokenize(text)
    if not tokens:
        raise FormulaError("empty formula")

    def atom() -> Node:
        if not tokens:
            raise FormulaError("unexpected end")
        token = tokens.pop(0)
        if token == "(":
            inner = chain("+-")
            if not tokens or tokens.pop(0) != ")":
                raise FormulaError("missing )")
            return inner
        if token[0].isdigit():
            return Number(float(token))
        if token in "+-*/)":
            raise FormulaError(f"unexpected {token!r}")
        return Ref(token)

    def chain(operators: str) -> Node:
        below = (lambda: chain("*/")) if operators == "+-" else atom
        node = below()
        while tokens and tokens[0] in operators:
            operator = tokens.pop(0)
            right = below()
            if operator == "/" and right == Number(0.0):
                raise FormulaError("division by zero")
            node = Binary(operator, node, right)
        return node

    node = chain("+-")
    if tokens:
        raise FormulaError(f"unexpected {tokens[0]!r}")
    return node


def references(node: Node) -> set[str]:
    if isinstance(node, Binary):
        return references(node.left) | references(node.right)
    return {node.code} if isinstance(node, Ref) else set()


def to_column(node: Node, column: Callable[[str], Column] = F.col) -> Column:
    """Arithmetic on doubles; a divisor that is zero at run time makes NULL."""
    if isinstance(node, Number):
        return F.lit(node.value)
    if isinstance(node, Ref):
        return column(node.code).cast("double")
    left, right = to_column(node.left, column), to_column(node.right, column)
    if node.operator == "/":
        return left / F.nullif(right, F.lit(0.0))
    return {"+": left + right, "-": left - right, "*": left * right}[node.operator]


def check_cycles(formulas: dict[str, str]) -> None:
    """Composites may refer to composites, but not to themselves by any way."""
    done: set[str] = set()

    def visit(code: str, path: tuple[str, ...]) -> None:
        if code in path:
            raise FormulaError("cycle: " + " -> ".join([*path, code]))
        if code in done or code not in formulas:
            return
        for other in sorted(references(parse(formulas[code]))):
            visit(other, (*path, code))
        done.add(code)

    for code in formulas:
        visit(code, ())
