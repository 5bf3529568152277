"""The semantic model: entities, events, relations, metrics, targets and rules, as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Attribute:
    code: str
    semantic_type: str = "TEXT"
    filterable: bool = True
    groupable: bool = True
    #: Physical expression; the code itself if empty.
    transform: str = ""
    unit: str = ""
    #: How far SUM goes: "additive"; "semi" (of an event: at its latest time only); "none" (not at all, but for `within`).
    additivity: str = "additive"
    #: Dimensions' names that a sum has to keep apart (say a batch), where additivity is "none".
    within: tuple[str, ...] = ()


@dataclass(frozen=True)
class Object:
    """An entity (dimension) or an event (fact) over a physical table."""

    code: str
    table: str
    kind: str
    key: tuple[str, ...]
    attributes: tuple[Attribute, ...]
    default_time: str = ""
    #: Other physical tables, by the source that has them (say a warehouse beside the table of operations).
    physical: tuple[tuple[str, str], ...] = ()

    def attribute(self, code: str) -> Attribute:
        for a in self.attributes:
            if a.code == code:
                return a
        raise KeyError(f"{self.code} has no attribute {code}")


@dataclass(frozen=True)
class Relation:
    """A typed edge. required relations are inner joins, others left joins."""

    code: str
    source: str
    target: str
    on: tuple[tuple[str, str], ...]
    cardinality: str = "MANY_TO_ONE"
    direction: str = "FORWARD"
    priority: int = 1
    required: bool = False
    role: str = ""


@dataclass(frozen=True)
class Condition:
    attribute: str
    operator: str
    values: tuple = ()


@dataclass(frozen=True)
class BasicMetric:
    code: str
    event: str
    operator: str
    attribute: str = ""
    conditions: tuple[Condition, ...] = ()
    logic: str = "AND"


@dataclass(frozen=True)
class CompositeMetric:
    code: str
    formula: str


@dataclass(frozen=True)
class Target:
    metric: str
    value: float
    start: date
    end: date
    dimension: str = ""


@dataclass(frozen=True)
class Catalog:
    objects: dict[str, Object] = field(default_factory=dict)
    relations: tuple[Relation, ...] = ()
    metrics: dict[str, BasicMetric | CompositeMetric] = field(default_factory=dict)
