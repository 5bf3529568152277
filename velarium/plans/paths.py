"""Join paths over the relation graph."""

from __future__ import annotations

from collections import deque

from velarium.plans.model import Catalog, Relation

Step = tuple[Relation, bool]


def steps_from(catalog: Catalog, code: str) -> list[Step]:
    """Relations that can be walked from an object, and whether against their direction; lower priority first."""
    out = [(r, False) for r in catalog.relations if r.source == code and r.direction in ("FORWARD", "BIDIRECTIONAL")]
    out += [(r, True) for r in catalog.relations if r.target == code and r.direction in ("REVERSE", "BIDIRECTIONAL")]
    return sorted(out, key=lambda s: (s[0].priority, s[0].code))


def find_path(catalog: Catalog, source: str, target: str, role: str = "") -> list[Step]:
    """The shortest path, of those the one of the first relations by priority. role: a relation of that role must be on it; relations of other roles are only for those who ask for them."""
    queue: deque[tuple[str, list[Step]]] = deque([(source, [])])
    while queue:
        at, path = queue.popleft()
        if at == target and (not role or any(r.role == role for r, _ in path)):
            return path
        for relation, back in steps_from(catalog, at):
            if relation.role in ("", role) and all(relation is not r for r, _ in path):
                queue.append((relation.source if back else relation.target, [*path, (relation, back)]))
    raise ValueError(f"{target} can't be reached from {source}")


def reachable(catalog: Catalog, source: str) -> set[str]:
    seen, queue = {source}, deque([source])
    while queue:
        for relation, back in steps_from(catalog, queue.popleft()):
            to = relation.source if back else relation.target
            if to not in seen:
                seen.add(to)
                queue.append(to)
    return seen


def fans_out(step: Step) -> bool:
    """Whether a step can multiply rows, so that measures must be aggregated before it."""
    relation, back = step
    many = {"MANY_TO_ONE": back, "ONE_TO_MANY": not back, "ONE_TO_ONE": False, "MANY_TO_MANY": True}
    return many[relation.cardinality]
