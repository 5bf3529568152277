"""Every publication check over a model made from the test tables, one query for each family, and the gate over all.

The expressions below are read by both engines; joins, aggregates and closures are each engine's own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession

from velarium.operators import modelcheck as M
from velarium.plans.checks import CHECKS
from velarium.registry import register
from velarium.session import table

_p, _c, _o = "p_partkey", "c_custkey", "o_orderkey"
_null = lambda k, when, then: f"CASE WHEN {k} % {when} = 0 THEN NULL ELSE {then} END"
_pid = f"(1 + {_c} % 40)"  # of a value's object
_depth = f"(1 + {_c} % 3)"
_event = f"(3 * (1 + {_p} % 60))"

#: Of each table: the parts that it is the union of, as (source, columns, condition).
MODEL: dict[str, list[tuple[str, dict[str, str], str]]] = {
    "objects": [("part", {"id": _p, "kind": f"CASE WHEN {_p} % 3 = 0 THEN 'EVENT' ELSE 'ENTITY' END", "code": f"concat('O', CASE WHEN {_p} % 50 = 0 THEN {_p} - 1 WHEN {_p} % 96 = 0 THEN {_p} - 3 ELSE {_p} END)", "uid": _null(_p, 37, f"{_p} * 10"), "time_attribute": _null(_p, 17, f"{_p} * 10 + 1")}, "true")],
    "attributes": [
        ("part", {"id": f"{_p} * 10 + {k}", "object": _p, "kind": f"CASE WHEN {_p} % 3 = 0 THEN 'EVENT' ELSE 'ENTITY' END", "type": t, "is_metric": f"{k} = 2 AND {_p} % 4 = 2", "filterable": f"{_p} % 5 <> 0"}, "true" if k != 1 else f"{_p} % 21 <> 0")
        for k, t in enumerate(("'ID'", "'DATETIME'", f"CASE {_p} % 4 WHEN 0 THEN 'HIERARCHY' WHEN 1 THEN 'ENUM' WHEN 2 THEN 'AMOUNT' ELSE 'TEXT' END"))
    ],
    "field_mappings": [("part", {"attribute": f"{_p} * 10 + {k}", "role": r}, w) for k, r, w in ((0, f"CASE WHEN {_p} % 11 = 0 THEN 'DIMENSION' ELSE 'JOIN_KEY' END", "true"), (1, f"CASE WHEN {_p} % 13 = 0 THEN 'DIMENSION' ELSE 'TIME' END", "true"), (2, "'DIMENSION'", f"{_p} % 19 <> 0"))],
    "schema_mappings": [("part", {"object": _p}, f"{_p} % 23 <> 0")],
    "relations": [("orders", {"id": _o, "code": f"concat('R', CASE WHEN {_o} % 64 = 1 THEN {_o} + 1 ELSE {_o} END)"}, "true")],
    "participations": [("orders", {"id": _o, "source": f"3 * (1 + {_o} % 50)", "source_attribute": _null(_o, 31, f"30 * (1 + {_o} % 50)"), "target_attribute": _null(_o, 29, f"10 * (1 + o_custkey % 100)")}, f"{_o} % 7 <> 0 AND (1 + o_custkey % 100) % 3 <> 0")],
    "terms": [("nation", {"id": "n_nationkey", "code": "concat('T', n_nationkey % 20)"}, "true")],
    "aliases": [("part", {"id": _p, "text": "p_type", "target_type": "'METRIC'", "target": "p_brand"}, "true")],
    "hierarchies": [("part", {"id": _p, "attribute": f"{_p} * 10 + CASE WHEN {_p} % 20 = 0 THEN 0 ELSE 2 END", "name": f"CASE WHEN {_p} % 52 = 0 THEN ' ' ELSE 'h' END"}, f"{_p} % 4 = 0")],
    "levels": [("part", {"id": f"{_p} * 100 + {d}", "attribute": f"{_p} * 10 + 2", "code": f"concat('L', CASE WHEN {_p} % 28 = 0 AND {d} = 3 THEN 2 ELSE {d} END)", "name": f"CASE WHEN {_p} % 44 = 0 AND {d} = 2 THEN '' ELSE 'level' END", "depth": str(d), "parent": "CAST(NULL AS BIGINT)" if d == 1 else f"{_p} * 100 + {d - 1}", "removed": f"{_p} % 36 = 0 AND {d} = 3"}, f"{_p} % 4 = 0 AND {_p} % 24 <> 0") for d in (1, 2, 3)],
    "metrics": [("part", {"id": _p, "code": f"CASE WHEN {_p} % 61 = 0 THEN '' WHEN {_p} % 58 = 0 THEN concat('M', {_p} - 1) ELSE concat('M', {_p}) END", "name": f"CASE WHEN {_p} % 67 = 0 THEN '' ELSE 'metric' END", "type": f"CASE WHEN {_p} % 4 = 0 THEN 'COMPOSITE' ELSE 'BASIC' END", "event": f"CASE WHEN {_p} % 71 = 0 THEN NULL WHEN {_p} % 73 = 0 THEN -1 ELSE {_event} END", "attribute": _null(_p, 79, f"{_event} * 10 + 2"), "operator": _null(_p, 59, "'SUM'"), "status": f"CASE WHEN {_p} % 6 = 0 THEN 'DRAFT' ELSE 'PUBLISHED' END"}, "true")],
    "calibers": [("part", {"metric": _p, "event": _event, "attribute": f"{_event} * 10 + CASE WHEN {_p} % 35 = 0 THEN 20 ELSE 2 END", "op": f"CASE WHEN {_p} % 15 = 0 THEN 'IS_NULL' ELSE 'EQ' END", "n_values": f"{_p} % 2"}, f"{_p} % 5 = 0")],
    "formula_refs": [
        ("part", {"metric": _p, "ref": f"CASE WHEN {_p} % 48 = 0 THEN 'X' WHEN {_p} % 44 = 0 THEN concat('M', {_p}) ELSE concat('M', {_p} - 1) END"}, f"{_p} % 4 = 0 AND {_p} % 52 <> 0"),
        ("part", {"metric": _p, "ref": f"concat('M', CASE WHEN {_p} % 40 = 0 THEN {_p} + 4 ELSE {_p} - 4 END)"}, f"{_p} % 8 = 4 OR {_p} % 40 = 0"),
    ],
    "metric_edges": [("part", {"a": _p, "b": f"CASE WHEN {_p} % 40 = 0 THEN {_p} + 4 WHEN {_p} % 44 = 0 THEN {_p} ELSE {_p} - 4 END"}, f"{_p} % 8 = 4 OR {_p} % 40 = 0")],
    "targets": [("part", {"id": _p, "metric": _null(_p, 31, f"{_p} % 50"), "period": f"CASE WHEN {_p} % 29 = 0 THEN '' ELSE 'MONTH' END", "dimension": f"concat('d', {_p} % 2)", "kind": f"CASE WHEN {_p} % 3 = 0 THEN 'RATIO' ELSE 'AMOUNT' END", "value": _null(_p, 37, f"{_p} % 5 - 1"), "first_day": _null(_p, 41, f"{_p} % 20 * 5"), "last_day": f"{_p} % 20 * 5 + {_p} % 7 - 1"}, "true")],
    "target_reach": [("part", {"id": _p, "start": f"3 * (1 + {_p} % 30)", "node": f"1 + {_p} % 100"}, f"{_p} % 4 = 1")],
    "object_edges": [("orders", {"a": f"3 * (1 + {_o} % 30)", "b": "1 + o_custkey % 60"}, f"{_o} % 5 = 0"), ("part", {"a": _p, "b": f"{_p} + 2"}, f"{_p} % 9 = 1")],
    "trigger_words": [("part", {"rule": _p, "word": "lower(p_name)", "active": f"{_p} % 3 <> 0"}, "true")],
    "attribute_values": [("customer", {"id": _c, "attribute": f"CASE WHEN {_c} % 53 = 0 THEN -1 ELSE {_pid} * 10 + 2 END", "physical": f"concat('P', {_c} % 80, CASE WHEN {_c} % 2 = 0 THEN ' ' ELSE '' END)", "level": f"CASE WHEN {_c} % 41 = 0 THEN 99 WHEN {_pid} % 4 = 0 OR {_c} % 47 = 0 THEN {_pid} * 100 + {_depth} END", "parent": f"CASE WHEN {_pid} % 4 = 0 AND ({_depth} > 1 OR {_c} % 12 = 3) THEN {_c} - 40 END", "status": f"CASE WHEN {_c} % 9 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END", "deleted": f"{_c} % 10 = 3"}, "true")],
    "hierarchy_values": [("customer", {"id": _c, "attribute": f"{_pid} * 10 + 2", "level": f"CASE WHEN {_c} % 41 = 0 THEN 99 ELSE {_pid} * 100 + {_depth} END", "parent": f"CASE WHEN {_depth} > 1 OR {_c} % 12 = 3 THEN {_c} - 40 END"}, f"{_pid} % 4 = 0 AND {_c} % 53 <> 0")],
    "levelled_values": [("customer", {"id": _c, "attribute": f"{_pid} * 10 + 2", "depth": _depth, "level_parent": f"{_pid} * 100 + {_depth} - 1", "parent": f"CASE WHEN {_depth} > 1 THEN {_c} - 40 END"}, f"{_pid} % 4 = 0 AND {_pid} % 24 <> 0 AND {_c} % 41 <> 0 AND {_c} % 53 <> 0")],
    "value_edges": [("customer", {"a": _c, "b": f"CASE WHEN {_c} % 45 = 7 THEN {_c} + 30 ELSE {_c} - 15 END"}, f"{_c} > 15 OR {_c} % 45 = 7")],
    "rules": [("customer", {"id": _c, "code": f"CASE WHEN {_c} % 62 = 0 THEN '' WHEN {_c} % 33 = 0 THEN concat('B', {_c} - 1) ELSE concat('B', {_c}) END", "name": f"CASE WHEN {_c} % 34 = 0 THEN '' ELSE 'rule' END", "mode": f"CASE {_c} % 4 WHEN 0 THEN 'COMPARISON' WHEN 1 THEN 'FILTER' WHEN 2 THEN 'EXISTENCE' ELSE 'COMPOSITE' END", "target_type": f"CASE WHEN {_c} % 4 = 0 AND {_c} % 20 <> 0 THEN 'METRIC' WHEN {_c} % 21 = 0 THEN 'METRIC' ELSE 'ENTITY' END", "target": f"{_c} % 2", "metric": f"CASE WHEN {_c} % 24 = 0 THEN NULL WHEN {_c} % 28 = 0 THEN -5 ELSE {_c} % 190 END", "threshold_source": f"CASE WHEN {_c} % 8 = 0 THEN 'CONSTANT' ELSE 'METRIC_TARGET' END", "threshold": _null(_c, 16, "10"), "ratio": f"CASE WHEN {_c} % 12 = 0 THEN NULL WHEN {_c} % 44 = 0 THEN 0 ELSE 1 END", "entity": f"CASE WHEN {_c} % 13 = 0 THEN NULL ELSE 1 + {_c} % 100 END", "event": f"CASE WHEN {_c} % 14 = 0 THEN NULL WHEN {_c} % 22 = 0 THEN 1 ELSE 3 * (1 + {_c} % 60) END", "opposite": f"CASE WHEN {_c} % 5 = 0 THEN {_c} + 3 WHEN {_c} % 27 = 0 THEN -{_c} END", "status": f"CASE WHEN {_c} % 7 = 0 THEN 'DRAFT' ELSE 'PUBLISHED' END"}, "true")],
    "existence_rules": [("customer", {"id": _c, "event": f"3 * (1 + {_c} % 60)"}, f"{_c} % 4 = 2 AND {_c} % 14 <> 0 AND {_c} % 22 <> 0")],
    "rule_conditions": [("customer", {"rule": _c, "entity": f"1 + {_c} % 100", "attribute": f"(1 + {_c} % 100) * 10 + CASE WHEN {_c} % 25 = 0 THEN 10 ELSE 2 END", "op": f"CASE WHEN {_c} % 10 = 1 THEN 'NOT_NULL' ELSE 'EQ' END", "n_values": f"{_c} % 3"}, f"{_c} % 4 = 1 AND {_c} % 17 <> 0")],
    "rule_components": [("customer", {"rule": _c, "component": f"CASE WHEN {_c} % 23 = 0 THEN {_c} WHEN {_c} % 19 = 0 THEN -{_c} WHEN {_c} % 15 = 0 THEN {_c} - 4 ELSE {_c} - 2 END"}, f"{_c} % 4 = 3 AND {_c} % 26 <> 3")],
    "rule_edges": [("customer", {"a": _c, "b": f"CASE WHEN {_c} % 23 = 0 THEN {_c} ELSE {_c} - 4 END"}, f"{_c} % 4 = 3 AND {_c} > 4")],
}


def model_table(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """The model's tables by name; each file is opened once."""
    opened = cache(lambda source: table(spark, sf_dir, source))

    @cache
    def get(name: str) -> DataFrame:
        parts = [opened(source).where(where).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()]) for source, columns, where in MODEL[name]]
        return reduce(DataFrame.union, parts)

    return get


def _table_sql(name: str) -> str:
    return "(" + " UNION ALL ".join(f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source} WHERE {where}" for source, columns, where in MODEL[name]) + ")"


def check_sql(c: M.Check) -> str:
    """The check for DuckDB: subqueries in place of anti joins, recursion in place of rounds."""
    head, t, o = f"SELECT '{c.code}' AS code, '{c.severity}' AS severity", _table_sql(c.t), _table_sql(c.o) if c.o else ""
    text = lambda e: f"CAST({e} AS VARCHAR)"
    if c.form == "cycle":
        return f"{head}, {text('a')} AS key, '' AS detail FROM (WITH RECURSIVE w(a, b) AS (SELECT a, b FROM {t} UNION SELECT w.a, e.b FROM w JOIN {t} e ON w.b = e.a) SELECT DISTINCT w.a FROM w JOIN w AS l ON w.b = l.a AND l.a = l.b)"
    if c.form == "apart":
        return f"{head}, {text(c.key)} AS key, {text(c.detail)} AS detail FROM {t} t WHERE NOT EXISTS (WITH RECURSIVE w(s, n) AS (SELECT DISTINCT start, start FROM {t} UNION SELECT w.s, e.b FROM w JOIN {o} e ON w.n = e.a) SELECT 1 FROM w WHERE w.s = t.start AND w.n = t.node)"
    if c.form == "twice":
        return f"{head}, {text('k')} AS key, {text('count(*)')} AS detail FROM (SELECT {c.key} AS k FROM {t} WHERE {c.where}) GROUP BY k HAVING count(*) > 1"
    if c.form == "row":
        return f"{head}, {text(c.key)} AS key, {text(c.detail)} AS detail FROM {t} t WHERE {c.where}"
    if c.form == "anti":
        return f"{head}, {text(c.key)} AS key, {text(c.detail)} AS detail FROM {t} t WHERE ({c.where}) AND NOT EXISTS (SELECT 1 FROM {o} o WHERE {c.on})"
    if c.form == "pair":
        return f"SELECT DISTINCT * FROM ({head}, {text(c.key)} AS key, {text(c.detail)} AS detail FROM {t} t JOIN {o} o ON {c.on} WHERE {c.where})"
    return f"{head}, {text(c.key)} AS key, {text('count(*)')} AS detail FROM {t} t, {o} o WHERE ({c.on}) AND ({c.where}) GROUP BY {c.key}"


def _family(name: str) -> None:
    own = [c for c in CHECKS if c.family == name]
    register(f"dq_model_{name}", lambda s, d: M.violations(own, model_table(s, d)), " UNION ALL ".join(f"({check_sql(c)})" for c in own))


FAMILIES = tuple(dict.fromkeys(c.family for c in CHECKS))
for _name in FAMILIES:
    _family(_name)
_all = " UNION ALL ".join(f"({check_sql(c)})" for c in CHECKS)
register(
    "dq_model_gate", lambda s, d: M.gate_of(CHECKS, model_table(s, d)),
    f"SELECT count(*) FILTER (severity = 'BLOCKER') AS n_blockers, count(*) FILTER (severity <> 'BLOCKER') AS n_warnings, count(DISTINCT code) AS n_codes, count(*) FILTER (severity = 'BLOCKER') = 0 AS publishable FROM ({_all})",
)
