"""Metrics compiled to one aggregate per event, joined on the dimensions, and formulas over the results.

All basic metrics of one event share one scan and one shuffle; caliber conditions become conditional
aggregates. Dimension tables are joined by the relation graph; whether they are broadcast is left to
Spark, by their size at run time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velarium.functions import formula
from velarium.functions.conditions import combine
from velarium.operators.ranking import medians
from velarium.plans.catalog import STAR, legal_operators
from velarium.plans.model import BasicMetric, Catalog, CompositeMetric, Condition, Object
from velarium.plans.paths import fans_out, find_path
from velarium.session import table


def normalize_operator(name: str) -> str:
    """`$sum` and `SUM` are one."""
    return {"COUNTDISTINCT": "COUNT_DISTINCT"}.get(name.lstrip("$").upper(), name.lstrip("$").upper())


#: Functions that a physical expression may call; others, subqueries and several statements are refused.
ALLOWED = frozenset("abs ceil floor round coalesce nullif ifnull greatest least cast case when then else end and or not in is null between like if concat concat_ws lower upper trim ltrim rtrim length substring substr replace split_part date date_add date_trunc to_date year quarter month day hour datediff unix_timestamp true false interval".split())


_TOKEN = re.compile(r"""(?P<text>'(?:[^'\\]|\\.|'')*')|(?P<quoted>`(?:[^`]|``)*`)|(?P<name>[^\W\d]\w*)|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?)|(?P<other>\S)""", re.S)
#: Words that no scalar expression over columns has.
_FORBIDDEN = frozenset("select from with insert delete update drop reflect java_method try_reflect lateral table values".split())


def check_transform(expression: str) -> None:
    """Refuses what isn't a scalar expression over columns, literals, operators and ALLOWED functions.

    It is read token by token, so what stands in a literal or a quoted name is no word of its own. Only a bare name that
    is allowed may stand before a bracket: quoted names, qualified ones and lambdas are refused there.
    """
    before = previous = ""
    for token in _TOKEN.finditer(expression):
        kind, word = token.lastgroup, token[0]
        if word in (";", '"', "$", "@", "#", "{", "}", "[", "]", "?") or word in "'`" and kind == "other" or expression.startswith(("--", "/*", "->", "=>"), token.start()) and kind == "other":
            raise ValueError(f"not a scalar expression: {expression}")
        if kind == "name" and word.lower() in _FORBIDDEN and previous != ".":
            raise ValueError(f"not a scalar expression: {expression}")
        if word == "(" and kind == "other" and previous:
            name = re.fullmatch(r"[^\W\d]\w*", previous)
            if previous.startswith(("`", "'")) or before == "." or name and previous.lower() not in ALLOWED and not re.fullmatch(r"(?i)decimal|varchar|char", previous):
                raise ValueError(f"{previous} isn't allowed in an expression")
        before, previous = previous, word


def physical_table(thing: Object, preferred: tuple[str, ...] = ()) -> str:
    """Of an object's physical tables, that of the first preferred source that it has; else its own."""
    others = dict(thing.physical)
    return next((others[p] for p in preferred if p in others), thing.table)


def scan(spark: SparkSession, sf_dir: str, catalog: Catalog, code: str, prefix: str = "", preferred: tuple[str, ...] = ()) -> DataFrame:
    """An object's attributes, by their transforms, over its physical table. Unused ones are pruned from the scan."""
    thing = catalog.objects[code]
    for a in thing.attributes:
        if a.transform:
            check_transform(a.transform)
    return table(spark, sf_dir, physical_table(thing, preferred)).select(*[(F.expr(a.transform) if a.transform else F.col(a.code)).alias(prefix + a.code) for a in thing.attributes])


def with_dimensions(df: DataFrame, spark: SparkSession, sf_dir: str, catalog: Catalog, event: str, dimensions: Iterable[str]) -> DataFrame:
    """dimensions: `entity.attribute` or `role:entity.attribute`; joined once each, inner if the relation is required, else left."""
    joined = {(): ""}
    for dimension in dimensions:
        role, _, rest = dimension.rpartition(":")
        entity, _, attribute = rest.partition(".")
        path, done = find_path(catalog, event, entity, role), ()
        for step in path:
            relation, back = step
            if fans_out(step):
                raise ValueError(f"{relation.code} would multiply the rows of {event}")
            after = (*done, relation.code)
            if after not in joined:
                prefix = "__".join(after) + "__"
                target = relation.source if back else relation.target
                other = scan(spark, sf_dir, catalog, target, prefix)
                pairs = [(b, a) if back else (a, b) for a, b in relation.on]
                on = [df[joined[done] + a] == other[prefix + b] for a, b in pairs]
                df = df.join(other, on, "inner" if relation.required else "left")
                joined[after] = prefix
            done = after
        df = df.withColumn(dimension_name(dimension), F.col(joined[done] + attribute))
    return df


def dimension_name(dimension: str) -> str:
    role, _, rest = dimension.rpartition(":")
    return (role + "_" if role else "") + rest.partition(".")[2]


def guarded(metric: BasicMetric, catalog: Catalog) -> Column:
    """The metric's input: its attribute (or 1) where its conditions hold, else NULL."""
    if metric.attribute:
        attribute, operator = catalog.objects[metric.event].attribute(metric.attribute), normalize_operator(metric.operator)
        if operator not in legal_operators(attribute):
            raise ValueError(f"{operator} isn't allowed on {attribute.code}")
    for c in metric.conditions:
        if not catalog.objects[metric.event].attribute(c.attribute).filterable:
            raise ValueError(f"{c.attribute} can't be filtered")
    value = F.col(metric.attribute) if metric.attribute else F.lit(1)
    if metric.conditions:
        value = F.when(combine(metric.conditions, metric.logic), value)
    return value


def aggregate(metric: BasicMetric, catalog: Catalog) -> Column:
    """The metric as an aggregate over its event's rows. Medians aren't (see ranking.medians): they need more than a partial state."""
    function = {"SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "COUNT_DISTINCT": F.count_distinct, "MAX": F.max, "MIN": F.min}[normalize_operator(metric.operator)]
    return function(guarded(metric, catalog)).alias(metric.code)


def check_sums(metrics: Iterable[BasicMetric], names: Iterable[str], catalog: Catalog) -> None:
    """ValueError where a sum would go across what an attribute keeps apart."""
    for m in metrics:
        if m.attribute and normalize_operator(m.operator) == "SUM":
            attribute = catalog.objects[m.event].attribute(m.attribute)
            if attribute.additivity == "none" and (across := set(attribute.within) - set(names)):
                raise ValueError(f"{attribute.code} isn't summed across {', '.join(sorted(across))}")


def of_latest(metric: BasicMetric, catalog: Catalog) -> bool:
    """Whether a metric sums what is a state at a time, so that only its event's latest time counts."""
    thing = catalog.objects[metric.event]
    return bool(metric.attribute and thing.default_time) and normalize_operator(metric.operator) == "SUM" and thing.attribute(metric.attribute).additivity == "semi"


def compute(
    spark: SparkSession, sf_dir: str, metrics: Iterable[BasicMetric | CompositeMetric], dimensions: tuple[str, ...] = (), period: tuple[date, date] | None = None,
    where: tuple[Condition, ...] = (), catalog: Catalog = STAR, keep: Iterable[str] | None = None,
) -> DataFrame:
    """A row for each combination of dimensions; metrics of events that lack one are NULL there. where: conditions over dimensions' names.

    Sums of semi-additive attributes of an event are those at its latest time in the period, whatever the conditions;
    a group without rows then has NULL.
    """
    metrics = list(metrics)
    basic = [m for m in metrics if isinstance(m, BasicMetric)]
    composite = {m.code: m.formula for m in metrics if isinstance(m, CompositeMetric)}
    formula.check_cycles(composite)
    names, out = [dimension_name(d) for d in dimensions], None
    check_sums(basic, names, catalog)
    for event in dict.fromkeys(m.event for m in basic):
        df = scan(spark, sf_dir, catalog, event)
        if period:
            time = F.col(catalog.objects[event].default_time)
            df = df.where((time >= F.lit(period[0])) & (time < F.lit(period[1] + timedelta(days=1))))
        scanned, df = df, with_dimensions(df, spark, sf_dir, catalog, event, dimensions).where(combine(where))
        own = [m for m in basic if m.event == event]
        ranked = [m for m in own if normalize_operator(m.operator) == "MEDIAN"]
        states = [m for m in own if of_latest(m, catalog)]
        apart = [*ranked, *states]
        part = df.groupBy(*names).agg(*[aggregate(m, catalog) for m in own if m not in apart], *([F.count(F.lit(1)).alias("__rows")] if apart else []))
        if states:
            at = catalog.objects[event].default_time
            last = scanned.agg(F.max(at).alias("__last"))  # one row
            found = df.join(F.broadcast(last), F.col(at) == F.col("__last")).groupBy(*names).agg(*[aggregate(m, catalog) for m in states])
            part = join_on_keys(part, found, names) if names else part.join(F.broadcast(found), F.lit(True), "left")  # one row each
        for m in ranked:
            found = medians(df.withColumn("__value", guarded(m, catalog)), names, "__value", m.code)
            part = join_on_keys(part, found, names) if names else part.join(F.broadcast(found), F.lit(True), "left")  # one row each
        if apart:
            part = part.drop("__rows")
        if out is None:
            out = part
        elif names:
            out = join_on_keys(out, part, names)
        else:
            out = out.crossJoin(part)  # one row each
    trees = {code: formula.parse(text) for code, text in composite.items()}

    def inlined(code: str) -> Column:
        return formula.to_column(trees[code], inlined) if code in trees else F.col(code)

    out = out.select("*", *[inlined(code).alias(code) for code in trees])
    return out.select(*names, *(keep or [m.code for m in metrics]))


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer on keys, where NULL equals NULL."""
    other = right.toDF(*[f"__{c}" for c in right.columns])
    on = [left[k].eqNullSafe(other[f"__{k}"]) for k in keys]
    joined = left.join(other, on, "full_outer")
    return joined.select(*[F.coalesce(left[k], other[f"__{k}"]).alias(k) for k in keys], *[c for c in left.columns if c not in keys], *[F.col(f"__{c}").alias(c) for c in right.columns if c not in keys])


def latest_snapshot(df: DataFrame, time: str, value: str, keys: tuple[str, ...] = (), period: tuple[date, date] | None = None, per_key: bool = False) -> DataFrame:
    """Semi-additive: the sum at the latest time in the period, over all rows; per_key: at each key's own latest time."""
    if period:
        df = df.where(F.col(time).between(F.lit(period[0]), F.lit(period[1])))
    rows = df.groupBy(*keys, time).agg(F.sum(value).alias("v"))
    if per_key:
        return rows.groupBy(*keys).agg(F.max_by("v", time).alias(value), F.max(time).alias(time))
    last = rows.agg(F.max(time).alias("__last"))
    return rows.join(F.broadcast(last), rows[time] == last["__last"]).select(*keys, F.col("v").alias(value), time)  # one row
