"""Checks of a semantic model that is stored as tables: each gives the rows that break it.

A check is a row of a table: its code and severity, the table it looks at (as `t`), another one (as `o`) with
the condition that joins both, and what makes a row a violation. Checks are compiled together: a table is scanned
once for all checks that look at it, each row becoming a row for each check that it concerns; all pairs of
tables meet in one join by check and key, and all counts are one aggregate. Checks that compare more of two rows than
their keys may have many rows on both sides of a key; they meet apart from the others, once equal rows are one. All
cycles are found in one run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velarium.operators import ranged

SCHEMA = "code string, severity string, key string, detail string"


@dataclass(frozen=True)
class Check:
    """form: `row` (t alone), `anti` (t without an o), `pair` (t with an o), `count` (how many o a t has, if any), `twice` (keys of t that are there more than once), `cycle` (nodes of t (a, b) from which a cycle can be reached), `apart` (t (start, node) where edges o (a, b) don't lead)."""

    code: str
    severity: str
    family: str
    form: str
    t: str
    key: str = ""
    where: str = "true"
    detail: str = "''"
    o: str = ""
    on: str = ""


def reaches_cycle(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node: those from which some way leads to a cycle.

    Ways into nodes that lead nowhere are taken away until there is none; then each way that is left goes on
    for ever. At each round, ways into a node with one way on skip it, so that a run of n such nodes takes
    log n rounds. Each is written to the shared folder.
    """
    from velarium.session import materialize

    edges = materialize(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "cycle")
    while True:
        ahead = edges.groupBy(F.col("a").alias("__x")).agg(F.count(F.lit(1)).alias("__n"), F.min("b").alias("__next"))
        step = materialize(edges.join(ahead, F.col("b") == F.col("__x"), "left").select("a", F.when(F.col("__n") == 1, F.col("__next")).otherwise(F.col("b")).alias("b"), F.col("__n").isNull().alias("ends")), "cycle")
        if step.where("ends").isEmpty():
            return edges.select(F.col("a").alias("node")).distinct()
        edges = step.where("NOT ends").select("a", "b").distinct()


def reachable_pairs(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """edges (a, b), starts (start) -> start, node: all that each start leads to, itself included. New pairs only go on, so cycles end and any depth is followed."""
    from velarium.session import materialize

    front = seen = materialize(starts.select("start", F.col("start").alias("node")).where("start IS NOT NULL").distinct(), "reach")
    while True:
        step = front.join(edges.select("a", "b"), F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        front = materialize(step.join(seen, ["start", "node"], "left_anti"), "reach")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def _out(df: DataFrame, check: Check, key: str, detail: str) -> DataFrame:
    return df.select(F.lit(check.code).alias("code"), F.lit(check.severity).alias("severity"), F.expr(f"CAST({key} AS STRING)").alias("key"), F.expr(f"CAST({detail} AS STRING)").alias("detail"))


def conjuncts(condition: str) -> list[str]:
    """The parts of a condition that are joined by AND outside of parentheses."""
    parts, depth, held = [], 0, []
    for word in re.split(r"(\s+AND\s+|[()])", condition):
        depth += (word == "(") - (word == ")")
        if depth == 0 and word.strip() == "AND":
            parts.append("".join(held).strip())
            held = []
        else:
            held.append(word)
    return [*parts, "".join(held).strip()]


def _sides(text: str) -> set[str]:
    return set(re.findall(r"\b([to])\.\w", text))


@dataclass
class _Plan:
    """A check taken apart: what each side must be, the keys that must be equal, and what is left to ask of a pair."""

    check: Check
    t_where: list[str]
    o_where: list[str]
    keys: list[tuple[str, str]]
    rest: list[str]

    @classmethod
    def of(cls, check: Check) -> _Plan:
        plan = cls(check, [], [], [], [])
        if check.form in ("row", "twice", "anti"):
            plan.t_where.append(check.where)
        asked = (conjuncts(check.on) if check.on else []) + (conjuncts(check.where) if check.form in ("pair", "count") else [])
        for part in asked:
            sides = _sides(part)
            equal = re.fullmatch(r"([to])\.(\w+) = ([to])\.(\w+)", part)
            if equal and sides == {"t", "o"}:
                named = {equal[1]: equal[2], equal[3]: equal[4]}
                plan.keys.append((named["t"], named["o"]))
            elif sides == {"t", "o"}:
                plan.rest.append(part)
            else:
                (plan.o_where if sides == {"o"} else plan.t_where).append(part)
        if check.form == "anti" and any(p in plan.t_where for p in conjuncts(check.on)):
            raise ValueError(f"{check.code}: a condition on t alone belongs to `where`")
        if check.form == "anti" and plan.rest:
            raise ValueError(f"{check.code}: rows without a match can only be told by equal keys")
        return plan

    def shared(self, side: str) -> list[str]:
        """Columns of a side that the rest asks for."""
        return sorted(set(re.findall(rf"\b{side}\.(\w+)", " ".join(self.rest))))


def _stream(side: str, name: str, plans: list[tuple[int, _Plan]], df: DataFrame) -> DataFrame:
    """One scan of a table for all checks that look at it from one side: n (the check), k (its key), and of t: key, detail, of o: detail; numbers and texts for the rest. One expression, as text: a table may have many checks."""
    kinds = dict(df.dtypes)
    rows = []
    for n, plan in plans:
        c = plan.check
        key_of = [pair[0 if side == "t" else 1] for pair in plan.keys]
        k = f"concat({', '.join(f'CAST({side}.{column} AS STRING), char(1)' for column in key_of)})" if key_of else "CAST(NULL AS STRING)"
        if side == "t":
            # Rows without a key match nothing; each gets a key of its own, so that they don't gather in one task.
            k = f"coalesce({k}, concat(char(2), coalesce(CAST({c.key} AS STRING), '')))"
        asked = plan.shared(side)
        texts = [x for x in asked if kinds[x] == "string"]
        numbers = [x for x in asked if x not in texts]
        if any(not re.match(r"tinyint|smallint|int|bigint|date", kinds[x]) for x in numbers):
            raise ValueError(f"{c.code}: only whole numbers, days and texts are compared between tables")
        numbers = ", ".join(f"unix_date({side}.{x})" if kinds[x] == "date" else f"{side}.{x}" for x in numbers)
        detail = c.detail if c.form in ("row", "anti", "pair") and ("o" in _sides(c.detail)) == (side == "o") else "NULL"
        where = " AND ".join(f"({w})" for w in (plan.t_where if side == "t" else plan.o_where)) or "true"
        key = f", 'key', CAST({c.key} AS STRING)" if side == "t" else ""
        fields = f"'n', {n}, 'k', {k}, 'detail', CAST({detail} AS STRING), 'numbers', CAST(array({numbers}) AS ARRAY<BIGINT>), 'texts', CAST(array({', '.join(f'{side}.{x}' for x in texts)}) AS ARRAY<STRING>){key}"
        rows.append(f"CASE WHEN {where} THEN named_struct({fields}) END")
    return df.alias(side).selectExpr(f"explode(filter(array({', '.join(rows)}), x -> x IS NOT NULL)) AS x").select("x.*")


#: Rows of one key on the side of `o` that a task compares with the other side's; more are dealt into parts.
PART_ROWS = 4096


def _rest(n: int, plan: _Plan, kinds: Mapping[str, Mapping[str, str]]) -> str:
    """What is left to ask, over the numbers and texts that both sides brought."""
    text = " AND ".join(f"({p})" for p in plan.rest)
    for side in "to":
        asked = plan.shared(side)
        texts = [x for x in asked if kinds[side][x] == "string"]
        numbers = [x for x in asked if x not in texts]
        for x in asked:
            place = f"{side}.texts[{texts.index(x)}]" if x in texts else f"{side}.numbers[{numbers.index(x)}]"
            text = re.sub(rf"\b{side}\.{x}\b(?!\[)", place, text)
    return f"WHEN {n} THEN {text}"


def _frames(plans: list[tuple[int, _Plan]], get: Callable[[str], DataFrame]) -> dict[str, dict[str, DataFrame]]:
    """The tables of each side, each asked for once."""
    names = {"t": dict.fromkeys(p.check.t for _, p in plans), "o": dict.fromkeys(p.check.o for _, p in plans if p.check.o)}
    return {side: {name: get(name) for name in of} for side, of in names.items()}


def _sided(side: str, plans: list[tuple[int, _Plan]], frames: dict[str, dict[str, DataFrame]]) -> DataFrame | None:
    """The rows of all tables that stand on a side."""
    of: dict[str, list] = {}
    for n, plan in plans:
        if name := getattr(plan.check, side):
            of.setdefault(name, []).append((n, plan))
    return reduce(DataFrame.unionByName, [_stream(side, name, some, frames[side][name]) for name, some in of.items()]) if of else None


def _alike(plans: list[tuple[int, _Plan]]) -> dict[int, int]:
    """Of each check, the first one that asks for the same rows of `o`: these are made and sent once for all of them."""
    first: dict[tuple, int] = {}
    alike = {}
    for n, plan in plans:
        c = plan.check
        detail = c.detail if c.form in ("anti", "pair") and "o" in _sides(c.detail) else ""
        alike[n] = first.setdefault((c.o, *[k for _, k in plan.keys], None, *plan.o_where, None, detail), n)
    return alike


def _pick(n: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), n + 1)


def _compared(checks: list[Check], plans: list[tuple[int, _Plan]], frames: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Checks that compare pairs of rows beyond their keys -> code, severity, key, detail.

    Rows that say the same are one, with their number. Keys with many rows are dealt into parts on the side of `o`, and met
    there by all of `t`, so no task has all pairs of a key. A pair whose detail is of `t` needs only one `o` (a semi join);
    else the pairs are distinct as they are, unless one key or detail has several different rows in its group.
    """
    from velarium.session import materialize

    forms, details = {}, set()
    for n, plan in plans:
        forms.setdefault("count" if plan.check.form == "count" else "semi" if "o" not in _sides(plan.check.detail) else "pair", []).append(n)
    whole = {}
    for side in "to":
        rows = _sided(side, plans, frames)
        whole[side] = materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times")), f"compared-{side}")
    t, o = whole["t"], whole["o"]
    for rows, by in ((t, ["n", "key"]), (o, ["n", "k", "detail"])):
        again = rows.where(F.col("n").isin(forms.get("pair", []))).groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        details |= {r.n for r in again.select("n").distinct().collect()}  # as many as the checks at most
    sizes = o.where("k IS NOT NULL").groupBy("n", "k").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > PART_ROWS)
    sizes = materialize(sizes.select("n", "k", F.ceil(F.col("rows") / PART_ROWS).cast("int").alias("parts")), "compared-sizes")
    if sizes.isEmpty():
        t, o = (rows.withColumn("part", F.lit(0)) for rows in (t, o))
    else:
        o = o.join(sizes, ["n", "k"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("detail", "numbers", "texts"), "parts").cast("int"), F.lit(0))).drop("parts")
        t = t.join(sizes, ["n", "k"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
        # By number: rows are few for the pairs they make, and small shuffles would be merged into few tasks.
        tasks = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        t, o = (rows.repartition(tasks, "n", "k", "part") for rows in (t, o))
    kinds = {side: {name: dict(df.dtypes) for name, df in of.items()} for side, of in frames.items()}
    out = []
    for form, those in forms.items():
        rests = [_rest(n, p, {"t": kinds["t"][p.check.t], "o": kinds["o"][p.check.o]}) for n, p in plans if n in those]
        on = F.expr(f"t.n = o.n AND t.k = o.k AND t.part = o.part AND CASE t.n {' '.join(rests)} END")
        met = t.where(F.col("n").isin(those)).alias("t").join(o.where(F.col("n").isin(those)).hint("merge").alias("o"), on, "left_semi" if form == "semi" else "inner")
        if form == "count":
            found = met.groupBy("t.n", "t.key").agg(F.sum(F.col("t.times") * F.col("o.times")).cast("string").alias("detail"))
        elif form == "semi":
            found = met.select("n", "key", "detail").distinct()
        else:
            found = met.select("t.n", "t.key", "o.detail")
            if details:
                several = F.col("n").isin(sorted(details))
                found = found.where(~several).unionByName(found.where(several).distinct())
        out.append(found.select(_pick(F.col("n"), [c.code for c in checks]).alias("code"), _pick(F.col("n"), [c.severity for c in checks]).alias("severity"), "key", "detail"))
    return reduce(DataFrame.unionByName, out)


def _joined(checks: list[Check], get: Callable[[str], DataFrame]) -> DataFrame:
    """All checks that look at rows and pairs of rows: each table is read once for each side that it stands on, and all meet in one join by check and key, and in one aggregate; but those of _compared."""
    plans = [(n, _Plan.of(c)) for n, c in enumerate(checks)]
    frames = _frames(plans, get)
    wide, plans = [x for x in plans if x[1].rest], [x for x in plans if not x[1].rest]
    if not plans:
        return _compared(checks, wide, frames)
    alike = _alike(plans)
    sides = {"t": plans, "o": [(n, p) for n, p in plans if alike[n] == n]}
    # Nothing is left to ask of a pair, so numbers and texts are empty.
    whole = {side: rows.drop("numbers", "texts") for side in "to" if (rows := _sided(side, sides[side], frames)) is not None}
    forms = [c.form for c in checks]
    t = whole["t"].alias("t")
    form = _pick(F.col("t.n"), forms)
    if "o" in whole:
        # By number: keys are much alike, so shuffles look small and would be merged into few tasks, each of which sorts ten times that.
        tasks = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        t = whole["t"].withColumn("m", _pick(F.col("n"), [alike.get(n, n) for n in range(len(checks))])).repartition(tasks, "m", "k").alias("t")
        o = whole["o"].withColumn("there", F.lit(True)).repartition(tasks, "n", "k")
        # The size of files says little of the rows that checks make of them: guessed by it, all of them would be broadcast.
        met = t.join(o.hint("merge").alias("o"), F.expr("t.m = o.n AND t.k = o.k"), "left")
        met = met.where((form.isin("row", "twice")) | ((form == "anti") & F.col("o.there").isNull()) | (form.isin("pair", "count") & F.col("o.there")))
        detail = F.coalesce("t.detail", "o.detail")
    else:
        met, detail = t, F.col("t.detail")
    counts = met.groupBy(F.col("t.n").alias("n"), F.col("t.key").alias("key"), detail.alias("detail")).agg(F.count(F.lit(1)).alias("rows"))
    form = _pick(F.col("n"), forms)
    counts = counts.where((form != "twice") | (F.col("rows") > 1))
    times = F.when(form.isin("row", "anti"), F.col("rows")).otherwise(F.lit(1).cast("long"))
    each = counts.withColumn("detail", F.when(form.isin("twice", "count"), F.col("rows").cast("string")).otherwise(F.col("detail"))).withColumn("__each", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    found = each.select(_pick(F.col("n"), [c.code for c in checks]).alias("code"), _pick(F.col("n"), [c.severity for c in checks]).alias("severity"), "key", "detail")
    return found.unionByName(_compared(checks, wide, frames)) if wide else found


def _cycles(checks: list[Check], get: Callable[[str], DataFrame]) -> DataFrame:
    """All cycle checks in one run: nodes carry the number of their check."""
    tag = lambda n, c: F.concat(F.lit(f"{n}:"), F.col(c).cast("string")).alias(c)
    edges = reduce(DataFrame.union, [get(c.t).where("a IS NOT NULL AND b IS NOT NULL").select(tag(n, "a"), tag(n, "b")) for n, c in enumerate(checks)])
    n = F.substring_index("node", ":", 1).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), n + 1)
    return reaches_cycle(edges).select(pick([c.code for c in checks]).alias("code"), pick([c.severity for c in checks]).alias("severity"), F.expr("substring(node, instr(node, ':') + 1)").alias("key"), F.lit("").alias("detail"))


def _apart(check: Check, get: Callable[[str], DataFrame]) -> DataFrame:
    t = get(check.t).alias("t")
    pairs = reachable_pairs(get(check.o), t.select("start"))
    return _out(t.where(check.where).join(pairs.alias("o"), F.expr("t.start = o.start AND t.node = o.node"), "left_anti"), check, check.key, check.detail)


def violations(checks: Iterable[Check], tables: Mapping[str, DataFrame] | Callable[[str], DataFrame]) -> DataFrame:
    """code, severity, key, detail of all checks."""
    get = tables if callable(tables) else tables.__getitem__
    checks = list(checks)
    plain = [c for c in checks if c.form not in ("cycle", "apart")]
    rings = [c for c in checks if c.form == "cycle"]
    parts = ([_joined(plain, get)] if plain else []) + ([_cycles(rings, get)] if rings else []) + [_apart(c, get) for c in checks if c.form == "apart"]
    return reduce(DataFrame.unionByName, parts)


def violations_of(check: Check, tables: Mapping[str, DataFrame] | Callable[[str], DataFrame]) -> DataFrame:
    return violations([check], tables)


#: Widest range of values whose places _crossed numbers.
_WIDEST = 1 << 62


def _crossing(plan: _Plan) -> tuple[str, str, str] | None:
    """id, low, high of a check that gives each two rows of a table by their ids, once, where either one's low is at most the other's high; None of any other check."""
    c = plan.check
    parts = [re.fullmatch(r"([to])\.(\w+) (<=?|>=?) ([to])\.(\w+)", p) for p in plan.rest]
    sided = [sorted(re.sub(r"\b[to]\.", "", p) for p in where if _sides(p)) for where in (plan.t_where, plan.o_where)]
    if c.form != "pair" or c.t != c.o or not plan.keys or any(x != y for x, y in plan.keys) or len(parts) != 3 or None in parts or sided[0] != sided[1]:
        return None
    turned = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
    asked = {(m[2], m[3], m[5]) if m[1] == "t" else (m[5], turned[m[3]], m[2]) for m in parts}
    ids = [x for x, op, y in asked if x == y and op in "<>"]
    both = [(x, y) for x, op, y in asked if x != y and op == "<=" and (y, ">=", x) in asked]
    if len(asked) != 3 or len(ids) != 1 or len(both) != 1 or (c.key, c.detail) != (f"t.{ids[0]}", f"o.{ids[0]}"):
        return None
    return ids[0], *both[0]


def _crossed(plan: _Plan, crossing: tuple[str, str, str], df: DataFrame) -> DataFrame | None:
    """rows: how many pairs a check of _crossing gives, of which none is made; None where an id is there twice with different values, so that pairs need not be distinct, or values are too far apart.

    Two rows meet once for each order, and a row meets itself if its low is at most its high. For all others' lows up to a row's
    high, these are numbered from the key's least one; the numbers before a bound are a block for each bit of the bound, and a number
    is in one block of each width. In a block, rows in the order of high, from the largest, are passed by a running sum. So rows are
    as many as different (low, high) of a key by the bits of their range, and a key with all rows is spread over ranges.
    """
    from velarium.session import materialize

    kinds, (own, low, high) = dict(df.dtypes), crossing
    if not all(re.match(r"tinyint|smallint|int|bigint|date", kinds[x]) for x in crossing) or (kinds[low] == "date") != (kinds[high] == "date"):
        return None
    keys = [x for x, _ in plan.keys]
    whole = lambda x: (F.unix_date(x) if kinds[x] == "date" else F.col(x)).cast("long")
    for part in plan.t_where:
        df = df.alias("t").where(part)
    there = " AND ".join(f"{x} IS NOT NULL" for x in (*keys, *crossing))
    rows = materialize(df.where(there).select(F.struct(*keys).alias("k"), F.col(own).alias("id"), whole(low).alias("low"), whole(high).alias("high")).distinct(), "crossed")
    if not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return None
    sorts = materialize(rows.groupBy("k", "low", "high").agg(F.count(F.lit(1)).alias("times")), "crossed")
    spans = sorts.groupBy("k").agg(F.min("low").alias("least"), F.max("low").alias("most"))
    far = spans.agg(F.max(F.expr("CAST(most AS DECIMAL(20, 0)) - CAST(least AS DECIMAL(20, 0))"))).first()[0]
    if far is not None and far >= _WIDEST:
        return None
    sorts = sorts.join(spans, "k").withColumn("bits", F.expr("sequence(0, length(bin(most - least + 1)) - 1)"))
    x, bound = "(low - least)", "CASE WHEN high < least THEN 0 ELSE least(high, most) - least + 1 END"
    lows = sorts.selectExpr("k", f"explode(filter(bits, b -> shiftright({x}, b) % 2 = 0)) AS b", f"{x} AS x", "high AS y", "times AS n", "0L AS asked").withColumn("block", F.expr("shiftright(x, b)"))
    highs = sorts.withColumn("x", F.expr(bound)).selectExpr("k", "explode(filter(bits, b -> shiftright(x, b) % 2 = 1)) AS b", "x", "low AS y", "0L AS n", "times AS asked").withColumn("block", F.expr("shiftright(x, b) - 1"))
    met = lows.unionByName(highs).groupBy("k", "b", "block", F.bitwise_not("y").alias("down")).agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"))
    met = ranged.over(met, ["k", "b", "block"], ["down"], above=("sum", "n")).where("asked > 0").selectExpr("CAST(asked AS DECIMAL(19, 0)) * CAST(above AS DECIMAL(19, 0)) AS pairs")
    itself = sorts.where("low <= high").selectExpr("CAST(-times AS DECIMAL(38, 0)) AS pairs")
    return met.unionByName(itself).agg(F.coalesce(F.expr("CAST(sum(pairs) / 2 AS BIGINT)"), F.lit(0).cast("long")).alias("rows"))


def tallies(checks: Iterable[Check], tables: Mapping[str, DataFrame] | Callable[[str], DataFrame]) -> DataFrame:
    """code, severity, rows: how many violations there are. Those of two rows of a table that cross, which may be as many as pairs of rows, are counted without being made (_crossed)."""
    get = tables if callable(tables) else tables.__getitem__
    counted, others = [], []
    for c in checks:
        found = None
        if c.form == "pair" and (crossing := _crossing(plan := _Plan.of(c))):
            found = _crossed(plan, crossing, get(c.t))
        if found is None:
            others.append(c)
        else:
            counted.append(found.where("rows > 0").select(F.lit(c.code).alias("code"), F.lit(c.severity).alias("severity"), "rows"))
    if others:
        counted.append(_tallied(violations(others, get)))
    return reduce(DataFrame.unionByName, counted)


def _tallied(found: DataFrame) -> DataFrame:
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("rows"))


def _gate(counts: DataFrame) -> DataFrame:
    blocking = F.col("severity") == "BLOCKER"
    number = lambda of: F.coalesce(F.sum(F.when(of, F.col("rows"))), F.lit(0).cast("long"))
    return counts.agg(number(blocking).alias("n_blockers"), number(~blocking).alias("n_warnings"), F.count_distinct("code").alias("n_codes"), (number(blocking) == 0).alias("publishable"))


def gate(found: DataFrame) -> DataFrame:
    """One row: a model may be published if no violation blocks."""
    return _gate(_tallied(found))


def gate_of(checks: Iterable[Check], tables: Mapping[str, DataFrame] | Callable[[str], DataFrame]) -> DataFrame:
    """gate() of all violations of checks, from their numbers."""
    return _gate(tallies(checks, tables))
