"""Checks compiled together against each by itself in plain Python, and how often a table is read."""

import random
from collections import Counter

import pytest

from velarium.operators import metrics, modelcheck
from velarium.operators.modelcheck import Check, conjuncts
from velarium.plans.checks import CHECKS


def test_conditions_are_split_outside_of_parentheses():
    assert conjuncts("t.a = o.b AND (t.c = 1 AND o.d = 2 OR t.e)  AND f(t.x, o.y) > 0") == ["t.a = o.b", "(t.c = 1 AND o.d = 2 OR t.e)", "f(t.x, o.y) > 0"]
    assert conjuncts("true") == ["true"]


@pytest.fixture()
def tables(spark):
    rng = random.Random(9)
    t = [(i, rng.choice([None, 1, 2, 3, 40]), rng.choice(["a", "b", None]), rng.randrange(6)) for i in range(40)] + [(7, 1, "a", 1)]
    o = [(rng.choice([None, 1, 2, 5]), rng.choice(["a", "b"]), rng.randrange(6)) for _ in range(25)]
    frames = {"t": spark.createDataFrame(t, "id int, k int, s string, n int"), "o": spark.createDataFrame(o, "k bigint, s string, n int")}
    return t, o, frames


def test_like_plain_loops(tables):
    t, o, frames = tables
    checks = [
        Check("ROW", "B", "f", "row", "t", "t.id", "t.n > 3", "t.s"),
        Check("TWICE", "B", "f", "twice", "t", "concat_ws('/', k, s)", "n < 5"),
        Check("ANTI", "W", "f", "anti", "t", "t.id", "t.n < 4", "t.k", "o", "t.k = o.k AND o.n > 1"),
        Check("PAIR", "W", "f", "pair", "t", "t.id", "t.n < o.n AND t.s <> o.s", "o.s", "o", "t.k = o.k"),
        Check("TWO", "W", "f", "pair", "t", "t.id", "o.n = t.n", "t.s", "o", "t.k = o.k AND t.s = o.s"),
        Check("COUNT", "B", "f", "count", "t", "t.id", "t.n <> o.n", "", "o", "t.k = o.k"),
        Check("OWN", "B", "f", "pair", "t", "t.id", "t.id < o.id", "'x'", "t", "t.k = o.k AND t.s = o.s"),
    ]
    asked = Counter()

    def get(name):
        asked[name] += 1
        return frames[name]

    found = Counter((r.code, r.key, r.detail) for r in modelcheck.violations(checks, get).collect())
    assert asked == {"t": 2, "o": 1}, "once for each side that a table stands on"
    text = lambda x: None if x is None else str(x)
    want = Counter(("ROW", text(i), s) for i, k, s, n in t if n > 3)
    groups = Counter("/".join(str(x) for x in (k, s) if x is not None) for i, k, s, n in t if n < 5)
    want += Counter({("TWICE", g, str(c)): 1 for g, c in groups.items() if c > 1})
    want += Counter(("ANTI", text(i), text(k)) for i, k, s, n in t if n < 4 and not any(k is not None and k == a and c > 1 for a, b, c in o))
    joined = [(i, k, s, n, b, c) for i, k, s, n in t for a, b, c in o if k is not None and k == a]
    want += Counter(set(("PAIR", text(i), b) for i, k, s, n, b, c in joined if n < c and s is not None and s != b))
    want += Counter(set(("TWO", text(i), s) for i, k, s, n, b, c in joined if n == c and s == b))
    counts = Counter(i for i, k, s, n, b, c in joined if n != c)
    want += Counter({("COUNT", str(i), str(c)): 1 for i, c in counts.items()})
    want += Counter(set(("OWN", text(x[0]), "x") for x in t for y in t if x[1] is not None and x[1] == y[1] and x[2] is not None and x[2] == y[2] and x[0] < y[0]))
    assert found == want


def test_one_join_for_all(spark, tables):
    _, _, frames = tables
    checks = [Check(f"C{k}", "B", "f", form, "t", "t.id", "true", "t.s", "o", "t.k = o.k") for k in range(5) for form in ("anti", "pair")]
    plan = modelcheck.violations(checks, frames)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Generate explode(filter") == 2


def test_what_cant_be_compiled_is_refused(tables):
    _, _, frames = tables
    with pytest.raises(ValueError):
        modelcheck.violations([Check("X", "B", "f", "anti", "t", "t.id", "true", "''", "o", "t.k < o.k")], frames)
    with pytest.raises(ValueError):
        modelcheck.violations([Check("X", "B", "f", "anti", "t", "t.id", "true", "''", "o", "t.k = o.k AND t.n > 1")], frames)
    assert {c.form for c in CHECKS} == {"row", "anti", "pair", "count", "twice", "cycle", "apart"}


def test_expressions_are_read_by_token():
    for good in ("a + 1", "`odd name` * 2", "round(x, 2)", "CASE WHEN a IN ('x(y)', 'it''s') THEN 1 END", "CAST(a AS decimal(10, 2))", "coalesce(t.a, 'select')", "(a + b) / nullif(c, 0)", "substr(a, 1, 2) || 'é'"):
        metrics.check_transform(good)
    for bad in ("`uuid`()", "`raise_error`('x')", "`monotonically_increasing_id` ()", "uuid()", "sys.uuid()", "a; drop table t", "a -- b", "a /* b */", "(SELECT 1)", "transform(a, x -> x)", "'open", "a[0]", "reflect('a')", "\"uuid\"()", "if/**/(a, b, c)"):
        with pytest.raises(ValueError):
            metrics.check_transform(bad)


def test_rows_that_meet_many_are_compared_once_and_in_parts(spark, monkeypatch):
    """3,000 equal rows are one before they meet; a key with many rows is dealt into parts; repeated keys and details stay distinct."""
    monkeypatch.setattr(modelcheck, "PART_ROWS", 16)
    same = spark.range(6000).selectExpr("'x' AS s", "CAST(id % 2 AS INT) AS n", "id AS i")
    some = spark.range(100).selectExpr("id % 90 AS id", "CAST(id % 2 AS INT) AS k", "id AS n", "id % 7 AS m")
    checks = [
        Check("SEMI", "W", "f", "pair", "same", "t.s", "t.n < o.n", "t.s", "same", "t.s = o.s"),
        Check("OF_O", "W", "f", "pair", "some", "t.id", "t.n < o.n", "o.m", "some", "t.k = o.k"),
        Check("COUNT", "B", "f", "count", "some", "t.id", "t.n < o.n", "", "some", "t.k = o.k"),
        Check("PAIRS", "W", "f", "pair", "some", "t.n", "t.n < o.n", "o.n", "some", "t.k = o.k"),
    ]
    found = Counter((r.code, r.key, r.detail) for r in modelcheck.violations(checks, {"same": same, "some": some}).collect())
    rows = [(i % 90, i % 2, i, i % 7) for i in range(100)]
    met = [(x, y) for x in rows for y in rows if x[1] == y[1] and x[2] < y[2]]
    want = Counter({("SEMI", "x", "x"): 1}) + Counter({("OF_O", str(x[0]), str(y[3])) for x, y in met}) + Counter(("PAIRS", str(x[2]), str(y[2])) for x, y in met)
    want += Counter({("COUNT", str(i), str(c)) for i, c in Counter(x[0] for x, _ in met).items()})
    assert found == want


def test_pairs_that_are_distinct_as_they_are_arent_shuffled(spark):
    """Each row has its own key and detail: no aggregate over the pairs, which may be far more than the rows."""
    some = spark.range(100).selectExpr("id", "id % 2 AS k")
    found = modelcheck.violations([Check("P", "W", "f", "pair", "some", "t.id", "t.id < o.id", "o.id", "some", "t.k = o.k")], {"some": some})
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 2 * 50 * 49 // 2


def test_checks_share_rows_and_the_join_keeps_its_parts(spark, tables, monkeypatch):
    """Checks that ask for the same rows of `o` send them once; small shuffles of keys that are much alike aren't merged into few large tasks."""
    _, _, frames = tables
    checks = [
        Check("A", "B", "f", "anti", "t", "t.id", "t.n < 4", "t.k", "o", "t.k = o.k AND o.n > 1"),
        Check("P", "W", "f", "pair", "t", "t.id", "t.n > 2", "t.s", "o", "t.k = o.k AND o.n > 1"),
        Check("N", "W", "f", "count", "t", "t.id", "true", "", "o", "t.n = o.k AND o.n > 1"),
        Check("O", "W", "f", "pair", "t", "t.id", "true", "o.s", "o", "t.k = o.k AND o.n > 1"),
        Check("M", "W", "f", "pair", "t", "t.id", "true", "t.s", "o", "t.k = o.k AND o.n > 2"),
    ]
    sent, stream = [], modelcheck._stream
    monkeypatch.setattr(modelcheck, "_stream", lambda side, name, plans, df: sent.append((side, len(plans))) or stream(side, name, plans, df))
    found = modelcheck.violations(checks, frames)
    assert sent == [("t", 5), ("o", 3)]
    rows = Counter(tuple(r) for r in found.collect())
    assert rows == sum((Counter(tuple(r) for r in modelcheck.violations_of(c, frames).collect()) for c in checks), Counter())
    assert {r[0] for r in rows} == {"A", "P", "N", "O", "M"}
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2


OVERLAP = "t.id < o.id AND t.first <= o.last AND t.last >= o.first"


@pytest.mark.parametrize("spread", [1, 40, 1 << 40])
def test_crossing_pairs_are_counted_without_being_made(spark, monkeypatch, spread):
    """Numbers of pairs like plain loops: NULLs, ends before beginnings, equal rows, and keys of one row."""
    rng = random.Random(spread)
    some = lambda x: None if rng.random() < 0.05 else x
    rows = [(some(i), some(rng.randrange(4)), rng.choice("ab"), some(a := rng.randrange(-10, 10) * spread + rng.randrange(3)), some(a + rng.randrange(-3, 8) * spread)) for i in range(160)]
    rows += rows[:9] + [(1000, 77, "a", 1, 2)]
    df = spark.createDataFrame(rows, "id long, k int, s string, first long, last long")
    checks = [Check("CROSS", "W", "f", "pair", "x", "t.id", OVERLAP, "o.id", "x", "t.k = o.k AND t.s = o.s"), Check("SOME", "BLOCKER", "f", "pair", "x", "t.id", f"{OVERLAP} AND t.s = 'a' AND o.s = 'a'", "o.id", "x", "t.k = o.k"), Check("ROW", "W", "f", "row", "x", "t.id", "t.first > t.last")]
    want = Counter()
    for code, only in (("CROSS", "ab"), ("SOME", "a")):
        want[code] = len({(x[0], y[0]) for x in rows for y in rows if None not in x + y and x[1:3] == y[1:3] and x[2] in only and x[0] < y[0] and x[3] <= y[4] and x[4] >= y[3]})
    want["ROW"] = sum(None not in x[3:] and x[3] > x[4] for x in rows)
    monkeypatch.setattr(modelcheck, "_compared", lambda *_: pytest.fail("pairs were made"))
    assert {r.code: r.rows for r in modelcheck.tallies(checks, {"x": df}).collect()} == want
    gate = modelcheck.gate_of(checks, {"x": df}).first()
    assert tuple(gate) == (want["SOME"], want["CROSS"] + want["ROW"], 3, False)


def test_crossing_pairs_that_need_not_be_distinct_are_made(spark):
    """An id with different values, or values too far apart: as many as violations()."""
    check = Check("CROSS", "W", "f", "pair", "x", "t.id", OVERLAP, "o.id", "x", "t.k = o.k")
    twice = [(i % 20, i % 2, i % 7, i % 7 + 3) for i in range(50)]
    far = [(1, 1, -(1 << 63), 5), (2, 1, (1 << 63) - 1, (1 << 63) - 1), (3, 1, 4, 9)]
    for rows, want in ((twice, None), (far, 1), (far[:0], 0)):
        tables = {"x": spark.createDataFrame(rows, "id long, k int, first long, last long")}
        found = sum(r.rows for r in modelcheck.tallies([check], tables).collect())
        assert found == modelcheck.violations([check], tables).count() and want in (None, found)


def test_the_gate_makes_no_pairs_of_targets(spark, sf, monkeypatch):
    from velarium.queries.modelchecks import model_table

    made, compared = [], modelcheck._compared
    monkeypatch.setattr(modelcheck, "_compared", lambda checks, plans, frames: made.extend(p.check.code for _, p in plans) or compared(checks, plans, frames))
    import __spark_entry__ as E

    found = E.queries()["dq_model_gate"](spark, sf).first()
    assert made and "METRIC_TARGET_OVERLAP" not in made
    every = modelcheck.violations(CHECKS, model_table(spark, sf)).collect()
    blockers = sum(r.severity == "BLOCKER" for r in every)
    assert tuple(found) == (blockers, len(every) - blockers, len({r.code for r in every}), blockers == 0)
