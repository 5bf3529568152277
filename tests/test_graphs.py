"""Components, roots, includes and data flow against plain algorithms."""

import random

import pytest
from pyspark.sql import functions as F

from velarium.operators import components as C
from velarium.operators import fixpoint, flows


def reachable(n, edges):
    reach = {v: {v} for v in range(n)}
    while True:
        before = sum(map(len, reach.values()))
        for a, b in edges:
            reach[a] |= reach[b]
        if sum(map(len, reach.values())) == before:
            return reach


def ring(*nodes):
    return list(zip(nodes, [*nodes[1:], nodes[0]]))


GRAPHS = {
    "sparse": (12, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (7, 7), (8, 9), (9, 8), (9, 10)]),
    "rings and runs": (40, [*ring(*range(10)), *ring(10, 11), (12, 13), (13, 14), *ring(20, 21, 22, 23), (21, 30), (30, 31), (31, 20), (31, 32), (32, 33)]),
    "long ways with ways back": (160, [e for k in range(3, 150, 10) for e in ((k, k + 10), (k, 2 * k % 17))] + [(k, 2 * k % 17) for k in range(17)]),
    "trees on rings and back": (60, [*ring(0, 1, 2, 3), *((k // 2, k) for k in range(8, 40)), (37, 9), (39, 4), (4, 2), *ring(50, 51, 52), (52, 53), (53, 54), (54, 55)]),
    "thin": (60, [(random.Random(k).randrange(60), random.Random(k + 900).randrange(60)) for k in range(75)]),
    "dense": (15, [(random.Random(k).randrange(15), random.Random(k + 500).randrange(15)) for k in range(45)]),
}


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_components(spark, name):
    n, edges = GRAPHS[name]
    df = spark.createDataFrame(edges, "a int, b int")
    reach, nodes = reachable(n, edges), {x for e in edges for x in e}
    found = {r.node: r.component for r in C.strong_components(df).collect()}
    assert set(found) == nodes
    assert all((found[a] == found[b]) == (b in reach[a] and a in reach[b]) for a in nodes for b in nodes)
    condensed = {(r.a, r.b) for r in C.condense(df, spark.createDataFrame(list(found.items()), "node int, component int")).collect()}
    assert condensed == {(found[a], found[b]) for a, b in edges if found[a] != found[b]}
    assert {r.node for r in C.on_cycle(df).collect()} == {v for v in nodes if any(v in reach[b] for a, b in edges if a == v)}
    starts = {a for a, _ in edges}
    pairs = {(r.node, r.root) for r in C.roots(df.toDF("node", "source"), spark.range(n).toDF("node")).collect()}
    assert pairs == {(v, r) for v in range(n) for r in reach[v] if r not in starts}


def test_roots_of_a_layered_diamond(spark, monkeypatch):
    """30 layers of two nodes, each from both of the layer before: 2**30 ways, and as many rows as answers."""
    edges = [(2 * k + i, 2 * k - 2 + j) for k in range(1, 30) for i in range(2) for j in range(2)]
    sizes = []
    plain = C.closure
    monkeypatch.setattr(C, "closure", lambda *a, **k: sizes.append((out := plain(*a, **k)).count()) or out)
    found = C.roots(spark.createDataFrame(edges, "node int, source int"), spark.range(60).toDF("node")).collect()
    assert sorted((r.node, r.root) for r in found) == sorted({(v, r) for v in range(2, 60) for r in (0, 1)} | {(0, 0), (1, 1)})
    assert sizes == [118]


def test_long_runs_are_skipped(spark, monkeypatch):
    written = []
    plain = fixpoint.materialize
    monkeypatch.setattr(fixpoint, "materialize", lambda *a: written.append(1) or plain(*a))
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 300)], "node int, source int")
    assert {r.root for r in C.roots(chain, spark.createDataFrame([(299,), (7,)], "node int")).collect()} == {0}
    assert len(written) < 16


def test_long_ways_with_ways_back_take_few_rounds(spark, monkeypatch):
    """Each node of a way of 400 has a way back to its start too, so no run of single ways is to be skipped."""
    written = []
    plain = fixpoint.materialize
    for module in (fixpoint, C):
        monkeypatch.setattr(module, "materialize", lambda *a: written.append(1) or plain(*a))
    found = C.strong_components(spark.createDataFrame([e for k in range(400) for e in ((k, k + 1), (k, 0))], "a int, b int")).collect()
    assert len({r.component for r in found if r.node < 400}) == 1 and len(found) == 401
    assert len(written) < 80


def test_follow(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (4, 5), (5, 6), (6, 5), (7, 7), (8, 9)], "a int, b int")
    assert {r.a: (r.end, r.steps if r.end else None) for r in fixpoint.follow(links, []).collect()} == {1: (9, 3), 2: (9, 2), 3: (9, 1), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None), 8: (9, 1)}
    assert fixpoint.follow(links.where("a > 99"), []).collect() == []


def test_closure_keeps_nulls(spark):
    start = spark.createDataFrame([(None, 1), (1, 1)], "k int, n int")
    found = fixpoint.closure(start, lambda rows: rows.where("n < 4").selectExpr("k", "n + 1 AS n"))
    assert sorted((r.k or 0, r.n) for r in found.collect()) == [(k, n) for k in (0, 1) for n in (1, 2, 3, 4)]


def resolve_plainly(fragments, includes, key):
    """Depth first, in the order of the includes."""
    counts = {k: fragments.count(k) for k in fragments}

    def of(key, visiting, done):
        if key in done:
            return "RESOLVED"
        if key in visiting:
            return "CYCLE"
        if key not in counts:
            return "UNRESOLVED"
        if counts[key] != 1:
            return "AMBIGUOUS"
        for _, target, dynamic in sorted(includes.get(key, []), key=lambda i: i[0]):
            if dynamic:
                return "DYNAMIC_" + dynamic
            found = of(target, visiting | {key}, done)
            if found != "RESOLVED":
                return found
        done.add(key)
        return "RESOLVED"

    return of(key, frozenset(), set())


@pytest.mark.parametrize("seed", [1, 2])
def test_includes(spark, seed):
    rng = random.Random(seed)
    fragments = [k for k in range(40) if k % 9] + [4, 17]
    includes = {k: [(p, rng.randrange(42) if rng.random() < 0.4 else rng.randrange(k, 42), rng.choice([None] * 12 + ["PROPERTY", "REFERENCE"])) for p in range(rng.choice((0, 0, 1, 1, 2)))] for k in range(40)}
    rows = [(k, *i) for k, some in includes.items() for i in some]
    found = C.resolve_includes(spark.createDataFrame([(k,) for k in fragments], "key int"), spark.createDataFrame(rows, "key int, position int, target int, dynamic string"), spark.range(45).selectExpr("CAST(id AS int) AS key"))
    want = {k: resolve_plainly(fragments, includes, k) for k in range(45)}
    assert {r.key: r.status for r in found.collect()} == want and len(set(want.values())) >= 4


def reach_plainly(statements, edges):
    """A work list of definitions at statements."""
    by_id = {s[0]: s for s in statements}
    nexts = {}
    for a, b in edges:
        nexts.setdefault(a, set()).add(b)
    out = set()
    for i, variable, defines, _ in statements:
        if not defines:
            continue
        todo, seen = list(nexts.get(i, ())), set()
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            s = by_id.get(at)
            if s and (s[3] == variable or not s[2] and s[1] == variable):
                out.add((variable, i, at, "ASSIGNMENT" if s[2] else "DEF_USE"))
            if not (s and s[2] and s[1] == variable):
                todo += nexts.get(at, ())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_definitions_over_branches_and_loops(spark, seed):
    rng = random.Random(seed)
    n = 40
    kinds = [rng.choice(["PLAIN"] * 5 + ["BRANCH", "BRANCH", "RETURN"]) for _ in range(n)]
    targets = [rng.randrange(n) if k == "BRANCH" else None for k in kinds]
    writes = [rng.random() < 0.35 for _ in range(n)]
    variables = [rng.choice("xyz") for _ in range(n)]
    sources = [rng.choice("xyz") if d and rng.random() < 0.5 else None for d in writes]
    rows = [(m, i, kinds[i], targets[i], variables[i], writes[i], sources[i], None) for m in (1, 2) for i in range(n)]
    df = spark.createDataFrame(rows, "method int, id int, kind string, target int, variable string, defines boolean, source string, callee int")
    edges = flows.control_flow(df)
    found = [(r.method, r.variable, r.a, r.b, r.kind) for r in flows.data_flow(df, edges).collect()]
    plain = reach_plainly([(i, variables[i], writes[i], sources[i]) for i in range(n)], {(r.a, r.b) for r in edges.where("method = 1").collect()})
    assert sorted(found) == sorted((m, *row) for m in (1, 2) for row in plain)


def test_a_use_behind_a_join_has_both_definitions(spark):
    """1 x=, 2 branch to 4, 3 x=, 4 use: both reach; a use in an endless ring has its own."""
    rows = [(1, 1, "PLAIN", None, "x", True), (1, 2, "BRANCH", 4, "y", False), (1, 3, "PLAIN", None, "x", True), (1, 4, "RETURN", None, "x", False), (2, 1, "PLAIN", None, "x", True), (2, 2, "BRANCH", 1, "x", False)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "method int, id int, kind string, target int, variable string, defines boolean, source string, callee int")
    assert sorted((r.method, r.a, r.b) for r in flows.data_flow(df, flows.control_flow(df)).collect()) == [(1, 1, 4), (1, 3, 4), (2, 1, 2)]


def test_calls_and_arguments(spark):
    rows = [(1, 1, "PLAIN", None, "x", True, None), (1, 2, "CALL", None, "x", False, 2), (1, 3, "PLAIN", None, "x", False, None), (2, 7, "BRANCH", 9, "p", False, None), (2, 8, "RETURN", None, "p", False, None), (2, 9, "PLAIN", None, "p", False, None)]
    df = spark.createDataFrame([(*r[:6], None, r[6]) for r in rows], "method int, id int, kind string, target int, variable string, defines boolean, source string, callee int")
    assert sorted((r.method, r.a, r.callee, r.b, r.kind) for r in flows.call_edges(df).collect()) == [(1, 2, 2, 7, "CALL"), (1, 8, 2, 3, "RETURN"), (1, 9, 2, 3, "RETURN")]
    assert ("x", 2, 7, "ARGUMENT_TO_PARAMETER") in {(r.variable, r.a, r.b, r.kind) for r in flows.data_flow(df, flows.control_flow(df)).collect()}


def test_a_round_of_few_goes_by_broadcast(spark):
    """A long way beside many facts: its rounds' rows go to every task, and neither what is known nor the ways are shuffled for them."""
    ways = spark.range(8).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    start = spark.range(1, 1000).select((-F.col("id")).alias("node")).union(spark.createDataFrame([(0,)], "node long"))
    step = lambda rows: rows.join(ways, F.col("node") == F.col("a")).select(F.col("b").alias("node"))
    sizes = []
    got = fixpoint.closure(start, step, few=lambda rows: sizes.append(rows.count()) or step(rows))
    assert sorted(r.node for r in got.collect()) == list(range(-999, 9))
    assert len(sizes) > 5 and max(sizes) <= 2
