"""Model, formulas, conditions, times, paths, paging, sources and diffs on small cases."""

from collections import Counter
from datetime import date

import pytest

from velarium.functions import formula
from velarium.functions.conditions import combine, compile_condition, parse_list
from velarium.functions.timex import Calendar, TimeRule, resolve, retail_445
from velarium.operators import hierarchy, joins, linediff, paging, quality, rules, sqlprofile
from velarium.operators.metrics import compute
from velarium.plans.catalog import STAR, legal_operators
from velarium.plans.model import Attribute, BasicMetric, CompositeMetric, Condition
from velarium.plans.paths import fans_out, find_path, reachable
from velarium.sources import registry, store

TODAY = date(2026, 7, 19)  # a Sunday


@pytest.mark.parametrize("text,want", [("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("8 / 2 / 2", 2), ("2 × 3 ÷ 4 − 1", 0.5), ("1 - 2 - 3", -4), ("5 / (1 - 1)", None)])
def test_formula(spark, text, want):
    assert spark.range(1).select(formula.to_column(formula.parse(text))).first()[0] == want


@pytest.mark.parametrize("text", ["", "1 +", "1 2", "(1", "1)", "-1", "a / 0", "a $ b", "1 + / 2"])
def test_formula_errors(text):
    with pytest.raises(formula.FormulaError):
        formula.parse(text)


def test_formula_cycles():
    formula.check_cycles({"a": "b + c", "b": "c * 2"})
    with pytest.raises(formula.FormulaError, match="a -> b -> a"):
        formula.check_cycles({"a": "b + 1", "b": "a"})


def test_conditions(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (None, "cd")], "n int, s string")
    count = lambda *c, logic="AND": df.where(combine([Condition(*x) for x in c], logic)).count()
    assert count() == 3 and count(("n", "!=", (1,))) == 1 and count(("n", "NOT_IN", (1,))) == 1
    assert count(("s", "IS_NULL"), ("n", "=", (1,)), logic="OR") == 2
    assert parse_list(" a, ,b,") == ("a", "b")
    for bad in (("n", "~", (1,)), ("n", "BETWEEN", (1,)), ("n", "IN", ()), ("n", "IS_NULL", (1,))):
        with pytest.raises(ValueError):
            compile_condition(Condition(*bad))


@pytest.mark.parametrize(
    "rule,cal,want",
    [
        (TimeRule("OFFSET", "WEEK"), Calendar(), (date(2026, 7, 13), date(2026, 7, 19))),
        (TimeRule("OFFSET", "WEEK", 1), Calendar(), (date(2026, 7, 20), date(2026, 7, 26))),
        (TimeRule("OFFSET", "MONTH", -5), Calendar(), (date(2026, 2, 1), date(2026, 2, 28))),
        (TimeRule("OFFSET", "YEAR"), Calendar(), (date(2026, 1, 1), TODAY)),
        (TimeRule("OFFSET", "QUARTER", 1), Calendar(), (date(2026, 10, 1), date(2026, 12, 31))),
        (TimeRule("OFFSET", "YEAR", -1), Calendar("FISCAL", 7, 20), (date(2024, 7, 20), date(2025, 7, 19))),
        (TimeRule("SINCE_START", "QUARTER"), Calendar("FISCAL", 2, 1), (date(2026, 5, 1), TODAY)),
        (TimeRule("SINCE_START", "WEEK"), Calendar(), None),
        (TimeRule("ROLLING", days=7), Calendar(), (date(2026, 7, 13), TODAY)),
        (TimeRule("CUSTOM"), Calendar(), None),
        (TimeRule("HOLIDAY"), Calendar(), None),
        (TimeRule("RECURRING", start=date(2000, 5, 1), end=date(2000, 5, 7)), Calendar(), (date(2026, 5, 1), date(2026, 5, 7))),
    ],
)
def test_times(rule, cal, want):
    assert resolve(rule, TODAY, cal) == want


def test_rolling_needs_a_day():
    with pytest.raises(ValueError):
        resolve(TimeRule("ROLLING", days=0), TODAY)


def test_retail_calendar(spark):
    rows = retail_445(spark, date(2026, 2, 2), 2).groupBy("fiscal_year", "period").count().collect()
    assert sorted({(r.period, r["count"] // 7) for r in rows}) == [(p, 5 if p % 3 == 0 else 4) for p in range(1, 13)] and len(rows) == 24


def test_paths():
    assert [r.code for r, _ in find_path(STAR, "sales_line", "nation")] == ["line_order", "order_customer", "customer_nation"]
    assert [r.code for r, _ in find_path(STAR, "sales_line", "nation", "supplier_nation")] == ["line_supplier", "supplier_nation"]
    assert reachable(STAR, "customer") == {"customer", "nation", "region"}
    assert not any(fans_out(s) for s in find_path(STAR, "order", "region"))
    with pytest.raises(ValueError):
        find_path(STAR, "activity", "part")


def test_metrics_are_checked(spark, sf):
    for bad in (BasicMetric("m", "customer", "SUM", "c_name"), BasicMetric("m", "sales_line", "SUM", "l_discount")):
        with pytest.raises(ValueError):
            compute(spark, sf, [bad])
    assert "SUM" in legal_operators(Attribute("x", "AMOUNT")) and legal_operators(Attribute("x", "ID")) == ("COUNT", "COUNT_DISTINCT")
    row = compute(spark, sf, [BasicMetric("n", "order", "COUNT"), BasicMetric("k", "activity", "COUNT"), CompositeMetric("r", "n / (k - k)")]).first()
    assert row.n > 0 and row.k > 0 and row.r is None


def test_sums_keep_apart(spark, sf):
    from velarium.queries.metrics import _stock

    stock = _stock()
    for bad, dimensions in ((("age",), ()), (("months",), ()), (("months",), ("customer.c_mktsegment",))):
        with pytest.raises(ValueError, match="isn't (summed across o_custkey|allowed on age|summed)"):
            compute(spark, sf, [BasicMetric("m", "order", "SUM", *bad)], dimensions, catalog=stock)
    # Without dimensions, and over a period that has nothing, whose states are NULL.
    metrics = [BasicMetric("s", "order", "SUM", "stock"), BasicMetric("top", "order", "MAX", "stock"), BasicMetric("n", "order", "COUNT")]
    row = compute(spark, sf, metrics, catalog=stock).first()
    orders = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("date_trunc('MONTH', o_orderdate) AS m", "o_totalprice AS v").toPandas()
    assert row.s == pytest.approx(orders[orders.m == orders.m.max()].v.sum()) and row.top == orders.v.max() and row.n == len(orders)
    assert tuple(compute(spark, sf, metrics, period=(date(1900, 1, 1), date(1900, 1, 2)), catalog=stock).first()) == (None, None, 0)


def test_plan_of_the_flagship(spark, sf):
    from velarium.queries.metrics import flagship

    plan = flagship(spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan and "PushedFilters: [IsNotNull(c_mktsegment)" in plan
    assert "o_orderpriority" not in plan.split("== Physical Plan ==")[1]


def test_flagship_golden(spark, sf):
    from velarium.queries.metrics import flagship

    rows = flagship(spark, sf).collect()
    assert sum(r.order_count for r in rows) == 66 and round(sum(r.order_amount for r in rows), 2) == 14302245.02


def test_cursors():
    token = paging.sign_cursor(b"k", {"run": 1}, ["a", 2])
    assert paging.read_cursor(b"k", {"run": 1}, token) == ["a", 2]
    for secret, scope, text in ((b"x", {"run": 1}, token), (b"k", {"run": 2}, token), (b"k", {"run": 1}, token[:-2] + "zz"), (b"k", {"run": 1}, "")):
        with pytest.raises(ValueError):
            paging.read_cursor(secret, scope, text)


def test_keyset_pages_cover_all(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(25)], "a int, b int")
    seen, after = [], None
    while rows := paging.keyset(df, ["a", "b"], 10, after=after).collect():
        seen += [tuple(r) for r in rows]
        after = seen[-1]
    assert seen == sorted((i % 3, i) for i in range(25))
    assert paging.page(df, ["b"], 99, 10).count() == 5


def test_as_of_overlap_and_containment(spark):
    left = spark.createDataFrame([("a", date(2026, 1, 5)), ("a", date(2025, 1, 1)), ("b", date(2026, 1, 1))], "g string, d date")
    right = spark.createDataFrame([("a", date(2026, 1, 1), 1), ("a", date(2026, 1, 5), 2), ("a", date(2026, 2, 1), 3)], "g string, e date, v int")
    for way in (joins.as_of, joins.as_of_sorted):
        assert sorted(((r.g, r.d, r.v) for r in way(left, right, "g", "d", "e", ["v"]).collect()), key=str) == [("a", date(2025, 1, 1), None), ("a", date(2026, 1, 5), 2), ("b", date(2026, 1, 1), None)]
    spans = [(i, "m", date(2026, 1, 1 + i), date(2026, 1, 1 + i + i % 9)) for i in range(20)]
    df = spark.createDataFrame(spans, "k int, g string, s date, e date")
    got = sorted((r.a, r.b) for r in joins.overlaps(df, "k", "g", "s", "e").collect())
    assert got == [(a[0], b[0]) for a in spans for b in spans if a[0] < b[0] and a[2] <= b[3] and a[3] >= b[2]]


def test_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "y"), (4, "w")], "k int, v string")
    assert {r.k: r.change for r in joins.diff(a, b, ["k"]).collect()} == {1: "REMOVED", 2: "UNCHANGED", 3: "MODIFIED", 4: "ADDED"}
    assert [tuple(r) for r in joins.diff_fields(a, b, "k").collect()] == [(3, "v", "z", "y")]


def test_line_diff():
    got = list(linediff.compare("a b c d".split(), "a x c d e".split()))
    assert got == [("UNCHANGED", "a"), ("REMOVED", "b"), ("ADDED", "x"), ("UNCHANGED", "c"), ("UNCHANGED", "d"), ("ADDED", "e")]
    assert list(linediff.compare([], [])) == [] and [c for c, _ in linediff.compare(["a"], ["b"])] == ["REMOVED", "ADDED"]


def test_rules(spark):
    a = spark.createDataFrame([(1, "PASS"), (2, "FAIL"), (3, "UNKNOWN")], "k int, verdict string")
    b = spark.createDataFrame([(1, "FAIL"), (2, "FAIL"), (3, "PASS"), (4, "PASS")], "k int, verdict string")
    run = lambda logic, *f: {r.k: r.verdict for r in rules.combine(list(f), "k", logic).collect()}
    assert run("AND", (a, False), (b, True)) == {1: "PASS", 2: "FAIL", 3: "FAIL", 4: "FAIL"}
    assert run("OR", (a, False), (b, False)) == {1: "PASS", 2: "FAIL", 3: "PASS", 4: "PASS"}
    assert run("NOT", (a, False)) == {1: "FAIL", 2: "PASS", 3: "UNKNOWN"}
    rules.check_mode("FILTER", "ENTITY")
    with pytest.raises(ValueError):
        rules.check_mode("EXISTENCE", "METRIC")


def test_cycles_and_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a long, b long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {r.node: r.depth for r in hierarchy.reach(edges, start, 9).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert [r.path for r in hierarchy.walk(edges, start, 9).where("cycle").collect()] == [[1, 2, 3, 1]]


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, ""), (2, None)], "k int, v string")
    assert {tuple(r) for r in quality.missing(df, "M", "k", "v").collect()} == {("M", "1", "v"), ("M", "2", "v")}
    assert [tuple(r) for r in quality.duplicates(df, "D", "k").collect()] == [("D", "1", "2")]
    assert quality.gate(quality.duplicates(df, "D", "k"), ("D",)).first().publishable is False


def test_profile(spark):
    rows = sqlprofile.profile(spark, [("a", "<if test='x'>SELECT 1</if> FROM t WHERE k = #{k}"), ("b", "SELECT a FROM ("), ("c", "CREATE TABLE t (a INT)")]).collect()
    status = {r.statement: r.status for r in rows}
    assert status == {"a": "PARSED", "b": "UNSUPPORTED", "c": "PARTIAL"}
    assert any(r.kind == "Filter" for r in rows if r.statement == "a")


def test_connections(spark, tmp_path):
    c = registry.Connection("c", "csv", {"path": str(tmp_path)})
    with pytest.raises(ValueError):
        registry.read(spark, c)
    with pytest.raises(ValueError):
        c.advance("ACTIVE")
    spark.range(3).write.csv(str(tmp_path / "x"))
    live = c.advance("TESTED").advance("DISCOVERED").advance("ACTIVE")
    assert registry.read(spark, live, "x", "id long").count() == 3
    with pytest.raises(ValueError, match="options.password"):
        registry.Connection("c", "csv", {"path": "p", "options": {"password": "x"}})
    registry.Connection("c", "csv", {"path": "p", "credential_ref": "vault"})
    with pytest.raises(ValueError, match="lacks port"):
        registry.Connection("m", "mysql", {"host": "h", "database": "d"})
    m = registry.Connection("m", "mysql", {"host": "h", "port": 1, "database": "d"})
    assert registry.options(m, "t")["url"] == "jdbc:mysql://h:1/d" and registry.from_yaml(registry.to_yaml(m)) == m
    newer = registry.Connection("m", "mysql", {"host": "i", "port": 1, "database": "d"}, 2)
    assert registry.preview({"m": m}, [newer, c]) == {"m": "updated", "c": "created"} and registry.preview({"m": newer}, [m]) == {"m": "conflict"}
    assert m.matches({"port": 1}) and not m.matches({"port": 2})
    assert registry.intake_errors([("a", 1)]) == [] and len(registry.intake_errors([("a", 11 << 20)] * 11)) == 13
    assert registry.select_items(["db.a", "db.b"], ["*.a"]) == ["db.a"]


def test_quads(spark, tmp_path):
    (tmp_path / "q.nq").write_text('<a:s> <a:p> "x \\" y"@en <a:g> .\n_:b <a:p> <a:o> .\nnot a quad\n')
    rows = sorted(tuple(r) for r in registry.read_quads(spark, str(tmp_path / "q.nq")).collect())
    assert rows == [("<a:s>", "<a:p>", '"x \\" y"@en', "<a:g>"), ("_:b", "<a:p>", "<a:o>", None)]


def test_content_store(spark, tmp_path):
    s = store.ContentStore(spark, str(tmp_path / "s"))
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "content string")
    refs = s.put(texts)
    s.put(texts)
    assert s.all().count() == 2 and s.get(refs.select("ref")).count() == 2 and s.broken().count() == 0
    spark.createDataFrame([("sha256:0", "c")], "ref string, content string").write.parquet(f"{s.path}/texts/segment=x/folder=0")
    assert s.broken().count() == 1


def test_markdown_and_zip():
    sections = {"Entities": "two\nlines", "Rules": "one"}
    title, back = store.parse_markdown(store.render_markdown("T", sections))
    assert title == "T" and {k: v for k, v in back.items() if v} == sections
    with pytest.raises(ValueError):
        store.parse_markdown("# T\n\n## 1. Overview\n")
    import io
    import zipfile

    data = store.zip_stored({"b": b"2", "a": b"1"})
    assert data == store.zip_stored({"a": b"1", "b": b"2"}) and zipfile.ZipFile(io.BytesIO(data)).read("b") == b"2"


def test_entry_without_llm(spark):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries()) and E.entry(spark).count() > 0


def test_a_key_with_many_pairs_is_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(joins, "PART_PAIRS", 50)
    left = spark.range(60).selectExpr("IF(id % 3 = 0, 7, IF(id = 1, NULL, id)) AS key", "id AS a")
    right = spark.range(80).selectExpr("IF(id % 2 = 0, 7, IF(id = 5, NULL, id)) AS key", "id AS b")
    met = joins.many_to_many(left, right, "key")
    assert met.columns == ["key", "a", "b"] and "part" in met._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, left.join(right, "key").collect()))


def test_tables_of_documents_are_not_broadcast_by_the_size_of_their_files(spark, sf):
    from velarium.queries.projections import documents

    assert "BroadcastHashJoin" not in documents(spark, sf)["relations"]._jdf.queryExecution().executedPlan().toString()


def test_join_using_reads_all_customers(spark, sf):
    import __spark_entry__ as E

    nations = Counter(r.c_nationkey for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_nationkey").collect())
    want = sum(nations[r.s_nationkey] for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_nationkey").collect())
    found = E.queries()["join_using"](spark, sf)
    assert found.count() == want > 0
    assert found.where("c_custkey % 10 <> 0").count() > 0
