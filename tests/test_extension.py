"""Sources behind sockets, exchangeable steps, cursors, ranges, and closures of any depth."""

import json
import random
import socketserver
import statistics
import sys
import threading
from datetime import date
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from velarium.functions import scalar, timex
from velarium.operators import evidence, flows, hierarchy, joins, metrics, modelcheck, paging, projection, ranking, sqlprofile
from velarium.plans import pipeline
from velarium.plans.model import Attribute, Object
from velarium.sources import adapters, registry, store
from velarium.streaming import streams

KEYS = {f"k{i}": f"v{i}" for i in range(2500)} | {"h1": {"a": "1"}}


class FakeRedis(socketserver.StreamRequestHandler):
    def handle(self):
        while line := self.rfile.readline():
            words = []
            for _ in range(int(line[1:])):
                size = int(self.rfile.readline()[1:])
                words.append(self.rfile.read(size + 2)[:-2].decode())
            bulk = lambda s: f"${len(s.encode())}\r\n{s}\r\n"
            if words[0] == "SELECT":
                out = "+OK\r\n"
            elif words[0] == "SCAN":
                found, at = [k for k in KEYS if k.startswith(words[3][:-1])], int(words[1])
                part, after = found[at : at + 1000], at + 1000 if at + 1000 < len(found) else 0
                out = f"*2\r\n{bulk(str(after))}*{len(part)}\r\n" + "".join(map(bulk, part))
            elif words[0] == "TYPE":
                out = "+hash\r\n" if words[1][0] == "h" else "+string\r\n"
            elif words[0] == "GET":
                out = bulk(KEYS[words[1]])
            else:
                out = "*2\r\n" + bulk("a") + bulk("1")
            self.wfile.write(out.encode())


class FakeHttp(BaseHTTPRequestHandler):
    nodes = [{"n": i} for i in range(25)]

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if "statements" in body:
            words = body["statements"][0]["statement"].split()
            rows = [[len(self.nodes)]] if "count(*)" in words else [[n] for n in self.nodes[int(words[words.index("SKIP") + 1]) :][: int(words[words.index("LIMIT") + 1])]]
            out = {"results": [{"data": [{"row": r} for r in rows]}], "errors": []}
        else:
            part = body["slice"]["id"] if "slice" in body else int(body["scroll_id"].split(":")[0])
            done = 0 if "slice" in body else int(body["scroll_id"].split(":")[1])
            own = [n for n in self.nodes if n["n"] % 2 == part][done : done + 5]
            out = {"_scroll_id": f"{part}:{done + 5}", "hits": {"hits": [{"_id": str(n["n"]), "_source": n} for n in own]}}
        data = json.dumps(out).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture
def served():
    servers = [socketserver.ThreadingTCPServer(("127.0.0.1", 0), FakeRedis), HTTPServer(("127.0.0.1", 0), FakeHttp)]
    for s in servers:
        threading.Thread(target=s.serve_forever, daemon=True).start()
    yield [s.server_address[1] for s in servers]
    for s in servers:
        s.shutdown()
        s.server_close()


def active(*args):
    return registry.Connection(*args).advance("TESTED").advance("DISCOVERED").advance("ACTIVE")


def test_sources_behind_sockets(spark, served):
    adapters.register(spark)
    redis = active("r", "redis", {"address": f"127.0.0.1:{served[0]}", "database": "0", "prefixes": "k1,k2,h"})
    assert adapters.check(spark, redis) == [] and adapters.check(spark, registry.Connection("x", "redis", {"address": "127.0.0.1:1", "database": "0"}))
    rows = registry.read(spark, redis)
    assert rows.rdd.getNumPartitions() == 3
    assert {r.key: r.value for r in rows.collect()} == {k: v if isinstance(v, str) else json.dumps(v) for k, v in KEYS.items() if k[:2] in ("k1", "k2", "h1")}
    graph = active("g", "property_graph", {"address": f"http://127.0.0.1:{served[1]}/tx", "match": "MATCH (n)", "return": "n", "order": "id(n)", "page": "4", "parts": "3"})
    assert sorted(json.loads(r.row)[0]["n"] for r in registry.read(spark, graph).collect()) == list(range(25))
    search = active("s", "elasticsearch", {"address": f"http://127.0.0.1:{served[1]}", "page": "5"})
    assert sorted(int(r.id) for r in registry.read(spark, search, "docs").collect()) == list(range(25))


def test_discover_and_capture(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(3).withColumn("v", F.lit(name)).write.parquet(f"{tmp_path}/{name}")
    c = active("p", "parquet", {"path": str(tmp_path)})
    assert adapters.check(spark, c) == [] and adapters.discover(spark, c) == ["a", "b"]
    one = {r.item: (r.n, r.fingerprint) for r in adapters.capture(spark, c, ["*"]).collect()}
    assert {k: v[0] for k, v in one.items()} == {"a": 3, "b": 3} and one["a"][1] != one["b"][1]
    spark.read.parquet(f"{tmp_path}/a").orderBy(F.desc("id")).write.parquet(f"{tmp_path}/c")
    again = {r.item: r.fingerprint for r in adapters.capture(spark, c, ["a", "c"]).collect()}
    assert again["a"] == again["c"] == one["a"][1] and adapters.capture(spark, c, ["z"]).collect() == []


def test_jdbc(spark):
    url = "jdbc:derby:memory:velarium;create=true"
    spark.range(50).select("id", (F.col("id") % 7).alias("k")).write.jdbc(url, "T", mode="overwrite")
    c = active("d", "jdbc", {"url": url, "catalog_query": "SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'", "partitionColumn": "ID", "lowerBound": 0, "upperBound": 50, "numPartitions": 5})
    assert adapters.discover(spark, c) == ["T"]
    rows = registry.read(spark, c, "T")
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 50


def test_store(spark, tmp_path):
    df = spark.range(10).select(F.col("id").cast("string").alias("k"))
    store.publish(df, f"{tmp_path}/x")
    assert spark.read.parquet(f"{tmp_path}/x").count() == 10 and [p.name for p in tmp_path.iterdir()] == ["x"]
    with pytest.raises(FileExistsError):
        store.publish(df, f"{tmp_path}/x")
    assert store.compare_and_set(spark, f"{tmp_path}/v", 0, df) == 1
    with pytest.raises(FileExistsError):
        store.compare_and_set(spark, f"{tmp_path}/v", 0, df)
    numbered = store.batches(spark.range(0, 2500, 1, 1), 1000).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in numbered) == [500, 1000, 1000]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("x")
    (tmp_path / "src" / "b.txt").write_text("")
    (tmp_path / "src" / "c.bin").write_text("x")
    found = {r.path.rpartition("/")[2]: (r.bytes, r.issue) for r in store.scan_directory(spark, f"{tmp_path}/src", "*.txt").collect()}
    assert found == {"a.txt": (1, None)}
    xml = [("<a>1</a>", None), ("<!doctype a><a/>", "DOCTYPE"), ('<a><!ENTITY x "y"></a>', "ENTITY_OR_INCLUDE"), ("<a><b></a", "UNCLOSED"), ("", "EMPTY"), (None, "EMPTY"), ("x", "NOT_XML"), ("<?xml version='1.0'?><!-- c --><a/>", None)]
    assert [r.rejected for r in store.admit_xml(spark.createDataFrame([(x,) for x, _ in xml], "x string").coalesce(1), "x").collect()] == [w for _, w in xml]


def test_steps_and_tools(spark):
    run = pipeline.Pipeline(lambda d: d.select((F.col("id") * 2).alias("id")), lambda d: d.where("id > 4"), lambda d: d.withColumn("k", F.lit(1)), lambda d: d.groupBy("k").count()).run(spark.range(5))
    assert run["reconcile"].count() == 2 and run["publish"].first()["count"] == 2

    class Bodies:
        def page(self, after, size):
            return paging.keyset(spark.range(10), ["id"], size, (after,))

        def load(self, refs):
            return refs.select("id", F.concat(F.lit("b"), "id").alias("body"))

    assert sorted(r.body for r in pipeline.Review(Bodies(), Bodies()).read(3, 2).collect()) == ["b4", "b5"]
    tool = [sys.executable, "-c", "import sys, json\nfor l in sys.stdin:\n    r = json.loads(l)\n    print(json.dumps({'id': r['id'], 'n': len(r['t'])}), flush=True)"]
    got = pipeline.through_process(spark.createDataFrame([(1, "a b"), (2, "")], "id long, t string"), tool, "id long, n int").collect()
    assert sorted(map(tuple, got)) == [(1, 3), (2, 0)]
    with pytest.raises(Exception, match="ended early"):
        pipeline.through_process(spark.range(3), [sys.executable, "-c", "pass"], "id long").collect()


def test_times():
    leap = timex.TimeRule("RECURRING", start=date(2024, 2, 29), end=date(2024, 3, 1))
    assert timex.resolve(leap, date(2025, 6, 1)) == (date(2025, 2, 28), date(2025, 3, 1)) and timex.resolve(leap, date(2028, 1, 1))[0] == date(2028, 2, 29)
    week = timex.from_pattern("last 7 days")
    assert timex.preview(week, date(2025, 1, 7)) == "2025-01-01 to 2025-01-07" and timex.preview(week, date(2025, 1, 7), active=False) == "disabled"
    assert timex.from_pattern("近N天").days == 30 and timex.from_pattern("last N days", n=3).days == 3 and timex.preview(timex.TimeRule("CUSTOM"), date(2025, 1, 1)) == "no period"
    with pytest.raises(ValueError):
        timex.from_pattern("soon")


def test_scalars(spark):
    df = spark.createDataFrame([("http://x/a#Order%20Line:",), ("plain",), ("///",), ("",)], "c string")
    assert [r[0] for r in df.coalesce(1).select(scalar.local_name(F.col("c"))).collect()] == ["Order Line", "plain", "///", ""]
    names = spark.createDataFrame([("salesOrder-Line 2!",), ("_X",), ("Ünit",)], "c string").coalesce(1)
    assert [r[0] for r in names.select(scalar.snake_case(F.col("c"))).collect()] == ["sales_order_line_2", "x", "nit"]


def test_cursors(spark):
    rows = spark.range(95).select("id", (F.col("id") % 3).alias("k"))
    scope, secret = {"run": "a", "filter": "x"}, b"s"
    pages, cursor = [], None
    while True:
        page = paging.read_page(rows, ["k", "id"], secret, scope, 30, cursor)
        pages.append([(r.k, r.id) for r in page.rows.collect()])
        assert page.total == 95 and page.has_more == (len(pages) < 4)
        if not page.has_more:
            break
        cursor = page.after
    assert [r for p in pages for r in p] == sorted((i % 3, i) for i in range(95)) and page.after is None
    back = paging.read_page(rows, ["k", "id"], secret, scope, 30, page.before, backward=True)
    assert [(r.k, r.id) for r in back.rows.collect()] == pages[2] and back.has_more and back.after and back.before
    with pytest.raises(ValueError):
        paging.read_page(rows, ["k", "id"], secret, {**scope, "filter": "y"}, 30, cursor)
    with pytest.raises(ValueError):
        paging.read_page(rows, ["k", "id"], secret, scope, 30, cursor[:-3] + "abc")
    first = paging.offset_page(rows, ["id"], {"q": "a"}, 40)
    last = paging.offset_page(rows, ["id"], {"q": "a"}, 400, paging.offset_page(rows, ["id"], {"q": "a"}, 40, first.after).after)
    assert [r.id for r in last.rows.collect()] == list(range(80, 95)) and last.after is None
    with pytest.raises(ValueError):
        paging.offset_page(rows, ["id"], {"q": "b"}, 40, first.after)
    view = list(range(70))
    assert paging.slide(view, [69, *range(70, 90)], int) == list(range(10, 90)) and paging.slide(view, [-1, 0], int, forward=False)[:2] == [-1, 0]
    empty = paging.read_page(rows.where("id < 0"), ["id"], secret, scope)
    assert empty.rows.collect() == [] and not empty.has_more and empty.total == 0


def test_places_and_medians(spark):
    rng = random.Random(1)
    data = [(rng.choice("abc"), float(rng.randint(0, 40)) if rng.random() > 0.1 else None, i) for i in range(3001)] + [(None, 7.0, 9000), (None, 8.0, 9001), ("z", None, 9002)]
    df = spark.createDataFrame(data, "k string, v double, id long").repartition(6)
    placed = ranking.places(df.select("id"), ["id"]).collect()
    assert {r.id: r.place for r in placed} == {i: n + 1 for n, i in enumerate(sorted(i for *_, i in data))}
    want = {k: statistics.median(v for x, v, _ in data if x == k and v is not None) for k in ("a", "b", "c", None)}
    assert {r.k: r.m for r in ranking.medians(df, ["k"], "v", "m").collect()} == want
    assert ranking.medians(df, [], "v", "m").first().m == statistics.median(v for _, v, _ in data if v is not None)
    assert ranking.medians(df.where("id < 0"), ["k"], "v", "m").collect() == []
    plan = ranking.places(df.select("id"), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" in plan and "hashpartitioning(__range" in plan


def test_deep_chains_and_cycles(spark):
    chain = spark.range(60).select((F.col("id") + 1).alias("node"), F.col("id").alias("source"))
    assert {r.root for r in hierarchy.roots(chain, spark.createDataFrame([(60,), (5,)], "node long")).collect()} == {0}
    ring = [(i, (i + 1) % 30) for i in range(30)] + [(100, 3), (7 + 200, 207), (40, 41)]
    edges = spark.createDataFrame(ring, "a long, b long")
    assert {r.node for r in hierarchy.on_cycle(edges).collect()} == {*range(30), 207}
    assert {r.node for r in modelcheck.reaches_cycle(edges).collect()} == {*range(30), 207, 100}
    up = edges.select(F.col("a").alias("node"), F.col("b").alias("source"))
    assert [tuple(r) for r in hierarchy.roots(up, spark.createDataFrame([(1,), (40,)], "node long")).collect()] == [(40, 41)]
    metrics_ = spark.createDataFrame([(i, "e" if i == 0 else None) for i in range(41)] + [(100, None)], "id long, event string")
    refs = spark.createDataFrame([(i, 0, i - 1) for i in range(1, 41)] + [(100, 0, 100)], "metric long, position int, ref long")
    assert {r.id: r.event for r in projection.root_events(metrics_, refs).collect()} == {**{i: "e" for i in range(41)}, 100: None}


def test_claims_compared(spark):
    rows = [(1, "s", "p", "v", "c", None, "SOURCE", 1), (2, "s", "p", "v", "c", "d1", "SOURCE", 1), (3, "s", "p", "w", "c", "d1", "SOURCE", 1), (4, "s", "p", "v", "c", "d2", "SOURCE", 1), (5, "s", "p", "v", "o", "d1", "SOURCE", 1), (6, "t", "p", "v", "c", "d1", "SOURCE", 1), (7, "s", "p", "v", "c", "d1", "FROZEN_RECORD", 1), (8, "s", "p", "v", "c", "d1", "GAP", 1), (9, "s", "p", "v", "c", "d1", "SOURCE", 0)]
    claims = spark.createDataFrame(rows, "id int, subject string, predicate string, value string, scope string, effective string, kind string, n_refs int")
    pairs = spark.createDataFrame([(2, i) for i in (1, 3, 4, 5, 6, 7, 8, 9, 99)], "left_id int, right_id int")
    got = {r.right_id: r.relation for r in evidence.compare(claims, pairs).collect()}
    assert got == {1: "CORROBORATES", 3: "CONFLICTS", 4: "TEMPORAL_DRIFT", 5: "SCOPE_DIFFERENCE", 6: "COMPLEMENTS", 7: "COMPLEMENTS", 8: "UNSUPPORTED", 9: "UNSUPPORTED"}
    said = spark.createDataFrame([("s", "p", "b", 2), ("s", "p", "zz", 2), ("s", "p", "a", 1)], "subject string, predicate string, value string, n long")
    assert evidence.decide(said).first().value == "b"


def test_transforms_and_tables():
    metrics.check_transform("round(l_extendedprice * (1 - l_discount), 2)")
    metrics.check_transform("CASE WHEN a = 'drop table; select' THEN 1 END")
    for bad in ("(SELECT 1)", "reflect('java.lang.System', 'exit')", "a; b", "java_method('x')", "input_file_name()", "a -- b"):
        with pytest.raises(ValueError):
            metrics.check_transform(bad)
    thing = Object("o", "orders", "EVENT", ("k",), (Attribute("k"),), physical=(("warehouse", "dw_orders"), ("lake", "lk_orders")))
    assert metrics.physical_table(thing) == "orders" and metrics.physical_table(thing, ("none", "lake", "warehouse")) == "lk_orders"


def test_model_checks(spark):
    tables = {"t": spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, code string"), "o": spark.createDataFrame([(1,), (1,)], "k int"), "e": spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 5)], "a int, b int")}
    check = lambda *x: sorted((r.key, r.detail) for r in modelcheck.violations_of(modelcheck.Check("C", "BLOCKER", "f", *x), tables).collect())
    assert check("twice", "t", "code", "code IS NOT NULL") == [("a", "2")] and check("row", "t", "t.id", "t.code IS NULL") == [("3", "")]
    assert check("anti", "t", "t.id", "true", "t.code", "o", "t.id = o.k") == [("2", "a"), ("3", None)] or check("anti", "t", "t.id", "true", "coalesce(t.code, '')", "o", "t.id = o.k")
    assert check("pair", "t", "t.id", "true", "t.code", "o", "t.id = o.k") == [("1", "a")] and check("count", "t", "t.id", "true", "", "o", "t.id = o.k") == [("1", "2")]
    assert check("cycle", "e") == [("1", ""), ("2", ""), ("3", "")]
    found = modelcheck.violations([modelcheck.Check("C", "WARNING", "f", "row", "t", "t.id")], tables)
    assert modelcheck.gate(found).first().asDict() == {"n_blockers": 0, "n_warnings": 3, "n_codes": 1, "publishable": True}


def test_required_references(spark):
    left = spark.createDataFrame([(1, 10), (2, None)], "a int, k int")
    right = spark.createDataFrame([(10, "x")], "b int, v string")
    assert sorted((r.a, r.v) for r in joins.require(left, "k", right, "b").collect()) == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="k leads nowhere: 11"):
        joins.require(left.union(spark.createDataFrame([(3, 11)], "a int, k int")), "k", right, "b").collect()


def test_flows(spark):
    s = spark.createDataFrame([(1, 1, "PLAIN", None), (1, 2, "BRANCH", 4), (1, 3, "PLAIN", None), (1, 4, "RETURN", None), (1, 5, "PLAIN", None)], "method int, id int, kind string, target int")
    edges = flows.control_flow(s)
    assert sorted((r.a, r.b, r.kind) for r in edges.collect()) == [(1, 2, "NEXT"), (2, 3, "TRUE"), (2, 4, "FALSE"), (3, 4, "NEXT")]
    assert {r.node: r.disposition for r in flows.dispositions(edges).collect()} == {1: "START", 2: "BRANCH", 3: "LINEAR", 4: "JOIN"}
    assert flows.unsettled(s, s, "id").collect() == []


def test_sql_includes():
    assert sqlprofile.expand("<include refid='a'/>", {"a": "x <include refid=\"b\"/>", "b": "y"}) == ("x y", [])
    assert sqlprofile.expand("<include refid='a'/>", {"a": "<include refid='a'/>"})[1] == ["INCLUDE_CYCLE"]


def test_document_of_another_shape(spark):
    bad = spark.createDataFrame([(1, '{"tables": 5}')], "id int, payload string")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ|malformed"):
        projection.catalog_tables(bad, "id", "payload")["objects"].collect()
