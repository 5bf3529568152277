"""Pages over keys with NULL, in both directions, and by an index that reads a range or two."""

import random

import pytest

from velarium.operators import paging

SECRET, SCOPE = b"k", {"run": 1}


def rows_of(seed, n=120):
    rng = random.Random(seed)
    return [(rng.choice([None, None, "a", "b", "é", "Z"]), rng.choice([None, 1.5, 2.0, float("nan")]), i) for i in range(n)]


def ordered(rows, nulls_last):
    def rank(value):
        if value is None:
            return (3,) if nulls_last else (0,)
        return (2,) if value != value else (1, value.encode() if isinstance(value, str) else value)

    return [r[2] for r in sorted(rows, key=lambda r: tuple(map(rank, r)))]


@pytest.mark.parametrize("nulls_last", [False, True])
def test_cursor_pages_lose_no_row(spark, nulls_last):
    rows = [r for r in rows_of(1, 40) if r[1] == r[1]]
    df, keys = spark.createDataFrame(rows, "k string, v double, id int"), ["k", "v", "id"]
    want, cursor, seen = ordered(rows, nulls_last), None, []
    while True:
        page = paging.read_page(df, keys, SECRET, SCOPE, 7, cursor, nulls_last=nulls_last)
        seen.append([r.id for r in page.rows.collect()])
        assert page.has_more == (page.after is not None)
        cursor = page.after
        if not cursor:
            break
    assert sum(seen, []) == want
    cursor, back = page.before, [seen[-1]]
    while cursor:
        page = paging.read_page(df, keys, SECRET, SCOPE, 7, cursor, backward=True, nulls_last=nulls_last)
        back.insert(0, [r.id for r in page.rows.collect()])
        cursor = page.before
    assert sum(back, []) == want


def test_five_rows_of_which_three_have_no_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 3), ("a", 4), ("b", 5)], "k string, id int")
    at, seen = None, []
    while rows := paging.keyset(df, ["k", "id"], 2, after=at).collect():
        seen += [r.id for r in rows]
        at = tuple(rows[-1])
    assert seen == [1, 2, 3, 4, 5]
    assert [r.id for r in paging.keyset(df, ["k", "id"], 9, before=("a", 4)).collect()] == [1, 2, 3]
    assert [r.id for r in paging.keyset(df, ["k", "id"], 9, before=(None, 2), nulls_last=True).collect()] == [4, 5, 1]


@pytest.fixture(scope="module", params=[False, True])
def index(spark, request):
    rows = rows_of(2, 300)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    made = paging.PageIndex.build(spark.createDataFrame(rows, "k string, v double, id int"), ["k", "v", "id"], nulls_last=request.param, ranges=8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return made, ordered(rows, request.param)


def test_every_slice(index):
    made, want = index
    assert made.total == 300 and len(made.ranges) == 8
    for offset, size in ((0, 20), (13, 50), (30, 45), (0, 300), (299, 5), (300, 5), (150, 1)):
        assert [r.id for r in made.slice(offset, size).collect()] == want[offset : offset + size]
    assert [r.id for r in made.page(99, 40).collect()] == want[280:] and [r.id for r in made.page(-1, 40).collect()] == want[:40]


def test_cursors_of_an_index(index):
    made, want = index
    seen, cursor = [], None
    while True:
        page = made.read(SECRET, SCOPE, 50, cursor)
        seen += [r.id for r in page.rows.collect()]
        assert page.total == 300
        cursor = page.after
        if not cursor:
            break
    assert seen == want and not page.has_more
    page = made.read(SECRET, SCOPE, 50, page.before, backward=True)
    assert [r.id for r in page.rows.collect()] == want[200:250] and page.has_more
    last = made.read(SECRET, SCOPE, 30, backward=True)
    assert [r.id for r in last.rows.collect()] == want[270:] and last.after is None
    gone = paging.sign_cursor(SECRET, SCOPE, ["a", 1.5, 999])
    with pytest.raises(paging.CursorExpired):
        made.read(SECRET, SCOPE, 5, gone)


def test_a_late_page_reads_no_more_than_the_first(spark, index):
    """By the scan's own counts: files and rows of one range, or of two where a page lies in both."""
    reopened = paging.PageIndex(spark, index[0].path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    reads = []
    for offset in (0, reopened.before[4], reopened.before[7], reopened.before[5] - 10):
        page = reopened.slice(offset, 20)
        plan = page._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        metrics = plan.collectLeaves().head().metrics()
        reads.append(tuple(metrics.get(m).get().value() for m in ("numFiles", "numOutputRows")))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [files for files, _ in reads] == [1, 1, 1, 2]
    assert max(rows for _, rows in reads) <= 2 * max(r["n"] for r in reopened.ranges)


def test_an_index_of_nothing(spark):
    made = paging.PageIndex.build(spark.createDataFrame([], "k string, id int"), ["k", "id"])
    assert made.total == 0 and made.page(3).count() == 0 and made.read(SECRET, SCOPE).rows.count() == 0 and not made.read(SECRET, SCOPE).has_more
