"""Streams in several batches, in any order, and again."""

import random
from datetime import datetime, timedelta

import pytest

from velarium.streaming import streams as S


def write(spark, path, rows, files):
    """Event files, one after the other."""
    for k in range(files):
        spark.createDataFrame(rows[k::files], S.EVENTS).coalesce(1).write.mode("append").parquet(path)


def machine(spark, path, files, base=None):
    tail = S.new_tail(spark)
    out = S.run_now(S.state_machine(S.read_events(spark, path, late="400 days", tail=tail, files=files)), "update", ("user_id",), tail, base, S.ROCKSDB)
    return {r.user_id: (r.state, r.n, r.broken) for r in out.collect()}


@pytest.fixture(scope="module")
def events():
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    return [(i, start + timedelta(minutes=rng.randrange(100_000)), rng.randrange(1, 9), rng.choice(("signup", "view", "purchase", "error")), 0.0, "") for i in range(240)]


def expected(rows):
    out = {}
    for _, _, user, kind, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        out[user] = S.follow(*out.get(user, (None, 0, 0)), [kind])
    return out


@pytest.mark.parametrize("files", [1, 3, 12])
def test_state_machine_over_batches_out_of_order(spark, tmp_path, events, files):
    """One file a batch, whose events are of all times."""
    rows = events if files > 1 else sorted(events, reverse=True)
    write(spark, f"{tmp_path}/e", rows, files)
    assert machine(spark, f"{tmp_path}/e", 1) == expected(events)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([(1, "NEW", 1, 0)], "user_id long, state string, n long, broken long")
    sink = S.keep_batch(str(tmp_path))
    for _ in range(3):
        sink(batch, 7)
    assert spark.read.parquet(f"{tmp_path}/out").drop("__batch").collect() == batch.collect()


def test_going_on_from_a_checkpoint(spark, tmp_path, events):
    """What an earlier run took isn't taken again, and its state goes on."""
    path, base = f"{tmp_path}/e", f"{tmp_path}/run"
    early, late = sorted(events, key=lambda r: r[1])[:120], sorted(events, key=lambda r: r[1])[120:]
    tail = S.new_tail(spark)
    stream = lambda: S.state_machine(S.read_events(spark, path, late="1 hour", tail=tail))
    write(spark, path, early, 1)
    first = {r.user_id: r.n + r.broken for r in S.run_now(stream(), "update", ("user_id",), base=base, store=S.ROCKSDB).collect()}
    write(spark, path, late, 1)
    rows = S.run_now(stream(), "update", ("user_id",), tail, base, S.ROCKSDB)
    assert {r.user_id: (r.state, r.n, r.broken) for r in rows.collect()} == expected(events)
    assert sum(first.values()) < sum(r[3] != "error" for r in events)


def test_idle_users_are_forgotten(spark, tmp_path):
    """A user who comes back after the idle time begins anew."""
    path, base, tail = f"{tmp_path}/e", f"{tmp_path}/run", S.new_tail(spark)
    row = lambda i, day, user, kind: (i, datetime(2024, 1, 1) + timedelta(days=day), user, kind, 0.0, "")
    stream = lambda: S.state_machine(S.read_events(spark, path, late="1 day", tail=tail))
    write(spark, path, [row(1, 0, 1, "signup"), row(2, 1, 1, "view")], 1)
    S.run_now(stream(), "update", ("user_id",), base=base, store=S.ROCKSDB)
    for i, day in ((3, 50), (4, 200), (5, 300)):
        write(spark, path, [row(i, day, 2, "error")], 1)
        S.run_now(stream(), "update", ("user_id",), base=base, store=S.ROCKSDB)
    write(spark, path, [row(6, 301, 1, "signup")], 1)
    rows = S.run_now(stream(), "update", ("user_id",), tail, base, S.ROCKSDB)
    assert {r.user_id: (r.state, r.n) for r in rows.collect() if r.user_id == 1} == {1: ("NEW", 1)}


def test_windows_end_after_all_batches(spark, tmp_path, events):
    """The event that ends the log comes after all files, however many batches they take."""
    path, tail = f"{tmp_path}/e", S.new_tail(spark)
    write(spark, path, events, 5)
    out = S.run_now(S.tumbling(S.read_events(spark, path, late="400 days", tail=tail, files=1), "1 day"), tail=tail)
    assert sum(r.n for r in out.collect()) == len(events)


def test_a_batch_of_a_user_is_one_call_to_the_store():
    """However many events it has; times are microseconds, and the timer stands at the earliest."""
    import pandas as pd

    calls = []

    class Handle:
        def getListState(self, *_):
            return self

        getValueState = getListState

        def appendValue(self, value):
            calls.append(value)

        def registerTimer(self, millis):
            calls.append(millis)

    machine = S.InOrder()
    machine.init(Handle())
    parts = [pd.DataFrame({"event_id": [1, 2], "at": [7_000_000, 5_000_999], "event_type": ["view", None]}), pd.DataFrame({"event_id": [3], "at": [6_000_000], "event_type": ["signup"]})]
    assert list(machine.handleInputRows((1,), iter(parts), None)) == []
    assert calls == [([7_000_000, 5_000_999, 6_000_000], [1, 2, 3], ["view", None, "signup"]), 5_000]
