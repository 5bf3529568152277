"""Changes that go through or not, decisions, trees and checks against plain replays in order."""

import hashlib
import random

import pytest
from velarium.operators import evidence, governance, hierarchy
from velarium.operators.fixpoint import trail
from velarium.sources import store


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_trail(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 70)] + [(200, 201), (201, 202), (202, 200), (300, 5), (400, None)], "a int, b int")
    got = rows(trail(links, spark.createDataFrame([(1,), (60,), (200,), (300,)], "node int")))
    want = {n: n - 1 for n in range(1, 71)} | {200: 0, 201: 1, 202: 2, 300: 0}
    for start, first in ((60, 60), (300, 4)):
        for n in range(max(first, 5) if start == 300 else first, 71):
            want[n] = min(want[n], n - 60 if start == 60 else n - 4)
    assert got == sorted(want.items(), key=repr)


@pytest.mark.parametrize("keys", [["hot"], ["a", "b", None, "c"]])
def test_guarded_writes(spark, keys):
    rng = random.Random(len(keys))
    made = [(rng.choice(keys), i, rng.choice([None, *range(-1, 3), *[1 + i // (9 * len(keys)) + rng.randint(-1, 1)] * 8])) for i in range(900)]
    made = [m for m in made if m[0] is not None]
    got = rows(governance.guarded_writes(spark.createDataFrame(made, "key string, seq long, expected int"), "key", "seq", "expected"))
    at, want = {}, []
    for key, seq, expected in made:
        now = at.setdefault(key, 1)
        applied = expected == now
        at[key] = now + applied
        want.append((key, seq, expected, "APPLIED" if applied else "STALE", at[key]))
    assert got == sorted(want, key=repr)
    assert max(at.values()) > 10
    assert rows(governance.guarded_writes(spark.createDataFrame([], "key string, seq long, expected int"), "key", "seq", "expected")) == []


def replay(requests, actions, roles):
    """Action by action, with the state that each leaves."""
    status, revision, published, out = {}, {}, {}, []
    for request, seq, actor, action, decision, expected, reason in sorted(actions, key=lambda a: a[1]):
        if request not in requests:
            continue
        space, author, base = requests[request]
        has = {r for s, a, r in roles if (s, a) == (space, actor)}
        state, rev = status.get(request, "SUBMITTED"), revision.get(request, 1)
        chain = published.setdefault(space, [])
        han = any("㐀" <= c <= "鿿" for c in reason or "")
        if action == "REVIEW":
            good = {"REVIEWER", "ADMIN"}
            wrong = "NOT_OPEN" if state != "SUBMITTED" else None
        else:
            good = {"PUBLISHER", "ADMIN"}
            wrong = "NOT_APPROVED" if state != "APPROVED" else None
        wrong = wrong or ("SELF" if actor == author else "FORBIDDEN" if not has & good else "STALE" if expected != rev else None)
        if not wrong and not han and not (action == "REVIEW" and decision == "APPROVE"):
            wrong = "NO_REASON"
        version = None
        if not wrong:
            revision[request] = rev + 1
            if action == "REVIEW":
                wrong = {"APPROVE": "APPROVED", "REJECT": "REJECTED"}.get(decision, "CHANGES_REQUESTED")
            elif (chain[-1] if chain else None) == base:
                chain.append(request)
                wrong, version = "PUBLISHED", len(chain)
            else:
                wrong = "CONFLICTED"
            status[request] = wrong
        out.append((request, seq, wrong, version))
    return out


def test_review_and_publish(spark):
    rng = random.Random(4)
    roles = [(s, a, r) for s in "xy" for a, r in ((1, "REVIEWER"), (2, "PUBLISHER"), (3, "ADMIN"), (4, "EDITOR"), (4, "EDITOR"))]
    requests, actions, last = {}, [], {"x": [None], "y": [None]}
    for k in range(420):
        space = "x" if k % 3 else "y"
        base = rng.choice([last[space][-1], last[space][-1], last[space][-1], rng.choice(last[space]), k - 1, 9999])
        requests[k] = (space, rng.choice([1, 2, 4, 4, 4, 4]), base)
        reason = lambda: rng.choice(["好", "好", "好", "ok", None])
        for n in range(rng.randint(1, 5)):
            kind = rng.choice(["REVIEW", "PUBLISH"]) if n else "REVIEW"
            actions.append((k, k * 8 + n, rng.choice([1, 2, 3, 3]), kind, rng.choice(["APPROVE", "APPROVE", "REJECT", "REQUEST_CHANGES"]) if kind == "REVIEW" else None, rng.choice([1, 1, 1, 2] if kind == "REVIEW" else [2, 2, 2, 1]), reason()))
        # Later drafts begin from what is published by now, so that the chain goes on.
        done = [o for o in replay(requests, actions, roles) if o[2] == "PUBLISHED" and requests[o[0]][0] == space]
        last[space] = [None, *[o[0] for o in sorted(done, key=lambda o: o[3])]]
    actions.append((7777, 99999, 3, "REVIEW", "APPROVE", 1, None))
    want = replay(requests, actions, roles)
    got = rows(
        governance.review_and_publish(
            spark.createDataFrame([(k, *v) for k, v in requests.items()], "request int, space string, author int, base int"),
            spark.createDataFrame(actions, "request int, seq int, actor int, action string, decision string, expected int, reason string"),
            spark.createDataFrame(roles, "space string, actor int, role string"),
        )
    )
    assert got == sorted(want, key=repr)
    assert max(w[3] or 0 for w in want) > 6
    assert {w[2] for w in want} >= {"PUBLISHED", "CONFLICTED", "NOT_OPEN", "NOT_APPROVED", "SELF", "FORBIDDEN", "STALE", "NO_REASON", "REJECTED", "CHANGES_REQUESTED"}


_ENTRY = "position int, code string, name string, reason string"


def test_decisions_and_eligibility(spark):
    rng = random.Random(9)
    codes, kinds = [f"o{i}" for i in range(12)], ["FIELD", "RULE"]
    pick = lambda: rng.choice(codes)
    exclusions = [(i, pick(), f"n{i}", rng.choice(["r", "", None, "s"])) for i in range(14)]
    pending = [(i, rng.choice(["deferred:FIELD:", "candidate:RULE:", "candidate:FIELD:", ""]) + pick(), f"p{i}", f"w{i}") for i in range(16)]
    rules = [("o1",), ("o2",), ("o2",)]
    decisions = [(i, f"d{i}", rng.choice(kinds), pick(), rng.choice(["KEEP", "KEEP", "EXCLUDED", "DEFERRED", "CANDIDATE_ONLY", "KEEP_WITHOUT_ENUM_MEMBER", "other"]), f"t{i}") for i in range(60)]
    refs = [(f"d{i % 60}", codes[i % 12], f"e{i % 5}") for i in range(100)] + [("d1", "o1", None)]
    out, waiting = [(c, n, r, None, None) for _, c, n, r in exclusions], [(c, n, r, None, None) for _, c, n, r in pending]

    def drop(entries, code):
        at = next((i for i, e in enumerate(entries) if e[0] == code), None)
        if at is not None:
            del entries[at]

    for _, d, kind, code, disposition, name in decisions:
        own = ",".join(sorted({r for x, c, r in refs if (x, c) == (d, code) and r}))
        if disposition == "KEEP":
            drop(out, code), drop(waiting, f"deferred:{kind}:{code}"), drop(waiting, f"candidate:{kind}:{code}")
        elif disposition == "EXCLUDED" and not any(e[0] == code for e in out):
            out.append((code, name, f"标准化决定 {d} 将该对象排除。", d, own))
        for word, prefix, text in (("DEFERRED", "deferred", "延后该对象。"), ("CANDIDATE_ONLY", "candidate", "仅登记为候选。")):
            key = f"{prefix}:{kind}:{code}"
            if disposition == word and not any(e[0] == key for e in waiting) and not (word == "CANDIDATE_ONLY" and kind == "RULE" and (code,) in rules):
                waiting.append((key, name, f"标准化决定 {d} {text}", d, own))
    lists = evidence.apply_decisions(
        spark.createDataFrame(exclusions, _ENTRY), spark.createDataFrame(pending, _ENTRY), spark.createDataFrame(rules, "code string"),
        spark.createDataFrame(decisions, "position int, decision string, kind string, code string, disposition string, name string"), spark.createDataFrame(refs, "decision string, code string, ref string"),
    ).cache()
    named = {k: [tuple(r)[2:] for r in lists.where(f"list = '{k}'").orderBy("place").collect()] for k in ("EXCLUSION", "PENDING")}
    assert named == {"EXCLUSION": out, "PENDING": waiting}

    candidates = [(i, rng.choice(["FIELD", "PENDING_ASSET"]), c, f"n{i}", rng.choice(["sum", "", None])) for i, c in enumerate([*codes[:7], codes[0], None, "", "unknown"])]
    got = evidence.eligibility(spark.createDataFrame(candidates, "candidate int, kind string, code string, name string, summary string"), lists.where("list = 'EXCLUSION'"), lists.where("list = 'PENDING'"))
    gaps, doubts = {c: r for c, _, r, *_ in out}, {c.split(":")[-1]: r for c, _, r, *_ in waiting}
    want = []
    for i, kind, code, name, summary in candidates:
        gap = (code and gaps.get(code)) or None
        doubt = (summary if kind == "PENDING_ASSET" else code and doubts.get(code)) or None
        want.append((f"conclusion:{i}", i, name, "EXCLUDED_GAP" if gap else "EXCLUDED_UNCERTAIN" if doubt else "ELIGIBLE", gap or doubt))
    want += [(f"conclusion:gap:{c}", None, n, "EXCLUDED_GAP", r) for c, n, r, *_ in out if c not in {x[2] for x in candidates}]
    assert rows(got) == sorted(want, key=repr)
    assert {w[3] for w in want} == {"EXCLUDED_GAP", "EXCLUDED_UNCERTAIN", "ELIGIBLE"}
    lists.unpersist()


def test_tree(spark):
    rng = random.Random(2)
    nodes = [(i, rng.randrange(i) if i > 3 else None, rng.choice([None, 1, 2]), rng.choice(["a", "b", None])) for i in range(60)]
    nodes += [(100 + i, 99 + i if i else 3, 1, "chain") for i in range(40)] + [(200, 201, 1, "x"), (201, 202, 1, "x"), (202, 200, 1, "x"), (203, 200, 1, "below"), (300, 999, 1, "orphan")]
    below, known = {}, {n[0] for n in nodes}
    for n in nodes:
        below.setdefault(n[1] if n[1] in known else None, []).append(n)
    want = []

    def visit(node, names):
        want.append((node[0], len(names), "/".join([*names, node[3] or ""]), len(want) + 1))
        for child in order(below.get(node[0], [])):
            visit(child, [*names, node[3] or ""])

    def order(found):
        return sorted(found, key=lambda n: (n[2] is not None, n[2] or 0, n[3] or "", n[0]))

    for root in order(below[None]):
        visit(root, [])
    assert rows(hierarchy.tree(spark.createDataFrame(nodes, "node int, parent int, position int, name string"))) == sorted(want, key=repr)


def test_checks_go_on(spark, tmp_path):
    digest = lambda i: hashlib.sha256(f"b{i}".encode()).hexdigest()
    items = spark.createDataFrame([(i, f"r{i}", digest(i)) for i in range(1, 96)], "position int, ref string, checksum string")
    bodies = lambda known: spark.createDataFrame([(f"r{i}", f"b{i}" if i != 37 or known else "other") for i in range(1, 96) if known or i != 80], "ref string, body string")
    path = str(tmp_path / "freeze")
    attempt, progress = store.freeze(items, bodies(False), path, 20)
    assert attempt == 1
    assert rows(progress) == [(1, "COMPLETED", 20, 20, None), (2, "FAILED", 20, 16, "r37"), (3, "NOT_RUN", 20, 0, None), (4, "NOT_RUN", 20, 0, None), (5, "NOT_RUN", 15, 0, None)]
    # What was verified isn't read again: its bodies may be gone.
    attempt, progress = store.freeze(items, bodies(True).where("ref IN ('r37', 'r80')"), path, 20)
    assert attempt == 2
    assert rows(progress) == [(b, "COMPLETED", n, n, None) for b, n in ((1, 20), (2, 20), (3, 20), (4, 20), (5, 15))]
    assert store.freeze(items, bodies(True).limit(0), path, 20)[1].where("status <> 'COMPLETED'").isEmpty()


def test_unclosed(spark):
    sources = spark.createDataFrame([("s1", "v1", []), ("s2", "v2", ["v1"]), ("s3", "v3", None)], "connection string, snapshot string, upstream array<string>")
    claims = [("c1", "s1", ["e1"], None), ("c2", "s2", ["e1"], ["c1"]), ("c3", "s3", ["e1"], ["c1"]), ("c4", "s9", ["e9", "e1"], ["c9"]), ("c5", "s1", None, [])]
    found = evidence.unclosed(sources, spark.createDataFrame([("e1",)], "id string"), spark.createDataFrame(claims, "claim string, source string, refs array<string>, upstream array<string>"))
    assert rows(found) == [("MISSING_EVIDENCE", "c4"), ("MISSING_SOURCE", "c4"), ("MISSING_UPSTREAM", "c4"), ("OPEN_UPSTREAM", "c3")]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    one, other = store.Versions(spark, path), store.Versions(spark, path)
    assert one.last() == 0 and one.put(0, a=spark.range(3), b=spark.range(2)) == 1
    assert (other.read("a").count(), other.read("b").count()) == (3, 2)
    for expected in (0, 2):
        with pytest.raises(FileExistsError):
            other.put(expected, a=spark.range(9))
    # A writer that saw version 1 while another made version 2 loses when it creates the file.
    other.last = lambda: 1
    assert one.put(1, a=spark.range(5)) == 2
    with pytest.raises(FileExistsError):
        other.put(1, a=spark.range(9))
    assert (one.last(), one.read("a").count(), one.read("a", 1).count()) == (2, 5, 3)


@pytest.mark.parametrize(("steps", "join"), [(100_000, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_rows_on_a_root_stay_out_of_the_joins(spark, monkeypatch, steps, join):
    """A star with a way of three: nodes on few others meet them by a broadcast, or by sorted ranges, and joins hold open rows only."""
    monkeypatch.setattr(hierarchy, "BROADCAST_STEPS", steps)
    nodes = [(0, None, 0, "r"), (1, 0, 0, "a"), (2, 1, 0, "b"), *((k, 0, k, "c") for k in range(3, 40))]
    plans, plain = [], hierarchy.materialize
    monkeypatch.setattr(hierarchy, "materialize", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, tag))
    got = {(r.node, r.depth, r.path, r.place) for r in hierarchy.tree(spark.createDataFrame(nodes, "node int, parent int, position int, name string")).collect()}
    assert got == {(0, 0, "r", 1), (1, 1, "r/a", 2), (2, 2, "r/a/b", 3), *((k, 1, "r/c", k + 1) for k in range(3, 40))}
    rounds = [p for p in plans[1:] if "Union" in p]
    assert len(rounds) == len(plans) - 1 and all(join in p for p in rounds)


def test_no_side_of_a_request_goes_through_the_driver(spark, monkeypatch):
    """Small tables are no reason for a broadcast, as files say little of the rows made of them."""
    from velarium.operators import fixpoint

    plans, plain = [], fixpoint.materialize
    monkeypatch.setattr(fixpoint, "materialize", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, tag))
    requests = spark.createDataFrame([(1, "s", "ann", None), (2, "s", "ann", 1)], "request int, space string, author string, base int")
    actions = [(r, 4 * r + n, who, kind, "APPROVE" if n == 1 else None, n, "理由") for r in (1, 2) for n, who, kind in ((1, "bob", "REVIEW"), (2, "cy", "PUBLISH"))]
    actions = spark.createDataFrame(actions, "request int, seq int, actor string, action string, decision string, expected int, reason string")
    found = governance.review_and_publish(requests, actions, spark.createDataFrame([("s", "bob", "REVIEWER"), ("s", "cy", "PUBLISHER")], "space string, actor string, role string"))
    assert {(r.request, r.outcome, r.version) for r in found.collect()} == {(1, "APPROVED", None), (1, "PUBLISHED", 1), (2, "APPROVED", None), (2, "PUBLISHED", 2)}
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p for p in [*plans, found._jdf.queryExecution().executedPlan().toString()])
