import numpy as np
import pytest
import xxhash

from velarium.llm import simhash
from velarium.llm.graph import connected_components


def brute_fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def classes(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    fps = [(d, brute_fingerprint(t or "")) for d, t in rows]
    distinct = sorted({f for _, f in fps})
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 3]
    of = classes(links, distinct)
    least = {}
    for d, f in fps:
        if d is not None:
            least[of[f]] = min(least.get(of[f], d), d)
    return sorted(((d, f"{f:016x}", least.get(of[f])) for d, f in fps), key=repr)


def test_against_all_pairs(odd, docs):
    for df in (odd, docs):
        assert sorted((tuple(r) for r in simhash.near_dedup(df).drop("root").collect()), key=repr) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_empty(none):
    assert simhash.near_dedup(none).collect() == []


def chained(n, seed=5):
    """Random fingerprints, and chains of near ones."""
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 2**64, n, dtype=np.uint64)
    for i in range(n // 3, n):
        flips = rng.integers(0, 64, rng.integers(1, 5))
        out[i] = out[rng.integers(0, i)] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
    return np.unique(out)


@pytest.mark.parametrize("sizes", [{}, {"shard": 100, "block": 60, "sample": 64}])
def test_shards_lose_no_link(spark, sizes):
    fps = chained(900)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.link(df, **sizes)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    ids = fps.view(np.int64).tolist()
    want = classes([(ids[a], ids[b]) for a, b in np.argwhere(near) if a != b], ids)
    assert {n: got.get(n, n) for n in ids} == want


def test_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (500, 501)], "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(301)} | {500: 500, 501: 500}
