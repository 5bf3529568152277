import functools
import random
import re

import pytest

from velarium.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/x?y#z", "https://a.b.example.net/en/", "https://example.net", "https://example.net?/en/", "https://xexample.com/de/1",
    "https://m.example.com/de/1", "https://x.org/fr/", "https://x.org/FR/", "https://org/fr/a", "https://cheap-pills.io/a", "https://a-cheap-pills.example.com/de/", "https://x.io/?u=http://casino-win.net/",
    "https://É.NET/ü?a", "https://x.net:80/a", "https://ads-track.org/fr/", "a://b://c.net/d", "https://x.net\n/y",
]


compiled = functools.cache(re.compile)


def brute(url, rules=U.RULES):
    text = url or ""
    rest = text.split("://", 1)[1] if "://" in text else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if r.host and host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        rule = min(fits, key=lambda r: (-len(r.name), r.host, r.path))
        return host, path, rule.name, rule.verdict
    return host, path, None, "block" if any(r.pattern and compiled(r.pattern).search(text.lower()) for r in rules) else "allow"


def test_against_all_rules(spark, sf):
    pages = [(i, u) for i, u in enumerate(URLS)] + [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()] + [(None, "http://x.net/"), (1, "http://x.net/" + "a/" * 20_000)]
    df = spark.createDataFrame([(p, u, "t", "t") for p, u in pages], "page_id long, url string, token string, rule string")
    want = sorted(((p, *brute(u)) for p, u in pages), key=repr)
    for block in (U.BLOCK, 3):
        assert sorted((tuple(r) for r in U.judge(df, block=block).collect()), key=repr) == want
    table = spark.createDataFrame([(r.verdict, r.host or None, r.path or None, r.pattern or None) for r in U.RULES] * 2 + [(None, None, None, None)], "verdict string, host string, path string, pattern string")
    assert sorted((tuple(r) for r in U.judge(df, table, block=4).collect()), key=repr) == want


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(none).collect() == []
    one = spark.createDataFrame([(1, "http://A.net/x")], "page_id long, url string")
    assert [tuple(r) for r in U.judge(one, []).collect()] == [(1, "a.net", "/x", None, "allow")]


@pytest.mark.parametrize(
    ("pattern", "tokens"),
    [
        ("ads-track", ()), ("/ads-track/", ("ads", "track")), ("x+", ()), (r"://([^/?#]*[.-])?free-bets\.", ("bets", "free")), (r"(a|b)/cat/", ("cat",)), (r"\bdog\b", ("dog",)), (r"[a-z]dog/", ()), (r"/dog[a-z]?", ()),
        (r"^dog$", ("dog",)), (r"/(?:dog/)+cat/", ("cat",)), (r"/(dog)/", ("dog",)), (r"(?i)/dog/", ()), (r"/dog(?:[/?#]|$)", ("dog",)), (r"/(?:dog|cat)/", ()), (r".dog.", ()), (r"/dog(?=x)", ()), (r"é_dog-", ("dog",)),
    ],
)
def test_tokens_of_patterns(pattern, tokens):
    assert U.tokens_of(pattern) == tokens


def test_a_pattern_is_found_only_with_its_tokens():
    """In random texts, whatever a random pattern is found in holds all of its tokens."""
    rng, found = random.Random(3), 0
    for _ in range(4000):
        parts = ["ab", "b", "/", r"\.", "[a/]", "[^a]", "(?:a|/b)", "(?:/)?", "a?", ".", r"\b", "$", "^", "(b/)*", "(/a)+"]
        pattern = "".join(rng.choices(parts, k=rng.randint(1, 6)))
        tokens = U.tokens_of(pattern)
        for _ in range(200 if tokens else 0):
            text = "".join(rng.choices("ab/.", k=rng.randint(0, 8)))
            if tokens and re.search(pattern, text):
                found += 1
                assert set(tokens) <= set(re.findall("[a-z0-9]+", text)), (pattern, text)
    assert found > 100


def test_many_rules_run_few_expressions():
    """Of 100,000 rules, a url runs those few that share its rarest tokens; the answers are those of all rules."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rules = [U.Rule(rng.choice(["allow", "block"]), f"{word()}.{rng.choice(['com', 'net', 'org'])}", rng.choice(["", "/", f"/{word()}", f"/{word()}/"])) for _ in range(60_000)]
    rules += [U.Rule("block", pattern=rf"[./]{word()}-{word()}\.(com|net)/") for _ in range(40_000)]
    rules = list(dict.fromkeys(rules))
    hosts = [r.host for r in rng.sample(rules, 300) if r.host]
    urls = [f"http://{rng.choice(['', 'www.', word() + '.'])}{h}/{rng.choice(['', word(), 'x/y'])}" for h in hosts[:60]]
    urls += [f"http://{p.pattern[4:15]}.com/" for p in rng.sample([r for r in rules if r.pattern], 60)] + [f"http://{word()}.{word()}.io/?{word()}" for _ in range(30)]
    index = U.Index(rules, {r: U.tokens_of(r.source()) for r in rules}, {"com": 90, "net": 60, "org": 50})
    assert not index.always
    for url in urls:
        host, path, rule, blocked = index.judge(url)
        assert (host, path, rule and rule.name, rule.verdict if rule else "block" if blocked else "allow") == brute(url, rules)
    assert index.runs < 10 * len(urls)
