"""URL filters: rules indexed by their rarest literal token.

A rule is either of a host and a path (it fits the host and all subdomains where the url's path starts
with the rule's), or a pattern that blocks. Of host rules that fit, the longest wins; where none fits, one
pattern that is found in the lower-cased url blocks it, else it is allowed.

All rules are in one index. The tokens of a rule are read off its literal text: runs of a-z and 0-9 that
stand between other characters in each url that it fits. It is filed under the one that the urls at hand
hold least often (counted over all of them). A url's tokens fetch candidate rules, and only those run
their regular expressions. Rules without a token run on each url.

Rules are taken in blocks of bounded size, each a broadcast index; a block passes on what it found.

Defined cases: a null url or one without `://` has an empty host and path, no rule, and is allowed
unless a pattern matches its text; an empty table gives an empty result, no rules allow all; repeated rows
are each judged; very long urls are read whole; of host rules of one length the first in order of host and
path wins; rules with neither a host nor a pattern, and repeated rules, change nothing; other columns aren't read.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules of a block.
BLOCK = 200_000


@dataclass(frozen=True)
class Rule:
    """A host rule (verdict, host, path), or a pattern, whose verdict is block."""

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def rank(self) -> tuple:
        """The least wins."""
        return -len(self.name), self.host, self.path

    def source(self) -> str:
        """The regular expression over a lower-cased url that tells the rule's tokens: each url that it fits matches this."""
        if self.pattern:
            return self.pattern
        return rf"://(?:[^/?#]*\.)?{re.escape((self.host + self.path).lower())}" + ("" if self.path else r"(?:[/?#]|$)")


#: The rules where none are given (fixed values): host rules, and patterns of hosts.
RULES = (
    Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"),
    *(Rule("block", pattern=rf"://([^/?#]*[.-])?{name}\.") for name in ("cheap-pills", "casino-win", "free-bets", "adult-x", "spam-farm", "ads-track")),
)

_TOKEN = re.compile(r"[a-z0-9]+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = re.search(r"[/?#]|$(?!\n)", rest).start()
    host = rest[:end].translate(_FOLD)
    return host, re.match(r"[^?#]*", rest[end:]).group()


def _is_token(code: int) -> bool:
    return 48 <= code <= 57 or 97 <= code <= 122


def _may_be_token(op, value) -> bool:
    """Whether a single-character node can match a character of a token."""
    if op is sre.LITERAL:
        return _is_token(value)
    if op is sre.IN and not any(k is sre.NEGATE for k, _ in value):
        return any(k is sre.CATEGORY or k is sre.RANGE and any(map(_is_token, range(v[0], min(v[1], 122) + 1))) or k is sre.LITERAL and _is_token(v) for k, v in value)
    return True


def _edge(items: list, last: bool) -> tuple[bool, bool]:
    """Of a sequence of nodes: whether the last (or first) character of a match can be a token's, and whether a match can be empty."""
    for op, value in reversed(items) if last else items:
        if op is sre.AT and value in ((sre.AT_BEGINNING, sre.AT_BEGINNING_STRING, sre.AT_BOUNDARY) if last else (sre.AT_END, sre.AT_END_STRING, sre.AT_BOUNDARY)):
            return False, False  # beside a token's character, no other can stand here
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            token, empty = _edge(list(value[2]), last)
            empty = empty or value[0] == 0
        elif op is sre.SUBPATTERN:
            token, empty = _edge(list(value[3]), last)
        elif op is sre.BRANCH:
            parts = [_edge(list(b), last) for b in value[1]]
            token, empty = any(t for t, _ in parts), any(e for _, e in parts)
        elif op in (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY):
            token, empty = _may_be_token(op, value), False
        else:
            token, empty = True, True
        if token:
            return True, empty and token
        if not empty:
            return False, False
    return False, True


def _flat(items) -> Iterator[tuple]:
    for op, value in items:
        if op is sre.SUBPATTERN and not value[1] and not value[2]:
            yield from _flat(value[3])
        else:
            yield op, value


def tokens_of(pattern: str) -> tuple[str, ...]:
    """The tokens that each text that a pattern is found in must hold."""
    tree = re._parser.parse(pattern)
    if tree.state.flags & re.I:
        return ()
    nodes, out, k = list(_flat(tree)), set(), 0
    while k < len(nodes):
        if nodes[k][0] is not sre.LITERAL or not _is_token(nodes[k][1]):
            k += 1
            continue
        end = k
        while end < len(nodes) and nodes[end][0] is sre.LITERAL and _is_token(nodes[end][1]):
            end += 1
        before, open_left = _edge(nodes[:k], True)
        after, open_right = _edge(nodes[end:], False)
        if not (before or after or open_left or open_right):
            out.add("".join(chr(v) for _, v in nodes[k:end]))
        k = end
    return tuple(sorted(out))


class Index:
    """Rules filed under their rarest token. runs counts the regular expressions that were run."""

    def __init__(self, rules: Iterable[Rule], tokens: dict[Rule, tuple[str, ...]], counts: dict[str, int]):
        self.by_token: dict[str, list[Rule]] = {}
        self.always: list[Rule] = []
        self.compiled: dict[Rule, re.Pattern] = {}
        self.runs = 0
        for rule in rules:
            if tokens[rule]:
                self.by_token.setdefault(min(tokens[rule], key=lambda t: (counts.get(t, 0), t)), []).append(rule)
            else:
                self.always.append(rule)

    def fits(self, rule: Rule, lower: str, host: str, path: str) -> bool:
        if rule not in self.compiled:
            self.compiled[rule] = re.compile(rule.pattern or rf"(?:.*\.)?{re.escape(rule.host)}", 0 if rule.pattern else re.S)
        self.runs += 1
        if rule.pattern:
            return self.compiled[rule].search(lower) is not None
        return path.startswith(rule.path) and self.compiled[rule].fullmatch(host) is not None

    def judge(self, url: str | None) -> tuple[str, str, Rule | None, bool]:
        """Host, path, the best host rule that fits, and whether a pattern blocks (asked only where no host rule fits)."""
        host, path = split_url(url)
        lower = (url or "").lower()
        found = [r for t in set(_TOKEN.findall(lower)) for r in self.by_token.get(t, ())] + self.always
        best = None
        for rule in found:
            if rule.host and host and (best is None or rule.rank < best.rank) and self.fits(rule, lower, host, path):
                best = rule
        return host, path, best, best is None and any(r.pattern and self.fits(r, lower, host, path) for r in found)


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many urls each token of some rules is. The result is as large as the rules, not as the urls."""

    def count(batches):
        seen = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                seen.update(tokens.intersection(_TOKEN.findall((url or "").lower())))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = urls.select(F.col("url").cast("string")).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {row.token: row.n for row in counted.collect()}


def blocks(rules: DataFrame | Iterable[Rule], size: int = BLOCK) -> Iterator[list[Rule]]:
    """Rules, or rows (verdict, host, path, pattern), in blocks."""
    if isinstance(rules, DataFrame):
        columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("verdict", "host", "path", "pattern")]
        rules = (Rule(*row) for row in rules.select(*columns).toLocalIterator())
    held: dict[Rule, None] = {}
    for rule in rules:
        if rule.host or rule.pattern:
            held[rule] = None
        if len(held) >= size:
            yield list(held)
            held = {}
    if held:
        yield list(held)


FOUND = "page_id long, url string, host string, path string, best string, verdict string, rest string, blocked boolean"


def _shared(pages: DataFrame, rules: list[Rule]):
    """The index of a block on every executor; it is as large as the block."""
    tokens = {rule: tokens_of(rule.source()) for rule in rules}
    several = {t for own in tokens.values() if len(own) > 1 for t in own}
    return pages.sparkSession.sparkContext.broadcast(Index(rules, tokens, token_counts(pages, several) if several else {}))


def judge(pages: DataFrame, rules: DataFrame | Iterable[Rule] = RULES, block: int = BLOCK) -> DataFrame:
    """page_id, host, path, rule, verdict: a row for each row of pages (page_id, url)."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 6, pa.bool_()]
    none = F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), none.alias("host"), none.alias("path"), none.alias("best"), none.alias("verdict"), none.alias("rest"), F.lit(False).alias("blocked"))

    def passed(index):
        def run(batches):
            for batch in batches:
                out = [[] for _ in names]
                for page, url, _, _, best, verdict, rest, blocked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    host, path, rule, hit = index.value.judge(url)
                    # best is the host of the rule that an earlier block has found, rest its path.
                    if rule and (best is None or rule.rank < Rule("", best, rest).rank):
                        best, rest, verdict = rule.host, rule.path, rule.verdict
                    for column, value in zip(out, (page, url, host, path, best, verdict, rest, blocked or hit), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

        return run

    indexes = [_shared(pages, some) for some in blocks(rules, block)] or [_shared(pages, [])]  # without rules, hosts and paths are read all the same
    for index in indexes:
        rows = rows.mapInArrow(passed(index), FOUND)
    verdict = F.coalesce("verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.concat("best", "rest").alias("rule"), verdict.alias("verdict"))
