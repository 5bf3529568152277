"""PII: weak-supervision aggregation, in DataFrame operations only.

Candidates come from regular expressions: the base kinds, numbers like cards that fail the check digit,
phones without a country code, e-mail addresses with `at` and `dot` spelled out, IPv6 addresses, and
secrets (keys, passwords and tokens that are assigned). Four labelers vote on each (for, against, or
abstain): its form (a card's with its check digit), a gazetteer (top-level domains, issuers with the lengths of their
numbers, reserved addresses, key prefixes), words of its context, and what it touches. For each kind, expectation-maximisation over the counts
of vote patterns estimates how reliable each labeler is. A logistic classifier over features of the spans (rule, length,
separators, neighbours, check digits; not the votes) is trained on the posteriors of all candidates, and
decides on those that aren't base. Base spans stay whatever it says.

Places come from splitting the text at the matches: a match begins where all that stands before it ends.
That is a running sum over the candidates alone, so texts are read once and never shuffled.

Defined cases: a null text is empty; a document without spans has counts 0 and empty strings; repeated
rows each have a result; very long texts are read whole; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velarium.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Found, but counted and listed apart.
SECRET = "secret"

# Possessive, and begun only where a longer match can't: the same matches as the plain forms, in linear time and without recursion.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z0-9-]++)++"
_LOCAL = r"(?<![0-9+.])(?<!\+[0-9]{1,3}[\x20.-]?)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

_NATIONAL = r"(?<![0-9+.,])(?<![0-9][\x20-])0[1-9](?:[\x20.-]?[0-9]{2}){4}(?![\x20.,-]?[0-9])"
_IP6 = r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])"
_SECRET = r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ghp_|gho_|xox[bp]-|sk-|sk_live_)[A-Za-z0-9_-]{12,}+|(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key)\x20?[:=]\x20?[\"']?[A-Za-z0-9+/_.-]{6,}+[\"']?"

#: Rule, kind, pattern, and a cheap test that a text must pass to hold a match.
RULES = (
    ("email", "email", _EMAIL, lambda t: F.contains(t, F.lit("@"))),
    ("ip", "ip", _IP, lambda t: t.rlike(r"[0-9]\.[0-9]")),
    ("card", "card", _CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")),
    ("phone", "phone", _PHONE, lambda t: t.rlike(r"\+[0-9]")),
    ("spelled", "email", _SPELLED, lambda t: t.rlike(r"[\[(](?:at|AT)[\])]")),
    ("local", "phone", _LOCAL, lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")),
    ("national", "phone", _NATIONAL, lambda t: t.rlike(r"0[1-9](?:[\x20.-]?[0-9]{2}){4}")),
    ("ip6", "ip", _IP6, lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")),
    ("secret", SECRET, _SECRET, lambda t: t.rlike(r"AKIA|ASIA|gh[po]_|xox[bp]-|sk[-_]|[:=]")),
)
#: Rules whose matches are never base.
ADDED = ("spelled", "local", "national", "ip6", "secret")
AROUND = 80

#: Fixed values of the gazetteer and the context labelers.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|at|ch|nl|be|us|ca"
RESERVED = r"^(?:0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-4])\."
ISSUERS = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11,16}|6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12,15})$"
CONTEXT = {
    "email": (r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel|adresse)\b", r"(?i)\b(?:example|sample|user@)\b"),
    "ip": (r"(?i)\b(?:ip|address|host|server|login|from|adresse|dirección)\b", r"(?i)\b(?:version|ver|release|section|v)\.?$"),
    "card": (r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment)\b", r"(?i)\b(?:order|isbn|id|tracking|serial|invoice|nr|no)\b"),
    SECRET: (r"(?i)\b(?:key|password|passwd|pwd|secret|token|credentials|login|auth)\b", r"(?i)\b(?:example|sample|placeholder|your)\b"),
    "phone": (r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell|telefon|téléphone|teléfono|anrufen)\b", r"(?i)\b(?:order|isbn|id|serial|part|version|nr|no)\b"),
}
VOTES = ("form", "gazetteer", "context", "neighbours")


def _candidate(rule: str):
    """Of a match, the text before it and the text after it."""
    return lambda z, n: F.struct(F.lit(rule).alias("rule"), n.alias("n"), F.length(z["g"]).alias("gap"), z["m"].alias("found"), F.right(z["g"], F.lit(AROUND)).alias("left"), F.left(z["h"], F.lit(AROUND)).alias("right"))


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id, c (rule, n, gap, found, left, right): a row for each candidate, and one with null c for a document without any."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text, lists = F.col("text"), []
    for rule, _, pattern, test in RULES:
        parts = F.split(text, pattern, -1)
        zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), parts.alias("g"), F.slice(parts, F.lit(2), F.size(parts)).alias("h"))
        found = F.transform(F.filter(zipped, lambda z: z["m"].isNotNull()), _candidate(rule))
        lists.append(F.when(test(text), found).otherwise(F.array().cast("array<struct<rule:string,n:int,gap:int,found:string,left:string,right:string>>")))
    return numbered.select("row", "doc_id", F.explode_outer(F.concat(*lists)).alias("c"))


def _vote(for_: Column, against: Column) -> Column:
    return F.when(against, -1).when(for_, 1).otherwise(0)


def _by_kind(**columns: Column) -> Column:
    """Each kind's own condition; none is false."""
    out = F.lit(False)
    for name, column in columns.items():
        out = F.when(F.col("kind") == name, F.coalesce(column, F.lit(False))).otherwise(out)
    return out


def labelled(found: DataFrame) -> DataFrame:
    """Candidates with kind, start, end, base (a base span), weak (one that the classifier decides on), a vote of each labeler, and FEATURES."""
    # One shuffle by row serves the running sum and the later grouping by document.
    dealt = found.repartition("row").select("row", "doc_id", "c.*")
    before = W.partitionBy("row", "rule").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.length("found")).over(before)
    kind = F.col("rule")
    for rule, name, *_ in RULES:
        kind = F.when(F.col("rule") == rule, F.lit(name)).otherwise(kind)
    rows = dealt.select("*", kind.alias("kind"), end.alias("end"), (end - F.length("found")).alias("start"))
    text, digits = F.col("found"), F.regexp_replace("found", "[^0-9]", "")
    # No part is empty (RULES), so one without digits after its zeros is 0.
    octet = "0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    small = text.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    luhn = F.expr("luhn_check(regexp_replace(found, '[^0-9]', ''))")
    ok = F.when(F.col("rule") == "email", True).when(F.col("rule") == "ip", small).when(F.col("rule") == "card", luhn).when(F.col("rule") == "phone", F.length(digits).between(10, 15)).otherwise(False)
    # An address with more or larger parts, or a phone with more or fewer digits, is no span of any sort.
    weak = F.col("rule").isin(*ADDED) | ((F.col("rule") == "card") & ~ok)

    form = _vote(
        _by_kind(
            email=text.rlike(r"^[A-Za-z0-9](?:[._%+-]?[A-Za-z0-9])*+@(?:[A-Za-z0-9](?:-*[A-Za-z0-9])*+\.)+[A-Za-z]{2,}$") | (F.col("rule") == "spelled"),
            ip=text.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$") | (F.col("rule") == "ip6"),
            card=luhn & text.rlike(r"^(?:[0-9]{14,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5})$"),
            phone=text.rlike(r"^(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?)?[0-9]+(?:([\x20.-])[0-9]+(?:\1[0-9]+)*)?$"),
            secret=text.rlike(r"[0-9]") & text.rlike(r"[A-Za-z]") & text.rlike(r"[A-Za-z0-9+/_-]{12,}"),
        ),
        _by_kind(email=text.rlike(r"\.\.|\.[0-9]+$|^[.-]|-\."), ip=text.rlike(r"^(?:0\.|.*\.0[0-9])"), card=~luhn | text.rlike(r"\x20.*-|-.*\x20|^[0-9]{1,3}[\x20-]"), phone=text.rlike(r"[\x20.()-]{3}|\([^)]*$"), secret=~text.rlike(r"[0-9]")),
    )
    near = F.concat_ws(" ", "left", "right")
    context = _vote(_by_kind(**{k: near.rlike(said) for k, (said, _) in CONTEXT.items()}), _by_kind(**{k: F.col("left").rlike(denied) for k, (_, denied) in CONTEXT.items()}))
    listed = {
        "email": (F.lower(text).rlike(rf"(?:\.|dot[\])]\x20?)(?:{DOMAINS})$"), F.lower(text).rlike(r"(?:example|test|invalid|localhost)(?:\.[a-z]+)?$")),
        "ip": (~text.rlike(RESERVED), text.rlike(RESERVED)), "card": (digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
        "phone": (digits.rlike(r"^(?:1?[2-9][0-9]{2}[2-9]|[2-9]|0[1-9])"), digits.rlike(r"^0{3}|^(.)\1+$|^1?[0-9]{3}55501")), SECRET: (text.rlike(r"^(?:AKIA|ASIA|gh[po]_|xox|sk[-_])"), text.rlike(r"(?i)[:=]\x20?[\"']?(?:null|none|true|false|undefined)")),
    }
    gazetteer = _vote(_by_kind(**{k: v[0] for k, v in listed.items()}), _by_kind(**{k: v[1] for k, v in listed.items()}))
    marks = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\x20().-]"), F.lit(0))))
    apart = r"^$|[\x20\t\n\r(\[{<\"',;:=]$"
    apart_left, apart_right = F.col("left").rlike(apart), F.col("right").rlike(r"^$|^[\x20\t\n\r)\]}>\"',;:.!?]")
    neighbours = _vote(apart_left & apart_right, F.col("left").rlike(r"[\p{L}\p{N}#/\\]$") | F.col("right").rlike(r"^[\p{L}\p{N}/\\]"))
    rows = rows.select(
        "row", "doc_id", "kind", "rule", "start", "end", F.coalesce(ok, F.lit(False)).alias("base"), F.coalesce(weak, F.lit(False)).alias("weak"),
        form.alias("form"), gazetteer.alias("gazetteer"), context.alias("context"), neighbours.alias("neighbours"),
        F.least(F.lit(3), F.floor(F.length(text) / 8)).cast("int").alias("size"), F.least(F.lit(2), marks).alias("marks"), (F.col("kind") == "card").cast("int").alias("_card"), luhn.cast("int").alias("_luhn"),
        apart_left.cast("int").alias("apart_left"), apart_right.cast("int").alias("apart_right"),
    )
    return rows.withColumn("checked", F.when(F.col("_card") == 1, 2 * F.coalesce("_luhn", F.lit(0)) - 1).otherwise(0)).drop("_card", "_luhn")


#: What tells a span apart from others, in few values each: at most some thousand patterns, of which few occur.
FEATURES = ("kind", "rule", "size", "marks", "apart_left", "apart_right", "checked", *VOTES)


def encode(pattern: tuple) -> tuple[float, ...]:
    """A pattern of FEATURES as numbers for the classifier: all but the votes, of which its targets are made and beside which no feature would tell anything."""
    values = dict(zip(FEATURES, pattern, strict=True))
    kinds = [float(values["kind"] == k) for k in (*KINDS, SECRET)]
    return (*kinds, *[float(values["rule"] == r) for r in ADDED], *[float(values["size"] >= k) for k in (1, 2, 3)], *[float(values["marks"] >= k) for k in (1, 2)], float(values["apart_left"]), float(values["apart_right"]), float(values["checked"]))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[dict[bool, dict[int, float]]], list[float]]:
    """Expectation-maximisation over (votes, count): the share of true candidates, each labeler's chance of each vote given true or false, and each pattern's posterior.

    An abstention says nothing about the truth. Begins from labelers that are right more often than not; that
    belief goes on to weigh as much as a fiftieth of the candidates, so that true and false can't change places.
    """
    prior, size, total = 0.5, len(patterns[0][0]) if patterns else 0, sum(n for _, n in patterns)
    first = {True: {1: 0.75, -1: 0.25}, False: {1: 0.25, -1: 0.75}}
    chance = [{truth: dict(votes) for truth, votes in first.items()} for _ in range(size)]
    posterior: list[float] = []
    for _ in range(rounds):
        posterior = []
        for votes, _ in patterns:
            yes = math.log(prior) + sum(math.log(chance[k][True][v]) for k, v in enumerate(votes) if v)
            no = math.log(1 - prior) + sum(math.log(chance[k][False][v]) for k, v in enumerate(votes) if v)
            posterior.append(1 / (1 + math.exp(min(700, no - yes))))
        prior = min(0.99, max(0.01, (1 + sum(n * p for (_, n), p in zip(patterns, posterior, strict=True))) / (2 + total)))
        for k in range(size):
            for truth in (True, False):
                mass = {v: (1 + total / 50) * first[truth][v] + sum(n * (p if truth else 1 - p) for (votes, n), p in zip(patterns, posterior, strict=True) if votes[k] == v) for v in (1, -1)}
                chance[k][truth] = {v: m / sum(mass.values()) for v, m in mass.items()}
    return prior, chance, posterior


def train_classifier(rows: list[tuple[tuple[float, ...], float, float]], rounds: int = 400, rate: float = 0.5, ridge: float = 0.01) -> list[float]:
    """Logistic weights, bias last, from (features, target in 0..1, count) by gradient descent; plain arithmetic over the patterns."""
    size = len(rows[0][0]) + 1 if rows else len(VOTES) + 1
    weights, total = [0.0] * size, sum(n for *_, n in rows) or 1.0
    for _ in range(rounds):
        gradient = [ridge * w for w in weights[:-1]] + [0.0]
        for x, y, n in rows:
            x = (*x, 1.0)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x, strict=True))))))
            for k, a in enumerate(x):
                gradient[k] += n / total * (p - y) * a
        weights = [w - rate * g for w, g in zip(weights, gradient, strict=True)]
    return weights


def fit(votes: DataFrame) -> dict[tuple, float]:
    """The classifier's probability for each pattern of FEATURES. What reaches the driver is a count for each of these."""
    counts = {tuple(r[c] for c in FEATURES): r["count"] for r in votes.where("base or weak").groupBy(*FEATURES).count().collect()}
    posterior = {}
    for kind in (*KINDS, SECRET):
        by_votes: dict[tuple, int] = {}
        for pattern, n in counts.items():
            if pattern[0] == kind:
                by_votes[pattern[-len(VOTES) :]] = by_votes.get(pattern[-len(VOTES) :], 0) + n
        found = sorted(by_votes.items())
        posterior |= {(kind, v): p for (v, _), p in zip(found, reliabilities(found)[2], strict=True)}
    rows = [(encode(p), posterior[p[0], p[-len(VOTES) :]], float(n)) for p, n in sorted(counts.items(), key=repr)]
    weights = train_classifier(rows)
    return {p: 1 / (1 + math.exp(-max(-30.0, min(30.0, weights[-1] + sum(w * x for w, x in zip(weights, encode(p), strict=False)))))) for p in counts}


def find(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind, start, end, base: a row for each span, and one with null kind for each document (any columns of it but doc_id and text are left out)."""
    found = materialize(candidates(docs), "pii-candidates")
    votes = labelled(found)
    yes = sorted((p for p, belief in fit(votes).items() if belief >= 0.5), key=repr)
    named = F.concat_ws("|", *[F.col(f).cast("string") for f in FEATURES])
    accepted = named.isin(*["|".join(map(str, p)) for p in yes]) if yes else F.lit(False)
    span = F.col("base") | (F.col("weak") & accepted)
    return votes.select("row", "doc_id", *[F.when(span, F.col(c)).alias(c) for c in ("kind", "start", "end", "base")])


def summarize(spans: DataFrame) -> DataFrame:
    """find()'s rows -> a row for each document: base spans counted by kind and digested, all spans of KINDS as text, how many were added to the base ones, and secrets apart."""
    order = F.lit(len(KINDS))
    for k, name in enumerate(KINDS):
        order = F.when(F.col("kind") == name, k).otherwise(order)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", order.alias("order"), "end", "kind", "base"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base, secret = F.coalesce("base", F.lit(False)), F.col("kind") == SECRET
    counts = [F.count(F.when((F.col("kind") == k) & base, 1)).alias(f"n_{k}") for k in KINDS]
    counts += [F.count(F.when(F.col("kind").isNotNull() & ~base & ~secret, 1)).alias("n_added"), F.count(F.when(secret, 1)).alias("n_secret"), F.count("kind").alias("n_spans")]
    rows = spans.groupBy("row", "doc_id").agg(*counts, F.sort_array(F.collect_list(span)).alias("s"))
    listed = [F.sha2(text(F.filter("s", lambda s: s["base"])), 256).alias("base_sha256"), text(F.filter("s", lambda s: s["kind"] != SECRET)).alias("spans"), text(F.filter("s", lambda s: s["kind"] == SECRET)).alias("secret_spans")]
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], *listed, "n_added", "n_secret", "n_spans")
