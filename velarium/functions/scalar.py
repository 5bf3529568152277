"""Scalar functions of the semantic layer as columns: names, routes, hashes, canonical JSON, tokens."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_list(c: Column, separator: str = ",") -> Column:
    """Trimmed parts, empties dropped."""
    return F.filter(F.transform(F.split(c, separator), F.trim), lambda x: x != "")


def local_name(c: Column) -> Column:
    """The last part of an IRI between `/`, `#` and `:` that isn't empty, decoded; the whole where all are."""
    parts = F.filter(F.split(c, "[/#:]"), lambda x: x != "")
    last = F.try_element_at(parts, F.lit(-1))
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last, c)


def snake_case(c: Column) -> Column:
    """Humps parted by `_`, which also stands for runs of what is no ASCII letter or digit, but at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), "[^a-zA-Z0-9]+", "_"), "^_|_$", ""))


def base64url(c: Column) -> Column:
    return F.rtrim(F.translate(F.base64(c.cast("binary")), "+/\r\n", "-_"), F.lit("="))


def compose_route(base: Column, path: Column) -> Column:
    """One slash between the parts, one in front, none at the end."""
    joined = F.concat_ws("/", F.lit(""), base, path)
    clean = F.regexp_replace(joined, "/+", "/")
    return F.when(F.length(clean) > 1, F.regexp_replace(clean, "/$", "")).otherwise(clean)


def has_cjk(c: Column) -> Column:
    return c.rlike("[\\u4e00-\\u9fff]")


def bind_tokens(c: Column) -> Column:
    """`#{name}` becomes `?`; `${name}`, which isn't a bound value, stays."""
    return F.regexp_replace(c, "#\\{[^}]*\\}", "?")


def fingerprint(c: Column) -> Column:
    """Digest of an array as a set."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(c)), "\n"), 256)


def fnv1a_32(c: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes, as a long. A fold over the bytes inside the JVM."""
    encoded = F.hex(c.cast("binary"))
    step = lambda h, k: (h.bitwiseXOR(F.conv(F.substring(encoded, k * 2 + 1, F.lit(2)), 16, 10).cast("long")) * F.lit(16777619).cast("long")) % F.lit(1 << 32)
    places = F.when(F.length(encoded) > 0, F.sequence(F.lit(0), (F.length(encoded) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(2166136261).cast("long"), step)


def crc_32(c: Column) -> Column:
    return F.crc32(c.cast("binary"))


def sorted_json(columns: dict[str, Column]) -> Column:
    """One JSON object of columns, keys in order, null fields kept: equal for equal contents."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def content_ref(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces; on the driver, for configuration."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def checksum(value: object) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(value).encode()).hexdigest()
