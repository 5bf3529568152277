"""Sources by family: how Spark reads each, what a connection may hold, and what it must not."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession

#: Family, Spark format, and options that a connection needs.
FAMILIES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mysql": ("jdbc", ("host", "port", "database")), "postgresql": ("jdbc", ("host", "port", "database")), "snowflake": ("jdbc", ("account", "warehouse", "database")),
    "mongodb": ("mongodb", ("cluster", "database")), "redis": ("velarium_redis", ("address", "database")), "jdbc": ("jdbc", ("url",)), "property_graph": ("velarium_graph", ("address", "match", "return", "order")), "cassandra": ("org.apache.spark.sql.cassandra", ("contact_points", "keyspace")),
    "graph": ("quads", ("address", "mode")), "elasticsearch": ("velarium_search", ("address",)), "milvus": ("parquet", ("path",)), "s3": ("parquet", ("path",)),
    "sharepoint": ("binaryFile", ("path",)), "github": ("text", ("path", "ref")), "kafka": ("kafka", ("bootstrap",)),
    "parquet": ("parquet", ("path",)), "csv": ("csv", ("path",)), "json": ("json", ("path",)), "orc": ("orc", ("path",)), "xml": ("xml", ("path",)), "text": ("text", ("path",)), "binary": ("binaryFile", ("path",)),
}
STATES = ("DRAFT", "TESTED", "DISCOVERED", "ACTIVE")
_SECRET = re.compile(r"(?i)passw|secret|token|api_?key|private_?key|credential(?!_?ref$)")


def find_secrets(config: object, path: str = "") -> list[str]:
    """Paths of keys that look like secrets, at any depth; only a credential_ref is allowed."""
    if isinstance(config, dict):
        return [p for k, v in config.items() for p in ([f"{path}{k}"] if _SECRET.search(str(k)) else []) + find_secrets(v, f"{path}{k}.")]
    if isinstance(config, (list, tuple)):
        return [p for k, v in enumerate(config) for p in find_secrets(v, f"{path}{k}.")]
    return []


@dataclass(frozen=True)
class Connection:
    name: str
    family: str
    config: dict = field(default_factory=dict)
    revision: int = 1
    state: str = "DRAFT"

    def __post_init__(self):
        if self.family not in FAMILIES:
            raise ValueError(f"unknown source family {self.family}")
        if found := find_secrets(self.config):
            raise ValueError("secrets don't belong into a connection: " + ", ".join(found))
        if lacking := [k for k in FAMILIES[self.family][1] if k not in self.config]:
            raise ValueError(f"{self.name} lacks {', '.join(lacking)}")

    def advance(self, state: str) -> Connection:
        """To the next state; none is skipped."""
        if STATES.index(state) != STATES.index(self.state) + 1:
            raise ValueError(f"{self.state} can't become {state}")
        return Connection(self.name, self.family, self.config, self.revision, state)

    def matches(self, expected: dict) -> bool:
        """Whether each expected key has an equal value, whatever the order inside it."""
        stable = lambda v: json.dumps(v, sort_keys=True)
        return all(k in self.config and stable(self.config[k]) == stable(v) for k, v in expected.items())


def jdbc_url(c: Connection) -> str:
    if c.family == "jdbc":
        return c.config["url"]
    if c.family == "snowflake":
        return f"jdbc:snowflake://{c.config['account']}/?warehouse={c.config['warehouse']}&db={c.config['database']}"
    return f"jdbc:{c.family}://{c.config['host']}:{c.config['port']}/{c.config['database']}"


def options(c: Connection, item: str = "") -> dict[str, str]:
    """Spark's options for a table, topic, collection or path of a connection."""
    kind = FAMILIES[c.family][0]
    if kind == "jdbc":
        out = {"url": jdbc_url(c), "dbtable": item, "fetchsize": "10000"}
        # A range of a key, so that executors read in parallel.
        return out | {k: str(c.config[k]) for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions") if k in c.config}
    if kind == "kafka":
        return {"kafka.bootstrap.servers": c.config["bootstrap"], "subscribePattern": item or ".*", "startingOffsets": "earliest"}
    if kind == "mongodb":
        return {"connection.uri": c.config["cluster"], "database": c.config["database"], "collection": item}
    if kind == "velarium_search":
        return {k: str(v) for k, v in c.config.items()} | {"index": item}
    if kind == "org.apache.spark.sql.cassandra":
        return {"keyspace": c.config["keyspace"], "table": item}
    return {k: str(v) for k, v in c.config.items() if k not in ("path", "ref")}


def read(spark: SparkSession, c: Connection, item: str = "", schema=None) -> DataFrame:
    """A table of an active connection. File families read the item below their path; give a schema, so that none is inferred."""
    if c.state != "ACTIVE":
        raise ValueError(f"{c.name} is {c.state}")
    kind = FAMILIES[c.family][0]
    if kind == "quads":
        return read_quads(spark, c.config["address"])
    reader = spark.read.format(kind).options(**options(c, item))
    if schema is not None:
        reader = reader.schema(schema)
    if "path" in c.config:
        if c.family == "github":
            reader = reader.option("wholetext", "true").option("recursiveFileLookup", "true")
        return reader.load("/".join(p for p in (c.config["path"].rstrip("/"), item) if p))
    return reader.load()


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    """N-Quads text to subject, predicate, object, graph; lines that aren't quads are left out."""
    from pyspark.sql import functions as F

    term = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^>]*>)?)'
    line = rf"^\s*{term}\s+(<[^>]*>)\s+{term}\s*(<[^>]*>|_:\S+)?\s*\.\s*$"
    parts = [F.regexp_extract("value", line, k).alias(n) for k, n in enumerate(("subject", "predicate", "object", "graph"), 1)]
    return spark.read.text(path).select(*parts).where("subject <> ''").withColumn("graph", F.nullif("graph", F.lit("")))


def preview_rows(latest: DataFrame, incoming: DataFrame) -> DataFrame:
    """latest and incoming (name, family, config, revision) -> name, outcome: created, updated, unchanged, conflict (a revision that isn't newer), or error (no name, family or config)."""
    from pyspark.sql import functions as F

    old = latest.select("name", F.col("family").alias("__f"), F.col("config").alias("__c"), F.col("revision").alias("__r"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    outcome = F.when(blank("name") | blank("family") | blank("config"), "error").when(F.col("__r").isNull(), "created")
    outcome = outcome.when((F.col("__c") == F.col("config")) & (F.col("__f") == F.col("family")), "unchanged").when(F.col("revision") > F.col("__r"), "updated").otherwise("conflict")
    return incoming.join(old, "name", "left").select("name", outcome.alias("outcome"))


def preview(latest: dict[str, Connection], incoming: list[Connection]) -> dict[str, str]:
    """What an import would do: created, updated, unchanged, or conflict (a revision that isn't newer)."""
    out = {}
    for c in incoming:
        old = latest.get(c.name)
        if old is None:
            out[c.name] = "created"
        elif old.config == c.config and old.family == c.family:
            out[c.name] = "unchanged"
        else:
            out[c.name] = "updated" if c.revision > old.revision else "conflict"
    return out


def intake_errors(files: list[tuple[str, int]], most: int = 10, each: int = 10 << 20, total: int = 25 << 20) -> list[str]:
    """What speaks against taking files (name, bytes) in."""
    out = [f"more than {most} files"] if len(files) > most else []
    out += [f"{name} is over {each} bytes" for name, size in files if size > each]
    return out + ([f"together over {total} bytes"] if sum(s for _, s in files) > total else [])


def select_items(items: list[str], patterns: list[str]) -> list[str]:
    """Discovered items inside a scope of shell patterns."""
    return [i for i in items if any(fnmatch(i, p) for p in patterns)]


def to_yaml(c: Connection) -> str:
    """Two levels of plain keys; values as JSON, which YAML reads."""
    lines = [f"name: {json.dumps(c.name)}", f"family: {c.family}", f"revision: {c.revision}", "config:"]
    return "\n".join(lines + [f"  {k}: {json.dumps(v, sort_keys=True)}" for k, v in sorted(c.config.items())]) + "\n"


def from_yaml(text: str) -> Connection:
    top, config, inside = {}, {}, False
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, sep, value = line.strip().partition(":")
        if not sep:
            raise ValueError(f"not a setting: {line!r}")
        value = value.strip()
        if not line.startswith(" "):
            inside = key == "config"
            if not inside:
                top[key] = value
        elif inside:
            try:
                config[key] = json.loads(value)
            except ValueError:
                config[key] = value
    return Connection(json.loads(top["name"]) if top["name"].startswith('"') else top["name"], top["family"], config, int(top.get("revision", 1)))
