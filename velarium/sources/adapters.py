"""Sources that Spark has no reader for, as Python data sources over the standard library, and the steps test, discover and capture.

`velarium_redis` reads keys by SCAN, a partition for each key prefix that it is given. `velarium_graph` reads a property
graph by pages of a query over HTTP, a partition for each run of pages. `velarium_search` reads an index of a search
service by slices. Executors open the connections; the driver only plans.
"""

from __future__ import annotations

import json
import socket
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from velarium.session import is_folder
from velarium.sources.registry import FAMILIES, Connection, read, select_items


@dataclass
class Part(InputPartition):
    value: object


class _Redis:
    """As much of the protocol as reading needs."""

    def __init__(self, address: str, database: str):
        host, _, port = address.rpartition(":")
        self.socket = socket.create_connection((host, int(port)), timeout=30)
        self.file = self.socket.makefile("rb")
        self.ask("SELECT", database)

    def ask(self, *words: str):
        self.socket.sendall(b"*%d\r\n" % len(words) + b"".join(b"$%d\r\n%s\r\n" % (len(w.encode()), w.encode()) for w in words))
        return self.answer()

    def answer(self):
        line = self.file.readline().rstrip(b"\r\n")
        kind, rest = line[:1], line[1:]
        if kind == b"-":
            raise OSError(rest.decode())
        if kind == b":":
            return int(rest)
        if kind == b"$":
            return None if rest == b"-1" else self.file.read(int(rest) + 2)[:-2].decode("utf-8", "replace")
        if kind == b"*":
            return [self.answer() for _ in range(int(rest))]
        return rest.decode()

    def close(self) -> None:
        self.file.close()
        self.socket.close()


def _pairs(flat: list) -> str:
    return json.dumps(dict(zip(flat[::2], flat[1::2], strict=True)))


class _RedisReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [Part(p) for p in self.options.get("prefixes", "").split(",")]

    def read(self, partition: Part) -> Iterator[tuple]:
        redis, cursor, seen = _Redis(self.options["address"], self.options.get("database", "0")), "0", set()
        try:
            while True:
                cursor, keys = redis.ask("SCAN", cursor, "MATCH", f"{partition.value}*", "COUNT", "1000")
                for key in keys:
                    if key in seen:  # SCAN may give a key twice
                        continue
                    seen.add(key)
                    kind = redis.ask("TYPE", key)
                    value = redis.ask("GET", key) if kind == "string" else _pairs(redis.ask("HGETALL", key)) if kind == "hash" else None
                    yield key, kind, value
                if cursor == "0":
                    return
        finally:
            redis.close()


class RedisSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "velarium_redis"

    def schema(self) -> str:
        return "key string, type string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _RedisReader(dict(self.options))


def _post(url: str, body: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Accept": "application/json"})
    with urllib.request.urlopen(request, timeout=60) as answer:
        return json.load(answer)


class _GraphReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.size = options, int(options.get("page", "1000"))

    def ask(self, statement: str) -> list:
        answer = _post(self.options["address"], {"statements": [{"statement": statement}]})
        if answer.get("errors"):
            raise OSError(str(answer["errors"])[:300])
        return [row["row"] for row in answer["results"][0]["data"]]

    def partitions(self):
        total = self.ask(f"{self.options['match']} RETURN count(*)")[0][0]
        step = max(self.size, -(-total // int(self.options.get("parts", "8"))))
        return [Part((a, min(total, a + step))) for a in range(0, total, step)]

    def read(self, partition: Part) -> Iterator[tuple]:
        start, end = partition.value
        for at in range(start, end, self.size):
            for row in self.ask(f"{self.options['match']} RETURN {self.options['return']} ORDER BY {self.options['order']} SKIP {at} LIMIT {min(self.size, end - at)}"):
                yield (json.dumps(row, sort_keys=True),)


class GraphSource(DataSource):
    """Options: address, match (a pattern), return and order (what is read, and an order of it that is total)."""

    @classmethod
    def name(cls) -> str:
        return "velarium_graph"

    def schema(self) -> str:
        return "row string"

    def reader(self, schema) -> DataSourceReader:
        return _GraphReader(dict(self.options))


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.parts = options, int(options.get("parts", "2"))

    def partitions(self):
        return [Part(k) for k in range(self.parts)]

    def read(self, partition: Part) -> Iterator[tuple]:
        base, size = self.options["address"].rstrip("/"), int(self.options.get("page", "1000"))
        body = {"size": size, "query": json.loads(self.options.get("query", '{"match_all": {}}')), "sort": ["_doc"]}
        if self.parts > 1:
            body["slice"] = {"id": partition.value, "max": self.parts}
        answer = _post(f"{base}/{self.options['index']}/_search?scroll=5m", body)
        while answer["hits"]["hits"]:
            for hit in answer["hits"]["hits"]:
                yield hit["_id"], json.dumps(hit["_source"], sort_keys=True)
            answer = _post(f"{base}/_search/scroll", {"scroll": "5m", "scroll_id": answer["_scroll_id"]})


class SearchSource(DataSource):
    """Options: address, index, query (JSON), parts."""

    @classmethod
    def name(cls) -> str:
        return "velarium_search"

    def schema(self) -> str:
        return "id string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (RedisSource, GraphSource, SearchSource):
        spark.dataSource.register(source)


def check(spark: SparkSession, c: Connection) -> list[str]:
    """What speaks against a connection: its folder isn't there, or its service doesn't answer."""
    if "path" in c.config:
        try:
            is_folder(spark, c.config["path"])
            return []
        except Exception as error:
            return [str(error).splitlines()[0][:200]]
    address = c.config.get("address") or f"{c.config.get('host')}:{c.config.get('port')}"
    host, _, port = address.partition("//")[2].partition("/")[0].rpartition(":") if "//" in address else address.rpartition(":")
    try:
        socket.create_connection((host, int(port)), timeout=5).close()
        return []
    except (OSError, ValueError) as error:
        return [f"{address}: {error}"]


def discover(spark: SparkSession, c: Connection) -> list[str]:
    """The items of a connection: entries of its folder, or tables of its database."""
    if "path" in c.config:
        path = spark._jvm.org.apache.hadoop.fs.Path(c.config["path"])
        listed = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
        return sorted(s.getPath().getName() for s in listed if not s.getPath().getName().startswith(("_", ".")))
    if FAMILIES[c.family][0] == "jdbc" and "catalog_query" in c.config:
        rows = spark.read.format("jdbc").options(url=c.config["url"], query=c.config["catalog_query"]).load().collect()  # a row for each table
        return sorted(r[0].strip() for r in rows)
    return []


def capture(spark: SparkSession, c: Connection, scope: list[str], schema=None) -> DataFrame:
    """item, n, fingerprint: of each discovered item in scope, its rows and a digest that doesn't depend on their order. Read in parallel; only counts and digests leave."""
    out = None
    for item in select_items(discover(spark, c), scope):
        rows = read(spark, c, item, schema)
        digest = F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
        one = rows.agg(F.count(F.lit(1)).alias("n"), F.hex(F.bit_xor(digest)).alias("a"), F.coalesce(F.sum(F.pmod(digest, F.lit(1 << 40))), F.lit(0)).alias("b"))
        one = one.select(F.lit(item).alias("item"), "n", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("fingerprint"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "item string, n long, fingerprint string")
