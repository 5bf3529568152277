"""Content-addressed documents, snapshots and batches as Parquet, and small archive and Markdown sinks."""

from __future__ import annotations

import hashlib  # noqa: F401  for users of filters
import io
import json
import re
import uuid
import zipfile
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from velarium.functions.scalar import content_ref
from velarium.session import discard, materialize
from velarium.sources.keyed import Conflict, Files

#: The nine sections of a standard document, in order.
SECTIONS = ("Overview", "Entities", "Events", "Relations", "Metrics", "Rules", "Calendars", "Evidence", "Open questions")


#: Bits of a filter for each digest, and hash functions: 1 in 100 digests that aren't there may seem to be.
FILTER_BITS, FILTER_HASHES = 10, 7


def _places(refs: pd.Series, size: int) -> np.ndarray:
    """A digest's places in a filter, a row for each; digests are uniform, so parts of them serve as hashes."""
    halves = np.array([(int(r[-32:-16], 16), int(r[-16:], 16) | 1) for r in refs], np.uint64).reshape(-1, 2)
    return (halves[:, :1] + np.arange(FILTER_HASHES, dtype=np.uint64) * halves[:, 1:]) % np.uint64(size)


def make_filter(refs: pd.Series) -> bytes:
    bits = np.zeros(max(64, -(-len(refs) * FILTER_BITS // 8) * 8), bool)
    bits[_places(refs, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(data: bytes, refs: pd.Series) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)
    return bits[_places(refs, len(bits))].all(axis=1)


class ContentStore:
    """Texts under the digest of their content. A text is written once; what is there is never changed.

    Each put that brings something new makes a segment: texts in folders by the first digits of their digests, and a Bloom
    filter of each folder's digests. A put looks its digests up in the filters and reads only the folders that may
    hold one of them, so what it reads follows the batch, not the store. digits: hexadecimal, so many that a
    folder's digests of one put suit a task.
    """

    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits

    def _there(self, what: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def all(self) -> DataFrame:
        schema = "ref string, content string, segment string, folder string"
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/texts") if self._there("texts") else self.spark.createDataFrame([], schema)
        return rows.select("ref", "content", "segment", "folder")

    def _folder(self):
        return F.substring("ref", len("sha256:") + 1, self.digits)

    def candidates(self, refs: DataFrame) -> DataFrame:
        """refs (ref) -> segment, folder: those that may hold one of refs, by their filters."""
        if not self._there("filters"):
            return self.spark.createDataFrame([], "segment string, folder string")
        filters = self.spark.read.schema("folder string, bits binary, segment string").parquet(f"{self.path}/filters")

        def look_up(mine: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            hits = [(s, f) for s, f, bits in zip(held.segment, held.folder, held.bits, strict=True) if len(mine) and may_hold(bits, mine.ref).any()]
            return pd.DataFrame(hits, columns=["segment", "folder"])

        return refs.select("ref", self._folder().alias("folder")).groupBy("folder").cogroup(filters.groupBy("folder")).applyInPandas(look_up, "segment string, folder string")

    def known(self, refs: DataFrame) -> DataFrame:
        """refs (ref) -> ref of those that are there. Reads the folders that candidates() names."""
        found = [(r.segment, r.folder) for r in self.candidates(refs).collect()]  # as many as the folders of all segments at most
        if not found:
            return refs.select("ref").limit(0)
        rows = self.spark.read.schema("ref string").parquet(*[f"{self.path}/texts/segment={s}/folder={f}" for s, f in found])
        return refs.select("ref").join(rows.select("ref"), "ref", "left_semi")

    @staticmethod
    def named(texts: DataFrame) -> DataFrame:
        """texts (content) -> ref, content of each distinct text."""
        return texts.select(content_ref(F.col("content")).alias("ref"), "content").dropDuplicates(["ref"])

    def missing(self, texts: DataFrame) -> DataFrame:
        """texts (content) -> ref, content of those that aren't there yet."""
        fresh = materialize(self.named(texts), "put")
        return fresh.join(self.known(fresh), "ref", "left_anti")

    def put(self, texts: DataFrame) -> DataFrame:
        """texts (content) -> ref, content of each distinct text; a segment of those that aren't there is added."""
        new = materialize(self.missing(texts).withColumn("folder", self._folder()), "new")
        if not new.isEmpty():
            segment = uuid.uuid4().hex

            def bits(rows: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame({"folder": [rows.folder.iloc[0]], "bits": [make_filter(rows.ref)]})

            new.repartition("folder").write.partitionBy("folder").parquet(f"{self.path}/texts/segment={segment}")
            # Texts without filters would be written again by a later put, which does no harm, so filters come last.
            new.select("ref", "folder").groupBy("folder").applyInPandas(bits, "folder string, bits binary").write.parquet(f"{self.path}/filters/segment={segment}")
        discard(new)
        return self.named(texts)

    def get(self, refs: DataFrame) -> DataFrame:
        """refs (ref) -> ref, content; a content that doesn't give its ref is left out."""
        texts = self.all().select("ref", "content").dropDuplicates(["ref", "content"])
        return refs.join(texts, "ref").where(F.col("ref") == content_ref(F.col("content")))

    def broken(self) -> DataFrame:
        return self.all().where(F.col("ref") != content_ref(F.col("content"))).select("ref")


def new_captures(captures: DataFrame, known: DataFrame) -> DataFrame:
    """Captures whose fingerprint wasn't seen."""
    return captures.join(known.select("fingerprint").distinct(), "fingerprint", "left_anti")


def freeze_batch(snapshots: DataFrame) -> DataFrame:
    """snapshots (batch, snapshot) -> batch, members, identity: distinct snapshot ids in order, and a digest over them."""
    members = F.array_sort(F.collect_set("snapshot"))
    return snapshots.groupBy("batch").agg(members.alias("members")).withColumn("identity", F.sha2(F.array_join("members", "\n"), 256))


def batches(df: DataFrame, size: int = 1000) -> DataFrame:
    """df with batch: numbers of groups of at most `size` rows, each inside one task."""
    number = F.monotonically_increasing_id()  # counts up inside each partition
    return df.withColumn("batch", F.floor(number / size).cast("long") if size >= 1 else F.lit(None).cast("long"))


def scan_directory(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int = 10 << 20) -> DataFrame:
    """path, bytes, sha256, issue of each file of a source tree that fits a pattern: TOO_LARGE ones aren't digested, and empty ones aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    large = F.col("length") > most_bytes
    return files.select("path", F.col("length").alias("bytes"), F.when(~large, F.sha2("content", 256)).alias("sha256"), F.when(large, "TOO_LARGE").alias("issue"))


def admit_xml(df: DataFrame, column: str) -> DataFrame:
    """df with rejected: null for XML that may be read, else why not. Document types and entities are refused unparsed, whatever they say."""
    text = F.col(column)
    root = F.regexp_extract(text, r"(?s)^\s*(?:<\?xml[^>]*\?>\s*)?(?:<!--.*?-->\s*)*<([A-Za-z_][\w.-]*)", 1)
    why = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "EMPTY").when(text.rlike(r"(?i)<!DOCTYPE"), "DOCTYPE").when(text.rlike(r"(?i)<!ENTITY|<\?(?!xml[\s?])|xi:include"), "ENTITY_OR_INCLUDE")
    why = why.when(root == "", "NOT_XML").when(~F.rtrim(text).endswith(F.concat(F.lit("</"), root, F.lit(">"))) & ~F.rtrim(text).endswith("/>"), "UNCLOSED")
    return df.withColumn("rejected", why)


def publish(df: DataFrame, path: str) -> None:
    """Write df beside its place, then move it there: readers see all of it or nothing. What is published is never replaced."""
    spark = df.sparkSession
    at, staged = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"))
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(at):
        raise FileExistsError(path)
    df.write.parquet(staged.toString())
    if not fs.rename(staged, at):
        fs.delete(staged, True)
        raise FileExistsError(path)


class Versions:
    """Numbered versions of a few tables, from 1. Tables are written to folders of their own; a version is a file that names
    them and is created only if there is none of its number, so of two writers one wins on any store, and nothing is
    renamed. Folders of a writer that lost, or was killed, are named by no version and may be cleaned away.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def last(self) -> int:
        """The last version's number; 0 before the first."""
        return max((int(n[1:-5]) for n in self.files.names("versions") if re.fullmatch(r"v\d+\.json", n)), default=0)

    def put(self, expected: int, **tables: DataFrame) -> int:
        """Publish tables as the version after `expected`, which has to be the last one (else FileExistsError) -> its number."""
        if self.last() != expected:
            raise FileExistsError(f"{self.path} isn't at version {expected}")
        named = {}
        for name, df in tables.items():
            named[name] = {"folder": f"data/{name}-{uuid.uuid4().hex}", "schema": df.schema.jsonValue()}
            df.write.parquet(f"{self.path}/{named[name]['folder']}")
        try:
            self.files.create(f"versions/v{expected + 1:012d}.json", json.dumps(named))
        except Conflict as error:
            raise FileExistsError(f"{self.path} has version {expected + 1}") from error
        return expected + 1

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version, of the last where none is named."""
        named = json.loads(self.files.read(f"versions/v{self.last() if version is None else version:012d}.json"))[name]
        return self.spark.read.schema(StructType.fromJson(named["schema"])).parquet(f"{self.path}/{named['folder']}")


def compare_and_set(spark: SparkSession, path: str, expected: int, df: DataFrame) -> int:
    """Publish df as the version after `expected`; another writer's version there already, or one that isn't there yet, is a conflict (FileExistsError). Returns the version."""
    return Versions(spark, path).put(expected, rows=df)


def freeze(items: DataFrame, bodies: DataFrame, path: str, size: int = 100) -> tuple[int, DataFrame]:
    """Check items against bodies in batches (`evidence.verify_batches`) as the next attempt under path -> its number and progress.

    Each attempt keeps its progress and what it verified there; the next one reads only bodies that none before it verified.
    Of two attempts at once the later one fails (FileExistsError).
    """
    from velarium.operators.evidence import verify_batches

    attempts = Versions(items.sparkSession, path)
    before = attempts.last()
    # Each attempt keeps what it read itself.
    known = reduce(DataFrame.unionByName, [attempts.read("verified", n) for n in range(1, before + 1)]) if before else None
    progress, verified = verify_batches(items, bodies, size, known)
    number = attempts.put(before, progress=progress, verified=verified)
    return number, attempts.read("progress", number)


def range_scan(df: DataFrame, key: str, prefix: str, after: str | None = None, size: int = 20) -> DataFrame:
    """Keys with a prefix, after a cursor: pushed down to the files' statistics as a range."""
    rows = df.where((F.col(key) >= prefix) & (F.col(key) < prefix + "\U0010ffff"))
    return (rows.where(F.col(key) > after) if after is not None else rows).orderBy(key).limit(size + 1)


def render_markdown(title: str, sections: dict[str, str]) -> str:
    if unknown := set(sections) - set(SECTIONS):
        raise ValueError(f"unknown sections {sorted(unknown)}")
    return f"# {title}\n" + "".join(f"\n## {n}. {name}\n\n{sections.get(name, '').strip()}\n" for n, name in enumerate(SECTIONS, 1))


def parse_markdown(text: str) -> tuple[str, dict[str, str]]:
    """Title and sections; ValueError unless all nine are there, in order."""
    head, *parts = re.split(r"(?m)^## ", text)
    names = [re.match(r"\d+\. (.*)", p)[1] for p in parts if re.match(r"\d+\. ", p)]
    if tuple(names) != SECTIONS or len(parts) != len(SECTIONS):
        raise ValueError("not the nine sections")
    return head.strip().removeprefix("# "), {n: p.partition("\n")[2].strip() for n, p in zip(names, parts, strict=True)}


def zip_stored(entries: dict[str, bytes]) -> bytes:
    """An archive without compression, the same for the same entries."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        for name in sorted(entries):
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), entries[name])
    return out.getvalue()
