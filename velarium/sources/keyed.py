"""Tables by key that change in part: buckets of keys, a folder for each bucket's rows, and a manifest for each version.

An upsert or a delete writes new folders for the buckets that it touches and a manifest that names these and,
for all others, the folders there were. A version is published by creating its manifest, which fails if another
writer made one of that number; so readers see one version or the next, and no file is renamed or written over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from velarium.session import discard, materialize


class Conflict(RuntimeError):
    """Another writer published this version first."""


class Files:
    """The file operations that manifests need, on any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Conflict if there is such a file."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception as error:
            if "AlreadyExists" in str(error):
                raise Conflict(name) from error
            raise
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class KeyedTable:
    """Rows with distinct keys (not NULL), in buckets by a hash of the key."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        """Open a version, the last where none is named."""
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        names = [n for n in self.files.names("manifests") if n.endswith(".json")]
        if not names:
            raise FileNotFoundError(path)
        self.version = int(names[-1][:-5]) if version is None else version
        self.manifest = json.loads(self.files.read(f"manifests/{self.version:012d}.json"))
        self.keys: list[str] = self.manifest["keys"]
        self.schema = StructType.fromJson(self.manifest["schema"])
        #: Folder of each bucket that has rows.
        self.folders: dict[int, str] = {int(b): f for b, f in self.manifest["folders"].items()}

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> KeyedTable:
        """The first version. buckets: so many that each one's rows suit one task."""
        spark, files = df.sparkSession, Files(df.sparkSession, path)
        files.create("manifests/000000000000.json", json.dumps({"keys": keys, "buckets": buckets, "schema": df.schema.jsonValue(), "folders": {}}))
        return cls(spark, path).upsert(df)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.manifest["buckets"])).cast("int")

    def _read(self, buckets: list[int]) -> DataFrame:
        folders = [f"{self.path}/{self.folders[b]}" for b in buckets if b in self.folders]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        return self._read(sorted(self.folders))

    def get(self, wanted: DataFrame) -> DataFrame:
        """Rows of the keys in wanted; only buckets that may hold them are read."""
        return self._read(self._touched(wanted)).join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        """As many as buckets at most."""
        return sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())

    def upsert(self, new: DataFrame) -> KeyedTable:
        """The next version, with new's rows in place of those with their keys. ValueError where new has a key twice or a NULL in one."""
        new = materialize(new.select(*self.schema.names), "upsert")
        missing = F.greatest(*[F.col(k).isNull() for k in self.keys], F.lit(False))
        if not new.where(missing).isEmpty() or not new.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError("keys must be distinct and not NULL")
        touched = self._touched(new)
        kept = self._read(touched).join(new.select(*self.keys), self.keys, "left_anti")
        try:
            return self._publish(kept.select(*self.schema.names).unionByName(new), touched)
        finally:
            discard(new)

    def delete(self, which: Column) -> KeyedTable:
        """The next version, without the rows for which a condition holds. Only buckets that have such rows are written again."""
        touched = self._touched(self.rows().where(which))
        return self._publish(self._read(touched).where(~F.coalesce(which, F.lit(False))), touched)

    def delete_range(self, key: str, low, high) -> KeyedTable:
        """Without keys from low up to (without) high."""
        return self.delete((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high)))

    def _publish(self, rows: DataFrame, touched: list[int]) -> KeyedTable:
        folder = f"data/{self.version + 1:012d}-{uuid.uuid4().hex}"
        rows.withColumn("__bucket", self._bucket()).repartition(max(1, len(touched)), "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        written = {int(n.partition("=")[2]): f"{folder}/{n}" for n in self.files.names(folder) if n.startswith("__bucket=")}
        folders = {b: f for b, f in self.folders.items() if b not in touched} | written
        manifest = self.manifest | {"folders": {str(b): f for b, f in sorted(folders.items())}}
        try:
            self.files.create(f"manifests/{self.version + 1:012d}.json", json.dumps(manifest))
        except Conflict:
            self.files.delete(folder)
            raise
        return KeyedTable(self.spark, self.path, self.version + 1)

    def vacuum(self, keep: int = 1) -> int:
        """Delete versions but the last few, and folders that none of these names; how many folders went. Readers of older versions must be done."""
        names = [n for n in self.files.names("manifests") if n.endswith(".json")]
        for name in names[:-keep]:
            self.files.delete(f"manifests/{name}")
        used = {f.split("/")[1] for name in names[-keep:] for f in json.loads(self.files.read(f"manifests/{name}"))["folders"].values()}
        gone = [n for n in self.files.names("data") if n not in used]
        for name in gone:
            self.files.delete(f"data/{name}")
        return len(gone)
