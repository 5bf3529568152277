"""Session settings shared by tests, the bench and local runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold for any master; sizes of partitions are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on one machine; on a cluster, build the session with its own settings."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("velarium")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; on one machine, a folder of our own where none is set."""
    global _own_dir
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="velarium-")
    return _own_dir


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: this cuts lineage and outlives executors."""
    path = f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written


def discard(df: DataFrame) -> None:
    """Delete the files of a table of materialize() that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that are written and that nothing refers to any more: it does so when the driver's heap is collected, which a small heap's own collections put off."""
    spark.range(1).count()  # the last execution is still referred to until another one ends
    spark._jvm.System.gc()


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store is a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()
