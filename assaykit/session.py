"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def get_spark(app: str = "assaykit", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs expect: UTC, ANSI casts, adaptive execution.

    The number of shuffle partitions is left to the cluster; adaptive execution coalesces them and
    splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def workspace(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a folder of its own; on a cluster a folder on one
    machine would be invisible to the executors, so the setting is required there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="assaykit-")
        _LOCAL[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read back: worked out once, safe against lost executors."""
    path = workspace(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def files_of(spark: SparkSession, path: str):
    """File system and path object of a location."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    files, target = files_of(spark, path)
    files.delete(target, True)


class Staging:
    """Ledger of what a job writes on its way: all of it is deleted when the block ends, also if it fails.

    Used as ``with Staging(spark) as stage``; ``stage(rows, name)`` is :func:`stored` with an entry in the ledger. Results that still
    read from it must be written or collected within the block.
    """

    def __init__(self, spark: SparkSession, base: str | None = None) -> None:
        self.spark, self.base, self.paths = spark, base, []

    def path(self, name: str) -> str:
        path = f"{self.base}/{name}-{uuid.uuid4().hex}" if self.base else workspace(self.spark, name)
        self.paths.append(path)
        return path

    def __call__(self, rows: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        rows.write.parquet(path)
        return self.spark.read.parquet(path)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        while self.paths:
            delete(self.spark, self.paths.pop())
