"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import shared_dir

#: Tables and folders that results still read.
_live: set[str] = set()


#: Session settings for rows that hold whole texts, which bound what a task holds at once.
#: Each takes the place of Spark's default (named first); other values of a session stay.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512")}
#: Removes a write's shuffle files when it is done, instead of when the driver collects its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a row group: what a writer, and a reader of one column, holds at most.
ROW_GROUP = 16 << 20


def settle(spark: SparkSession) -> SparkSession:
    """The session with small batches."""
    own = spark.sparkContext.getConf()
    for name, (default, value) in SETTINGS.items():
        if not own.contains(name) and spark.conf.get(name) == default:
            spark.conf.set(name, value)
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessel/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        _live.discard(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def keep(path: str) -> str:
    """Note a folder that a result reads, for clean()."""
    _live.add(path)
    return path


def clean(spark: SparkSession) -> int:
    """Delete all tables and folders that results of this process read, when none is needed any more."""
    gone = list(_live)
    drop(spark, *gone)
    return len(gone)


class Store:
    """Tables written by one run; each cuts the lineage and outlives executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = settle(spark), name, {}

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Write df as Parquet and read it back; the shuffle files that led to it go."""
        path = new_path(self.spark, f"{self.name}-{name}")
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.paths.setdefault(name, []).append(path)
        _live.add(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables."""
        for name in names:
            drop(self.spark, *self.paths.pop(name, []))

    def drop_but(self, *names: str) -> None:
        """Delete all tables but these."""
        self.drop(*[name for name in self.paths if name not in names])
