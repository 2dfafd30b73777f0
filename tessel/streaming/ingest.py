"""Micro-batches of a stream upserted into a versioned table, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.resolve import newest
from ..sources.database import Database


def read_files(spark: SparkSession, folder: str, schema: StructType | str, max_files: int = 100, kind: str = "parquet") -> DataFrame:
    """A stream of a folder's files; max_files bounds what one batch takes on."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(kind).load(folder)


def upsert_stream(stream: DataFrame, database: Database, table: str, order: list[str], checkpoint: str, name: str | None = None, once: bool = False, interval: str = "1 second", max_log: int = 8) -> StreamingQuery:
    """Start a query that keeps the table at the newest row of each key.

    A batch that finds max_log folders in the table's log drains them first, so that
    reads stay cheap; the source waits meanwhile.

    order: columns that tell which of a batch's rows of one key is the newest.  A batch
    that runs again after a failure is known by its number and leaves no second trace.
    """
    keys = database.manifest["tables"][table]["primary_key"]
    if len(keys) != 1:
        raise ValueError("the table needs a primary key of one column")
    source = name or table

    def put(rows: DataFrame, batch_id: int) -> None:
        database.refresh()
        if len(database.manifest["tables"][table]["log"]) >= max_log:
            database.compact(table)
        database.apply_batch(table, source, batch_id, newest(rows, keys[0], order))

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def windowed_counts(stream: DataFrame, at: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts per window of event time; rows later than `late` behind the newest are dropped."""
    from pyspark.sql import functions as F

    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n"))
