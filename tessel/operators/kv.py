"""Reads of an ordered table by key: points, neighbours, prefixes and ranges.

All are filters that Parquet can prune by (comparisons of the key with constants), with a
top-1 or an aggregate behind where one row or number is asked for; no read sorts a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import text_successor

#: Points in a span of an as-of join.
SPAN = 50_000


def get(df: DataFrame, **key) -> DataFrame:
    """The rows at a key; equality on leading columns gives a prefix read."""
    for name, value in key.items():
        df = df.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return df


def scan(df: DataFrame, *keys: str, reverse: bool = False) -> DataFrame:
    """All rows in key order, nulls first, or the other way round."""
    return df.orderBy(*(F.col(k).desc_nulls_last() if reverse else F.col(k).asc_nulls_first() for k in keys))


def multi_get(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Each asked key with its row, and found; keys that aren't there keep null columns.

    Other columns of keys, such as the number of the request, stay beside them.
    """
    there = df.withColumn("found", F.lit(True))
    return keys.join(there, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def between(column: Column, low=None, high=None) -> Column:
    """low <= column < high; None is no bound."""
    inside = F.lit(True)
    if low is not None:
        inside = column >= F.lit(low)
    if high is not None:
        inside = inside & (column < F.lit(high))
    return inside


def range_scan(df: DataFrame, key: str, low=None, high=None) -> DataFrame:
    return df.where(between(F.col(key), low, high))


def prefix_scan(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose text key begins with prefix, as a range that Parquet statistics can prune."""
    return range_scan(df, key, prefix, text_successor(prefix))


def range_count(df: DataFrame, key: str, low=None, high=None) -> DataFrame:
    return range_scan(df, key, low, high).agg(F.count(F.lit(1)).alias("n"))


def range_empty(df: DataFrame, key: str, low=None, high=None) -> DataFrame:
    return range_scan(df, key, low, high).limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))


def lower_bound(df: DataFrame, key: str, at) -> DataFrame:
    """The first row at or after a key."""
    return df.where(F.col(key) >= F.lit(at)).orderBy(key).limit(1)


def upper_bound(df: DataFrame, key: str, at) -> DataFrame:
    """The first row after a key."""
    return df.where(F.col(key) > F.lit(at)).orderBy(key).limit(1)


def seek_for_prev(df: DataFrame, key: str, at) -> DataFrame:
    """The last row at or before a key."""
    return df.where(F.col(key) <= F.lit(at)).orderBy(F.desc(key)).limit(1)


def less_than(df: DataFrame, key: str, at) -> DataFrame:
    """The last key before a key."""
    return df.where(F.col(key) < F.lit(at)).agg(F.max(key).alias(key))


def prefix_max(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """The last key with a prefix."""
    return prefix_scan(df, key, prefix).agg(F.max(key).alias(key))


def as_of(probes: DataFrame, points: DataFrame, by: str, at: str, point_at: str, value: str, width: int | None = None) -> DataFrame:
    """For each probe, the value of the latest point of the same `by` at or before it.

    at and point_at are longs (microseconds for times).  Time is cut into spans of width,
    which by default gives a span SPAN points of all keys together.
    Inside a span a window looks back; the value from earlier spans is carried over a
    table with one row for each key and span.  So a key with very many rows is spread
    over its spans instead of filling one task.
    """
    if width is None:
        low, high, n = points.agg(F.min(point_at), F.max(point_at), F.count(F.lit(1))).first()
        width = (high - low) // max(1, n // SPAN) + 1 if n else 1
    span = lambda c: F.floor(F.col(c) / F.lit(width))
    names = probes.columns
    asked = probes.withColumn("span", span(at))
    given = points.select(F.col(by).alias("_by"), F.col(point_at).alias("_at"), F.col(value).alias("_value")).withColumn("_span", span("_at"))
    last = given.groupBy("_by", "_span").agg(F.max_by(F.struct("_value"), "_at").alias("_last"))
    spans = asked.select(F.col(by).alias("_by"), F.col("span").alias("_span")).distinct()
    both = last.join(spans, ["_by", "_span"], "full")
    before = Window.partitionBy("_by").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).select(F.col("_by").alias(by), F.col("_span").alias("span"), "_carried")
    mixed = asked.select(F.col(by), "span", F.col(at).alias("_at"), F.lit(1).alias("_turn"), F.struct(*names).alias("_row"), F.lit(None).cast(given.select(F.struct("_value")).schema[0].dataType).alias("_point"))
    mixed = mixed.unionByName(given.select(F.col("_by").alias(by), F.col("_span").alias("span"), "_at", F.lit(0).alias("_turn"), F.lit(None).cast(mixed.schema["_row"].dataType).alias("_row"), F.struct("_value").alias("_point")))
    inside = Window.partitionBy(by, "span").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    seen = mixed.withColumn("_seen", F.last("_point", ignorenulls=True).over(inside)).where("_turn = 1").select(by, "span", "_row", "_seen")
    return seen.join(carried, [by, "span"], "left").select("_row.*", F.coalesce("_seen", "_carried")["_value"].alias(value))


def tree_stats(df: DataFrame, *columns: str) -> DataFrame:
    """Rows, and bytes of the given text columns."""
    return df.agg(F.count(F.lit(1)).alias("n_keys"), *(F.sum(F.octet_length(c)).alias(f"{c}_bytes") for c in columns))


def is_subtree(df: DataFrame, value: str) -> Column:
    """True where a value is a nested table (struct, array or map) and not null."""
    kind = df.schema[value].dataType.simpleString()
    return F.col(value).isNotNull() & F.lit(kind.startswith(("struct", "array", "map")))


def subtree(df: DataFrame, key: str, value: str, at) -> DataFrame:
    """The rows of the table nested under a key."""
    return get(df, **{key: at}).select(F.inline(value))


def put_subtree(df: DataFrame, key: str, value: str, at, rows: DataFrame, by: str) -> DataFrame:
    """df with rows nested under a key, sorted by a column of theirs, in place of what it held.

    One value holds the whole nested table, so it must fit a row.
    """
    names = [by, *(c for c in rows.columns if c != by)]
    nested = rows.agg(F.array_sort(F.collect_list(F.struct(*names))).alias(value)).select(F.lit(at).cast(df.schema[key].dataType).alias(key), value)
    return df.where(~F.col(key).eqNullSafe(F.lit(at))).unionByName(nested, allowMissingColumns=True)
