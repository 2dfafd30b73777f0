"""Maps with several sorted values for a key, and cursor moves over all rows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dml import ConstraintError
from .spans import SPAN, following


def first_last(df: DataFrame, key: str, value: str) -> DataFrame:
    """The first and last value of each key, and their number."""
    return df.groupBy(key).agg(F.min(value).alias("first_value"), F.max(value).alias("last_value"), F.count(F.lit(1)).alias("n"))


def count(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def moves(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each distinct pair with the next and previous value of its key; one shuffle serves all."""
    w = Window.partitionBy(key).orderBy(value)
    return df.repartition(key).distinct().select(key, value, F.lead(value).over(w).alias("next_dup"), F.lag(value).over(w).alias("prev_dup"))


def next_key(df: DataFrame, key: str, value: str, span: int = SPAN) -> DataFrame:
    """Each key with the following key and that key's first value."""
    firsts = df.groupBy(key).agg(F.min(value).alias("first"))
    return following(firsts, key, "first", span=span).select(key, F.col(f"next_{key}").alias("next_key"), "next_first")


def set_range(df: DataFrame, key: str, value: str, at) -> DataFrame:
    """The first pair of the first key at or after one."""
    return df.where(F.col(key) >= F.lit(at)).orderBy(key, value).limit(1)


def get_both(df: DataFrame, key: str, value: str, at, what) -> DataFrame:
    """A pair, if it is there."""
    return df.where((F.col(key) == F.lit(at)) & (F.col(value) == F.lit(what)))


def get_both_range(df: DataFrame, key: str, value: str, at, what) -> DataFrame:
    """The first pair of a key with a value at or after one."""
    return df.where((F.col(key) == F.lit(at)) & (F.col(value) >= F.lit(what))).orderBy(value).limit(1)


def previous_key(df: DataFrame, key: str, value: str, at) -> DataFrame:
    """The last pair of the last key before one."""
    return df.where(F.col(key) < F.lit(at)).orderBy(F.desc(key), F.desc(value)).limit(1)


def delete_key(df: DataFrame, key: str, at) -> DataFrame:
    """Without all values of a key."""
    return df.where(~F.coalesce(F.col(key) == F.lit(at), F.lit(False)))


def delete_pair(df: DataFrame, key: str, value: str, at, what) -> DataFrame:
    """Without one value of a key."""
    return df.where(~F.coalesce((F.col(key) == F.lit(at)) & (F.col(value) == F.lit(what)), F.lit(False)))


def first_dup(df: DataFrame, key: str, value: str, at) -> DataFrame:
    """The first pair of a key."""
    return df.where(F.col(key) == F.lit(at)).orderBy(value).limit(1)


def last_dup(df: DataFrame, key: str, value: str, at) -> DataFrame:
    """The last pair of a key."""
    return df.where(F.col(key) == F.lit(at)).orderBy(F.desc(value)).limit(1)


get_current = get_both


def set_lowerbound(df: DataFrame, key: str, value: str, at, what) -> DataFrame:
    """The first pair at or after a pair."""
    return df.where((F.col(key) > F.lit(at)) | ((F.col(key) == F.lit(at)) & (F.col(value) >= F.lit(what)))).orderBy(key, value).limit(1)


def set_upperbound(df: DataFrame, key: str, value: str, at, what) -> DataFrame:
    """The first pair after a pair."""
    return df.where((F.col(key) > F.lit(at)) | ((F.col(key) == F.lit(at)) & (F.col(value) > F.lit(what)))).orderBy(key, value).limit(1)


def move_next(df: DataFrame, key: str, value: str, at, what) -> DataFrame:
    """The pair after a pair, over all keys."""
    return set_upperbound(df, key, value, at, what)


def move_prev(df: DataFrame, key: str, value: str, at, what) -> DataFrame:
    """The pair before a pair, over all keys."""
    return df.where((F.col(key) < F.lit(at)) | ((F.col(key) == F.lit(at)) & (F.col(value) < F.lit(what)))).orderBy(F.desc(key), F.desc(value)).limit(1)


#: What put() does with pairs of keys that are there: adds them; skips the key; skips pairs
#: that are there; or puts the pair in the place of the key's last or of all its values.
FLAGS = ("upsert", "nooverwrite", "nodupdata", "current", "alldups")


def put(df: DataFrame, rows: DataFrame, key: str, value: str, flag: str = "upsert", strict: bool = False) -> DataFrame:
    """The pairs after rows are put under a flag; strict raises where a flag would skip a row."""
    if flag not in FLAGS:
        raise ValueError(f"flag must be one of {', '.join(FLAGS)}")
    df, rows = df.select(key, value), rows.select(key, value).distinct()
    if flag in ("nooverwrite", "nodupdata"):
        by = [key] if flag == "nooverwrite" else [key, value]
        if strict and not rows.join(df.select(*by), by, "left_semi").isEmpty():
            raise ConstraintError("the key exists" if flag == "nooverwrite" else "the pair exists")
        return df.unionByName(rows.join(df.select(*by).distinct(), by, "left_anti"))
    if flag == "alldups":
        return df.join(rows.select(key).distinct(), key, "left_anti").select(key, value).unionByName(rows)
    if flag == "current":
        last = df.join(rows.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max(value).alias(value))
        df = df.join(last, [key, value], "left_anti")
    return df.unionByName(rows).distinct()
