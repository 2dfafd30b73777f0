"""Mutations as the new state of a table, and checks of constraints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kv import between


class ConstraintError(ValueError):
    """A statement would break a constraint."""


def upsert(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows replace those of the same key; others are added."""
    return base.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def insert_or_ignore(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of keys that aren't there are added."""
    return base.unionByName(rows.join(base.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def insert_unique(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows are added; raises if a key is there already or comes twice."""
    if not violations_unique(rows, keys).isEmpty() or not rows.join(base.select(*keys), list(keys), "left_semi").isEmpty():
        raise ConstraintError(f"duplicate key in {', '.join(keys)}")
    return base.unionByName(rows)


def update_existing(base: DataFrame, rows: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Rows replace those of the same key; others are left out, or raise if strict."""
    if strict and not rows.join(base.select(*keys), list(keys), "left_anti").isEmpty():
        raise ConstraintError(f"no such key in {', '.join(keys)}")
    return upsert(base, rows.join(base.select(*keys), list(keys), "left_semi"), keys)


def delete(base: DataFrame, keys: DataFrame, names: Sequence[str]) -> DataFrame:
    return base.join(keys.select(*names), list(names), "left_anti")


def delete_where(base: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true go; where it is null they stay."""
    return base.where(~F.coalesce(condition, F.lit(False)))


def range_delete(base: DataFrame, key: str, low=None, high=None) -> DataFrame:
    return delete_where(base, between(F.col(key), low, high))


def update_where(base: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """Set columns where the condition is true; all values see the old row."""
    hit = F.coalesce(condition, F.lit(False))
    return base.select(*(F.when(hit, values[c].cast(t)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c, t in base.dtypes))


def splice(into: DataFrame, source: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """A key range of one table in the place of that of another."""
    return range_delete(into, key, low, high).unionByName(source.where(between(F.col(key), low, high)))


def replace(base: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """The state after a get-and-set: a row that comes takes the place of its key's, a null new value deletes."""
    kept = base.join(rows.select(key), key, "left_anti")
    return kept.unionByName(rows.where(F.col(value).isNotNull()).select(*base.columns))


def replace_returning(base: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, old and new value of each row that comes; replace() gives the state after it."""
    return rows.select(key, F.col(value).alias("new")).join(base.select(key, F.col(value).alias("old")), key, "left").select(key, "old", "new")


def violations_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null counts of columns that must not be null, where there are any."""
    counts = df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in columns))).alias("x")).select("x.*").where("n > 0")


def violations_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that come more than once; keys with a null in them are distinct."""
    full = df.where(~F.greatest(*(F.col(c).isNull() for c in columns)) if len(columns) > 1 else F.col(columns[0]).isNotNull())
    return full.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_rows(df: DataFrame, not_null: Sequence[str] = (), checks: Mapping[str, str] | None = None) -> None:
    """Raise if a row has a null where none may be, or fails a condition; one pass over df."""
    faults = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c} has nulls") for c in dict.fromkeys(not_null)]
    faults += [F.count(F.when(~F.expr(text), 1)).alias(f"check {name} fails") for name, text in (checks or {}).items()]
    if faults:
        for name, n in df.agg(*faults).first().asDict().items():
            if n:
                raise ConstraintError(f"{name} ({n} rows)")


def check_constraints(df: DataFrame, not_null: Sequence[str] = (), unique: Sequence[Sequence[str]] = ()) -> None:
    """Raise if a state breaks a constraint."""
    if not_null:
        for row in violations_not_null(df, not_null).collect():
            raise ConstraintError(f"{row.column_name} has {row.n} nulls")
    for columns in unique:
        if not violations_unique(df, columns).isEmpty():
            raise ConstraintError(f"duplicate key in {', '.join(columns)}")
