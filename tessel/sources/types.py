"""SQL types of tables and the Spark types that hold them."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: SQL type names and the Spark types that hold all their values.  Unsigned
#: types take the next wider signed one; TIME is microseconds of the day; INTERVAL is
#: ordered by its fields; a UUID is its canonical lower-case text.
SPARK_TYPES = {
    "BOOLEAN": T.BooleanType(),
    "TINYINT": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "HUGEINT": T.DecimalType(38, 0),
    "UTINYINT": T.ShortType(),
    "USMALLINT": T.IntegerType(),
    "UINTEGER": T.LongType(),
    "UBIGINT": T.DecimalType(20, 0),
    "UHUGEINT": T.DecimalType(38, 0),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "VARCHAR": T.StringType(),
    "BLOB": T.BinaryType(),
    "DATE": T.DateType(),
    "TIME": T.LongType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "TIMESTAMP_TZ": T.TimestampType(),
    "INTERVAL": T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())]),
    "UUID": T.StringType(),
}

_ALIASES = {"INT": "INTEGER", "INT4": "INTEGER", "INT8": "BIGINT", "LONG": "BIGINT", "TEXT": "VARCHAR", "STRING": "VARCHAR", "REAL": "FLOAT", "BYTEA": "BLOB", "BOOL": "BOOLEAN", "TIMESTAMP WITH TIME ZONE": "TIMESTAMP_TZ"}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a SQL type; DECIMAL(p, s) and VARCHAR(n) included."""
    plain = " ".join(name.upper().split())
    if m := re.fullmatch(r"(?:DECIMAL|NUMERIC) ?\( ?(\d+) ?(?:, ?(\d+) ?)?\)", plain):
        return T.DecimalType(int(m[1]), int(m[2] or 0))
    plain = re.sub(r" ?\(.*\)$", "", plain)
    plain = _ALIASES.get(plain, plain)
    if plain not in SPARK_TYPES:
        raise TypeError(f"no such type: {name}")
    return SPARK_TYPES[plain]


def schema(columns: dict[str, str]) -> T.StructType:
    """A schema from column names and SQL types."""
    return T.StructType([T.StructField(c, spark_type(k)) for c, k in columns.items()])
