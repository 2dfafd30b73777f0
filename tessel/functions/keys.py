"""Order-preserving key bytes, and helpers on prefixes."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_LONG_MIN = -(1 << 63)
_WIDTH = {"byte": 2, "tinyint": 2, "short": 4, "smallint": 4, "int": 8, "integer": 8, "date": 8, "long": 16, "bigint": 16, "timestamp": 16, "timestamp_ntz": 16}


def key_part(column: Column, kind: str) -> Column:
    """Hexadecimal key of one column: 00 for null, else 01 and the value's ordered bytes.

    Integers, dates and timestamps are big-endian with the sign flipped; booleans a byte;
    strings and binary end with 0000, a zero byte in them becoming 00FF; floating-point
    numbers are their bits, all flipped below zero and the sign alone above (-0.0 is 0.0, NaN
    comes last); decimals of up to 18 digits are their unscaled numbers.  Comparing the bytes
    of keys is comparing the values, nulls first.
    """
    if kind == "boolean":
        body = F.when(column, F.lit("01")).otherwise(F.lit("00"))
    elif kind in ("string", "binary"):
        raw = F.hex(column.cast("binary"))
        body = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1)), F.lit(2)), lambda i: F.when(F.substr(raw, i, F.lit(2)) == "00", F.lit("00FF")).otherwise(F.substr(raw, i, F.lit(2)))), ""), F.lit("0000"))
    elif kind in _WIDTH:
        number = F.datediff(column, F.lit("1970-01-01").cast("date")).cast("long") if kind == "date" else F.unix_micros(column.cast("timestamp")) if kind.startswith("timestamp") else column.cast("long")
        flipped = number.bitwiseXOR(F.lit(_LONG_MIN)) if _WIDTH[kind] == 16 else number + F.lit(1 << (4 * _WIDTH[kind] - 1))
        body = F.lpad(F.hex(flipped), _WIDTH[kind], "0")
    elif kind in ("float", "double"):
        name, method, width = ("java.lang.Double", "doubleToLongBits", 16) if kind == "double" else ("java.lang.Float", "floatToIntBits", 8)
        bits = F.reflect(F.lit(name), F.lit(method), F.when(column == 0, F.lit(0.0).cast(kind)).otherwise(column)).cast("long")
        body = F.lpad(F.right(F.hex(F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(_LONG_MIN if kind == "double" else 1 << 31)))), F.lit(width)), width, "0")
    elif m := re.fullmatch(r"decimal\((\d+),(\d+)\)", kind):
        if int(m[1]) > 18:
            raise TypeError(f"no ordered bytes for {kind}")
        number = (column.cast("decimal(38,18)") * F.lit(Decimal(10 ** int(m[2])))).cast("long")
        body = F.lpad(F.hex(number.bitwiseXOR(F.lit(_LONG_MIN))), 16, "0")
    else:
        raise TypeError(f"no ordered bytes for {kind}")
    return F.when(column.isNull(), F.lit("00")).otherwise(F.concat(F.lit("01"), body))


def memcomparable_key(df, *names: str) -> Column:
    """The hexadecimal key of several columns of df, in the order given."""
    kinds = dict(df.dtypes)
    return F.concat(*(key_part(F.col(n), kinds[n]) for n in names))


def decode_part(key: Column, kind: str) -> tuple[Column, Column]:
    """(the value of the first part of a key, the rest of the key)."""
    null = F.substr(key, F.lit(1), F.lit(2)) == "00"
    if kind in ("string", "binary"):
        body = F.regexp_extract(key, r"^01((?:00FF|(?!00)..)*)0000", 1)
        value, size = F.unhex(F.regexp_replace(body, r"\G((?:(?!00)..)*)00FF", "$100")).cast(kind), F.length(body) + 4
    else:
        width = 2 if kind == "boolean" else 8 if kind == "float" else 16 if kind == "double" or kind.startswith("decimal") else _WIDTH[kind]
        raw, size = F.substr(key, F.lit(3), F.lit(width)), F.lit(width)
        # two halves, as 16 digits don't fit a signed number
        high, low = (F.conv(F.substr(raw, F.lit(a), F.lit(n)), 16, 10).cast("long") for a, n in ((1, width // 2), (width // 2 + 1, width - width // 2)))
        bits = F.shiftleft(high, 2 * width).bitwiseOR(low)
        if kind == "boolean":
            value = raw == "01"
        elif kind in ("float", "double"):
            sign = F.lit(_LONG_MIN if kind == "double" else 1 << 31)
            positive = bits.bitwiseAND(sign) != 0
            name, method, inner = ("java.lang.Double", "longBitsToDouble", "long") if kind == "double" else ("java.lang.Float", "intBitsToFloat", "int")
            own = F.when(positive, bits.bitwiseXOR(sign)).otherwise(F.bitwise_not(bits))
            if kind == "float":
                own = own.bitwiseAND(F.lit((1 << 32) - 1))
                own = F.when(own >= 1 << 31, own - (1 << 32)).otherwise(own)
            value = F.reflect(F.lit(name), F.lit(method), own.cast(inner)).cast(kind)
        else:
            number = bits.bitwiseXOR(F.lit(_LONG_MIN)) if width == 16 else bits - (1 << (4 * width - 1))
            if kind.startswith("decimal"):
                value = (number.cast("decimal(38,18)") / F.lit(Decimal(10 ** int(kind[:-1].split(",")[1])))).cast(kind)
            elif kind == "date":
                value = F.date_from_unix_date(number.cast("int"))
            elif kind.startswith("timestamp"):
                value = F.timestamp_micros(number).cast(kind)
            else:
                value = number.cast(kind)
    return F.when(~null, value), F.when(null, F.substr(key, F.lit(3))).otherwise(F.substr(key, size + 3))


def decode_key(key: Column, **kinds: str) -> list[Column]:
    """The columns that memcomparable_key put into a key, by name and type in their order.

    Each part is bound to a variable before it is cut, so that expressions don't multiply.
    """

    def part(kind: str, which: int) -> Column:
        return F.transform(F.array(key), lambda k: decode_part(k, kind)[which])[0]

    out = []
    for name, kind in kinds.items():
        out.append(part(kind, 0).alias(name))
        key = part(kind, 1)
    return out


def prefix_successor(prefix: bytes) -> bytes | None:
    """The least byte string above all that begin with prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def text_successor(prefix: str) -> str | None:
    """The same for text, in the order of code points (which is that of UTF-8)."""
    for i in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[i]) + 1
        code = 0xE000 if 0xD800 <= code < 0xE000 else code
        if code <= 0x10FFFF:
            return prefix[:i] + chr(code)
    return None


def common_prefix(a: Column, b: Column) -> Column:
    """The longest text that both begin with."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    return F.substr(a, F.lit(1), F.array_max(same))
