"""Little-endian integers in binary columns, as expressions without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTHS = {"u8": 1, "i8": 1, "u16": 2, "i16": 2, "u32": 4, "i32": 4, "u64": 8, "i64": 8}
SPARK_TYPES = {"u8": "smallint", "i8": "tinyint", "u16": "int", "i16": "smallint", "u32": "bigint", "i32": "int", "u64": "decimal(20,0)", "i64": "bigint"}


def read_le(value: Column, offset: int, kind: str) -> Column:
    """The integer of a kind at a byte offset; null where the record is too short."""
    n = WIDTHS[kind]
    turned = F.concat(*(F.substring(value, offset + i + 1, 1) for i in reversed(range(n))))
    raw = F.conv(F.hex(turned), 16, 10 if kind != "i64" else -10)
    number = raw.cast("decimal(20,0)")
    if kind[0] == "i" and kind != "i64":
        number = F.when(number >= 1 << (8 * n - 1), number - (1 << (8 * n))).otherwise(number)
    return F.when(F.length(value) >= offset + n, number.cast(SPARK_TYPES[kind]))


def write_le(value: Column, kind: str) -> Column:
    """The little-endian bytes of an integer."""
    n = WIDTHS[kind]
    text = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*(F.substring(text, 17 - 2 * i, 2) for i in range(1, n + 1))))


def same_bytes(value: Column, offset: int, width: int, expected: bytes) -> Column:
    return F.substring(value, offset + 1, width) == F.lit(bytearray(expected))
