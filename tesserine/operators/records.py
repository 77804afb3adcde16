"""Packed fixed-width records: field projection, header checks, typed lanes and continuity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError, invalid
from ..functions import packed
from ..functions.types import Column as TypedColumn
from ..functions.binary import SPARK_TYPES, WIDTHS, write_le

#: The layout of the 168-byte order and trade records.
WIDTH, MAGIC, SCHEMA, HEADER = 168, b"ALIR", 1, 80
ORDER, TRADE = 1, 2
FAMILIES, TOP_EXCHANGE = (1, 2, 3), 2
FIELDS = {
    "schema_version": (4, "u16"), "header_len": (6, "u16"), "record_len": (8, "u16"), "record_kind": (10, "u8"), "source_family": (11, "u8"),
    "exchange_id": (12, "u8"), "trading_day": (16, "u32"), "channel_id": (20, "i32"), "biz_index": (24, "i64"), "source_ordinal": (32, "u64"),
    "receive_nano": (40, "i64"), "exchange_time": (48, "i64"),
}
SYMBOL, BODY = (56, 9), (80, 7)
WORDS = (88, 96, 104, 112, 120, 128, 136, 144, 152, 160)
#: The typed lanes: (name, offset, kind of integer or number of bytes, type).
LANES: list[packed.Lane] = [
    ("day_key", 16, "u32", T.IntegerType()), ("channel_id", 20, "i32", T.LongType()), ("biz_index", 24, "i64", T.LongType()), ("record_kind", 10, "u8", T.IntegerType()),
    ("receive_nano", 40, "i64", T.LongType()), ("source_ordinal", 32, "u64", T.LongType()), ("payload_header_bytes_11_12", 11, 2, T.BinaryType()),
    ("payload_exchange_time", 48, "i64", T.LongType()), ("payload_symbol", *SYMBOL, T.BinaryType()), ("payload_body_bytes_80_86", *BODY, T.BinaryType()),
    *((f"payload_body_word_{o}", o, "i64", T.LongType()) for o in WORDS),
]
#: What every record holds besides its lanes.
BLANK = (MAGIC + SCHEMA.to_bytes(2, "little") + HEADER.to_bytes(2, "little") + WIDTH.to_bytes(2, "little")).ljust(WIDTH, b"\0")


def lane_columns() -> list[TypedColumn]:
    """The lanes as columns of an ordered table."""
    fixed = lambda kind: kind if isinstance(kind, int) else None
    return [TypedColumn(name, "fixed_binary" if fixed(kind) else {"int": "i32", "bigint": "i64"}[t.simpleString()], width=fixed(kind), nullable=False) for name, _, kind, t in LANES]


def word_column(offset: int) -> str:
    if offset not in WORDS:
        raise invalid(f"no body word at offset {offset}")
    return f"payload_body_word_{offset}"


@dataclass(frozen=True)
class Field:
    name: str
    offset: int
    kind: str


@dataclass(frozen=True)
class Projection:
    """Fields of a fixed-binary column of a given width."""

    column: str
    width: int
    fields: tuple[Field, ...]
    allow_nulls: bool = False

    def __post_init__(self):
        if self.width <= 0:
            raise invalid("record width is zero")
        if len({f.name for f in self.fields}) != len(self.fields):
            raise invalid("duplicate field name")
        for f in self.fields:
            if f.kind not in WIDTHS:
                raise invalid(f"unknown field type {f.kind}")
            if f.offset < 0 or f.offset + WIDTHS[f.kind] > self.width:
                raise invalid(f"field {f.name} ends beyond the record")

    def typed(self, name: str, kind: str) -> Column:
        f = next((f for f in self.fields if f.name == name), None)
        if f is None or f.kind != kind:
            raise invalid(f"field {name} is not {kind}")
        return F.col(name)


def _typed(fields: dict[str, tuple[int, str]]) -> list[packed.Lane]:
    return [(name, offset, kind, T.StructType.fromDDL(f"x {SPARK_TYPES[kind]}")["x"].dataType) for name, (offset, kind) in fields.items()]


def project(df: DataFrame, p: Projection, keep: tuple[str, ...] = ()) -> DataFrame:
    """The fields as typed columns; a record of another width, or a null where none is allowed, raises."""
    width, nulls = p.width, p.allow_nulls

    def check(lengths: np.ndarray) -> None:
        if not nulls and (lengths < 0).any():
            raise ValueError("fixed_binary_width_mismatch: null record")
        if ((lengths >= 0) & (lengths != width)).any():
            raise ValueError(f"fixed_binary_width_mismatch: expected {width} bytes")

    return packed.decoded(df, p.column, width, _typed({f.name: (f.offset, f.kind) for f in p.fields}), keep, check)


def header_error(record: Column) -> Column:
    """The error kind of a record, null if it is sound; checks run in the order of the layout, on bytes as they are."""
    at = lambda offset, width: F.substring(record, offset + 1, width)
    raw = lambda b: F.lit(bytearray(b))
    zero = lambda offset, width: at(offset, width) == raw(bytes(width))
    one = lambda name, values: at(FIELDS[name][0], 1).isin(*(raw([v]) for v in values))
    bad, kind = F.lit("payload_header_mismatch"), at(FIELDS["record_kind"][0], 1)
    not_above_zero = lambda name: (at(sum(_place(name)) - 1, 1) >= raw(b"\x80")) | zero(*_place(name))
    return (
        F.when(record.isNull() | (F.length(record) != WIDTH), "fixed_binary_width_mismatch")
        .when(at(0, 4) != raw(MAGIC), bad)
        .when(at(4, 2) != raw(BLANK[4:6]), "unsupported_schema_version")
        .when((at(6, 4) != raw(BLANK[6:10])) | ~one("record_kind", (ORDER, TRADE)), bad)
        .when(~one("source_family", FAMILIES) | ~one("exchange_id", range(TOP_EXCHANGE + 1)), bad)
        .when(~zero(13, 3) | ~zero(65, 15), bad)
        .when(zero(*_place("trading_day")) | not_above_zero("channel_id") | not_above_zero("biz_index") | ~zero(87, 1), bad)
        .when((kind == raw([ORDER])) & ~(zero(82, 1) & zero(104, 16) & zero(152, 8)), bad)
        .when((kind == raw([TRADE])) & ~(zero(83, 1) & zero(86, 1)), bad)
    )


def _place(name: str) -> tuple[int, int]:
    offset, kind = FIELDS[name]
    return offset, WIDTHS[kind]


def decoded_header(df: DataFrame, column: str = "payload") -> DataFrame:
    """df with every header field, null where a record is too short for it, and error_kind."""
    out = packed.decoded(df, column, WIDTH, _typed(FIELDS), tuple(df.columns))
    return out.withColumn("error_kind", header_error(F.col(column)))


def to_lanes(df: DataFrame, column: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """The twenty typed lanes of each record, null where a record is too short for one."""
    return packed.decoded(df, column, WIDTH, LANES, keep)


def to_records(df: DataFrame, name: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns to keep and the exact 168 bytes of each row's typed lanes."""
    return packed.encoded(df, name, BLANK, [x[:3] for x in LANES], keep)


def from_lanes() -> Column:
    """The exact 168 bytes of a row of typed lanes, as an expression; to_records is the form for whole tables."""
    fixed = lambda b: F.lit(bytearray(b))
    head = MAGIC + SCHEMA.to_bytes(2, "little") + HEADER.to_bytes(2, "little") + WIDTH.to_bytes(2, "little")
    return F.concat(
        fixed(head), write_le(F.col("record_kind"), "u8"), F.col("payload_header_bytes_11_12"), fixed(bytes(3)), write_le(F.col("day_key"), "u32"),
        write_le(F.col("channel_id"), "i32"), write_le(F.col("biz_index"), "i64"), write_le(F.col("source_ordinal"), "u64"), write_le(F.col("receive_nano"), "i64"),
        write_le(F.col("payload_exchange_time"), "i64"), F.col("payload_symbol"), fixed(bytes(15)), F.col("payload_body_bytes_80_86"), fixed(bytes(1)),
        *(write_le(F.col(word_column(o)), "i64") for o in WORDS),
    )


def cross_checked(df: DataFrame, column: str = "payload", scalars: tuple[str, ...] = ("day_key", "channel_id", "biz_index", "record_kind", "receive_nano", "source_ordinal")) -> DataFrame:
    """df with same_<scalar> for each scalar column held against its record, and all_same."""
    from_record = {"day_key": "trading_day", **{s: s for s in scalars if s != "day_key"}}
    lanes = [(f"_record_{s}", offset, kind, t) for s in scalars for _, offset, kind, t in _typed({s: FIELDS[from_record[s]]})]
    read = packed.decoded(df, column, WIDTH, lanes, tuple(df.columns))
    same = {s: F.col(s).cast("decimal(20,0)") == F.col(f"_record_{s}").cast("decimal(20,0)") for s in scalars}
    out = read.select(*df.columns, *(v.alias(f"same_{s}") for s, v in same.items()))
    return out.withColumn("all_same", F.array_min(F.array(*(F.col(f"same_{s}") for s in same))))


def check_lanes(df: DataFrame) -> None:
    """Raise unless df has the twenty lanes with their types, and lanes of bytes with their widths."""
    types = dict(df.dtypes)
    want = dict.fromkeys(("channel_id", "biz_index", "receive_nano", "source_ordinal", "payload_exchange_time", *map(word_column, WORDS)), "bigint")
    want |= {"day_key": "int", "record_kind": "int"} | dict.fromkeys(("payload_header_bytes_11_12", "payload_symbol", "payload_body_bytes_80_86"), "binary")
    for name, kind in want.items():
        if types.get(name) != kind:
            raise TableError("invalid_input", f"lane {name} is missing or not {kind}")
    for name, width in (("payload_header_bytes_11_12", 2), ("payload_symbol", SYMBOL[1]), ("payload_body_bytes_80_86", BODY[1])):
        if not df.where(F.length(name) != width).isEmpty():
            raise TableError("fixed_binary_width_mismatch", f"lane {name} is not {width} bytes wide")


def continuity(df: DataFrame, channel: str = "channel_id", index: str = "biz_index", order: tuple[str, ...] = ("row_number",), first: int | None = None) -> DataFrame:
    """df with expected index and issue: null, biz_index_duplicate, biz_index_regression or biz_index_gap.

    A scan expects the index before plus one; one that equals the index before is a duplicate, one further
    below a regression, one above a gap. first: what the first row of each channel must hold, if anything.
    """
    before = F.lag(index).over(Window.partitionBy(channel).orderBy(*order))
    expected = F.when(before.isNull(), F.lit(first).cast("bigint")).otherwise(before + 1)
    out = df.withColumn("expected", expected)
    x, e = F.col(index), F.col("expected")
    issue = F.when(x == e - 1, "biz_index_duplicate").when(x < e, "biz_index_regression").when(x > e, "biz_index_gap")
    return out.withColumn("issue", issue)


def payload_aggregates(df: DataFrame, channel: str = "channel_id", order: str = "row_number") -> DataFrame:
    return df.groupBy(channel).agg(
        F.count("*").alias("row_count"),
        F.min_by("biz_index", order).alias("first_biz_index"),
        F.max_by("biz_index", order).alias("last_biz_index"),
        F.min("receive_nano").alias("min_receive_nano"),
        F.max("receive_nano").alias("max_receive_nano"),
        F.count_if(F.col("record_kind") == ORDER).alias("order_records"),
        F.count_if(F.col("record_kind") == TRADE).alias("trade_records"),
    )


