"""Fixed-width records a batch at a time: fields out of and into binary columns, as views of one matrix of bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from .binary import WIDTHS

#: (name, offset, kind of integer or number of bytes, Spark type)
Lane = tuple[str, int, str | int, DataType]


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Records as rows of bytes, padded with zeros, and the length of each, -1 for null."""
    n = len(column)
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, np.diff(at))
    if (lengths == width).all():
        return data[at[0] : at[0] + n * width].reshape(n, width), lengths
    out = np.zeros((n, width), np.uint8)
    held = np.arange(width) < lengths[:, None]
    out[held] = data[(at[:-1, None] + np.arange(width))[held]]
    return out, lengths


def binary_array(rows: np.ndarray, short: np.ndarray | None = None) -> pa.Array:
    """Rows of bytes as a binary column; null where short."""
    n, width = rows.shape
    whole = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])
    if short is None or not short.any():
        return whole
    return whole.take(pa.array(np.arange(n), mask=short))


def lane(records: np.ndarray, lengths: np.ndarray, offset: int, kind: str | int, to: pa.DataType) -> pa.Array:
    """One field of all records; null where a record ends before it, an error where its value does not fit."""
    width = kind if isinstance(kind, int) else WIDTHS[kind]
    short, raw = lengths < offset + width, records[:, offset : offset + width]
    if isinstance(kind, int):
        return binary_array(raw, short)
    numbers = np.ascontiguousarray(raw).view(f"<{kind[0]}{width}").ravel()
    return pa.array(numbers, mask=short).cast(to)


def decoded(df: DataFrame, column: str, width: int, lanes: list[Lane], keep: tuple[str, ...] = (), check: Callable[[np.ndarray], None] | None = None) -> DataFrame:
    """The columns to keep and the lanes of each record; check sees the lengths of each batch. One column of bytes and those kept go to Python."""
    schema = StructType([df.schema[k] for k in keep] + [StructField(name, kind) for name, _, _, kind in lanes])
    names, n = schema.names, len(keep)
    fields = [(offset, kind, to_arrow_type(t)) for _, offset, kind, t in lanes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lengths = matrix(batch.column(n), width)
            if check is not None:
                check(lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(lane(found, lengths, *f) for f in fields)], names)

    return df.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keep)), F.col(column).alias(f"_{n}")).mapInArrow(run, schema)


def encoded(df: DataFrame, name: str, template: bytes, lanes: list[tuple[str, int, str | int]], keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns to keep and a record for each row: a template with lanes set in it; a null lane makes the record null."""
    schema = StructType([df.schema[k] for k in keep]).add(name, "binary")
    names, n, blank = schema.names, len(keep), np.frombuffer(template, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.tile(blank, (batch.num_rows, 1))
            null = np.zeros(batch.num_rows, bool)
            for (label, offset, kind), column in zip(lanes, batch.columns[n:], strict=True):
                absent = column.is_null().to_numpy(zero_copy_only=False)
                null |= absent
                width = kind if isinstance(kind, int) else WIDTHS[kind]
                if isinstance(kind, int):
                    found, lengths = matrix(column, width)
                    if ((lengths != width) & ~absent).any():
                        raise ValueError(f"fixed_binary_width_mismatch: lane {label} is not {width} bytes wide")
                else:
                    numbers = column.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).astype("<i8")
                    found = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8)[:, :width]
                out[:, offset : offset + width] = found
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], binary_array(out, null)], names)

    columns = [*keep, *(label for label, _, _ in lanes)]
    return df.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(columns))).mapInArrow(run, schema)
