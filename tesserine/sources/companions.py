"""Companion formats of tensors: Arrow, CSV, Parquet and NumPy, with checks on the way back."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import TableError, invalid
from ..operators.tensor import DTYPES, Tensor, from_numpy, grid, to_numpy

CSV_COLUMNS = ("record", "dtype", "shape", "order", "flat_index", "value")


def flat_rows(t: Tensor) -> DataFrame:
    """(flat_index, value), row-major."""
    return t.cells.select(t.flat().alias("flat_index"), "value")


def csv_rows(t: Tensor) -> DataFrame:
    """One metadata row and a row for each value, all columns text."""
    shape = "x".join(map(str, t.shape))
    meta = t.cells.sparkSession.range(1).select(
        F.lit("metadata").alias("record"), F.lit(t.dtype).alias("dtype"), F.lit(shape).alias("shape"), F.lit("row_major").alias("order"), F.lit(None).cast("bigint").alias("flat_index"), F.lit(None).cast("string").alias("value")
    )
    values = flat_rows(t).select(F.lit("value").alias("record"), F.lit(None).cast("string").alias("dtype"), F.lit(None).cast("string").alias("shape"), F.lit(None).cast("string").alias("order"), "flat_index", F.col("value").cast("string").alias("value"))
    return meta.union(values)


def write_csv(t: Tensor, path: str) -> None:
    csv_rows(t).orderBy(F.col("record") != "metadata", "flat_index").write.option("header", "true").csv(path)


def write_parquet(t: Tensor, path: str) -> None:
    """flat_index and value; dtype and shape go with the column, as field metadata."""
    meta = {"dtype": t.dtype, "shape": list(t.shape), "order": "row_major"}
    flat_rows(t).orderBy("flat_index").select("flat_index", F.col("value").alias("value", metadata=meta)).write.parquet(path)


def _from_flat(rows: DataFrame, dtype: str, shape: tuple[int, ...]) -> Tensor:
    if dtype not in DTYPES or not shape or any(n < 0 for n in shape):
        raise invalid("bad dtype or shape")
    size = math.prod(shape)
    r = rows.agg(F.count("*").alias("n"), F.min("flat_index").alias("lo"), F.max("flat_index").alias("hi"), F.count_distinct("flat_index").alias("d")).head()
    if r["n"] != size or r["d"] != size or (size and (r["lo"] != 0 or r["hi"] != size - 1)):
        raise TableError("invalid_input", "values or flat indices do not fit the shape")
    cols, rest = [], size
    for k, n in enumerate(shape):
        rest //= max(1, n)
        cols.append(F.expr(f"(flat_index div {max(1, rest)}) % {max(1, n)}").alias(f"i{k}"))
    return Tensor(rows.select(*cols, F.col("value").cast(DTYPES[dtype]).alias("value")), dtype, tuple(shape))


def read_csv(spark: SparkSession, path: str, check_order: bool = True) -> Tensor:
    df = _placed(spark.read.option("header", "true").csv(path))
    if tuple(df.columns[: -len(PLACE)]) != CSV_COLUMNS:
        raise invalid("malformed header")
    meta = df.where("record = 'metadata'").limit(2).collect()
    if len(meta) != 1 or meta[0]["order"] != "row_major":
        raise invalid("one metadata row in row-major order is needed")
    try:
        shape = tuple(int(n) for n in meta[0]["shape"].split("x"))
    except ValueError as e:
        raise invalid("malformed shape") from e
    dtype = meta[0]["dtype"]
    if dtype not in DTYPES:
        raise invalid(f"unknown dtype {dtype}")
    rows = df.where("record = 'value'").select(F.col("flat_index").try_cast("bigint").alias("flat_index"), F.col("value").try_cast(DTYPES[dtype]).alias("value"), *PLACE)
    _check(rows, df, check_order)
    return _from_flat(rows.drop(*PLACE), dtype, shape)


def _check(rows: DataFrame, df: DataFrame, check_order: bool) -> None:
    if not rows.where("flat_index is null or value is null").isEmpty() or not df.where("record not in ('metadata', 'value')").isEmpty():
        raise invalid("malformed row")
    if check_order:
        _check_order(rows)


#: Where a row was read: its file, the split of the file, and its place in that.
PLACE = ("_file", "_start", "_at")


def _placed(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))


def _check_order(rows: DataFrame) -> None:
    """flat_index must ascend in every split, and from one split to the next in order of files; splits are few."""
    before = F.lag("flat_index").over(Window.partitionBy("_file", "_start").orderBy("_at"))
    ends = rows.groupBy("_file", "_start").agg(F.min("flat_index").alias("low"), F.max("flat_index").alias("high"))
    last = F.lag("high").over(Window.orderBy("_file", "_start"))
    if not rows.withColumn("before", before).where("before >= flat_index").isEmpty() or not ends.withColumn("last", last).where("last >= low").isEmpty():
        raise invalid("flat index out of order")


def read_parquet(spark: SparkSession, path: str, dtype: str | None = None, shape: tuple[int, ...] | None = None) -> Tensor:
    df = spark.read.parquet(path)
    if set(df.columns) != {"flat_index", "value"}:
        raise invalid("flat_index and value are needed")
    meta = df.schema["value"].metadata
    if not meta or "dtype" not in meta or "shape" not in meta:
        raise invalid("missing metadata")
    if dtype not in (None, meta["dtype"]) or shape not in (None, tuple(meta["shape"])):
        raise invalid("dtype or shape differs from the metadata")
    if dict(df.dtypes)["value"] != DTYPES[meta["dtype"]]:
        raise invalid("column type differs from the dtype")
    _check_order(_placed(df))
    return _from_flat(df, meta["dtype"], tuple(meta["shape"]))


def slices(t: Tensor) -> DataFrame:
    """A row for each index of axis 0 with its inner values as a list in row-major order."""
    if math.prod(t.shape[1:]) == 0:
        raise invalid("inner width is zero")
    inner = F.lit(0).cast("bigint")
    for k in range(1, t.rank):
        inner = inner * t.shape[k] + F.col(f"i{k}")
    rows = t.cells.groupBy("i0").agg(F.array_sort(F.collect_list(F.struct(inner.alias("o"), "value"))).alias("v"))
    return rows.select(F.col("i0").alias("time_id"), F.transform("v", lambda x: x["value"]).alias("values"))


def to_record_batch(t: Tensor) -> pa.RecordBatch:
    """time_id (unsigned 32 bits) and fixed-size lists, with dimensions in the schema's metadata."""
    width = math.prod(t.shape[1:])
    got = slices(t).orderBy("time_id").toArrow()
    kind = {"f32": pa.float32(), "f64": pa.float64(), "i32": pa.int32(), "i64": pa.int64()}[t.dtype]
    flat = got.column("values").combine_chunks().flatten().cast(kind)
    meta = {"dtype": t.dtype, "dim_lens": json.dumps(t.shape), "order": "row_major"}
    schema = pa.schema([("time_id", pa.uint32()), ("values", pa.list_(kind, width))], meta)
    return pa.RecordBatch.from_arrays([got.column("time_id").combine_chunks().cast(pa.uint32()), pa.FixedSizeListArray.from_arrays(flat, width)], schema=schema)


def from_record_batch(spark: SparkSession, batch: pa.RecordBatch) -> Tensor:
    meta = {k.decode(): v.decode() for k, v in (batch.schema.metadata or {}).items()}
    if "dtype" not in meta or "dim_lens" not in meta:
        raise invalid("missing metadata")
    shape = tuple(json.loads(meta["dim_lens"]))
    values = batch.column("values").flatten().to_numpy()
    if math.prod(shape[1:]) == 0:
        raise invalid("inner width is zero")
    if batch.num_rows != shape[0] or len(values) != math.prod(shape) or batch.column("time_id").to_pylist() != list(range(shape[0])):
        raise invalid("values or time_id do not fit the shape")
    return from_numpy(spark, values.reshape(shape), meta["dtype"])


def to_ipc(t: Tensor) -> bytes:
    batch = to_record_batch(t)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(spark: SparkSession, data: bytes) -> Tensor:
    try:
        batches = list(pa.ipc.open_stream(data))
    except pa.ArrowInvalid as e:
        raise invalid("malformed Arrow stream") from e
    if len(batches) != 1:
        raise invalid("one batch is needed")
    return from_record_batch(spark, batches[0])


def to_array(t: Tensor) -> np.ndarray:
    return to_numpy(t)


__all__ = ["csv_rows", "flat_rows", "from_ipc", "from_record_batch", "grid", "read_csv", "read_parquet", "slices", "to_array", "to_ipc", "to_record_batch", "write_csv", "write_parquet"]
