"""Appends from a stream: each micro-batch is one tensor commit, named by its batch id so that a replay adds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tensor import DTYPES, Tensor
from ..sources.tensor_store import TensorStore


def slice_of(batch: DataFrame, axes: list[str], value: str, dtype: str, dims: tuple[int, ...]) -> Tensor:
    """One slice of a batch: values summed up by the axes' positions."""
    keys = [F.col(a).cast("bigint").alias(f"i{k + 1}") for k, a in enumerate(axes)]
    cells = batch.groupBy(*keys).agg(F.sum(value).cast(DTYPES[dtype]).alias("value"))
    return Tensor(cells.select(F.lit(0).cast("bigint").alias("i0"), *(f"i{k + 1}" for k in range(len(axes))), "value"), dtype, (1, *dims))


def ingest(stream: DataFrame, store: TensorStore, to_tensor: Callable[[DataFrame], Tensor], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start appending a stream's batches; trigger defaults to what is there now."""

    def add(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            store.append(to_tensor(batch), tag=f"batch-{batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
