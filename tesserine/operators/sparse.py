"""Sparse appends: which subtensors a rule leaves out, and what is stored."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import invalid
from .tensor import DTYPES, Tensor

OUTCOMES = ("sparse_regular_chunked", "dense_fallback", "reject", "sparse_chunk_tree")
LAYOUTS = ("streaming", "random_access", "regular_chunked", "inferred")


@dataclass(frozen=True)
class Rule:
    """detector: null or predicate; predicate: zero, nan or (equal, dtype, value)."""

    sparse_axes: tuple[int, ...]
    detector: str = "predicate"
    predicate: str | tuple = "zero"
    min_absent_fraction: float = 0.0
    min_absent_subtensors: int = 1
    fallback: str = "dense_fallback"

    def matches(self, t: Tensor) -> Column:
        v = F.col("value")
        if self.detector == "null":
            return v.isNull()
        if self.predicate == "zero":
            return v == 0
        if self.predicate == "nan":
            if t.whole:
                raise invalid("integers are never NaN")
            return F.isnan(v)
        kind, dtype, value = self.predicate
        if kind != "equal" or dtype != t.dtype or isinstance(value, int) != t.whole:
            raise invalid("the predicate's dtype is not the tensor's")
        return v == F.lit(value).cast(DTYPES[dtype])


def subtensors(t: Tensor, rule: Rule) -> DataFrame:
    """(append index, indices of the sparse axes, absent): a subtensor is absent if all its cells match."""
    if any(not 0 < a < t.rank for a in rule.sparse_axes) or len(set(rule.sparse_axes)) != len(rule.sparse_axes):
        raise invalid("sparse axes must be distinct and not the append axis")
    keys = ["i0", *(f"i{a}" for a in sorted(rule.sparse_axes))]
    return t.cells.groupBy(*keys).agg(F.bool_and(F.coalesce(rule.matches(t), F.lit(False))).alias("absent"))


def analyze(t: Tensor, rule: Rule, layout: str = "random_access", blocks: tuple[int, ...] | None = None) -> DataFrame:
    """One row: total and absent subtensors, absent fraction, outcome and reason."""
    if layout not in LAYOUTS:
        raise invalid(f"unknown layout {layout}")
    total = reduce(lambda a, b: a * b, (t.shape[a] for a in (0, *rule.sparse_axes)))
    row = subtensors(t, rule).agg(F.count_if("absent").alias("absent_subtensors")).withColumn("total_subtensors", F.lit(total))
    share = F.col("absent_subtensors") / F.greatest(F.lit(1), F.col("total_subtensors"))
    enough = (share >= rule.min_absent_fraction) & (F.col("absent_subtensors") >= rule.min_absent_subtensors)
    stored = {"streaming": "dense_fallback", "random_access": "sparse_chunk_tree", "inferred": "sparse_chunk_tree", "regular_chunked": "sparse_regular_chunked"}[layout]
    if layout == "regular_chunked" and blocks is not None and any(blocks[a] > 1 for a in rule.sparse_axes):
        stored = "reject"  # a chunk spans several subtensors, so it cannot be left out as a whole
    outcome = F.when(enough, stored).otherwise(rule.fallback)
    reason = F.when(~enough, "below_threshold").when(outcome == "dense_fallback", "layout_has_no_sparse_storage").when(outcome == "reject", "chunks_span_subtensors").otherwise("absent_subtensors_found")
    return row.select("total_subtensors", "absent_subtensors", share.alias("absent_fraction"), outcome.alias("outcome"), reason.alias("reason"))


def present(t: Tensor, rule: Rule) -> Tensor:
    """The tensor without its absent subtensors."""
    gone = subtensors(t, rule).where("absent").drop("absent")
    return t.with_cells(t.cells.join(gone, gone.columns, "left_anti").select(*t.axes, "value"))
