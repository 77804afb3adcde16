"""Shape policies: reads of a tensor's slots in a chosen domain of the other axes, and universes with remaps.

A slot is one index of the append axis (axis 0 here). `slots` is a table (i0, family, version, n1, n2, ...): the
extents that each slot was appended with, and the universe that its axis 1 was bound to, if any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import invalid
from .tensor import DTYPES, Tensor, checked_fill, dense, grid

POLICIES = ("file_envelope", "current_head", "union", "intersection", "initial_registered", "explicit_extents", "explicit_universe", "explicit_universe_and_extents")


def extents(t: Tensor, slots: DataFrame, policy: str, given: tuple[int, ...] | None = None) -> tuple[int, ...]:
    """The non-append extents of a policy; union, intersection and initial_registered take their plain meaning."""
    if policy not in POLICIES:
        raise invalid(f"unknown shape policy {policy}")
    names = [f"n{k}" for k in range(1, t.rank)]
    if policy in ("explicit_extents", "explicit_universe_and_extents"):
        if given is None or len(given) != t.rank - 1 or any(n < 0 for n in given):
            raise invalid("one extent for each axis but the append axis is needed")
        return tuple(given)
    if policy in ("file_envelope", "union"):
        row = slots.agg(*(F.max(n).alias(n) for n in names)).head()
    elif policy == "intersection":
        row = slots.agg(*(F.min(n).alias(n) for n in names)).head()
    elif policy == "initial_registered":
        row = slots.agg(*(F.min_by(n, "i0").alias(n) for n in names)).head()
    else:
        row = slots.agg(*(F.max_by(n, "i0").alias(n) for n in names)).head()
    return tuple(int(row[n] or 0) for n in names)


def cropped(t: Tensor, ext: tuple[int, ...]) -> Tensor:
    """Cells outside the extents are dropped; missing ones stay absent."""
    cells = t.cells
    for k, n in enumerate(ext, 1):
        cells = cells.where(F.col(f"i{k}") < n)
    return t.with_cells(cells, (t.shape[0], *ext))


def with_policy(t: Tensor, slots: DataFrame, policy: str, fill: float = 0, given: tuple[int, ...] | None = None) -> DataFrame:
    """All cells of the policy's domain with valid; what a slot does not hold is fill."""
    return dense(cropped(t, extents(t, slots, policy, given)), fill)


def remapped(t: Tensor, slots: DataFrame, remaps: DataFrame, family: str, version: str, length: int) -> Tensor:
    """Axis 1 aligned with a universe: slots bound to the version as they are, others by a published remap.

    remaps: (family, from_version, to_version, source, target), out[target] = in[source], of one hop.
    """
    bound = slots.where(F.col("family") == family).select("i0", "version")
    other = bound.where(F.col("version") != version).select("version").distinct()
    known = remaps.where((F.col("family") == family) & (F.col("to_version") == version))
    lost = other.join(known.select(F.col("from_version").alias("version")).distinct(), "version", "left_anti")
    if bound.isEmpty() or not lost.isEmpty():
        raise invalid(f"universe {family}/{version} is neither bound nor reached by a remap")
    cells = t.cells.join(bound, "i0")
    exact = cells.where(F.col("version") == version).drop("version")
    moved = cells.join(known.select(F.col("from_version").alias("version"), F.col("source").alias("i1"), F.col("target")), ["version", "i1"])
    moved = moved.select(*(F.col("target").cast("bigint").alias("i1") if a == "i1" else F.col(a) for a in t.axes), "value")
    return t.with_cells(exact.unionByName(moved).where(F.col("i1") < length), (t.shape[0], length, *t.shape[2:]))


def valued_grid(t: Tensor, fill: float = 0) -> DataFrame:
    f = F.lit(checked_fill(t.dtype, fill)).cast(DTYPES[t.dtype])
    return grid(t.cells.sparkSession, t.shape).withColumn("value", f)
