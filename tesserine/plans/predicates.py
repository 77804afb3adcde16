"""Projections, row-group predicates and read plans.

A predicate prunes row groups by their statistics and never filters rows; `exact_filter` does that on top.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import pairwise

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Unimplemented, invalid
from ..functions.types import Column

_RANGES = {"i32": (-(1 << 31), (1 << 31) - 1), "i64": (-(1 << 63), (1 << 63) - 1)}


@dataclass(frozen=True)
class Predicate:
    """Inclusive bounds on a scalar column; physical is the bounds' own type and must equal the column's."""

    column: str
    lower: float | int | None = None
    upper: float | int | None = None
    physical: str | None = None

    @staticmethod
    def between(column: str, lower, upper, physical: str | None = None) -> Predicate:
        return Predicate(column, lower, upper, physical)

    @staticmethod
    def equal(column: str, value, physical: str | None = None) -> Predicate:
        return Predicate(column, value, value, physical)


@dataclass(frozen=True)
class ReadOptions:
    read_threads: int = 1
    validate_checksums: bool = True
    decode_dictionaries: bool = False


@dataclass(frozen=True)
class ReadReport:
    requested_read_threads: int
    effective_read_threads: int
    selected_row_groups: int
    pruned_row_groups: int
    selected_chunks: int
    fallback_reason: str | None


@dataclass(frozen=True)
class ReadPlan:
    columns: tuple[str, ...]
    row_groups: tuple[int, ...]
    report: ReadReport
    predicates: tuple[Predicate, ...] = field(default=())


def resolve(columns: list[Column], names: list[str] | None) -> list[Column]:
    """The projected columns: all in order of the schema, or those named in order of the request."""
    if names is None:
        return list(columns)
    known = {c.name: c for c in columns}
    if len(set(names)) != len(names):
        raise invalid("projection contains duplicate column names")
    missing = [n for n in names if n not in known]
    if missing:
        raise invalid(f"projection names unknown column {missing[0]}")
    return [known[n] for n in names]


def check(columns: list[Column], predicates: list[Predicate]) -> None:
    known = {c.name: c for c in columns}
    for p in predicates:
        c = known.get(p.column)
        if c is None:
            raise invalid(f"predicate on unknown column {p.column}")
        if not c.scalar:
            raise invalid(f"predicate on fixed-binary column {p.column}")
        bounds = [b for b in (p.lower, p.upper) if b is not None]
        if not bounds:
            raise invalid(f"predicate on {p.column} has no bound")
        whole = c.physical in _RANGES
        if p.physical not in (None, c.physical) or any(isinstance(b, bool) or isinstance(b, int) != whole for b in bounds):
            raise invalid(f"predicate on {p.column} has a bound of another type")
        if whole and any(not _RANGES[c.physical][0] <= b <= _RANGES[c.physical][1] for b in bounds):
            raise invalid(f"predicate on {p.column} has a bound of another type")
        if any(isinstance(b, float) and math.isnan(b) for b in bounds):
            raise invalid(f"predicate on {p.column} compares with NaN")
        if len(bounds) == 2 and p.lower > p.upper:
            raise invalid(f"predicate on {p.column} has lower above upper")


def group_condition(predicates: list[Predicate], low: str = "min_{}", high: str = "max_{}") -> SparkColumn:
    """Over a row of wide statistics: whether the row group may hold matching rows; missing statistics keep it."""
    keep = F.lit(True)
    for p in predicates:
        lo, hi = F.col(low.format(p.column)), F.col(high.format(p.column))
        if p.lower is not None:
            keep = keep & (hi.isNull() | (hi >= p.lower))
        if p.upper is not None:
            keep = keep & (lo.isNull() | (lo <= p.upper))
    return keep


#: Ranges of row-group ids that a scan is filtered by, at most.
SPANS = 256


def spans_of(ids: Iterable[int], most: int = SPANS) -> list[tuple[int, int]]:
    """At most so many (low, high) that hold all ids: runs of neighbours, joined over the smallest holes if there are too many."""
    ordered = sorted(set(ids))
    holes = sorted(((b - a, i) for i, (a, b) in enumerate(pairwise(ordered)) if b - a > 1), reverse=True)[: most - 1]
    cuts = [0, *sorted(i + 1 for _, i in holes), len(ordered)]
    return [(ordered[a], ordered[b - 1]) for a, b in pairwise(cuts)] if ordered else []


def within(column: str, spans: list[tuple[int, int]]) -> SparkColumn:
    """Whether a value lies in one of the spans; the scan gets the comparisons."""
    inside = F.lit(False)
    for i, (low, high) in enumerate(spans):
        inside = F.col(column).between(low, high) if i == 0 else inside | F.col(column).between(low, high)
    return inside


def exact_filter(df: DataFrame, predicates: list[Predicate]) -> DataFrame:
    """Rows within the bounds; Catalyst pushes the comparisons into the scan."""
    for p in predicates:
        if p.lower is not None:
            df = df.where(F.col(p.column) >= p.lower)
        if p.upper is not None:
            df = df.where(F.col(p.column) <= p.upper)
    return df


def report(options: ReadOptions, selected: int, total: int, columns: int) -> ReadReport:
    if not options.validate_checksums:
        raise Unimplemented("reads without checksum validation")
    if options.decode_dictionaries:
        raise Unimplemented("reads that decode dictionaries")
    if options.read_threads < 1:
        raise invalid("read_threads is zero")
    effective = max(1, min(options.read_threads, selected))
    reason = None
    if options.read_threads == 1:
        reason = "thread_cap_one"
    elif selected <= 1:
        reason = "too_few_row_groups"
        effective = 1
    return ReadReport(options.read_threads, effective, selected, total - selected, selected * columns, reason)


def ordering_key_predicates(columns: list[Column], keys: list[str], ranges: dict[int, tuple]) -> list[Predicate]:
    """Bounds by index of ordering key, as conjunctive predicates."""
    if not ranges:
        raise invalid("no ordering-key range")
    out = []
    for index, bounds in ranges.items():
        if not 0 <= index < len(keys):
            raise invalid(f"unknown ordering key {index}")
        out.append(Predicate(keys[index], *bounds))
    check(columns, out)
    return out


def subset(plan: ReadPlan, row_groups: list[int]) -> tuple[int, ...]:
    """Chosen row groups of a plan, in the plan's order."""
    if len(set(row_groups)) != len(row_groups):
        raise invalid("read plan subset contains duplicate row group ids")
    unknown = [g for g in row_groups if g not in plan.row_groups]
    if unknown:
        raise invalid(f"read plan subset contains unknown row group {unknown[0]}")
    chosen = set(row_groups)
    return tuple(g for g in plan.row_groups if g in chosen)
