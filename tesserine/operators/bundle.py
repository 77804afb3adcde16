"""Reads of ordered tables: projections, pruning, reports, visits and ordered preparation."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import TableError, invalid
from ..functions.types import Column, columns_of
from ..plans import predicates as P
from ..scratch import stored
from . import layout
from .records import Projection, project

OWN = ["row_group_id", "base_row", "row_in_group"]


@dataclass
class Bundle:
    """One snapshot of an ordered table: rows with their row groups, statistics, dictionaries and ordering keys."""

    rows: DataFrame
    columns: list[Column]
    keys: list[str]
    stats: DataFrame
    dictionaries: DataFrame | None = None
    generation: int = 1
    previous: int | None = None

    @staticmethod
    def build(df: DataFrame, keys: list[str], group_rows: int = layout.GROUP_ROWS, columns: list[Column] | None = None, dictionaries: DataFrame | None = None) -> Bundle:
        """A bundle of df, whose ordered rows are written once: statistics and reads scan them, they do not order them again."""
        columns = columns or columns_of(df.schema)
        rows = stored(layout.grouped(df.select(*(c.name for c in columns)), keys, group_rows), "bundle")
        return Bundle(rows, columns, keys, layout.statistics(rows, columns), dictionaries)

    # --- metadata -------------------------------------------------------------------------------------

    def row_count(self) -> int:
        return self.stats.agg(F.coalesce(F.sum("rows"), F.lit(0))).head()[0]

    def row_group_count(self) -> int:
        return self.stats.count()

    def metadata(self) -> DataFrame:
        spark = self.rows.sparkSession
        one = [(self.generation, self.previous, len(self.columns), self.row_group_count(), self.row_count(), self.keys, self.rows.schema.json())]
        return spark.createDataFrame(one, "generation long, previous_generation long, columns int, row_groups long, rows long, ordering_keys array<string>, schema string")

    def row_group_summaries(self, plan: P.ReadPlan | None = None) -> DataFrame:
        """Statistics in long form; with a plan, of its row groups and columns, in plan order."""
        if plan is None:
            return layout.long_statistics(self.stats, self.columns)
        own = layout.long_statistics(self.stats.where(P.within("row_group_id", P.spans_of(plan.row_groups))), P.resolve(self.columns, list(plan.columns)))
        return own.join(self._ordinals(plan, plan.row_groups), "row_group_id").orderBy("plan_ordinal", "column_id").drop("plan_ordinal")

    def dictionary(self, dictionary_id: int) -> DataFrame:
        found = self.dictionaries.where(F.col("dictionary_id") == dictionary_id) if self.dictionaries is not None else None
        if found is None or found.isEmpty():
            raise invalid(f"unknown dictionary {dictionary_id}")
        return found.select("code", "value")

    def decoded(self, column: str, label: str | None = None, df: DataFrame | None = None) -> DataFrame:
        """Rows with the label of a dictionary code beside it; a join, so large dictionaries are shuffled, small ones sent out by size."""
        c = next(x for x in self.columns if x.name == column)
        names = self.dictionary(c.dictionary_id).select(F.col("code").alias(column), F.col("value").alias(label or f"{column}_label"))
        return (self.rows if df is None else df).join(names, column, "left")

    # --- planning -------------------------------------------------------------------------------------

    def pruned(self, predicates: list[P.Predicate]) -> DataFrame:
        """Ids of the row groups that may match."""
        return self.stats.where(P.group_condition(predicates)).select("row_group_id")

    def spans(self, predicates: list[P.Predicate]) -> tuple[list[tuple[int, int]], bool]:
        """At most P.SPANS ranges of ids that hold all row groups that may match, and whether they hold no others; the driver gets a row for each range."""
        top = self.stats.agg(F.max("row_group_id")).head()[0] or 0
        bucket = F.expr(f"row_group_id div {top // P.SPANS + 1}")
        found = sorted(self.pruned(predicates).groupBy(bucket).agg(F.min("row_group_id"), F.max("row_group_id"), F.count("*")).collect())
        exact = all(high - low + 1 == n for _, low, high, n in found)
        joined: list[tuple[int, int]] = []
        for _, low, high, _ in found:
            joined[-1:] = [(joined[-1][0], high)] if joined and joined[-1][1] + 1 == low else [*joined[-1:], (low, high)]
        return joined, exact

    def plan(self, names: list[str] | None = None, predicates: list[P.Predicate] = (), options: P.ReadOptions | None = None) -> P.ReadPlan:
        """A stored plan: ids of row groups come to the driver, so many as a snapshot has, not its rows."""
        options = options or P.ReadOptions()
        chosen = P.resolve(self.columns, names)
        P.check(self.columns, list(predicates))
        P.report(options, 0, 0, 0)
        ids = sorted(r[0] for r in self.pruned(list(predicates)).collect())
        return P.ReadPlan(tuple(c.name for c in chosen), tuple(ids), P.report(options, len(ids), self.row_group_count(), len(chosen)), tuple(predicates))

    def plan_strict(self, names=None, predicates=(), options=None, max_row_groups: int | None = None) -> P.ReadPlan:
        plan = self.plan(names, predicates, options)
        for p in predicates:
            if not self.stats.where(F.col(f"min_{p.column}").isNull() | F.col(f"max_{p.column}").isNull()).isEmpty():
                raise invalid(f"strict plan: a row group has no statistics of {p.column}")
        if max_row_groups is not None and len(plan.row_groups) > max_row_groups:
            raise invalid(f"strict plan: {len(plan.row_groups)} row groups, at most {max_row_groups} allowed")
        return plan

    def validate_plan(self, plan: P.ReadPlan) -> None:
        P.resolve(self.columns, list(plan.columns))
        if len(set(plan.row_groups)) != len(plan.row_groups):
            raise invalid("read plan contains duplicate row group ids")
        known = {r[0] for r in self.stats.select("row_group_id").collect()}
        if not set(plan.row_groups) <= known:
            raise invalid("read plan contains unknown row group ids")

    # --- reads ----------------------------------------------------------------------------------------

    def read(self, names: list[str] | None = None, predicates: list[P.Predicate] = (), options: P.ReadOptions | None = None) -> DataFrame:
        """Whole row groups that may match, projected.

        Statistics give spans of ids, which the scan is filtered by, so files and Parquet row groups without them are not read. Only where
        spans hold other row groups as well does a semi-join with the statistics follow.
        """
        chosen = P.resolve(self.columns, names)
        P.check(self.columns, list(predicates))
        P.report(options or P.ReadOptions(), 0, 0, 0)
        rows = self.rows
        if predicates:
            spans, exact = self.spans(list(predicates))
            rows = rows.where(P.within("row_group_id", spans))
            rows = rows if exact else rows.join(self.pruned(list(predicates)), "row_group_id", "left_semi")
        return rows.select(*OWN, *(c.name for c in chosen))

    def read_with_report(self, names=None, predicates=(), options=None) -> tuple[DataFrame, DataFrame]:
        plan = self.plan(names, predicates, options)
        return self.read_plan(plan), self.rows.sparkSession.createDataFrame([tuple(asdict(plan.report).values())], REPORT)

    def read_with_attribution(self, names=None, predicates=(), options=None) -> tuple[DataFrame, DataFrame, dict]:
        """Rows, report, and what the planner knows of the read: nanoseconds of planning, chunks, bytes by Spark's estimate, the physical plan."""
        start = time.perf_counter_ns()
        rows, report = self.read_with_report(names, predicates, options)
        execution = rows._jdf.queryExecution()
        planned = time.perf_counter_ns() - start
        size = int(str(execution.optimizedPlan().stats().sizeInBytes()))
        return rows, report, {"plan_ns": planned, "estimated_bytes": size, "physical_plan": execution.executedPlan().toString()}

    def read_plan(self, plan: P.ReadPlan, row_groups: list[int] | None = None) -> DataFrame:
        """The plan's row groups, or a subset of them, with the ordinal of each in the plan."""
        chosen = plan.row_groups if row_groups is None else P.subset(plan, row_groups)
        return self._planned(self.rows, plan, chosen).select("plan_ordinal", *OWN, *plan.columns)

    def _ordinals(self, plan: P.ReadPlan, chosen: tuple[int, ...]) -> DataFrame:
        place = {g: i for i, g in enumerate(plan.row_groups)}
        return self.rows.sparkSession.createDataFrame([(g, place[g]) for g in chosen], "row_group_id int, plan_ordinal int")

    def _planned(self, df: DataFrame, plan: P.ReadPlan, chosen: tuple[int, ...]) -> DataFrame:
        """Rows of the chosen row groups with their ordinals; the scan is filtered by spans of ids."""
        return df.where(P.within("row_group_id", P.spans_of(chosen))).join(self._ordinals(plan, chosen), "row_group_id")

    def read_row_group(self, row_group_id: int) -> DataFrame:
        found = self.rows.where(F.col("row_group_id") == row_group_id)
        if found.isEmpty():
            raise invalid(f"unknown row group {row_group_id}")
        return found

    def read_row_group_into(self, row_group_id: int, buffers: dict[str, tuple[str, int, bool]]) -> pa.Table:
        """buffers: name -> (physical type, capacity, takes nulls). All are checked before anything is read."""
        columns = P.resolve(self.columns, list(buffers))
        rows = self.stats.where(F.col("row_group_id") == row_group_id).head()
        if rows is None:
            raise invalid(f"unknown row group {row_group_id}")
        for c in columns:
            physical, capacity, nulls = buffers[c.name]
            if physical != c.physical:
                raise invalid(f"buffer of {c.name} has type {physical}, the column {c.physical}")
            if capacity < rows["rows"]:
                raise invalid(f"buffer of {c.name} is too small")
            if c.nullable and not nulls:
                raise invalid(f"buffer of {c.name} takes no nulls")
        return self.read_row_group(row_group_id).orderBy("row_in_group").select(*buffers).toArrow()

    def visit(self, visitor: Callable[[int, list], bool | None], plan: P.ReadPlan, row_groups: list[int] | None = None) -> bool:
        """Call visitor(row_group_id, rows) in plan order, one row group in memory at a time; False stops. Returns whether all were visited."""
        return _visited(self.read_plan(plan, row_groups), list(plan.columns), visitor)

    def project_plan(self, plan: P.ReadPlan, p: Projection, row_groups: list[int] | None = None) -> DataFrame:
        """The fields of the plan's packed records, with the place of each row; only the column of records is read."""
        P.resolve(self.columns, [p.column])
        if p.column not in plan.columns:
            raise invalid(f"the plan does not read {p.column}")
        chosen = plan.row_groups if row_groups is None else P.subset(plan, row_groups)
        return project(self._planned(self.rows, plan, chosen), p, ("plan_ordinal", *OWN))

    def visit_projected(self, visitor: Callable[[int, list], bool | None], plan: P.ReadPlan, p: Projection, row_groups: list[int] | None = None) -> tuple[bool, dict]:
        """visit over projected records; also what was visited: row groups, rows, bytes of records, nanoseconds until the plan stood and in all."""
        start, seen = time.perf_counter_ns(), {"row_groups": 0, "rows": 0, "record_bytes": 0}
        rows = self.project_plan(plan, p, row_groups)
        seen["plan_ns"] = time.perf_counter_ns() - start

        def count(g: int, found: list) -> bool | None:
            seen["row_groups"] += 1
            seen["rows"] += len(found)
            seen["record_bytes"] += len(found) * p.width
            return visitor(g, found)

        whole = _visited(rows, [f.name for f in p.fields], count)
        return whole, seen | {"total_ns": time.perf_counter_ns() - start}

    def visit_into(self, buffers: dict[str, list], visitor: Callable[[int, dict[str, list]], bool | None], plan: P.ReadPlan, row_groups: list[int] | None = None) -> bool:
        """visit with the caller's lists, one a column, refilled for each row group."""
        P.resolve(self.columns, list(buffers))

        def fill(g: int, rows: list) -> bool | None:
            for name, buffer in buffers.items():
                buffer[:] = [r[name] for r in rows]
            return visitor(g, buffers)

        return self.visit(fill, plan, row_groups)

    def prepare(self, function: Callable[[pa.Table], bytes], plan: P.ReadPlan, row_groups: list[int] | None = None) -> DataFrame:
        """Workers map each row group to bytes in parallel: rows (plan_ordinal, payload, error)."""

        def run(table: pa.Table) -> pa.Table:
            ordinal = table.column("plan_ordinal")[0].as_py()
            ordered = table.sort_by("row_in_group").select(list(plan.columns))
            try:
                payload, error = function(ordered), None
            except Exception as e:  # reported by ordinal, the earliest wins
                payload, error = None, f"{type(e).__name__}: {e}"
            return pa.table({"plan_ordinal": pa.array([ordinal], pa.int32()), "payload": pa.array([payload], pa.binary()), "error": pa.array([error], pa.string())})

        return self.read_plan(plan, row_groups).groupBy("row_group_id").applyInArrow(run, "plan_ordinal int, payload binary, error string")

    def prepare_and_commit(self, function, commit: Callable[[int, bytes], bool | None], plan: P.ReadPlan, row_groups=None) -> bool:
        """Commit prepared row groups strictly in plan order; the earliest error is raised; False stops. Returns whether all were committed."""
        for r in self.prepare(function, plan, row_groups).orderBy("plan_ordinal").toLocalIterator():
            if r["error"]:
                raise TableError("invalid_input", f"row group at ordinal {r['plan_ordinal']}: {r['error']}")
            if commit(r["plan_ordinal"], r["payload"]) is False:
                return False
        return True

    def session(self, plan: P.ReadPlan) -> ReadSession:
        return ReadSession(self, plan)


def _batches(rows: DataFrame, columns: list[str]) -> Iterator[tuple[int, list]]:
    """Row groups in plan order, by one ordered read; partitions come to the driver one after the other."""
    ordered = rows.orderBy("plan_ordinal", "row_in_group").select("row_group_id", *(F.col(c).alias(f"_{i}") for i, c in enumerate(columns)))
    make = Row(*columns)
    for g, found in groupby(ordered.toLocalIterator(), key=lambda r: r[0]):
        yield g, [make(*r[1:]) for r in found]


def _visited(rows: DataFrame, columns: list[str], visitor: Callable[[int, list], bool | None]) -> bool:
    return all(visitor(g, found) is not False for g, found in _batches(rows, columns))


REPORT = "requested_read_threads int, effective_read_threads int, selected_row_groups int, pruned_row_groups int, selected_chunks int, fallback_reason string"


class ReadSession:
    """A poll interface: next() gives ('batch', row_group_id, rows), ('end',) or ('cancelled',)."""

    def __init__(self, bundle: Bundle, plan: P.ReadPlan):
        self.plan, self.cancelled = plan, False
        self.batches = _batches(bundle.read_plan(plan), list(plan.columns))

    def next(self) -> tuple:
        if self.cancelled:
            return ("cancelled",)
        found = next(self.batches, None)
        return ("end",) if found is None else ("batch", *found)

    def cancel(self) -> None:
        """Nothing is read from here on."""
        self.cancelled = True
        self.batches.close()

    def report(self) -> P.ReadReport:
        return self.plan.report

    def __iter__(self) -> Iterator[tuple]:
        while (x := self.next())[0] == "batch":
            yield x
