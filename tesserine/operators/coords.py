"""Coordinates of tensor axes: lookups with errors (first API) or with statuses (second API).

Coordinates are a dimension table (axis, pos, number, text, code, commit); dictionaries are (axis, code, stable_id,
label, alias, commit). A lookup touches these tables only; the tensor is read afterwards, by position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import invalid
from .tensor import Tensor, axis_range, axis_take

STATUSES = ("unique", "range", "many", "missing", "unavailable", "duplicate", "unsupported", "error")
DOMAINS = ("i32", "i64", "fixed_text", "code", "stable_id", "label", "alias", "raw_time")
ENCODINGS = ("plain", "days", "yyyymmdd", "epoch_s", "epoch_ms", "epoch_us", "epoch_ns")
CODE_WIDTHS = {"u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)"}
COORDINATES = "axis int, pos long, number long, text string, code long, commit long"
DICTIONARY = "axis int, code long, stable_id string, label string, alias string, commit long"


@dataclass(frozen=True)
class Axis:
    """How an axis is described: kind i32, i64, fixed_text, dictionary, append_sequence or external."""

    axis: int
    kind: str
    width: int | None = None
    unique: bool = False
    encoding: str = "plain"


def axis_coordinates(coords: DataFrame, axis: int, commit: int | None = None) -> DataFrame:
    out = coords.where(F.col("axis") == axis)
    return out if commit is None else out.where(F.col("commit") <= commit)


def padded(text: str, width: int) -> str:
    if len(text) > width or not text.isascii():
        raise invalid("text is too long or not ASCII")
    return text.ljust(width)


# --- first API: errors, inclusive ranges ------------------------------------------------------------------


def index_of(coords: DataFrame, spec: Axis, value: int, dtype: str) -> int:
    if spec.kind != dtype:
        raise invalid(f"coordinates are {spec.kind}, not {dtype}")
    found = axis_coordinates(coords, spec.axis).where(F.col("number") == value).orderBy("pos").select("pos").head()
    if found is None:
        raise invalid(f"coordinate {value} is missing")
    return found[0]


def range_of(coords: DataFrame, spec: Axis, lower: int, upper: int, dtype: str) -> tuple[int, int]:
    """Half-open positions of an inclusive range of values; partial overlap will do, none is an error."""
    if spec.kind != dtype:
        raise invalid(f"coordinates are {spec.kind}, not {dtype}")
    r = axis_coordinates(coords, spec.axis).where(F.col("number").between(lower, upper)).agg(F.min("pos"), F.max("pos")).head()
    if r[0] is None:
        raise invalid("no coordinate in range")
    return r[0], r[1] + 1


def at_coordinate(t: Tensor, coords: DataFrame, axis: int, value: int) -> Tensor:
    """Cells at a value, the axis kept with length 1: a join with the dimension table."""
    hit = axis_coordinates(coords, axis).where(F.col("number") == value).select(F.col("pos").alias(f"i{axis}"))
    cells = t.cells.join(hit, f"i{axis}", "left_semi").withColumn(f"i{axis}", F.lit(0).cast("bigint"))
    return t.with_cells(cells.select(*t.axes, "value"), (*t.shape[:axis], 1, *t.shape[axis + 1 :]))


def in_coordinate_range(t: Tensor, coords: DataFrame, spec: Axis, lower: int, upper: int) -> Tensor:
    return axis_range(t, spec.axis, *range_of(coords, spec, lower, upper, spec.kind))


# --- second API: statuses, half-open ranges ---------------------------------------------------------------


@dataclass(frozen=True)
class Lookup:
    status: str
    positions: tuple[int, ...] = ()
    start: int | None = None
    end: int | None = None
    category: str | None = None


def _positions(coords: DataFrame, dictionary: DataFrame | None, spec: Axis, domain: str, key, commit: int | None) -> DataFrame | str:
    if domain not in DOMAINS:
        raise invalid(f"unknown key domain {domain}")
    if spec.kind == "external":
        return "unavailable"
    at = axis_coordinates(coords, spec.axis, commit)
    if domain in ("i32", "i64", "raw_time"):
        return "error" if spec.kind != domain and not (domain == "raw_time" and spec.kind in ("i32", "i64") and spec.encoding != "plain") else at.where(F.col("number") == key)
    if domain == "fixed_text":
        return "error" if spec.kind != "fixed_text" else at.where(F.col("text") == padded(key, spec.width))
    if spec.kind != "dictionary":
        return "error"
    if domain == "alias":
        return "unsupported"
    names = dictionary.where(F.col("axis") == spec.axis)
    if commit is not None:
        names = names.where(F.col("commit") <= commit)
    column: Column = F.col("code") == key if domain == "code" else F.col("stable_id" if domain == "stable_id" else "label") == key
    return at.join(names.where(column).select("code"), "code", "left_semi")


def lookup(coords: DataFrame, spec: Axis, domain: str, key, dictionary: DataFrame | None = None, commit: int | None = None) -> Lookup:
    """Where a key stands; several positions are `duplicate` on an axis declared unique, else `many`."""
    found = _positions(coords, dictionary, spec, domain, key, commit)
    if isinstance(found, str):
        return Lookup(found, category="lookup_domain_mismatch" if found == "error" else None)
    pos = tuple(r[0] for r in found.select("pos").orderBy("pos").collect())
    if not pos:
        return Lookup("missing")
    return Lookup("unique", pos) if len(pos) == 1 else Lookup("duplicate" if spec.unique else "many", pos)


def lookup_range(coords: DataFrame, spec: Axis, lower: int, upper: int, commit: int | None = None) -> Lookup:
    """Positions of values in [lower, upper)."""
    if spec.kind == "external":
        return Lookup("unavailable")
    if spec.kind not in ("i32", "i64"):
        return Lookup("error", category="lookup_domain_mismatch")
    r = axis_coordinates(coords, spec.axis, commit).where((F.col("number") >= lower) & (F.col("number") < upper)).agg(F.min("pos"), F.max("pos")).head()
    return Lookup("missing") if r[0] is None else Lookup("range", (), r[0], r[1] + 1)


def statuses(coords: DataFrame, keys: DataFrame, axis: int, unique: bool) -> DataFrame:
    """Many lookups at once: keys (key) to (key, status, start, end) by one join."""
    at = axis_coordinates(coords, axis).select(F.col("number").alias("key"), "pos")
    n = F.count("pos")
    status = F.when(n == 0, "missing").when(n == 1, "unique").otherwise("duplicate" if unique else "many")
    return keys.join(at, "key", "left").groupBy("key").agg(status.alias("status"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))


def read(t: Tensor, spec: Axis, found: Lookup) -> Tensor | None:
    """The payload of a unique or range lookup, None for any other status."""
    if found.status == "unique":
        return axis_take(t, spec.axis, list(found.positions))
    if found.status == "range":
        return axis_range(t, spec.axis, found.start, found.end)
    return None


def declarations(coords: DataFrame, axis: int) -> DataFrame:
    """One row: whether an axis' numbers are sorted, strictly monotonic and unique."""
    at = axis_coordinates(coords, axis)
    before = F.lag("number").over(Window.partitionBy("axis").orderBy("pos"))
    rows = at.withColumn("before", before)
    return rows.agg(
        F.coalesce(F.bool_and(F.col("number") >= F.col("before")), F.lit(True)).alias("sorted"),
        F.coalesce(F.bool_and(F.col("number") > F.col("before")), F.lit(True)).alias("monotonic"),
        (F.count_distinct("number") == F.count("number")).alias("unique"),
    )


def extended(dictionary: DataFrame, new: DataFrame) -> DataFrame:
    """The dictionary with an append's new codes; a code that is declared again fails."""
    if not new.join(dictionary, ["axis", "code"], "left_semi").isEmpty() or not new.groupBy("axis", "code").count().where("count > 1").isEmpty():
        raise invalid("a dictionary code is declared again")
    return dictionary.unionByName(new)
