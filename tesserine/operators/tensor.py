"""N-dimensional arrays as long tables: index columns i0..iN-1 and a value; an absent cell is a missing row.

A Tensor's shape lives beside its cells, since trailing empty slices have no rows. Every operation is an
expression over the index columns, a grouping or a join; nothing is collected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Unimplemented, invalid

DTYPES = {"f32": "float", "f64": "double", "i32": "int", "i64": "bigint"}
ELLIPSIS, NEWAXIS = "...", "newaxis"


@dataclass(frozen=True)
class Tensor:
    cells: DataFrame
    dtype: str
    shape: tuple[int, ...]

    def __post_init__(self):
        if self.dtype not in DTYPES:
            raise invalid(f"unknown dtype {self.dtype}")
        if not self.shape:
            raise invalid("tensors have at least one axis")

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def axes(self) -> list[str]:
        return [f"i{k}" for k in range(self.rank)]

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def whole(self) -> bool:
        return self.dtype[0] == "i"

    def axis(self, k: int) -> int:
        n = k + self.rank if k < 0 else k
        if not 0 <= n < self.rank:
            raise invalid(f"axis {k} of a tensor of rank {self.rank}")
        return n

    def with_cells(self, cells: DataFrame, shape: tuple[int, ...] | None = None, dtype: str | None = None) -> Tensor:
        return replace(self, cells=cells, shape=self.shape if shape is None else tuple(shape), dtype=dtype or self.dtype)

    def indexed(self, columns: list[Column], shape, value: Column | None = None, dtype: str | None = None, source: DataFrame | None = None) -> Tensor:
        """A tensor of new index columns over the same cells."""
        df = self.cells if source is None else source
        v = F.col("value") if value is None else value
        return self.with_cells(df.select(*(c.cast("bigint").alias(f"i{k}") for k, c in enumerate(columns)), v.cast(DTYPES[dtype or self.dtype]).alias("value")), shape, dtype)

    def flat(self, prefix: str = "i") -> Column:
        """Row-major flat index."""
        out = F.lit(0).cast("bigint")
        for k, n in enumerate(self.shape):
            out = out * n + F.col(f"{prefix}{k}")
        return out


def from_frame(df: DataFrame, axes: list[str], value: str, dtype: str, shape: tuple[int, ...]) -> Tensor:
    return Tensor(df.select(*(F.col(a).cast("bigint").alias(f"i{k}") for k, a in enumerate(axes)), F.col(value).cast(DTYPES[dtype]).alias("value")), dtype, tuple(shape))


def from_array(df: DataFrame, row: Column, array: Column, dtype: str, shape: tuple[int, int]) -> Tensor:
    """A matrix with a row for each row of df and its array's elements along axis 1."""
    cells = df.select(row.cast("bigint").alias("i0"), F.posexplode(array).alias("i1", "v"))
    return Tensor(cells.select("i0", F.col("i1").cast("bigint"), F.col("v").cast(DTYPES[dtype]).alias("value")), dtype, shape)


def from_numpy(spark: SparkSession, x: np.ndarray, dtype: str) -> Tensor:
    rows = [(*map(int, at), x[at].item()) for at in np.ndindex(x.shape)]
    axes = ", ".join(f"i{k} long" for k in range(x.ndim))
    return Tensor(spark.createDataFrame(rows, f"{axes}, value {DTYPES[dtype]}"), dtype, x.shape)


def to_numpy(t: Tensor, fill=0) -> np.ndarray:
    out = np.full(t.shape, fill, {"f32": np.float32, "f64": np.float64, "i32": np.int32, "i64": np.int64}[t.dtype])
    p = t.cells.toPandas()
    if len(p):
        out[tuple(p[a].to_numpy() for a in t.axes)] = p["value"].to_numpy()
    return out


def to_arrow(t: Tensor) -> pa.Table:
    return t.cells.orderBy(*t.axes).toArrow()


def grid(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """All index tuples of a shape, unrolled from one distributed range, so nothing is joined."""
    df = spark.range(math.prod(shape)).withColumnRenamed("id", "_flat")
    out, rest = [], math.prod(shape)
    for k, n in enumerate(shape):
        rest //= max(1, n)
        out.append(F.expr(f"(_flat div {max(1, rest)}) % {max(1, n)}").alias(f"i{k}"))
    return df.select(*out)


def checked_fill(dtype: str, fill: float):
    if dtype[0] == "i":
        if fill != int(fill):
            raise invalid("fill of an integer tensor is not integral")
        return int(fill)
    return float(fill)


def dense(t: Tensor, fill: float = 0) -> DataFrame:
    """All cells of the shape with valid; absent ones hold the fill value."""
    f = F.lit(checked_fill(t.dtype, fill)).cast(DTYPES[t.dtype])
    g = grid(t.cells.sparkSession, t.shape)
    return g.join(t.cells.withColumn("valid", F.lit(True)), t.axes, "left").select(*t.axes, F.coalesce("value", f).alias("value"), F.coalesce("valid", F.lit(False)).alias("valid"))


# --- reads ------------------------------------------------------------------------------------------------


def axis_range(t: Tensor, axis: int, start: int, end: int) -> Tensor:
    k = t.axis(axis)
    if not 0 <= start <= end <= t.shape[k]:
        raise invalid(f"range {start}:{end} of an axis of {t.shape[k]}")
    c = F.col(f"i{k}")
    cols = [F.col(a) - start if j == k else F.col(a) for j, a in enumerate(t.axes)]
    return t.indexed(cols, (*t.shape[:k], end - start, *t.shape[k + 1 :]), source=t.cells.where((c >= start) & (c < end)))


def axis_take(t: Tensor, axis: int, indices: list[int]) -> Tensor:
    """Slices in order of the indices, repeats allowed; the index list is a table that is joined."""
    k = t.axis(axis)
    if any(not 0 <= i < t.shape[k] for i in indices):
        raise invalid("take index out of range")
    picks = t.cells.sparkSession.createDataFrame(list(enumerate(indices)), "_to long, _from long")
    cols = [F.col("_to") if j == k else F.col(a) for j, a in enumerate(t.axes)]
    return t.indexed(cols, (*t.shape[:k], len(indices), *t.shape[k + 1 :]), source=t.cells.join(F.broadcast(picks) if len(indices) < 100_000 else picks, F.col(f"i{k}") == F.col("_from")))


def axis_one(t: Tensor, axis: int, index: int) -> Tensor:
    """One slice; the axis stays with length 1."""
    if not 0 <= index < t.shape[t.axis(axis)]:
        raise invalid("index out of range")
    return axis_range(t, axis, index, index + 1)


def scalar(t: Tensor, at: tuple[int, ...]) -> DataFrame:
    """One row with the cell's value, none if it is absent."""
    if len(at) != t.rank or any(not 0 <= i < n for i, n in zip(at, t.shape, strict=True)):
        raise invalid("scalar index out of range")
    return t.cells.where(reduce(lambda a, b: a & b, (F.col(f"i{k}") == i for k, i in enumerate(at)))).select("value")


def select(t: Tensor, selectors: list) -> Tensor:
    """Per axis None (all), (start, end) or a list of indices."""
    if len(selectors) != t.rank:
        raise invalid("one selector for each axis is needed")
    for k, s in enumerate(selectors):
        if isinstance(s, tuple):
            t = axis_range(t, k, *s)
        elif s is not None:
            t = axis_take(t, k, list(s))
    return t


def read_index(t: Tensor, items: list) -> Tensor:
    """Index items: an int (drops the axis), a slice with a step of 1 or more, ELLIPSIS, NEWAXIS; negatives count from the end."""
    if items.count(ELLIPSIS) > 1:
        raise invalid("more than one ellipsis")
    used = sum(1 for x in items if x not in (ELLIPSIS, NEWAXIS))
    if used > t.rank:
        raise invalid("more index items than axes")
    rest = [slice(None)] * (t.rank - used)
    at = items.index(ELLIPSIS) if ELLIPSIS in items else len(items)
    items = [*items[:at], *rest, *items[at + 1 :]]
    if all(isinstance(x, int) for x in items):
        raise invalid("a read of one scalar is not a tensor")
    df, cols, shape, k = t.cells, [], [], 0
    for x in items:
        if x == NEWAXIS:
            cols.append(F.lit(0))
            shape.append(1)
            continue
        n, c = t.shape[k], F.col(f"i{k}")
        k += 1
        if isinstance(x, int):
            i = x + n if x < 0 else x
            if not 0 <= i < n:
                raise invalid(f"index {x} of an axis of {n}")
            df = df.where(c == i)
        else:
            step = 1 if x.step is None else x.step
            if step == 0:
                raise invalid("slice step is zero")
            if step < 0:
                raise invalid("negative slice steps are not supported by read_index")
            start, end, _ = x.indices(n)
            if (start, end, step) != (0, n, 1):
                df = df.where((c >= start) & (c < end) & ((c - start) % step == 0))
            cols.append(F.expr(f"(i{k - 1} - {start}) div {step}"))
            shape.append(max(0, -(-(end - start) // step)))
    return t.indexed(cols, shape, source=df)


# --- shape ------------------------------------------------------------------------------------------------


def contiguous(t: Tensor) -> Tensor:
    return t


def reshape(t: Tensor, shape: tuple[int, ...]) -> Tensor:
    if math.prod(shape) != t.size or not shape:
        raise invalid(f"cannot reshape {t.shape} to {shape}")
    df, cols, rest = t.cells.withColumn("_flat", t.flat()), [], t.size
    for n in shape:
        rest //= max(1, n)
        cols.append(F.expr(f"(_flat div {max(1, rest)}) % {max(1, n)}"))
    return t.indexed(cols, shape, source=df)


def flatten(t: Tensor) -> Tensor:
    return reshape(t, (t.size,))


def expand_dims(t: Tensor, axis: int) -> Tensor:
    k = axis + t.rank + 1 if axis < 0 else axis
    if not 0 <= k <= t.rank:
        raise invalid("axis out of range")
    cols = [F.col(a) for a in t.axes]
    return t.indexed([*cols[:k], F.lit(0), *cols[k:]], (*t.shape[:k], 1, *t.shape[k:]))


def squeeze(t: Tensor, axis: int | None = None) -> Tensor:
    drop = {t.axis(axis)} if axis is not None else {k for k, n in enumerate(t.shape) if n == 1}
    if any(t.shape[k] != 1 for k in drop):
        raise invalid("only axes of length 1 can be squeezed")
    keep = [k for k in range(t.rank) if k not in drop]
    if not keep:
        raise invalid("tensors have at least one axis")
    return t.indexed([F.col(f"i{k}") for k in keep], [t.shape[k] for k in keep])


def permute(t: Tensor, order: list[int]) -> Tensor:
    order = [t.axis(k) for k in order]
    if sorted(order) != list(range(t.rank)):
        raise invalid("axes are not a permutation")
    return t.indexed([F.col(f"i{k}") for k in order], [t.shape[k] for k in order])


def transpose(t: Tensor) -> Tensor:
    return permute(t, list(reversed(range(t.rank))))


def swap_axes(t: Tensor, a: int, b: int) -> Tensor:
    order = list(range(t.rank))
    a, b = t.axis(a), t.axis(b)
    order[a], order[b] = order[b], order[a]
    return permute(t, order)


def move_axis(t: Tensor, source: int, target: int) -> Tensor:
    order = list(range(t.rank))
    order.insert(t.axis(target), order.pop(t.axis(source)))
    return permute(t, order)


def broadcast_to(t: Tensor, shape: tuple[int, ...]) -> Tensor:
    pad = len(shape) - t.rank
    if pad < 0 or any(n not in (1, m) for n, m in zip(t.shape, shape[pad:], strict=True)):
        raise invalid(f"cannot broadcast {t.shape} to {shape}")
    df, cols = t.cells, []
    for k, n in enumerate(shape):
        old = k - pad
        if old >= 0 and t.shape[old] == n:
            cols.append(F.col(f"i{old}"))
        else:  # copies are generated row by row
            df = df.withColumn(f"_b{k}", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n else df.where("false").withColumn(f"_b{k}", F.lit(0))
            cols.append(F.col(f"_b{k}"))
    return t.indexed(cols, shape, source=df)


def slice_axis(t: Tensor, axis: int, start: int, end: int, step: int = 1) -> Tensor:
    """Half-open, with a signed step, by NumPy's rule for indices."""
    if step == 0:
        raise invalid("slice step is zero")
    k = t.axis(axis)
    picked = range(*slice(start, end if step > 0 or end >= 0 else None, step).indices(t.shape[k]))
    c = F.col(f"i{k}")
    if not len(picked):
        return t.with_cells(t.cells.where("false"), (*t.shape[:k], 0, *t.shape[k + 1 :]))
    lo, hi = min(picked[0], picked[-1]), max(picked[0], picked[-1])
    df = t.cells.where(c.between(lo, hi) & ((c - picked[0]) % step == 0))
    cols = [F.expr(f"(i{k} - {picked[0]}) div {step}") if j == k else F.col(a) for j, a in enumerate(t.axes)]
    return t.indexed(cols, (*t.shape[:k], len(picked), *t.shape[k + 1 :]), source=df)


def concat(ts: list[Tensor], axis: int) -> Tensor:
    if not ts:
        raise invalid("nothing to concatenate")
    k = ts[0].axis(axis)
    for t in ts:
        if t.dtype != ts[0].dtype or t.rank != ts[0].rank or any(a != b for j, (a, b) in enumerate(zip(t.shape, ts[0].shape, strict=True)) if j != k):
            raise invalid("concat needs one dtype and equal other extents")
    at, parts = 0, []
    for t in ts:
        parts.append(t.cells.withColumn(f"i{k}", F.col(f"i{k}") + at))
        at += t.shape[k]
    shape = (*ts[0].shape[:k], at, *ts[0].shape[k + 1 :])
    return ts[0].with_cells(reduce(DataFrame.unionByName, parts), shape)


def stack(ts: list[Tensor], axis: int = 0) -> Tensor:
    if not ts or any(t.shape != ts[0].shape or t.dtype != ts[0].dtype for t in ts):
        raise invalid("stack needs identical shapes and dtypes")
    return concat([expand_dims(t, axis) for t in ts], axis)


def split(t: Tensor, axis: int, sections: list[int]) -> list[Tensor]:
    k = t.axis(axis)
    if not sections or any(s <= 0 for s in sections) or sum(sections) != t.shape[k]:
        raise invalid("sections must be positive and sum to the axis")
    ends = np.cumsum(sections).tolist()
    return [axis_range(t, k, e - s, e) for s, e in zip(sections, ends, strict=True)]


def unstack(t: Tensor, axis: int = 0) -> list[Tensor]:
    if t.rank == 1:
        raise invalid("a tensor of rank 1 cannot be unstacked")
    k = t.axis(axis)
    return [squeeze(axis_one(t, k, i), k) for i in range(t.shape[k])]


def repeat(t: Tensor, axis: int, times: int) -> Tensor:
    return _copied(t, axis, times, lambda i, n: i * times + F.col("_r"))


def tile(t: Tensor, axis: int, times: int) -> Tensor:
    return _copied(t, axis, times, lambda i, n: i + F.col("_r") * n)


def _copied(t: Tensor, axis: int, times: int, place) -> Tensor:
    k = t.axis(axis)
    if times < 0:
        raise invalid("negative number of copies")
    df = t.cells.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times else t.cells.where("false").withColumn("_r", F.lit(0))
    cols = [place(F.col(a), t.shape[k]) if j == k else F.col(a) for j, a in enumerate(t.axes)]
    return t.indexed(cols, (*t.shape[:k], t.shape[k] * times, *t.shape[k + 1 :]), source=df)


def flip(t: Tensor, axis: int) -> Tensor:
    k = t.axis(axis)
    return t.indexed([t.shape[k] - 1 - F.col(a) if j == k else F.col(a) for j, a in enumerate(t.axes)], t.shape)


def roll(t: Tensor, axis: int, shift: int) -> Tensor:
    k = t.axis(axis)
    n = max(1, t.shape[k])
    return t.indexed([F.pmod(F.col(a) + shift, F.lit(n)) if j == k else F.col(a) for j, a in enumerate(t.axes)], t.shape)


# --- arithmetic -------------------------------------------------------------------------------------------


def _applied(op: str, x: Column, y: Column, dtype: str) -> Column:
    """x op y; integers overflow and divide by zero with an error (ANSI mode), floats follow IEEE."""
    if op == "add":
        return x + y
    if op == "sub":
        return x - y
    if op == "mul":
        return x * y
    if op != "div":
        raise invalid(f"unknown operation {op}")
    if dtype[0] == "i":
        return F.call_function("div", x, y)
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    # Zero divisors: NaN for 0/0 and NaN/0, else infinity with the signs of both, -0.0 included.
    minus = (F.signum(x) < 0) != (y.cast("string") == "-0.0")
    at_zero = F.when(F.isnan(x) | (x == 0), nan).when(minus, -inf).otherwise(inf)
    return F.when(y == 0, at_zero).otherwise(F.try_divide(x.cast("double"), y.cast("double")))


def elementwise(op: str, a: Tensor, b: Tensor) -> Tensor:
    """NumPy broadcasting as an equi-join on the axes that both have; cells absent on one side are absent."""
    if a.dtype != b.dtype:
        raise invalid("operands have different dtypes")
    rank = max(a.rank, b.rank)
    p, q = (1,) * (rank - a.rank) + a.shape, (1,) * (rank - b.rank) + b.shape
    if any(m != n and 1 not in (m, n) for m, n in zip(p, q, strict=True)):
        raise invalid(f"shapes {a.shape} and {b.shape} do not broadcast")
    shape = tuple(n if m == 1 else m for m, n in zip(p, q, strict=True))

    def named(t: Tensor, side: str) -> DataFrame:
        off = rank - t.rank
        return t.cells.select(*(F.col(f"i{k}").alias(f"{side}{k + off}") for k in range(t.rank)), F.col("value").alias(f"{side}v"))

    x, y = named(a, "x"), named(b, "y")
    on = [F.col(f"x{k}") == F.col(f"y{k}") for k in range(rank) if k >= rank - a.rank and k >= rank - b.rank and p[k] == q[k]]
    if any(p[k] == q[k] for k in range(rank) if k >= rank - min(a.rank, b.rank)):
        df = x.join(y, reduce(lambda m, n: m & n, on))
    else:  # no axis in common: one side is generated from the other's axes
        a, b = broadcast_to(a, shape), broadcast_to(b, shape)
        return elementwise(op, a, b)
    cols = []
    for k in range(rank):
        from_x = k >= rank - a.rank and (p[k] == shape[k])
        cols.append(F.col(f"{'x' if from_x else 'y'}{k}") if shape[k] != 1 or from_x else F.lit(0))
    return a.indexed(cols, shape, _applied(op, F.col("xv"), F.col("yv"), a.dtype), source=df)


def with_scalar(op: str, t: Tensor, value: float | int, swapped: bool = False) -> Tensor:
    """t op value, or value op t if swapped."""
    if t.whole != isinstance(value, int) or isinstance(value, bool):
        raise invalid("the scalar's type is not the tensor's")
    v, s = F.col("value"), F.lit(value).cast(DTYPES[t.dtype])
    return t.with_cells(t.cells.withColumn("value", (_applied(op, s, v, t.dtype) if swapped else _applied(op, v, s, t.dtype)).cast(DTYPES[t.dtype])))


# --- reductions -------------------------------------------------------------------------------------------


def _extreme(v: Column, order: Column, sign: int) -> Column:
    """Minimum or maximum in index order: NaN only if the first value is NaN."""
    ok = F.when(~F.isnan(v), v)
    best = F.min(ok) if sign < 0 else F.max(ok)
    return F.when(F.isnan(F.min_by(v, order)), float("nan")).otherwise(best)


def reduce_axes(op: str, t: Tensor, axes: list[int] | None = None, keepdims: bool = False) -> Tensor:
    """sum, mean, min, max, argmin, argmax, var or std over axes (None: all, which needs keepdims)."""
    drop = sorted({t.axis(k) for k in axes}) if axes is not None else list(range(t.rank))
    if axes is not None and len(drop) != len(axes):
        raise invalid("duplicate axis")
    if not drop:
        raise invalid("no axis to reduce")
    if len(drop) == t.rank and not keepdims:
        raise invalid("a reduction over all axes needs keepdims")
    kept = [k for k in range(t.rank) if k not in drop]
    v = F.col("value")
    offset = F.lit(0).cast("bigint")
    for k in drop:
        offset = offset * t.shape[k] + F.col(f"i{k}")
    dtype = t.dtype
    if op == "sum":
        agg = F.sum(v)
    elif op in ("mean", "var", "std"):
        dtype = "f64" if t.whole else t.dtype
        d = v.cast("double")
        agg = {"mean": F.avg, "var": F.var_pop, "std": F.stddev_pop}[op](d)
    elif op in ("min", "max"):
        agg = (F.min(v) if op == "min" else F.max(v)) if t.whole else _extreme(v, offset, -1 if op == "min" else 1)
    elif op in ("argmin", "argmax"):
        dtype = "i64"
        first_nan = F.isnan(F.min_by(v, offset)) if not t.whole else F.lit(False)
        ok = F.when(~F.isnan(v), v) if not t.whole else v
        key = F.struct((ok if op == "argmin" else -ok.cast("decimal(38,0)") if t.whole else -ok).alias("v"), offset.alias("o"))
        agg = F.when(first_nan, F.min(offset)).otherwise(F.min_by(offset, F.when(ok.isNotNull(), key)))
    else:
        raise invalid(f"unknown reduction {op}")
    out = t.cells.groupBy(*(f"i{k}" for k in kept)).agg(agg.cast(DTYPES[dtype]).alias("value"))
    if not kept:
        out = out.where("value is not null")
    cols = [F.lit(0) if k in drop else F.col(f"i{k}") for k in range(t.rank) if keepdims or k not in drop]
    shape = [1 if k in drop else t.shape[k] for k in range(t.rank) if keepdims or k not in drop]
    return t.indexed(cols, shape, dtype=dtype, source=out)


def cumulative(op: str, t: Tensor, axis: int | None = None) -> Tensor:
    """cumsum or cumprod along an axis; None runs over the flattened tensor. Integers are checked."""
    if axis is None:
        t, axis = flatten(t), 0
    k = t.axis(axis)
    others = [a for j, a in enumerate(t.axes) if j != k]
    w = Window.partitionBy(*others).orderBy(f"i{k}").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = F.col("value")
    if op == "cumsum":
        value = F.sum(v).over(w)
    elif op != "cumprod":
        raise invalid(f"unknown operation {op}")
    elif t.whole:
        value = F.aggregate(F.collect_list(v.cast("bigint")).over(w), F.lit(1).cast("bigint"), lambda a, x: a * x)
    else:
        value = F.product(v).over(w)
    return t.with_cells(t.cells.withColumn("value", value.cast(DTYPES[t.dtype])))


class TypedTensor:
    """A tensor of a declared dtype; operations go on to the functions of this module and check their operands' dtype."""

    ALLOWED = frozenset("contiguous reshape flatten expand_dims squeeze permute transpose swap_axes move_axis broadcast_to slice_axis axis_take axis_one concat stack split unstack repeat tile flip roll".split())

    def __init__(self, tensor: Tensor, dtype: str):
        if tensor.dtype != dtype:
            raise invalid(f"tensor has dtype {tensor.dtype}, not {dtype}")
        self.tensor, self.dtype = tensor, dtype

    def apply(self, name: str, *args) -> TypedTensor | list[TypedTensor]:
        if name in ("mean", "var", "std"):
            raise Unimplemented(f"{name} does not keep the dtype")
        if name in ("add", "sub", "mul", "div"):
            other = args[0]
            out = elementwise(name, self.tensor, other.tensor if isinstance(other, TypedTensor) else other) if not isinstance(other, int | float) else with_scalar(name, self.tensor, other)
        elif name in ("sum", "min", "max"):
            out = reduce_axes(name, self.tensor, *args)
        elif name in ("cumsum", "cumprod"):
            out = cumulative(name, self.tensor, *args)
        elif name in self.ALLOWED:
            out = globals()[name](self.tensor, *args)
        else:
            raise invalid(f"unknown operation {name}")
        return [TypedTensor(x, self.dtype) for x in out] if isinstance(out, list) else TypedTensor(out, self.dtype)
