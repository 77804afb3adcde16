"""Row groups of an ordered table, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..errors import TableError
from ..functions.types import Column, columns_of

GROUP_ROWS = 65_536


def range_bounds(df: DataFrame, keys: list[str], parts: int) -> list[tuple]:
    """At most parts - 1 ascending key tuples that cut the rows into about equal ranges, from a bounded sample of 64 tuples a range.

    Bounds are of all keys, so rows that agree in the first ones, as a day's do, are cut as well.
    """
    if parts < 2:
        return []
    key = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    sample = df.select(key.alias("key")).orderBy(F.xxhash64("key"), "key").limit(64 * parts).collect()
    place = lambda v: (v is not None, v != v, 0 if v is None or v != v else v)  # noqa: E731  nulls first, NaN last, as Spark orders them
    values = sorted((tuple(r["key"]) for r in sample), key=lambda key: tuple(map(place, key)))
    return list(dict.fromkeys(values[len(values) * i // parts] for i in range(1, parts))) if values else []


def with_row_number(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """df with row_number, its place from 0 in the total order of keys.

    Rows are dealt to ranges of the whole key; each range numbers its own rows and starts after the rows of the
    ranges before it, so no task sees all rows. The keys must order the rows totally for the numbers to be unique.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(df, keys, parts)
    part = F.lit(0)
    if bounds:
        first, kind = F.col(keys[0]), df.schema[keys[0]].dataType
        as_key = lambda values: F.struct(*(v.alias(f"k{i}") for i, v in enumerate(values)))
        typed = lambda b: [F.lit(v).cast(df.schema[k].dataType) for v, k in zip(b, keys, strict=True)]
        heads = F.array(*(F.lit(b[0]).cast(kind) for b in bounds if b[0] is not None)).cast(ArrayType(kind))
        missing = sum(b[0] is None for b in bounds)  # nulls come first, in structs as in the order below
        below = F.when(first.isNull(), 0).otherwise(F.array_size(F.filter(heads, lambda b: b < first)) + missing)
        # Only rows that agree with a bound in the first key are held against whole bounds.
        own, shared = as_key([F.col(k) for k in keys]), first.isNull() if missing else F.lit(False)
        cuts = F.array(*(as_key(typed(b)) for b in bounds))
        level = F.array_size(F.filter(cuts, lambda b: b["k0"].eqNullSafe(first) & (b < own)))
        part = below + F.when(shared | F.coalesce(F.array_contains(heads, first), F.lit(False)), level).otherwise(0)
    dealt = df.withColumn("_part", part)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).drop("_n")  # one row for each of at most `parts` ranges
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*(F.col(k).asc_nulls_first() for k in keys)))
    numbered = dealt.withColumn("_own", own).join(F.broadcast(offsets), "_part")
    return numbered.withColumn("row_number", F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")


def grouped(df: DataFrame, keys: list[str], group_rows: int = GROUP_ROWS, first_row: int = 0, first_group: int = 0) -> DataFrame:
    """df with row_group_id, base_row and row_in_group in front."""
    n = with_row_number(df, keys)
    group = F.expr(f"row_number div {group_rows}")
    return n.select(
        (group + first_group).cast("int").alias("row_group_id"),
        (group * group_rows + first_row).alias("base_row"),
        (F.col("row_number") % group_rows).alias("row_in_group"),
        *df.columns,
    )


def statistics(df: DataFrame, columns: list[Column] | None = None) -> DataFrame:
    """Wide statistics: a row for each row group with rows, and null_count, min and max of each scalar column."""
    own = ("row_group_id", "base_row", "row_in_group")
    columns = columns or columns_of(df.drop(*own).schema)
    aggs = [F.count("*").alias("rows"), F.min("base_row").alias("base_row")]
    for c in columns:
        aggs.append(F.count_if(F.col(c.name).isNull()).alias(f"null_count_{c.name}"))
        if c.scalar:
            aggs += [F.min(c.name).alias(f"min_{c.name}"), F.max(c.name).alias(f"max_{c.name}")]
    return df.groupBy("row_group_id").agg(*aggs)


def long_statistics(wide: DataFrame, columns: list[Column]) -> DataFrame:
    """Statistics as one row for each row group and column; bounds as doubles and, for integers, as longs."""
    rows = []
    for i, c in enumerate(columns):
        number = c.physical in ("i32", "i64")
        lo, hi = (F.col(f"{k}_{c.name}") if c.scalar else F.lit(None) for k in ("min", "max"))
        rows.append(
            F.struct(
                F.lit(i).alias("column_id"),
                F.lit(c.name).alias("column_name"),
                F.col(f"null_count_{c.name}").alias("null_count"),
                (lo if number else F.lit(None)).cast("bigint").alias("min_long"),
                (hi if number else F.lit(None)).cast("bigint").alias("max_long"),
                lo.cast("double").alias("min_double"),
                hi.cast("double").alias("max_double"),
            )
        )
    return wide.select("row_group_id", "rows", F.explode(F.array(*rows)).alias("s")).select("row_group_id", "rows", "s.*")


def check_order(df: DataFrame, keys: list[str]) -> None:
    """Raise unless rows ascend by keys in order of base_row and row_in_group; neighbours across groups are compared by group ends."""
    key = F.struct(*keys)
    within = F.lag(key).over(Window.partitionBy("row_group_id").orderBy("row_in_group"))
    bad = df.select(key.alias("k"), within.alias("p")).where("k < p").isEmpty()
    ends = df.groupBy("row_group_id").agg(F.min_by(key, "row_in_group").alias("first"), F.max_by(key, "row_in_group").alias("last"))
    before = F.lag("last").over(Window.orderBy("row_group_id"))
    if not bad or not ends.select("first", before.alias("p")).where("first < p").isEmpty():
        raise TableError("invalid_input", "rows do not follow the declared order")
