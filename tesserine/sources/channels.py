"""Reads of tables that are sharded by channel: one scan over all artifacts, with a report and checks by channel."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TableError
from ..operators import records
from ..operators.bundle import Bundle
from ..plans.predicates import ReadPlan
from .catalog import TableFile

WORKERS = 8


def read_channels(spark: SparkSession, inputs: list[tuple[int, str, int | None]], names: list[str] | None = None) -> DataFrame:
    """Rows of all channels (channel, path, expected rows or None), with source_channel; artifacts are listed in the driver, read by tasks."""
    if len({c for c, _, _ in inputs}) != len(inputs):
        raise TableError("invalid_manifest", "a channel is listed twice")
    parts = []
    for channel, path, _ in inputs:
        try:
            b = TableFile.open(spark, path).bundle()
        except TableError as e:
            raise TableError("missing_artifact", f"channel {channel}: {e}") from e
        parts.append(b.read(names).withColumn("source_channel", F.lit(channel)))
    return reduce(DataFrame.unionByName, parts)


def channel_report(spark: SparkSession, rows: DataFrame, inputs: list[tuple[int, str, int | None]]) -> DataFrame:
    """By channel, in order: rows, row groups, and the issue if rows differ from the expected number or carry another channel."""
    want = spark.createDataFrame([(c, n) for c, _, n in inputs], "source_channel int, expected_rows long")
    wrong = F.count_if(F.col("channel_id") != F.col("source_channel")) if "channel_id" in rows.columns else F.lit(0)
    got = rows.groupBy("source_channel").agg(F.count("*").alias("rows"), F.count_distinct("row_group_id").alias("row_groups"), wrong.alias("wrong"))
    issue = F.when(F.col("wrong") > 0, "channel_id_mismatch").when(F.col("expected_rows") != F.coalesce("rows", F.lit(0)), "row_count_mismatch")
    return want.join(got, "source_channel", "left").select("source_channel", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("row_groups", F.lit(0)).alias("row_groups"), issue.alias("issue")).orderBy("source_channel")


def certify_lanes(rows: DataFrame, order: tuple[str, ...] = ("base_row", "row_in_group")) -> DataFrame:
    """By channel: counts, ends, times, the first break in continuity, and whether every rebuilt record has a sound header."""
    built = records.to_records(rows.withColumn("place", F.struct(*order)), keep=("place", "channel_id", "biz_index", "record_kind"))
    seen = records.continuity(built.withColumn("bad", records.header_error(F.col("payload"))).drop("payload"), order=("place",))
    return seen.groupBy("channel_id").agg(
        F.count("*").alias("row_count"),
        F.min_by("biz_index", "place").alias("first_biz_index"),
        F.max_by("biz_index", "place").alias("last_biz_index"),
        F.count_if(F.col("record_kind") == records.ORDER).alias("order_records"),
        F.count_if(F.col("record_kind") == records.TRADE).alias("trade_records"),
        F.coalesce(F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("place"))), F.min_by("issue", F.when(F.col("issue").isNotNull(), F.col("place")))).alias("issue"),
    )


def certify_summaries(bundle: Bundle) -> DataFrame:
    """By row group: rows by its statistics and the first issue of these, null if all is well.

    Columns other than the twenty lanes: invalid_manifest; rows other than the data's: row_count_mismatch; nulls:
    payload_header_mismatch; a lane of another type or width: fixed_binary_width_mismatch.
    """
    want = {c.name: (c.physical, c.width) for c in records.lane_columns()}
    own = {c.name: (c.physical, c.width) for c in bundle.columns}
    foreign, mistyped = own.keys() != want.keys(), own != want
    nulls = reduce(lambda a, b: a | b, (F.col(f"null_count_{c}") > 0 for c in own))
    held = bundle.rows.groupBy("row_group_id").agg(F.count("*").alias("held"))
    issue = (
        F.when(F.lit(foreign), "invalid_manifest")
        .when(~F.col("held").eqNullSafe(F.col("rows")), "row_count_mismatch")
        .when(nulls, "payload_header_mismatch")
        .when(F.lit(mistyped), "fixed_binary_width_mismatch")
    )
    return bundle.stats.join(held, "row_group_id", "left").select("row_group_id", "rows", issue.alias("issue"))


def channel_plan(bundle: Bundle, channel: int, expected_rows: int | None = None, row_groups: list[int] | None = None) -> ReadPlan:
    """A plan of all lanes; rows are held against the expected number where the whole channel is read."""
    if not -(1 << 31) <= channel < 1 << 31:
        raise TableError("invalid_input", f"channel {channel} does not fit 32 bits")
    if row_groups is None and expected_rows is not None and bundle.row_count() != expected_rows:
        raise TableError("row_count_mismatch", f"channel {channel}: expected {expected_rows} rows")
    records.check_lanes(bundle.rows.select(*(c.name for c in bundle.columns)))
    return bundle.plan([x[0] for x in records.LANES])


def checked_channel(function: Callable[[pa.Table], bytes], channel: int) -> Callable[[pa.Table], bytes]:
    """The function, for row groups of which every row is the channel's."""

    def run(table: pa.Table) -> bytes:
        if not pc.all(pc.equal(table["channel_id"], channel)).as_py():
            raise TableError("channel_id_mismatch", f"expected channel {channel}")
        return function(table)

    return run


def prepare_channel(bundle: Bundle, channel: int, function: Callable[[pa.Table], bytes], expected_rows: int | None = None, row_groups: list[int] | None = None) -> DataFrame:
    """Bundle.prepare over the lanes of one channel; a row group with a row of another channel has an error in place of its payload."""
    return bundle.prepare(checked_channel(function, channel), channel_plan(bundle, channel, expected_rows, row_groups), row_groups)


def prepare_channel_and_commit(bundle: Bundle, channel: int, function: Callable[[pa.Table], bytes], commit: Callable[[int, bytes], bool | None], expected_rows: int | None = None, row_groups: list[int] | None = None) -> bool:
    """Bundle.prepare_and_commit over the lanes of one channel."""
    return bundle.prepare_and_commit(checked_channel(function, channel), commit, channel_plan(bundle, channel, expected_rows, row_groups), row_groups)
