"""Market-data pipelines: orders and trades to events, snapshots to ten levels, a loader, and size attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TableError
from ..functions import market as M
from ..functions.types import Column as Declared
from ..plans.predicates import Predicate
from .bundle import Bundle

ROW_LIMIT, GROUP_ROWS = 10_000, 65_536
EVENT_KEYS = ["day_key", "partition_key", "order_key", "tie_breaker"]
SNAPSHOT_KEYS = ["day_key", "symbol_code", "receive_nano", "tie_breaker"]
_KEY, _ENUM, _NANO = "opaque_key", "enum_code", "timestamp_nanos_like"
EVENT_COLUMNS = [
    Declared("day_key", "i32", _KEY), Declared("partition_key", "i64", _KEY), Declared("order_key", "i64", _KEY), Declared("tie_breaker", "i64", _KEY), Declared("event_kind_code", "i32", _ENUM),
    Declared("symbol_code", "i32", _KEY), Declared("venue_code", "i32", _ENUM), Declared("price_scaled", "i64", "scaled_integer", scale=-2), Declared("volume", "i64"), Declared("id_0", "i64"), Declared("id_1", "i64"),
    Declared("side_code", "i32", _ENUM), Declared("type_code", "i32", _ENUM), Declared("receive_nano", "i64", _NANO), Declared("exchange_time", "i64", _NANO),
]
LEVELS = range(1, 11)


def _event(df: DataFrame, time: str, kind: str, ids: tuple[str, str], kinds: dict, sides: dict, ordinal: Column) -> DataFrame:
    return df.select(
        M.day_key(F.col(time)).alias("day_key"),
        F.col("ChannelNo").cast("bigint").alias("partition_key"),
        F.col("BizIndex").cast("bigint").alias("order_key"),
        ordinal.cast("bigint").alias("tie_breaker"),
        M.coded(F.col(kind), kinds).alias("event_kind_code"),
        M.symbol_code(F.col("InstrumentCode")).alias("symbol_code"),
        M.coded(F.col("ExchangeID"), M.VENUES).alias("venue_code"),
        M.price_cents(F.col("Price")).alias("price_scaled"),
        M.volume(F.col("Volume")).alias("volume"),
        F.col(ids[0]).cast("bigint").alias("id_0"),
        F.col(ids[1]).cast("bigint").alias("id_1"),
        M.coded(F.col("BSFlag"), sides).alias("side_code"),
        F.col(kind).cast("int").alias("type_code"),
        F.col("nano").cast("bigint").alias("receive_nano"),
        F.col(time).cast("bigint").alias("exchange_time"),
    )


def order_trade_events(orders: DataFrame, trades: DataFrame, order_ordinal: Column, trade_ordinal: Column) -> DataFrame:
    """Orders and trades as one event table; ordinals number the source rows, trades after orders."""
    a = _event(orders, "OrderTime", "OrderType", ("OrderNo", "OrderIndex"), M.ORDER_KINDS, M.ORDER_SIDES, order_ordinal)
    b = _event(trades, "TradeTime", "TradeType", ("BidNo", "AskNo"), M.TRADE_KINDS, M.TRADE_SIDES, trade_ordinal)
    return a.unionByName(b)


def convert_order_trade(orders: DataFrame, trades: DataFrame, order_ordinal: Column, trade_ordinal: Column, group_rows: int = GROUP_ROWS) -> Bundle:
    return Bundle.build(order_trade_events(orders, trades, order_ordinal, trade_ordinal), EVENT_KEYS, group_rows, EVENT_COLUMNS)


def snapshots(df: DataFrame, ordinal: Column) -> DataFrame:
    """Ten levels of both sides with a prefix of twelve columns."""
    cols = [
        M.day_key(F.col("TradeTime")).alias("day_key"),
        M.symbol_code(F.col("InstrumentCode")).alias("symbol_code"),
        M.coded(F.col("ExchangeID"), M.VENUES).alias("venue_code"),
        F.col("nano").cast("bigint").alias("receive_nano"),
        F.col("TradeTime").cast("bigint").alias("trade_time"),
        ordinal.cast("bigint").alias("tie_breaker"),
        M.price_cents(F.col("LastPrice")).alias("last_price_scaled"),
        M.volume(F.col("TotalTradeNumber")).alias("total_trade_number"),
        M.volume(F.col("TotalTradeVolume")).alias("total_trade_volume"),
        M.price_cents(F.col("TotalTradeAmount")).alias("total_trade_amount_scaled"),
        M.price_cents(F.col("WeightedAvgAskPrice")).alias("weighted_avg_ask_price_scaled"),
        M.price_cents(F.col("WeightedAvgBidPrice")).alias("weighted_avg_bid_price_scaled"),
    ]
    for side in ("Ask", "Bid"):
        cols += [M.price_cents(F.col(f"{side}Price{k}")).alias(f"{side.lower()}_price_scaled_{k}") for k in LEVELS]
        cols += [M.volume(F.col(f"{side}Volume{k}")).alias(f"{side.lower()}_volume_{k}") for k in LEVELS]
        cols += [F.col(f"{side}Number{k}").cast("bigint").alias(f"{side.lower()}_number_{k}") for k in LEVELS]
    return df.select(*cols)


def convert_market_data(df: DataFrame, ordinal: Column, group_rows: int = GROUP_ROWS) -> Bundle:
    return Bundle.build(snapshots(df, ordinal), SNAPSHOT_KEYS, group_rows)


def load(bundle: Bundle, names: list[str] | None = None, day: int | None = None, channel: int | None = None, symbol: int | None = None, limit: int = ROW_LIMIT) -> DataFrame:
    """The first rows, in order, of the row groups that may hold a day, channel and symbol; rows are not filtered."""
    known = {c.name for c in bundle.columns}
    wanted = [("day_key", day), ("partition_key", channel), ("symbol_code", symbol)]
    predicates = [Predicate.equal(c, v) for c, v in wanted if v is not None and c in known]
    if any(v is not None and c not in known for c, v in wanted):
        raise TableError("invalid_input", "the table has no such key")
    return bundle.read(names, predicates).orderBy("base_row", "row_in_group").limit(limit)


#: Shares of the file from which a part is tackled first, in this order.
THRESHOLDS = (("payload_share", 0.60, "fixed_binary_byte_lane_transpose"), ("scalar_share", 0.20, "scalar_encoding"), ("overhead_share", 0.15, "row_group_size_matrix"))
ELSE = "zstd_row_group_matrix"


def size_attribution(chunks: DataFrame, file_bytes: Column, payload: str = "payload") -> DataFrame:
    """chunks (artifact, column_name, row_group_id, rows, compressed, uncompressed) to shares, ratio and what to try next, by artifact."""
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("compressed"))), F.lit(0))
    named = F.col("column_name") == payload
    t = chunks.withColumn("_file", file_bytes).groupBy("artifact").agg(
        part(named).alias("payload_bytes"), part(~named).alias("scalar_bytes"), F.sum("compressed").alias("chunk_bytes"), F.sum("uncompressed").alias("raw_bytes"), F.max("_file").alias("file_bytes"), F.max("rows").alias("rows")
    )
    share = lambda c: F.when(F.col("file_bytes") == 0, 0.0).otherwise(c / F.col("file_bytes"))
    t = t.select(
        "artifact", "payload_bytes", "scalar_bytes", "file_bytes",
        share(F.col("payload_bytes")).alias("payload_share"), share(F.col("scalar_bytes")).alias("scalar_share"), share(F.greatest(F.lit(0), F.col("file_bytes") - F.col("chunk_bytes"))).alias("overhead_share"),
        F.when(F.col("chunk_bytes") != 0, F.col("raw_bytes") / F.col("chunk_bytes")).alias("ratio"),
    )
    advice = F.lit(ELSE)
    for name, least, what in reversed(THRESHOLDS):
        advice = F.when(F.col(name) >= least, what).otherwise(advice)
    return t.withColumn("next_experiment", advice)


def column_sizes(chunks: DataFrame) -> DataFrame:
    """Bytes, bytes a row and compression ratio of each column."""
    g = chunks.groupBy("column_name").agg(F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed"), F.sum("rows").alias("rows"))
    return g.withColumn("bytes_per_row", F.when(F.col("rows") == 0, 0.0).otherwise(F.col("compressed") / F.col("rows"))).withColumn("ratio", F.when(F.col("compressed") != 0, F.col("uncompressed") / F.col("compressed")))
