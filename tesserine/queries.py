"""Queries over the driver's tables, one for each operator, and the SQL that must give the same rows.

Rules: every query reads whole tables. Order keys are total on the tables given. Floats that sums make are
rounded to six digits on both sides, as the order of addition differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import binary
from .functions import market as M
from .functions.types import columns_of
from .operators import apps, coords, layout, records, shape, sparse
from .operators import tensor as X
from .operators.bundle import Bundle
from .plans import predicates as P
from .scratch import scratch
from .sources import companions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- bundles ----------------------------------------------------------------------------------------------

GROUP = 1024
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
LINE_VALUES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def orders_bundle(spark: SparkSession, d: str, names=("o_orderkey", "o_custkey", "o_totalprice")) -> Bundle:
    return Bundle.build(table(spark, d, "orders").select(*names), ["o_orderkey"], GROUP)


def lines_bundle(spark: SparkSession, d: str) -> Bundle:
    df = table(spark, d, "lineitem").select(*LINE_VALUES, F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ship"))
    return Bundle.build(df, [*LINE_KEYS[:6], "ship"], 4096)


ORDERS = f"r as (select o_orderkey, o_custkey, o_totalprice, (row_number() over (order by o_orderkey)-1)//{GROUP} g, (row_number() over (order by o_orderkey)-1)%{GROUP} k from orders)"
ORDERS_STATS = f"{ORDERS}, s as (select g, min(o_orderkey) lo, max(o_orderkey) hi, min(o_custkey) clo, max(o_custkey) chi, min(o_totalprice) plo, max(o_totalprice) phi, count(*) n from r group by g)"
LINES = "l as (select *, epoch_us(l_shipdate) ship from lineitem), r as (select *, (row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, ship)-1) n from l), q as (select *, n//4096 g from r)"


def _pruned(spark, d, predicates):
    return orders_bundle(spark, d).read(["o_orderkey", "o_totalprice"], predicates).select("row_group_id", "o_orderkey", "o_totalprice")


@query(f"with {ORDERS_STATS} select g as row_group_id, o_orderkey, o_totalprice from r where g in (select g from s where hi>=3000 and lo<=3500)")
def bundle_prune_between(spark, d):
    return _pruned(spark, d, [P.Predicate.between("o_orderkey", 3000, 3500)])


@query(f"with {ORDERS_STATS} select g as row_group_id, o_orderkey, o_totalprice from r where g in (select g from s where hi>=777 and lo<=777)")
def bundle_prune_equal(spark, d):
    return _pruned(spark, d, [P.Predicate.equal("o_orderkey", 777)])


@query(f"with {ORDERS_STATS} select g as row_group_id, o_orderkey, o_totalprice from r where g in (select g from s where hi>=1000 and lo<=9000 and chi>=100 and clo<=120 and phi>=150000.0)")
def bundle_prune_conjunctive(spark, d):
    return _pruned(spark, d, [P.Predicate("o_orderkey", 1000, 9000), P.Predicate("o_custkey", 100, 120), P.Predicate("o_totalprice", 150000.0)])


@query(f"with {ORDERS_STATS} select g as row_group_id, o_orderkey from r where g in (select g from s where g % 2 = 1 or (hi>=3000 and lo<=3500))")
def bundle_prune_missing_stats(spark, d):
    b = orders_bundle(spark, d)
    odd = F.col("row_group_id") % 2 == 1
    b.stats = b.stats.withColumns({c: F.when(~odd, F.col(c)) for c in ("min_o_orderkey", "max_o_orderkey")})
    return b.read(["o_orderkey"], [P.Predicate.between("o_orderkey", 3000, 3500)]).select("row_group_id", "o_orderkey")


@query(f"with {LINES} select g as row_group_id, count(*) as n_rows, min(n) as base_row, min(l_orderkey) as min_orderkey, max(l_orderkey) as max_orderkey, min(l_extendedprice) as min_price, max(l_extendedprice) as max_price, 0 as null_orderkeys from q group by g")
def bundle_row_group_summaries(spark, d):
    s = lines_bundle(spark, d).stats
    return s.select("row_group_id", F.col("rows").alias("n_rows"), "base_row", F.col("min_l_orderkey").alias("min_orderkey"), F.col("max_l_orderkey").alias("max_orderkey"), F.col("min_l_extendedprice").alias("min_price"), F.col("max_l_extendedprice").alias("max_price"), F.col("null_count_l_orderkey").alias("null_orderkeys"))


@query(f"with {ORDERS_STATS}, x as (select g as row_group_id, n as n_rows, unnest([0,1,2]) as column_id, lo, hi, clo, chi from s) select row_group_id, n_rows, column_id, case column_id when 0 then lo when 1 then clo end as min_long, case column_id when 0 then hi when 1 then chi end as max_long from x")
def bundle_long_statistics(spark, d):
    s = orders_bundle(spark, d).row_group_summaries()
    return s.select("row_group_id", F.col("rows").alias("n_rows"), "column_id", "min_long", "max_long")


@query(f"with {ORDERS_STATS}, p as (select count(*) filter (where hi>=3000 and lo<=3500) c, count(*) t from s) select 4 as requested_read_threads, (case when c <= 1 then 1 else least(4, c) end) as effective_read_threads, c as selected_row_groups, t - c as pruned_row_groups, 2*c as selected_chunks, case when c <= 1 then 'too_few_row_groups' end as fallback_reason from p")
def bundle_read_report(spark, d):
    _, report = orders_bundle(spark, d).read_with_report(["o_orderkey", "o_totalprice"], [P.Predicate.between("o_orderkey", 3000, 3500)], P.ReadOptions(read_threads=4))
    return report


@query(f"with {LINES}, s as (select g, min(l_orderkey) lo, max(l_orderkey) hi, min(l_linenumber) mlo, max(l_linenumber) mhi from q group by g) select g as row_group_id, l_orderkey, l_linenumber, l_quantity from q where g in (select g from s where hi>=500 and lo<=900 and mhi>=2)")
def bundle_ordering_range(spark, d):
    b = lines_bundle(spark, d)
    p = P.ordering_key_predicates(b.columns, b.keys, {0: (500, 900), 1: (2, None)})
    return b.read(["l_orderkey", "l_linenumber", "l_quantity"], p).select("row_group_id", "l_orderkey", "l_linenumber", "l_quantity")


@query("select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem where l_quantity between 10.0 and 12.0 and l_orderkey <= 5000")
def bundle_exact_filter(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return P.exact_filter(df, [P.Predicate("l_quantity", 10.0, 12.0), P.Predicate("l_orderkey", None, 5000)])


@query(f"with {ORDERS} select g as plan_ordinal, g as row_group_id, o_orderkey from r where g in (0, 1)")
def bundle_subset_plan_order(spark, d):
    b = orders_bundle(spark, d)
    plan = b.plan(["o_orderkey"])
    return b.read_plan(plan, [plan.row_groups[1], plan.row_groups[0]]).select("plan_ordinal", "row_group_id", "o_orderkey")


@query(f"with {ORDERS} select g as row_group_id, g*{GROUP} as base_row, k as row_in_group, o_orderkey, o_custkey, o_totalprice from r where g = 1")
def bundle_read_row_group(spark, d):
    return orders_bundle(spark, d).read_row_group(1)


@query(f"with {ORDERS} select g as plan_ordinal, count(*) as n_rows, sum(o_custkey) as key_sum from r group by g")
def bundle_parallel_prepare(spark, d):
    b = orders_bundle(spark, d)
    plan = b.plan(["o_orderkey", "o_custkey"])

    def work(t):
        import pyarrow.compute as pc

        return f"{t.num_rows},{pc.sum(t['o_custkey']).as_py()}".encode()

    out = b.prepare(work, plan).withColumn("t", F.split(F.col("payload").cast("string"), ","))
    return out.select("plan_ordinal", F.col("t")[0].cast("bigint").alias("n_rows"), F.col("t")[1].cast("bigint").alias("key_sum"))


@query("with c as (select distinct event_type from events), k as (select event_type, row_number() over (order by event_type) - 1 as code from c) select event_id, code as event_code, event_type as event_code_label from events join k using (event_type)")
def bundle_dictionary_decode(spark, d):
    e = table(spark, d, "events")
    from pyspark.sql import Window

    kinds = e.select("event_type").distinct().withColumn("code", F.row_number().over(Window.orderBy("event_type")) - 1)
    rows = e.join(kinds, "event_type").select("event_id", F.col("code").alias("event_code").cast("int"))
    rows = rows.select("event_id", F.col("event_code").alias("event_code", metadata={"logical_kind": "dictionary_code", "dictionary_id": 0}))
    b = Bundle.build(rows, ["event_id"], 4096, dictionaries=kinds.select(F.lit(0).alias("dictionary_id"), "code", F.col("event_type").alias("value")))
    return b.decoded("event_code").select("event_id", "event_code", "event_code_label")


@query("select count(*) as n_rows, count(*) - count(nullif(l_linenumber, 1)) as nulls, min(nullif(l_linenumber, 1)) as least, max(nullif(l_linenumber, 1)) as most from lineitem")
def bundle_null_validity(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(1)).alias("line"), "l_extendedprice", "l_partkey")
    s = Bundle.build(df, ["l_orderkey", "l_partkey", "l_extendedprice"], 4096).stats
    return s.agg(F.sum("rows").alias("n_rows"), F.sum("null_count_line").alias("nulls"), F.min("min_line").alias("least"), F.max("max_line").alias("most"))


@query(f"with h as (select max(o_orderkey)//2 m from orders), a as (select o_orderkey, o_totalprice, (row_number() over (order by o_orderkey)-1)//{GROUP} g from orders where o_orderkey <= (select m from h)), z as (select o_orderkey, o_totalprice, (select max(g)+1 from a) + (row_number() over (order by o_orderkey)-1)//{GROUP} g from orders where o_orderkey > (select m from h)) select g as row_group_id, o_orderkey, o_totalprice from a union all select g, o_orderkey, o_totalprice from z")
def bundle_append_snapshot(spark, d):
    """Two commits of an ordered table; the appended groups follow those before."""
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    half = df.agg(F.expr("max(o_orderkey) div 2")).head()[0]
    first = layout.grouped(df.where(F.col("o_orderkey") <= half), ["o_orderkey"], GROUP)
    n = first.agg(F.count("*"), F.max("row_group_id")).head()
    second = layout.grouped(df.where(F.col("o_orderkey") > half), ["o_orderkey"], GROUP, n[0], n[1] + 1)
    return first.union(second).select("row_group_id", "o_orderkey", "o_totalprice")


@query("select 2 as generation, 1 as previous_generation, count(*) as n_rows from orders")
def table_create_append_open(spark, d):
    """A table written in two commits to the shared folder and opened again."""
    from .sources.catalog import TableFile

    path = scratch(spark, "table")
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    half = df.agg(F.expr("max(o_orderkey) div 2")).head()[0]
    t, _ = TableFile.create(spark, path, df.where(F.col("o_orderkey") <= half), columns_of(df.schema), ["o_orderkey"], group_rows=GROUP)
    t.append(df.where(F.col("o_orderkey") > half))
    t = TableFile.open(spark, path)
    return t.bundle().rows.agg(F.lit(t.commit["generation"]).alias("generation"), F.lit(t.commit["previous"]).alias("previous_generation"), F.count("*").alias("n_rows"))


# --- packed records ---------------------------------------------------------------------------------------

PACKED = [("l_orderkey", 0, "i64"), ("l_partkey", 8, "u32"), ("l_linenumber", 12, "u8"), ("negative", 13, "i32"), ("wide", 17, "u64"), ("small", 25, "i16")]


@query("select l_orderkey, l_partkey, l_linenumber::int as l_linenumber, (-l_suppkey)::int as negative, l_orderkey * 1000003 as wide, (l_linenumber - 4)::int as small from lineitem")
def record_fixed_binary_project(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (-F.col("l_suppkey")).alias("negative"), (F.col("l_orderkey") * 1000003).alias("wide"), (F.col("l_linenumber") - 4).alias("small"))
    packed = df.select(F.concat(*(binary.write_le(F.col(n), k) for n, _, k in PACKED)).alias("payload"))
    out = records.project(packed, records.Projection("payload", 27, tuple(records.Field(*p) for p in PACKED)))
    return out.withColumns({"wide": F.col("wide").cast("bigint"), "small": F.col("small").cast("int"), "l_linenumber": F.col("l_linenumber").cast("int")})


def _lanes(spark, d):
    o = table(spark, d, "orders")
    zero = lambda n: F.lit(bytearray(n))
    kind = (F.col("o_orderkey") % 2 + 1).cast("int")
    body = F.when(kind == 1, F.lit(bytearray(b"\x01\x02\x00\x04\x05\x06\x07"))).otherwise(F.lit(bytearray(b"\x01\x02\x03\x00\x05\x06\x00")))
    words = {w: F.when((kind == 1) & F.lit(w in (104, 112, 152)), F.lit(0)).otherwise(F.col("o_custkey") * w - 5000).cast("bigint") for w in records.WORDS}
    return o.select(
        F.lit(20260702).alias("day_key"), (F.col("o_custkey") % 8 + 1).cast("bigint").alias("channel_id"), (F.col("o_orderkey") + 1).alias("biz_index"), kind.alias("record_kind"),
        (F.col("o_orderkey") * 7).alias("receive_nano"), F.col("o_orderkey").alias("source_ordinal"), F.lit(bytearray(b"\x01\x02")).alias("payload_header_bytes_11_12"), (F.col("o_orderkey") * 11).alias("payload_exchange_time"),
        F.concat(F.lit(bytearray(b"000001")), zero(3)).alias("payload_symbol"), body.alias("payload_body_bytes_80_86"), *(c.alias(records.word_column(w)) for w, c in words.items()),
    )


@query("select (o_custkey % 8 + 1) as channel_id, o_orderkey + 1 as biz_index, (o_orderkey % 2 + 1)::int as record_kind, case when o_orderkey % 2 = 0 then 0 else o_custkey * 104 - 5000 end as word_104, o_custkey * 88 - 5000 as word_88, 168 as width, null as error_kind from orders")
def record_lanes_round_trip(spark, d):
    packed = records.to_records(_lanes(spark, d))
    head = records.header_error(F.col("payload"))
    out = records.to_lanes(packed.withColumn("width", F.length("payload")).withColumn("error_kind", head), keep=("width", "error_kind"))
    return out.select("channel_id", "biz_index", "record_kind", F.col("payload_body_word_104").alias("word_104"), F.col("payload_body_word_88").alias("word_88"), "width", "error_kind")


@query("select case o_orderkey % 7 when 0 then 'payload_header_mismatch' when 1 then 'unsupported_schema_version' when 2 then 'fixed_binary_width_mismatch' end as error_kind, count(*) as n from orders group by 1")
def record_header_errors(spark, d):
    cut = lambda a, n: F.substring(F.col("p"), a, n)
    packed = records.to_records(_lanes(spark, d), "p", ("biz_index",)).withColumn("m", F.col("biz_index") % 7)  # biz_index is the order key plus one
    bad = (
        F.when(F.col("m") == 1, F.concat(F.lit(bytearray(b"XXXX")), cut(5, 164)))
        .when(F.col("m") == 2, F.concat(cut(1, 4), F.lit(bytearray(b"\x09\x00")), cut(7, 162)))
        .when(F.col("m") == 3, cut(1, 160))
        .otherwise(F.col("p"))
    )
    return packed.select(records.header_error(bad).alias("error_kind")).groupBy("error_kind").agg(F.count("*").alias("n"))


CHANNEL = "c as (select o_custkey % 8 + 1 as channel_id, o_orderkey, row_number() over (partition by o_custkey % 8 order by o_orderkey) n from orders), b as (select channel_id, o_orderkey, case when n % 50 = 0 then n - 1 when n % 77 = 0 then n + 3 when n % 131 = 0 then n - 9 else n end as biz_index from c)"


def _channels(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("channel_id").orderBy("o_orderkey"))
    c = table(spark, d, "orders").select((F.col("o_custkey") % 8 + 1).alias("channel_id"), "o_orderkey").withColumn("n", n.cast("bigint"))
    index = F.when(F.col("n") % 50 == 0, F.col("n") - 1).when(F.col("n") % 77 == 0, F.col("n") + 3).when(F.col("n") % 131 == 0, F.col("n") - 9).otherwise(F.col("n"))
    return c.withColumn("biz_index", index)


@query(f"with {CHANNEL}, e as (select *, lag(biz_index) over (partition by channel_id order by o_orderkey) + 1 as expected from b) select channel_id, o_orderkey, biz_index, case when biz_index = expected - 1 then 'biz_index_duplicate' when biz_index < expected then 'biz_index_regression' when biz_index > expected then 'biz_index_gap' end as issue from e")
def record_continuity(spark, d):
    return records.continuity(_channels(spark, d), order=("o_orderkey",)).select("channel_id", "o_orderkey", "biz_index", "issue")


@query(f"with {CHANNEL} select channel_id, count(*) as row_count, arg_min(biz_index, o_orderkey) as first_biz_index, arg_max(biz_index, o_orderkey) as last_biz_index, min(o_orderkey*7) as min_receive_nano, max(o_orderkey*7) as max_receive_nano, count(*) filter (where o_orderkey%2=0) as order_records, count(*) filter (where o_orderkey%2=1) as trade_records from b group by 1")
def record_payload_aggregates(spark, d):
    rows = _channels(spark, d).withColumn("receive_nano", F.col("o_orderkey") * 7).withColumn("record_kind", F.col("o_orderkey") % 2 + 1)
    return records.payload_aggregates(rows, order="o_orderkey")


@query("with c as (select o_custkey % 8 + 1 as channel_id, count(*) as n, count(*) filter (where o_orderkey%2=0) as o, count(*) filter (where o_orderkey%2=1) as t from orders group by 1) select channel_id, n as row_count, o as order_records, t as trade_records, case when channel_id = 3 then 'row_count_mismatch' when channel_id = 5 then 'invalid_manifest' end as issue from c")
def manifest_certify(spark, d):
    """Channels against a manifest in which channel 3 has a wrong count of orders and channel 5 a wrong time."""
    from pyspark.sql import Window

    from .sources import manifest

    n = F.row_number().over(Window.partitionBy("channel_id").orderBy("o_orderkey")).cast("bigint")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 8 + 1).cast("int").alias("channel_id"), "o_orderkey")
    rows = rows.withColumns({"biz_index": n, "record_kind": F.col("o_orderkey") % 2 + 1, "receive_nano": F.col("o_orderkey") * 7, "day_key": F.lit(20260702)})
    got = records.payload_aggregates(rows, order="o_orderkey")
    wrong = got.withColumns({"order_records": F.col("order_records") + F.when(F.col("channel_id") == 3, 1).otherwise(0), "max_receive_nano": F.col("max_receive_nano") + F.when(F.col("channel_id") == 5, 1).otherwise(0)})
    entry = F.struct("channel_id", F.lit("x").alias("relative_path"), "row_count", "first_biz_index", "last_biz_index", "min_receive_nano", "max_receive_nano", "order_records", "trade_records")
    m = wrong.agg(F.array_sort(F.collect_list(entry)).alias("channels")).select(F.lit(1).alias("schema_version"), F.lit(20260702).alias("trading_day"), F.lit("full-day").alias("selection_scope"), "channels")
    return manifest.certify(m, rows.withColumnRenamed("o_orderkey", "row_number")).select("channel_id", "row_count", "order_records", "trade_records", "issue")


@query("with c as (select o_custkey % 8 + 1 as channel_id, count(*) as n, count(*) filter (where o_orderkey%2=0) as o from orders group by 1) select count(*)::int as channels, sum(n)::bigint as row_count, sum(o)::bigint as order_records, (sum(n) - sum(o))::bigint as trade_records from c")
def manifest_counts(spark, d):
    from .sources import manifest

    o = F.count_if(F.col("o_orderkey") % 2 == 0)
    c = table(spark, d, "orders").groupBy((F.col("o_custkey") % 8 + 1).cast("int").alias("channel_id")).agg(F.count("*").alias("row_count"), o.alias("order_records"))
    entry = F.struct("channel_id", "row_count", "order_records", (F.col("row_count") - F.col("order_records")).alias("trade_records"))
    m = c.agg(F.collect_list(entry).alias("channels")).select(F.lit(1).alias("schema_version"), F.lit(0).alias("trading_day"), F.lit("x").alias("artifact_format"), "channels")
    return manifest.summary(m).select("channels", "row_count", "order_records", "trade_records")


# --- tensors ----------------------------------------------------------------------------------------------

DIM = 64


def vectors(spark, d) -> X.Tensor:
    df = table(spark, d, "embeddings")
    n = df.agg(F.max("vec_id")).head()[0] + 1
    return X.from_array(df, F.col("vec_id"), F.col("embedding"), "f64", (n, DIM))


VEC = "e as (select vec_id as i0, unnest(range(len(embedding))) as i1, unnest(embedding)::double as value from embeddings)"


def cells(t: X.Tensor) -> DataFrame:
    return t.cells.select(*t.axes, "value")


EVENT_DAYS = "a as (select (datediff('day', (select min(ts)::date from events), ts::date)) as d, (select count(distinct y.event_type) from events y where y.event_type < x.event_type) as k, user_id as u, value as v from events x), s as (select d as i0, k as i1, u as i2, round(sum(v), 6) as value from a group by all), n as (select datediff('day', min(ts)::date, max(ts)::date) + 1 as days, count(distinct event_type) as kinds, max(user_id) + 1 as users from events)"


def event_tensor(spark, d) -> X.Tensor:
    """Day by event type by user, summed values; combinations without events are absent."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    r = e.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("z"), F.count_distinct("event_type").alias("k"), F.max("user_id").alias("u")).head()
    kinds = e.select("event_type").distinct().withColumn("k", F.row_number().over(Window.orderBy("event_type")) - 1)
    rows = e.join(kinds, "event_type")
    g = rows.groupBy(F.datediff(F.to_date("ts"), F.lit(r["a"])).alias("a"), "k", "user_id").agg(F.round(F.sum("value"), 6).alias("v"))
    return X.from_frame(g, ["a", "k", "user_id"], "v", "f64", ((r["z"] - r["a"]).days + 1, r["k"], r["u"] + 1))


@query(f"with {EVENT_DAYS}, g as (select unnest(range(days)) as i0, kinds, users from n), g1 as (select i0, unnest(range(kinds)) as i1, users from g), g2 as (select i0, i1, unnest(range(users)) as i2 from g1) select i0, i1, i2, coalesce(value, -1.0) as value, value is not null as valid from g2 left join s using (i0, i1, i2)")
def tensor_dense_fill(spark, d):
    return X.dense(event_tensor(spark, d), -1)


def tensor_query(sql_body: str, name: str, build) -> None:
    def run(spark, d):
        return cells(build(vectors(spark, d)))

    run.__name__ = name
    query(f"with {VEC} {sql_body}")(run)


tensor_query("select i0 - 100 as i0, i1, value from e where i0 >= 100 and i0 < 220", "tensor_axis_range", lambda t: X.axis_range(t, 0, 100, 220))
tensor_query("select i0, x.j as i1, value from e join (select unnest([5, 63, 5, 0]) as k, unnest([0, 1, 2, 3]) as j) x on e.i1 = x.k", "tensor_axis_take", lambda t: X.axis_take(t, 1, [5, 63, 5, 0]))
tensor_query("select 0 as i0, i1, value from e where i0 = 7", "tensor_axis_one", lambda t: X.axis_one(t, 0, 7))
tensor_query("select (i0 - 3)//5 as i0, (i1 - 1)//2 as i1, value from e where i0 >= 3 and i0 < 300 and (i0-3)%5 = 0 and (i1 - 1) % 2 = 0 and i1 >= 1", "tensor_read_index_step", lambda t: X.read_index(t, [slice(3, 300, 5), slice(1, None, 2)]))
tensor_query("select i0, value from e where i1 = 62", "tensor_read_index_negative", lambda t: X.read_index(t, [X.ELLIPSIS, -2]))
tensor_query("select 0 as i0, i0 as i1, i1 - 4 as i2, value from e where i1 >= 4", "tensor_read_index_newaxis", lambda t: X.read_index(t, [X.NEWAXIS, slice(None), slice(4, None)]))
tensor_query("select i0 - 10 as i0, 0 as i1, value from e where i0 >= 10 and i0 < 20 and i1 = 3", "tensor_selectors", lambda t: X.select(t, [(10, 20), [3]]))


@query(f"with {VEC} select value from e where i0 = 3 and i1 = 5")
def tensor_read_scalar(spark, d):
    return X.scalar(vectors(spark, d), (3, 5))


@query(f"with {VEC}, n as (select max(i0) + 1 as n from e), g as (select unnest(range(n)) as i0 from n), h as (select i0, unnest(range(70)) as i1 from g) select i0, i1, coalesce(value, 0.0) as value, value is not null as valid from h left join e using (i0, i1)")
def tensor_shape_explicit_extents(spark, d):
    t = vectors(spark, d)
    return shape.with_policy(t, spark.createDataFrame([], "i0 long, n1 long"), "explicit_extents", 0, (70,))


@query(f"with {VEC} select i0, i1, value, true as valid from e where i1 < 32")
def tensor_shape_cropped(spark, d):
    return shape.with_policy(vectors(spark, d), spark.createDataFrame([], "i0 long, n1 long"), "explicit_extents", 0, (32,))


def _shape_policy(policy: str, bound: str) -> None:
    def run(spark, d):
        """Slots of growing extents: slot i holds i % 4 + 61 columns."""
        t = vectors(spark, d)
        slots = table(spark, d, "embeddings").select(F.col("vec_id").alias("i0"), (F.col("vec_id") % 4 + 61).alias("n1"))
        held = t.with_cells(t.cells.where(F.col("i1") < F.col("i0") % 4 + 61))
        return shape.with_policy(held, slots, policy, -1)

    run.__name__ = f"tensor_shape_{policy}"
    query(f"with {VEC}, b as (select {bound} as m from (select distinct i0 from e)), g as (select distinct i0 from e), h as (select i0, unnest(range((select m from b)::bigint)) as i1 from g) select i0, i1, case when i1 < i0 % 4 + 61 then value else -1.0 end as value, i1 < i0 % 4 + 61 as valid from h left join e using (i0, i1)")(run)


_shape_policy("union", "max(i0 % 4 + 61)")
_shape_policy("file_envelope", "max(i0 % 4 + 61)")
_shape_policy("intersection", "min(i0 % 4 + 61)")
_shape_policy("current_head", "arg_max(i0 % 4 + 61, i0)")
_shape_policy("initial_registered", "arg_min(i0 % 4 + 61, i0)")


@query(f"with {VEC} select i0, case when i0 % 2 = 0 then i1 else 63 - i1 end as i1, value from e")
def tensor_universe_remap(spark, d):
    """Even slots are bound to version b, odd ones to version a, whose symbols stand in reverse."""
    t = vectors(spark, d)
    slots = table(spark, d, "embeddings").select(F.col("vec_id").alias("i0"), F.lit("f").alias("family"), F.when(F.col("vec_id") % 2 == 0, "b").otherwise("a").alias("version"))
    maps = spark.range(DIM).select(F.lit("f").alias("family"), F.lit("a").alias("from_version"), F.lit("b").alias("to_version"), F.col("id").alias("source"), (63 - F.col("id")).alias("target"))
    return cells(shape.remapped(t, slots, maps, "f", "b", DIM))


# --- history ----------------------------------------------------------------------------------------------

HISTORY = "p as (select month(ts) % 3 as part, user_id % 16 as u, value from events), t as (select part as i0, u as i1, round(sum(value), 4) as value from p group by all)"


def _store(spark, d):
    """A store with three appends: values by user modulo 16, of months in thirds."""
    from .sources.tensor_store import TensorStore

    store = TensorStore.create(spark, scratch(spark, "tensor"), "f64", (16,))
    e = table(spark, d, "events").groupBy((F.month("ts") % 3).alias("part"), (F.col("user_id") % 16).alias("u")).agg(F.round(F.sum("value"), 4).alias("v"))
    seqs = []
    for part in range(3):
        store.append(X.from_frame(e.where(F.col("part") == part).withColumn("z", F.lit(0)), ["z", "u"], "v", "f64", (1, 16)))
        seqs.append(store.head_commit())
    return store, seqs


@query(f"with {HISTORY} select * from t where i0 < 2")
def tensor_at_commit(spark, d):
    store, seqs = _store(spark, d)
    return cells(store.read_all(seqs[1]))


@query(f"with {HISTORY} select * from t where i0 < 1")
def tensor_pop(spark, d):
    store, _ = _store(spark, d)
    store.pop(2)
    return cells(store.read_all())


@query(f"with {HISTORY} select * from t where i0 < 2")
def tensor_revert(spark, d):
    store, seqs = _store(spark, d)
    store.pop(2)
    store.revert_commit(seqs[1])
    return cells(store.read_all())


@query(f"with {HISTORY} select i0, i1, case when i0 = 1 and i1 in (2, 5) then -1.0 * i1 else value end as value from t")
def tensor_rewrite(spark, d):
    store, _ = _store(spark, d)
    new = spark.createDataFrame([(0, 0, -2.0), (0, 1, -5.0)], "i0 long, i1 long, value double")
    store.rewrite_slice([[1], [2, 5]], X.Tensor(new, "f64", (1, 2)))
    return cells(store.read_all())


# --- coordinates ------------------------------------------------------------------------------------------

DAYS = "k as (select distinct strftime(ts, '%Y%m%d')::bigint as day from events), c as (select day, row_number() over (order by day) - 1 as pos from k)"
DAY_VALUES = f"{DAYS}, v as (select pos as i0, user_id % 4 as i1, round(sum(value), 6) as value from events join c on day = strftime(ts, '%Y%m%d')::bigint group by all)"


def _dated(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyyMMdd").cast("bigint"))
    days = e.select("day").distinct().withColumn("pos", F.row_number().over(Window.orderBy("day")).cast("bigint") - 1)
    g = e.join(days, "day").groupBy("pos", (F.col("user_id") % 4).alias("u")).agg(F.round(F.sum("value"), 6).alias("v"))
    t = X.from_frame(g, ["pos", "u"], "v", "f64", (days.count(), 4))
    c = days.select(F.lit(0).alias("axis"), "pos", F.col("day").alias("number"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("bigint").alias("code"), F.lit(1).cast("bigint").alias("commit"))
    return t, c, days.agg(F.min_by("day", F.abs(F.col("pos") - 3)), F.min_by("day", F.abs(F.col("pos") - 9))).head()


@query(f"with {DAY_VALUES} select 0 as i0, i1, value from v where i0 = 3")
def coord_exact(spark, d):
    t, c, (a, _) = _dated(spark, d)
    return cells(coords.at_coordinate(t, c, 0, a))


@query(f"with {DAY_VALUES} select i0 - 3 as i0, i1, value from v where i0 between 3 and 9")
def coord_range_inclusive(spark, d):
    t, c, (a, b) = _dated(spark, d)
    return cells(coords.in_coordinate_range(t, c, coords.Axis(0, "i64"), a, b))


@query(f"with {DAY_VALUES} select i0 - 3 as i0, i1, value from v where i0 >= 3 and i0 < 9")
def coord_range_half_open(spark, d):
    t, c, (a, b) = _dated(spark, d)
    spec = coords.Axis(0, "i64")
    return cells(coords.read(t, spec, coords.lookup_range(c, spec, a, b)))


@query(f"with {DAYS}, q as (select unnest([20260101, 19000101, 20990101]) as key union select day from c where pos < 5) select key, case when pos is null then 'missing' else 'unique' end as status, pos as start, pos + 1 as \"end\" from q left join c on day = key")
def coord_status(spark, d):
    _, c, _ = _dated(spark, d)
    keys = spark.createDataFrame([(20260101,), (19000101,), (20990101,)], "key long").union(c.where("pos < 5").select("number")).distinct()
    return coords.statuses(c, keys, 0, True)


@query(f"with {DAYS} select true as sorted, true as monotonic, true as \"unique\"")
def coord_declarations(spark, d):
    return coords.declarations(_dated(spark, d)[1], 0)


# --- sparse appends ---------------------------------------------------------------------------------------

SPARSE = "p as (select p_partkey, p_size from part), z as (select p_partkey % 8 as i0, (p_partkey // 8) % 32 as i1, p_size % 5 as i2, sum(case when p_size % 3 = 0 then p_size else 0 end)::bigint as value from p group by all)"
SPARSE_SUB = f"{SPARSE}, b as (select i0, i1, bool_and(value = 0) as absent from z group by all)"


def _sparse(spark, d) -> X.Tensor:
    p = table(spark, d, "part")
    g = p.groupBy((F.col("p_partkey") % 8).alias("a"), (F.expr("p_partkey div 8") % 32).alias("b"), (F.col("p_size") % 5).alias("c")).agg(F.sum(F.when(F.col("p_size") % 3 == 0, F.col("p_size")).otherwise(0)).alias("v"))
    return X.from_frame(g, ["a", "b", "c"], "v", "i64", (8, 32, 5))


@query(f"with {SPARSE_SUB}, c as (select count(*) filter (where absent) as absent_subtensors from b) select 256 as total_subtensors, absent_subtensors, absent_subtensors / 256.0::double as absent_fraction, case when absent_subtensors >= 1 then 'sparse_chunk_tree' else 'dense_fallback' end as outcome, case when absent_subtensors >= 1 then 'absent_subtensors_found' else 'below_threshold' end as reason from c")
def sparse_analysis(spark, d):
    return sparse.analyze(_sparse(spark, d), sparse.Rule((1,)))


@query(f"with {SPARSE_SUB} select i0, i1, i2, value from z anti join (select i0, i1 from b where absent) x using (i0, i1)")
def sparse_append_present(spark, d):
    return cells(sparse.present(_sparse(spark, d), sparse.Rule((1,))))


@query(f"with {SPARSE_SUB}, y as (select i0, i1, i2, value from z anti join (select i0, i1 from b where absent) x using (i0, i1)), g as (select unnest(range(8)) as i0), h as (select i0, unnest(range(32)) as i1 from g), k as (select i0, i1, unnest(range(5)) as i2 from h) select i0, i1, i2, coalesce(value, -9) as value, value is not null as valid from k left join y using (i0, i1, i2)")
def sparse_append_mask(spark, d):
    return X.dense(sparse.present(_sparse(spark, d), sparse.Rule((1,))), -9)


# --- tensor operations ------------------------------------------------------------------------------------

OP = [
    ("op_tensor_reshape", "select i0 * 4 + i1 // 16 as i0, i1 % 16 as i1, value from e", lambda t: X.reshape(t, (t.shape[0] * 4, 16))),
    ("op_tensor_flatten", "select i0 * 64 + i1 as i0, value from e", X.flatten),
    ("op_tensor_expand_dims", "select i0, 0 as i1, i1 as i2, value from e", lambda t: X.expand_dims(t, 1)),
    ("op_tensor_squeeze", "select i1 as i0, value from e where i0 = 2", lambda t: X.squeeze(X.axis_one(t, 0, 2))),
    ("op_tensor_transpose", "select i1 as i0, i0 as i1, value from e", X.transpose),
    ("op_tensor_swap_axes", "select i1 as i0, i0 as i1, value from e", lambda t: X.swap_axes(t, 0, -1)),
    ("op_tensor_move_axis", "select i1 % 8 as i0, i0 as i1, i1 // 8 as i2, value from e", lambda t: X.move_axis(X.reshape(t, (t.shape[0], 8, 8)), 2, 0)),
    ("op_tensor_broadcast_to", "select r as i0, i1, value from e cross join (select unnest(range(3)) as r) where i0 = 4", lambda t: X.broadcast_to(X.squeeze(X.axis_one(t, 0, 4), 0), (3, DIM))),
    ("op_tensor_slice_step", "select i0, (i1 - 2)//3 as i1, value from e where i1 >= 2 and i1 < 50 and (i1-2)%3 = 0", lambda t: X.slice_axis(t, 1, 2, 50, 3)),
    ("op_tensor_slice_step_negative", "select i0, (60 - i1)//7 as i1, value from e where i1 <= 60 and i1 > 10 and (60-i1)%7 = 0", lambda t: X.slice_axis(t, 1, 60, 10, -7)),
    ("op_tensor_take", "select i0, k.j as i1, value from e join (select unnest([3,3,60]) as c, unnest([0,1,2]) as j) k on i1 = c", lambda t: X.axis_take(t, 1, [3, 3, 60])),
    ("op_tensor_concat", "select i0, i1, value from e union all select i0, i1 + 64, value from e where i1 < 8", lambda t: X.concat([t, X.axis_range(t, 1, 0, 8)], 1)),
    ("op_tensor_stack", "select 0 as i0, i0 as i1, i1 as i2, value from e union all select 1, i0, 63 - i1, value from e", lambda t: X.stack([t, X.flip(t, 1)], 0)),
    ("op_tensor_split", "select i0, i1 - 10 as i1, value from e where i1 >= 10 and i1 < 40", lambda t: X.split(t, 1, [10, 30, 24])[1]),
    ("op_tensor_unstack", "select i0, value from e where i1 = 9", lambda t: X.unstack(t, 1)[9]),
    ("op_tensor_repeat", "select i0, i1 * 3 + r as i1, value from e cross join (select unnest(range(3)) as r)", lambda t: X.repeat(t, 1, 3)),
    ("op_tensor_tile", "select i0, i1 + 64 * r as i1, value from e cross join (select unnest(range(2)) as r)", lambda t: X.tile(t, 1, 2)),
    ("op_tensor_flip", "select i0, 63 - i1 as i1, value from e", lambda t: X.flip(t, 1)),
    ("op_tensor_roll", "select i0, (i1 + 64 - 5) % 64 as i1, value from e", lambda t: X.roll(t, 1, -5)),
    ("op_tensor_mul_scalar", "select i0, i1, value * 2.5 as value from e", lambda t: X.with_scalar("mul", t, 2.5)),
    ("op_tensor_add_scalar", "select i0, i1, value + 1.0 as value from e", lambda t: X.with_scalar("add", t, 1.0)),
    ("op_tensor_add_broadcast", "select e.i0, e.i1, e.value + f.value as value from e join e f on f.i0 = 0 and f.i1 = e.i1", lambda t: X.elementwise("add", t, X.squeeze(X.axis_one(t, 0, 0), 0))),
    ("op_tensor_sub_broadcast", "select e.i0, e.i1, e.value - f.value as value from e join e f on f.i1 = 0 and f.i0 = e.i0", lambda t: X.elementwise("sub", t, X.axis_one(t, 1, 0))),
    ("op_tensor_mul", "select i0, i1, value * value as value from e", lambda t: X.elementwise("mul", t, t)),
    ("op_tensor_div", "select e.i0, e.i1, e.value / f.value as value from e join e f on f.i0 = 1 and f.i1 = e.i1", lambda t: X.elementwise("div", t, X.squeeze(X.axis_one(t, 0, 1), 0))),
    ("op_tensor_min", "select i0, min(value) as value from e group by i0", lambda t: X.reduce_axes("min", t, [1])),
    ("op_tensor_max", "select i1 as i0, max(value) as value from e group by i1", lambda t: X.reduce_axes("max", t, [0])),
    ("op_tensor_argmin", "select i0, arg_min(i1, (value, i1)) as value from e group by i0", lambda t: X.reduce_axes("argmin", t, [1])),
    ("op_tensor_argmax", "select i0, arg_max(i1, (value, -i1)) as value from e group by i0", lambda t: X.reduce_axes("argmax", t, [1])),
    ("op_tensor_max_all", "select 0 as i0, 0 as i1, max(value) as value from e", lambda t: X.reduce_axes("max", t, None, True)),
]
for _name, _sql, _build in OP:
    tensor_query(_sql, _name, _build)


def rounded_query(name: str, body: str, build, digits: int = 6) -> None:
    def run(spark, d):
        t = build(vectors(spark, d))
        return cells(t).withColumn("value", F.round("value", digits))

    run.__name__ = name
    query(f"with {VEC} {body}")(run)


rounded_query("op_tensor_sum", "select i0, round(sum(value), 6) as value from e group by i0", lambda t: X.reduce_axes("sum", t, [1]))
rounded_query("op_tensor_sum_keepdims", "select 0 as i0, i1, round(sum(value), 6) as value from e group by i1", lambda t: X.reduce_axes("sum", t, [0], True))
rounded_query("op_tensor_mean", "select i0, round(avg(value), 6) as value from e group by i0", lambda t: X.reduce_axes("mean", t, [1]))
rounded_query("op_tensor_var", "select i0, round(var_pop(value), 6) as value from e group by i0", lambda t: X.reduce_axes("var", t, [1]))
rounded_query("op_tensor_std", "select i0, round(stddev_pop(value), 6) as value from e group by i0", lambda t: X.reduce_axes("std", t, [1]))
rounded_query("op_tensor_cumsum", "select i0, i1, round(sum(value) over (partition by i0 order by i1), 6) as value from e", lambda t: X.cumulative("cumsum", t, 1))


@query("with o as (select o_custkey % 50 as i0, month(o_orderdate) - 1 as i1, count(*) % 3 + 1 as value from orders group by all) select i0, i1, product(value) over (partition by i0 order by i1)::bigint as value from o")
def op_tensor_cumprod(spark, d):
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("a"), (F.month("o_orderdate") - 1).alias("m")).agg((F.count("*") % 3 + 1).alias("v"))
    return cells(X.cumulative("cumprod", X.from_frame(o, ["a", "m"], "v", "i64", (50, 12)), 1))


@query("with q as (select l_linenumber as i1, l_orderkey as i0, sum(l_quantity)::bigint as value from lineitem group by all) select i0, sum(value)::bigint as value from q group by i0")
def op_tensor_sum_quantity(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("bigint").alias("v"))
    n = table(spark, d, "lineitem").agg(F.max("l_orderkey"), F.max("l_linenumber")).head()
    return cells(X.reduce_axes("sum", X.from_frame(q, ["l_orderkey", "l_linenumber"], "v", "i64", (n[0] + 1, n[1] + 1)), [1]))


# --- companions -------------------------------------------------------------------------------------------


@query(f"with {VEC}, n as (select max(i0) + 1 as n from e) select 'metadata' as record, 'i32' as dtype, n || 'x64' as shape, 'row_major' as \"order\", null::bigint as flat_index, null as value from n union all select 'value', null, null, null, i0 * 64 + i1, floor(value * 100)::int::varchar from e")
def csv_companion_layout(spark, d):
    t = vectors(spark, d)
    return companions.csv_rows(X.Tensor(t.cells.withColumn("value", F.floor(F.col("value") * 100).cast("int")), "i32", t.shape))


@query(f"with {VEC} select i0 * 64 + i1 as flat_index, value from e")
def parquet_companion_layout(spark, d):
    return companions.flat_rows(vectors(spark, d))


@query(f"with {VEC} select i0 as time_id, list(value order by i1)[64] as last_value, count(*) as width from e group by i0")
def arrow_companion_slices(spark, d):
    return companions.slices(vectors(spark, d)).select("time_id", F.element_at("values", -1).alias("last_value"), F.size("values").cast("bigint").alias("width"))


# --- market data ------------------------------------------------------------------------------------------

SYMBOL = "lpad((p_partkey % 1000000)::varchar, 6, '0') || case p_partkey % 4 when 0 then '.SH' when 1 then '.XSHE' when 2 then '.SZ' else '.BJ' end"


@query(f"with s as (select p_partkey, {SYMBOL} as symbol from part) select p_partkey, ((case when symbol like '%.SH' or symbol like '%.XSHG' then 1 when symbol like '%.SZ' or symbol like '%.XSHE' then 2 else 9 end) * 1000000 + symbol[1:6]::int)::int as symbol_code from s")
def etl_symbol_code(spark, d):
    end = F.when(F.col("p_partkey") % 4 == 0, ".SH").when(F.col("p_partkey") % 4 == 1, ".XSHE").when(F.col("p_partkey") % 4 == 2, ".SZ").otherwise(".BJ")
    s = table(spark, d, "part").withColumn("symbol", F.concat(F.lpad((F.col("p_partkey") % 1000000).cast("string"), 6, "0"), end))
    return s.select("p_partkey", M.symbol_code(F.col("symbol")).alias("symbol_code"))


@query("select o_orderkey, (strftime(o_orderdate, '%Y%m%d'))::int as day_key from orders")
def etl_day_key(spark, d):
    raw = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((F.col("o_orderkey") % 1000000000).cast("string"), 9, "0")).cast("bigint")
    return table(spark, d, "orders").select("o_orderkey", M.day_key(raw).alias("day_key"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 0 else (round(o_totalprice * 100))::bigint end as price_scaled, case when o_orderkey % 7 = 0 then 0 else round(o_totalprice)::bigint end as volume from orders")
def etl_price_cents(spark, d):
    o = table(spark, d, "orders")
    price = F.when(F.col("o_orderkey") % 5 == 0, float("nan")).otherwise(F.col("o_totalprice"))
    size = F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return o.select("o_orderkey", M.price_cents(price).alias("price_scaled"), M.volume(size).alias("volume"))


@query("select event_id, case event_id % 6 when 0 then 2 when 1 then 4 when 2 then 1 when 3 then 1 when 4 then 1 else 0 end as order_kind, case event_id % 3 when 0 then 2 when 1 then 3 else 0 end as trade_kind, case event_id % 3 when 0 then 1 when 1 then 2 else 0 end as side, case event_id % 4 when 1 then 1 when 2 then 2 else 0 end as venue from events")
def etl_event_kind(spark, d):
    def pick(chars: str):
        out = F.lit(0)
        for i, c in enumerate(chars):
            out = F.when(F.col("event_id") % len(chars) == i, ord(c)).otherwise(out)
        return out

    return table(spark, d, "events").select(
        "event_id",
        M.coded(pick("DS1A3X"), M.ORDER_KINDS).alias("order_kind"),
        M.coded(pick("12Z"), M.TRADE_KINDS).alias("trade_kind"),
        M.coded(pick("01Q"), M.ORDER_SIDES).alias("side"),
        M.coded(F.col("event_id") % 4, M.VENUES).alias("venue"),
    )


def _raw_orders(spark, d):
    o = table(spark, d, "orders")
    symbol = F.concat(F.lpad((F.col("o_custkey") % 1000000).cast("string"), 6, "0"), F.lit(".SZ"))
    time = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("093000000")).cast("bigint")
    return o.select(
        "o_orderkey", time.alias("t"), (F.col("o_custkey") % 8 + 1).alias("ChannelNo"), F.col("o_orderkey").alias("BizIndex"), symbol.alias("InstrumentCode"), (F.col("o_custkey") % 3).alias("ExchangeID"),
        F.col("o_totalprice").alias("Price"), F.lit(100.0).alias("Volume"), F.lit(ord("1")).alias("BSFlag"), (F.col("o_orderkey") * 3).alias("nano"),
    )


EVENTS_SQL = "x as (select strftime(o_orderdate, '%Y%m%d')::int as day_key, o_custkey % 8 + 1 as partition_key, o_orderkey as order_key, o_orderkey as tie_breaker, case when o_orderkey % 2 = 0 then 1 else 3 end as event_kind_code, (2000000 + o_custkey % 1000000)::int as symbol_code, case o_custkey % 3 when 1 then 1 when 2 then 2 else 0 end as venue_code, round(o_totalprice * 100)::bigint as price_scaled, case when o_orderkey % 2 = 0 then 2 else 1 end as side_code from orders), r as (select *, row_number() over (order by day_key, partition_key, order_key, tie_breaker) - 1 as n from x)"


def _events_bundle(spark, d):
    raw = _raw_orders(spark, d)
    orders = raw.where("o_orderkey % 2 = 0").withColumnRenamed("t", "OrderTime").withColumns({"OrderType": F.lit(ord("A")), "OrderNo": F.col("BizIndex"), "OrderIndex": F.lit(0)})
    trades = raw.where("o_orderkey % 2 = 1").withColumnRenamed("t", "TradeTime").withColumns({"TradeType": F.lit(ord("2")), "BidNo": F.col("BizIndex"), "AskNo": F.lit(0)})
    return apps.convert_order_trade(orders, trades, F.col("o_orderkey"), F.col("o_orderkey"), 2048)


@query(f"with {EVENTS_SQL} select n//2048 as row_group_id, n%2048 as row_in_group, day_key, partition_key, order_key, event_kind_code, symbol_code, venue_code, price_scaled, side_code from r")
def etl_union_sorted(spark, d):
    return _events_bundle(spark, d).rows.select("row_group_id", "row_in_group", "day_key", "partition_key", "order_key", "event_kind_code", "symbol_code", "venue_code", "price_scaled", "side_code")


@query(f"with {EVENTS_SQL}, g as (select *, n//2048 as g from r), s as (select g, min(partition_key) lo, max(partition_key) hi, min(symbol_code) slo, max(symbol_code) shi from g group by g) select day_key, partition_key, order_key, price_scaled from g where g in (select g from s where lo <= 3 and hi >= 3 and slo <= 2000042 and shi >= 2000042) order by n limit 500")
def etl_load(spark, d):
    return apps.load(_events_bundle(spark, d), ["day_key", "partition_key", "order_key", "price_scaled"], channel=3, symbol=2000042, limit=500).drop("row_group_id", "base_row", "row_in_group")


@query("select o_orderkey as tie_breaker, strftime(o_orderdate, '%Y%m%d')::int as day_key, (2000000 + o_custkey % 1000000)::int as symbol_code, round((o_totalprice + 3) * 100)::bigint as ask_price_scaled_3, 100 as bid_volume_10, 7 as ask_number_1 from orders")
def etl_snapshots(spark, d):
    raw = _raw_orders(spark, d).withColumnRenamed("t", "TradeTime")
    extra = {n: F.col("Price") for n in ("LastPrice", "TotalTradeAmount", "WeightedAvgAskPrice", "WeightedAvgBidPrice")} | {n: F.lit(1.0) for n in ("TotalTradeNumber", "TotalTradeVolume")}
    for side in ("Ask", "Bid"):
        for k in apps.LEVELS:
            extra |= {f"{side}Price{k}": F.col("Price") + k, f"{side}Volume{k}": F.lit(10.0 * k), f"{side}Number{k}": F.lit(7)}
    s = apps.snapshots(raw.withColumns(extra), F.col("o_orderkey"))
    return s.select("tie_breaker", "day_key", "symbol_code", "ask_price_scaled_3", F.col("bid_volume_10").cast("bigint").alias("bid_volume_10"), "ask_number_1")


@query("with c as (select 'a' || (o_custkey % 4) as artifact, case when o_orderkey % 3 = 0 then 'payload' else 'c' || (o_orderkey % 3) end as column_name, o_orderkey % 100 + (case when o_orderkey % 3 = 0 then o_custkey % 4 * 30 else 0 end) as compressed, 500 as uncompressed from orders), t as (select artifact, sum(compressed) filter (where column_name = 'payload') as p, sum(compressed) filter (where column_name <> 'payload') as s, sum(compressed) as k, sum(uncompressed) as u from c group by 1), f as (select *, 1000000 as file from t) select artifact, p::bigint as payload_bytes, s::bigint as scalar_bytes, round(p / file, 6) as payload_share, round(u / k, 6) as ratio, case when p / file >= 0.6 then 'fixed_binary_byte_lane_transpose' when s / file >= 0.2 then 'scalar_encoding' when greatest(0, file - k) / file >= 0.15 then 'row_group_size_matrix' else 'zstd_row_group_matrix' end as next_experiment from f")
def size_attribution(spark, d):
    o, third = table(spark, d, "orders"), F.col("o_orderkey") % 3
    extra = F.when(third == 0, F.col("o_custkey") % 4 * 30).otherwise(0)
    chunks = o.select(
        F.concat(F.lit("a"), (F.col("o_custkey") % 4).cast("string")).alias("artifact"), F.when(third == 0, "payload").otherwise(F.concat(F.lit("c"), third.cast("string"))).alias("column_name"),
        F.lit(0).alias("row_group_id"), F.lit(1).alias("rows"), (F.col("o_orderkey") % 100 + extra).alias("compressed"), F.lit(500).alias("uncompressed"),
    )
    out = apps.size_attribution(chunks, F.lit(1000000))
    return out.select("artifact", "payload_bytes", "scalar_bytes", F.round("payload_share", 6).alias("payload_share"), F.round("ratio", 6).alias("ratio"), "next_experiment")

# Types that the SQL's own arithmetic would give otherwise.
_INT = {"row_group_id": "int"}
_TYPES: dict[str, dict[str, str]] = {
    **dict.fromkeys("bundle_append_snapshot bundle_long_statistics bundle_ordering_range bundle_prune_between bundle_prune_conjunctive bundle_prune_equal bundle_prune_missing_stats bundle_read_row_group etl_union_sorted".split(), _INT),
    "bundle_dictionary_decode": {"event_code": "int"},
    "bundle_read_report": dict.fromkeys(("effective_read_threads", "pruned_row_groups", "selected_chunks", "selected_row_groups"), "int"),
    "bundle_row_group_summaries": {"row_group_id": "int", "null_orderkeys": "bigint"},
    "bundle_subset_plan_order": {"plan_ordinal": "int", "row_group_id": "int"},
    "bundle_parallel_prepare": {"plan_ordinal": "int", "key_sum": "bigint"},
    "etl_snapshots": {"ask_number_1": "bigint", "bid_volume_10": "bigint"},
    "manifest_certify": {"channel_id": "int"},
    "record_lanes_round_trip": {"error_kind": "varchar"},
    "sparse_append_present": {"i2": "bigint"},
    "op_tensor_expand_dims": {"i1": "bigint"},
    "op_tensor_max_all": {"i0": "bigint", "i1": "bigint"},
    **dict.fromkeys(("op_tensor_stack", "op_tensor_sum_keepdims", "coord_exact", "tensor_axis_one", "tensor_read_index_newaxis"), {"i0": "bigint"}),
    **dict.fromkeys(("op_tensor_take", "tensor_axis_take", "tensor_selectors"), {"i1": "bigint"}),
}
for _name, _casts in _TYPES.items():
    _columns = ", ".join(f"{c}::{t} as {c}" for c, t in _casts.items())
    ORACLE_SQL[_name] = f"select * replace ({_columns}) from ({ORACLE_SQL[_name]}) as _typed"

# Queries of stored tables and tensors register themselves beside these.
from . import store_queries  # noqa: E402, F401
