"""Queries over stored tables and tensors: commits, history, coordinates, maintenance; see `queries` for the rules.

The tensors are of events: parts are days of the month modulo three, so that every append has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import binary
from .functions.types import Column, columns_of
from .operators import coords, records
from .operators import tensor as X
from .operators.bundle import Bundle
from .plans import predicates as P
from .queries import GROUP, ORDERS, ORDERS_STATS, _lanes, cells, orders_bundle, query, scratch, table
from .sources import channels
from .sources.catalog import TableFile, files_manifest, validate_files
from .sources.tensor_store import TensorStore

# --- tensors --------------------------------------------------------------------------------------------------

PARTS = "p as (select day(ts) % 3 as part, user_id % 16 as u, value from events), t as (select part as i0, u as i1, round(sum(value), 4) as value from p group by all)"
COMMITS = 3


def _slices(spark, d, dtype: str = "f64") -> list[X.Tensor]:
    e = table(spark, d, "events").groupBy((F.dayofmonth("ts") % 3).alias("part"), (F.col("user_id") % 16).alias("u")).agg(F.round(F.sum("value"), 4).alias("v"))
    return [X.from_frame(e.where(F.col("part") == part).withColumn("z", F.lit(0)), ["z", "u"], "v", dtype, (1, 16)) for part in range(COMMITS)]


def stored(spark, d, **options) -> tuple[TensorStore, list[int], list[tuple[int, int]]]:
    """A store with three appends, their commits and their ranges."""
    store = TensorStore.create(spark, scratch(spark, "tensor"), "f64", (16,), **options)
    seqs, ranges = [], []
    for t in _slices(spark, d):
        ranges.append(store.append(t))
        seqs.append(store.head_commit())
    return store, seqs, ranges


def one_row(spark, **values) -> DataFrame:
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in values.items()))


@query(f"with {PARTS} select * from t where i0 < 2")
def history_read_at_commit(spark, d):
    store, seqs, _ = stored(spark, d)
    return cells(store.read_all(seqs[1]))


@query(f"with {PARTS} select * from t where i0 < 1")
def history_pop(spark, d):
    store, _, _ = stored(spark, d)
    store.pop(2)
    return cells(store.read_all())


@query(f"with {PARTS} select * from t where i0 < 2")
def history_revert(spark, d):
    """To the second commit, after a pop to the first: neither the head nor what stood before the pop."""
    store, seqs, _ = stored(spark, d)
    store.pop(2)
    store.revert_commit(seqs[1])
    return cells(store.read_all())


@query("select unnest([1, 2, 3])::bigint as place, unnest([2, 1, 0])::bigint as append")
def history_list_commits(spark, d):
    """The last three commits, newest first, as numbers of the appends that made them."""
    store, seqs, _ = stored(spark, d)
    return spark.createDataFrame([(i + 1, seqs.index(s)) for i, s in enumerate(store.list_commits(3))], "place long, append long")


@query(f"with {PARTS} select i0, i1, case when i0 = 1 then value else -1.0 * i1 end as value from t where i0 = 1 union all select unnest([0, 2]) as i0, i1, -1.0 * i1 from (select unnest(range(16)) as i1)")
def history_rewrite_entries(spark, d):
    store, _, _ = stored(spark, d)
    new = spark.range(16).select(F.explode(F.expr("array(0L, 1L)")).alias("i0"), F.col("id").alias("i1"), (-F.col("id")).cast("double").alias("value"))
    store.rewrite([0, 2], X.Tensor(new, "f64", (2, 16)))
    return cells(store.read_all())


@query("select unnest([0, 1, 2])::bigint as start, unnest([1, 2, 3])::bigint as \"end\"")
def append_ranges(spark, d):
    return spark.createDataFrame(stored(spark, d)[2], "start long, end long")


@query(f"with {PARTS} select * from t where i0 < 1")
def append_with_a_tag_once(spark, d):
    store = TensorStore.create(spark, scratch(spark, "tensor"), "f64", (16,))
    first = _slices(spark, d)[0]
    assert store.append(first, tag="a") == store.append(first, tag="a") == (0, 1)
    return cells(store.read_all())


@query("select 2::bigint as rank, 'f64' as dtype, 3::bigint as length, 16::bigint as width, 'random_access' as layout, '1x8' as chunk_plan")
def tensor_metadata(spark, d):
    """A random-access tensor with blocks, opened again."""
    store, _, _ = stored(spark, d, layout="random_access", blocks=(1, 8))
    m = TensorStore.open(spark, store.path).meta()
    return one_row(spark, rank=m["rank"], dtype=m["dtype"], length=m["dim_lens"][0], width=m["dim_lens"][1], layout=m["layout"], chunk_plan="x".join(map(str, m["chunk_plan"])))


@query("select 'user' as name, 'a,b' as labels, 'v' as kv, 5::bigint as every, 3::bigint as length")
def tensor_metadata_edits(spark, d):
    store, _, _ = stored(spark, d)
    store.set_dim_name(1, "user")
    store.set_labels(0, ["a", "b"])
    store.set_user_kv("k", "v")
    store.set_compression("on")
    store.index_checkpoint_every(5)
    again = TensorStore.open(spark, store.path)
    m = again.meta()
    return one_row(spark, name=m["names"]["1"], labels=",".join(m["names"]["labels_0"]), kv=m["kv"]["k"], every=again.index_checkpoint_every(), length=m["dim_lens"][0])


@query(f"with {PARTS} select * from t")
def compact_to(spark, d):
    store, _, _ = stored(spark, d)
    return cells(store.compact_to(scratch(spark, "compact")).read_all())


@query(f"with {PARTS} select * from t where i0 < 1")
def compact_after_pop(spark, d):
    """maybe_compact of a store whose history is mostly dead; the copy holds the head alone."""
    store, _, _ = stored(spark, d)
    store.pop(2)
    return cells(store.maybe_compact(scratch(spark, "compact"), 0.3).read_all())


@query(f"with {PARTS} select * from t")
def reform_to_random_access(spark, d):
    store, _, _ = stored(spark, d)
    return cells(store.reform_to(scratch(spark, "reform"), "random_access", (1, 4)).read_all())


@query(f"with {PARTS} select * from t where i0 < 2")
def retain_last_commits(spark, d):
    """A copy with the last two commits, read at the older one."""
    store, _, _ = stored(spark, d)
    copy = store.retain(scratch(spark, "retained"), 2)
    return cells(copy.read_all(copy.list_commits(2)[-1]))


@query("select true as some_live, true as some_history, 0::bigint as orphan_bytes, true as ratio")
def analyze_compaction(spark, d):
    store, _, _ = stored(spark, d)
    store.pop(1)
    r = store.analyze_compaction()
    return r.select((F.col("head_bytes") > 0).alias("some_live"), (F.col("history_bytes") > 0).alias("some_history"), "orphan_bytes", ((F.col("dead_ratio") > 0) & (F.col("dead_ratio") < 1)).alias("ratio"))


@query("select 'known' as state, null::varchar as reason")
def store_diagnostics(spark, d):
    return stored(spark, d)[0].diagnostics().select("state", "reason")


@query(f"with {PARTS} select 0::bigint as i0, x.j::bigint as i1, value from t join (select unnest([3, 9, 1]) as k, unnest([0, 1, 2]) as j) x on i1 = k where i0 = 1")
def read_selectors_at_commit(spark, d):
    store, seqs, _ = stored(spark, d)
    t, execution = store.read_with_options([[1], [3, 9, 1]], "threads", 2, seqs[1])
    assert execution.threads == 2
    return cells(t)


@query(f"with {PARTS}, g as (select unnest(range(2)) as i0), k as (select i0, unnest(range(16)) as i1 from g) select i0, i1, coalesce(value, -1.0) as value, value is not null as valid from k left join t using (i0, i1)")
def read_dense_at_commit(spark, d):
    store, seqs, _ = stored(spark, d)
    return store.read_all_dense(-1, seqs[1])


@query(f"with {PARTS} select * from t where i0 < 2")
def tensor_store_open_again(spark, d):
    store, seqs, _ = stored(spark, d)
    return cells(TensorStore.open(spark, store.path).read_all(seqs[1]))


# --- coordinates of stored tensors --------------------------------------------------------------------------------

def _with_coordinates(spark, d) -> tuple[TensorStore, list[int]]:
    """Three appends; the append axis has numbers 100, 110, 120, the users' axis dictionary codes, extended by the last append."""
    axes = {0: coords.Axis(0, "i64", unique=True), 1: coords.Axis(1, "dictionary")}
    store, seqs = TensorStore.create(spark, scratch(spark, "tensor"), "f64", (16,), axes=axes), []
    for k, t in enumerate(_slices(spark, d)):
        given, words = [{"axis": 0, "number": 100 + 10 * k}], []
        if k == 0:
            given += [{"axis": 1, "code": i % 3} for i in range(16)]
            words = [{"axis": 1, "code": i, "label": f"group{i}"} for i in range(3)]
        if k == 2:
            given, words = [*given, {"axis": 1, "code": 7, "pos": 5}], [{"axis": 1, "code": 7, "label": "late"}]
        store.append(t, coordinates=given, dictionary=words)
        seqs.append(store.head_commit())
    return store, seqs


@query(f"with {PARTS} select 0::bigint as i0, i1, value from t where i0 = 1")
def coord_read_stored(spark, d):
    return cells(_with_coordinates(spark, d)[0].read_at_coordinate(0, "i64", 110)[1])


@query(f"with {PARTS} select i0 - 1 as i0, i1, value from t where i0 >= 1")
def coord_range_stored(spark, d):
    return cells(_with_coordinates(spark, d)[0].read_coordinate_range(0, 105, 121)[1])


@query("select unnest(['missing', 'unique', 'missing', 'unique']) as status, unnest(['number', 'number', 'label', 'label']) as key, unnest(['first', 'head', 'first', 'head']) as at_commit")
def coord_lookup_at_commits(spark, d):
    """The last slot's number and the late label, at the first commit and at the head."""
    store, seqs = _with_coordinates(spark, d)
    rows = [(store.lookup(*key, seq=s).status, name, at) for name, key in (("number", (0, "i64", 120)), ("label", (1, "label", "late"))) for at, s in (("first", seqs[0]), ("head", None))]
    return spark.createDataFrame(rows, "status string, key string, at_commit string")


@query("select unnest([0, 1, 2, 7])::bigint as code, unnest(['group0', 'group1', 'group2', 'late']) as label")
def coord_dictionary(spark, d):
    return _with_coordinates(spark, d)[0].dictionary().select("code", "label")


@query("select unnest([0, 1, 2])::bigint as pos, unnest([100, 110, 120])::bigint as number")
def coord_axis(spark, d):
    store, _ = _with_coordinates(spark, d)
    return coords.axis_coordinates(store.coordinates(), 0).select("pos", "number")


@query("select x as pos from (select unnest(range(16))::bigint as x) where x % 3 = 1")
def coord_label_positions(spark, d):
    store, _ = _with_coordinates(spark, d)
    return spark.createDataFrame([(p,) for p in store.lookup(1, "label", "group1").positions], "pos long")


# --- tables -------------------------------------------------------------------------------------------------------

HALVES = "h as (select max(o_orderkey) // 2 as half from orders)"


def stored_table(spark, d) -> tuple[TableFile, object, object]:
    """Orders in two generations, with the reports of both writes."""
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    half = df.agg(F.expr("max(o_orderkey) div 2")).head()[0]
    t, one = TableFile.create(spark, scratch(spark, "table"), df.where(F.col("o_orderkey") <= half), columns_of(df.schema), ["o_orderkey"], group_rows=GROUP)
    _, two = t.append(df.where(F.col("o_orderkey") > half))
    return TableFile.open(spark, t.log.root), one, two


@query(f"with {HALVES}, n as (select count(*) filter (where o_orderkey <= half) as a, count(*) filter (where o_orderkey > half) as b from orders, h) select 1::bigint as generation, null::bigint as previous, a as n_rows, ceil(a / {GROUP})::bigint as row_groups from n union all select 2, 1, b, ceil(b / {GROUP})::bigint from n")
def table_write_reports(spark, d):
    _, one, two = stored_table(spark, d)
    return spark.createDataFrame([(r.generation, r.previous_generation, r.rows, r.row_groups) for r in (one, two)], "generation long, previous long, n_rows long, row_groups long")


@query(f"with {HALVES} select count(*) as n_rows, (ceil(count(*) filter (where o_orderkey <= half) / {GROUP}) + ceil(count(*) filter (where o_orderkey > half) / {GROUP}))::bigint as row_groups, 3::bigint as n_columns from orders, h")
def table_counts(spark, d):
    t = TableFile.open(spark, stored_table(spark, d)[0].log.root, full_payload=True)
    b = t.clone().bundle()
    return one_row(spark, n_rows=b.row_count(), row_groups=b.row_group_count(), n_columns=len(t.columns()))


@query("select 'ok' as status, 2::bigint as generation, 1::bigint as previous_generation, 0::bigint as orphan_bytes")
def table_maintenance(spark, d):
    return stored_table(spark, d)[0].analyze().select("status", "generation", "previous_generation", "orphan_bytes")


@query("select 1::bigint as removed, 0::bigint as again, 'ok' as status")
def table_cleanup(spark, d):
    """A folder that no commit names is removed once."""
    t, _, _ = stored_table(spark, d)
    spark.range(3).write.parquet(t.log.full(t.log.new_folder()))
    first, second = t.cleanup_orphans().head(), t.cleanup_orphans().head()
    return one_row(spark, removed=first["removed_folders"], again=second["removed_folders"], status=t.analyze().head()["status"])


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def table_copy_of_a_snapshot(spark, d):
    t, _, _ = stored_table(spark, d)
    copy, _ = t.copy_snapshot(scratch(spark, "copy"))
    return copy.bundle().rows.select("o_orderkey", "o_custkey", "o_totalprice")


@query("select true as listed, 0::bigint as issues, 1::bigint as missing")
def table_files_manifest(spark, d):
    """A manifest of the table's files fits them; with a file less one issue is told."""
    t, _, _ = stored_table(spark, d)
    found = files_manifest(spark, [t.log.full("data")])
    one = found.orderBy("file").limit(1)
    missing = validate_files(found, found.join(one.select("file"), "file", "left_anti")).where("issue is not null")
    return one_row(spark, listed=found.count() > 0, issues=validate_files(found, found).where("issue is not null").count(), missing=missing.count())


# --- plans and visits -----------------------------------------------------------------------------------------------

def _planned(spark, d):
    b = orders_bundle(spark, d)
    return b, b.plan(["o_orderkey", "o_totalprice"], [P.Predicate.between("o_custkey", 40, 60)])


@query(f"with {ORDERS_STATS} select g::int as row_group_id, count(*) as n, min(o_orderkey) as first, max(o_orderkey) as last from r where g in (select g from s where clo <= 60 and chi >= 40) group by g")
def plan_visit(spark, d):
    """Row groups visited in plan order, each whole and in order."""
    b, plan = _planned(spark, d)
    seen = []
    assert b.visit(lambda g, rows: seen.append((g, len(rows), rows[0].o_orderkey, rows[-1].o_orderkey)), plan)
    return spark.createDataFrame(seen, "row_group_id int, n long, first long, last long")


@query(f"with {ORDERS_STATS} select count(*) as selected from s where clo <= 60 and chi >= 40")
def plan_strict(spark, d):
    b = orders_bundle(spark, d)
    plan = b.plan_strict(["o_orderkey"], [P.Predicate.between("o_custkey", 40, 60)], max_row_groups=1_000_000)
    b.validate_plan(plan)
    return one_row(spark, selected=len(plan.row_groups))


@query(f"with {ORDERS} select o_orderkey, o_totalprice from r where g = 1")
def row_group_into_buffers(spark, d):
    b = orders_bundle(spark, d)
    kinds = {c.name: c.physical for c in b.columns}
    found = b.read_row_group_into(1, {c: (kinds[c], GROUP, True) for c in ("o_orderkey", "o_totalprice")})
    return spark.createDataFrame(found.to_pandas())


@query("select count(*) as n_rows, ceil(count(*) / 1024)::bigint as row_groups, 3::bigint as n_columns, 'o_orderkey' as keys from orders")
def bundle_metadata(spark, d):
    m = orders_bundle(spark, d).metadata()
    return m.select(F.col("rows").alias("n_rows"), F.col("row_groups"), F.col("columns").cast("bigint").alias("n_columns"), F.array_join("ordering_keys", ",").alias("keys"))


MATCHING = f"{ORDERS_STATS}, m as (select * from r where g in (select g from s where clo <= 60 and chi >= 40))"


@query(f"with {MATCHING} select g::int as row_group_id, sum(o_orderkey)::bigint as key_sum, round(max(o_totalprice), 4) as top from m group by g")
def plan_visit_into_buffers(spark, d):
    b, plan = _planned(spark, d)
    seen = []
    b.visit_into({"o_orderkey": [], "o_totalprice": []}, lambda g, buffers: seen.append((g, sum(buffers["o_orderkey"]), round(max(buffers["o_totalprice"]), 4))), plan)
    return spark.createDataFrame(seen, "row_group_id int, key_sum long, top double")


@query(f"with {MATCHING} select g::int as row_group_id, count(*) as n from m group by g")
def plan_session(spark, d):
    """A session polled to its end."""
    b, plan = _planned(spark, d)
    return spark.createDataFrame([(g, len(rows)) for _, g, rows in b.session(plan)], "row_group_id int, n long")


@query(f"with {MATCHING}, x as (select g, unnest(['o_orderkey', 'o_totalprice']) as column_name, min(o_orderkey) as lo, max(o_orderkey) as hi, min(o_totalprice) as plo, max(o_totalprice) as phi, count(*) as n from m group by g) select g::int as row_group_id, n as n_rows, column_name, case column_name when 'o_orderkey' then lo else plo end as least, case column_name when 'o_orderkey' then hi else phi end as most from x")
def plan_summaries(spark, d):
    b, plan = _planned(spark, d)
    return b.row_group_summaries(plan).select("row_group_id", F.col("rows").alias("n_rows"), "column_name", F.col("min_double").alias("least"), F.col("max_double").alias("most"))


@query(f"with {MATCHING} select g::int as row_group_id, count(*) as n, sum(o_orderkey)::bigint as key_sum, sum(o_custkey)::bigint as customer_sum from m group by g")
def plan_visit_projected(spark, d):
    """Fields of packed records, visited by row group."""
    df = table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"))
    df = df.withColumn("packed", F.concat(binary.write_le(F.col("o_orderkey"), "i64"), binary.write_le(F.col("o_custkey"), "u32")))
    b = Bundle.build(df, ["o_orderkey"], GROUP, [Column("o_orderkey", "i64"), Column("o_custkey", "i64"), Column("packed", "fixed_binary", width=12)])
    plan = b.plan(["packed"], [P.Predicate.between("o_custkey", 40, 60)])
    fields = records.Projection("packed", 12, (records.Field("key", 0, "i64"), records.Field("customer", 8, "u32")))
    seen = []
    b.visit_projected(lambda g, rows: seen.append((g, len(rows), sum(r.key for r in rows), sum(r.customer for r in rows))), plan, fields)
    return spark.createDataFrame(seen, "row_group_id int, n long, key_sum long, customer_sum long")


# --- lanes of channels ------------------------------------------------------------------------------------------------

LANE_GROUPS = f"r as (select o_orderkey + 1 as b, (row_number() over (order by o_orderkey) - 1) // {GROUP} as g from orders)"


@query(f"with {LANE_GROUPS} select g::int as row_group_id, count(*) + case when g = 1 then 1 else 0 end as n_rows, case when g = 1 then 'row_count_mismatch' when count(*) filter (where b % 5000 = 0) > 0 then 'payload_header_mismatch' end as issue from r group by g")
def lanes_certify_summaries(spark, d):
    """Nulls in some row groups, and statistics of one that count a row too many."""
    lanes = _lanes(spark, d).withColumn("receive_nano", F.when(F.col("biz_index") % 5000 != 0, F.col("receive_nano")))
    b = Bundle.build(lanes, ["biz_index"], GROUP, records.lane_columns())
    b.stats = b.stats.withColumn("rows", F.col("rows") + F.when(F.col("row_group_id") == 1, 1).otherwise(0))
    return channels.certify_summaries(b).select("row_group_id", F.col("rows").alias("n_rows"), "issue")


@query(f"with {LANE_GROUPS}, x as (select g, count(*) as n, sum(b) as total, count(*) filter (where b % 5000 = 0) as bad from r group by g) select g::int as plan_ordinal, case when bad = 0 then n end as n_rows, case when bad = 0 then total end::bigint as index_sum, bad > 0 as foreign_rows from x")
def lanes_prepare_channel(spark, d):
    """All orders as channel 3; row groups with a row of channel 4 are refused."""
    lanes = _lanes(spark, d).withColumn("channel_id", F.when(F.col("biz_index") % 5000 == 0, 4).otherwise(3).cast("bigint"))
    b = Bundle.build(lanes, ["biz_index"], GROUP, records.lane_columns())

    def work(t):
        import pyarrow.compute as pc

        return f"{t.num_rows},{pc.sum(t['biz_index']).as_py()}".encode()

    out = channels.prepare_channel(b, 3, work, expected_rows=b.row_count()).withColumn("t", F.split(F.col("payload").cast("string"), ","))
    return out.select("plan_ordinal", F.col("t")[0].cast("bigint").alias("n_rows"), F.col("t")[1].cast("bigint").alias("index_sum"), F.coalesce(F.col("error").contains("channel_id_mismatch"), F.lit(False)).alias("foreign_rows"))


@query("with c as (select (o_custkey % 8 + 1)::bigint as channel_id, o_orderkey + 1 as b, o_orderkey % 2 as k, lag(o_orderkey) over (partition by o_custkey % 8 order by o_orderkey) + 1 as p from orders) select channel_id, count(*) as row_count, min(b) as first_biz_index, max(b) as last_biz_index, count(*) filter (where k = 0) as order_records, count(*) filter (where k = 1) as trade_records, case when channel_id = 5 then 'payload_header_mismatch' when count(*) filter (where b > p + 1) > 0 then 'biz_index_gap' end as issue from c group by channel_id")
def lanes_certify_channels(spark, d):
    """Continuity, counts and rebuilt headers of all channels; channel 5 has no trading day."""
    lanes = _lanes(spark, d).withColumn("day_key", F.when(F.col("channel_id") == 5, 0).otherwise(F.col("day_key")))
    return channels.certify_lanes(lanes, order=("biz_index",))
