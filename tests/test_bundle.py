"""Ordered tables: plans, reads, reports and their rejections, on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from tesserine.errors import TableError, Unimplemented
from tesserine.functions.types import Column, columns_of, schema_of
from tesserine.operators import layout
from tesserine.operators.bundle import Bundle
from tesserine.plans import predicates as P
from tesserine.sources.catalog import TableFile

KEYED = [Column("partition_key", "i32", "opaque_key"), Column("order_key", "i64", "opaque_key"), Column("category_code", "i32", "dictionary_code", dictionary_id=0)]
ROWS = [(10, 100, 1), (10, 101, 1), (10, 102, 2), (11, 200, 1), (11, 201, 2), (11, 202, 2)]


@pytest.fixture(scope="module")
def keyed(spark):
    df = spark.createDataFrame(ROWS, "partition_key int, order_key long, category_code int")
    names = spark.createDataFrame([(0, 1, "alpha"), (0, 2, "beta")], "dictionary_id int, code int, value string")
    b = Bundle.build(df, ["partition_key", "order_key"], 3, KEYED, names)
    b.stats = b.stats.drop("min_category_code", "max_category_code").selectExpr("*", "cast(null as int) min_category_code", "cast(null as int) max_category_code")
    return b


def kind_of(f, *args, **kw):
    with pytest.raises(TableError) as e:
        f(*args, **kw)
    return e.value.kind


def values(df):
    return [tuple(r) for r in df.orderBy("base_row", "row_in_group").drop("row_group_id", "base_row", "row_in_group", "plan_ordinal").collect()]


def test_equal_prunes_one_group(keyed):
    plan = keyed.plan(None, [P.Predicate.equal("partition_key", 11)], P.ReadOptions(read_threads=4))
    assert plan.row_groups == (1,)
    assert plan.report == P.ReadReport(4, 1, 1, 1, 3, "too_few_row_groups")
    assert values(keyed.read_plan(plan)) == ROWS[3:]


def test_pruning_never_filters_rows(keyed):
    got = keyed.read(["order_key"], [P.Predicate.between("order_key", 101, 150)])
    assert values(got) == [(100,), (101,), (102,)]
    assert P.exact_filter(got, [P.Predicate.between("order_key", 101, 150)]).count() == 2


def test_missing_statistics_keep_groups(keyed):
    plan = keyed.plan(["category_code"], [P.Predicate.equal("category_code", 2)])
    assert plan.row_groups == (0, 1) and plan.report.pruned_row_groups == 0 and plan.report.fallback_reason == "thread_cap_one"
    assert kind_of(keyed.plan_strict, None, [P.Predicate.equal("category_code", 2)]) == "invalid_input"
    assert kind_of(keyed.plan_strict, None, [P.Predicate("order_key", 0)], max_row_groups=1) == "invalid_input"
    assert keyed.plan_strict(None, [P.Predicate("order_key", 0)], max_row_groups=2).row_groups == (0, 1)


@pytest.mark.parametrize(
    "p",
    [
        P.Predicate.equal("nope", 1), P.Predicate("order_key"), P.Predicate("order_key", 5, 4), P.Predicate("order_key", 1.0), P.Predicate("partition_key", 1 << 40),
        P.Predicate("order_key", 1, physical="i32"),
    ],
)
def test_predicates_are_checked(keyed, p):
    assert kind_of(keyed.plan, None, [p]) == "invalid_input"


def test_float_and_binary_predicates(spark):
    columns = [Column("k", "i64"), Column("x", "f64"), Column("b", "fixed_binary", width=2)]
    assert kind_of(P.check, columns, [P.Predicate("x", float("nan"))]) == "invalid_input"
    assert kind_of(P.check, columns, [P.Predicate.equal("b", 1)]) == "invalid_input"
    assert kind_of(P.check, columns, [P.Predicate.equal("x", 1)]) == "invalid_input"
    P.check(columns, [P.Predicate("x", 0.5, None)])


def test_projection_order_and_rejections(keyed):
    assert keyed.read(["category_code", "partition_key"]).columns[3:] == ["category_code", "partition_key"]
    assert kind_of(keyed.read, ["order_key", "order_key"]) == "invalid_input"
    assert kind_of(keyed.read, ["nope"]) == "invalid_input"


def test_options_that_are_not_there(keyed):
    for o in (P.ReadOptions(validate_checksums=False), P.ReadOptions(decode_dictionaries=True)):
        with pytest.raises(Unimplemented):
            keyed.plan(options=o)
    assert kind_of(keyed.plan, options=P.ReadOptions(read_threads=0)) == "invalid_input"


def test_ordering_key_ranges(keyed):
    p = P.ordering_key_predicates(keyed.columns, keyed.keys, {0: (11, 11), 1: (None, 201)})
    assert keyed.plan(None, p).row_groups == (1,)
    for bad in ({}, {2: (1, 2)}, {0: (2, 1)}, {0: (None, None)}, {0: (1.5, None)}):
        assert kind_of(P.ordering_key_predicates, keyed.columns, keyed.keys, bad) == "invalid_input"


def test_subsets_follow_the_plan(keyed):
    plan = keyed.plan()
    assert P.subset(plan, [1, 0]) == (0, 1)
    assert "duplicate" in str(pytest.raises(TableError, P.subset, plan, [1, 1]).value)
    assert kind_of(P.subset, plan, [7]) == "invalid_input"
    keyed.validate_plan(plan)
    assert kind_of(keyed.validate_plan, P.ReadPlan(("order_key",), (0, 9), plan.report)) == "invalid_input"


def test_visits_stop(keyed):
    seen = []
    assert keyed.visit(lambda g, rows: seen.append((g, len(rows))), keyed.plan(["order_key"]))
    assert seen == [(0, 3), (1, 3)]
    assert not keyed.visit(lambda g, rows: False, keyed.plan())
    s = keyed.session(keyed.plan(["order_key"]))
    assert s.next()[:2] == ("batch", 0)
    s.cancel()
    assert s.next() == ("cancelled",)
    assert [x[1] for x in keyed.session(keyed.plan())] == [0, 1]


def test_prepare_commits_in_order(keyed):
    plan, seen = keyed.plan(["order_key"]), []
    assert keyed.prepare_and_commit(lambda t: str(t["order_key"][0].as_py()).encode(), lambda i, p: seen.append((i, bytes(p))), plan)
    assert seen == [(0, b"100"), (1, b"200")]
    assert not keyed.prepare_and_commit(lambda t: b"", lambda i, p: False, plan)

    def fails(t):
        raise ValueError("no")

    assert "ordinal 0" in str(pytest.raises(TableError, keyed.prepare_and_commit, fails, lambda i, p: None, plan).value)


def test_read_into_buffers(keyed):
    got = keyed.read_row_group_into(1, {"order_key": ("i64", 3, False)})
    assert got["order_key"].to_pylist() == [200, 201, 202]
    for bad in ({"order_key": ("i32", 3, False)}, {"order_key": ("i64", 2, False)}, {"nope": ("i64", 3, False)}):
        assert kind_of(keyed.read_row_group_into, 1, bad) == "invalid_input"
    assert kind_of(keyed.read_row_group, 5) == "invalid_input"


def test_dictionary_and_summaries(keyed):
    assert [tuple(r) for r in keyed.dictionary(0).orderBy("code").collect()] == [(1, "alpha"), (2, "beta")]
    assert kind_of(keyed.dictionary, 3) == "invalid_input"
    assert keyed.decoded("category_code").where("category_code_label = 'beta'").count() == 3
    s = keyed.row_group_summaries().where("column_name = 'order_key'").orderBy("row_group_id").collect()
    assert [(r.min_long, r.max_long, r.null_count, r.rows) for r in s] == [(100, 102, 0, 3), (200, 202, 0, 3)]
    assert keyed.metadata().head()["rows"] == 6


def test_nulls_in_a_column(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "k long, v int")
    b = Bundle.build(df, ["k"], 2)
    assert [r.null_count_v for r in b.stats.orderBy("row_group_id").collect()] == [1, 0]


def test_row_numbers_over_ranges(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "id as v")
    got = layout.with_row_number(df, ["k"], 5).collect()
    assert all(r.row_number == r.k for r in got)


def test_table_lifecycle(spark, tmp_path):
    columns = [Column("sequence_key", "i64", "opaque_key"), Column("category_code", "i32", "dictionary_code", dictionary_id=0), Column("metric", "f64", nullable=True)]
    frame = lambda rows: spark.createDataFrame(rows, schema_of(columns))
    path = str(tmp_path / "t")
    old, report = TableFile.create(spark, path, frame([(10, 0, 1.5), (11, 1, 2.5)]), columns, ["sequence_key"], {0: ["alpha", "beta"]}, group_rows=2)
    assert (report.generation, report.rows, report.row_groups, report.chunks) == (1, 2, 1, 3)
    new, report = old.append(frame([(12, 1, 3.5), (13, 0, 4.5)]))
    assert (report.generation, report.previous_generation) == (2, 1)
    assert old.bundle().rows.count() == 2 and new.bundle().rows.count() == 4
    got = TableFile.open(spark, path, full_payload=True).bundle()
    assert (got.generation, got.row_group_count(), got.row_count()) == (2, 2, 4)
    batch = got.read(["category_code"], [P.Predicate.between("sequence_key", 12, 13)]).orderBy("row_in_group").collect()
    assert [(r.base_row, r.category_code) for r in batch] == [(2, 1), (2, 0)]
    assert columns_of(schema_of(columns)) == columns
    assert kind_of(old.append, frame([(14, 0, 1.0)]).drop("metric")) == "invalid_input"
    assert kind_of(new.append, frame([(9, 0, 1.0)])) == "invalid_input"
    with pytest.raises(TableError) as e:
        old._write(frame([(20, 0, 1.0)]), "zstd", None)
    assert e.value.kind == "lock_unavailable"
    # The refused write's data are orphans.
    assert new.analyze().head()["status"] == "orphan_tail"
    assert new.cleanup_orphans().head()["removed_folders"] == 2
    assert new.cleanup_orphans().head()["removed_folders"] == 0
    copy, _ = new.copy_snapshot(str(tmp_path / "copy"))
    assert copy.fingerprint()["combined"] == new.fingerprint()["combined"] != old.fingerprint()["combined"]
    assert kind_of(new.copy_snapshot, str(tmp_path / "copy")) == "io"
    assert new.plan_certification(new.bundle().plan(["metric"]))["row_groups"] == [0, 1]


def test_damaged_commits_are_passed_over(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k long, v double")
    path = tmp_path / "t"
    t, _ = TableFile.create(spark, str(path), df, columns_of(df.schema), ["k"])
    t2, _ = t.append(spark.createDataFrame([(3, 4.0)], "k long, v double"))
    log = sorted((path / "_log").glob("*.json"))
    log[-1].write_text(log[-1].read_text()[:-20])
    for crc in (path / "_log").glob(".*.crc"):
        crc.unlink()
    again = TableFile.open(spark, str(path))
    assert again.commit["generation"] == 1 and again.bundle().rows.count() == 2
    assert again.analyze().head()["rejected_commits"] == 1


def test_fixed_binary_widths(spark, tmp_path):
    columns = [Column("key", "i64"), Column("payload", "fixed_binary", width=4)]
    df = spark.createDataFrame([(1, bytearray(b"0123")), (2, bytearray(b"456"))], "key long, payload binary")
    assert kind_of(TableFile.create, spark, str(tmp_path / "x"), df, columns, ["key"]) == "fixed_binary_width_mismatch"
    assert not (tmp_path / "x").exists()
    assert kind_of(Column, "p", "fixed_binary") == "invalid_input"


def test_attribution_and_buffers(keyed):
    rows, report, seen = keyed.read_with_attribution(["order_key"], [P.Predicate.equal("partition_key", 10)])
    assert rows.count() == 3 and report.head()["selected_row_groups"] == 1 and seen["plan_ns"] > 0 and "Scan" in seen["physical_plan"]
    buffers, got = {"order_key": []}, []
    assert keyed.visit_into(buffers, lambda g, b: got.append((g, list(b["order_key"]))), keyed.plan(["order_key"]))
    assert got == [(0, [100, 101, 102]), (1, [200, 201, 202])]


def test_channels(spark, tmp_path):
    from tesserine.sources import channels

    inputs = []
    for c in (2, 1):
        df = spark.createDataFrame([(c, i, float(i)) for i in range(5)], "channel_id int, k long, v double")
        TableFile.create(spark, str(tmp_path / f"c{c}"), df, columns_of(df.schema), ["k"], group_rows=2)
        inputs.append((c, str(tmp_path / f"c{c}"), 5 if c == 1 else 6))
    rows = channels.read_channels(spark, inputs)
    assert [(r.source_channel, r.rows, r.row_groups, r.issue) for r in channels.channel_report(spark, rows, inputs).collect()] == [(1, 5, 3, None), (2, 5, 3, "row_count_mismatch")]
    assert kind_of(channels.read_channels, spark, [(3, str(tmp_path / "none"), None)]) == "missing_artifact"
    swapped = [(2, inputs[1][1], None)]
    assert channels.channel_report(spark, channels.read_channels(spark, swapped), swapped).head().issue == "channel_id_mismatch"


def test_crc32c(spark):
    from tesserine.functions import checksums

    known = {b"123456789": 0xE3069283, b"": 0, bytes(32): 0x8A9136AA}
    df = spark.createDataFrame([(bytearray(k),) for k in known] + [(None,)], "b binary")
    got = [r[0] for r in df.select(checksums.crc32c("b")).collect()]
    assert got == [*known.values(), None]
    assert [checksums.crc32c_of(k) for k in known] == list(known.values())


def test_stored_reads_are_pruned_in_the_scan(spark, tmp_path):
    df = spark.range(20000).select("id", (F.col("id") % 7).alias("k"))
    t, _ = TableFile.create(spark, str(tmp_path / "t"), df, columns_of(df.schema), ["id"], group_rows=100)
    b = t.bundle()
    found = b.read(["id"], [P.Predicate.between("id", 5050, 5250)])
    assert sorted(r.id for r in found.collect()) == list(range(5000, 5300))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_group_id,50)" in plan and "LessThanOrEqual(row_group_id,52)" in plan and "Join" not in plan
    assert b.read(["id"], [P.Predicate.between("id", 90000, 90001)]).isEmpty()


def test_spans():
    assert P.spans_of([]) == [] and P.spans_of([3, 1, 2, 9]) == [(1, 3), (9, 9)]
    assert P.spans_of([1, 3, 50, 52, 900], 2) == [(1, 52), (900, 900)] and P.spans_of([1, 5], 1) == [(1, 5)]


def test_spans_hold_all_groups_that_may_match(spark):
    """More runs than spans: reads are still of whole matching row groups only."""
    df = spark.range(4000).select("id", F.when(F.expr("id div 2 % 3 = 0"), 1).otherwise(0).alias("k"))
    b = Bundle.build(df, ["id"], 2)
    spans, exact = b.spans([P.Predicate.equal("k", 1)])
    assert len(spans) <= P.SPANS and not exact
    assert b.read(["id"], [P.Predicate.equal("k", 1)]).count() == df.where("k = 1").count()


def test_row_numbers_within_one_first_key(spark):
    """Rows of a single day, with nulls and repeated values, are cut into several ranges and numbered in order."""
    rows = [(20260702, None if i % 10 == 0 else (i * 7919) % 300, float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "day int, a int, b double")
    bounds = layout.range_bounds(df, ["day", "a", "b"], 6)
    assert len(bounds) == 5
    got = [tuple(r)[:3] for r in layout.with_row_number(df, ["day", "a", "b"], 6).orderBy("row_number").collect()]
    assert got == sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2]))
    numbers = [r.row_number for r in layout.with_row_number(df, ["day", "a", "b"], 6).collect()]
    assert sorted(numbers) == list(range(1000))
    empty = spark.createDataFrame([(None, i) for i in range(50)], "a int, b int")
    assert [r.b for r in layout.with_row_number(empty, ["a", "b"], 4).orderBy("row_number").collect()] == list(range(50))
