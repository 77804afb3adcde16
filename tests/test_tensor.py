"""Tensors: reads, operations, stores, coordinates and their rejections, against NumPy."""

import numpy as np
import pytest

from tesserine.errors import TableError, Unimplemented
from tesserine.operators import coords as C
from tesserine.operators import sparse as S
from tesserine.operators import tensor as X
from pyspark.sql import functions as F

from tesserine.sources import companions
from tesserine.sources.tensor_store import TensorStore


@pytest.fixture(scope="module")
def t(spark):
    return X.from_numpy(spark, np.arange(1.0, 7.0).reshape(3, 2), "f64")


def same(t, want):
    got = X.to_numpy(t)
    assert got.shape == want.shape
    np.testing.assert_allclose(got.astype(float), want.astype(float), rtol=1e-9)


def rejects(f, *args, **kw):
    with pytest.raises(TableError):
        f(*args, **kw)


A = np.arange(1.0, 7.0).reshape(3, 2)


@pytest.mark.parametrize("items", [[slice(0, 3, 2), slice(None)], [-1, X.ELLIPSIS], [X.ELLIPSIS, 0], [X.NEWAXIS, slice(1, None), 1], [slice(-2, None)], [X.ELLIPSIS, X.NEWAXIS], [slice(2, 1)]])
def test_read_index(t, items):
    np_items = tuple(Ellipsis if x == X.ELLIPSIS else np.newaxis if x == X.NEWAXIS else x for x in items)
    same(X.read_index(t, items), A[np_items])


@pytest.mark.parametrize("items", [[slice(None, None, 0)], [X.ELLIPSIS, X.ELLIPSIS], [0, 1], [slice(None, None, -1)], [5, slice(None)], [0, 0, 0]])
def test_read_index_rejects(t, items):
    rejects(X.read_index, t, items)


def test_arithmetic(spark, t):
    row = X.from_numpy(spark, np.array([10.0, 0.0]), "f64")
    same(X.elementwise("add", t, row), A + [10, 0])
    with np.errstate(divide="ignore"):
        same(X.elementwise("div", t, row), A / [10, 0])
    same(X.elementwise("mul", X.axis_one(t, 1, 0), X.axis_one(t, 0, 0)), A[:, :1] * A[:1])
    same(X.with_scalar("sub", t, 1.5, swapped=True), 1.5 - A)
    i = X.from_numpy(spark, np.array([[1, 2147483647]]), "i32")
    rejects(X.elementwise, "add", t, i)
    rejects(X.with_scalar, "add", t, 1)
    with pytest.raises(Exception, match="OVERFLOW"):
        X.with_scalar("add", i, 1).cells.collect()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        X.with_scalar("div", i, 0).cells.collect()
    rejects(X.elementwise, "add", t, X.from_numpy(spark, np.zeros(3), "f64"))


def test_float_division_by_zero(spark):
    a = X.from_numpy(spark, np.array([1.0, -1.0, 0.0, np.nan]), "f64")
    got = X.to_numpy(X.with_scalar("div", a, 0.0))
    assert got[0] == np.inf and got[1] == -np.inf and np.isnan(got[2]) and np.isnan(got[3])


def test_reductions(spark, t):
    for op, f in (("sum", np.sum), ("mean", np.mean), ("min", np.min), ("max", np.max), ("var", np.var), ("std", np.std), ("argmin", np.argmin), ("argmax", np.argmax)):
        same(X.reduce_axes(op, t, [0]), f(A, axis=0))
    same(X.reduce_axes("sum", t, None, True), np.array([[21.0]]))
    rejects(X.reduce_axes, "sum", t)
    rejects(X.reduce_axes, "sum", t, [0, 0])
    assert X.reduce_axes("argmax", t, [1]).dtype == "i64"
    i = X.from_numpy(spark, np.array([[2, 2, 1], [7, 7, 7]]), "i32")
    same(X.reduce_axes("argmax", i, [1]), np.array([0, 0]))
    same(X.reduce_axes("argmin", i, [1]), np.array([2, 0]))
    assert (X.reduce_axes("sum", i, [1]).dtype, X.reduce_axes("mean", i, [1]).dtype) == ("i32", "f64")
    big = X.from_numpy(spark, np.array([[2147483647, 1]]), "i32")
    with pytest.raises(Exception, match="OVERFLOW"):
        X.reduce_axes("sum", big, [1]).cells.collect()


def test_nan_counts_only_first(spark):
    x = X.from_numpy(spark, np.array([[np.nan, 1.0, 2.0], [3.0, np.nan, 1.0]]), "f64")
    assert np.isnan(X.to_numpy(X.reduce_axes("min", x, [1]))[0]) and X.to_numpy(X.reduce_axes("min", x, [1]))[1] == 1.0
    same(X.reduce_axes("argmax", x, [1]), np.array([0, 0]))
    same(X.reduce_axes("argmin", x, [1]), np.array([0, 2]))


def test_cumulative(spark, t):
    same(X.cumulative("cumsum", t, 0), np.cumsum(A, 0))
    same(X.cumulative("cumprod", t, 1), np.cumprod(A, 1))
    same(X.cumulative("cumsum", t), np.cumsum(A))
    i = X.from_numpy(spark, np.array([3, 4, 5]), "i64")
    same(X.cumulative("cumprod", i, 0), np.array([3, 12, 60]))


def test_shapes(spark, t):
    same(X.reshape(t, (2, 3)), A.reshape(2, 3))
    same(X.move_axis(X.expand_dims(t, 0), 0, 2), np.moveaxis(A[None], 0, 2))
    same(X.broadcast_to(X.axis_one(t, 0, 1), (4, 2)), np.broadcast_to(A[1:2], (4, 2)))
    same(X.slice_axis(t, 0, 2, -4, -1), A[::-1])
    same(X.repeat(t, 0, 2), np.repeat(A, 2, 0))
    same(X.tile(t, 0, 2), np.tile(A, (2, 1)))
    same(X.roll(t, 0, -1), np.roll(A, -1, 0))
    same(X.concat([t, t], 1), np.concatenate([A, A], 1))
    same(X.stack([t, t], -1), np.stack([A, A], -1))
    assert X.repeat(t, 0, 0).shape == (0, 2) and X.repeat(t, 0, 0).cells.isEmpty()
    for bad in (lambda: X.reshape(t, (5,)), lambda: X.squeeze(t, 0), lambda: X.split(t, 0, [1, 1]), lambda: X.permute(t, [0, 0]), lambda: X.unstack(X.flatten(t)), lambda: X.slice_axis(t, 0, 0, 1, 0), lambda: X.broadcast_to(t, (2, 2)), lambda: X.axis_take(t, 0, [9])):
        rejects(bad)


def test_typed_tensor(t):
    typed = X.TypedTensor(t, "f64")
    same(typed.apply("add", typed).tensor, A * 2)
    with pytest.raises(Unimplemented):
        typed.apply("mean", [0])
    rejects(X.TypedTensor, t, "f32")


def test_history(spark, tmp_path):
    s = TensorStore.create(spark, str(tmp_path / "h"), "f32", (1,))
    seqs = []
    for v in (1.0, 2.0, 3.0):
        assert s.append(X.from_numpy(spark, np.array([[v]]), "f32")) == (int(v) - 1, int(v))
        seqs.append(s.head_commit())
    assert s.list_commits(2) == [seqs[2], seqs[1]]
    same(s.read_all(seqs[1]), np.array([[1.0], [2.0]]))
    s.pop()
    same(s.read_all(), np.array([[1.0], [2.0]]))
    assert s.list_commits(9)[:2] == [seqs[1], seqs[0]]
    s.revert_commit(seqs[2])
    same(TensorStore.open(spark, s.path).read_all(), np.array([[1.0], [2.0], [3.0]]))
    for bad in (lambda: s.pop(0), lambda: s.list_commits(0), lambda: s.read_all(999), lambda: s.revert_commit(999), lambda: s.append(X.from_numpy(spark, np.zeros((1, 2)), "f32")), lambda: s.append(X.from_numpy(spark, np.zeros((1, 1)), "f64"))):
        rejects(bad)
    for absent in (s.clear_blocks, lambda: s.auto_compaction({})):
        with pytest.raises(Unimplemented):
            absent()
    small = s.compact_to(str(tmp_path / "c"))
    same(small.read_all(), np.array([[1.0], [2.0], [3.0]]))
    kept = s.retain(str(tmp_path / "r"), 2)
    assert len(kept.list_commits(9)) == 2
    assert s.diagnostics().head()["state"] == "known"


def test_append_by_tag_is_idempotent(spark, tmp_path):
    s = TensorStore.create(spark, str(tmp_path / "i"), "f64", (2,))
    x = X.from_numpy(spark, np.ones((1, 2)), "f64")
    assert s.append(x, tag="batch-0") == s.append(x, tag="batch-0") == (0, 1)
    assert s.meta()["dim_lens"] == (1, 2)


def test_rewrite(spark, tmp_path):
    s = TensorStore.create(spark, str(tmp_path / "w"), "f32", (2,))
    s.append(X.from_numpy(spark, A, "f32"))
    s.rewrite([0, 2], X.from_numpy(spark, np.array([[10.0, 11.0], [50.0, 51.0]]), "f32"))
    same(s.read_all(), np.array([[10.0, 11], [3, 4], [50, 51]]))
    rejects(s.rewrite, [0], X.from_numpy(spark, np.zeros((2, 2)), "f32"))
    rejects(s.rewrite_slice, [[0]], X.from_numpy(spark, np.zeros((1, 2)), "f32"))


def test_universe_remap(spark, tmp_path):
    s = TensorStore.create(spark, str(tmp_path / "u"), "f32", (2,), universe=("fam", "v1", 2))
    s.append(X.from_numpy(spark, np.array([[1.0, 2.0]]), "f32"))
    s.append(X.from_numpy(spark, np.array([[3.0, 4.0], [5.0, 6.0]]), "f32"), slots=[("fam", "v2")] * 2, remaps=[("fam", "v1", "v2", [1, 0])])
    got = s.read_with_shape_policy("explicit_universe", universe=("fam", "v2", 2)).orderBy("i0", "i1").collect()
    assert [r.value for r in got] == [2.0, 1.0, 3.0, 4.0, 5.0, 6.0]
    rejects(s.read_with_shape_policy, "explicit_universe", universe=("fam", "v9", 2))
    padded = s.read_with_shape_policy("explicit_extents", fill=-1, extents=(3,)).where("not valid").collect()
    assert len(padded) == 3 and all(r.value == -1 for r in padded)
    rejects(TensorStore.create, spark, str(tmp_path / "b"), "f32", (2,), axes={1: C.Axis(1, "i32")}, universe=("a", "b", 2))
    assert not (tmp_path / "b").exists()


def test_sparse_appends(spark, tmp_path):
    x = X.from_numpy(spark, np.array([[11, 0, 13, 0]]), "i64")
    rule = S.Rule((1,), min_absent_subtensors=1)
    s = TensorStore.create(spark, str(tmp_path / "s"), "i64", (4,), layout="random_access")
    row = s.analyze_sparse(x, rule).head()
    assert (row.total_subtensors, row.absent_subtensors, row.absent_fraction, row.outcome) == (4, 2, 0.5, "sparse_chunk_tree")
    assert s.append_sparse(x, rule) == ("sparse_chunk_tree", (0, 1))
    got = s.read_all_dense(-5).orderBy("i1").collect()
    assert [(r.value, r.valid) for r in got] == [(11, True), (-5, False), (13, True), (-5, False)]
    assert TensorStore.create(spark, str(tmp_path / "d"), "i64", (4,)).append_sparse(x, rule)[0] == "dense_fallback"
    r = TensorStore.create(spark, str(tmp_path / "r"), "i64", (4,), layout="regular_chunked", blocks=(1, 2))
    assert r.append_sparse(x, rule) == ("reject", None) and r.meta()["dim_lens"] == (0, 4)
    exact = X.from_numpy(spark, np.array([[9007199254740993, 9007199254740992]]), "i64")
    assert S.analyze(exact, S.Rule((1,), predicate=("equal", "i64", 9007199254740993))).head().absent_subtensors == 1
    rejects(S.analyze, x, S.Rule((1,), predicate="nan"))
    rejects(S.analyze, x, S.Rule((1,), predicate=("equal", "f64", 1.0)))
    rejects(X.dense, x, 0.5)


def test_coordinates(spark, tmp_path):
    axes = {0: C.Axis(0, "i64", unique=True), 1: C.Axis(1, "dictionary")}
    s = TensorStore.create(spark, str(tmp_path / "c"), "f64", (2,), axes=axes)
    x = X.from_numpy(spark, np.array([[1.0, 2.0], [3.0, 4.0]]), "f64")
    days = [{"axis": 0, "number": 20260531}, {"axis": 0, "number": 20260601}]
    codes = [{"axis": 1, "code": 1}, {"axis": 1, "code": 2}]
    words = [{"axis": 1, "code": 1, "label": "AAPL", "stable_id": "a"}, {"axis": 1, "code": 2, "label": "MSFT", "stable_id": "m"}]
    for bad in ([], days[:1] + codes, [{"axis": 0, "text": "x"}, *days[1:], *codes], [*days, *codes, {"axis": 7, "number": 1}]):
        rejects(s.append, x, coordinates=bad)
    assert s.meta()["dim_lens"] == (0, 2)
    s.append(x, coordinates=days + codes, dictionary=words)
    found, payload = s.read_at_coordinate(0, "i64", 20260601)
    assert found.status == "unique"
    same(payload, np.array([[3.0, 4.0]]))
    assert s.read_at_coordinate(0, "i64", 1) == (C.Lookup("missing"), None)
    assert s.lookup(1, "label", "MSFT").positions == (1,)
    assert s.lookup(1, "alias", "x").status == "unsupported" and s.lookup(1, "i64", 5).category == "lookup_domain_mismatch"
    assert s.lookup_range(1, 0, 5).status == "error"
    found, payload = s.read_coordinate_range(0, 20260531, 20260601)
    assert (found.status, found.start, found.end) == ("range", 0, 1)
    rejects(s.append, x, coordinates=days, dictionary=words[:1])
    first = s.head_commit()
    s.append(x, coordinates=[{"axis": 0, "number": 20260602}, {"axis": 0, "number": 20260603}, {"axis": 1, "code": 3, "pos": 2}], dictionary=[{"axis": 1, "code": 3, "label": "NEW"}])
    assert s.lookup(1, "label", "NEW", seq=first).status == "missing" and s.lookup(1, "label", "NEW").status == "unique"
    co, spec = s.coordinates(), s.axis_spec(0)
    assert C.index_of(co, spec, 20260531, "i64") == 0 and C.range_of(co, spec, 20260601, 20260699, "i64") == (1, 4)
    rejects(C.index_of, co, spec, 5, "i64")
    rejects(C.index_of, co, spec, 20260531, "i32")
    rejects(C.range_of, co, spec, 1, 2, "i64")
    assert C.declarations(co, 0).head().asDict() == {"sorted": True, "monotonic": True, "unique": True}
    assert C.lookup(co, C.Axis(0, "external"), "i64", 1).status == "unavailable"


def test_parquet_companion_out_of_order(spark, tmp_path, t):
    rows = companions.flat_rows(t)
    companions.write_parquet(t, str(tmp_path / "p"))
    kept = spark.read.parquet(str(tmp_path / "p"))
    kept.coalesce(1).orderBy(F.desc("flat_index")).write.parquet(str(tmp_path / "down"))
    rejects(companions.read_parquet, spark, str(tmp_path / "down"))
    kept.repartition(3, "flat_index").sortWithinPartitions("flat_index").write.parquet(str(tmp_path / "mixed"))
    rejects(companions.read_parquet, spark, str(tmp_path / "mixed"))
    assert rows.count() == kept.count()


def test_companions(spark, tmp_path, t):
    companions.write_csv(t, str(tmp_path / "csv"))
    same(companions.read_csv(spark, str(tmp_path / "csv"), check_order=False), A)
    companions.write_parquet(t, str(tmp_path / "p"))
    same(companions.read_parquet(spark, str(tmp_path / "p")), A)
    rejects(companions.read_parquet, spark, str(tmp_path / "p"), "f32")
    same(companions.from_ipc(spark, companions.to_ipc(t)), A)
    rejects(companions.from_ipc, spark, b"nonsense")
    plain = tmp_path / "plain"
    t.cells.selectExpr("i0 * 2 + i1 as flat_index", "value").write.parquet(str(plain))
    rejects(companions.read_parquet, spark, str(plain))
    bad = tmp_path / "bad.csv"
    head = "record,dtype,shape,order,flat_index,value\nmetadata,f64,2x1,row_major,,\n"
    for body in ("value,,,,1,2.0\nvalue,,,,0,1.0\n", "value,,,,0,1.0\n", "value,,,,0,x\nvalue,,,,1,2\n", "other,,,,0,1\nvalue,,,,1,2\n"):
        bad.write_text(head + body)
        rejects(companions.read_csv, spark, str(bad))
    bad.write_text("a,b\n1,2\n")
    rejects(companions.read_csv, spark, str(bad))


def test_metadata_edits(spark, tmp_path):
    s = TensorStore.create(spark, str(tmp_path / "m"), "f64", (2,))
    s.set_dim_name(1, "symbol")
    s.set_user_kv("a", "b")
    assert s.meta()["names"]["1"] == "symbol" and s.meta()["kv"] == {"a": "b"} and s.index_checkpoint_every() == 1
    for bad in (lambda: s.set_dim_name(1, ""), lambda: s.set_dim_name(1, "a\0"), lambda: s.index_checkpoint_every(0), lambda: s.set_compression("lz")):
        rejects(bad)
    rejects(TensorStore.create, spark, str(tmp_path / "m"), "f64", (2,))


def test_stream_ingest(spark, tmp_path):
    from tesserine.streaming.ingest import ingest, slice_of

    src = tmp_path / "in"
    spark.createDataFrame([(0, 1.0), (1, 2.0), (1, 3.0)], "u int, v double").write.parquet(str(src))
    s = TensorStore.create(spark, str(tmp_path / "st"), "f64", (2,))
    stream = spark.readStream.schema("u int, v double").parquet(str(src))
    for _ in range(2):
        ingest(stream, s, lambda b: slice_of(b, ["u"], "v", "f64", (2,)), str(tmp_path / "ck")).awaitTermination()
    same(s.read_all(), np.array([[1.0, 5.0]]))
