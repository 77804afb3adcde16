"""Packed records, manifests and market-data functions."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from tesserine.errors import KINDS, TableError
from tesserine.functions import binary
from tesserine.functions import market as M
from tesserine.operators import apps, records
from tesserine.sources import catalog, manifest


def record(kind=1, channel=7, index=1, **at):
    b = bytearray(168)
    b[0:4] = records.MAGIC
    struct.pack_into("<HHHBBB", b, 4, 1, 80, 168, kind, 1, 1)
    struct.pack_into("<Iiqqqq", b, 16, 20260702, channel, index, 5, 1001, 99)
    b[56:65] = b"000001.SZ"
    b[80:87] = b"\x01\x02\x00\x04\x05\x06\x07" if kind == 1 else b"\x01\x02\x03\x00\x05\x06\x00"
    for o in records.WORDS:
        struct.pack_into("<q", b, o, 0 if kind == 1 and o in (104, 112, 152) else o - 100)
    for o, v in at.items():
        b[int(o[1:])] = v
    return b


def test_header_matrix(spark):
    cases = {
        "good order": (record(), None),
        "good trade": (record(2), None),
        "short": (record()[:100], "fixed_binary_width_mismatch"),
        "magic": (record(_0=1), "payload_header_mismatch"),
        "schema": (record(_4=2), "unsupported_schema_version"),
        "header length": (record(_6=81), "payload_header_mismatch"),
        "record length": (record(_8=1), "payload_header_mismatch"),
        "kind": (record(_10=3), "payload_header_mismatch"),
        "family": (record(_11=4), "payload_header_mismatch"),
        "exchange": (record(_12=3), "payload_header_mismatch"),
        "flags": (record(_13=1), "payload_header_mismatch"),
        "tail": (record(_70=1), "payload_header_mismatch"),
        "channel": (record(channel=0), "payload_header_mismatch"),
        "index": (record(index=-1), "payload_header_mismatch"),
        "reserved": (record(_87=1), "payload_header_mismatch"),
        "order padding": (record(_82=1), "payload_header_mismatch"),
        "order word": (record(_105=1), "payload_header_mismatch"),
        "trade padding": (record(2, _86=1), "payload_header_mismatch"),
    }
    df = spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "name string, payload binary")
    got = {r.name: r.error_kind for r in records.decoded_header(df).collect()}
    assert got == {k: e for k, (_, e) in cases.items()}


def test_round_trip(spark):
    df = spark.createDataFrame([(record(),), (record(2, 3, 1 << 40),)], "payload binary")
    lanes = records.to_lanes(df, keep=("payload",))
    records.check_lanes(lanes)
    assert all(bytes(a) == bytes(b) for a, b in lanes.select("payload", records.from_lanes()).collect())
    crossed = records.cross_checked(lanes.withColumn("channel_id", F.col("channel_id") + F.when(F.col("record_kind") == 2, 1).otherwise(0)))
    assert sorted((r.record_kind, r.all_same, r.same_channel_id) for r in crossed.collect()) == [(1, True, True), (2, False, False)]
    with pytest.raises(TableError):
        records.check_lanes(lanes.drop("payload_symbol"))


def test_little_endian_edges(spark):
    values = {"u8": 255, "i8": -128, "u16": 65535, "i16": -1, "u32": 2**32 - 1, "i32": -(2**31), "u64": 2**64 - 1, "i64": -(2**63)}
    for kind, v in values.items():
        raw = v.to_bytes(binary.WIDTHS[kind], "little", signed=v < 0)
        got = spark.createDataFrame([(bytearray(b"\xff" + raw),)], "b binary").select(binary.read_le(F.col("b"), 1, kind), binary.read_le(F.col("b"), 2, kind)).head()
        assert int(got[0]) == v and got[1] is None


def test_projection_rejects(spark):
    for bad in (
        lambda: records.Projection("p", 0, ()),
        lambda: records.Projection("p", 4, (records.Field("a", 1, "u32"),)),
        lambda: records.Projection("p", 4, (records.Field("a", 0, "f32"),)),
        lambda: records.Projection("p", 4, (records.Field("a", 0, "u8"), records.Field("a", 1, "u8"))),
        lambda: records.Projection("p", 4, (records.Field("a", 0, "u8"),)).typed("a", "i8"),
        lambda: records.word_column(89),
    ):
        with pytest.raises(TableError):
            bad()
    p = records.Projection("p", 2, (records.Field("a", 0, "u16"),))
    with pytest.raises(Exception, match="fixed_binary_width_mismatch"):
        records.project(spark.createDataFrame([(bytearray(3),)], "p binary"), p).collect()
    with pytest.raises(Exception, match="null record"):
        records.project(spark.createDataFrame([(None,)], "p binary"), p).collect()
    allowed = records.Projection("p", 2, p.fields, True)
    assert records.project(spark.createDataFrame([(None,)], "p binary"), allowed).head()[0] is None


def test_continuity_kinds(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([1, 2, 2, 5, 3, 4])], "channel_id int, row_number int, biz_index long")
    assert [r.issue for r in records.continuity(df, first=1).orderBy("row_number").collect()] == [None, None, "biz_index_duplicate", "biz_index_gap", "biz_index_regression", None]


ENTRY = {"channel_id": 7, "relative_path": "a/b.parquet", "row_count": 2, "first_biz_index": 1, "last_biz_index": 2, "min_receive_nano": 10, "max_receive_nano": 11, "order_records": 2, "trade_records": 0}


def write(spark, tmp_path, **changes):
    body = {"schema_version": 1, "trading_day": 20260702, "artifact_format": "f", "selection_scope": "contiguous-prefix", "counts": {"channels": 1, "row_count": 2}, "claims": {"default_readiness": False}, "channels": [ENTRY]} | changes
    p = tmp_path / "m.json"
    p.write_text(json.dumps(body, indent=1))
    return manifest.load(spark, str(p))


def test_manifest(spark, tmp_path):
    m = write(spark, tmp_path)
    manifest.validate(m)
    assert manifest.summary(m).head().row_count == 2
    assert manifest.inputs(m, "/root/x").head().path == "/root/x/a/b.parquet"
    for kind, change in {
        "unsupported_schema_version": {"schema_version": 2},
        "unsafe_manifest_path": {"channels": [ENTRY | {"relative_path": "../x"}]},
        "invalid_manifest": {"channels": [ENTRY | {"last_biz_index": 5}]},
    }.items():
        with pytest.raises(TableError) as e:
            manifest.validate(write(spark, tmp_path, **change))
        assert e.value.kind == kind
    for change in ({"claims": {"performance_dominance": True}}, {"channels": [ENTRY, ENTRY]}, {"counts": {"channels": 2}}, {"channels": [ENTRY | {"first_biz_index": 2, "last_biz_index": 3}]}, {"channels": []}):
        with pytest.raises(TableError):
            manifest.validate(write(spark, tmp_path, **change))


def test_paths():
    assert manifest.resolve("/a/b", "c/d.x") == "/a/b/c/d.x"
    for bad in ("", "/etc", "../x", "a/../../x", "./x", "a//b", "c:/x", "a\\b"):
        with pytest.raises(TableError) as e:
            manifest.resolve("/a/b", bad)
        assert e.value.kind == "unsafe_manifest_path"


def test_certification_names_each_failure(spark, tmp_path):
    m = write(spark, tmp_path)

    def issue(rows):
        df = spark.createDataFrame(rows, "channel_id int, day_key int, biz_index long, record_kind int, receive_nano long, row_number int")
        return [r.issue for r in manifest.certify(m, df).orderBy("channel_id").collect()]

    good = [(7, 20260702, 1, 1, 10, 0), (7, 20260702, 2, 1, 11, 1)]
    assert issue(good) == [None]
    assert issue([good[0], (7, 20260702, 3, 1, 11, 1)]) == ["biz_index_gap"]
    assert issue([good[0], (7, 20260702, 1, 1, 11, 1)]) == ["biz_index_duplicate"]
    assert issue([good[0]]) == ["row_count_mismatch"]
    assert issue([(7, 20260701, 1, 1, 10, 0), good[1]]) == ["payload_header_mismatch"]
    assert issue([good[0], (7, 20260702, 2, 1, 12, 1)]) == ["invalid_manifest"]
    assert issue([(8, *x[1:]) for x in good]) == ["missing_artifact", "channel_id_mismatch"]


def test_file_hashes(spark, tmp_path):
    content = b"some bytes"
    h = 0xCBF29CE484222325
    for c in content:
        h = ((h ^ c) * 0x100000001B3) % (1 << 64)
    entry = ENTRY | {"payload_sha256": hashlib.sha256(content).hexdigest(), "fingerprint": {"file_bytes": len(content), "fnv1a64": f"{h:016x}"}}
    m = write(spark, tmp_path, channels=[entry])
    look = lambda b: manifest.verify_files(m, spark.createDataFrame([("a/b.parquet", bytearray(b))], "relative_path string, content binary")).head().issue
    assert look(content) is None and look(b"other byte") == "checksum_mismatch"
    spark.range(3).write.parquet(str(tmp_path / "data"))
    found = catalog.files_manifest(spark, [str(tmp_path / "data")]).cache()
    assert catalog.validate_files(found, found).where("issue is not null").isEmpty()
    assert catalog.validate_files(found.withColumn("file", F.lit("gone")).limit(1), found.limit(0)).head().issue == "io.failure"


def test_market_functions(spark):
    df = spark.createDataFrame([("000001.SZ", 2.675, 20260702093000123), ("600000.XSHG", -1.0, -2026070209), ("x123456", float("inf"), 20260702), ("688001.SH\0\0", 0.005, 1)], "s string, p double, t long")
    rows = df.select(M.symbol_code(F.col("s")).alias("c"), M.price_cents(F.col("p")).alias("p"), M.day_key(F.col("t")).alias("d")).collect()
    assert [r.c for r in rows] == [2000001, 1600000, 9123456, 1688001]
    assert [r.p for r in rows][1:3] == [0, 0] and [r.d for r in rows] == [20260702, 20260702, 20260702, 1]
    with pytest.raises(Exception, match="six-digit"):
        df.limit(1).select(M.symbol_code(F.lit("12.SZ"))).collect()
    assert df.limit(1).select(M.symbol_code(F.lit("12.SZ"), strict=False)).head()[0] is None


def test_loader_and_errors(spark):
    df = spark.createDataFrame([(20260702, 1, i, i) for i in range(10)], "day_key int, partition_key long, order_key long, tie_breaker long")
    from tesserine.operators.bundle import Bundle

    b = Bundle.build(df, apps.EVENT_KEYS, 4)
    assert apps.load(b, ["order_key"], day=20260702, channel=1, limit=5).count() == 5
    with pytest.raises(TableError):
        apps.load(b, symbol=3)
    assert TableError("checksum_mismatch", "x").cause == KINDS["checksum_mismatch"]
