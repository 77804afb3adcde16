"""Manifests of tables that are sharded by channel: reading, validation, safe paths, certification."""

from __future__ import annotations

import posixpath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import TableError
from ..operators import records

ENTRY = "channel_id int, relative_path string, row_count long, first_biz_index long, last_biz_index long, min_receive_nano long, max_receive_nano long, order_records long, trade_records long, payload_sha256 string, fingerprint struct<file_bytes:long,fnv1a64:string>"
SCHEMA = f"schema_version int, trading_day int, artifact_format string, payload_width_bytes int, selection_scope string, channel_indivisible boolean, counts struct<channels:int,row_count:long,order_records:long,trade_records:long>, claims struct<default_readiness:boolean,runtime_readiness:boolean,performance_dominance:boolean>, channels array<struct<{ENTRY.replace(' int,', ':int,').replace(' string,', ':string,').replace(' long,', ':long,').replace(' struct<', ':struct<')}>>"
#: Fixed value: the scope whose channels start at index 1.
PREFIX_SCOPE = "contiguous-prefix"


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path)


def entries(manifest: DataFrame) -> DataFrame:
    """A row for each channel, in order of the list."""
    return manifest.select("trading_day", "selection_scope", F.posexplode("channels").alias("position", "c")).select("trading_day", "selection_scope", "position", "c.*")


def path_error(path: str) -> str | None:
    parts = path.split("/") if path else []
    return "unsafe_manifest_path" if not parts or path.startswith("/") or any(p in ("", ".", "..") for p in parts) or ":" in parts[0] or "\\" in path else None


def resolve(root: str, path: str) -> str:
    """A manifest's path under its root; anything that could leave the root is refused."""
    if path_error(path):
        raise TableError("unsafe_manifest_path", f"path {path!r}")
    full = posixpath.normpath(posixpath.join(root, path))
    if not full.startswith(root.rstrip("/") + "/"):
        raise TableError("unsafe_manifest_path", f"path {path!r} leaves the root")
    return full


def inputs(manifest: DataFrame, root: str) -> DataFrame:
    """channel_id, path and expected_rows of every artifact."""
    return entries(manifest).select("channel_id", F.concat(F.lit(root.rstrip("/") + "/"), "relative_path").alias("path"), F.col("row_count").alias("expected_rows"))


def issues(manifest: DataFrame) -> DataFrame:
    """Rows (position, issue) of everything wrong with a manifest; position is null for the manifest as a whole."""
    e = entries(manifest)
    before = F.lag("channel_id").over(Window.partitionBy("trading_day").orderBy("position"))
    bad_path = F.col("relative_path").isNull() | (F.col("relative_path") == "") | F.col("relative_path").rlike(r"^/|^[^/]*:|\\|(^|/)(\.{0,2})(/|$)")
    per = e.withColumn("before", before).select(
        "position",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("channel_id") <= 0, F.lit("channel id is not positive")),
                    F.when(F.col("before") >= F.col("channel_id"), F.lit("channels are not sorted and unique")),
                    F.when(bad_path, F.lit("unsafe_manifest_path")),
                    F.when(F.col("row_count") <= 0, F.lit("no rows")),
                    F.when(F.col("last_biz_index") - F.col("first_biz_index") + 1 != F.col("row_count"), F.lit("index range differs from rows")),
                    F.when(F.col("order_records") + F.col("trade_records") != F.col("row_count"), F.lit("orders and trades differ from rows")),
                    F.when((F.col("selection_scope") == PREFIX_SCOPE) & (F.col("first_biz_index") != 1), F.lit("a prefix starts at 1")),
                )
            )
        ).alias("issue"),
    )
    sums = F.aggregate("channels", F.lit(0).cast("bigint"), lambda a, c: a + c["row_count"])
    whole = manifest.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("schema_version").isNull() | (F.col("schema_version") != 1), F.lit("unsupported_schema_version")),
                    F.when(F.coalesce(F.size("channels"), F.lit(0)) <= 0, F.lit("no channels")),
                    F.when(F.col("counts.channels") != F.size("channels"), F.lit("channel count differs")),
                    F.when(F.col("counts.row_count") != sums, F.lit("row count differs")),
                    F.when(F.col("claims.default_readiness") | F.col("claims.runtime_readiness") | F.col("claims.performance_dominance"), F.lit("claims must be false")),
                )
            )
        ).alias("issue")
    )
    return whole.select(F.lit(None).cast("int").alias("position"), "issue").union(per)


def validate(manifest: DataFrame) -> None:
    found = issues(manifest).head()
    if found:
        kind = found["issue"] if found["issue"] in ("unsafe_manifest_path", "unsupported_schema_version") else "invalid_manifest"
        raise TableError(kind, found["issue"])


def summary(manifest: DataFrame) -> DataFrame:
    """Counts without paths."""

    def total(n: str):
        return F.aggregate("channels", F.lit(0).cast("bigint"), lambda a, c: a + c[n]).alias(n)

    return manifest.select("schema_version", "trading_day", "artifact_format", F.size("channels").alias("channels"), *map(total, ("row_count", "order_records", "trade_records")))


@F.pandas_udf(StringType())
def fnv1a64(content: pd.Series) -> pd.Series:
    """FNV-1a, 64 bits, of binary values, all values advanced together byte by byte; Spark has no such function."""
    values = [b"" if v is None else bytes(v) for v in content]
    size = max(map(len, values), default=0)
    h = np.full(len(values), 0xCBF29CE484222325, np.uint64)
    lengths = np.array([len(v) for v in values])
    for i in range(size):
        live = lengths > i
        byte = np.array([v[i] if len(v) > i else 0 for v in values], np.uint64)
        h = np.where(live, (h ^ byte) * np.uint64(0x100000001B3), h)
    return pd.Series([None if v is None else f"{x:016x}" for v, x in zip(content, h.tolist(), strict=True)])


def certify(manifest: DataFrame, rows: DataFrame, order: str = "row_number") -> DataFrame:
    """A row for each channel of the manifest: its counts against those observed, and the first issue.

    rows: the lanes channel_id, day_key, biz_index, record_kind, receive_nano and the row order of all artifacts.
    """
    want = entries(manifest).select("trading_day", *(F.col(c).alias(f"want_{c}") for c in ("channel_id", "row_count", "first_biz_index", "last_biz_index", "min_receive_nano", "max_receive_nano", "order_records", "trade_records")))
    seen = records.continuity(rows, order=(order,))
    first_issue = F.min_by("issue", F.when(F.col("issue").isNotNull(), F.col(order)))
    got = records.payload_aggregates(rows, order=order).join(seen.groupBy("channel_id").agg(first_issue.alias("continuity"), F.min("day_key").alias("d0"), F.max("day_key").alias("d1")), "channel_id")
    j = want.join(got, F.col("want_channel_id") == F.col("channel_id"), "full_outer")
    differs = lambda n: F.col(f"want_{n}") != F.col(n)
    issue = (
        F.when(F.col("channel_id").isNull(), "missing_artifact")
        .when(F.col("want_channel_id").isNull(), "channel_id_mismatch")
        .when((F.col("d0") != F.col("trading_day")) | (F.col("d1") != F.col("trading_day")), "payload_header_mismatch")
        .when(F.col("continuity").isNotNull(), F.col("continuity"))
        .when(differs("row_count") | differs("order_records") | differs("trade_records"), "row_count_mismatch")
        .when(differs("first_biz_index") | differs("last_biz_index") | differs("min_receive_nano") | differs("max_receive_nano"), "invalid_manifest")
    )
    return j.select(F.coalesce("want_channel_id", "channel_id").alias("channel_id"), "row_count", "first_biz_index", "last_biz_index", "order_records", "trade_records", issue.alias("issue"))


def verify_files(manifest: DataFrame, contents: DataFrame) -> DataFrame:
    """Size, SHA-256 and FNV-1a of artifacts against the manifest; contents has relative_path and content."""
    e = entries(manifest).select("channel_id", "relative_path", "payload_sha256", "fingerprint")
    j = e.join(contents.select("relative_path", "content"), "relative_path", "left")
    issue = (
        F.when(F.col("content").isNull(), "missing_artifact")
        .when((F.col("fingerprint.file_bytes") != F.length("content")) | (F.lower("payload_sha256") != F.sha2("content", 256)) | (F.lower("fingerprint.fnv1a64") != fnv1a64("content")), "checksum_mismatch")
    )
    return j.select("channel_id", issue.alias("issue"))
