"""Ordered tables on disk: create, append, open, maintain, copy, fingerprint."""

from __future__ import annotations

import hashlib
import json
import time
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import TableError, invalid
from ..functions.types import Column, columns_of, schema_of
from ..operators import layout
from ..operators.bundle import OWN, Bundle
from .log import LOG, Commit, CommitLog

FINGERPRINT = "tesserine.crc32.v1"
CODECS = ("none", "zstd")


@dataclass(frozen=True)
class WriteReport:
    generation: int
    previous_generation: int | None
    rows: int
    row_groups: int
    chunks: int
    bytes_written: int
    seconds: float


class TableFile:
    """An ordered table under a path. A handle keeps the snapshot that it opened."""

    def __init__(self, log: CommitLog, commit: Commit):
        self.log, self.commit = log, commit
        self.spark = log.files.spark

    # --- writing --------------------------------------------------------------------------------------

    @staticmethod
    def create(spark: SparkSession, path: str, df: DataFrame, columns: list[Column], keys: list[str], dictionaries: dict[int, list] | None = None, group_rows: int = layout.GROUP_ROWS, codec: str = "zstd", level: int | None = None) -> tuple[TableFile, WriteReport]:
        log = CommitLog(spark, path)
        if log.files.exists(LOG):
            raise TableError("io", f"{path} exists")
        known = {c.name: c for c in columns}
        if any(k not in known or not known[k].scalar for k in keys) or len(set(keys)) != len(keys) or not keys:
            raise invalid("ordering keys must be distinct scalar columns")
        _check_widths(df, columns)
        body = {"generation": 0, "previous": None, "folders": [], "stats": [], "rows": 0, "row_groups": 0, "keys": keys, "schema": schema_of(columns).json(), "dictionaries": {str(k): v for k, v in (dictionaries or {}).items()}, "group_rows": group_rows}
        return TableFile(log, Commit(0, body))._write(df, codec, level)

    def append(self, df: DataFrame, codec: str = "zstd", level: int | None = None) -> tuple[TableFile, WriteReport]:
        """A sorted suffix as the next generation; its schema must be the frozen one and its keys follow those before."""
        head = self.log.head()
        columns = columns_of(StructType.fromJson(json.loads(head["schema"])))
        if sorted(df.dtypes) != sorted((f.name, f.dataType.simpleString()) for f in schema_of(columns)):
            raise invalid("appended columns differ from the frozen schema")
        _check_widths(df, columns)
        if head.get("last_key") is not None:
            first = df.select(F.min(F.struct(*head["keys"])).alias("k")).head()["k"]
            if first is not None and list(first) < list(head["last_key"]):
                raise invalid("appended rows do not follow the table's order")
        return TableFile(self.log, head)._write(df, codec, level)

    def _write(self, df: DataFrame, codec: str, level: int | None) -> tuple[TableFile, WriteReport]:
        if codec not in CODECS:
            raise invalid(f"unknown codec {codec}")
        start, old = time.time(), self.commit
        columns = columns_of(StructType.fromJson(json.loads(old["schema"])))
        rows = layout.grouped(df.select(*(c.name for c in columns)), old["keys"], old["group_rows"], old["rows"], old["row_groups"])
        folder, stats = self.log.new_folder(), self.log.new_folder()
        writer = rows.write.option("compression", "uncompressed" if codec == "none" else "zstd")
        if level is not None:
            writer = writer.option("parquet.compression.codec.zstd.level", str(level))
        writer.parquet(self.log.full(folder))
        written = self.spark.read.parquet(self.log.full(folder))
        layout.statistics(written, columns).coalesce(1).write.parquet(self.log.full(stats))
        summary = self.spark.read.parquet(self.log.full(stats)).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.count("*").alias("g")).head()
        last = written.select(F.max(F.struct(*old["keys"])).alias("k")).head()["k"]
        body = dict(old.body) | {
            "generation": old["generation"] + 1,
            "previous": old["generation"] or None,
            "folders": [*old["folders"], folder],
            "extra_folders": [*old.get("extra_folders", []), stats],
            "rows": old["rows"] + summary["n"],
            "row_groups": old["row_groups"] + summary["g"],
            "last_key": old.get("last_key") if last is None else [x if isinstance(x, int | float) else str(x) for x in last],
        }
        head = self.log.sequences()
        if head and self.log.head()["generation"] != old["generation"]:
            raise TableError("lock_unavailable", "another writer committed meanwhile")
        new = TableFile(self.log, self.log.commit(body))
        report = WriteReport(body["generation"], body["previous"], summary["n"], summary["g"], summary["g"] * len(columns), self.log.files.size(folder), time.time() - start)
        return new, report

    # --- reading --------------------------------------------------------------------------------------

    @staticmethod
    def open(spark: SparkSession, path: str, full_payload: bool = False) -> TableFile:
        """The latest valid snapshot; full_payload also reads all data and checks it against the statistics."""
        log = CommitLog(spark, path)
        table = TableFile(log, log.head())
        for f in table.commit["folders"] + table.commit["extra_folders"]:
            if not log.files.exists(f):
                raise TableError("corrupt_file", f"{f} is missing")
        if full_payload:
            table.validate()
        return table

    def clone(self) -> TableFile:
        return TableFile(self.log, self.commit)

    def columns(self) -> list[Column]:
        return columns_of(StructType.fromJson(json.loads(self.commit["schema"])))

    def bundle(self) -> Bundle:
        columns = self.columns()
        schema = StructType.fromJson(json.loads(self.commit["schema"]))
        own = self.spark.createDataFrame([], "row_group_id int, base_row long, row_in_group long").schema
        rows = self.spark.read.schema(StructType(own.fields + schema.fields)).parquet(*(self.log.full(f) for f in self.commit["folders"]))
        stats = self.spark.read.parquet(*(self.log.full(f) for f in self.commit["extra_folders"]))
        entries = [(int(k), i, str(v)) for k, values in self.commit["dictionaries"].items() for i, v in enumerate(values)]
        names = self.spark.createDataFrame(entries, "dictionary_id int, code int, value string")
        return Bundle(rows, columns, self.commit["keys"], stats, names, self.commit["generation"], self.commit["previous"])

    def validate(self) -> None:
        """Metadata against data: contiguous base rows, counts, statistics and order."""
        b = self.bundle()
        now = layout.statistics(b.rows, b.columns)
        same = now.select(sorted(now.columns)).exceptAll(b.stats.select(sorted(now.columns)))
        if not same.isEmpty():
            raise TableError("corrupt_file", "data differ from the statistics")
        end = 0
        for r in b.stats.select("base_row", "rows").orderBy("base_row").collect():
            if r["base_row"] != end:
                raise TableError("corrupt_file", "row groups are not contiguous")
            end += r["rows"]
        if end != self.commit["rows"]:
            raise TableError("row_count_mismatch", "rows differ from the commit")
        layout.check_order(b.rows, b.keys)

    # --- fingerprints ---------------------------------------------------------------------------------

    def fingerprint(self) -> dict[str, str]:
        """Checksums of schema, dictionaries, ordering and row groups, and of all together."""
        b = self.bundle()
        groups = [r.asDict() for r in layout.long_statistics(b.stats, b.columns).orderBy("row_group_id", "column_id").collect()]
        return combined({"schema": self.commit["schema"], "dictionaries": self.commit["dictionaries"], "ordering": self.commit["keys"], "row_groups": groups})

    def plan_certification(self, plan) -> dict:
        b = self.bundle()
        b.validate_plan(plan)
        groups = [r.asDict() for r in b.row_group_summaries(plan).orderBy("row_group_id", "column_id").collect()]
        return {"fingerprint": self.fingerprint(), "row_groups": list(plan.row_groups), "columns": list(plan.columns), "chunks": crc(groups)}

    # --- maintenance ----------------------------------------------------------------------------------

    def analyze(self) -> DataFrame:
        """One row of health: generations, orphaned bytes, rejected commits, issues."""
        log = self.log
        head, orphans, bad = log.head(), log.orphans(), log.rejected()
        missing = [f for f in head["folders"] + head["extra_folders"] if not log.files.exists(f)]
        issues = [f"rejected commit {s}" for s in bad] + [f"missing {f}" for f in missing]
        status = "corrupt" if missing else "orphan_tail" if orphans else "ok"
        row = (status, head["generation"], head["previous"], sum(map(log.files.size, orphans)), len(orphans), len(bad), issues)
        return self.spark.createDataFrame([row], "status string, generation long, previous_generation long, orphan_bytes long, orphan_folders int, rejected_commits int, issues array<string>")

    def cleanup_orphans(self) -> DataFrame:
        """Delete data that no commit names; a second call finds nothing."""
        orphans = self.log.orphans()
        size = sum(map(self.log.files.size, orphans))
        for f in orphans:
            self.log.files.delete(f)
        return self.spark.createDataFrame([(len(orphans), size)], "removed_folders int, removed_bytes long")

    def copy_snapshot(self, path: str) -> tuple[TableFile, int]:
        """Only the selected snapshot, to a path that must not exist; also the bytes left behind."""
        target = CommitLog(self.spark, path)
        if target.files.exists():
            raise TableError("io", f"{path} exists")
        b, folder, stats = self.bundle(), target.new_folder(), target.new_folder()
        b.rows.write.parquet(target.full(folder))
        b.stats.write.parquet(target.full(stats))
        body = dict(self.commit.body) | {"folders": [folder], "extra_folders": [stats]}
        kept = sum(self.log.files.size(f) for f in self.commit["folders"] + self.commit["extra_folders"])
        return TableFile(target, target.commit(body)), max(0, self.log.files.size("data") - kept)


def crc(value) -> str:
    return f"{zlib.crc32(json.dumps(value, sort_keys=True, default=str).encode()):08x}"


def combined(parts: dict) -> dict[str, str]:
    out = {k: crc(v) for k, v in parts.items()}
    return {"algorithm": FINGERPRINT, **out, "combined": crc(out)}


def _check_widths(df: DataFrame, columns: list[Column]) -> None:
    fixed = [c for c in columns if not c.scalar]
    if fixed:
        bad = reduce(lambda a, b: a | b, (F.length(c.name) != c.width for c in fixed))
        if not df.where(bad).isEmpty():
            raise TableError("fixed_binary_width_mismatch", "a value has another width than its column")


# --- manifests of files ---------------------------------------------------------------------------------------


def files_manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Digest, size and rows of each data file under paths; contents are read where the files are."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(paths)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("file_bytes"), F.sha2("content", 256).alias("sha256"), F.crc32("content").alias("crc32"))


def validate_files(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Compatibility of files with a manifest: a row for each, issue null if all is well; missing files are issues, not errors."""
    a, b = manifest.alias("m"), found.alias("f")
    issue = F.when(F.col("f.file").isNull(), "io.failure").when(F.col("m.file").isNull(), "unlisted").when(F.col("m.sha256") != F.col("f.sha256"), "checksum_mismatch").when(F.col("m.file_bytes") != F.col("f.file_bytes"), "size_mismatch")
    return a.join(b, F.col("m.file") == F.col("f.file"), "full_outer").select(F.coalesce("m.file", "f.file").alias("file"), issue.alias("issue"))


def sha256_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


__all__ = ["OWN", "TableFile", "WriteReport", "combined", "crc", "files_manifest", "sha256_of", "validate_files"]
