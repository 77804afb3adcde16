"""A commit log of JSON files beside data folders, on any file system that Spark reaches.

Commit n is the file _log/<n, 20 digits>.json, created exclusively: of two writers one fails with lock_unavailable.
Its body carries a checksum; a commit that is torn or does not match is passed over, and of the rest the highest
generation wins. Exclusive creation needs a file system with atomic create, as local disks and HDFS have.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from ..errors import TableError

LOG, DATA = "_log", "data"


class Files:
    """The few operations needed, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        p = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def size(self, name: str) -> int:
        p = self.path(name)
        return self.fs.getContentSummary(p).getLength() if self.fs.exists(p) else 0

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception as e:
            raise TableError("lock_unavailable", f"{name} exists: another writer was first") from e
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Commit:
    seq: int
    body: dict[str, Any]

    def __getitem__(self, key: str):
        return self.body[key]

    def get(self, key: str, default=None):
        return self.body.get(key, default)


def checksum(body: dict) -> int:
    return zlib.crc32(json.dumps(body, sort_keys=True).encode())


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)
        self.root = self.files.root

    @staticmethod
    def name(seq: int) -> str:
        return f"{LOG}/{seq:020d}.json"

    def sequences(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(LOG) if n.endswith(".json") and n[:-5].isdigit()]

    def load(self, seq: int) -> Commit | None:
        """A commit, or None if it is torn or damaged."""
        try:
            raw = json.loads(self.files.read(self.name(seq)))
            return Commit(seq, raw["body"]) if checksum(raw["body"]) == raw["crc32"] else None
        except (ValueError, KeyError, TypeError):
            return None

    def valid(self) -> list[Commit]:
        return [c for c in map(self.load, self.sequences()) if c]

    def head(self) -> Commit:
        """The valid commit of the highest generation; a generation with conflicting commits is rejected, older ones are used.

        Commits are read from the latest on, and no further than a generation that holds.
        """
        same: list[Commit] = []
        agree = lambda: len({checksum(c.body) for c in same}) == 1
        for c in filter(None, map(self.load, reversed(self.sequences()))):
            if same and c["generation"] != same[0]["generation"]:
                if agree():
                    return same[0]
                same = []
            same.append(c)
        if same and agree():
            return same[0]
        raise TableError("corrupt_file", f"no valid commit under {self.root}" if self.sequences() else f"nothing at {self.root}")

    def rejected(self) -> list[int]:
        ok = {c.seq for c in self.valid()}
        return [s for s in self.sequences() if s not in ok]

    def commit(self, body: dict) -> Commit:
        seq = max(self.sequences(), default=0) + 1
        self.files.create(self.name(seq), json.dumps({"body": body, "crc32": checksum(body)}, sort_keys=True))
        return Commit(seq, body)

    def new_folder(self) -> str:
        return f"{DATA}/{uuid.uuid4().hex}"

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def referenced(self) -> set[str]:
        return {f for c in self.valid() for f in c.get("folders", []) + c.get("extra_folders", [])}

    def orphans(self) -> list[str]:
        """Data folders that no valid commit names."""
        used = self.referenced()
        return [f for f in (f"{DATA}/{n}" for n in self.files.names(DATA)) if f not in used]
