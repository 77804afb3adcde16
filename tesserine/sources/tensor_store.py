"""Tensors on disk: appends as commits, history, rewrites, coordinates, universes and maintenance."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TableError, Unimplemented, invalid
from ..operators import coords as C
from ..operators import shape as S
from ..operators import sparse as SP
from ..operators import tensor as X
from .log import LOG, Commit, CommitLog

LAYOUTS = SP.LAYOUTS
COMPRESSION = {"off": "uncompressed", "auto": "snappy", "on": "zstd"}
SLOTS = "i0 long, family string, version string, extents array<long>"
REMAPS = "family string, from_version string, to_version string, source long, target long"


@dataclass(frozen=True)
class Execution:
    """What a read was asked for and did; Spark's scheduler does the rest."""

    requested_mode: str
    effective_mode: str
    threads: int
    reasons: tuple[str, ...]
    commit: int | None = None
    source: str = "head"


class TensorStore:
    """A tensor under a path; axis 0 grows by appends, one commit each."""

    def __init__(self, log: CommitLog):
        self.log, self.spark = log, log.files.spark

    # --- creation and metadata ------------------------------------------------------------------------

    @staticmethod
    def create(spark: SparkSession, path: str, dtype: str, dims: tuple[int, ...], layout: str = "streaming", blocks: tuple[int, ...] | None = None, hints: dict | None = None, axes: dict[int, C.Axis] | None = None, universe: tuple[str, str, int] | None = None) -> TensorStore:
        """dims: extents of the axes after the append axis. axes: coordinate specs; universe: (family, version, length)."""
        log = CommitLog(spark, path)
        if dtype not in X.DTYPES or layout not in LAYOUTS or any(n <= 0 for n in dims):
            raise invalid("unknown dtype or layout, or an empty axis")
        if axes and universe:
            raise invalid("a tensor has either coordinates or a universe")
        if blocks is not None and (len(blocks) != len(dims) + 1 or any(b <= 0 for b in blocks)):
            raise invalid("one positive block size for each axis is needed")
        if log.files.exists(LOG):
            raise TableError("io", f"{path} exists")
        body = {
            "generation": 1, "kind": "create", "parent": None, "dtype": dtype, "dims": list(dims), "layout": layout, "blocks": list(blocks) if blocks else None, "hints": hints or {}, "length": 0, "folders": [], "extra_folders": [],
            "slots": [], "coordinates": [], "dictionary": [], "remaps": [], "axes": {str(k): vars(a) for k, a in (axes or {}).items()}, "universe": list(universe) if universe else None, "names": {}, "kv": {}, "compression": "auto", "checkpoint_every": 1,
        }
        log.commit(body)
        return TensorStore(log)

    @staticmethod
    def open(spark: SparkSession, path: str) -> TensorStore:
        store = TensorStore(CommitLog(spark, path))
        store.head()
        return store

    def head(self) -> Commit:
        return self.log.head()

    @property
    def path(self) -> str:
        return self.log.root

    def meta(self) -> dict:
        h = self.head()
        return {"rank": len(h["dims"]) + 1, "dtype": h["dtype"], "append_axis": 0, "dim_lens": (h["length"], *h["dims"]), "layout": h["layout"], "chunk_plan": h["blocks"] or [1, *h["dims"]], "names": h["names"], "kv": h["kv"], "axes": h["axes"]}

    def _next(self, kind: str, **changes) -> Commit:
        head = self.head()
        return self.log.commit(dict(head.body) | {"generation": head["generation"] + 1, "kind": kind, "parent": head.seq} | changes)

    def set_dim_name(self, axis: int, name: str) -> None:
        if not name or "\0" in name or not 0 <= axis <= len(self.head()["dims"]):
            raise invalid("a name is empty or holds NUL, or the axis is unknown")
        self._next("metadata", names=self.head()["names"] | {str(axis): name})

    def set_labels(self, axis: int, labels: list[str]) -> None:
        if any(not x or "\0" in x for x in labels):
            raise invalid("a label is empty or holds NUL")
        self._next("metadata", names=self.head()["names"] | {f"labels_{axis}": labels})

    def set_user_kv(self, key: str, value: str) -> None:
        if not key or "\0" in key + value:
            raise invalid("a key is empty or holds NUL")
        self._next("metadata", kv=self.head()["kv"] | {key: value})

    def set_compression(self, mode: str) -> None:
        if mode not in COMPRESSION:
            raise invalid(f"unknown compression {mode}")
        self._next("metadata", compression=mode)

    def index_checkpoint_every(self, commits: int | None = None) -> int:
        if commits is not None:
            if commits < 1:
                raise invalid("zero commits")
            self._next("metadata", checkpoint_every=commits)
        return self.head()["checkpoint_every"]

    # --- appends --------------------------------------------------------------------------------------

    def _store(self, cells: DataFrame, head: Commit) -> str:
        folder = self.log.new_folder()
        cells.sortWithinPartitions(*(c for c in cells.columns if c != "value")).write.option("compression", COMPRESSION[head["compression"]]).parquet(self.log.full(folder))
        return folder

    def append(self, t: X.Tensor, slots: list[tuple[str, str]] | None = None, remaps: list[tuple] | None = None, coordinates: list[dict] | None = None, dictionary: list[dict] | None = None, tag: str | None = None) -> tuple[int, int]:
        """Add slices; returns their [start, end). Payload, coordinates, bindings and remaps are published by one commit or not at all.

        tag: makes the append idempotent; a second append of a tag that the history holds changes nothing.
        """
        head = self.head()
        if tag is not None:
            for c in self.log.valid():
                if c.get("tag") == tag:
                    return tuple(c["range"])
        if t.dtype != head["dtype"] or t.rank != len(head["dims"]) + 1:
            raise invalid("appended tensor has another dtype or rank")
        if head["universe"] is None and list(t.shape[1:]) != head["dims"] and not slots:
            raise invalid(f"appended shape {t.shape} does not fit {head['dims']}")
        start, end = head["length"], head["length"] + t.shape[0]
        bound = slots or ([tuple(head["universe"][:2])] * t.shape[0] if head["universe"] else [(None, None)] * t.shape[0])
        if len(bound) != t.shape[0]:
            raise invalid("one binding for each slot is needed")
        new_coords = self._coordinates(head, coordinates or [], start, t.shape[0])
        new_words = [{"axis": 0, "stable_id": None, "label": None, "alias": None} | d | {"commit": head["generation"] + 1} for d in dictionary or []]
        seen = {(d["axis"], d["code"]) for d in head["dictionary"]}
        for d in new_words:
            if (d["axis"], d["code"]) in seen:
                raise invalid("a dictionary code is declared again")
            seen.add((d["axis"], d["code"]))
        folder = self._store(t.cells.withColumn("i0", F.col("i0") + start), head)
        self._next(
            "append",
            length=end,
            dims=[max(a, b) for a, b in zip(head["dims"], t.shape[1:], strict=True)],
            folders=[*head["folders"], folder],
            slots=head["slots"] + [[start + k, f, v, list(t.shape[1:])] for k, (f, v) in enumerate(bound)],
            remaps=head["remaps"] + [list(r) for r in remaps or []],
            coordinates=head["coordinates"] + new_coords,
            dictionary=head["dictionary"] + new_words,
            range=[start, end],
            tag=tag,
        )
        return start, end

    def _coordinates(self, head: Commit, given: list[dict], start: int, count: int) -> list[dict]:
        """Checked coordinate rows of an append: every declared append-axis coordinate needs one value a slot."""
        out = []
        for key, spec in head["axes"].items():
            axis, kind = int(key), spec["kind"]
            rows = [c for c in given if c["axis"] == axis]
            if kind in ("append_sequence", "external"):
                continue
            if axis == 0 and len(rows) != count:
                raise invalid(f"axis 0 needs {count} coordinates")
            if axis > 0 and not rows and not any(c["axis"] == axis for c in head["coordinates"]):
                raise invalid(f"axis {axis} needs coordinates")
            field = {"i32": "number", "i64": "number", "fixed_text": "text", "dictionary": "code"}[kind]
            for k, c in enumerate(rows):
                if c.get(field) is None or any(c.get(f) is not None for f in ("number", "text", "code") if f != field):
                    raise invalid(f"coordinate of axis {axis} is of another domain")
                text = C.padded(c["text"], spec["width"]) if kind == "fixed_text" else None
                out.append({"axis": axis, "pos": c.get("pos", (start if axis == 0 else 0) + k), "number": c.get("number"), "text": text, "code": c.get("code"), "commit": head["generation"] + 1})
        unknown = {c["axis"] for c in given} - {int(k) for k in head["axes"]}
        if unknown:
            raise invalid(f"axis {unknown.pop()} has no coordinates")
        return out

    def analyze_sparse(self, t: X.Tensor, rule: SP.Rule) -> DataFrame:
        h = self.head()
        return SP.analyze(t, rule, h["layout"], tuple(h["blocks"]) if h["blocks"] else None)

    def append_sparse(self, t: X.Tensor, rule: SP.Rule) -> tuple[str, tuple[int, int] | None]:
        """(outcome, range); rejected appends publish nothing."""
        outcome = self.analyze_sparse(t, rule).head()["outcome"]
        if outcome == "reject":
            return outcome, None
        return outcome, self.append(t if outcome == "dense_fallback" else SP.present(t, rule))

    # --- mutation and history -------------------------------------------------------------------------

    def rewrite(self, entries: list[int], t: X.Tensor) -> None:
        """Replace whole slices; t has one slice for each entry."""
        self.rewrite_slice([entries, *[None] * (t.rank - 1)], t)

    def rewrite_slice(self, selectors: list, t: X.Tensor) -> None:
        """Replace the cells at per-axis selectors (None, (start, end) or a list) by t's, copy-on-write."""
        head = self.head()
        shape = (head["length"], *head["dims"])
        if t.dtype != head["dtype"] or t.dtype not in ("f32", "f64"):
            raise invalid("rewrites take floats of the tensor's dtype")
        if len(selectors) != len(shape) or t.rank != len(shape):
            raise invalid("one selector for each axis is needed")
        lists = [list(range(n)) if s is None else list(range(*s)) if isinstance(s, tuple) else list(s) for s, n in zip(selectors, shape, strict=True)]
        if tuple(map(len, lists)) != t.shape or any(len(set(x)) != len(x) or any(not 0 <= i < n for i in x) for x, n in zip(lists, shape, strict=True)):
            raise invalid("selectors do not fit the shape of the values")
        old, new = self.read_all().cells, t.cells
        hit = old
        for k, x in enumerate(lists):
            m = self.spark.createDataFrame(list(enumerate(x)), f"_from{k} long, i{k} long")
            new = new.withColumnRenamed(f"i{k}", f"_from{k}").join(m, f"_from{k}").drop(f"_from{k}")
            hit = hit.join(m.select(f"i{k}"), f"i{k}", "left_semi")
        axes = t.axes
        cells = old.join(hit.select(*axes), axes, "left_anti").select(*axes, "value").union(new.select(*axes, "value"))
        self._next("rewrite", folders=[self._store(cells, head)])

    def clear_blocks(self, *_):
        raise Unimplemented("clear_blocks")

    def _visible(self) -> list[Commit]:
        """Commits of the head's chain, newest first; popped and reverted ones are not in it."""
        known = {c.seq: c for c in self.log.valid()}
        out, at = [], self.head()
        while at is not None:
            if at["kind"] not in ("pop", "revert"):
                out.append(at)
                at = known.get(at["parent"])
            else:
                at = known.get(at["restores"])
        return out

    def head_commit(self) -> int:
        return self.head().seq

    def list_commits(self, limit: int) -> list[int]:
        if limit < 1:
            raise invalid("limit is zero")
        return [c.seq for c in self._visible()][:limit]

    def _restore(self, kind: str, target: Commit) -> None:
        head = self.head()
        self.log.commit(dict(target.body) | {"generation": head["generation"] + 1, "kind": kind, "parent": head.seq, "restores": target.seq, "tag": None})

    def pop(self, n: int = 1) -> None:
        """Undo the last n appends as a new commit."""
        if n < 1:
            raise invalid("nothing to pop")
        chain = self._visible()
        appends = [i for i, c in enumerate(chain) if c["kind"] == "append"]
        if n > len(appends):
            raise invalid(f"only {len(appends)} appends can be popped")
        self._restore("pop", chain[appends[n - 1] + 1])

    def revert_commit(self, seq: int) -> None:
        target = self.log.load(seq) if seq in self.log.sequences() else None
        if target is None:
            raise invalid(f"unknown commit {seq}")
        self._restore("revert", target)

    # --- reads ----------------------------------------------------------------------------------------

    def read_all(self, seq: int | None = None) -> X.Tensor:
        c = self.head() if seq is None else self.log.load(seq) if seq in self.log.sequences() else None
        if c is None:
            raise invalid(f"unknown commit {seq}")
        shape = (c["length"], *c["dims"])
        axes = ", ".join(f"i{k} long" for k in range(len(shape)))
        schema = f"{axes}, value {X.DTYPES[c['dtype']]}"
        cells = self.spark.read.schema(schema).parquet(*(self.log.full(f) for f in c["folders"])) if c["folders"] else self.spark.createDataFrame([], schema)
        return X.Tensor(cells, c["dtype"], shape)

    def read_all_dense(self, fill: float = 0, seq: int | None = None) -> DataFrame:
        return X.dense(self.read_all(seq), fill)

    def slots(self, seq: int | None = None) -> DataFrame:
        c = self.head() if seq is None else self.log.load(seq)
        df = self.spark.createDataFrame([tuple(s) for s in c["slots"]], SLOTS)
        return df.select("i0", "family", "version", *(F.col("extents")[k].alias(f"n{k + 1}") for k in range(len(c["dims"]))))

    def remaps(self) -> DataFrame:
        rows = [(f, a, b, i, m) for f, a, b, mapping in self.head()["remaps"] for i, m in enumerate(mapping)]
        return self.spark.createDataFrame(rows, REMAPS)

    def read_with_options(self, selectors: list, mode: str = "serial", threads: int = 1, seq: int | None = None) -> tuple[X.Tensor, Execution]:
        if mode not in ("serial", "threads") or threads < 1:
            raise invalid("unknown mode or no threads")
        t = X.select(self.read_all(seq), selectors)
        return t, Execution(mode, "distributed", threads, ("scheduled_by_partitions",), seq, "head" if seq is None else "history")

    def read_with_shape_policy(self, policy: str, fill: float = 0, extents: tuple[int, ...] | None = None, universe: tuple[str, str, int] | None = None, seq: int | None = None) -> DataFrame:
        t, slots = self.read_all(seq), self.slots(seq)
        if policy.startswith("explicit_universe"):
            if universe is None:
                raise invalid("a universe is needed")
            t = S.remapped(t, slots, self.remaps(), *universe)
            return X.dense(S.cropped(t, extents) if extents else t, fill)
        return S.with_policy(t, slots, policy, fill, extents)

    def attributed(self, df: DataFrame, context: dict) -> tuple[DataFrame, str]:
        """The same result and a JSON trace with the caller's context and the plan."""
        return df, json.dumps({"context": context, "commit": self.head_commit(), "plan": df._jdf.queryExecution().executedPlan().toString()})

    # --- coordinates ----------------------------------------------------------------------------------

    def coordinates(self, seq: int | None = None) -> DataFrame:
        c = self.head() if seq is None else self.log.load(seq)
        rows = [tuple(x[k] for k in ("axis", "pos", "number", "text", "code", "commit")) for x in c["coordinates"]]
        for k, a in c["axes"].items():
            if a["kind"] == "append_sequence":
                rows += [(int(k), i, i, None, None, 0) for i in range(c["length"] if k == "0" else c["dims"][int(k) - 1])]
        return self.spark.createDataFrame(rows, C.COORDINATES)

    def dictionary(self, seq: int | None = None) -> DataFrame:
        c = self.head() if seq is None else self.log.load(seq)
        return self.spark.createDataFrame([tuple(x[k] for k in ("axis", "code", "stable_id", "label", "alias", "commit")) for x in c["dictionary"]], C.DICTIONARY)

    def axis_spec(self, axis: int) -> C.Axis:
        spec = self.head()["axes"].get(str(axis))
        if spec is None:
            raise invalid(f"axis {axis} has no coordinates")
        return C.Axis(**spec)

    def lookup(self, axis: int, domain: str, key, seq: int | None = None) -> C.Lookup:
        return C.lookup(self.coordinates(seq), self.axis_spec(axis), domain, key, self.dictionary(seq))

    def lookup_range(self, axis: int, lower: int, upper: int, seq: int | None = None) -> C.Lookup:
        return C.lookup_range(self.coordinates(seq), self.axis_spec(axis), lower, upper)

    def read_at_coordinate(self, axis: int, domain: str, key, seq: int | None = None) -> tuple[C.Lookup, X.Tensor | None]:
        """Lookup and payload of one commit; no payload is read unless the key is unique."""
        seq = self.head_commit() if seq is None else seq
        found = self.lookup(axis, domain, key, seq)
        return found, C.read(self.read_all(seq), self.axis_spec(axis), found)

    def read_coordinate_range(self, axis: int, lower: int, upper: int, seq: int | None = None) -> tuple[C.Lookup, X.Tensor | None]:
        seq = self.head_commit() if seq is None else seq
        found = self.lookup_range(axis, lower, upper, seq)
        return found, C.read(self.read_all(seq), self.axis_spec(axis), found)

    # --- layout and accounting ------------------------------------------------------------------------

    def reform_to(self, path: str, layout: str, blocks: tuple[int, ...] | None = None) -> TensorStore:
        """The current data in another layout, logically unchanged."""
        return self._copied(path, [self.head()], layout, blocks)

    def compact_to(self, path: str) -> TensorStore:
        return self._copied(path, [self.head()], self.head()["layout"], self.head()["blocks"])

    def retain(self, path: str, commits: int) -> TensorStore:
        """A copy with the last commits of the visible history."""
        if commits < 1:
            raise invalid("no commit to retain")
        return self._copied(path, list(reversed(self._visible()[:commits])), self.head()["layout"], self.head()["blocks"])

    def _copied(self, path: str, commits: list[Commit], layout: str, blocks) -> TensorStore:
        if layout not in LAYOUTS:
            raise invalid(f"unknown layout {layout}")
        log = CommitLog(self.spark, path)
        if log.files.exists():
            raise TableError("io", f"{path} exists")
        parent = None
        for c in commits:
            folders = []
            if c["folders"]:
                folder = log.new_folder()
                self.read_all(c.seq).cells.coalesce(max(1, len(c["folders"]) // 4)).write.option("compression", COMPRESSION[c["compression"]]).parquet(log.full(folder))
                folders = [folder]
            parent = log.commit(dict(c.body) | {"folders": folders, "layout": layout, "blocks": list(blocks) if blocks else None, "parent": parent.seq if parent else None, "kind": c["kind"] if parent else "create"})
        return TensorStore(log)

    def analyze_compaction(self) -> DataFrame:
        """One row: bytes of the head, of history and of nothing, the dead ratio, commits."""
        head, files = self.head(), self.log.files
        live = sum(map(files.size, head["folders"]))
        history = sum(map(files.size, self.log.referenced() - set(head["folders"])))
        orphan = sum(map(files.size, self.log.orphans()))
        total = live + history + orphan
        return self.spark.createDataFrame([(live, history, orphan, (history + orphan) / total if total else 0.0, len(self.log.sequences()))], "head_bytes long, history_bytes long, orphan_bytes long, dead_ratio double, commits long")

    def maybe_compact(self, path: str, dead_ratio: float) -> TensorStore | None:
        return self.compact_to(path) if self.analyze_compaction().head()["dead_ratio"] >= dead_ratio else None

    def diagnostics(self) -> DataFrame:
        """One row: bytes and a state; unknown with a reason while commits cannot be classified."""
        bad = self.log.rejected()
        row = self.analyze_compaction().head()
        reason = f"{len(bad)} commits cannot be read" if bad else None
        return self.spark.createDataFrame([("unknown" if bad else "known", reason, row["head_bytes"], row["history_bytes"], row["orphan_bytes"], time.time())], "state string, reason string, head_bytes long, superseded_bytes long, orphan_bytes long, at double")

    def auto_compaction(self, config: dict | None = None) -> None:
        """There is none to get; setting it is not implemented."""
        if config is not None:
            raise Unimplemented("automatic compaction")


def union_of(ts: list[X.Tensor]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.cells for t in ts])
