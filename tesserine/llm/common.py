"""What the operators of this folder share: tables, shared storage, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, return.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch that a function is given at once, about; a single row may be longer.
PART_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one is set only where none is configured and Spark runs on this machine alone, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            where = found.get()
        elif not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            where = tempfile.mkdtemp(prefix="tesserine-")
            spark.sparkContext.setCheckpointDir(where)
    return where


def stash(df: DataFrame, name: str, sorted_by: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """df written as a Parquet table, in the shared folder if no path is given, and read again: its lineage ends here."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.sortWithinPartitions(*sorted_by) if sorted_by else df
    out.write.option("compression", "zstd").parquet(path)
    return restored(spark, path, df.schema)


def restored(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table that stash wrote, which unstash deletes."""
    found = spark.read.schema(schema).parquet(path)
    found._stash_path = path
    return found


def unstash(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stash_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def mapped(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow of a function of one batch; batches of long texts are handed on in parts of about `PART_BYTES`."""

    def run(batches):
        for batch in batches:
            step = max(1, int(batch.num_rows * PART_BYTES / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield from function(batch.slice(at, step))
        released()

    return df.mapInArrow(run, schema)


def as_rows(docs: DataFrame) -> DataFrame:
    """docs as one column `row`, so that columns of any name stand beside an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def with_own(rows: DataFrame, *own: str) -> DataFrame:
    """The columns of `row` and an operator's own ones; of columns with one name the operator's stays."""
    taken = {c.lower() for c in own}
    return rows.select(*(F.col(f"row.`{c}`") for c in rows.schema["row"].dataType.names if c.lower() not in taken), *own)


def field(schema_row: T.StructType, name: str) -> int:
    """The place of a column among the row's fields, by name as Spark compares it; -1 if there is none."""
    return next((i for i, c in enumerate(schema_row.names) if c.lower() == name.lower()), -1)


def released() -> None:
    """Give free memory of this Python worker back: workers outlive their tasks and keep what they grew."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its offsets (rows + 1); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, at = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + at)[at:]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def with_turn(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with turn, the number of the text among the different ones under its doc_id: 0 but for repeated doc_ids."""
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    twice = docs.select("doc_id", digest.alias("h")).groupBy("doc_id").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y and doc_id is not null")
    if twice.isEmpty():
        return docs.select("doc_id", "text", F.lit(0).alias("turn"))
    hashed = docs.select("doc_id", "text", digest.alias("h"))
    several = hashed.join(twice.select("doc_id").hint("merge"), "doc_id", "left_semi").select("doc_id", "h").distinct()
    turns = several.select("doc_id", "h", (F.row_number().over(Window.partitionBy("doc_id").orderBy("h")) - 1).alias("turn"))
    return hashed.join(turns.hint("merge"), ["doc_id", "h"], "left").select("doc_id", "text", F.coalesce("turn", F.lit(0)).alias("turn"))


def word_counters(frames: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], counters: int, parts: int = 64) -> np.ndarray:
    """The binary logarithm, rounded up, of the number of 64-bit hashes that fall on each counter, over all rows of frames.

    counters is a power of two and bounds what comes to the driver: a byte each. Every task sends its own sums.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            step = max(1, int(batch.num_rows * PART_BYTES / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                for found in hashes(batch.slice(at, step)):
                    counts = np.zeros(counters, np.uint32) if counts is None else counts
                    where, n = np.unique(counter_of(found, counters), return_counts=True)
                    counts[where] += n.astype(np.uint32)
        if counts is not None:
            for i, part in enumerate(np.split(counts, parts)):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], ["part", "counts"])
        counts = None
        released()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                found = np.frombuffer(pa.decompress(raw, 4 * counters // parts, "zstd", asbytes=True), np.uint32)
                sums[i] = sums[i] + found if i in sums else found.astype(np.uint64)
        for i, found in sums.items():
            level = np.ceil(np.log2(np.maximum(found, 1))).astype(np.uint8) + (found > 0)
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([level.tobytes()], pa.binary())], ["part", "level"])

    counted = frames.mapInArrow(count, "part long, counts binary").repartition("part").mapInArrow(add, "part long, level binary")
    out = np.zeros((parts, counters // parts), np.uint8)
    for r in counted.collect():
        out[r["part"]] = np.frombuffer(r["level"], np.uint8)
    return out.ravel()


def counter_of(hashes: np.ndarray, counters: int) -> np.ndarray:
    return (hashes & np.uint64(counters - 1)).astype(np.int64)


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b) as rows (node, component), component the smallest node reached.

    Alternating star contraction on DataFrames: in each round every node hands its smallest neighbour on
    to its others (large star) and to its smaller neighbours (small star). A round's edges are written to
    the shared folder; rounds grow with the logarithm of the longest path. Only nodes with an edge are returned.
    """
    spark = edges.sparkSession
    now = stash(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after = stash(small, "edges")
        # A star forest: every node has one edge, and no centre hangs on another.
        rest = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        deep = after.select(F.col("b").alias("a")).distinct().join(after.select("a").distinct(), "a", "left_semi")
        done = rest.union(deep).isEmpty()
        unstash(now)
        now = after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres)


def session_for_tests() -> SparkSession:
    return (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
