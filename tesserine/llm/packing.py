"""Best-fit packing of tokenised documents into fixed-size sequences.

Documents are tokenised whole, closed by an end id, and cut only when longer than the capacity. Sizes of pieces and gaps are integers
up to the capacity. From the largest size on, the pieces of a size, in order of rank, take the smallest gaps that hold
them, one piece a gap, until all have a place; where no gap is left, new sequences open. This works on counts: runs of equal
gaps (first sequence, number) meet runs of equal pieces (first rank, number).

What is decided is a table of such runs, bounded by capacity and pieces per sequence, not by the number of documents; it is made
on the driver (`plan`) and sent out. This departs from distributed successor sweeps over rows with conflicts between
them: with counts no two pieces want one gap. Ranks within a size are given to the rows in
parallel: counts by (part, size) are summed up over parts, and every part numbers its own rows.

Edges: null and empty texts are one piece of the end id; repeated rows are packed as often as they come; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, stash
from .tokens import DEFAULT, vocabulary_path, word_tokenizer

CAPACITY, END = 2048, 0
#: Rows of one part in the numbering.
PART = 20_000


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(path: str, capacity: int, end: int, special: bool):
    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens = word_tokenizer(path, special)
        texts, ids = batch.column("text"), batch.column("doc_id")
        for at in range(0, batch.num_rows, 256):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, found in enumerate(tokens.encode([t or "" for t in texts.slice(at, 256).to_pylist()])):
                whole = np.append(found, np.uint32(end)).astype("<u4")
                for k, (s, n) in enumerate(cuts(len(whole), capacity)):
                    rows.append(at + i), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(whole[s : s + n].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def pieces(docs: DataFrame, vocabulary: str = DEFAULT, capacity: int = CAPACITY, end: int = END, special: bool = True) -> DataFrame:
    """Per piece doc_id, piece, start, length and ids_crc32; special: special tokens' strings get their ids."""
    return mapped(docs.select("doc_id", "text"), _pieces(vocabulary_path(vocabulary), capacity, end, special), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """((size, first rank, number, first sequence, offset) of every run placed, number of sequences)."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # gaps that sequences have, ascending
    placed, opened = [], 0

    def open_gap(size: int, run: tuple[int, int]) -> None:
        if size:
            if size not in gaps:
                gaps[size] = []
                insort(order, size)
            gaps[size].append(run)

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(order, size)
            if at == len(order):
                number = -(-left // (capacity // size))
                open_gap(capacity, (opened, number))
                opened += number
                continue
            gap = order[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            take = min(left, number)
            if take < number:
                open_gap(gap, (first + take, number - take))
            placed.append((size, rank, take, first, capacity - gap))
            open_gap(gap - size, (first, take))
            rank, left = rank + take, left - take
    return placed, opened


def ranked(rows: DataFrame, part_rows: int = PART) -> DataFrame:
    """rows with rank, from 0 within each length."""
    parts = max(1, -(-rows.count() // part_rows))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    sums = dealt.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32"))
    return dealt.withColumn("own", own).join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("own") - 1).drop("part", "own", "base")


def pack(docs: DataFrame, vocabulary: str = DEFAULT, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    found = stash(pieces(docs, vocabulary, capacity, end), "pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    placed, _ = plan(counts, capacity)
    table = np.array(sorted(placed), np.int64).reshape(-1, 5)
    held = docs.sparkSession.sparkContext.broadcast(table)  # bounded by the capacity, see above

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size, first, _, sequence, offset = held.value.T
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        at = np.searchsorted((size << 48) | first, (length << 48) | rank, "right") - 1
        columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return mapped(
        ranked(found).select("doc_id", "piece", "start", "length", "ids_crc32", "rank"),
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
