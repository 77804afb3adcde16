"""Incremental removal of repeated word windows with a log-structured fingerprint index.

Documents come in batches of ascending doc_id. The index is a list of immutable runs: Parquet tables, sorted
by fingerprint, of what earlier batches held. Each batch

1. takes the fingerprints of its 50-word windows, grouped by content-chosen anchors (see `anchors`), so that a
   fingerprint row stands for a run of consecutive windows;
2. merge-joins them with every run of the index and with itself;
3. verifies: rows whose whole run of windows is equal (128 bits of hash over all its words) are copies; where
   only the anchor is shared, the words of one representative per distinct run are fetched and compared window
   by window; under a key with more than `HOT` distinct runs these are cut, once for all batches, into shorter runs
   by longer anchors and settled in the same way; where that leaves hot keys, runs are cut into single windows, of which
   equal ones (128 bits of hash over all words) are brought to their first document before they meet;
4. is appended as a new sorted run of level 0; when a level has `fan_in` runs, they are compacted: merged into one of
   the next level that keeps the first document of equal rows.

`dedup_words` runs several batches and fetches the words to compare (step 3) for all of them at once. With an index under
a path (`FingerprintIndex.opened`) a later job goes on where an earlier one ended.

Edges: null texts have no words; fewer words than a window removes nothing; a window repeated within one
document only is kept; rows with one doc_id count as one document, and different texts under one as its parts, which no
window crosses; documents with a null doc_id neither remove anything nor lose anything; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log import CommitLog
from . import anchors
from .common import mapped, restored, stash, texts_of, unstash, with_turn

WINDOW, GRAM = 50, 16
BATCHES, FAN_IN = 3, 2
RUN = "key long, snip long, doc_id long, place long"
CHUNK = 1 << 21
#: Distinct runs under one key that are compared in one group.
HOT = 1000
#: Runs of hot keys are grouped again by anchors so many words shorter than a window.
FINE = 10
#: A text's turn under its doc_id stands above its places.
TURN = 40
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word in the bytes, and the words' offsets by document."""
    inside = ~_SPACE[data]
    step = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # A word never spans two documents: cut at their borders.
    border = offsets[1:-1]
    border = np.unique(border[(border > 0) & (border < len(data))])
    cut = border[inside[border - 1] & inside[border]] if len(border) else border
    if len(cut):
        begin, end = np.sort(np.concatenate((begin, cut))), np.sort(np.concatenate((end, cut)))
    return begin, end, np.searchsorted(begin, offsets, "left")


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(begin), np.uint64)
    size = anchors.BLOCK
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + size, "right")))
        base = begin[at]
        total = anchors.sums(data[base : end[to - 1]].astype(np.uint64) + np.uint64(1))
        out[at:to] = anchors.spans(total, begin[at:to] - base, end[at:to] - base)
        at = to
    return out


def _found(window: int, gram: int):
    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = texts_of(batch.column("text"))
        begin, end, words = word_places(data, offsets)
        symbols = word_hashes(data, begin, end)
        ids, turn = batch.column("doc_id"), batch.column("turn").to_numpy().astype(np.int64)
        for row, start, count, key, snip in anchors.runs(symbols, words, window, gram):
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(snip), ids.take(pa.array(row)), pa.array((start + (turn[row] << TURN)) * 256 + count)],
                ["key", "snip", "doc_id", "place"],
            )

    return find


def _wanted(batch: pa.RecordBatch, window: int):
    """The batch's words (raw, begin, end) and its wanted runs: row, first word, windows, (key, place, fresh)."""
    data, offsets = texts_of(batch.column("text"))
    begin, end, words = word_places(data, offsets)
    wanted = batch.column("wanted")
    flat = wanted.flatten()
    row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(wanted).to_numpy())
    turn = flat.field("place").to_numpy() >> (TURN + 8)
    mine = np.flatnonzero(turn == batch.column("turn").to_numpy()[row])
    key, place, fresh = (flat.field(c).take(pa.array(mine)) for c in ("key", "place", "fresh"))
    row = row[mine]
    start, count = np.divmod(place.to_numpy(), 256)
    first = words[row] + (start & ((1 << TURN) - 1))
    return (data.tobytes(), begin, end), row, first, count, (key, place, fresh)


def _snippets(window: int):
    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (raw, begin, end), row, first, count, (key, place, fresh) = _wanted(batch, window)
        a, b = begin[first], end[first + count + window - 2]
        pieces = [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        for i in range(0, len(pieces), 2048):
            yield pa.RecordBatch.from_arrays(
                [key.slice(i, 2048), batch.column("doc_id").take(pa.array(row[i : i + 2048])), place.slice(i, 2048), fresh.slice(i, 2048), pa.array(pieces[i : i + 2048], pa.binary())],
                ["key", "doc_id", "place", "fresh", "bytes"],
            )

    return cut


def _pieces(window: int, gram: int):
    """Runs of hot keys as shorter runs, about one for (window - gram) / 2 windows: key, snip, doc_id, place, fresh."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (raw, begin, end), row, first, count, (_, place, fresh) = _wanted(batch, window)
        symbols, start = word_hashes(np.frombuffer(raw, np.uint8), begin, end), place.to_numpy() // 256
        for i in range(0, len(row), 2048):
            n = count[i : i + 2048] + window - 1
            offsets = np.concatenate(([0], np.cumsum(n)))
            at = np.arange(offsets[-1]) + np.repeat(first[i : i + 2048] - offsets[:-1], n)
            for which, step, windows, key, snip in anchors.runs(symbols[at], offsets, window, gram):
                which = which + i
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(snip), batch.column("doc_id").take(pa.array(row[which])), pa.array((start[which] + step) * 256 + windows), fresh.take(pa.array(which))],
                    ["key", "snip", "doc_id", "place", "fresh"],
                )

    return cut


def _windows(window: int):
    """Runs of hot keys as single windows: two halves of a hash of key and words, doc_id, begin, fresh."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (raw, begin, end), row, first, count, (key, place, fresh) = _wanted(batch, window)
        keys = key.to_numpy()
        for i in range(0, len(row), 2048):
            digests = []
            for x, n, k in zip(first[i : i + 2048].tolist(), count[i : i + 2048].tolist(), keys[i : i + 2048].tolist(), strict=True):
                to = x + n + window - 1
                run = [raw[a:b] for a, b in zip(begin[x:to].tolist(), end[x:to].tolist(), strict=True)]
                salt = k.to_bytes(8, "little", signed=True)
                digests += [hashlib.blake2b(b" ".join(run[j : j + window]), digest_size=16, salt=salt).digest() for j in range(n)]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            of = np.repeat(np.arange(i, min(i + 2048, len(row))), count[i : i + 2048])
            at = np.arange(len(of)) - np.repeat(np.cumsum(count[i : i + 2048]) - count[i : i + 2048], count[i : i + 2048])
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), batch.column("doc_id").take(pa.array(row[of])), pa.array(place.to_numpy()[of] // 256 + at), fresh.take(pa.array(of))],
                ["high", "low", "doc_id", "begin", "fresh"],
            )

    return cut


def _compared(window: int):
    """Groups of representatives under one key, to the word spans (doc_id, begin, end) of fresh ones that an earlier document holds."""

    def solve(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .suffix_dedup import _binary

        t = pa.Table.from_batches(rows)
        data, offsets = _binary(t.column("bytes"))
        begin, end, words = word_places(data, offsets)
        symbols = word_hashes(data, begin, end)
        place = t.column("place").to_numpy()
        start, count = place // 256, place % 256
        ids = t.column("doc_id").to_numpy(zero_copy_only=False)
        fresh = t.column("fresh").to_numpy(zero_copy_only=False)
        which = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        at = words[which] + step
        sizes = end - begin
        total = anchors.sums(symbols)
        content = anchors.spans(total, at, at + window)
        order = np.lexsort((ids[which], content))
        same = content[order][1:] == content[order][:-1]
        head = np.zeros(len(order), np.int64)
        head[1:] = np.where(same, 0, np.arange(1, len(order)))
        head = np.maximum.accumulate(head)
        first = order[head]
        hit = np.flatnonzero((ids[which[order]] > ids[which[first]]) & fresh[which[order]])
        for i in range(0, len(hit), 100_000):  # the words themselves decide
            part = hit[i : i + 100_000]
            mine, theirs = at[order[part]], at[first[part]]
            good = np.ones(len(part), bool)
            for k in range(window):
                good &= symbols[mine + k] == symbols[theirs + k]
                good &= sizes[mine + k] == sizes[theirs + k]
            found = order[part[good]]
            if len(found):
                s = start[which[found]] + step[found]
                yield pa.RecordBatch.from_arrays([pa.array(ids[which[found]], pa.int64()), pa.array(s), pa.array(s + window)], ["doc_id", "begin", "end"])

    from .suffix_dedup import by_group

    return lambda batches: by_group(batches, solve, CHUNK)


class FingerprintIndex:
    """Sorted immutable runs (key, snip, doc_id, place) of what earlier batches held, in levels.

    A batch is a run of level 0. As soon as a level has `fan_in` runs they are merged into one of the next level, which
    keeps the first of equal rows, so a row is written again once for each level, not for each batch. With a path the runs stand under
    it and a commit names them after each change, so a later job goes on with `opened`; without one they last as long as the object.
    A batch is in the index as soon as its commit stands, whether or not the job that brought it ends well.
    """

    def __init__(self, fan_in: int = FAN_IN, log: CommitLog | None = None):
        self.fan_in, self.log = fan_in, log
        self.runs: list[tuple[int, str | None, DataFrame]] = []  # (level, folder, rows)
        self.upto: int | None = None

    @classmethod
    def opened(cls, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, fan_in: int = FAN_IN) -> FingerprintIndex:
        """The index under a path, a new one if there is none; its windows must be of the same make."""
        index = cls(fan_in, CommitLog(spark, path))
        index.make = {"window": window, "gram": gram}
        if index.log.sequences():
            head = index.log.head()
            if head["make"] != index.make:
                raise ValueError(f"the index under {path} holds windows of {head['make']}")
            index.upto = head["upto"]
            index.runs = [(level, folder, restored(spark, index.log.full(folder), RUN)) for level, folder in zip(head["levels"], head["folders"], strict=True)]
        return index

    def rows(self) -> DataFrame | None:
        return reduce(DataFrame.union, (rows for _, _, rows in self.runs)) if self.runs else None

    def stored(self, run: DataFrame) -> tuple[str | None, DataFrame]:
        """A run written in order, where the index lives."""
        folder = self.log.new_folder() if self.log else None
        return folder, stash(run, "index", ("key", "snip"), self.log.full(folder) if folder else None)

    def append(self, folder: str | None, run: DataFrame, upto: int | None = None) -> None:
        """Take a stored table as the next run; upto: the greatest doc_id that it covers."""
        self.runs.append((0, folder, run))
        self.upto = upto if upto is not None else self.upto
        merged = self._compact()
        if self.log:
            generation = self.log.head()["generation"] + 1 if self.log.sequences() else 1
            body = {"generation": generation, "levels": [x[0] for x in self.runs], "folders": [x[1] for x in self.runs], "upto": self.upto, "make": self.make}
            self.log.commit(body)
        unstash(*merged)  # after the commit that no longer names them

    def _compact(self) -> list[DataFrame]:
        """Merge full levels, from the lowest on; the runs that are merged now."""
        gone, level = [], 0
        while len(own := [x for x in self.runs if x[0] == level]) >= self.fan_in:
            both = reduce(DataFrame.union, (rows for _, _, rows in own))
            first = both.groupBy("key", "snip").agg(F.min(F.struct("doc_id", "place")).alias("first"))
            merged = self.stored(first.select("key", "snip", "first.doc_id", "first.place"))
            self.runs = [x for x in self.runs if x[0] != level] + [(level + 1, *merged)]
            gone += [rows for _, _, rows in own]
            level += 1
        return gone


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """doc_id bounds of batches of about equal row counts."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("c")).head()
    return sorted(set(cuts["c"] or []))


def _settled(found: DataFrame, classes: DataFrame, window: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Spans (doc_id, begin, end) of found runs that are copied whole, and runs (key, doc_id, place, fresh, hot) to compare.

    classes: a row for each distinct run (key, snip), with its first place, whether it is among found, and the last document there.
    """
    per_key = classes.groupBy("key").agg(F.count("*").alias("kinds"), F.max("fresh").alias("any_fresh"))
    copied = classes.where("most > first.doc_id").select("key", "snip", F.col("first.doc_id").alias("holder"))
    whole = (
        found.join(copied.hint("merge"), ["key", "snip"]).where("doc_id > holder")
        .select("doc_id", F.expr("place div 256").alias("begin"), F.expr(f"place div 256 + place % 256 + {window - 1}").alias("end"))
    )
    whole = stash(whole, "spans")
    several = per_key.where("kinds > 1 and any_fresh").select("key", (F.col("kinds") > hot).alias("hot"))
    named = classes.join(several.hint("merge"), "key").select("key", "snip", F.col("first.doc_id").alias("doc_id"), F.col("first.place").alias("place"), F.col("first.fresh").alias("fresh"), "hot")
    # A run that its first document holds twice is looked at in both places.
    again = found.join(named.where("fresh").select("key", "snip", "doc_id", "hot").hint("merge"), ["key", "snip", "doc_id"])
    return whole, stash(named.select("key", "doc_id", "place", "fresh", "hot").union(again.select("key", "doc_id", "place", F.lit(True), "hot")).distinct(), "wanted")


def candidates(batch: DataFrame, index: FingerprintIndex, window: int = WINDOW, gram: int = GRAM, last: bool = False, hot: int = HOT, upto: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge-join a batch with the index: spans (doc_id, begin, end) of copied runs, and runs (key, doc_id, place, fresh, hot) to compare.

    Runs that share a key only are compared by `verified`. The batch joins the index. last: nothing follows, so
    the index is left as it is. upto: the greatest doc_id of the batch.
    """
    every = mapped(batch.select("doc_id", "text", "turn"), _found(window, gram), RUN).where("doc_id is not null")
    folder, every = index.stored(every)
    history = index.rows()
    # Keys that occur once, in the batch and in the index together, have nothing to say.
    keys = every.select("key", F.lit(True).alias("fresh"))
    if history is not None:
        keys = keys.union(history.select("key", F.lit(False)))
    live = stash(keys.groupBy("key").agg(F.count("*").alias("n"), F.max("fresh").alias("fresh")).where("n > 1 and fresh").select("key"), "keys")
    found = stash(every.join(live.hint("merge"), "key", "left_semi"), "fingerprints")
    fresh = found.groupBy("key", "snip").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max("doc_id").alias("most"))
    both = fresh.select("key", "snip", "first.doc_id", "first.place", F.lit(True).alias("fresh"), "most")
    if history is not None:
        old = history.join(live.hint("merge"), "key", "left_semi")
        both = both.union(old.select("key", "snip", "doc_id", "place", F.lit(False), F.lit(None).cast("long")))
    # One row per distinct run: its first document ever, whether the batch has it, and the last document of the batch that has it.
    classes = both.groupBy("key", "snip").agg(
        F.min(F.struct("doc_id", "place", "fresh")).alias("first"), F.max("fresh").alias("fresh"), F.max("most").alias("most")
    )
    classes = stash(classes, "classes")
    whole, wanted = _settled(found, classes, window, hot)
    unstash(live, found, classes)
    if last:
        unstash(every)
    else:
        index.append(folder, every, upto)
    return whole, wanted


def verified(docs: DataFrame, wanted: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """Spans (doc_id, begin, end) of fresh runs' windows that an earlier document's run under the same key holds word by word.

    Runs that several batches want are fetched once, and a key that is hot in one batch is hot for all.
    """

    def held(runs: DataFrame, moved: bool = False) -> DataFrame:
        lists = runs.groupBy("doc_id").agg(F.collect_list(F.struct("key", "place", "fresh")).alias("wanted"))
        # Few lists of hot keys' runs are broadcast, so that no text moves for them; for the others texts move as they do for the removal.
        lists = lists.hint("merge") if moved else stash(lists, "lists")
        return docs.join(lists, "doc_id").select("doc_id", "text", "turn", "wanted")

    def by_heat(wanted: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        once = wanted.groupBy("key", "doc_id", "place").agg(F.max("fresh").alias("fresh"))
        if wanted.where("hot").isEmpty():
            return once, None
        keys = F.broadcast(wanted.where("hot").select("key").distinct())  # of many runs each
        return once.join(keys, "key", "left_anti"), once.join(keys, "key", "left_semi")

    def compared(held: DataFrame) -> DataFrame:
        texts = mapped(held, _snippets(window), "key long, doc_id long, place long, fresh boolean, bytes binary")
        return texts.repartition("key").sortWithinPartitions("key").mapInArrow(_compared(window), "doc_id long, begin long, end long")

    cold, several = by_heat(wanted)
    out = compared(held(cold, moved=True))
    if several is None:
        return out
    # Under longer anchors few of the runs that are alike but for a word meet, and those that do differ near their ends only.
    found = stash(mapped(held(several), _pieces(window, window - FINE), f"{RUN}, fresh boolean"), "pieces")
    classes = found.groupBy("key", "snip").agg(
        F.min(F.struct("doc_id", "place", "fresh")).alias("first"), F.max("fresh").alias("fresh"), F.max(F.when(F.col("fresh"), F.col("doc_id"))).alias("most")
    )
    whole, wanted = _settled(found.where("fresh").drop("fresh"), stash(classes, "classes"), window, hot)
    cold, several = by_heat(wanted)
    out = out.union(whole).union(compared(held(cold)))
    if several is None:
        return out
    # Equal windows are counted together before they meet, whatever number of runs holds them; they are written, since both
    # sides of the join would cut them again.
    cut = stash(mapped(held(several), _windows(window), "high long, low long, doc_id long, begin long, fresh boolean"), "windows")
    first = cut.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max(F.when(F.col("fresh"), F.col("doc_id"))).alias("most")).where("most > first")
    alone = cut.where("fresh").join(first.hint("merge"), ["high", "low"]).where("doc_id > first")
    return out.union(alone.select("doc_id", "begin", (F.col("begin") + window).alias("end")))


def _kept(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data, offsets = texts_of(batch.column("text"))
    begin, end, words = word_places(data, offsets)
    raw = data.tobytes()
    out = []
    turns = batch.column("turn").to_pylist()
    for i, spans in enumerate(batch.column("spans").to_pylist()):
        lo, hi, base = int(words[i]), int(words[i + 1]), turns[i] << TURN
        drop = np.zeros(hi - lo + 1, np.int64)
        for x in spans or ():
            if x["begin"] >> TURN == turns[i]:
                drop[x["begin"] - base] += 1
                drop[x["end"] - base] -= 1
        keep = np.flatnonzero(np.cumsum(drop)[:-1] == 0) + lo
        text = b" ".join([raw[a:b] for a, b in zip(begin[keep].tolist(), end[keep].tolist(), strict=True)])
        out.append((hi - lo, hi - lo - len(keep), hashlib.sha256(text).hexdigest()))
    n, removed, digest = zip(*out, strict=True)
    yield pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)],
        ["doc_id", "n_words", "n_removed", "kept_sha256"],
    )


def dedup_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, fan_in: int = FAN_IN, hot: int = HOT, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """Per document what the removal of word windows that smaller doc_ids hold leaves: n_words, n_removed, kept_sha256.

    index, history: an index that stays and the documents (doc_id, text) that it covers; docs come after them, are compared with
    them as well and are in the index afterwards. Of history only the texts of runs in question are read on.
    """
    docs = with_turn(docs.select("doc_id", "text"))
    stays = index is not None
    index, whole, wanted, below, top = index or FingerprintIndex(fan_in), [], [], None, None
    if stays:
        least, top = docs.agg(F.min("doc_id"), F.max("doc_id")).head()
        if index.upto is not None and least is not None and least <= index.upto:
            raise ValueError(f"doc_id {least} does not follow the index, which covers {index.upto}")
        if index.runs and history is None:
            raise ValueError("the texts that the index covers are needed to verify what it finds")
    for upper in [*batch_bounds(docs, batches), None]:
        batch = docs
        if below is not None:
            batch = batch.where(F.col("doc_id") > below)
        if upper is not None:
            batch = batch.where(F.col("doc_id") <= upper)
        spans, runs = candidates(batch, index, window, gram, last=upper is None and not stays, hot=hot, upto=top if upper is None else upper)
        whole.append(spans)
        wanted.append(runs)
        below = upper
    wanted, texts = reduce(DataFrame.union, wanted), docs
    if history is not None:
        asked = history.select("doc_id", "text").join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
        texts = docs.union(with_turn(asked))
    # The texts move once, for the comparison of all batches and for the removal.
    spans = reduce(DataFrame.union, whole).union(verified(texts, wanted, window, hot))
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = docs.join(lists.hint("merge"), "doc_id", "left").select("doc_id", "text", "turn", "spans")
    return mapped(joined, _kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")
