"""Exact repeats of bytes by the interval tree of enhanced suffix arrays.

A repeat of `length` bytes or more is found wherever its windows' anchors meet (see `anchors`). Four steps:

1. A first reading counts the anchors' keys in a table of `COUNTERS` counters. Runs of keys that are frequent by far are cut into
   single windows under keys of their own, so a passage that a third of all rows hold has no group of its contexts.
2. Every document's runs are hashed. Equal ones of one batch are one row already before the shuffle; the others are known to be
   repeats. Then runs stream by key: those alone under their key are dropped, equal ones are one class, whose first
   occurrence stands for it.
3. For keys with several classes the representatives' bytes meet by key. A suffix array over their window
   starts is built by prefix doubling, with its common-prefix lengths; a stack scan walks the interval tree and
   reports every interval of `length` or more whose occurrences differ in their left neighbour: a maximal repeat
   (within the run's text) with all its occurrences. All but the earliest occurrence are duplicates.
4. Keys that still have more classes than one task should hold (`HOT` and more) have their runs cut into single windows
   after the fact; equal windows are then one class each and are pre-aggregated, so no group is unbounded.

`repeat_groups` gives the maximal repeats of steps 2 and 3 with all their occurrences.

Edges: null texts are empty; texts under `length` bytes have no repeats; equal rows (doc_id and text repeated)
count as occurrences at one place, so neither removes the other; different texts under one doc_id count as parts of
that document, in order of their hashes, that no match crosses; documents with a null doc_id neither remove anything nor lose
anything; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import counter_of, mapped, stash, texts_of, with_turn, word_counters

LENGTH, GRAM = 100, 24
#: Classes under one key from which its runs are cut into windows.
HOT = 20_000
#: Counters of the keys' frequencies; their logarithms are broadcast, a byte each.
COUNTERS = 1 << 22
#: Keys that occur more often than this, beyond four times the counters' average, are cut into windows at once.
FREQUENT = 1 << 13
#: A text's turn under its doc_id stands above its places.
TURN = 40
#: Bytes of representatives that one suffix array covers, at least; groups are never divided.
CHUNK = 1 << 20


def _keys(length: int, gram: int):
    def find(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, _, key, _ in anchors.runs(*texts_of(batch.column("text")), length, gram):
            yield key.view(np.uint64)

    return find


def _found(length: int, gram: int, held, frequent: int):
    """Rows (key, snip, doc_id, place, salt): one for equal runs of a batch with salt -1, the others of them salted; place is start * 256 + windows."""

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(held.value, np.uint8)
        symbols, offsets = texts_of(batch.column("text"))
        ids, turn = batch.column("doc_id"), batch.column("turn").to_numpy().astype(np.int64)
        for row, start, count, key, snip in anchors.runs(symbols, offsets, length, gram):
            often = level[counter_of(key.view(np.uint64), len(level))] >= frequent
            if often.any():  # runs of frequent keys as single windows
                of = np.repeat(np.flatnonzero(often), count[often])
                step = np.arange(len(of)) - np.repeat(np.cumsum(count[often]) - count[often], count[often])
                at = start[of] + step
                window = _window_hashes(symbols, offsets[row[of]] + at, length)
                key = np.concatenate((key[~often], anchors.mix(window ^ key[of].view(np.uint64)).view(np.int64)))
                snip = np.concatenate((snip[~often], window.view(np.int64)))
                row, start = np.concatenate((row[~often], row[of])), np.concatenate((start[~often], at))
                count = np.concatenate((count[~often], np.ones(len(of), np.int64)))
            doc = ids.take(pa.array(row)).to_numpy(zero_copy_only=False)
            place = (start + (turn[row] << TURN)) * 256 + count
            order = np.lexsort((place, doc, snip, key))
            k, s = key[order], snip[order]
            again = np.zeros(len(order), bool)
            again[1:] = (k[1:] == k[:-1]) & (s[1:] == s[:-1])
            # An equal row's place is the first one's too.
            same = np.zeros(len(order), bool)
            d, p = doc[order], place[order]
            same[1:] = again[1:] & (d[1:] == d[:-1]) & (p[1:] == p[:-1])
            salt = np.where(again, (order & 0x3FF).astype(np.int64), -1)
            yield pa.RecordBatch.from_arrays([pa.array(x[~same]) for x in (k, s, d, p, salt)], ["key", "snip", "doc_id", "place", "salt"])

    return find


def _window_hashes(symbols: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(at), np.uint64)
    for i in range(0, len(at), 1 << 15):
        views = symbols[at[i : i + (1 << 15), None] + np.arange(length)]
        up, _ = anchors.powers(length)
        out[i : i + (1 << 15)] = anchors.mix(((views.astype(np.uint64) + np.uint64(1)) * up).sum(1, dtype=np.uint64))
    return out


def _met(most: int):
    """Rows of `_found` in order of (key, salt, snip, doc_id, place) to (kind, key, snip, doc_id, place).

    kind 0: a run that occurs earlier; 1: the first of its class, under a key with several; 2: the same, of more than
    `most` classes.
    """

    def out(kind, key, snip, doc, place) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind)), pa.array(key), pa.array(snip), pa.array(doc), pa.array(place)], ["kind", "key", "snip", "doc_id", "place"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # the first row under the last key and snip seen
        held, size, over = [], 0, None  # class firsts of the last key; the key that is over `most`
        for batch in batches:
            if not batch.num_rows:
                continue
            key, snip, doc, place, salt = (batch.column(c).to_numpy() for c in ("key", "snip", "doc_id", "place", "salt"))
            local = salt >= 0
            if local.any():
                yield out(0, key[local], snip[local], doc[local], place[local])
                key, snip, doc, place = key[~local], snip[~local], doc[~local], place[~local]
            if not len(key):
                continue
            n = len(key)
            fresh = np.ones(n, bool)
            fresh[1:] = (key[1:] != key[:-1]) | (snip[1:] != snip[:-1])
            if first is not None:
                fresh[0] = (int(key[0]), int(snip[0])) != first[:2]
            lead = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            lead_doc = np.where(lead >= 0, doc[lead], first[2] if first else 0)
            lead_place = np.where(lead >= 0, place[lead], first[3] if first else 0)
            again = ~fresh & ((doc != lead_doc) | (place != lead_place))  # equal rows have one place
            if again.any():
                yield out(0, key[again], snip[again], doc[again], place[again])
            first = (int(key[-1]), int(snip[-1]), int(lead_doc[-1]), int(lead_place[-1]))
            rows = [x[fresh] for x in (key, snip, doc, place)]
            if not len(rows[0]):
                continue
            if over is not None:
                streamed = rows[0] == over
                if streamed.any():
                    yield out(2, *(x[streamed] for x in rows))
                rows = [x[~streamed] for x in rows]
                if not len(rows[0]):
                    continue
                over = None
            if held:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            edge = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1])))
            sizes = np.diff(np.append(edge, len(rows[0])))
            if sizes[-1] > most:
                over = int(rows[0][-1])
            done, kinds = edge[-1], np.repeat(sizes, sizes)
            for kind, chosen in ((1, (kinds > 1) & (kinds <= most)), (2, kinds > most)):
                if over is None or kind == 1:
                    chosen[done:] = False
                if chosen.any():
                    yield out(kind, *(x[chosen] for x in rows))
            held = [] if over is not None else [x[done:] for x in rows]
        if held and len(held[0]) > 1:
            yield out(1, *held)

    return meet


def met_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, frequent: int = FREQUENT, counters: int = COUNTERS) -> DataFrame:
    """Rows (kind, key, snip, doc_id, place) of the runs whose key occurs more than once, see `_met`; docs has turn."""
    known = docs.where("doc_id is not null")
    level = word_counters(known.select("text"), _keys(length, gram), counters)
    mean = float((2.0 ** level[level > 0] / 2).mean()) if level.any() else 0.0
    bound = int(np.ceil(np.log2(frequent + 4 * mean))) + 1
    held = docs.sparkSession.sparkContext.broadcast(level.tobytes())
    every = mapped(known, _found(length, gram, held, bound), "key long, snip long, doc_id long, place long, salt long")
    order = ("key", "salt", "snip", "doc_id", "place")
    met = every.repartition("key", "salt").sortWithinPartitions(*order).mapInArrow(_met(hot), "kind long, key long, snip long, doc_id long, place long")
    return stash(met, "runs")


def suffix_ranks(text: np.ndarray, longest: int) -> list[tuple[int, np.ndarray]]:
    """(h, rank of the first h bytes of every suffix) for h = 8, 16, ... up to at least `longest`; prefix doubling."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + n]
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64) + 1
    out, h = [(8, rank)], 8
    while h < longest:
        later = np.zeros(n, np.int64)
        later[: max(0, n - h)] = rank[h:]
        rank = np.unique((rank << 32) | later, return_inverse=True)[1].astype(np.int64) + 1
        h *= 2
        out.append((h, rank))
    return out


def common_prefixes(text: np.ndarray, levels: list[tuple[int, np.ndarray]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes left[i] and right[i], by binary descent over the ranks."""
    n, a, b = len(text), left.copy(), right.copy()
    for h, rank in reversed(levels):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        a, b = a + h * same, b + h * same
    for _ in range(7):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = text[a[inside]] == text[b[inside]]
        a, b = a + same, b + same
        if not same.any():
            break
    return a - left


def maximal_repeats(
    text: np.ndarray, suffixes: np.ndarray, room: np.ndarray, before: np.ndarray, length: int
) -> Iterator[tuple[int, np.ndarray]]:
    """(length, numbers of the suffixes) of every maximal repeat among the given suffixes of `text`.

    room: how far each suffix may be compared. before: what stands left of it, unique negative numbers where the
    run begins. An interval is reported if it is `length` or longer and its left neighbours are not all alike.
    """
    levels = suffix_ranks(text, int(room.max(initial=0)))
    order = np.argsort(levels[-1][1][suffixes], kind="stable")
    at = suffixes[order]
    lcp = np.minimum(common_prefixes(text, levels, at[:-1], at[1:]), np.minimum(room[order][:-1], room[order][1:]))
    long = np.flatnonzero(np.diff(np.concatenate(([0], (lcp >= length).astype(np.int8), [0]))))
    for lo, hi in zip(long[::2].tolist(), long[1::2].tolist(), strict=True):
        yield from _intervals(lcp[lo:hi].tolist(), order[lo : hi + 1], before)


def _intervals(lcp: list[int], members: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The stack scan: lcp[i] is between members[i] and members[i + 1]; a left mark is a byte, or None once it differs."""
    marks = before[members].tolist()
    if len(lcp) == 1:
        if marks[0] != marks[1]:
            yield lcp[0], members
        return
    stack: list[list] = []  # [prefix length, first member, left mark]
    for i, now in enumerate([*lcp, -1]):
        first, mark = i, marks[i]
        while stack and stack[-1][0] >= now:
            top = stack.pop()
            if top[2] != mark:
                top[2] = None
            first, mark = top[1], top[2]
            if top[0] > now:
                if mark is None:
                    yield top[0], members[first : i + 1]
            # an equal one goes on as the same interval
        if now >= 0:
            stack.append([now, first, mark])


def _covered(length: int):
    """Partitions sorted by key with columns key, doc_id, place, left (int, -1 at the start), bytes, to rows doc_id, begin, end."""

    def solve(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        data, offsets = _binary(t.column("bytes"))
        place = t.column("place").to_numpy()
        start, count = place // 256, place % 256
        ids = t.column("doc_id").to_numpy(zero_copy_only=False)
        which = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        suffixes = offsets[which] + step
        room = offsets[which + 1] - suffixes
        before = np.where(step > 0, data[suffixes - 1].astype(np.int64), -1 - np.arange(len(which)))
        by_age = np.lexsort((start[which] + step, ids[which]))
        d, p = ids[which[by_age]], (start[which] + step)[by_age]
        age = np.empty(len(which), np.int64)
        age[by_age] = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (p[1:] != p[:-1]))))  # equal rows are of one age
        reach = np.zeros(len(which), np.int64)
        for size, members in maximal_repeats(data, suffixes, room, before, length):
            later = members[age[members] != age[members].min()]
            reach[later] = np.maximum(reach[later], size)
        hit = np.flatnonzero(reach)
        if len(hit):
            begin = start[which[hit]] + step[hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[which[hit]], pa.int64()), pa.array(begin), pa.array(begin + reach[hit])], ["doc_id", "begin", "end"]
            )

    return lambda batches: by_group(batches, solve, CHUNK)


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    whole = column.combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1 + whole.offset)[whole.offset :]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def by_group(batches: Iterator[pa.RecordBatch], solve, chunk: int) -> Iterator[pa.RecordBatch]:
    """Gather batches that are sorted by `key` until a group ends beyond `chunk` bytes, and solve them together."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        ends = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and held[-1].column("key")[-1].as_py() != key[0]:
            ends = np.insert(ends, 0, 0)
        last = 0
        per_row = batch.nbytes / batch.num_rows
        for end in ends.tolist():
            if size + (end - last) * per_row >= chunk:
                if end > last:
                    held.append(batch.slice(last, end - last))
                if held:
                    yield from solve(held)
                held, size, last = [], 0, end
        if last < batch.num_rows:
            held.append(batch.slice(last))
            size += held[-1].num_rows * per_row
    if held:
        yield from solve(held)


def _snippets(length: int):
    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch.filter(pa.compute.is_valid(batch.column("wanted")))
        data, offsets = texts_of(batch.column("text"))
        wanted = batch.column("wanted")
        key, place = wanted.flatten().field("key"), wanted.flatten().field("place")
        row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(wanted).to_numpy())
        start, count = np.divmod(place.to_numpy(), 256)
        mine = np.flatnonzero(start >> TURN == batch.column("turn").to_numpy()[row])
        key, place, row, start, count = key.take(pa.array(mine)), place.take(pa.array(mine)), row[mine], start[mine], count[mine]
        begin = offsets[row] + (start & ((1 << TURN) - 1))
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(begin.tolist(), (begin + count + length - 1).tolist(), strict=True)]
        for i in range(0, len(pieces), 4096):
            yield pa.RecordBatch.from_arrays(
                [key.slice(i, 4096), batch.column("doc_id").take(pa.array(row[i : i + 4096])), place.slice(i, 4096), pa.array(pieces[i : i + 4096], pa.binary())],
                ["key", "doc_id", "place", "bytes"],
            )

    return cut


def _span(windows: str, length: int):
    return F.expr("place div 256").alias("begin"), F.expr(f"place div 256 + {windows} + {length - 1}").alias("end")


def covered_spans(docs: DataFrame, runs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (doc_id, begin, end) of byte spans that occur earlier too; spans may overlap. docs has turn, runs are its met_runs."""
    whole = runs.where("kind = 0").select("doc_id", *_span("place % 256", length))
    texts = _texts(docs, runs.where("kind = 1").select("key", "doc_id", "place"), length)
    within = texts.repartition("key").sortWithinPartitions("key").mapInArrow(_covered(length), "doc_id long, begin long, end long")
    if runs.where("kind = 2").isEmpty():
        return whole.union(within)
    # Runs of hot keys, cut into single windows: equal ones are counted together before they meet.
    single = runs.where("kind = 2").select(
        "key", "doc_id", F.explode(F.expr("transform(sequence(0, int(place % 256) - 1), i -> (place div 256 + i) * 256 + 1)")).alias("place")
    )
    cut = _texts(docs, single, length).select(F.xxhash64("bytes").alias("key"), F.xxhash64("key", "bytes").alias("snip"), "doc_id", "place")
    first = cut.groupBy("key", "snip").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    alone = cut.join(first.hint("merge"), ["key", "snip"]).where(~F.struct("doc_id", "place").eqNullSafe(F.col("first"))).select("doc_id", *_span("1", length))
    return whole.union(within).union(alone)


def _texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted runs (key, doc_id, place). The join is that of the removal, so the texts are shuffled once for both."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "place")).alias("wanted"))
    joined = docs.join(lists.hint("merge"), "doc_id", "left").select("doc_id", "text", "turn", "wanted")
    return mapped(joined, _snippets(length), "key long, doc_id long, place long, bytes binary")


def _removed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    data, offsets = texts_of(batch.column("text"))
    raw = data.tobytes()
    lists, turns = batch.column("spans").to_pylist(), batch.column("turn").to_pylist()
    out = []
    for i, spans in enumerate(lists):
        text, base = raw[offsets[i] : offsets[i + 1]], turns[i] << TURN
        merged: list[list[int]] = []
        for x in sorted((x["begin"] - base, x["end"] - base) for x in spans or () if x["begin"] >> TURN == turns[i]):
            if merged and x[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], x[1])
            else:
                merged.append(list(x))
        kept, at = hashlib.sha256(), 0
        for b, e in merged:
            kept.update(text[at:b])
            at = e
        kept.update(text[at:])
        out.append((len(text), sum(e - b for b, e in merged), len(merged), kept.hexdigest()))
    n, removed, spans, digest = zip(*out, strict=True)
    yield pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, frequent: int = FREQUENT) -> DataFrame:
    """Per document what the removal of repeated bytes leaves: n_bytes, n_removed, n_spans, kept_sha256."""
    docs = with_turn(docs.select("doc_id", "text"))
    spans = covered_spans(docs, met_runs(docs, length, gram, hot, frequent), length)
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = docs.join(lists.hint("merge"), "doc_id", "left").select("doc_id", "text", "turn", "spans")
    return mapped(joined, _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _grouped(length: int):
    """Representatives by key, to rows (repeat, n, doc_id, begin) of their maximal repeats of n bytes with all occurrences."""

    def solve(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        data, offsets = _binary(t.column("bytes"))
        place = t.column("place").to_numpy()
        start, count = place // 256, place % 256
        ids, key = t.column("doc_id").to_numpy(), t.column("key").to_numpy()
        which = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        suffixes = offsets[which] + step
        before = np.where(step > 0, data[suffixes - 1].astype(np.int64), -1 - np.arange(len(which)))
        for size, members in maximal_repeats(data, suffixes, offsets[which + 1] - suffixes, before, length):
            at = which[members]
            for k in np.unique(key[at]):  # what two anchors share belongs to both
                own = members[key[at] == k]
                if len(own) > 1:
                    text = bytes(data[suffixes[own[0]] : suffixes[own[0]] + size])
                    name = hashlib.blake2b(text, digest_size=16).hexdigest()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(own)), pa.array(np.full(len(own), size, np.int64)), pa.array(ids[which[own]]), pa.array(start[which[own]] + step[own])],
                        ["repeat", "n", "doc_id", "begin"],
                    )

    return lambda batches: by_group(batches, solve, CHUNK)


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (repeat, n, doc_id, begin): the maximal repeats of n >= length bytes, as far as an anchor's windows reach, with all occurrences.

    repeat is a digest of the bytes. Longer repeats are those of neighbouring anchors, which overlap.
    """
    docs = with_turn(docs.select("doc_id", "text"))
    known = docs.where("doc_id is not null")
    # Without frequent keys: every run stands for itself, so that no occurrence is missing.
    every = mapped(known, _found(length, gram, docs.sparkSession.sparkContext.broadcast(b"\0"), 255), "key long, snip long, doc_id long, place long, salt long")
    often = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    texts = _texts(docs, every.join(often.hint("merge"), "key", "left_semi").select("key", "doc_id", "place").distinct(), length)
    return texts.repartition("key").sortWithinPartitions("key").mapInArrow(_grouped(length), "repeat string, n long, doc_id long, begin long").distinct()
