"""Jaccard self-join of documents on word shingles with signature trees.

1. A first reading counts all shingles in a table of `COUNTERS` counters. Their powers of two order the shingles, rare ones
   first; every document orders its shingles alike, so the order may be rough and results stay exact.
2. A document's set is hashed (64 bits a shingle); equal sets are one class, whose least doc_id stands for it. Of a
   set of n shingles the first n - ceil(0.8 n) + 1 in that order are its prefix: sets similar enough share a
   shingle of their prefixes, for certain. Passages that many documents share come last and hardly ever meet.
3. Classes meet by the shingles of their prefixes. Star step: every member of a group is compared with the group's first one.
   The links give components; a group within one component is settled, however large it is.
4. Signature trees: groups that still span components are cut into nodes of at most `HOT` members, in order of component and
   size, with OR- and AND-combined token bitmaps and size ranges. Pairs of nodes are rows of a table; those that lie
   in one component or whose greatest possible overlap is below the threshold are dropped. Tasks go down each
   remaining pair of nodes by dual traversal of the trees under them, with the same bounds, to pairs of members.

Pairs of the star step pass the bound of two members' bitmaps first. Pairs of both steps are compared exactly, on the whole sets; nothing depends on odds but the 64-bit hashes of the shingles and
the 128-bit hashes of the sets. No group is held whole by a task: members stream, frequent shingles are salted.

Edges: null or blank texts: n_shingles 0, linked with nothing; fewer than five words: one shingle, the whole
sequence; equal rows are copies; further texts under one doc_id add to its links; documents with a null doc_id are
not linked; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import components, counter_of, mapped, stash, texts_of, unstash, word_counters
from .substring_dedup import word_hashes, word_places
from .suffix_dedup import by_group

WORDS, PERCENT = 5, 80
#: Members of a node, which is what a task holds of a group at once (two nodes).
HOT = 512
#: Counters of the shingles' frequencies; their logarithms are broadcast, a byte each.
COUNTERS = 1 << 22
#: Shingles that occur more often than this, beyond the counters' average, have their members salted.
SALTED = 1 << 16
#: Members compared with one copy of the set that stands first.
SPREAD = 1000
#: Documents to be fetched are looked up in place, without moving the texts, up to this number.
FEW = 100_000
#: Bits of a member's token bitmap.
BITS = 4096
LEAF = 16
CHUNK = 1 << 21


def shingle_blocks(column: pa.Array, words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes of all runs of `words` words, running sums, the texts' bounds in words) of blocks of whole texts, A-Z lower-cased."""
    data, offsets = texts_of(column)
    row = 0
    while row < len(offsets) - 1:
        last = row + max(1, int(np.searchsorted(offsets[row + 1 :], offsets[row] + 4 * anchors.BLOCK, "right")))
        part = data[offsets[row] : offsets[last]]
        part = part + np.where((part >= 65) & (part <= 90), np.uint8(32), np.uint8(0))
        begin, end, at = word_places(part, offsets[row : last + 1] - offsets[row])
        total = anchors.sums(word_hashes(part, begin, end))
        start = np.arange(max(0, len(total) - words))
        yield anchors.spans(total, start, start + words), total, at
        row = last


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    for hashes, total, at in shingle_blocks(column, words):
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if hi - lo >= words:
                yield np.unique(hashes[lo : hi - words + 1])
            elif hi > lo:
                yield anchors.spans(total, np.array([lo]), np.array([hi]))
            else:
                yield np.zeros(0, np.uint64)


def frequencies(docs: DataFrame, words: int = WORDS, counters: int = COUNTERS) -> np.ndarray:
    """About the binary logarithm of every shingle's count over all documents, by counter."""
    return word_counters(docs.select("text"), lambda batch: (hashes for hashes, _, _ in shingle_blocks(batch.column("text"), words)), counters)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """How many of a set's first shingles a set similar enough cannot miss entirely."""
    return n - -(-percent * n // 100) + 1


def _signed(words: int, percent: int, held):
    def sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(held.value, np.uint8)
        for at in range(0, batch.num_rows, 1024):
            size, one, two, prefix = [], [], [], []
            part = batch.slice(at, 1024)
            for tokens in shingle_sets(part.column("text"), words):
                size.append(len(tokens))
                if len(tokens):
                    one.append(int(np.bitwise_xor.reduce(anchors.mix(tokens)).view(np.int64)))
                    two.append(int(np.add.reduce(anchors.mix(tokens ^ np.uint64(0x1234567))).view(np.int64)))
                    order = np.argsort(level[counter_of(tokens, len(level))], kind="stable")
                    prefix.append(tokens[order[: prefix_size(len(tokens), percent)]].view(np.int64))
                else:
                    one.append(None), two.append(None), prefix.append(None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                ["doc_id", "size", "one", "two", "prefix"],
            )

    return sign


def _met(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows (key, salt, rep) in that order, to (key, rep, lead, n) of keys that two or more hold; lead is the first under key and salt.

    The key of a group that was seen whole is the hash of its members, so that groups of the same members are one, and n
    their number. Groups over `most` rows stream and keep their key, as do salted ones; their n is 0.
    """
    held = None  # rows of the last group, not yet ended
    lead = None  # (key, salt, lead) while a large group streams

    def out(k: np.ndarray, r: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(r), pa.array(first), pa.array(n.astype(np.int64))], ["key", "rep", "lead", "n"])

    def group(k: np.ndarray, s: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1]))))
        n = np.diff(np.append(edge, len(k)))
        first = np.repeat(r[edge], n)
        members = np.add.reduceat(anchors.mix(r.view(np.uint64)), edge).view(np.int64)
        name = np.repeat(np.where(s[edge] >= 0, k[edge], members), n)
        keep = np.repeat((n > 1) | (s[edge] >= 0), n)
        if keep.any():
            yield out(name[keep], r[keep], first[keep], np.repeat(np.where(s[edge] >= 0, 0, n), n)[keep])

    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in ("key", "salt", "rep")]
        if not len(rows[0]):
            continue
        if lead is not None:
            same = (rows[0] == lead[0]) & (rows[1] == lead[1])
            n = int(same.sum())
            if n:
                yield out(rows[0][:n], rows[2][:n], np.full(n, lead[2]), np.zeros(n))
                rows = [x[n:] for x in rows]
            if not len(rows[0]):
                continue
            lead = None
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1:].max(initial=-1)) + 1
        if last:
            yield from group(*(x[:last] for x in rows))
        held = [x[last:] for x in rows]
        if len(held[0]) > most:
            lead = (held[0][0], held[1][0], held[2][0])
            yield out(held[0], held[2], np.full(len(held[0]), lead[2]), np.zeros(len(held[0])))
            held = None
    if held is not None:
        yield from group(*held)


def _packed(words: int):
    """The whole sets as bytes: 64 bits a shingle, sorted."""

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sets = [t.tobytes() for t in shingle_sets(part.column("text"), words)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["rep", "tokens"])

    return pack


def _mapped_bits(words: int):
    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sets = list(shingle_sets(part.column("text"), words))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array([bitmap(t).tobytes() for t in sets], pa.binary())], ["rep", "size", "bits"])

    return pack


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _verified(percent: int):
    """Rows (a, part, own, rep, tokens), a's own row first under a and part, to pairs (a, b) that are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        under, mine = None, []
        for batch in batches:
            a, b = [], []
            for key, part, own, rep, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "own", "rep")), batch.column("tokens"), strict=True):
                if own:
                    if under != (key, part):
                        under, mine = (key, part), []
                    mine.append(np.frombuffer(bytes(raw.as_buffer()), np.uint64))
                elif any(linked(x, np.frombuffer(raw.as_buffer(), np.uint64), percent) for x in mine):
                    a.append(key), b.append(rep)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return verify


def _exact(pairs: DataFrame, docs: DataFrame, words: int, percent: int, spread: int = SPREAD) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough. One copy of a's set goes to every `spread` of its partners."""
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("b"), F.expr(f"n div {spread} + 1")).cast("int")
    dealt = stash(pairs.join(many.hint("merge"), "a").select("a", "b", part.alias("part")), "dealt")
    guests = dealt.select("a", "part", F.lit(False).alias("own"), F.col("b").alias("rep"))
    needs = guests.union(dealt.select("a", "part").distinct().select("a", "part", F.lit(True), "a"))
    sets = mapped(_texts(docs, needs.select("rep").distinct()), _packed(words), "rep long, tokens binary")
    rows = needs.join(sets.hint("merge"), "rep").select("a", "part", "own", "rep", "tokens")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("own"))
    found = stash(rows.mapInArrow(_verified(percent), "a long, b long"), "links")
    unstash(dealt)
    return found


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The documents named by needed (rep)."""
    needed = needed.select(F.col("rep").alias("doc_id"))
    few = needed.limit(FEW + 1).count() <= FEW
    return docs.join(F.broadcast(needed) if few else needed.hint("merge"), "doc_id", "left_semi")


def _bits(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """Sizes and token bitmaps of the documents named by needed (rep)."""
    return mapped(_texts(docs, needed), _mapped_bits(words), "rep long, size long, bits binary")


def _reachable(percent: int):
    """Pairs (a, b) whose sizes and bitmaps leave the threshold within reach."""

    def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            m, k = (_maps(part.select([c]).rename_columns(["bits"])) for c in ("x", "y"))
            s, t = part.column("m").to_numpy(), part.column("n").to_numpy()
            both = np.concatenate((m, k))
            i, j = alike(both, np.concatenate((s, t)), np.arange(2 * len(m)), np.arange(len(m)), np.arange(len(m)) + len(m), percent)
            yield part.select(["a", "b"]).take(pa.array(i))

    return keep


def _within_reach(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs that the bound of their bitmaps leaves; a doc_id with several texts has several bitmaps."""
    bits = stash(_bits(docs, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), words), "bits")
    x = bits.select(F.col("rep").alias("a"), F.col("size").alias("m"), F.col("bits").alias("x"))
    y = bits.select(F.col("rep").alias("b"), F.col("size").alias("n"), F.col("bits").alias("y"))
    both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "m", "n", "x", "y")
    out = stash(mapped(both, _reachable(percent), "a long, b long").distinct(), "near")
    unstash(bits)
    return out


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[(tokens % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


class SignatureTree:
    """Members in order of size under nodes of two; a node's OR and AND bitmaps, size range and component (-1: several)."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.order, self.maps, self.sizes, self.comps = order, maps[order], sizes[order], comps[order]
        self.nodes: dict[tuple[int, int], tuple] = {}
        self.build(0, len(order))

    def build(self, lo: int, hi: int) -> tuple:
        if hi - lo <= LEAF:
            m, c = self.maps[lo:hi], self.comps[lo:hi]
            node = (np.bitwise_or.reduce(m), np.bitwise_and.reduce(m), int(self.sizes[lo]), int(self.sizes[hi - 1]), int(c[0]) if (c == c[0]).all() else -1)
        else:
            mid = (lo + hi) // 2
            x, y = self.build(lo, mid), self.build(mid, hi)
            node = (x[0] | y[0], x[1] & y[1], x[2], y[3], x[4] if x[4] == y[4] else -1)
        self.nodes[lo, hi] = node
        return node

    def pairs(self, percent: int, other: SignatureTree | None = None) -> Iterator[tuple[int, int]]:
        """Members of different components, of this tree or of this and the other, whose overlap may reach the threshold."""
        right = other or self
        todo = [((0, len(self.order)), (0, len(right.order)))]
        while todo:
            a, b = todo.pop()
            x, y = self.nodes[a], right.nodes[b]
            own = other is None and a == b
            if not own and hopeless(x, y, percent) or x[4] >= 0 and x[4] == y[4]:
                continue
            if a[1] - a[0] <= LEAF and b[1] - b[0] <= LEAF:
                yield from self.leaves(right, a, b, percent, own)
            elif own:
                mid = (a[0] + a[1]) // 2
                todo += [((a[0], mid), (a[0], mid)), ((a[0], mid), (mid, a[1])), ((mid, a[1]), (mid, a[1]))]
            elif a[1] - a[0] >= b[1] - b[0]:
                mid = (a[0] + a[1]) // 2
                todo += [((a[0], mid), b), ((mid, a[1]), b)]
            else:
                mid = (b[0] + b[1]) // 2
                todo += [(a, (b[0], mid)), (a, (mid, b[1]))]

    def leaves(self, right: SignatureTree, a: tuple[int, int], b: tuple[int, int], percent: int, own: bool) -> Iterator[tuple[int, int]]:
        m, k = self.maps[a[0] : a[1], None], right.maps[None, b[0] : b[1]]
        s, t = self.sizes[a[0] : a[1], None], right.sizes[None, b[0] : b[1]]
        most = np.minimum(s - np.bitwise_count(m & ~k).sum(2, dtype=np.int64), t - np.bitwise_count(k & ~m).sum(2, dtype=np.int64))
        good = (100 * most >= percent * (s + t - most)) & (self.comps[a[0] : a[1], None] != right.comps[None, b[0] : b[1]])
        i, j = np.nonzero(good)
        if own:
            i, j = i[i < j], j[i < j]
        yield from zip(self.order[i + a[0]].tolist(), right.order[j + b[0]].tolist(), strict=True)


def alike(maps, sizes, comps, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs (i, j) of different components whose sizes and bitmaps leave the threshold within reach."""
    low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    keep = (comps[i] != comps[j]) & (100 * low >= percent * high)
    i, j = i[keep], j[keep]
    m, k = maps[i], maps[j]
    most = np.minimum(sizes[i] - np.bitwise_count(m & ~k).sum(1, dtype=np.int64), sizes[j] - np.bitwise_count(k & ~m).sum(1, dtype=np.int64))
    keep = 100 * most >= percent * (sizes[i] + sizes[j] - most)
    return i[keep], j[keep]


def hopeless(x: tuple, y: tuple, percent: int) -> bool:
    """Whether no member of x and member of y can be similar enough, by size ranges and bitmaps."""
    if 100 * x[3] < percent * y[2] or 100 * y[3] < percent * x[2]:
        return True
    # A member of x has at least the tokens behind x's common bits; those that y nowhere has cannot overlap.
    most = min(x[3] - int(np.bitwise_count(x[1] & ~y[0]).sum()), y[3] - int(np.bitwise_count(y[1] & ~x[0]).sum()))
    return 100 * most < percent * (x[2] + y[2] - most)


def _noded(most: int):
    """Members of open groups in order of (key, component, size), to the same with the node that they lie in."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, key, comp, n = TaskContext.get().partitionId() << 40, None, None, 0
        for batch in batches:
            nodes = []
            for k, c in zip(batch.column("key").to_pylist(), batch.column("component").to_pylist(), strict=True):
                # A component that fills nodes of its own does not share them: such nodes are settled among themselves.
                if k != key or n >= most or c != comp and n >= most // 2:
                    node, key, n = node + 1, k, 0
                comp, n = c, n + 1
                nodes.append(node)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], [*batch.schema.names, "node"])

    return cut


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members in order of node, to a row for each node: key, sizes, components and bitmaps."""

    def solve(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        node, maps = t.column("key").to_numpy(), _maps(t)
        edge = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        size, comp = t.column("size").to_numpy(), t.column("component").to_numpy()
        held = [np.minimum.reduceat(size, edge), np.maximum.reduceat(size, edge), np.minimum.reduceat(comp, edge), np.maximum.reduceat(comp, edge)]
        some, every = np.bitwise_or.reduceat(maps, edge), np.bitwise_and.reduceat(maps, edge)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[edge]), pa.array(t.column("group").to_numpy()[edge]), *map(pa.array, held), pa.array([x.tobytes() for x in some], pa.binary()), pa.array([x.tobytes() for x in every], pa.binary())],
            ["node", "key", "least", "most", "low", "high", "some", "every"],
        )

    yield from by_group(batches, solve, CHUNK)


def _maps(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(t.num_rows, -1)


def _hopeful(percent: int):
    """Pairs of nodes whose members may be similar enough."""

    def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bits = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("some1", "every1", "some2", "every2")]
        sizes = [batch.column(c).to_pylist() for c in ("least1", "most1", "least2", "most2")]
        good = [not hopeless((a, b, i, j), (c, d, k, m), percent) for a, b, c, d, i, j, k, m in zip(*bits, *sizes, strict=True)]
        yield batch.select(["node1", "node2"]).filter(pa.array(good, pa.bool_()))

    return keep


def _traversed(percent: int):
    """Rows (key, side, rep, size, component, bits) of pairs of nodes, side 0 alone where a node meets itself, to pairs (a, b)."""

    def solve(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        key, side, ids = t.column("key").to_numpy(), t.column("side").to_numpy(), t.column("rep").to_numpy()
        maps, sizes, comps = _maps(t), t.column("size").to_numpy(), t.column("component").to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        count, double = np.diff(edges), np.add.reduceat(side, edges[:-1]) > 0

        def out(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        single = (count > 1) & (count <= LEAF) & ~double
        for n in np.unique(count[single]).tolist():  # trees of one leaf, all of a size together
            first = edges[:-1][single & (count == n)]
            i, j = (x[None] for x in np.triu_indices(n, 1))
            i, j = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            for at in range(0, len(i), 20_000):
                x, y = alike(maps, sizes, comps, i[at : at + 20_000], j[at : at + 20_000], percent)
                if len(x):
                    yield out(ids[x], ids[y])
        for lo, hi in zip(edges[:-1][(count > LEAF) | double].tolist(), edges[1:][(count > LEAF) | double].tolist(), strict=True):
            mid = lo + int((side[lo:hi] == 0).sum())
            trees = [SignatureTree(maps[x:y], sizes[x:y], comps[x:y]) for x, y in ((lo, mid), (mid, hi)) if y > x]
            found = np.array(list(trees[0].pairs(percent, *trees[1:])), np.int64).reshape(-1, 2)
            if len(found):
                yield out(ids[lo + found[:, 0]], ids[(lo if len(trees) == 1 else mid) + found[:, 1]])

    return lambda batches: by_group(batches, solve, CHUNK)


def _residual(groups: DataFrame, settled: DataFrame, docs: DataFrame, words: int, percent: int, hot: int) -> DataFrame:
    """Pairs (a, b) of different components that dual traversal of the open groups' trees leaves."""
    # A lead has been compared with all others, and of two members nothing is left.
    rows = groups.where("rep <> lead and n <> 2").select("key", "rep").union(groups.where("n = 0").join(_led_twice(groups).hint("merge"), "key").where("rep = lead").select("key", "rep"))
    member = rows.join(settled.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    member = stash(member.distinct(), "members")
    spread = member.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    opened = stash(member.join(spread.hint("merge"), "key", "left_semi"), "open")
    unstash(member)
    bits = _bits(docs, opened.select("rep").distinct(), words)
    ranged = opened.join(bits.hint("merge"), "rep").repartitionByRange("key", "component", "size", "rep").sortWithinPartitions("key", "component", "size", "rep")
    noded = stash(ranged.select("rep", "key", "component", "size", "bits").mapInArrow(_noded(hot), "rep long, key long, component long, size long, bits binary, node long"), "noded")
    # Nodes of groups that have several meet as rows of a table; a node always meets itself.
    several = noded.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("key")
    parted = noded.join(several.hint("merge"), "key", "left_semi").select(F.col("node").alias("key"), F.col("key").alias("group"), "size", "component", "bits")
    nodes = parted.repartition("key").sortWithinPartitions("key").mapInArrow(_summed, "node long, key long, least long, most long, low long, high long, some binary, every binary")
    nodes = stash(nodes, "nodes")
    left, right = (nodes.select("key", *(F.col(c).alias(f"{c}{i}") for c in nodes.columns if c != "key")) for i in (1, 2))
    sizes = (100 * F.col("most1") >= percent * F.col("least2")) & (100 * F.col("most2") >= percent * F.col("least1"))
    apart = (F.col("low1") < F.col("high1")) | (F.col("low2") < F.col("high2")) | (F.col("low1") != F.col("low2"))
    both = mapped(left.join(right.hint("merge"), "key").where(F.col("node1") < F.col("node2")).where(sizes & apart), _hopeful(percent), "node1 long, node2 long")
    name = F.xxhash64("node1", "node2").alias("key")
    sides = both.select(name, F.posexplode(F.array("node1", "node2")).alias("side", "node"))
    alone = noded.groupBy("node").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select(F.col("node").alias("key"), F.lit(0).alias("side"), "node")
    meeting = noded.select("node", "rep", "size", "component", "bits").join(sides.union(alone).hint("merge"), "node").select("key", "side", "rep", "size", "component", "bits")
    pairs = meeting.repartition("key").sortWithinPartitions("key", "side").mapInArrow(_traversed(percent), "a long, b long").distinct()
    out = stash(pairs, "pairs")
    unstash(opened, noded, nodes)
    return out


def _led_twice(groups: DataFrame) -> DataFrame:
    """Keys whose members have several leads, as salted ones have."""
    return groups.where("n = 0").groupBy("key").agg(F.min("lead").alias("top"), F.max("lead").alias("x")).where("top < x").select("key", "top")


def similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hot: int = HOT, salted: int = SALTED, counters: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """(signed documents doc_id, size, rep; components of representatives node, component)."""
    docs = docs.select("doc_id", "text")
    level = frequencies(docs, words, counters)
    held = docs.sparkSession.sparkContext.broadcast(level.tobytes())
    signed = stash(mapped(docs, _signed(words, percent, held), "doc_id long, size long, one long, two long, prefix array<long>"), "signed")
    known = signed.where("size > 0 and doc_id is not null")
    classes = stash(known.groupBy("one", "two", "size").agg(F.min("doc_id").alias("rep")), "classes")
    meets = known.join(classes.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.explode("prefix").alias("key"))
    groups = stash(_grouped(meets, level, salted).distinct(), "groups")
    tops = groups.where("n = 0").join(_led_twice(groups).hint("merge"), "key").where("lead > top").select(F.col("top").alias("a"), F.col("lead").alias("b"))
    stars = groups.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).union(tops).distinct()
    near = stash(_sized(stars, classes, percent), "stars")
    first = _exact(_within_reach(near, docs, words, percent), docs, words, percent)
    settled = components(first)
    pairs = _residual(groups, settled, docs, words, percent, hot)
    left = stash(pairs.join(near, ["a", "b"], "left_anti"), "pairs")
    rest = _exact(left, docs, words, percent)
    final = settled if rest.isEmpty() else components(first.union(rest))
    unstash(groups, near, pairs, left)
    return signed.join(classes, ["one", "two", "size"], "left").select("doc_id", "size", "rep"), final


def _grouped(meets: DataFrame, level: np.ndarray, salted: int) -> DataFrame:
    """Members (key, rep, lead, n) of the keys that two or more hold. Frequent keys are salted by their members."""
    often = 2.0**level
    bound = salted + 2 * float(often.mean())
    hot = np.flatnonzero(often > 2 * bound)
    salt = F.lit(-1)
    if len(hot):  # at most a row for each counter
        table = meets.sparkSession.createDataFrame([(int(c), int(often[c] // bound)) for c in hot], "counter long, salts int")
        n = len(level)  # a power of two, so the low bits of the key as it is signed
        meets = meets.join(F.broadcast(table), F.col("key").bitwiseAND(F.lit(n - 1)) == F.col("counter"), "left")
        salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")).otherwise(-1)
    rows = meets.select("key", salt.alias("salt"), "rep")
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "rep").mapInArrow(_met, "key long, rep long, lead long, n long")


def _sized(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose sizes leave the threshold within reach; a doc_id with several texts has several sizes."""
    x = classes.select(F.col("rep").alias("a"), F.col("size").alias("m"))
    y = classes.select(F.col("rep").alias("b"), F.col("size").alias("n"))
    fits = 100 * F.least("m", "n") >= percent * F.greatest("m", "n")
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where(fits).select("a", "b").distinct()


def join_components(docs: DataFrame, **options) -> DataFrame:
    """Per document n_shingles and component_id."""
    signed, final = similar(docs, **options)
    out = signed.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
