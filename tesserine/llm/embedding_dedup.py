"""Near-duplicate vectors by cosine within a label, through an inverted multi-index.

Two codebooks are trained, one for each half of the unit vectors, on a bounded sample (`SAMPLE` rows at most,
the least hashes of vec_id); their product is a grid of cells, about one for each `BLOCK` of different vectors. Every distinct vector is filed in the cell of its
two nearest codewords. It then visits cells in the order of the multi-sequence traversal, nearest pairs of
codewords first. A vector in cell (i, j) lies on the codewords' side of the bisecting planes, which bounds its
distance from below half by half; the visits end where that bound reaches the target recall's. It is a share of
the threshold's own distance: the difference of two vectors of d components at the threshold exceeds four
standard deviations, 16 / d of its square, in the direction of a plane once in 30 000 times (with 16 components
or fewer the visits are complete), and twice what the linked pairs of the sample would have needed is allowed
as well. What the visits meet is verified in double precision, so no pair below the threshold is linked.

Equal vectors of a label are one class with a count, and cells are cut into blocks of at most `BLOCK` classes, so
that a hot cell is met by many tasks. Of the links found in a block the edges of a spanning forest go on: every
class that is linked there to the least of those it hangs together with, so no found connection is lost.

Edges: null label, null or empty or zero vectors, null or non-finite components: no links, own component, kept.
Vectors of different lengths never link. A null vec_id stays as a row of its own without links.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mapped, stash

THRESHOLD = 0.98
SAMPLE, STEPS = 8192, 12
#: Least and greatest number of codewords of a half; the greatest has 32 rows of the sample each.
CODEWORDS = (16, 256)
#: Standard deviations of a difference in one direction that visits allow for.
DEVIATIONS = 4.0
BLOCK = 2048
#: Slack for rounding in bounds; verification itself is exact to double precision.
SLACK = 1e-9


def vectors_of(column: pa.Array, width: int | None = None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if width is None else width) if len(column) else np.zeros((0, width or 0))


def usable(embedding: str = "embedding", label: str = "label"):
    x = F.col(embedding)
    plain = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return x.isNotNull() & F.col(label).isNotNull() & F.coalesce((F.size(x) > 0) & plain & F.exists(x, lambda v: v != 0), F.lit(False))


def _halves(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = unit.shape[1] // 2
    return unit[:, :cut], unit[:, cut:]


def codewords(rows: int, block: int = BLOCK) -> int:
    """Codewords of a half for so many vectors: the grid, their square, has about a cell for each block of vectors."""
    return int(min(max(np.sqrt(rows / block), CODEWORDS[0]), CODEWORDS[1]))


def codebook(x: np.ndarray, k: int = CODEWORDS[0], steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """Lloyd's iterations from a seeded choice of rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(steps):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = x[near == j].mean(0)
    return np.unique(centres, axis=0)


def train(vectors: DataFrame, sample: int = SAMPLE, k: int = CODEWORDS[0], threshold: float = THRESHOLD) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each vector length of the sample the codebooks of both halves, and the bound at which visits end."""
    rows = vectors.select("vec_id", "embedding", "label").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["embedding"]), []).append(r)
    out = {}
    for n, found in by.items():
        x = np.array([r["embedding"] for r in found], np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        halves = _halves(x)
        books = tuple(codebook(h, k) for h in halves)
        labels = np.unique([str(r["label"]) for r in found], return_inverse=True)[1]
        most = 2 - 2 * threshold + 1e-7
        allowed = max(most * min(1.0, DEVIATIONS**2 / n), 2 * _needed(x, labels, halves, books, threshold))
        out[n] = (*books, min(most, allowed))
    return out


def _needed(x: np.ndarray, labels: np.ndarray, halves, books, threshold: float) -> float:
    """The greatest bound at which a linked pair of the sample would still be missed, in blocks of rows."""
    (na, la), (nb, lb) = (_bounds(h, w) for h, w in zip(halves, books, strict=True))
    worst = 0.0
    for label in range(labels.max(initial=-1) + 1):
        own = np.flatnonzero(labels == label)
        for at in range(0, len(own), 512):
            i, j = np.nonzero(x[own[at : at + 512]] @ x[own].T >= threshold)
            i, j = own[at + i], own[j]
            if len(i):
                worst = max(worst, float((la[i, na[j]] + lb[i, nb[j]]).max()))
    return worst


def _bounds(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and the square of a lower bound of its distance to every codeword's region."""
    if words.shape[1] == 0:
        return np.zeros(len(x), np.int64), np.zeros((len(x), 1))
    d = ((x**2).sum(1)[:, None] - 2 * x @ words.T + (words**2).sum(1)).clip(0)
    near = d.argmin(1)
    gap = np.sqrt(((words[:, None] - words[None]) ** 2).sum(2))
    over = d - d[np.arange(len(x)), near][:, None]
    apart = 2 * gap[near]
    low = np.divide(over, apart, out=np.zeros_like(over), where=apart > 0)
    return near, np.maximum(low - SLACK, 0) ** 2


def traversal(first: np.ndarray, second: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Multi-sequence: pairs (i, j) in ascending first[i] + second[j], up to `most`."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > most:
            return
        yield int(a[i]), int(b[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (first[a[p]] + second[b[q]], p, q))


def _filed(books: dict, home: bool):
    """Rows with their cell; at home one each, as visitors one for each cell that they must visit."""

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = pa.compute.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
        for n in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == n))
            x = vectors_of(part.column("embedding"), n)
            x = x / np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            if n not in books:  # a length that the sample missed has one cell
                rows, cells = np.arange(len(x)), np.zeros(len(x), np.int64)
            else:
                (na, la), (nb, lb) = (_bounds(h, w) for h, w in zip(_halves(x), books[n][:2], strict=True))
                width, most = len(books[n][1]) or 1, books[n][2]
                if home:
                    rows, cells = np.arange(len(x)), na * width + nb
                else:
                    pairs = [(r, i * width + j) for r in range(len(x)) for i, j in traversal(la[r], lb[r], most)]
                    rows, cells = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
            for at in range(0, len(rows), 8192):
                take = pa.array(rows[at : at + 8192])
                chosen = part.take(take)
                yield pa.RecordBatch.from_arrays(
                    [chosen.column(c) for c in ("vec_id", "label", "n", "embedding")] + [pa.array(np.full(len(take), n)), pa.array(cells[at : at + 8192])],
                    ["vec_id", "label", "n", "embedding", "width", "cell"],
                )

    return place


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine similarity in double precision."""
    return (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None])


def _scaled(x: np.ndarray) -> np.ndarray:
    """Huge or tiny components are brought near 1 by a power of two; others stay as they are."""
    top = np.abs(x).max(axis=1, keepdims=True)
    odd = (top > 1e100) | (top < 1e-100)
    return np.where(odd, x / np.exp2(np.floor(np.log2(top))), x)


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For linked[i, j] of left[i] and right[j] the least id that each row and each column hangs together with; its own without links."""
    rows, columns = left.copy(), right.copy()
    fresh = linked.any(1)
    free = linked.any(0)
    for start in np.flatnonzero(fresh).tolist():
        if not fresh[start]:
            continue
        fresh[start] = False
        front, mine, theirs = np.array([start]), [], []
        while len(front):
            mine.append(front)
            met = np.flatnonzero(linked[front].any(0) & free)
            free[met] = False
            theirs.append(met)
            front = np.flatnonzero(linked[:, met].any(1) & fresh)
            fresh[front] = False
        a, b = np.concatenate(mine), np.concatenate(theirs)
        rows[a] = columns[b] = min(left[a].min(), right[b].min())
    return rows, columns


def _met(threshold: float):
    def meet(left: Iterator, right: Iterator):
        residents = list(left)
        if not residents:
            return
        home = pa.Table.from_batches(residents)
        n = home.column("width")[0].as_py()
        x = _scaled(vectors_of(home.column("embedding").combine_chunks(), n))
        ids, weight = home.column("vec_id").to_numpy(), home.column("n").to_numpy()
        for guests in right:
            for at in range(0, guests.num_rows, 1024):
                part = guests.slice(at, 1024)
                linked = cosines(_scaled(vectors_of(part.column("embedding"), n)), x) >= threshold
                mine = part.column("vec_id").to_numpy()
                linked &= mine[:, None] != ids[None]
                links = linked @ weight
                hit = np.flatnonzero(links)
                if len(hit):
                    least, others = forest(linked[hit], mine[hit], ids)
                    more = np.flatnonzero(others != ids)
                    columns = (mine[hit], ids[more]), (links[hit], np.zeros(len(more), links.dtype)), (least, others[more])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["vec_id", "links", "least"])

    return meet


def links(classes: DataFrame, books: dict, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, links, least): for each class and block met, the vectors linked there and the least vec_id of those that hang together; residents with 0 links as well."""
    types = f"vec_id long, label {classes.schema['label'].dataType.simpleString()}, n long, embedding array<{classes.schema['embedding'].dataType.elementType.simpleString()}>"
    filed = mapped(classes.select("vec_id", "label", "n", "embedding"), _filed(books, True), f"{types}, width long, cell long")
    cell = ["label", "width", "cell"]
    sizes = filed.groupBy(*cell).agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    home = filed.join(sizes.select(*cell, "blocks"), cell).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    guests = mapped(classes.select("vec_id", "label", "n", "embedding"), _filed(books, False), f"{types}, width long, cell long")
    # The guests of a block are cut as well: a block of residents is sent once for each `blocks` cut.
    guests = guests.join(sizes.select(*cell, "blocks"), cell).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    guests = guests.withColumn("cut", F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks").cast("int"))
    home = home.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = [*cell, "block", "cut"]
    names = ["vec_id", "n", "embedding", "width"]
    a, b = (df.select(*(F.col(k).alias(f"k_{k}") for k in keys), *names) for df in (home, guests))
    by = [f"k_{k}" for k in keys]
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(_cogrouped(threshold), "vec_id long, links long, least long")


def _cogrouped(threshold: float):
    meet = _met(threshold)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(meet(left.to_batches(), right.to_batches()))
        schema = pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])
        return pa.Table.from_batches(found, schema) if found else schema.empty_table()

    return run


def dedup_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, k: int | None = None, block: int = BLOCK) -> DataFrame:
    """Per vector n_links, component_id and kept; k: codewords of a half, by the number of different vectors if not given."""
    vectors = vectors.select("vec_id", "embedding", "label")
    good = vectors.where(usable() & F.col("vec_id").isNotNull())
    # 0.0 and -0.0 differ as bytes but not as numbers; two such classes still link by cosine.
    named = good.withColumn("same", F.struct("label", "embedding"))
    classes = stash(named.groupBy("same").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).select("vec_id", "n", "same.label", "same.embedding"), "classes")
    books = train(good, sample, k or codewords(classes.count()), threshold)
    found = stash(links(classes, books, threshold, block), "links")
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    sums = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    known = (
        classes.select("vec_id", "n", "label", "embedding")
        .join(sums, "vec_id", "left")
        .join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(F.struct("label", "embedding").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    )
    key = F.when(usable() & F.col("vec_id").isNotNull(), F.struct("label", "embedding"))
    rows = vectors.withColumn("same", key).join(known, "same", "left")
    out = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
