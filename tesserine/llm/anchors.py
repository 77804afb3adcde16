"""Where equal windows meet: windows of a document grouped by a content-chosen anchor.

Every window of `length` symbols (bytes or words) holds one anchor: of its grams of `gram` symbols the one
with the least hash, the leftmost on ties. The choice depends on the window's content alone, so equal
windows have equal anchors at equal places. Consecutive windows with one anchor form a run; only runs
travel, about one for (length - gram) / 2 windows, and equal windows always meet under their anchor's key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Symbols worked on at once; longer documents are cut into overlapping blocks.
BLOCK = 1 << 19
PLACE = np.uint64((1 << 21) - 1)
#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sums(symbols: np.ndarray) -> np.ndarray:
    """Running sums S with S[e] - S[s] = symbols[s:e] weighted by powers of BASE."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    up, _ = powers(len(symbols) + 1)
    np.cumsum(symbols * up[:-1], out=out[1:])
    return out


def spans(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each symbols[start:end], whatever the place."""
    _, down = powers(len(total))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    block = padded.reshape(rows, w)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def blocks(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, document row, window starts from, window starts to) of blocks of symbols; starts are places in the block."""
    row, n = 0, len(offsets) - 1
    while row < n:
        last = row + max(1, int(np.searchsorted(offsets[row + 1 :], offsets[row] + BLOCK, "right")))
        first, end = int(offsets[row]), int(offsets[last])
        if last == row + 1 and end - first > BLOCK:
            for at in range(first, end - length + 1, BLOCK):
                to = min(end, at + BLOCK + length - 1)
                yield at, to, np.array([row]), np.array([0]), np.array([to - at - length + 1])
        else:
            starts = offsets[row:last] - first
            yield first, end, np.arange(row, last), starts, np.maximum(starts, offsets[row + 1 : last + 1] - first - length + 1)
        row = last


def runs(symbols: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (row, start in the document, windows, key, snippet hash) of all runs, block by block.

    key: the anchor's hash. snippet hash: of the run's symbols and the anchor's place in them, so equal
    snippet hashes under one key mean equal runs.
    """
    for first, end, rows, starts, stops in blocks(offsets, length):
        if end - first < length:
            continue
        total = sums(symbols[first:end].astype(np.uint64) + np.uint64(1))
        m = end - first - gram + 1
        _, down = powers(m)
        grams = mix((total[gram:] - total[:m]) * down)
        order = (grams & ~PLACE) | np.arange(m, dtype=np.uint64)
        anchor = (sliding_min(order, length - gram + 1) & PLACE).astype(np.int64)
        good = np.zeros(end - first + 1, np.int8)
        np.add.at(good, starts, 1)
        np.add.at(good, stops, -1)
        valid = np.cumsum(good, dtype=np.int8)[: len(anchor)].astype(bool)
        edge = np.ones(len(anchor), bool)
        edge[1:] = anchor[1:] != anchor[:-1]
        edge[starts[starts < len(anchor)]] = True
        edge[stops[stops < len(anchor)]] = True
        at = np.flatnonzero(edge)
        count = np.diff(np.append(at, len(anchor)))
        keep = valid[at]
        at, count = at[keep], count[keep]
        if not len(at):
            continue
        which = np.searchsorted(starts, at, "right") - 1
        place = anchor[at]
        key = mix(grams[place] + np.uint64(0x5851F42D4C957F2D))
        snippet = mix(spans(total, at, at + count + length - 1) + (place - at).astype(np.uint64))
        yield rows[which], at + first - offsets[rows[which]], count, key.view(np.int64), snippet.view(np.int64)
