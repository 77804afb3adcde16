"""Ordinal quality regression: a cumulative-link model on hashed text.

Ratings are ordered grades 0..K-1. One weight vector over hashed features is shared by all grades; ascending
thresholds t_1 < ... < t_{K-1} give P(grade >= k) = sigmoid(score - t_k). Expected grade is the sum of these tail
probabilities. Features are binary: hashed words (stripped of signs, lower-cased), word shapes, and binned
statistics of the whole text (repetition, signs, capitals, digits, separators, word and line lengths).

The model is fitted by gradient descent on at most `SAMPLE` labelled rows, those with the least hashes of doc_id;
the bound is a parameter. Scoring reads every whole text.

Edges: null texts are empty; a text without words gets the least grade's score by its statistics alone; labels
that are null, or without a document, are ignored; several labels of one document count as the least; without any
usable label every document is kept with null scores; repeated rows are scored one by one; extra columns are kept, but for those
named as the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import anchors
from .common import as_rows, field, mapped, texts_of, with_own
from .substring_dedup import word_places

BUCKETS = 1 << 18
SAMPLE = 6000
STEPS, RATE, PENALTY = 120, 0.08, 2e-4
#: Training documents in which a feature must occur.
LEAST = 4
#: Texts are worked on in blocks of so many bytes.
BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.zeros(256, np.uint8)  # 0 sign, 1 lower, 2 upper, 3 digit, 4 not ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4


def grade(quality: Column, toxic: Column) -> Column:
    """0 poor, 1 sound but toxic, 2 sound; null if unrated."""
    return F.when(quality == 0, 0).when((quality >= 1) & (toxic >= 1), 1).when(quality >= 1, 2)


def _binned(name: int, value: np.ndarray, edges: list[float]) -> np.ndarray:
    return (np.uint64(name) << np.uint64(8)) + np.searchsorted(edges, value).astype(np.uint64)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct feature."""
    data, offsets = texts_of(column)
    rows, buckets = [], []
    first = 0
    while first < len(offsets) - 1:
        last = first + max(1, int(np.searchsorted(offsets[first + 1 :], offsets[first] + BLOCK, "right")))
        r, b = _features(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        rows.append(r + first), buckets.append(b)
        first = last
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    begin, end, words = word_places(data, offsets)
    owner = np.repeat(np.arange(n), np.diff(words))
    kind = _CLASS[data]
    letters = np.where(kind == 0, np.uint64(0), _LOWER[data].astype(np.uint64) + np.uint64(1))
    up, down = anchors.powers(len(data) + 1)
    # Signs weigh nothing and do not move the letters after them, so "word," and "word" have one hash.
    kept = np.concatenate(([0], np.cumsum(kind != 0)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * up[kept[:-1]])))
    plain = anchors.mix((total[end] - total[begin]) * down[kept[begin]])
    count = lambda k: np.concatenate(([0], np.cumsum(kind == k)))
    signs, upper, digits = count(0), count(2), count(3)
    size = end - begin
    sign, caps, digit = signs[end] - signs[begin], upper[end] - upper[begin], digits[end] - digits[begin]
    shape = (np.minimum(sign, 4) * 64 + np.minimum(caps, 3) * 16 + np.minimum(digit, 3) * 4 + np.minimum(size // 5, 3)).astype(np.uint64)
    tail = np.where(sign > 0, data[end - 1].astype(np.uint64), np.uint64(0))
    shape = anchors.mix(shape * np.uint64(257) + tail + np.uint64(1 << 40))
    total_words = np.maximum(1, np.diff(words))

    def per(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, n)

    pair = np.unique((owner.astype(np.uint64) << np.uint64(42)) | (plain >> np.uint64(22)))
    held = (pair >> np.uint64(42)).astype(np.int64)
    distinct = np.bincount(held, minlength=n)
    again = np.zeros(len(owner), bool)
    if len(owner) > 1:
        again[1:] = (plain[1:] == plain[:-1]) & (owner[1:] == owner[:-1])
    chars = np.maximum(1, np.diff(offsets))
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    n_lines = lines[offsets[1:]] - lines[offsets[:-1]] + 1
    tenths = [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
    stats = [
        _binned(1, distinct / total_words, tenths),
        _binned(2, per((sign >= 2).astype(float)) / total_words, tenths),
        _binned(3, per(sign.astype(float)) / chars, tenths),
        _binned(4, per((caps >= np.maximum(2, size // 2)).astype(float)) / total_words, tenths),
        _binned(5, per((digit > 0).astype(float)) / total_words, tenths),
        _binned(6, per((sign == size).astype(float)) / total_words, tenths),
        _binned(7, per(size.astype(float)) / total_words, [2, 3, 4, 5, 6, 7, 8, 10, 14]),
        _binned(8, np.diff(words) / n_lines, [1.5, 3, 6, 12, 25, 50, 100]),
        _binned(9, per(again.astype(float)) / total_words, tenths),
        _binned(10, np.diff(words).astype(float), [1, 5, 20, 60, 200, 600]),
    ]
    shapes = np.unique((owner << 18) | (shape % np.uint64(BUCKETS)).astype(np.int64))
    row = np.concatenate([held, shapes >> 18, np.tile(np.arange(n), len(stats))])
    mask = np.uint64(BUCKETS - 1)
    whole = anchors.mix(np.concatenate(stats) + np.uint64(1 << 50)) & mask
    return row, np.concatenate([(pair & mask).astype(np.int64), shapes & (BUCKETS - 1), whole.astype(np.int64)])


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        size = np.maximum(1, np.bincount(rows, minlength=n))
        return np.bincount(rows, self.weights[buckets], n) / np.sqrt(size)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... as columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -30, 30)))


def fit(rows: np.ndarray, buckets: np.ndarray, grades: np.ndarray, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> OrdinalModel:
    """Adam on the mean log-likelihood of the grades, classes weighted by the root of their rarity."""
    n, top = len(grades), int(grades.max())
    often = np.bincount(buckets, minlength=BUCKETS) >= min(LEAST, n)
    keep = often[buckets]
    used, cols = np.unique(buckets[keep], return_inverse=True)
    rows = rows[keep]
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=n)))
    cut = np.array([np.log(max(1, (grades < k).sum()) / max(1, (grades >= k).sum())) for k in range(1, top + 1)])
    weight = 1 / np.sqrt(np.bincount(grades, minlength=top + 1)[grades])
    weight /= weight.sum()
    w = np.zeros(len(used))
    m, v = np.zeros(len(w) + top), np.zeros(len(w) + top)
    for step in range(1, steps + 1):
        score = np.bincount(rows, w[cols], n) * scale
        edge = np.concatenate(([-np.inf], cut, [np.inf]))
        hi, lo = edge[grades + 1] - score, edge[grades] - score
        p_hi, p_lo = 1 / (1 + np.exp(np.clip(-hi, -40, 40))), 1 / (1 + np.exp(np.clip(-lo, -40, 40)))
        mass = np.maximum(p_hi - p_lo, 1e-9)
        d_hi, d_lo = p_hi * (1 - p_hi), p_lo * (1 - p_lo)
        slope = weight * (d_hi - d_lo) / mass  # of the loss, by the score
        grad_w = np.bincount(cols, (slope * scale)[rows], len(w)) + penalty * w
        grad_cut = np.array([(weight * d_lo / mass)[grades == k].sum() - (weight * d_hi / mass)[grades == k - 1].sum() for k in range(1, top + 1)])
        g = np.concatenate((grad_w, grad_cut))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, cut = w - move[: len(w)], np.sort(cut - move[len(w) :])
    full = np.zeros(BUCKETS)
    full[used] = w
    return OrdinalModel(full.astype(np.float32), cut)


def _collected(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows, buckets = features(batch.column("text"))
    order = np.argsort(rows, kind="stable")
    rows, buckets = rows[order], buckets[order]
    lists = np.split(buckets.astype(np.int32), np.searchsorted(rows, np.arange(1, batch.num_rows)))
    yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([x.tobytes() for x in lists], pa.binary())], ["grade", "buckets"])


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> OrdinalModel | None:
    """Fit on at most `sample` rated documents; ratings has doc_id and grade."""
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text")
    found = mapped(joined, _collected, "grade int, buckets binary").collect()
    if len({r["grade"] for r in found}) < 2:
        return None
    found.sort(key=lambda r: (r["grade"], r["buckets"]))
    lists = [np.frombuffer(r["buckets"], np.int32) for r in found]
    levels = sorted({r["grade"] for r in found})
    grades = np.array([levels.index(r["grade"]) for r in found])
    return fit(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64), grades)


def score(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """docs as `row` (see `as_rows`) with expected_grade and tail_probability, that of the highest grade."""
    rows = as_rows(docs)
    if model is None:
        return rows.select("row", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"))
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    text = field(rows.schema["row"].dataType, "text")

    def scored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = OrdinalModel(*held.value)
        found, buckets = features(pa.compute.struct_field(batch.column("row"), [text]))
        tails = m.tails(m.scores(found, buckets, batch.num_rows))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(tails.sum(1)), pa.array(tails[:, -1])], ["row", "expected_grade", "tail_probability"])

    return mapped(rows, scored, T.StructType([*rows.schema.fields]).add("expected_grade", T.DoubleType()).add("tail_probability", T.DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel | None:
    return train(docs, labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")), sample)


#: Documents whose probability of the highest grade is below this are rejected.
KEEP = 0.3


def kept_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """docs as `row` with expected_grade, tail_probability and kept."""
    out = score(docs, classify(docs, labels, sample))
    return out.withColumn("kept", F.coalesce(F.col("tail_probability") >= keep, F.lit(True)))


def rated(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """docs with expected_grade, tail_probability and kept, in place of columns of these names."""
    return with_own(kept_rows(docs, labels, sample, keep), "expected_grade", "tail_probability", "kept")
