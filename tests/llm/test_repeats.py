"""Removal of repeated bytes and words against plain versions."""

import hashlib
import random
import uuid

import numpy as np
import pytest

from tesserine.llm import anchors, substring_dedup, suffix_dedup

from .helpers import empty, frame, texts, words


def plain_bytes(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        hit = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                hit[s] += 1
                hit[s + length] -= 1
            seen.add(w)
        gone = np.cumsum(hit)[:-1] > 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def plain_words(rows, window=50):
    first, out = {}, {}
    for i, text in sorted(rows):
        w = words(text)
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_bytes_match_plain(spark, hot):
    df = frame(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_bytes(df, hot=hot).collect()}
    assert got == plain_bytes(rows)
    assert sum(x[1] for x in got.values()) > 1000


@pytest.mark.parametrize("batches", [1, 4])
def test_words_match_plain(spark, batches):
    df = frame(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_words(df, batches=batches).collect()}
    assert got == plain_words(rows)
    assert sum(x[1] for x in got.values()) > 300


@pytest.mark.parametrize("batches", [1, 3])
def test_words_of_hot_keys_match_plain(spark, monkeypatch, batches):
    r = random.Random(8)
    some = lambda k: [f"w{r.randrange(10_000)}" for _ in range(k)]
    passage = some(60)
    rows = [" ".join([*some(20), *passage[r.randint(0, 9) :], *some(20)]).replace(" ", " \n", i % 3) for i in range(60)]
    df = frame(spark, texts() + rows + [" ".join(passage[5:] + passage[5:])])
    whole = substring_dedup._snippets

    def counted(window):
        def cut(batch):
            for out in whole(window)(batch):
                most = max(np.unique(out.column("key").to_numpy(), return_counts=True)[1], default=0)
                if most > 30:
                    raise ValueError("a hot key's runs came to one group")
                yield out

        return cut

    monkeypatch.setattr(substring_dedup, "_snippets", counted)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.dedup_words(df, batches=batches, hot=3).collect()}
    assert got == plain_words([(x.doc_id, x.text) for x in df.collect()])


def test_words_of_hot_keys_are_cut_once(spark, monkeypatch, tmp_path):
    """A window of a hot key is one row, whatever the number of batches that look at it; a key that is hot in one is hot in all."""
    r = random.Random(8)
    some = lambda k: [f"w{r.randrange(10_000)}" for _ in range(k)]
    passage = some(70)

    def changed(i):
        out = list(passage)
        out[i % 70] = f"x{i}"
        return " ".join([*some(5), *out, *some(5), *(out[:60] if i % 7 == 0 else ())])

    df = frame(spark, [changed(i) for i in range(90)])
    whole = substring_dedup._windows

    def counted(window):
        def cut(batch):
            for number, out in enumerate(whole(window)(batch)):
                rows = np.stack([out.column(c).to_numpy() for c in ("high", "low", "doc_id", "begin")])
                np.save(tmp_path / f"{uuid.uuid4().hex}-{number}.npy", rows)
                yield out

        return cut

    monkeypatch.setattr(substring_dedup, "_windows", counted)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.dedup_words(df, batches=3, hot=3).collect()}
    assert got == plain_words([(x.doc_id, x.text) for x in df.collect()])
    rows = np.concatenate([np.load(f) for f in tmp_path.glob("*.npy")], axis=1)
    assert rows.shape[1] > 200 and np.unique(rows, axis=1).shape[1] == rows.shape[1]


def test_near_copies_meet_by_longer_anchors_first(spark, monkeypatch):
    """Near copies of a text, more than a key may have, are told apart by longer anchors; few come to single windows."""
    r = random.Random(8)
    some = lambda k: [f"w{r.randrange(10_000)}" for _ in range(k)]
    passage = some(150)
    rows = [" ".join([*passage[: i % 150], f"x{i}", *passage[i % 150 + 1 :]]) for i in range(200)]
    df = frame(spark, rows)

    def refused(window):
        def cut(batch):
            raise ValueError("near copies came to single windows")
            yield

        return cut

    monkeypatch.setattr(substring_dedup, "_windows", refused)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.dedup_words(df, batches=2, hot=60).collect()}
    assert got == plain_words([(x.doc_id, x.text) for x in df.collect()])


@pytest.mark.parametrize("frequent", [0, 2, 8])
def test_bytes_of_frequent_keys_match_plain(spark, frequent):
    r = random.Random(9)
    some = lambda k: "".join(r.choice("abcdef ") for _ in range(k))
    line = some(140)
    df = frame(spark, texts() + [some(r.randint(0, 80)) + line + some(r.randint(0, 80)) for _ in range(60)] + [line] * 20)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.dedup_bytes(df, frequent=frequent, hot=4).collect()}
    assert got == plain_bytes([(x.doc_id, x.text) for x in df.collect()])


def test_repeated_and_missing_ids(spark):
    """Texts under one doc_id are parts of one document; without a doc_id a document takes no part."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    text, other = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(60))
    rows = [(1, text), (1, other), (1, other), (2, other + " x " + text), (None, text), (None, text), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n, m = len(text.encode()), len(other.encode())
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_bytes, x.n_removed) for x in suffix_dedup.dedup_bytes(df).collect())
    assert got == sorted([(1, n, 0), (1, m, 0), (1, m, 0), (2, n + m + 3, n + m), (-1, n, 0), (-1, n, 0), (3, 0, 0), (3, 0, 0)])
    found = sorted((-1 if x.doc_id is None else x.doc_id, x.n_words, x.n_removed) for x in substring_dedup.dedup_words(df).collect())
    assert found == [(-1, 60, 0), (-1, 60, 0), (1, 60, 0), (1, 60, 0), (1, 60, 0), (2, 121, 120), (3, 0, 0), (3, 0, 0)]


def test_repeat_groups_have_all_occurrences(spark):
    r = random.Random(3)
    some = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    passage = some(110)
    df = spark.createDataFrame([(i, some(50) + passage + some(50)) for i in range(5)], "doc_id long, text string")
    groups = {}
    for x in suffix_dedup.repeat_groups(df).collect():
        groups.setdefault((x.repeat, x.n), set()).add((x.doc_id, x.begin))
    # Maximal within the windows of an anchor: those that all five hold are the passage, and where neighbours are alike by chance some hold more.
    shared = {n: g for n, g in groups.items() if len({d for d, _ in g}) == 5}
    assert shared and all(len(g) >= 2 for g in groups.values())
    assert min(b for g in shared.values() for _, b in g) == 50 and max(b + n for (_, n), g in shared.items() for _, b in g) == 160


def test_empty_tables(spark):
    assert suffix_dedup.dedup_bytes(empty(frame(spark))).collect() == []
    assert substring_dedup.dedup_words(empty(frame(spark))).collect() == []


def test_long_documents_are_cut_into_blocks(monkeypatch):
    data = np.frombuffer(" ".join(t or "" for t in texts()).encode(), np.uint8)
    offsets = np.array([0, 10, len(data)])

    def windows():
        return {(int(r), int(s) + k, int(key)) for rows in anchors.runs(data, offsets, 100, 32) for r, s, n, key, _ in zip(*rows, strict=True) for k in range(n)}

    whole = windows()
    monkeypatch.setattr(anchors, "BLOCK", 257)
    assert windows() == whole
    assert len(whole) == len(data) - 10 - 99


def test_maximal_repeats_with_all_occurrences():
    text = b"xABCDEFGHy" + b"zABCDEFGHw" + b"qABCDEFGHyr"
    data = np.frombuffer(text, np.uint8)
    suffixes = np.arange(len(text) - 3)
    before = np.where(suffixes > 0, data[np.maximum(suffixes - 1, 0)].astype(int), -1)
    found = {(n, tuple(sorted(m.tolist()))) for n, m in suffix_dedup.maximal_repeats(data, suffixes, len(text) - suffixes, before, 4)}
    assert found == {(8, (1, 11, 21)), (9, (1, 21))}


def test_a_later_job_goes_on_with_the_index(spark, tmp_path):
    """Jobs of rising doc_ids that share nothing but the index's path give the rows of one job; levels are merged on the way."""
    df, path = frame(spark), str(tmp_path / "index")
    want = sorted(tuple(r) for r in substring_dedup.dedup_words(df.where("doc_id is not null")).collect())
    ids = sorted({r.doc_id for r in df.collect()} - {None})
    cuts = [ids[0], *(ids[len(ids) * i // 3] for i in (1, 2)), ids[-1] + 1]
    got, levels = [], []
    for low, high in zip(cuts, cuts[1:]):
        index = substring_dedup.FingerprintIndex.opened(spark, path)
        now = df.where(f"doc_id >= {low} and doc_id < {high}")
        got += substring_dedup.dedup_words(now, batches=1, index=index, history=df.where(f"doc_id < {low}")).collect()
        levels.append([x[0] for x in index.runs])
    assert sorted(tuple(r) for r in got) == want and levels == [[0], [1], [1, 0]]
    assert any(r[2] for r in want)
    with pytest.raises(ValueError, match="does not follow"):
        substring_dedup.dedup_words(df.where(f"doc_id = {ids[0]}"), index=substring_dedup.FingerprintIndex.opened(spark, path), history=df)
    with pytest.raises(ValueError, match="holds windows of"):
        substring_dedup.FingerprintIndex.opened(spark, path, window=20)
