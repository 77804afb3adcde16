import itertools
import random

import numpy as np

from tesserine.llm import jaccard_join

from .helpers import empty, frame, words


def plain(rows):
    sets = {}
    for i, text in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def variants(seed=1):
    r = random.Random(seed)
    out = []
    for base in range(6):
        w = [f"w{base}_{r.randint(0, 400)}" for _ in range(r.choice((30, 80, 150)))]
        for _ in range(12):
            v = list(w)
            for _ in range(r.randint(0, 4)):
                v[r.randrange(len(v))] = f"e{r.randint(0, 10**6)}"
            out.append(" ".join(v))
    return out


def test_components_match_plain(spark):
    for rows in (None, variants()):
        df = frame(spark, rows)
        data = [(r.doc_id, r.text) for r in df.collect()]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(df).collect()}
        assert got == plain(data)


def test_hot_groups_are_divided(spark):
    df = frame(spark, variants(2))
    data = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(df, hot=3).collect()}
    assert got == plain(data)


def test_salted_shingles(spark):
    df = frame(spark, variants(3))
    data = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(df, hot=5, salted=0).collect()}
    assert got == plain(data)


def test_group_of_near_copies_and_a_shared_passage(spark):
    r = random.Random(4)
    base, passage = [f"b{i}" for i in range(60)], [f"p{i}" for i in range(40)]
    rows = [" ".join(base)]
    for i in range(4000):
        v = list(base)
        v[i % 60] = f"e{i}"
        rows.append(" ".join(v))
    rows += [" ".join([*(f"o{i}_{k}" for k in range(30)), *passage, *(f"o{i}_{k}" for k in range(30, 60))]) for i in range(2000)]
    order = list(range(len(rows)))
    r.shuffle(order)
    df = frame(spark, [rows[i] for i in order])
    least = 3 * min(at for at, i in enumerate(order) if i <= 4000)
    got = {x.doc_id: x.component_id for x in jaccard_join.join_components(df).collect()}
    assert got == {3 * at: least if i <= 4000 else 3 * at for at, i in enumerate(order)}


def test_prefixes_cannot_miss():
    for n in range(1, 200):
        p = jaccard_join.prefix_size(n)
        assert 100 * (n - p) < 80 * n <= 100 * (n - p + 1)


def test_edges(spark):
    df = frame(spark, ["a b c d e f", "a b c d e f", None, "", "x", "X", "p q", "p q r"])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(df.union(df.limit(1))).collect()}
    assert got == {0: (2, 0), 3: (2, 0), 6: (0, 6), 9: (0, 9), 12: (1, 12), 15: (1, 12), 18: (1, 18), 21: (1, 21)}
    assert jaccard_join.join_components(empty(df)).collect() == []


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 2**40, n).astype(np.uint64) for n in (40, 60, 200)]
    sets = []
    for i in range(150):
        s = base[i % 3].copy()
        k = rng.integers(0, len(s) // 8)
        s[rng.integers(0, len(s), k)] = rng.integers(0, 2**40, k).astype(np.uint64)
        sets.append(np.unique(s))
    maps = np.stack([jaccard_join.bitmap(s) for s in sets])
    tree = jaccard_join.SignatureTree(maps, np.array([len(s) for s in sets]), np.arange(len(sets)))
    found = {tuple(sorted(p)) for p in tree.pairs(80)}
    need = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard_join.linked(sets[i], sets[j])}
    assert need and need <= found
    assert len(found) < len(sets) * (len(sets) - 1) / 4
