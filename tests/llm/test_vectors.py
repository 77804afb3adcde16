import itertools

import numpy as np

from tesserine.llm import embedding_dedup as E


def rows(seed=4, n=150):
    rng = np.random.default_rng(seed)
    out = []
    base = rng.normal(size=(12, 8))
    for i in range(n):
        v = base[i % 12] + rng.normal(size=8) * rng.choice([0, 0.01, 0.15, 0.3])
        out.append((i * 2, [float(np.float32(x)) for x in v], [0, 0, 1, None][i % 4] if i % 11 else None))
    out += [(1001, None, 0), (1003, [0.0] * 8, 0), (1005, [1.0] * 7 + [float("nan")], 0), (1007, [1.0] * 7 + [None], 0), (1009, [float("inf")] + [1.0] * 7, 0), (1011, [], 0)]
    out += [(1013, [1.0, 2.0], 0), (1015, [2.0, 4.0], 0), (1017, [1e30] * 8, 1), (1019, [1e-30] * 8, 1)]
    return out


def plain(data, t=0.98):
    good = [(i, np.array(v, float), l) for i, v, l in data if l is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links, root = {i: 0 for i, *_ in data}, {i: i for i, *_ in data}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, x, a), (j, y, b) in itertools.combinations(good, 2):
        if a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= t:
            links[i] += 1
            links[j] += 1
            p, q = sorted((find(i), find(j)))
            root[q] = p
    return {i: (links[i], find(i), find(i) == i) for i in links}


def test_links_match_plain(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<float>, label int, cell string")
    want = plain(data)
    for block in (E.BLOCK, 5):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.dedup_vectors(df, k=6, block=block).collect()}
        assert got == want
    assert sum(x[0] for x in want.values()) > 200
    assert E.dedup_vectors(df.where("false")).collect() == []


def test_traversal_is_in_order():
    rng = np.random.default_rng(0)
    a, b = rng.random(9), rng.random(7)
    seen = list(E.traversal(a, b, 1.0))
    costs = [a[i] + b[j] for i, j in seen]
    assert costs == sorted(costs)
    assert set(seen) == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 1.0}


def test_chains_keep_their_component(spark):
    at = np.arccos(0.985)
    chain = [(v, [float(np.cos(k * at)), float(np.sin(k * at))], 0) for k, v in enumerate((1, 3, 4, 2))]
    rng = np.random.default_rng(5)
    data, ids = list(chain), rng.permutation(np.arange(10, 2000))
    for g in range(25):
        base = rng.normal(size=16)
        for _ in range(20):
            v = base + rng.normal(size=16) * 0.145
            data.append((int(ids[len(data)]), [float(x) for x in v], 1 + g))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    want = plain(data)
    assert [want[v][1] for v in (1, 2, 3, 4)] == [1] * 4
    assert len({c for _, c, _ in want.values()}) < len(data) - 100
    for block in (E.BLOCK, 6):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.dedup_vectors(df, k=1, block=block).collect()}
        assert got == want


def test_recall_of_long_vectors_with_many_codewords(spark):
    """64 components, where visits end at a bound: links with the least and with more codewords, against brute force."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(150, 64))
    rows = [(i, (base[i % 150] + rng.normal(size=64) * rng.choice([0.05, 0.1, 0.14])).tolist(), i % 2) for i in range(1200)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for k in (None, 48):
        got = {r.vec_id: r.n_links for r in E.dedup_vectors(df, k=k, block=64).collect()}
        found = np.array([got[i] for i in range(len(x))])
        assert linked.sum() > 1000 and (found <= linked.sum(1)).all() and found.sum() >= 0.99 * linked.sum()


def test_codewords_follow_the_rows():
    assert E.codewords(0) == E.codewords(E.BLOCK * 256) == 16 and E.codewords(E.BLOCK * 10_000) == 100 and E.codewords(10**12) == 256
