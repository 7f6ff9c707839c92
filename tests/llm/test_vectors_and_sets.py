"""Whitening, centroid clustering and the Jaccard join against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import centroids, jaccard, whitening

INF, NAN = float("inf"), float("nan")


def vectors(n: int, size: int, seed: int) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, size)) * 0.2 + (rng.integers(0, 3, n)[:, None] - 1) * 0.3).astype(np.float32).tolist()


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, n long, cluster string, w string")


ODD = [(1001, None), (1002, []), (1003, [1.0, None]), (1004, [1.0, NAN]), (1005, [INF] * 6), (1006, [0.5] * 5)]


@pytest.fixture(scope="module")
def six():
    rows = list(enumerate(vectors(300, 6, 1)))
    return rows + [rows[0], (None, rows[1][1])]


def test_whitening(spark, six):
    df = table(spark, [(k, v, "x", 1, "c", "w") for k, v in six + ODD])
    got = whitening.whiten(df, 4).collect()
    x = np.floor(1024 * np.asarray([v for _, v in six], np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 4 * n and {r["n"] for r in got} == {n} and {r["identity_error"] for r in got}.pop() < 1e-9
    deviation = sorted(int(d) for d in ((n * x - sums) ** 2).sum(1))
    assert sorted(int(r["deviation"]) for r in got if r["component"] == 1) == deviation
    for c in range(4):
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c + 1}
        expected = centred @ axes[:, c] / values[c] ** 0.5
        sign = np.sign(mine[0] * expected[0])
        assert all(abs(mine[k] * sign - e) < 1e-8 for (k, _), e in zip(six, expected))
        assert abs(next(r["explained"] for r in got if r["component"] == c + 1) - values[c] / values.sum()) < 1e-9
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], "", 0, "", "")] * 3)).collect() == []  # no variance


def test_whitening_takes_pairs_in_parts(spark, six, monkeypatch):
    df = table(spark, [(k, v, "x", 1, "c", "w") for k, v in six])
    points = whitening.fixed_points(df, "embedding", "vec_id")
    whole = whitening.moments(points, 6)
    monkeypatch.setattr(whitening, "PAIRS", 4)
    assert np.allclose(whitening.moments(points, 6).covariance, whole.covariance, rtol=1e-12)


def k_means(rows, k, rounds, size):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(1024 * np.asarray([v for _, v in kept], np.float64)).astype(np.int64)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, hashlib.sha256(f"3:{kept[i][0]}".encode()).hexdigest(), x[i].tolist()))
    middle = x[order[:k]].copy()
    near = lambda: np.stack([((x - c) ** 2).sum(1) for c in middle], 1)
    for _ in range(rounds):
        at = near().argmin(1)
        for c in range(len(middle)):
            if (at == c).any():
                middle[c] = x[at == c].sum(0) // (at == c).sum()
    return sorted((str(i), int(a), int(d)) for (i, _), a, d in zip(kept, near().argmin(1), near().min(1))), middle.tolist()


@pytest.mark.parametrize("points,leaf,k", [(4096, 16, 5), (40, 2, 5), (64, 4, 1)])
def test_centroids(spark, six, monkeypatch, points, leaf, k):
    monkeypatch.setattr(centroids, "TREE_POINTS", points)
    monkeypatch.setattr(centroids, "LEAF", leaf)
    rows = six + ODD + [(2000 + i, six[5][1]) for i in range(50)]
    df = table(spark, [(i, v, "x", 1, "c", "w") for i, v in rows])
    got = centroids.cluster(df, k=k, rounds=4, size=6).collect()
    expected, middle = k_means(rows, k, 4, 6)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == expected
    assert all(r["centroid"] == middle[r["cluster"]] for r in got)
    assert {int(r["inertia"]) for r in got} == {sum(d for _, _, d in expected)}
    for r in got:
        assert int(r["cluster_inertia"]) == sum(d for _, c, d in expected if c == r["cluster"])


def test_centroids_of_few_rows(spark):
    assert centroids.cluster(table(spark, []), size=6).collect() == []
    two = table(spark, [(i, v, "", 0, "", "") for i, v in enumerate(vectors(2, 6, 3))])
    assert sorted(r["distance"] for r in centroids.cluster(two, size=6).collect()) == [0, 0]
    with pytest.raises(Exception, match="passes"):
        centroids.cluster(table(spark, [(1, [1e9] * 6, "", 0, "", "")]), size=6).collect()


def test_balls_go_whole():
    """Far clusters are assigned by balls, with the sums that point by point assignment has."""
    rng = np.random.default_rng(0)
    middle = rng.integers(-5000, 5000, (4, 8))
    x = (middle[rng.integers(0, 4, 2000)] + rng.integers(-20, 20, (2000, 8))).astype(np.int64)
    order, nodes, sums = centroids.build_tree(x)
    named = [dict(zip(("start", "stop", "left", "right", "radius"), n)) for n in nodes]
    cluster, counts, totals, whole = centroids.filtered(x[order], named, sums, middle.astype(np.int64))
    at = np.stack([((x[order] - c) ** 2).sum(1) for c in middle], 1).argmin(1)
    assert (cluster == at).all() and counts == np.bincount(at, minlength=4).tolist()
    assert all((totals[c] == x[order][at == c].sum(0)).all() for c in range(4))
    assert 0 < whole <= 16


def linked(rows, words=4, percent=85):
    """(key, shingles, component) by comparing all pairs that share a shingle."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    holders: dict = {}
    for i, s in enumerate(sets):
        shared: dict = {}
        for x in s:
            for j in holders.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            holders[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[of(i)] = of(j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[of(i)] = min(k, least.get(of(i), k))
    return sorted((str(k), len(sets[i]), str(least.get(of(i)))) for i, (k, _) in enumerate(rows))


def family(draw, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(*edits)):
            words[draw.randrange(len(words))] = f"e{draw.randrange(40)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(7)
    word = lambda: f"w{draw.randrange(3000)}"
    near = family(draw, [word() for _ in range(110)], 120, (0, 5)) + family(draw, [word() for _ in range(50)], 30, (0, 3))
    long = [word() for _ in range(1600)]
    chain = [" ".join(long[i * 10 : i * 10 + 250]) for i in range(90)]
    alone = [" ".join(word() for _ in range(draw.randint(1, 60))) for _ in range(60)]
    odd = [None, "", " \n\t", "a", "A", "a b", "a b c d", "A B C D e", "x " * 5000]
    rows = list(enumerate(near + chain + alone + odd))
    return rows + [(None, near[0]), (None, "zz yy"), (3, near[3]), (3, near[3]), (4, "other text of the same id")]


@pytest.mark.parametrize("heavy,sizes", [(32, {}), (3, {"leaf": 12, "pivots": 4, "block": 20})])
def test_jaccard(spark, texts, monkeypatch, heavy, sizes):
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in texts], "doc_id long, text string, n_shingles int, class int").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.jaccard_groups(df, **sizes).collect())
    assert got == linked(texts)


def test_jaccard_of_no_rows(spark):
    assert jaccard.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_leaf_links_join_what_all_pairs_join():
    draw = random.Random(2)
    sets = [np.unique(np.asarray([draw.randrange(40) for _ in range(draw.randint(10, 40))], np.uint64)) for _ in range(80)]
    for percent in (50, 60, 85):
        links = jaccard.links_within(np.arange(80), np.arange(80), list(map(len, sets)), sets, percent)
        near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
        assert all(near(sets[a], sets[b]) for a, b in links)
        root = list(range(80))
        for a, b in links:
            root = [root[a] if r == root[b] else r for r in root]
        assert all(root[a] == root[b] for a in range(80) for b in range(a) if near(sets[a], sets[b]))
