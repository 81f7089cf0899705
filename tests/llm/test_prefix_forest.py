import numpy as np
import pytest

from lodestrata.llm import prefix_forest
from lodestrata.llm.prefix_forest import BITS, _planes, best_in_array, cut_cells, fitted_groups, groups_of, hash_strings, nearest, search_forest, similar_pairs, stop_depths, told_apart

SCHEMA = "embedding_id long, model string, dim int, vector array<float>, rank string"


def brute(rows, k):
    """rows: {id: (space, vector)}; {id: [(other, cosine)]}, ties to the smaller id."""
    out = {}
    for i, (s, v) in rows.items():
        others = [(round(-float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 5), j) for j, (t, w) in rows.items() if j != i and t == s]
        out[i] = [(j, -c) for c, j in sorted(others)[:k]]
    return out


def frame(spark, rows, extra=()):
    return spark.createDataFrame([(i, s[0], s[1], [float(x) for x in v], "r") for i, (s, v) in rows.items()] + list(extra), SCHEMA)


def clustered(n, dim, seed, groups=60, noise=0.12):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((groups, dim))
    return centres[rnd.integers(groups, size=n)] + noise * rnd.standard_normal((n, dim))


def test_against_brute_force(spark):
    rows = {i: (("a", 24), v) for i, v in enumerate(clustered(700, 24, 1))} | {1000 + i: (("b", 16), v) for i, v in enumerate(clustered(80, 16, 2))}
    want = brute(rows, 5)
    got = nearest(frame(spark, rows), reach=24, trees=12).collect()
    by = {}
    for r in got:
        by.setdefault(r.embedding_id, []).append(r.neighbour_id)
    hits = sum(len(set(by[i]) & {j for j, _ in w}) for i, w in want.items())
    assert hits >= 0.95 * sum(len(w) for w in want.values())
    assert all(len(x) <= 5 for x in by.values())


def test_copies_and_ties(spark):
    v = np.arange(1, 9.0)
    rows = {i: (("a", 8), v) for i in range(30)} | {100: (("a", 8), 2 * v), 200: (("a", 8), -v), 300: (("b", 8), v), 400: (("a", 8), v + np.eye(8)[0])}
    got = nearest(frame(spark, rows)).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.embedding_id, []).append((r.neighbour_id, r.cosine))
    assert by[0][:4] == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)] and by[25] == [(i, 1.0) for i in range(5)]
    assert by[400][0][1] < 1 and 300 not in by and len(by[200]) == 5
    pairs = {tuple(r) for r in similar_pairs(nearest(frame(spark, rows)), 0.97).collect()}
    assert (0, 1) in pairs and (0, 400) in pairs and not any(200 in p or 300 in p for p in pairs)


def test_malformed_repeated_and_empty(spark):
    good = {1: (("a", 3), np.array([1, 2, 3.0])), 2: (("a", 3), np.array([1, 2, 3.1]))}
    bad = [(3, None, 3, [1.0, 2.0, 3.0], "r"), (4, "a", 3, None, "r"), (5, "a", 3, [1.0, 2.0], "r"), (6, "a", 3, [1.0, None, 3.0], "r"), (7, "a", 3, [1.0, float("nan"), 3.0], "r"), (8, "a", 3, [0.0, 0.0, 0.0], "r"), (9, "a", None, [1.0, 2.0, 3.0], "r"), (10, "a", 3, [], "r"), (1, "a", 3, [1.0, 2.0, 3.0], "r"), (11, "a", 3, [1.0, float("inf"), 3.0], "r")]
    got = nearest(frame(spark, good, bad)).collect()
    assert sorted((r.embedding_id, r.neighbour_id) for r in got) == [(1, 2), (2, 1)]
    assert nearest(frame(spark, good).limit(0)).count() == 0


def test_hash_order_and_blocks():
    rnd = np.random.default_rng(1)
    units = rnd.standard_normal((1500, 16)).astype(np.float32)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    h = hash_strings(units, 3, 7)
    assert h.shape == (1500, 3) and len(np.unique(h[:, 0])) > 1400
    exact = units @ units.T
    np.fill_diagonal(exact, -2)
    for start, places, cosines in best_in_array(units, 4, 2000):
        want = np.sort(exact[start : start + len(places)], axis=1)[:, -4:]
        assert np.allclose(np.sort(cosines, axis=1), want, atol=1e-6)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_vectors(spark, n):
    rows = {i: (("a", 4), np.array([1.0, i, 0, 0])) for i in range(n)}
    assert nearest(frame(spark, rows)).count() == n * (n - 1)


@pytest.mark.parametrize("noise", [2e-4, 2e-3])
def test_large_group_of_near_copies(spark, noise):
    n, dim = 4000, 32
    rnd = np.random.default_rng(11)
    v = (rnd.standard_normal(dim) + noise * rnd.standard_normal((n, dim))).astype(np.float32)
    got = nearest(frame(spark, {i: (("a", dim), x) for i, x in enumerate(v)})).collect()
    by = {}
    for r in got:
        by.setdefault(r.embedding_id, set()).add(r.neighbour_id)
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cosines = u @ u.T
    np.fill_diagonal(cosines, -2)
    best = np.argsort(-cosines, axis=1)[:, :5]
    assert sum(len(by[i] & set(b.tolist())) for i, b in enumerate(best)) >= 0.97 * 5 * n


def test_runs_are_told_apart_at_every_scale():
    rnd = np.random.default_rng(3)
    centre = rnd.standard_normal(16)
    # groups within a group: one level of finer strings leaves each of the inner ones together
    inner = centre + 1e-3 * rnd.standard_normal((8, 16))
    units = (np.repeat(inner, 200, axis=0) + 1e-6 * rnd.standard_normal((1600, 16)))[rnd.permutation(1600)]
    units = (units / np.linalg.norm(units, axis=1, keepdims=True)).astype(np.float32)
    order = told_apart(units, np.zeros(1600, np.int64), _planes(16, 1, 7)[:, :BITS], 50)
    assert sorted(order) == list(range(1600))
    steps = np.linalg.norm(np.diff(units[order].astype(np.float64), axis=0), axis=1)
    assert (steps > 1e-4).sum() < 100
    same = np.ones((300, 4), np.float32) / 2
    assert told_apart(same, np.zeros(300, np.int64), _planes(4, 1, 7)[:, :BITS], 50).tolist() == list(range(300))


def forest_recall(units, enough, **kwargs):
    exact = units.astype(np.float64) @ units.T.astype(np.float64)
    np.fill_diagonal(exact, -2)
    want = np.argsort(-exact, axis=1)[:, :5]
    hits = 0
    for at, others, _ in search_forest(units, np.ones(len(units), bool), 5, enough, 8, 3, **kwargs):
        hits += sum(len(set(o) & set(want[i])) for i, o in zip(at, others.tolist()))
    return hits / (5 * len(units))


def test_the_strings_find_the_neighbours():
    m = clustered(6000, 32, 5, groups=600, noise=0.3)
    units = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)

    def noise(u, trees, seed):
        return np.random.default_rng(seed).integers(-(1 << 63), 1 << 63, (len(u), trees))

    assert forest_recall(units, 400) > 0.95
    assert forest_recall(units, 400, hashed=noise) < 0.2


def test_ascent_in_step():
    # two trees: a vector stops where the buckets of both hold enough
    strings = np.array([[0b1100, 0b0000], [0b1101, 0b1000], [0b1111, 0b0001], [0b0000, 0b0011]], np.uint64) << np.uint64(60)
    stops, _, _ = stop_depths(strings, 3)
    assert stops.tolist() == [3, 3, 3, 2]
    assert stop_depths(strings, 9)[0].tolist() == [0, 0, 0, 0]
    assert stop_depths(strings[:1], 1)[0].tolist() == [0]


def test_cells_are_subtrees_of_bounded_size():
    rnd = np.random.default_rng(8)
    strings = rnd.integers(-(1 << 63), 1 << 63, 20_000)
    strings[:6000] = 77
    starts, finer = cut_cells(strings, rnd.standard_normal(20_000), 20_000, 2000)
    cell = np.searchsorted(starts, strings[6000:].view(np.uint64) ^ np.uint64(1 << 63), side="right")
    assert np.bincount(cell).max() <= 2000 and list(finer) == [77 ^ (1 << 63)] and len(next(iter(finer.values()))) == 3
    assert groups_of(100) == 1 and groups_of(10**6) == 8


@pytest.mark.parametrize("noise", [0.3, 1e-5])
def test_collections_larger_than_a_cell(spark, monkeypatch, noise):
    monkeypatch.setattr(prefix_forest, "CELL", 700)
    m = clustered(4000, 24, 6, groups=400 if noise > 0.1 else 1, noise=noise)
    rows = {i: (("a", 24), v.astype(np.float32)) for i, v in enumerate(m)}
    by = {}
    for r in nearest(frame(spark, rows)).collect():
        by.setdefault(r.embedding_id, set()).add(r.neighbour_id)
    u = np.stack([v for _, v in rows.values()]).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    u -= u.mean(axis=0) if noise < 0.1 else 0
    far = (u * u).sum(1)[:, None] + (u * u).sum(1) - 2 * u @ u.T
    np.fill_diagonal(far, np.inf)
    best = np.argsort(far, axis=1)[:, :5]
    assert sum(len(by[i] & set(b.tolist())) for i, b in enumerate(best)) >= 0.9 * 5 * len(rows)


def test_groups_follow_the_angles():
    rnd = np.random.default_rng(2)
    noise = rnd.standard_normal((4000, 48))
    close = np.repeat(rnd.standard_normal((200, 48)), 20, axis=0) + 0.05 * rnd.standard_normal((4000, 48))

    def fitted(m, n):
        return fitted_groups((m / np.linalg.norm(m, axis=1, keepdims=True))[rnd.permutation(len(m))].astype(np.float32), n, 5)

    assert fitted(noise, 10**6) > 1.3 * fitted(close, 10**6) >= groups_of(10**6)
    assert fitted(noise, 1000) == 1 and fitted(noise[:10], 10**6) == groups_of(10**6)


def test_several_large_collections_of_one_dim(spark, monkeypatch):
    monkeypatch.setattr(prefix_forest, "CELL", 700)
    rows = {i: (("a", 16), v) for i, v in enumerate(clustered(3000, 16, 6, groups=300, noise=0.2))} | {5000 + i: (("b", 16), v) for i, v in enumerate(np.random.default_rng(1).standard_normal((1500, 16)))}
    by = {}
    for r in nearest(frame(spark, rows)).collect():
        by.setdefault(r.embedding_id, set()).add(r.neighbour_id)
    for ids in (range(3000), range(5000, 6500)):
        u = np.stack([rows[i][1] for i in ids])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        c = u @ u.T
        np.fill_diagonal(c, -2)
        best = np.argsort(-c, axis=1)[:, :5] + ids[0]
        assert sum(len(by[i] & set(b.tolist())) for i, b in zip(ids, best)) >= 0.9 * 5 * len(ids)
