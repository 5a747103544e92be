import random

import numpy as np
import pytest

from kvlake.llm import adaptive_scan as A, mtree as M, vectors as V
from tests.conftest import SF


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int")


def cloud(n, d, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(6, d))[rng.integers(6, size=n)] + spread * rng.normal(size=(n, d))).astype(np.float32)


def slow(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[ids.index(q)]
        order = sorted((-v, i) for i, v in zip(ids, s.tolist()) if i != q)[:k]
        out[q] = [(i, -v) for v, i in order]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("n, block, queries", [(700, 64, 4096), (700, 2048, 5)])
def test_exact_search(spark, n, block, queries):
    x = cloud(n, 9)
    x[50:90] = x[50]  # ties
    rows = [(i * 5, x[i].tolist(), 0, 7) for i in range(n)]
    ids, grid = [r[0] for r in rows], np.floor(256 * x.astype(np.float64)).astype(np.int64)
    found = got(M.top_k(table(spark, rows), V.every(50), cells=5, block_rows=block, query_rows=queries))
    assert found == slow(ids, grid, [i for i in ids if i % 50 == 0], 5)


def test_tree_bounds_avoid_work():
    x = np.floor(256 * cloud(4000, 3, spread=0.05).astype(np.float64)).astype(np.int64)
    ids, top = np.arange(4000), float((x * x).sum(axis=1).max())
    s = M.Searcher(ids[:40], x[:40], top, 5)
    s.feed(M.load(ids, x, top))
    q, v, score = s.best()
    want = slow(ids.tolist(), x, range(40), 5)
    assert [(a, b) for a, b in zip(v.tolist(), score.tolist())] == [p for q in range(40) for p in want[q]]
    assert s.compared < 0.5 * 40 * 4000


def test_queries_go_through_a_tree_together(monkeypatch):
    """On vectors spread evenly, where no bound helps, each page is met by the queries at once and not one by one."""
    x = np.random.default_rng(3).normal(size=(1500, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    ids, top, calls, add = np.arange(1500), float((x * x).sum(axis=1).max()), [], V.Best.add
    monkeypatch.setattr(V.Best, "add", lambda self, *a: calls.append(1) or add(self, *a))
    tree, want = M.load(ids, x, top), slow(ids.tolist(), x, range(200), 5)
    for floors in (None, np.array([float(want[q][-1][1]) for q in range(200)])):
        calls.clear()
        q, v, score = M.Searcher(ids[:200], x[:200], top, 5, floors)(tree)
        assert [(a, b) for a, b in zip(v.tolist(), score.tolist())] == [p for i in range(200) for p in want[i]]
        assert 0 < len(calls) <= 2 * sum(tree.leaf) < 200


def test_tree_invariants():
    x = np.floor(256 * cloud(1500, 6).astype(np.float64)).astype(np.int64)
    top = float((x * x).sum(axis=1).max())
    t = M.load(np.arange(1500), x, top, page=20, fanout=5)
    lifted, seen = V.lift(t.rows, top), []
    for i, leaf in enumerate(t.leaf):
        if leaf:
            a, b = t.span[i]
            d = np.sqrt(((lifted[a:b] - t.pivot[i]) ** 2).sum(axis=1))
            assert np.allclose(d, t.to_pivot[a:b]) and (d <= t.radius[i] + 1e-6).all()
            seen += t.ids[a:b].tolist()
        else:
            a, b = t.span[i]
            assert np.allclose(t.to_parent[a:b], np.sqrt(((t.pivot[a:b] - t.pivot[i]) ** 2).sum(axis=1)))
    assert sorted(seen) == list(range(1500))
    same = M.load(np.arange(300), np.ones((300, 4), np.int64), 4.0, page=20)
    assert sorted(same.ids.tolist()) == list(range(300))


def test_large_components_stay_exact():
    x = np.array([[2**27 + 1, 3], [2**27, 5], [7, 2**27]], dtype=np.int64)
    top = float((x.astype(object) ** 2).sum(axis=1).max())
    s = M.Searcher(np.array([0]), x[:1], top, 2)
    s.feed(M.load(np.arange(3), x, top))
    assert s.best()[2].tolist() == [(2**27 + 1) * 2**27 + 15, (2**27 + 1) * 7 + 3 * 2**27]


def test_approximate_search_recall(spark):
    x = cloud(3000, 24)
    rows = [(i, x[i].tolist(), 0, 7) for i in range(3000)]
    found = got(A.nearest_neighbours(table(spark, rows), V.every(20), lists=32, probes=24, block_rows=200, query_rows=100))
    want = slow(list(range(3000)), x.astype(np.float64), range(0, 3000, 20), 20)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    assert all(np.isclose(s, float(x[i].astype(np.float64) @ x[q].astype(np.float64))) for q in found for i, s in found[q])


def test_hypothesis_tests_abandon_candidates():
    x = cloud(2000, 63, spread=0.3)
    top = float((x.astype(np.float64) ** 2).sum(axis=1).max())
    turn, want = A.rotation(64), slow(list(range(2000)), x.astype(np.float64), range(50), 20)
    s = A.Scanner(np.arange(50), x[:50], np.array([want[q][-1][1] for q in range(50)]), top, turn, 20)
    found = {}
    for a in range(0, 2000, 250):
        q, v, score = s(A.pack(np.arange(a, a + 250), x[a : a + 250], top, turn))
        for i, j, z in zip(q.tolist(), v.tolist(), score.tolist(), strict=True):
            found.setdefault(i, set()).add(j)
            assert z == pytest.approx(float(x[i].astype(np.float64) @ x[j].astype(np.float64)), abs=1e-12)
    assert 0 < s.read < 0.8 * s.offered
    assert sum(len(found[q] & {i for i, _ in want[q]}) for q in want) / 1000 > 0.97


def test_doubles_are_kept_and_lengths_are_searched_apart(spark):
    a, b = 0.1 + 1e-12, 0.1
    rows = [(0, [1.0, 1.0]), (1, [a, 0.3]), (2, [b, 0.3]), (20, [1.0]), (21, [0.5]), (22, [0.25]), (100, [1.0, 2.0, 3.0]), (50, [3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = got(A.nearest_neighbours(table, V.every(20)))
    assert found[0] == [(1, a + 0.3), (2, b + 0.3)] and found[20] == [(50, 3.0), (21, 0.5), (22, 0.25)] and set(found) == {0, 20}
    exact = got(M.top_k(table, V.every(50)))
    assert exact[0] == [(1, 256 * (25 + 76)), (2, 256 * (25 + 76))] and [i for i, _ in exact[50]] == [20, 21, 22] and 100 not in exact


def test_queries_that_find_too_few_search_all_lists(spark):
    x = cloud(60, 4)
    rows = [(i, x[i].tolist(), 0, 7) for i in range(60)]
    found = got(A.nearest_neighbours(table(spark, rows), V.every(20), lists=30, probes=1))
    want = slow(list(range(60)), x.astype(np.float64), range(0, 60, 20), 20)
    assert all(len(found[q]) == 20 for q in want) and all(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) > 15 for q in want)


def test_probes_are_measured():
    x = cloud(2000, 8).astype(np.float64)
    top = float((x * x).sum(axis=1).max())
    centre = V.centres(V.lift(x[1000:], top), 30)
    assert 1 <= A.probes_for(x[:1000], centre, top, 5, 0.5) <= A.probes_for(x[:1000], centre, top, 5, 0.95) <= len(centre)


def test_recall_on_the_supplied_vectors(spark):
    found = got(A.query(spark, "/root/testdata/sf0.1"))
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], np.float32).astype(np.float64)
    want = slow([r["vec_id"] for r in rows], x, [r["vec_id"] for r in rows if r["vec_id"] % 20 == 0], 20)
    assert sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want) / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("search", [lambda t: M.top_k(t, V.every(50)), lambda t: A.nearest_neighbours(t, V.every(20))])
def test_odd_rows(spark, search):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 0, 1), (100, [0.5, 0.5], 0, 1), (3, [0.9, 0.1], 0, 1), (7, None, 0, 1), (9, [1.0, None], 0, 1), (11, [nan, 1.0], 0, 1), (13, [float("inf"), 1.0], 0, 1), (15, [], 0, 1), (17, [1.0, 2.0, 3.0], 0, 1), (None, [1.0, 1.0], 0, 1), (3, [0.9, 0.1], 0, 1), (200, None, 0, 1)]
    random.Random(1).shuffle(rows)
    found = got(search(table(spark, rows)))
    assert [i for i, _ in found[0]] == [3, 3, 100] and [i for i, _ in found[100]] == [0, 3, 3] and set(found) == {0, 100}
    assert search(table(spark, [])).collect() == [] and search(table(spark, [(7, None, 0, 1)])).collect() == []
    zero = search(table(spark, [(0, [0.0, 0.0], 0, 1), (100, [1.0, 0.0], 0, 1)]))
    assert len(zero.collect()) in (0, 2)


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, grid = [r["vec_id"] for r in rows], np.floor(256 * np.array([r["embedding"] for r in rows], np.float64)).astype(np.int64)
    assert got(M.query(spark, SF)) == slow(ids, grid, [i for i in ids if i % 50 == 0], 5)
