"""Cover trees and the vector join against all cosines."""

import numpy as np
import pytest

from wavelane.llm import cover_tree as C


def clouds(rng, n, dim, noise):
    centres = rng.normal(size=(n, dim))
    points = np.concatenate([c + noise * rng.normal(size=(rng.integers(1, 30), dim)) for c in centres])
    return points / np.linalg.norm(points, axis=1)[:, None]


@pytest.mark.parametrize("n,dim,noise", [(1, 3, 0.0), (40, 3, 0.05), (60, 16, 0.1), (300, 64, 0.05), (5, 2, 0.5)])
def test_linked_pairs(n, dim, noise):
    rng = np.random.default_rng(n)
    one, two = clouds(rng, n, dim, noise), clouds(rng, n, dim, noise)
    a, b = C.linked_pairs(one, None, 0.9)
    i, j = np.nonzero(np.triu(one @ one.T >= 0.9, 1))
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(i.tolist(), j.tolist()))
    a, b = C.linked_pairs(one, two, 0.9)
    i, j = np.nonzero(one @ two.T >= 0.9)
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(i.tolist(), j.tolist()))


def test_tree_invariants():
    rng = np.random.default_rng(4)
    points = clouds(rng, 50, 4, 0.2)
    tree = C.CoverTree(points)

    def below(node):
        return [tree.centre[node]] if tree.leaf[node] else [r for k in tree.kids[node] for r in below(k)]
    assert sorted(below(0)) == list(range(len(points)))
    for node in range(len(tree.centre)):
        rows = below(node)
        assert tree.centre[node] in rows
        assert np.linalg.norm(points[rows] - points[tree.centre[node]], axis=1).max() <= tree.reach[node] + 1e-3


def brute(rows):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            one = np.array(v, np.float64)
            good[k] = one / np.abs(one).max()
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in good:
        for j in good:
            if j < i and len(good[i]) == len(good[j]):
                if good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= 0.9:
                    links[i] += 1
                    links[j] += 1
                    parent[top(i)] = top(j)
    least = {}
    for k, (key, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), key), key)
    return sorted((key, links[k], least[top(k)], key == least[top(k)]) for k, (key, _) in enumerate(rows))


@pytest.mark.parametrize("block,pivots", [(8_192, 64), (16, 5), (16, 1)])
def test_equals_all_cosines(spark, block, pivots):
    rng = np.random.default_rng(8)
    vectors = [v.tolist() for v in clouds(rng, 25, 6, 0.15) * rng.uniform(0.1, 50, 1)]
    vectors += [vectors[3]] * 40 + [None, [], [0.0] * 6, [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [None] + [1.0] * 5, [1.0, 2.0], [2.0, 4.0],
                [-0.0, 1.0], [0.0, 1.0], [1e-300, 2e-300]]
    rows = [(1000 - i, v) for i, v in enumerate(vectors)]
    table = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<double>, label int, node string").repartition(3)
    got = C.near_duplicates(table, pivots=pivots, block=block).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == brute(rows)


def test_null_id_and_empty(spark):
    table = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in C.near_duplicates(table).collect()))
    assert got == [(0, 0, None, False), (1, 1, 1, True), (1, 1, 1, True)]
    assert C.near_duplicates(table.limit(0)).count() == 0


def test_radius_of_near_copies():
    rng = np.random.default_rng(4)
    for far in (3e-4, 1e-3, 3e-3):
        one = rng.normal(size=64)
        rows = one / np.linalg.norm(one) + far / 8 * rng.normal(size=(300, 64))
        tree = C.CoverTree(rows / np.linalg.norm(rows, axis=1, keepdims=True))
        held = tree.vectors.astype(np.float64)
        assert abs(tree.reach[0] - np.linalg.norm(held - held[0], axis=1).max()) < 1e-8
