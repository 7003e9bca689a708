"""Exact top-k against all inner products."""

import math
import random

import numpy as np
import pytest

from wavelane.llm import exact_topk
from wavelane.llm.queries import QUERIES

LONG = (1 << 63) - 1


def plain_top(queries, rows, k):
    out = []
    for q, v in queries:
        if q is None or v is None or None in v:
            continue
        scored = [(-max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(v, w)))), c) for c, w in rows
                  if c is not None and w is not None and None not in w and c != q]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def made(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (6, width))
    rows = [(i, (centres[i % 6] + rng.integers(-spread, spread + 1, width)).tolist()) for i in range(n)]
    for i in range(0, n, 3):  # a third of all rows is one vector
        rows[i] = (i, rows[0][1])
    return rows


def table_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vector array<long>")


@pytest.mark.parametrize("n,width,spread,pivots,block,chunk", [(300, 8, 20, 8, 16, 4), (200, 3, 2, 5, 1000, 512), (150, 5, 300, 1, 10, 7)])
def test_equals_all_products(spark, n, width, spread, pivots, block, chunk):
    rows = made(n, n, width, spread)
    queries = rows[::7] + [rows[3], (10 ** 6, [5] * width)]  # a repeated query, and one that is no row
    got = exact_topk.exact_top_k(table_of(spark, queries), table_of(spark, rows), 5, pivots=pivots, block=block, chunk=chunk)
    assert got.columns == ["query", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top(queries, rows, 5)


def test_odd_inputs(spark):
    rows = [(1, [1, 2]), (1, [1, 2]), (2, [3]), (3, []), (4, None), (5, [1, None]), (None, [9, 9]), (6, [-4, 0, 7]), (7, [LONG, LONG]), (8, [-LONG - 1])]
    got = exact_topk.exact_top_k(table_of(spark, rows), table_of(spark, rows), 3, block=2)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, rows, 3)
    empty = table_of(spark, [])
    assert exact_topk.exact_top_k(empty, table_of(spark, rows)).count() == 0
    assert exact_topk.exact_top_k(table_of(spark, rows), empty).count() == 0
    assert exact_topk.exact_top_k(table_of(spark, rows[:1]), table_of(spark, rows[:2])).count() == 0  # no row but its own


def test_bounds_leave_rows_out():
    """On clusters, bounds stop a search long before all rows are evaluated, and never too early."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-500, 500, (40, 16))
    vectors = np.concatenate([c + rng.integers(-5, 6, (50, 16)) for c in centres])
    pivots = exact_topk.farthest_first(vectors, 40)
    norm, table = exact_topk.distances(vectors, pivots)
    shares = []
    for q in range(0, len(vectors), 97):
        gap = np.abs(table - table[q]).max(axis=1)
        bound = exact_topk.upper_bounds(norm, norm[q], gap, float(norm.max()))
        score = vectors @ vectors[q]
        assert (bound >= score).all()
        score[q] = -(1 << 60)
        shares.append((bound >= np.sort(score)[-5]).mean())
    assert np.mean(shares) < 0.3


def test_query_equals_definition(spark, tmp_path):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 0.1) for _ in range(12)], i % 3) for i in range(400)]
    vectors += [(450, None, 1), (500, [0.5, None], 1), (550, [float("nan")] * 12, 1), (600, [float("inf")] * 12, 1), (650, [0.1] * 12, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v] if v and all(x is not None and math.isfinite(x) for x in v) else None)
            for i, v, _ in vectors]
    want = plain_top([r for r in ints if r[0] % 50 == 0], ints, 5)
    got = QUERIES["op13_exact_topk"](spark, str(tmp_path))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == want
