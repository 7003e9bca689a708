"""Jaccard join against all pairs, its pruning rule, and components."""

import random

import numpy as np
import pytest

from wavelane.llm import jaccard_join as J
from wavelane.llm.components import components, local_roots
from wavelane.llm.shingles import shingle_hashes, shingle_set


def word_shingles(text, k=5):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    size = min(k, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(rows, threshold=0.8):
    """(key, class, links) by comparing all pairs."""
    sets = [word_shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), key), key)
    return sorted((key, least[top(i)], links[i]) for i, (key, _) in enumerate(rows))


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    hot = [rng.choice(words) for _ in range(120)]
    for _ in range(60):
        copy = list(hot)
        copy[rng.randrange(120)] = rng.choice(words)
        rows.append(", ".join(copy).upper())
    rows += [" ".join(hot)] * 20 + ["", " .. ", "one two", "One  two!", "one two three", None]
    rng.shuffle(rows)
    return [(100 + i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block,exact", [(512, 128), (8, 4)])
def test_equals_all_pairs(spark, monkeypatch, block, exact):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "EXACT_BLOCK", exact)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, size int, node string").repartition(4)
    got = sorted(tuple(r) for r in J.classes_and_links(docs).collect())
    assert got == brute(rows)


def test_null_ids_repeated_rows_and_empty(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(7, text), (7, text), (None, text), (9, "x y"), (9, text), (5, None)], "doc_id long, text string")
    got = sorted(((r["key"] or 0, r["class_id"], r["n_links"]) for r in J.classes_and_links(docs).collect()))
    assert got == [(0, None, 0), (5, 5, 0), (7, 7, 2), (7, 7, 2), (9, 7, 2), (9, 9, 0)]
    assert J.classes_and_links(docs.limit(0)).count() == 0


def test_repeated_rows_with_near_copies(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(7, " ".join(words)), (8, near), (7, " ".join(words)), (9, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        spark.conf.set(batch, "1")  # the repeated row comes in a batch of its own
        assert sorted(tuple(r) for r in J.classes_and_links(docs).collect()) == brute(rows)
    finally:
        spark.conf.set(batch, before)


def test_keep_one(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in J.keep_one(docs).collect())
    assert kept == sorted({c for _, c, _ in brute(rows)})
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in J.keep_one(twice).collect()] == [(1, "a b c")]


def test_long_text_in_runs(monkeypatch):
    from wavelane.llm import shingles

    text = " ".join(f"word{i * 7919 % 1000}" for i in range(3000)) + " " + "z" * 900
    whole = shingle_hashes(text)
    monkeypatch.setattr(shingles, "RUN", 200)
    assert (shingle_hashes(text) == whole).all()
    assert len(shingle_set(text)) == len(word_shingles(text))


def test_posterior_bound():
    t, tol = 0.8, 1e-7
    grid = np.linspace(0, 1, 200_001)
    for n, least in J.least_matches(t, tol):
        def posterior(m):
            like = np.exp(m * np.log(np.maximum(grid, 1e-300)) + (n - m) * np.log(np.maximum(1 - grid, 1e-300)))
            return like[grid >= t].sum() / like.sum()
        assert posterior(least) >= tol * 0.9
        if least:
            assert posterior(least - 1) < tol * 1.1


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({found[i] for i in range(61)}) == 1 and len({found[i] for i in (200, 201, 202)}) == 1
    assert found[0] != found[200] and 300 not in found
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_local_roots():
    root = local_roots(7, np.array([5, 4, 3, 6]), np.array([4, 3, 2, 1]))
    assert root.tolist() == [0, 1, 2, 2, 2, 2, 1]
