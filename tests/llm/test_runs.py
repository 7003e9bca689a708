"""Periodic runs against their definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from wavelane.llm import periodic_runs
from wavelane.llm.queries import QUERIES, planted_runs


def plain_runs(words, exponent=4, least=6):
    """Every maximal stretch of every period, with a period no smaller one explains."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - i >= max(least, exponent * q):
                found.setdefault((i, end + q - i), q)
            i = end + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def plain_collapse(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made_texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        letters = "ab" if rng.random() < 0.5 else "abcdefgh"
        words = [rng.choice(letters) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, 6))]
            repeated = (unit * 9)[:rng.randrange(2, 9 * len(unit) + 1)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = repeated
        out.append(words)
    return out


@pytest.mark.parametrize("seed,exponent,least", [(1, 4, 6), (2, 2, 2), (3, 3, 4), (4, 4, 6)])
def test_find_runs_equals_definition(seed, exponent, least):
    texts = made_texts(seed)
    number = {}
    codes = np.array([k * 1000 + number.setdefault(w, len(number)) for k, t in enumerate(texts) for w in t], np.int64)
    sizes = np.array([len(t) for t in texts])
    got = periodic_runs.find_runs(codes, sizes, exponent, least)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    for k, words in enumerate(texts):
        mine = got[(got[:, 0] >= begins[k]) & (got[:, 0] < begins[k + 1])] - [begins[k], 0, 0]
        assert [tuple(r) for r in mine.tolist()] == plain_runs(words, exponent, least), words


def test_multiples_of_a_period_are_one_run():
    for q in (1, 2, 3, 7):
        unit = np.arange(q)
        for n in (6 * q, 16 * q + q // 2, 2000):
            codes = np.concatenate([[90], np.resize(unit, n), [91]])
            assert periodic_runs.find_runs(codes, np.array([len(codes)]), 4, 6).tolist() == [[1, n, q]]


def test_odd_inputs(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \t\n ", "z"), (4, "a a a a a a b", "w"), (4, "a a a a a a b", "w"), (None, "a a a a", "v"),
            (6, "é " * 50, "u"), (7, "\x1ca a\x1c " * 3, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, periodic string")  # a column that clashes with the result
    for block in (5, 400_000):
        got = periodic_runs.periodic_runs(docs, block=block).select("doc_id", "periodic.*").collect()
        assert len(got) == len(rows)
        for r, (key, text, _) in zip(got, rows):
            words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
            runs = plain_runs(words)
            assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == plain_collapse(words, runs)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_long_text(spark):
    """200,000 words: a long run of one word, one of a long period, and words that do not repeat."""
    words = ["x"] * 50_000 + [f"w{i}" for i in range(50_000)] + [f"v{i % 10_000}" for i in range(50_000)] + [f"w{i}" for i in range(50_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = periodic_runs.periodic_runs(docs).select("periodic.*").first()
    assert [tuple(r) for r in row["runs"]] == [(0, 50_000, 1), (100_000, 50_000, 10_000)]
    assert len(row["collapsed"].split()) == 1 + 50_000 + 10_000 + 50_000


def plain_query(key, text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    listing = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    s, m, q = best or (None,) * 3
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listing, plain_collapse(words, runs))]
    return (len(runs), s, m, q, 1000 * m // q if best else None, *sha)


def test_query_equals_definition(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(t) for t in made_texts(11)] * 4 + [None, "", " ", "one", "é é é é é é"]
    rows = [(i if i % 40 else None if i else 0, t) for i, t in enumerate(texts)] + [(rng.randrange(1 << 60), "a b c d e f g h " * 3) for _ in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    keyed = sorted([(r["doc_id"], *(r[c] for c in names)) for r in got if r["doc_id"] is not None], key=str)
    assert keyed == sorted([(k, *plain_query(k, t)) for k, t in rows if k is not None], key=str)
    assert len(got) == len(rows)


def test_planting_keeps_other_rows(spark):
    docs = spark.createDataFrame([(None, "a  b"), (1, None)], "doc_id long, text string")
    assert [tuple(r) for r in planted_runs(docs).collect()] == [(None, "a  b"), (1, None)]
