"""License scan against a full alignment of every template with every text."""

import random
import re

import numpy as np
import pytest

from wavelane.llm import licenses as L

NOTICE = "Licensed under the Apache License, Version 2.0."


def words_of(text):
    return [m[0].lower() for m in re.finditer(r"[^\W_]+", text or "")]


def full_alignment(a, b):
    """Best local score and the most matched words among alignments with it, without a band."""
    score = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            score[i, j] = max(0, score[i - 1, j - 1] + (2 if x == y else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
    return score.max()


def test_winnow_guarantee():
    rng = random.Random(3)
    for _ in range(200):
        hashes = np.array([rng.randrange(9) for _ in range(rng.randint(1, 20))], np.uint64)
        at = L.winnow(hashes, 3)
        for k in range(max(len(hashes) - 2, 1)):
            window = range(k, min(k + 3, len(hashes)))
            assert any(p in window for p in at)
            assert min(hashes[list(window)]) in hashes[at]


def test_every_template_is_found_in_the_middle_of_noise():
    index, rng = L.build_index(L.TEMPLATES), random.Random(1)
    noise = lambda n: " ".join(f"n{rng.randrange(500)}" for _ in range(n))
    for name, text in L.TEMPLATES:
        body = noise(300) + "\n" + text + "\n" + noise(200)
        found = L.scan(body, index)
        assert [(f[0], f[1]) for f in found] == [(name, 1.0)]
        assert words_of(body[found[0][3]:found[0][4]]) == words_of(text)


@pytest.mark.parametrize("edits", [1, 4, 8])
def test_edited_text_equals_full_alignment(edits):
    index, rng = L.build_index(L.TEMPLATES), random.Random(edits)
    for name, text in [t for t in L.TEMPLATES if len(words_of(t[1])) > 30]:
        own = words_of(text)
        copy = list(own)
        for _ in range(edits):
            at = rng.randrange(len(copy))
            if rng.random() < 0.4:
                del copy[at]
            elif rng.random() < 0.5:
                copy.insert(at, "zzz")
            else:
                copy[at] = "zzz"
        body = [f"n{k}" for k in range(40)] + copy + [f"m{k}" for k in range(40)]
        matched, first, last = L.align(own, body, 40 - 12, 40 + 12)
        assert 40 <= first < last <= 40 + len(copy)
        gaps = full_alignment(own, body)
        assert 2 * matched - (last - first - matched) - edits <= gaps <= 2 * matched  # the score it stands for
        found = L.scan(" ".join(body), index)
        if matched >= L.COVERAGE * len(own):
            assert name in [f[0] for f in found]


def test_rows(spark):
    rows = [(1, f"x\n{NOTICE}\ny {NOTICE.upper()}"), (2, None), (3, ""), (4, "..."), (5, "no license here at all"), (None, "Released under the MIT License."),
            (6, "Released under the"), (7, NOTICE), (7, NOTICE), (8, "a " * 50_000 + NOTICE + " b" * 50_000), (9, "İİ " + NOTICE)]
    docs = spark.createDataFrame([(i, t, "s", 5) for i, t in rows], "doc_id long, text string, license string, start long")
    got = sorted(((r["doc_id"] or 0, r["license"], r["coverage"], r["matched"]) for r in L.license_spans(docs).collect()))
    notice = NOTICE[:-1]
    assert got == sorted([(1, "Apache-2.0", 1.0, notice), (1, "Apache-2.0", 1.0, notice.upper()), (0, "MIT", 1.0, "Released under the MIT License"),
                          (7, "Apache-2.0", 1.0, notice), (7, "Apache-2.0", 1.0, notice), (8, "Apache-2.0", 1.0, notice), (9, "Apache-2.0", 1.0, notice)])
    assert L.license_spans(docs.limit(0)).count() == 0
    assert L.license_spans(docs, []).count() == 0
    assert L.license_spans(docs, [("Own", "no license here"), ("Blank", "...")]).count() == 1


def test_query_finds_every_literal_notice(spark):
    import duckdb

    from wavelane.llm.queries import QUERIES
    folder = "/root/testdata/sf0.01"
    want = {}
    for notice, name in [("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"), ("This work is licensed under the GNU General Public License, version 3", "GPL-3.0"),
                         (NOTICE[:-1], "Apache-2.0"), ("Released under the MIT License", "MIT")]:
        for i, at in duckdb.connect().execute(f"SELECT doc_id, strpos(text, ?) FROM read_parquet('{folder}/documents.parquet') WHERE contains(text, ?)",
                                              [notice, notice]).fetchall():
            want[i, name] = (at - 1, at - 1 + len(notice))
    got = {(r["doc_id"], r["license"]): (r["start"], r["end"]) for r in QUERIES["op2_license_scan"](spark, folder).collect()}
    assert got == want and len(want) > 10
