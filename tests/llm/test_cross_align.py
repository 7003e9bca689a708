"""Cross-tokenizer alignment against the two libraries and loops over byte offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wavelane.llm import cross_align
from wavelane.llm.queries import QUERIES


@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return definition, file.read()


@pytest.fixture(scope="module")
def plain(files):
    a = Tokenizer.from_str(files[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    alphabet = cross_align.byte_alphabet()

    def spans(text):
        """[(id, begin, end)] of both, or none where bytes differ"""
        if not text:
            return [], []
        x = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if any(b"".join(t for _, t in side) != (" " + text).encode() for side in (x, y)):
            return [], []
        out = []
        for side in (x, y):
            at, placed = 0, []
            for i, t in side:
                placed.append((i, at, at + len(t)))
                at += len(t)
            out.append(placed)
        return tuple(out)
    return spans


def plain_rows(spans, rows):
    placed = [spans(t) for _, t in rows]
    linked = [[(i, j) for i, (_, s, e) in enumerate(x) for j, (_, u, v) in enumerate(y) if s < v and u < e] for x, y in placed]
    counts = Counter((x[i][0], y[j][0]) for (x, y), links in zip(placed, linked) for i, j in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (key, _), (x, y), links in zip(rows, placed, linked):
        ends = sorted({e for _, _, e in x} & {e for _, _, e in y})
        groups, begin = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, _ in side if begin <= s < end) for side in (x, y)))
            begin = end
        pairs = [(x[i][0], y[j][0]) for i, j in links]
        listing = ";".join(groups)
        out.append((key, len(x), len(y), len(groups), len(links), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs),
                    hashlib.sha256(listing.encode()).hexdigest() if x else ""))
    return sorted(out, key=str)


def made_rows():
    rng = random.Random(3)
    parts = ["the", "Über", " ", "  ", "\n", "\t ", "don't", "123", "!?", "日本語", "é", "🙂", "transformation", " analytics", " of", "a" * 30, " ", "ﬁ"]
    made = ["".join(rng.choice(parts) for _ in range(n)) for n in (1, 3, 10, 40, 100)]
    texts = [None, "", " ", "a", "<|endoftext|> and </s><s><unk> <0x41>", "▁ under ▁line", "x\x00y", *made, made[-1], made[-1], "The same words are here, the same words."]
    return [(i, t) for i, t in enumerate(texts)]


def test_row_products_equal_dense_products():
    rng = np.random.default_rng(1)
    for room in (1, 7, 1 << 20):
        for shape in ((1, 1, 1), (5, 8, 3), (20, 11, 30), (3, 0, 4), (0, 3, 2)):
            left, right = (rng.random(s) < 0.3 for s in (shape[:2], shape[1:]))
            sparse = [cross_align.Rows(np.concatenate([[0], np.cumsum(m.sum(1))]).astype(int), np.nonzero(m)[1], m.shape[1]) for m in (left, right)]
            got = np.zeros((shape[0], shape[2]), int)
            for x, y, n in cross_align.row_products(*sparse, room):
                assert (got[x, y] == 0).all()
                got[x, y] = n
            assert (got == left.astype(int) @ right.astype(int)).all()
            back = cross_align.transpose(cross_align.transpose(sparse[0]))
            assert (back.begin == sparse[0].begin).all() and (back.at == sparse[0].at).all()


def test_query_equals_loops(spark, plain, tmp_path):
    rows = made_rows()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_cross_tokenizer"](spark, str(tmp_path))
    names = ["doc_id", *cross_align.NUMBERS, "groups_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == plain_rows(plain, rows)


@pytest.mark.parametrize("held,rows_of_block", [(0, 256), (0, 2), (10 ** 6, 256)])
def test_both_ways_of_meeting_counts_agree(spark, files, plain, monkeypatch, held, rows_of_block):
    monkeypatch.setattr(cross_align, "BLOCK_ROWS", rows_of_block)
    rows = made_rows() * 2
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_a int, listing string")
    got = cross_align.align(docs, *files, pattern=public_tokenizers.PATTERN, held=held)
    assert got.columns == ["doc_id", *cross_align.NUMBERS, "listing"]
    found = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in map(tuple, got.collect())]
    assert sorted(found, key=str) == plain_rows(plain, rows)


def test_links_and_shared_groups(spark, files, plain):
    rows = made_rows()
    pair = cross_align.Tokenizers(spark, *files)  # without a pattern: the tokenizers library itself
    coded = cross_align.tokenize(spark.createDataFrame(rows, "doc_id long, text string"), pair)
    found, shared = [sorted(map(tuple, cross_align.links(coded, pair, shared=s).collect())) for s in (False, True)]
    want, want_shared = [], []
    for key, text in rows:
        x, y = plain(text)
        ends = sorted({e for _, _, e in x} & {e for _, _, e in y})
        for i, (p, s, e) in enumerate(x):
            for j, (q, u, v) in enumerate(y):
                if s < v and u < e:
                    want.append((key, i, j, p, q, min(e, v) - max(s, u)))
                if next(k for k in ends if k >= e) == next(k for k in ends if k >= v):
                    want_shared.append((key, i, j, p, q, None))
    assert found == sorted(want) and shared == sorted(want_shared)


def test_empty_table(spark, files):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert cross_align.align(docs, *files).count() == 0
    assert cross_align.align(docs, *files, held=-1).count() == 0


def test_ranks_equal_the_library(files):
    """All characters of the basic plane, next to letters, digits, blanks and each other."""
    ranked = cross_align.TokenPair(*files, public_tokenizers.PATTERN)
    assert ranked.ranks is not None
    chars = [chr(c) for c in range(0x20, 0x10000, 3) if not 0xD800 <= c < 0xE000]
    texts = [f" a{c}b 1{c}2 {c} {c}{c}\n{c}  {c}" for c in chars]
    got = [ranked.ranks.encode_ordinary(t) for t in texts]
    assert got == [e.ids for e in ranked.library.encode_batch_fast(texts, add_special_tokens=False)]
