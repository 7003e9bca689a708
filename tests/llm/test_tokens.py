"""BPE and token files against the libraries that define their results."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from wavelane.llm import bpe, token_files

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def plain(ranks):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def texts():
    rng = random.Random(5)
    parts = ["the", "Über", " ", "  ", "\n", "\n\n", "\t ", "don't", "'ll", "123", "1", "!?", "日本語", "é", "🙂", "a" * 30, " ", "x'sy"]
    made = ["".join(rng.choice(parts) for _ in range(n)) for n in (1, 5, 40, 200, 500, 900)]
    return [None, "", " ", "\n\n \n", "a", "<|endoftext|> ordinary", "a" * 700, " " * 700, *made, made[-1], made[3] * 4]


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (100, 50), (1 << 16, 1 << 10)])
def test_encode_equals_library(spark, ranks, plain, chunk, overlap):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a column that clashes with the result
    coded = bpe.decode(bpe.encode(docs, ranks, PATTERN, chunk=chunk, overlap=overlap), ranks, PATTERN)
    got = {r["doc_id"]: r for r in coded.collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == plain.encode_ordinary(t or "")
        assert bytes(got[i]["decoded"]) == (t or "").encode()


def test_repeated_rows_and_empty_table(spark, ranks, plain):
    docs = spark.createDataFrame([(1, "ab " * 100)] * 3 + [(None, "z")], "doc_id long, text string")
    coded = bpe.encode(docs, ranks, PATTERN, chunk=50, overlap=20).collect()
    want = np.array(plain.encode_ordinary("ab " * 100), "<u4").tobytes()
    assert sorted((r["doc_id"] or 0, bytes(r["ids"]) == want) for r in coded) == [(0, False), (1, True), (1, True), (1, True)]
    assert bpe.digests(docs.limit(0), ranks, PATTERN).count() == 0


def test_digests(spark, ranks, plain):
    docs = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string")
    for r in bpe.digests(docs, ranks, PATTERN).collect():
        text = "Hello there" if r["doc_id"] == 1 else ""
        ids = plain.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def test_token_files_round_trip(spark, definition):
    tokenizer = Tokenizer.from_str(definition)
    rows = [(i * 7 % 60 - 5, t, "f", i) for i, t in enumerate(texts() + ["Straße ΣΑΣ", "a\x1cb c", "é É"])]
    rows += [(500, "same", "f", 1), (500, "same", "f", 2), (500, "other", "f", 3), (None, "lost", "f", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, shard long").repartition(5)
    got = sorted((r["key"], r["start"], r["n"], zlib.crc32(r["ids"])) for r in token_files.round_trip(docs, definition).collect())
    want = [(k, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for k, t, _, _ in rows if k is not None]
    assert sorted((k, n, c) for k, _, n, c in got) == sorted((k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in want)
    at = 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):  # no gaps, ascending keys
        assert start == at
        at += n
    assert [k for k, _, _, _ in sorted(got, key=lambda r: r[1])] == sorted(k for k, _ in want)


def test_words_give_the_ids_of_whole_texts(definition):
    rng = random.Random(4)
    coder = token_files.WordCoder(definition)
    parts = ["Word", "ÉTÉ", "e\u0301", "İ", "ΣΑΣ", "ß", "ǅ", ".", ",", ". ", ", ", "..", '"', "'s", "_", " ", "\n", "12", "\x1c", "K", "<|endoftext|>", "\u00a0"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    want = coder.tokenizer.encode_batch(made, add_special_tokens=False)
    for _ in range(2):  # new words, then held ones
        assert [np.frombuffer(x, coder.type).tolist() for x in coder.encode(made)] == [w.ids for w in want]


def test_index_is_minimal_and_refuses_strangers(spark, definition):
    docs = spark.range(5000).selectExpr("id * 3 as doc_id", "concat('w ', id) as text")
    folder, index, shards = token_files.write(docs, definition, 1)
    for r in index.collect():
        assert len(r["slots"]) % token_files.SLOT.itemsize == 0
    assert sum(len(r["slots"]) for r in index.collect()) == 5000 * token_files.SLOT.itemsize
    keys = spark.createDataFrame([(0, 0), (14997, 0), (1, 0), (3, 1), (None, 0)], "key long, occurrence int")
    found = token_files.read_payload(token_files.lookup(index, keys), shards, folder).collect()
    assert sorted(r["key"] for r in found) == [0, 14997]


def test_empty_table(spark, definition):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.round_trip(docs, definition).count() == 0


def test_levels_place_every_id_once():
    ids = token_files._identity(np.arange(10_000), np.zeros(10_000, int))
    slots = token_files.slots_of(ids, token_files.build_levels(ids))
    assert sorted(slots.tolist()) == list(range(10_000))
