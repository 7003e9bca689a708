"""The pipeline against a plain version of its stages, and its odd inputs."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_similarity import brute, word_shingles
from wavelane.llm import langid, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_run_equals_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    machine = lexicon.automaton()
    rows = [(i, t) for i, t in rows if lexicon.load(t, machine) < lexicon.cut]
    ids = [i for i, _ in rows]
    model = langid.fit(docs.where(docs["doc_id"].isin(ids)))
    rows = [(i, t) for i, t in rows if model.score(t)[0] != "und" and model.score(t)[1] >= 0.5]
    first = {c for _, c, _ in brute(rows)}
    rows = [(i, t) for i, t in rows if i in first]
    items = [word_shingles(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(q and len(q & word_shingles(t)) >= 0.8 * len(q) for q in items)]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = plain.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_stages_on_odd_rows(spark):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    text = source.where("lang = 'en'").first()["text"]
    rows = [(1, text, "en", "s", 1, "x"), (1, text, "en", "s", 1, "x"), (None, text, None, None, None, None), (2, None, "en", "s", 0, "x"), (3, "", "en", "s", 0, "x"),
            (4, "12 34", "en", "s", 0, "x"), (5, text + " " + text, "en", "s", 0, "x"), (6, text, "en", None, 0, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, FOLDER)
            if name != "bpe":
                assert docs.columns == columns, name
        found = sorted((r["doc_id"] or 0 for r in docs.collect()))
        assert found in ([0, 1], [])  # row 5 says the same twice, so it is a copy
