"""Language identification and toxicity on small fixtures and on held-out rows."""

import numpy as np
import pytest

from wavelane.llm import langid, toxicity
from wavelane.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_language_of_small_texts(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the hat", "en"), ("der Hund und die Katze", "de"),
                                                  ("this is the other thing", "en"), ("das ist nicht der Weg", "de")] * 5)]
    model = langid.fit(spark.createDataFrame([*rows, (99, None, "fr"), (98, "xx", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    docs = spark.createDataFrame([(1, "the thing", "de"), (2, None, "x"), (3, "12 !?", "x"), (4, "", "x"), (5, "und nicht " * 60_000, "x"),
                                  (5, "und nicht", "x")], "doc_id long, text string, score string")
    got = langid.predict(docs, model, into="judged").select("doc_id", "score", "judged.*").collect()
    assert [r["lang_pred"] for r in got] == ["en", "und", "und", "und", "de", "de"]
    assert [r[3] for r in got[1:4]] == [0.0] * 3 and got[4][3] > 0.99
    assert [r["doc_id"] for r in langid.keep_known(docs, model).collect()] == [1, 5, 5]
    assert langid.predict(docs.limit(0), model).count() == 0


def test_language_runs_equal_whole(monkeypatch):
    points = langid.codes("Ein ziemlich langer Text, der in Stücken gelesen wird. " * 20)
    whole = np.sort(np.concatenate(list(langid.gram_buckets(points, 512))))
    monkeypatch.setattr(langid, "RUN", 37)
    assert (np.sort(np.concatenate(list(langid.gram_buckets(points, 512)))) == whole).all()


def test_naive_bayes_equals_counts(spark):
    rows = [(1, "ab ba", "x"), (2, "bb", "y"), (3, "abab", "x")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), buckets=64, smoothing=0.5)
    for k, name in enumerate(model.languages):
        counts = np.full(64, 0.5)
        for _, text, lang in rows:
            if lang == name:
                for ids in langid.gram_buckets(langid.codes(text), 64):
                    counts += np.bincount(ids, minlength=64)
        assert np.allclose(model.log_prob[:, k], np.log(counts / counts.sum()))
    assert np.allclose(np.exp(model.log_prior), [2 / 3, 1 / 3])


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.fit(docs).score("abc") == ("und", 0.0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert [r["toxicity"] for r in toxicity.score(docs, lexicon).collect()] == [0.0]


@pytest.mark.parametrize("raw,folded", [("TRÄSH  bin", "trash bin"), ("1d10t", "idiot"), ("l0s3r!", "loser!"), ("$cum", "scum"), ("ѕсum", "scum"),
                                        ("wow$$$ and%%%", "wow$$$ and%%%"), ("route 66", "route 66"), (None, ""), (" \n", ""), ("idio7", "idiot")])
def test_fold(raw, folded):
    assert toxicity.fold(raw) == folded


def test_matches_equal_a_scan():
    lexicon = toxicity.Lexicon({"trash": 2.0, "scum": 3.0, "trash bag": 1.0}, ["trash can", "no scum"], 0.1)
    machine = lexicon.automaton()
    for text, total in [("trash", 2), ("trashed scum", 3), ("the trash can", 0), ("trash can trash", 2), ("no scum scum", 3),
                        ("a trash bag", 3), ("a tr4sh bag", 3), ("", 0), ("scum.trash", 5)]:
        words = max(len(text.split()), 1)
        assert lexicon.load(text, machine) == pytest.approx(total / words)


def test_best_cut():
    assert toxicity.best_cut(np.array([0, 0, 0.2, 0.4]), np.array([0, 0, 1, 1])) == pytest.approx(0.1)
    assert toxicity.best_cut(np.array([0, 0.1, 0.2, 0.4]), np.array([0, 0, 1, 1])) == pytest.approx(0.15)
    assert toxicity.best_cut(np.zeros(3), np.array([0, 1, 1])) == 1.0


def test_learns_words_weights_and_exceptions(spark):
    docs, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        text = f"plain words {i} here " + ("you vile thing" if toxic else "the vile weed" if i % 7 == 0 else "")
        docs.append((i, text, "en", i))
        labels.append((i, int(toxic), None))
    docs = spark.createDataFrame([*docs, (None, "vile", "en", 1), (400, None, "en", 1)], "doc_id long, text string, lang string, load long")
    labels = spark.createDataFrame([*labels, (None, 1, 1), (7, None, 1), (0, 1, 1)], "doc_id long, toxic int, quality int")
    lexicon = toxicity.learn(docs, labels)
    assert "vile" in lexicon.weights and "plain" not in lexicon.weights
    assert "vile weed" in lexicon.exceptions
    new = spark.createDataFrame([(1, "a vile man"), (2, "a vile weed"), (3, "V1LE man"), (4, None), (4, "")], "doc_id long, text string")
    assert [r["doc_id"] for r in toxicity.keep_clean(new, lexicon).collect()] == [2, 4, 4]
    assert toxicity.score(new.limit(0), lexicon).count() == 0


def test_held_out_rows(spark):
    """Whole queries at a small scale: languages of held-out rows; no clean document is called toxic."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op5_language_id"](spark, FOLDER).join(docs, "doc_id").where("held_out").toPandas()
    assert len(found) > 150 and (found["lang"] == found["lang_pred"]).mean() > 0.99
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    judged = QUERIES["op6_toxicity"](spark, FOLDER).join(labels, "doc_id").toPandas()
    assert judged[judged["toxic"] == 0]["predicted"].sum() == 0
    assert judged[judged["toxic"] == 1]["predicted"].mean() > 0.5
