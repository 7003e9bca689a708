"""Registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from functools import wraps

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

import corpus_pipeline
from wavelane.llm import bpe, cover_tree, cross_align, decontaminate, exact_topk, html_text, jaccard_join, langid, licenses, \
    periodic_runs, token_files, toxicity, url_graph
from wavelane.llm.common import fold, prepare, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, batch: int = 2_000):
    def register(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            prepare(spark, batch)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_jaccard_join")
def op1(spark, sf_dir):
    return jaccard_join.classes_and_links(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


@query("op2_license_scan")
def op2(spark, sf_dir):
    return licenses.license_spans(table(spark, sf_dir, "documents")).drop("matched")


# The rules of the query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op3_url_filter", url_graph.twin(URL_RULES))
def op3(spark, sf_dir):
    return url_graph.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op4_bpe")
def op4(spark, sf_dir):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op5_language_id")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    judged = langid.predict(docs.select("doc_id", "text"), model, into="judged")
    return judged.select("doc_id", held_out.alias("held_out"), "judged.lang_pred", "judged.score")


@query("op6_toxicity")
def op6(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    lexicon = toxicity.learn(docs, labels.where(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), lexicon, into="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_html_text")
def op9(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op10_token_files")
def op10(spark, sf_dir):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    read = token_files.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), definition)
    return read.select(F.col("key").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op7_embedding_near_duplicates")
def op7(spark, sf_dir):
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_decontamination", decontaminate.twin())
def op8(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """In one text of ten, by the hash of doc_id, the words from a chosen one on repeat with a chosen period; others stay."""
    @F.pandas_udf("string")
    def repeat(texts: pd.Series, hashes: pd.Series) -> pd.Series:
        def one(text, h):
            words, g = bytes(text).split(), int(h) // 10
            if not words:
                return ""
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            tail = words[a:a + p]
            return b" ".join(words[:a] + (tail * ((len(words) - a) // p + 1))[:len(words) - a]).decode()
        return pd.Series([one(t, h) if t is not None else None for t, h in zip(texts, hashes)], dtype=object)

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    # The other texts reach Python as nulls only.
    return docs.withColumn("text", F.when(chosen, repeat(F.when(chosen, F.col("text").cast("binary")), h)).otherwise(F.col("text")))


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    docs = planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs).select("doc_id", "periodic.*").withColumn("best", periodic_runs.strongest(F.col("runs")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(periodic_runs.listing(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op12_cross_tokenizer", batch=500)
def op12(spark, sf_dir):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    told = cross_align.align(table(spark, sf_dir, "documents").select("doc_id", "text"), definition, model, public_tokenizers.PATTERN)
    listing = F.col("listing")
    return told.select("doc_id", *cross_align.NUMBERS,
                       F.when(listing == "", "").otherwise(F.sha2(listing.cast("binary"), 256)).alias("groups_sha256"))


OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
"""


@query("op13_exact_topk", OP13_SQL)
def op13(spark, sf_dir):
    finite = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(F.coalesce(~finite, F.lit(False))).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    best = exact_topk.exact_top_k(rows.where(F.col("vec_id") % 50 == 0), rows)
    return best.withColumnRenamed("query", "query_id")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
