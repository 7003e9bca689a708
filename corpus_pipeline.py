"""A corpus from documents: toxicity, language, near-duplicates and benchmark passages out, then token ids.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs. All but the
last return the columns of documents. Texts that are null or empty are not toxic, have no language (so the second stage drops
them), link with nothing and hold no test item. An empty table passes through as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wavelane.llm import bpe, decontaminate, jaccard_join, langid, toxicity
from wavelane.llm.common import prepare, table
from wavelane.runtime import write_through


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the score that parts toxic labels from clean ones; the lexicon is learnt from labelled documents."""
    prepare(spark)
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a probability of at least one half; null and letterless texts go."""
    prepare(spark)
    return langid.keep_known(docs, langid.fit(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more, the one with the smallest id."""
    prepare(spark)
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the shingles of every test item."""
    prepare(spark)
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the bytes they decode to."""
    prepare(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("language_id", drop_unknown_language), ("jaccard_join", keep_one_of_each_group),
          ("decontamination", drop_contaminated), ("bpe", encode)]

ORACLE_SQL = None  # the first two stages are learnt models, the last is a tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = write_through(stage(spark, docs, sf_dir))
    return docs
