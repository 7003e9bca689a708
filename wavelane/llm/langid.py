"""Language identification by multinomial naive Bayes over hashed character n-grams.

``fit`` counts n-grams per language in Spark and keeps one log-probability matrix (buckets x languages); its size is set by
parameters, so it is shipped to the tasks. ``predict`` scores whole texts in numpy, a bounded run of characters at a time.

Cases: a null text, an empty one and one without a letter are ``und`` with score 0. Languages tie towards the smaller name.
Rows repeat as they come; other columns of the input pass through. An empty training set gives a model that knows no language
and answers ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from wavelane.llm.common import free_name

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
ROWS_PER_LANGUAGE = 4_000  # bound of the training sample
LANGUAGES = 1_000          # most languages one model may hold
RUN = 1 << 18              # characters scored at once

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def codes(text: str | None) -> np.ndarray:
    """Lower-cased code points with everything but letters as a space; empty without letters."""
    if not text:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    return np.where(letter, points, 32).astype(np.uint32) if letter.any() else np.zeros(0, np.uint32)


def gram_buckets(points: np.ndarray, buckets: int):
    """Hashed n-grams of a text, in runs of bounded length; blank ones are left out."""
    for start in range(0, len(points), RUN):
        run = points[start:start + RUN + max(SIZES) - 1].astype(np.uint64)
        for n in SIZES:
            count = min(RUN, len(run) - n + 1)
            if count <= 0:
                continue
            h, filled = np.full(count, n, np.uint64), np.zeros(count, bool)
            for k in range(n):
                part = run[k:k + count]
                h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
                filled |= part != 32
            yield ((h[filled] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray

    def score(self, text: str | None) -> tuple[str, float]:
        points = codes(text)
        if not len(points) or not self.languages:
            return "und", 0.0
        total = self.log_prior.copy()
        for ids in gram_buckets(points, len(self.log_prob)):
            total += self.log_prob[ids].sum(axis=0)
        best = int(np.argmax(total))
        return self.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", buckets: int = BUCKETS,
        rows_per_language: int = ROWS_PER_LANGUAGE, smoothing: float = 0.5) -> Model:
    """Learn from rows with text and language; at most about ``rows_per_language`` rows of each language are read."""
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")) \
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(rows)
    if not languages:
        return Model([], np.zeros((buckets, 0)), np.zeros(0))
    share = F.lit(0)
    for name, n in rows.items():
        share = F.when(F.col("lang") == name, int(1_000_000 * min(1.0, rows_per_language / n))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("key", F.lit("fit")), F.lit(1_000_000)) < share)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for value, name in zip(batch["text"], batch["lang"]):
                held = sums.setdefault(name, np.zeros(buckets, np.int64))
                for ids in gram_buckets(codes(value), buckets):
                    held += np.bincount(ids, minlength=buckets)
        for name, held in sums.items():
            at = np.flatnonzero(held)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": held[at]})

    counts = chosen.select("text", "lang").mapInPandas(count, "lang string, bucket long, n long") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # at most buckets x languages rows
    table = np.full((buckets, len(languages)), smoothing)
    place = {name: i for i, name in enumerate(languages)}
    for r in counts:
        table[r["bucket"], place[r["lang"]]] += r["n"]
    weight = np.array([min(rows[name], rows_per_language) for name in languages], float)
    return Model(languages, np.log(table / table.sum(axis=0)), np.log(weight / weight.sum()))


def predict(docs: DataFrame, model: Model, text: str = "text", into: str | None = None) -> DataFrame:
    """Add a struct (lang_pred, score) to every row, under ``into`` or a free name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages doubles

    @F.pandas_udf(RESULT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.score(t) for t in texts]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return docs.withColumn(into or free_name(docs, "language"), judge(F.col(text)))


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """Rows whose language is known with at least that score; columns as they were."""
    name = free_name(docs, "language")
    judged = predict(docs, model, text, name)
    return judged.where((F.col(name)["lang_pred"] != "und") & (F.col(name)["score"] >= least)).drop(name)
