"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding lower-cases, strips accents, maps look-alike letters of other scripts to Latin ones, and turns digits and signs that
stand for letters into those letters. ``learn`` counts the documents of each class per word in Spark, keeps the words that
stand out in toxic ones far beyond chance (log-odds as weight), and phrases around them that are harmless (exceptions). A
text's load is the sum of the weights of its matches outside exceptions, divided by its number of words; the score is
load / (load + cut) with the cut that best parts the training rows, so 0.5 lies at the cut.

Cases: null, empty and blank texts score 0. Repeated rows are scored alike. Other columns pass through. Without labelled rows,
or without a word that stands out, every score is 0.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from wavelane.llm.common import free_name, thin
from wavelane.runtime import write_through

ROWS_PER_CLASS = 15_000  # bound of the training sample, for toxic and for clean rows each

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans({
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ø": "o", "ł": "l",
    "­": None, "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None,
})
# Digits and signs written for letters.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"})

_run = re.compile(r"[0134578@$!]+(?=[^\W\d_])")       # before a letter
_end = re.compile(r"(?<=[^\W\d_])[0134578]+(?![\w@$!])")  # digits that end a word
_signs = re.compile(r"[0134578@$!]")
_word = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    """Folded text with single blanks."""
    if not text:
        return ""
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).translate(LOOK_ALIKES)
    if _signs.search(text):
        stand_in = lambda m: m[0].translate(STAND_INS)
        text = _end.sub(stand_in, _run.sub(stand_in, text))
    return " ".join(text.split())


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    cut: float = 1.0

    def automaton(self):
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        return found

    def load(self, text: str | None, automaton) -> float:
        """Summed weights of matched words outside exception phrases, per word of the text."""
        text = fold(text)
        if not text or not self.weights:
            return 0.0
        hits, excused, last = [], [], len(text) - 1
        for end, (size, weight) in automaton.iter(text):
            start = end - size + 1
            if (start and text[start - 1].isalpha()) or (end < last and text[end + 1].isalpha()):
                continue
            if weight is None:
                excused.append((start, end))
            else:
                hits.append((start, end, weight))
        if excused:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in excused)]
        return sum(h[2] for h in hits) / (text.count(" ") + 1)


def _words(batches):
    for batch in batches:
        out = []
        for text, toxic in zip(batch["text"], batch["toxic"]):
            out.extend((w, toxic) for w in set(_word.findall(fold(text))) if len(w) <= 40)
        yield pd.DataFrame(out, columns=["term", "toxic"])


def _phrases(weights):
    def run(batches):
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = _word.findall(fold(text))
                seen = set()
                for i, w in enumerate(words):
                    if w in weights:
                        seen.update(" ".join(words[a:b]) for a, b in ((max(i - 1, 0), i + 1), (i, i + 2)) if b - a == 2)
                out.extend((p, toxic) for p in seen)
            yield pd.DataFrame(out, columns=["term", "toxic"])
    return run


def _tally(rows: DataFrame, run) -> DataFrame:
    return rows.mapInPandas(run, "term string, toxic int").groupBy("term").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))


def best_cut(loads: np.ndarray, toxic: np.ndarray) -> float:
    """The load between two rows that has the best mean of both classes' rates; the middle of the first such gap."""
    order = np.argsort(loads, kind="stable")
    x, y = loads[order], toxic[order].astype(float)
    if not len(x) or not 0 < y.sum() < len(y) or x[-1] <= x[0]:
        return 1.0
    edge = np.flatnonzero(np.diff(x) > 0)
    clean_below, toxic_below = np.cumsum(1 - y)[edge], np.cumsum(y)[edge]
    rate = clean_below / (1 - y).sum() + 1 - toxic_below / y.sum()
    k = edge[int(np.argmax(np.round(rate, 12)))]
    return float((x[k] + x[k + 1]) / 2)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          rows_per_class: int = ROWS_PER_CLASS, chance: float = 0.01) -> Lexicon:
    """Words, weights, exceptions and cut from labelled rows; about ``rows_per_class`` rows of each class are read.

    A word stays if its share of toxic documents could come about by chance with a probability below ``chance`` over the
    whole vocabulary, and at least half of its documents are toxic.
    """
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(
        F.max(F.col(label)).cast("int").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [thin(marked.where(F.col("toxic") == k), F.col("key"), n, rows_per_class) for k, n in size.items()]
    if len(parts) < 2:
        return Lexicon()
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # ids of the bounded sample
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()) \
        .join(chosen, "key").select("text", "toxic")
    classes = rows.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    toxic, clean = classes["t"] or 0, classes["c"] or 0
    if not toxic or not clean:
        return Lexicon()
    tally = write_through(_tally(rows, _words))  # vocabulary of the bounded sample
    n, share = F.col("t") + F.col("c"), toxic / (toxic + clean)
    p = F.col("t") / n
    rare = n * (p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0))
    candidates = tally.where((F.col("t") >= 3) & (p >= 0.5) & (p > share)).withColumn("rare", rare)
    least = np.log(max(tally.count(), 1) / chance)
    odds = lambda t, c: float(np.clip(np.log((t + 0.5) / (toxic - t + 0.5)) - np.log((c + 0.5) / (clean - c + 0.5)), 0.5, 8))
    kept = candidates.where(F.col("rare") > float(least)).collect()  # words that stand out
    lexicon = Lexicon({r["term"]: odds(r["t"], r["c"]) for r in kept})
    if not kept:
        return lexicon
    if any(r["c"] for r in kept):
        harmless = _tally(rows, _phrases(set(lexicon.weights))).where((F.col("c") >= 3) & (F.col("t") <= 0.2 * F.col("c")))
        lexicon.exceptions = [r["term"] for r in harmless.select("term").collect()]
    loaded = rows.select("toxic", _load(docs, lexicon)(F.col("text")).alias("load")).toPandas()  # the bounded sample
    lexicon.cut = best_cut(loaded["load"].to_numpy(), loaded["toxic"].to_numpy())
    return lexicon


def _load(docs: DataFrame, lexicon: Lexicon):
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # words that stand out in a bounded sample

    @F.pandas_udf(T.DoubleType())
    def load(texts: pd.Series) -> pd.Series:
        words = shared.value
        automaton = words.automaton()
        return pd.Series([words.load(t, automaton) for t in texts], dtype=float)

    return load


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", into: str | None = None) -> DataFrame:
    """Add the score (0 to 1) to every row, under ``into`` or a free name."""
    name = free_name(docs, "load")
    loaded = docs.withColumn(name, _load(docs, lexicon)(F.col(text)))
    return loaded.withColumn(into or free_name(loaded, "toxicity"), F.col(name) / (F.col(name) + F.lit(lexicon.cut))).drop(name)


def keep_clean(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Rows that score below 0.5; columns as they were."""
    name = free_name(docs, "toxicity")
    return score(docs, lexicon, text, name).where(F.col(name) < 0.5).drop(name)
