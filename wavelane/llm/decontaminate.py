"""Benchmark decontamination: documents that hold most of a test item's word shingles. DataFrame operations only.

Items are partitioned by size: partition u holds those with 2^u to 2^(u + 1) - 1 shingles. An item's sketch is its smallest shingle
hashes (bottom-k MinHash); the partition sets how many, and the least number of hits. Up to ``sketch`` shingles all are taken
and as many hits are needed as the threshold says. In the partitions above the sketch grows by a quarter with every doubling, and
the least number of hits is the largest with which no size of the partition is missed, at the threshold, with a probability above
the tolerance: larger items need a smaller share of a larger sketch. The shingles of all documents are looked up
in the sketches, so a document's length does not thin out the search. Pairs with enough hits are verified by exact
containment, |item and document| / |item|, from the shingle sets.

Cases: texts are lower-cased and cut at everything but letters and digits. Null, empty and wordless texts and items match
nothing. An item of n words, fewer than five, is one shingle of n words, and is found wherever a document holds these words in a
row; documents are cut into runs of such lengths too where items have them. Rows without an id are no items, and as documents
are kept and never matched. An id with several rows is one document or item with all their shingles. Other columns are not
read. Empty tables give no matches.
"""

from __future__ import annotations

from math import ceil, comb

from pyspark.sql import Column, DataFrame, functions as F

from wavelane.runtime import write_through

WORDS = 5
SKETCH = 32
EXACT_SIZES = 512             # item sizes below which the hits are counted as draws without replacement
BROADCAST_HASHES = 2_000_000  # most sketch or item hashes that are sent to all tasks
BROADCAST_IDS = 1_000_000     # most document ids that are sent to all tasks


def least_hits(sketch: int, threshold: float, tolerance: float, size: int | None = None) -> int:
    """Largest c, at least 1, so that an item at the threshold has fewer than c of its sketch in the document with a probability of at
    most ``tolerance``. With its ``size`` the hits are hypergeometric, without it binomial, which bounds every size from below."""
    held = None if size is None else ceil(size * threshold - 1e-9)
    below, c = 0.0, 0
    while c < sketch:
        below += comb(sketch, c) * threshold ** c * (1 - threshold) ** (sketch - c) if held is None \
            else comb(held, c) * comb(size - held, sketch - c) / comb(size, sketch)
        if below > tolerance:
            break
        c += 1
    return max(c, 1)


def size_partitions(sketch: int, threshold: float, tolerance: float, most: int = 40) -> dict[int, tuple[int, int]]:
    """Partition: (hashes of a sketch, least hits), for partitions with items that are not sketched whole."""
    first = (sketch + 1).bit_length() - 1
    found = {}
    for u in range(first, most):
        low, high = max(1 << u, sketch + 1), (2 << u) - 1
        held = min(sketch + sketch * (u - first) // 4, low)
        exact = [least_hits(held, threshold, tolerance, size) for size in range(low, high + 1)] if high < EXACT_SIZES else []
        found[u] = (held, min(exact, default=least_hits(held, threshold, tolerance)))
    return found


def shingles(rows: DataFrame, key: str, text: str, words: int = WORDS, short: list[int] | None = None) -> DataFrame:
    """key, hash for all word shingles of all rows, repeats included. A text under ``words`` words is one shingle of all its words.

    With ``short``, lengths below ``words``, only runs of words are taken: of ``words`` words and of each of these lengths.
    """
    split = F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")
    # explode(array(x)) keeps Spark from computing x anew for each element of the next step.
    hashed = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.explode(F.array(F.transform(split, lambda w: F.xxhash64(w)))).alias("w")).where(F.size("w") > 0)
    n = F.size("w")

    def runs(length):
        return F.when(n >= length, F.transform(F.sequence(F.lit(0), F.greatest(n - length, F.lit(0))),
                                               lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(length)]))).otherwise(F.array().cast("array<bigint>"))

    if short is None:
        whole = F.lit(None).cast("bigint")
        for length in range(1, words):
            whole = F.when(n == length, F.xxhash64(*[F.get("w", F.lit(k)) for k in range(length)])).otherwise(whole)
        taken = F.when(n >= words, runs(words)).otherwise(F.array(whole))
    else:
        taken = F.concat(*[runs(length) for length in (words, *short)])
    return hashed.select("key", F.explode(taken).alias("hash"), *([F.least(n, F.lit(words)).alias("words")] if short is None else []))


def _sent(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, words: int = WORDS, sketch: int = SKETCH,
                 tolerance: float = 1e-9, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """key, item, shared, size, containment of all pairs whose containment reaches the threshold."""
    items = write_through(shingles(benchmark, item, text, words).distinct().withColumnRenamed("key", "item"))
    # Lengths of the items under ``words`` words: at most words - 1 numbers, and none for most benchmarks.
    short = sorted(r["words"] for r in items.where(F.col("words") < words).select("words").distinct().collect())
    sizes = items.groupBy("item").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("hash")).alias("hashes"))
    part = F.floor(F.log2("size") + 1e-12).cast("int")
    held, enough = F.col("size"), F.greatest(F.ceil(F.col("size") * threshold - 1e-9), F.lit(1))
    for u, (n_hashes, n_hits) in size_partitions(sketch, threshold, tolerance).items():
        drawn = (F.col("part") == u) & (F.col("size") > sketch)
        held, enough = F.when(drawn, n_hashes).otherwise(held), F.when(drawn, n_hits).otherwise(enough)
    sketches = write_through(sizes.withColumn("part", part).select(
        "item", "size", "part", enough.alias("enough"), F.explode(F.slice("hashes", F.lit(1), held.cast("int"))).alias("hash")))
    n_sketch, n_items = sketches.count(), items.count()
    probes = shingles(docs, key, text, words, short)
    hits = probes.join(_sent(sketches, n_sketch, BROADCAST_HASHES), "hash").groupBy("key", "item", "part", "enough") \
        .agg(F.count_distinct("hash").alias("hits")).where("hits >= enough")
    candidates = write_through(hits.select("key", "item"))

    ids = candidates.select("key").distinct()
    n_ids = ids.count()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(_sent(ids, n_ids, BROADCAST_IDS), "key", "left_semi")
    shared = shingles(found, "key", "text", words, short).join(_sent(items, n_items, BROADCAST_HASHES), "hash") \
        .groupBy("key", "item").agg(F.count_distinct("hash").alias("shared"))
    total = sizes.select("item", "size")
    exact = shared.join(candidates, ["key", "item"], "left_semi").join(total, "item")
    return exact.where(F.col("shared") >= F.col("size") * threshold - 1e-9).select(
        F.col("key").alias(key), F.col("item").alias(item), "shared", F.col("size").alias("n_shingles"),
        (F.col("shared") / F.col("size")).alias("containment"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, words: int = WORDS, key: str = "doc_id",
                        item: str = "item_id", text: str = "text") -> DataFrame:
    """Documents that hold no test item; columns as they were."""
    ids = write_through(contaminated(docs, benchmark, threshold, words, key=key, item=item, text=text).select(key).distinct())
    return docs.join(_sent(ids, ids.count(), BROADCAST_IDS), key, "left_anti").select(*docs.columns)


def twin(threshold: float = 0.8, words: int = WORDS) -> str:
    """The same matches in DuckDB SQL over documents and benchmark."""
    def cut(table: str, key: str) -> str:
        return f"""SELECT {key} AS key, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
            FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL"""

    def runs(length: str) -> str:
        return f"unnest(list_transform(range(0, len(w) - {length} + 1), lambda i: array_to_string(w[i + 1:i + {length}], ' ')))"
    return f"""WITH dw AS ({cut('documents', 'doc_id')}), bw AS ({cut('benchmark', 'item_id')}),
        b AS (SELECT DISTINCT key, least(len(w), {words}) AS n_words, {runs(f'least(len(w), {words})')} AS shingle FROM bw WHERE len(w) > 0),
        lengths AS (SELECT DISTINCT n_words FROM b UNION SELECT {words}),
        d AS (SELECT DISTINCT key, n_words, {runs('n_words')} AS shingle FROM dw, lengths WHERE len(w) >= n_words),
        size AS (SELECT key, count(*) AS n FROM b GROUP BY key)
        SELECT d.key AS doc_id, b.key AS item_id, count(*) AS shared, any_value(size.n) AS n_shingles,
               count(*) / any_value(size.n)::DOUBLE AS containment
        FROM d JOIN b USING (n_words, shingle) JOIN size ON size.key = b.key
        GROUP BY d.key, b.key HAVING count(*) >= any_value(size.n) * {threshold} - 1e-9"""
