"""Join of documents whose word-shingle sets have a Jaccard similarity of at least a threshold, with Bayesian pruning.

1. One pass gives each document its shingle-set hash, MinHash values and band keys. Documents with one shingle set are one
   class from here on, with their number, so copies cost one row.
2. Classes that share a band key are candidates. Band buckets with equal members are visited once. A bucket is dealt to blocks
   of bounded size; a pair is looked at in its first common band only. In a block MinHash values are compared a few at a time,
   and a pair goes as soon as the posterior probability (uniform prior) that its similarity reaches the threshold is below the
   tolerance. A block returns a spanning forest of what is left, not the pairs.
3. The forest's components are small groups of likely copies. Their shingle sets are compared exactly, again block against
   block: each block returns the number of links of each class and a spanning forest of the exact links.

With 28 bands of 4 values a pair at 0.8 is missed with a probability of 4e-7. No bucket, group or list is capped.

Cases: null, empty and wordless texts link with nothing. A text under five words has one shingle, so it links with texts of the
same words. Repeated rows are copies of each other. Rows without an id come back with no links and no class. An id with several
texts has a row for each. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wavelane.llm.common import partitions, with_keys, without_keys
from wavelane.llm.components import components, local_roots
from wavelane.llm.shingles import WORDS, groups, shingle_set
from wavelane.runtime import write_through

BANDS, ROWS = 28, 4
STEP = 16
BLOCK = 512             # classes of a bucket block
EXACT_BLOCK = 128       # classes of a block that is compared exactly
EXACT_POINTS = 500_000  # shingles of such a block, in the mean

_rng = np.random.default_rng(20_011)
_FACTORS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    found = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2_048):
        part = _FACTORS[:, None] * shingles[None, at:at + 2_048] + _SHIFTS[:, None]
        np.minimum(found, part.min(axis=1), out=found)
    return (found >> np.uint64(32)).astype(np.uint32)


def band_keys(values: np.ndarray) -> np.ndarray:
    parts = values.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ parts[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def least_matches(threshold: float, tolerance: float, step: int = STEP, total: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """(values compared, matches needed): fewer matches leave the threshold a posterior probability below the tolerance."""
    found = []
    for n in range(step, total + 1, step):
        # With a uniform prior, P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m).
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        found.append((n, m))
    return found


def _sketch(words: int):
    def run(batches):
        for batch in batches:
            out = []
            for key, text in zip(batch["key"], batch["text"]):
                s = shingle_set(text, words)
                if not len(s):
                    out.append((key, 0, 0, 0, None, None))
                    continue
                hi, lo = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()
                values = minhash(s)
                out.append((key, hi, lo, len(s), band_keys(values), values.astype(np.uint16).tobytes()))
            yield pd.DataFrame(out, columns=["key", "hi", "lo", "size", "bands", "values"])
    return run


def survivors(values: np.ndarray, left: np.ndarray, right: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Positions of pairs that no step of the comparison drops."""
    alive, matches, begin = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for n, least in needed:
        for at in range(0, len(alive), 1 << 17):
            part = alive[at:at + (1 << 17)]
            matches[part] += (values[left[part], begin:n] == values[right[part], begin:n]).sum(axis=1)
        alive = alive[matches[alive] >= least]
        begin = n
        if not len(alive):
            break
    return alive


def block_pairs(g: dict):
    """Positions of a dealt group's pairs: all of a block with itself, or each of block i with each of block j."""
    if g["i"][0] == g["j"][0]:
        return np.triu_indices(len(g["side"]), 1)
    ones, twos = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
    return np.repeat(ones, len(twos)), np.tile(twos, len(ones))


def _prune(threshold: float, tolerance: float):
    needed = least_matches(threshold, tolerance)

    def run(batches):
        out = []
        for g in groups(batches, ["band", "band_key", "i", "j"]):
            left, right = block_pairs(g)
            if not len(left):
                continue
            low = np.minimum(g["size"][left], g["size"][right])
            fit = low >= threshold * np.maximum(g["size"][left], g["size"][right]) - 1e-9
            left, right = left[fit], right[fit]
            keys = np.stack(g["bands"])
            first = np.ones(len(left), bool)
            for k in range(int(g["band"][0])):
                first &= keys[left, k] != keys[right, k]
            left, right = left[first], right[first]
            values = np.frombuffer(b"".join(g["values"]), np.uint16).reshape(len(g["size"]), -1)
            alive = survivors(values, left, right, needed)
            root = local_roots(len(g["size"]), left[alive], right[alive])
            joined = np.flatnonzero(root != np.arange(len(root)))
            out.extend(zip(g["node"][root[joined]].tolist(), g["node"][joined].tolist()))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"])
    return run


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, by products of 0/1 blocks."""
    if len(left) <= 12:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    shared = n > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, width = np.zeros((len(sets), len(sets)), np.float32), 4_096
    for begin in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (begin, begin + width))
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], column[a:b] - begin] = 1
        total += block @ block.T
    return total[left, right].astype(np.int64)


def _verify(threshold: float):
    def run(batches):
        out = []
        for g in groups(batches, ["root", "i", "j"]):
            _, first = np.unique(g["node"], return_index=True)  # repeated rows from other batches or partitions
            g = {c: v[first] for c, v in g.items()}
            left, right = block_pairs(g)
            if not len(left):
                continue
            sets = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
            size = np.array([len(s) for s in sets])
            low = np.minimum(size[left], size[right])
            fit = low >= threshold * np.maximum(size[left], size[right]) - 1e-9
            left, right = left[fit], right[fit]
            common = common_counts(sets, left, right) if len(left) else np.zeros(0, np.int64)
            linked = common >= threshold * (size[left] + size[right] - common) - 1e-9
            left, right = left[linked], right[linked]
            links = np.zeros(len(sets), np.int64)
            np.add.at(links, left, g["copies"][right])
            np.add.at(links, right, g["copies"][left])
            root = local_roots(len(sets), left, right)
            for at in np.flatnonzero(links):
                out.append((g["node"][at], links[at], g["node"][root[at]]))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["node", "links", "peer"])
                out = []
        yield pd.DataFrame(out, columns=["node", "links", "peer"])
    return run


def _deal(rows: DataFrame, blocks, keys: list[str]) -> DataFrame:
    """Deal the rows of each key to pairs of blocks (i <= j); side 1 marks the rows of block j where i < j."""
    dealt = rows.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")) \
        .withColumn("side", (F.col("mine") > F.col("other")).cast("int")).drop("blocks", "mine", "other")
    by = [*keys, "i", "j"]
    return dealt.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)


def classes_and_links(docs: DataFrame, threshold: float = 0.8, words: int = WORDS, tolerance: float = 1e-7,
                      key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id (smallest key reachable by links, itself included), n_links (documents linked directly), one row per row."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    sketches = write_through(rows.where(F.col("key").isNotNull()).mapInPandas(
        _sketch(words), "key long, hi long, lo long, size long, bands array<long>, values binary"))
    filled = sketches.where("size > 0")
    reps = write_through(filled.groupBy("hi", "lo").agg(
        F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"),
        F.first("bands").alias("bands"), F.first("values").alias("values")).withColumn("node", F.monotonically_increasing_id()))

    # Candidates: buckets of a band key, one for each set of members.
    banded = reps.select("node", F.posexplode("bands").alias("band", "band_key"))
    buckets = banded.groupBy("band", "band_key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")) \
        .where("n > 1").groupBy("n", "members").agg(F.min(F.struct("band", "band_key")).alias("bucket")) \
        .select("n", "bucket.band", "bucket.band_key")
    members = banded.join(buckets, ["band", "band_key"]).join(reps.select("node", "size", "bands", "values"), "node")
    dealt = _deal(members, F.ceil(F.col("n") / BLOCK), ["band", "band_key"])
    likely = dealt.select("band", "band_key", "i", "j", "side", "node", "size", "bands", "values") \
        .mapInPandas(_prune(threshold, tolerance), "a long, b long")
    candidates = components(likely)

    # Exact comparison inside the groups of likely copies.
    sizes = candidates.join(reps.select("node", "size"), "node").groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("points"))
    grouped = write_through(candidates.join(sizes, "root").join(reps.select("node", "key", "hi", "lo", "copies"), "node"))

    def load(batches):
        for batch in batches:
            out, seen = [], set()
            for r in batch.itertuples(index=False):
                s = shingle_set(r.text, words)
                hi, lo = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()
                if (hi, lo) == (r.hi, r.lo) and r.node not in seen:  # another text under the same id, or a repeated row
                    seen.add(r.node)
                    out.append((r.root, r.n, r.points, r.node, r.copies, s.tobytes()))
            yield pd.DataFrame(out, columns=["root", "n", "points", "node", "copies", "shingles"])

    # Texts of the grouped keys only are shuffled.
    wanted = with_keys(rows.where(F.col("key").isNotNull()), grouped.select("key").distinct(), "key")
    texts = wanted.join(grouped, "key").select("root", "n", "points", "node", "copies", "hi", "lo", "text")
    loaded = texts.mapInPandas(load, "root long, n long, points long, node long, copies long, shingles binary")
    blocks = F.greatest(F.ceil(F.col("n") / EXACT_BLOCK), F.ceil(F.col("points") / EXACT_POINTS))
    found = write_through(_deal(loaded, blocks, ["root"]).select("root", "i", "j", "side", "node", "copies", "shingles")
                          .mapInPandas(_verify(threshold), "node long, links long, peer long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    named = linked.join(reps.select("node", "key"), "node")
    least = named.groupBy("root").agg(F.min("key").alias("class_id"))
    told = reps.select("hi", "lo", "node", "key", "copies").join(links, "node", "left") \
        .join(linked.join(least, "root").select("node", "class_id"), "node", "left") \
        .select("hi", "lo", F.lit(1).alias("size"), F.coalesce("class_id", "key").alias("class_id"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    matched = sketches.select("key", "hi", "lo", F.least("size", F.lit(1)).alias("size")).join(told, ["hi", "lo", "size"], "left")
    result = matched.select("key", F.coalesce("class_id", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return result.unionByName(rows.where(F.col("key").isNull()).select("key", F.lit(None).cast("long").alias("class_id"),
                                                                       F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, threshold: float = 0.8, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, that of the smallest id; columns as they were. Rows without an id stay. An id is one document."""
    found = classes_and_links(docs, threshold, words, key=key, text=text)
    # A key with rows both of its own class and of another one is kept, so the keys that go have none of their own.
    keys = write_through(found.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.count(F.when(F.col("key") == F.col("class_id"), 1)).alias("own")))
    rows = without_keys(docs, keys.where("own = 0").select(F.col("key").alias(key)), key)
    if keys.where("own > 1").isEmpty():
        return rows
    repeated = keys.where("own > 1").select(F.col("key").alias(key))
    once = with_keys(rows, repeated, key).dropDuplicates([key, text])
    return without_keys(rows, repeated, key).unionByName(once)
