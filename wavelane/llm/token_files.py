"""Token-id files with a minimal perfect hash index.

A shard is a header and raw ids (little-endian, 16-bit where the vocabulary allows it, else 32-bit) of documents in ascending
key order. Shards are written by the tasks of one range-partitioned stage into a shared folder; the rows that the stage returns
name the files, so a repeated task leaves only files that nothing names. The index maps (key, occurrence) to its slot without
storing keys: keys are dealt to buckets of a few thousand, and in each bucket every level of a bit array takes the keys that
are alone at their position, the rest go to the next level. The rank of a key's bit is its slot, which holds a fingerprint,
the shard, the first id and the number of ids. A lookup reads one bucket, a few bits and one slot.

Cases: null and empty texts hold the end id only. A key that repeats is kept once per row, as occurrence 0, 1, ... (order: hash
of the text). A row without a key has no place in the index and is not written. Unknown keys give no row, unless their 32-bit
fingerprint happens to agree (1 in 4 billion). An empty table gives an empty index. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from array import array
from itertools import chain

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from wavelane.llm.common import byte_alphabet, partitions
from wavelane.runtime import scratch_folder, write_through

HEAD = b"WLTOKEN1"              # then the id width in bytes, as one little-endian 64-bit integer
SHARD_BYTES = 64 << 20          # a shard is closed once it is larger
BUCKET_KEYS = 4_096             # mean number of keys of an index bucket
HELD = 800_000                  # words a worker remembers, about 200 bytes each
NATIVE = sys.byteorder == "little"
MARK = "~"                      # stands between words that are encoded together
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("n", "<u4")])

_beyond = re.compile("[\u0130\u0250-\U0010ffff]")      # letters whose lower case or normal form depends on more than one character
_marks = re.compile(r"[^\w\s][.,] |_")
_control = re.compile("[\x1c-\x1f]")  # blanks for Python's split, not for the tokenizer
_alphabet = {byte: sign for sign, byte in byte_alphabet().items()}
_coders: dict = {}


# How the definition must cut texts for the word rules to hold (Latin letters in lower case, no token over a blank).
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_words(definition: str) -> bool:
    """True where the definition cuts texts at white space as the word rules take for granted."""
    described = json.loads(definition)
    normal, before = described.get("normalizer") or {}, described.get("pre_tokenizer") or {}
    first, *rest = before.get("pretokenizers") or [{}]
    return (normal.get("normalizers") == WORD_NORMALIZERS and first.get("pattern") == {"Regex": WORD_SPLIT}
            and first.get("behavior") == "Removed" and first.get("invert") is True
            and [(r.get("type"), r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
            and not described["model"].get("dropout") and not any(set(t["content"]) & set(" \t\n") or t["lstrip"] or t["rstrip"] or t["normalized"]
                                                                  for t in described.get("added_tokens", [])))


class WordCoder:
    """Ids of whole texts; where the tokenizer's pre-tokens never hold white space, each new word is encoded once and remembered."""

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.by_word = cuts_words(definition)
        # Young words, and those seen before them: when the young are many they become the old ones, so words in use stay.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes() if NATIVE else np.array(ids, self.type).tobytes()

    @staticmethod
    def words(text: str | None) -> list[str]:
        """The text cut at white space, with equal pre-tokens made equal words where that cannot change an id.

        Latin letters are lower-cased as the tokenizer would. A stop or comma after a letter or digit is a pre-token of its
        own, so it is cut off. Texts with other letters, or with marks in a row before a blank, are cut at white space only.
        """
        if not text:
            return []
        if _control.search(text):
            return [text]
        if not _beyond.search(text):
            text = text.lower()
            if not _marks.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ")
        return text.split()

    def encode_new(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words of Latin letters in lower case are one pre-token as they stand and go to the model itself."""
        out: list = [None] * len(words)
        others = []
        for at, word in enumerate(words):
            if self.by_word and word.isalpha() and max(word) < "\u0250" and word == word.lower():
                out[at] = self.pack([t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_alphabet))])
            else:
                others.append(at)
        for at, ids in zip(others, self._encode_marked([words[at] for at in others])):
            out[at] = ids
        return out

    def _encode_marked(self, words: list[str]) -> list[bytes]:
        """Ids of each word: many words in one text with a mark between them, one by one where a word holds the mark too."""
        out, width = [], self.type.itemsize
        parts = [words[at:at + 256] for at in range(0, len(words), 256)]
        joined = self.tokenizer.encode_batch_fast([f" {MARK} ".join(p) for p in parts], add_special_tokens=False) if self.mark is not None \
            else [None] * len(parts)
        for part, found in zip(parts, joined):
            ids = np.array(found.ids, self.type) if found is not None else None
            ends = np.flatnonzero(ids == self.mark).tolist() if ids is not None else []
            if len(ends) == len(part) - 1:
                packed = ids.tobytes()
                out += [packed[begin * width:end * width] for begin, end in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)])]
            else:
                out += [self.pack(f.ids) for f in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def encode(self, texts) -> list[bytes]:
        if not self.by_word:
            return [self.pack(f.ids) for f in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if len(self.young) > HELD // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        split = [self.words(t) for t in texts]
        flat = list(chain.from_iterable(split))
        packed = list(map(young.get, flat))
        new = {}
        for at in [at for at, found in enumerate(packed) if found is None]:
            word = flat[at]
            known = old.get(word)
            if known is None:
                new.setdefault(word, []).append(at)
            else:
                packed[at] = young[word] = known
        fresh = list(new)
        for word, ids in zip(fresh, self.encode_new(fresh)):
            for at in new[word]:
                packed[at] = ids
            if len(word) < 64:
                young[word] = ids
        ends = np.cumsum([len(words) for words in split]).tolist()
        return [b"".join(packed[end - len(words):end]) for words, end in zip(split, ends)]


def word_coder(definition: str) -> WordCoder:
    key = hash(definition)
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordCoder(definition)
    return _coders[key]


def _open(uri: str):
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


def write_shards(docs: DataFrame, definition: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write all rows with a key; returns one row per document: key, occurrence, shard file, first id, n ids."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # the tokenizer file
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull()) \
        .withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "key", "tie").sortWithinPartitions("key", "tie")

    def write(batches):
        coder = word_coder(shared.value)
        stop, width = coder.pack([end_id]), coder.type.itemsize
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            entries = []
            for begin in range(0, len(batch), 500):
                keys, texts = batch["key"].iloc[begin:begin + 500], batch["text"].iloc[begin:begin + 500]
                for one, packed in zip(keys, coder.encode(texts)):
                    if out is None:
                        name, at = f"shard-{uuid.uuid4().hex}.ids", 0
                        out = system.open_output_stream(f"{base}/{name}")
                        out.write(HEAD + np.array([width], "<u8").tobytes())
                    out.write(packed)
                    out.write(stop)
                    n = len(packed) // width + 1
                    entries.append((one, name, at, n))
                    at += n
                    if at * width > SHARD_BYTES:
                        out.close()
                        out = None
            yield pd.DataFrame(entries, columns=["key", "file", "first", "n"])
        if out is not None:
            out.close()

    return write_through(ordered.select("key", "text").mapInPandas(write, "key long, file string, first long, n long"))


def shard_table(entries: DataFrame) -> DataFrame:
    """file, shard (number in key order), base (ids before it); a row per shard, so small against the data."""
    shards = entries.groupBy("file").agg(F.min(F.struct("key", "first")).alias("order"), F.max(F.col("first") + F.col("n")).alias("ids"),
                                         F.max(F.struct("key", "first")).alias("last"))
    by = Window.orderBy("order", "last", "file")
    return shards.select("file", (F.row_number().over(by) - 1).alias("shard"),
                         F.coalesce(F.sum("ids").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def _mix(keys: np.ndarray, salt: int) -> np.ndarray:
    h = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _identity(keys: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return _mix(keys.astype(np.int64).view(np.uint64) ^ _mix(occurrence.astype(np.uint64), 77), 1)


def build_levels(ids: np.ndarray, gamma: float = 1.5) -> list[np.ndarray]:
    """Bit arrays (one byte per bit here) of a minimal perfect hash over distinct 64-bit ids."""
    levels, left = [], ids
    while len(left):
        size = max(int(gamma * len(left)), 2)
        at = (_mix(left, 100 + len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
        if len(levels) > 200:
            raise ValueError("two keys have one 64-bit identity")
    return levels


def slots_of(ids: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Slot of each id; -1 for ids that no level takes."""
    found, before = np.full(len(ids), -1, np.int64), 0
    for k, bits in enumerate(levels):
        open_ = np.flatnonzero(found < 0)
        if not len(open_):
            break
        at = (_mix(ids[open_], 100 + k) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        found[open_[hit]] = before + np.cumsum(bits)[at[hit]] - 1
        before += int(bits.sum())
    return found


def build_index(entries: DataFrame, shards: DataFrame, keys_per_bucket: int = BUCKET_KEYS) -> DataFrame:
    """bucket, keys, sizes and bits of the levels, slots; one row per bucket of a few thousand keys."""
    buckets = max(entries.count() // keys_per_bucket, 1)
    numbered = entries.join(F.broadcast(shards.select("file", "shard")), "file") if shards.count() <= 100_000 \
        else entries.join(shards.select("file", "shard"), "file")
    order = Window.partitionBy("key").orderBy("shard", "first")
    placed = numbered.withColumn("occurrence", F.row_number().over(order) - 1).withColumn("bucket", bucket_of("key", "occurrence", buckets))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        ids = _identity(rows["key"].to_numpy(), rows["occurrence"].to_numpy())
        levels = build_levels(ids)
        held = np.zeros(len(ids), SLOT)
        at = slots_of(ids, levels)
        held["print"][at] = (_mix(ids, 2) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for name, column in (("shard", "shard"), ("first", "first"), ("n", "n")):
            held[name][at] = rows[column].to_numpy()
        return pd.DataFrame({"bucket": [int(rows["bucket"].iloc[0])], "buckets": [buckets], "sizes": [[len(b) for b in levels]],
                             "bits": [np.packbits(np.concatenate(levels)).tobytes()], "slots": [held.tobytes()]})

    return placed.groupBy("bucket").applyInPandas(build, "bucket long, buckets long, sizes array<long>, bits binary, slots binary")


def bucket_of(key: str, occurrence: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("long"), F.col(occurrence).cast("int")), F.lit(buckets))


def lookup(index: DataFrame, keys: DataFrame, key: str = "key", occurrence: str = "occurrence") -> DataFrame:
    """key, occurrence, shard, first, n of the wanted keys (long key, int occurrence), by the index alone."""
    head = index.select("buckets").first()
    empty = "key long, occurrence int, shard long, first long, n long"
    if head is None:
        return index.sparkSession.createDataFrame([], empty)
    wanted = keys.select(F.col(key).cast("long").alias("key"), F.col(occurrence).cast("int").alias("occurrence")) \
        .where(F.col("key").isNotNull()).withColumn("bucket", bucket_of("key", "occurrence", head["buckets"]))

    def probe(keys_: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(keys_):
            return pd.DataFrame({c: [] for c in ("key", "occurrence", "shard", "first", "n")})
        row = held.iloc[0]
        sizes = np.array(row["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[:int(sizes.sum())].astype(bool)
        slots = np.frombuffer(row["slots"], SLOT)
        ids = _identity(keys_["key"].to_numpy(), keys_["occurrence"].to_numpy())
        at = slots_of(ids, np.split(bits, np.cumsum(sizes)[:-1]))
        found = slots[np.maximum(at, 0)]
        sure = (at >= 0) & (found["print"] == (_mix(ids, 2) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        return pd.DataFrame({"key": keys_["key"], "occurrence": keys_["occurrence"], "shard": found["shard"].astype(np.int64),
                             "first": found["first"].astype(np.int64), "n": found["n"].astype(np.int64)})[sure]

    return wanted.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(probe, empty)


def read_payload(places: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """places (shard, first, n, ...) with the packed 32-bit ids read from the shard files."""
    schema = "key long, occurrence int, start long, n long, ids binary"
    located = places.join(shards, "shard").select("key", "occurrence", "file", "base", "first", "n") \
        .repartition(partitions(places.sparkSession), "file").sortWithinPartitions("file", "first")

    def read(batches):
        system, base = _open(folder)
        name, source, type_ = None, None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.file != name:
                    if source is not None:
                        source.close()
                    name, source = row.file, system.open_input_file(f"{base}/{row.file}")
                    head = source.read_at(16, 0)
                    if head[:8] != HEAD:
                        raise ValueError(f"{name} is no shard")
                    type_ = np.dtype(f"<u{int(np.frombuffer(head[8:], '<u8')[0])}")
                raw = source.read_at(row.n * type_.itemsize, 16 + row.first * type_.itemsize)
                out.append((row.key, row.occurrence, row.base + row.first, row.n, np.frombuffer(raw, type_).astype("<u4").tobytes()))
                if len(out) == 500:
                    yield pd.DataFrame(out, columns=["key", "occurrence", "start", "n", "ids"])
                    out = []
            yield pd.DataFrame(out, columns=["key", "occurrence", "start", "n", "ids"])
        if source is not None:
            source.close()

    return located.mapInPandas(read, schema)


def write(docs: DataFrame, definition: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text"):
    """Write shards and index below a folder of the shared file system; returns (folder, index, shard table)."""
    folder = folder or f"{scratch_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    entries = write_shards(docs, definition, end_id, folder, key, text)
    shards = write_through(shard_table(entries))
    return folder, write_through(build_index(entries, shards)), shards


def round_trip(docs: DataFrame, definition: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents, look every key up through the index, and read its ids back from the files."""
    folder, index, shards = write(docs, definition, end_id, None, key, text)
    rows = docs.select(F.col(key).cast("long").alias("key")).where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    wanted = rows.select("key", F.explode(F.sequence(F.lit(0), (F.col("rows") - 1).cast("int"))).alias("occurrence"))
    return read_payload(lookup(index, wanted), shards, folder)
