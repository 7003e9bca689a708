"""Byte-level BPE encoding and decoding with a file of merge ranks.

Short texts are encoded where they are. Long ones are cut into overlapping chunks that are pre-tokenised in
parallel, each from its own first character. Where two neighbours have a common pre-token boundary inside the overlap, both
scans agree from there on, so the text is cut at that place and the pieces are encoded in parallel. Only boundaries after a
character that is no white space are used: there the pattern does not look ahead. A text with a seam that does not
resynchronise is encoded in one piece. Decoding joins raw bytes.

Ids travel as binary, little-endian unsigned 32-bit. Cases: null and empty texts have no ids; every input row gives one row,
repeated ones too; other columns pass through (one named like the result is replaced); an empty table stays empty.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from wavelane.llm.common import partitions
from wavelane.runtime import write_through

CHUNK = 1 << 16    # characters of a chunk; longer texts are cut
OVERLAP = 1 << 10  # characters that a chunk shares with the next one

_coders: dict = {}


def read_ranks(path: str) -> bytes:
    """The rank file (under 1 MB for 50,000 ranks), to be sent to the tasks."""
    with open(path, "rb") as file:
        return file.read()


class Coder:
    """Texts to packed ids, and ids to bytes."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.split = regex.compile(pattern)  # for seams only
        self.merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.token = np.full(max(table.values(), default=-1) + 1, b"", object)
        for piece, rank in table.items():
            self.token[rank] = piece

    def encode(self, text: str) -> bytes:
        """Packed ids of a text that begins and ends at pre-token boundaries."""
        return self.merges.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(self.token[np.frombuffer(packed, "<u4")].tolist())

    def bounds(self, text: str, begin: int, end: int) -> list[int]:
        """Starts of pre-tokens in [begin, end) that follow a character other than white space."""
        return [s for s in (m.start() for m in self.split.finditer(text)) if begin <= s < end and s and not text[s - 1].isspace()]


def coder(ranks: bytes, pattern: str) -> Coder:
    """One coder for each worker and vocabulary."""
    key = (hash(ranks), pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(ranks, pattern)
    return _coders[key]


def _in_place(shared, pattern):
    @F.pandas_udf(T.BinaryType())
    def encode(texts: pd.Series) -> pd.Series:
        own = coder(shared.value, pattern)
        return pd.Series([own.encode(t) if t else b"" for t in texts], dtype=object)
    return encode


def _seams(chunks: DataFrame, shared, pattern, chunk: int, overlap: int) -> DataFrame:
    """row, cuts (null where a seam does not resynchronise)."""
    def scan(batches):
        own = coder(shared.value, pattern)
        for batch in batches:
            out = []
            for row, k, text in zip(batch["row"], batch["k"], batch["text"]):
                head = own.bounds(text[:overlap * 2], 1, overlap) if k else []
                tail = own.bounds(text, chunk, chunk + overlap) if len(text) > chunk else []
                out.append((row, k, [k * chunk + s for s in head], [k * chunk + s for s in tail]))
            yield pd.DataFrame(out, columns=["row", "k", "head", "tail"])

    scans = chunks.mapInPandas(scan, "row long, k long, head array<long>, tail array<long>")
    ends = scans.where(F.col("k") > 0).select("row", "k", "head")
    starts = scans.select("row", (F.col("k") + 1).alias("k"), "tail")
    seams = ends.join(starts, ["row", "k"]).select("row", F.array_min(F.array_intersect("head", "tail")).alias("cut"))
    return seams.groupBy("row").agg(F.collect_list("cut").alias("found"), F.count(F.lit(1)).alias("n")).select(
        "row", F.when(F.size("found") == F.col("n"), F.sort_array("found")).alias("cuts"))


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", into: str = "ids", chunk: int = CHUNK,
           overlap: int = OVERLAP) -> DataFrame:
    """Replace the text column by packed ids, as the plain encoder gives for the whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    rest = [c for c in docs.columns if c not in (text, into)]
    packed = docs.select(F.struct(*rest).alias("rest") if rest else F.lit(0).alias("rest"), F.col(text).alias("text"))
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = packed.where(~is_long).select("rest", _in_place(shared, pattern)("text").alias(into))
    # Numbered once and written, so that all later passes agree on the row numbers.
    numbered = write_through(packed.where(is_long).withColumn("row", F.monotonically_increasing_id()))

    def cut_even(batches):
        for batch in batches:
            for row, value in zip(batch["row"], batch["text"]):
                for k in range(-(-len(value) // chunk)):
                    yield pd.DataFrame({"row": [row], "k": [k], "text": [value[k * chunk:(k + 1) * chunk + overlap]]})

    def cut_at(batches):
        for batch in batches:
            for row, value, cuts in zip(batch["row"], batch["text"], batch["cuts"]):
                at = [0, *(cuts if cuts is not None else []), len(value)]
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    yield pd.DataFrame({"row": [row], "k": [k], "text": [value[a:b]]})

    n, schema = partitions(spark), "row long, k long, text string"
    chunks = numbered.select("row", "text").mapInPandas(cut_even, schema).repartition(n, "row", "k")
    pieces = numbered.select("row", "text").join(_seams(chunks, shared, pattern, chunk, overlap), "row") \
        .mapInPandas(cut_at, schema).repartition(n, "row", "k")
    ids = pieces.select("row", "k", _in_place(shared, pattern)("text").alias("part")).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("k", "part"))).alias("parts"))
    joined = F.expr("unhex(array_join(transform(parts, x -> hex(x.part)), ''))")  # binary parts in one pass
    long = numbered.join(ids, "row").select("rest", joined.alias(into))
    return short.unionByName(long).select(*([f"rest.{c}" for c in rest]), into)


def decode(encoded: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the raw bytes that the packed ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf(T.BinaryType())
    def unpack(packed: pd.Series) -> pd.Series:
        own = coder(shared.value, pattern)
        return pd.Series([own.decode(p) if p is not None else None for p in packed], dtype=object)

    return encoded.withColumn(into, unpack(F.col(ids)))


def digests(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of tokens and hashes of the ids and of the bytes they decode to."""
    coded = decode(encode(docs.select(key, text), ranks, pattern, text), ranks, pattern)
    return coded.select(key, F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
