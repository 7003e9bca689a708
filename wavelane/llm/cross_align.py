"""Alignment of the tokens of two tokenizers over the bytes that both cut.

A is a byte-level BPE (a tokenizers definition), B a sentencepiece model with byte fallback that puts a space before the text.
Per text there are two incidence matrices, tokens of A x bytes and tokens of B x bytes, kept as compressed sparse rows built by
hand. Row products after Gustavson give A·Bᵀ, whose entries are the overlap links with the number of shared bytes. Offsets where
tokens of both end cut the text into groups; the products of the two group-incidence matrices are the shared-group links. Links
are counted per pair of ids over the whole corpus, and every text is told how its links stand in these counts.

Texts are tokenised once and written with a block number (256 texts a block). Counts are summed in each task before the
shuffle. The table of counts has a row per pair of ids seen together; up to ``held`` pairs it is sent to the tasks, beyond that
the pairs of each block meet the counts by a shuffle and go back to their block, one row per block and pair, so that neither a
common pair nor a long table lands in one task. Products are formed some rows at a time, so memory stays bounded for long texts;
shared-group links can be many in a text without common ends and are made only where asked for.

Cases: texts that are null or empty, or whose joined token bytes differ from a space and the text, have no tokens, no groups,
an empty listing and zeros. Repeated rows count as often as they stand. Other columns pass through; those named like a result
are replaced. Strings of special tokens are plain text. An empty table gives empty tables.
"""

from __future__ import annotations

import json
from array import array
from functools import cached_property
from typing import Iterator, NamedTuple

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from wavelane.llm.common import byte_alphabet, write_packed
from wavelane.runtime import write_through

BLOCK_ROWS = 256
SLICE = 1 << 18            # products formed at once
CHARS = 1 << 17            # of the texts that are tokenised together
TOKENS = 1 << 16           # of A, of the texts that are aligned together
HELD_PAIRS = 4_000_000     # pairs of ids sent to the tasks, 17 bytes each
PENDING = 1 << 19          # links a task gathers before it counts them

_pairs: dict = {}


# ---- sparse rows -----------------------------------------------------------------------------------------------------------

class Rows(NamedTuple):
    """A 0/1 matrix: row r has its ones in the columns ``at[begin[r]:begin[r + 1]]``, ascending."""
    begin: np.ndarray
    at: np.ndarray
    columns: int


def rows_of_sizes(sizes: np.ndarray) -> Rows:
    """Row r takes the next ``sizes[r]`` columns: tokens over bytes."""
    begin = np.concatenate([[0], np.cumsum(sizes)])
    return Rows(begin, np.arange(begin[-1]), int(begin[-1]))


def rows_of_owners(owner: np.ndarray, columns: int) -> Rows:
    """Row r has a single one, in column ``owner[r]``: tokens over groups."""
    return Rows(np.arange(len(owner) + 1), owner, columns)


def transpose(matrix: Rows) -> Rows:
    order = np.argsort(matrix.at, kind="stable")
    owner = np.repeat(np.arange(len(matrix.begin) - 1), np.diff(matrix.begin))
    begin = np.concatenate([[0], np.cumsum(np.bincount(matrix.at, minlength=matrix.columns))])
    return Rows(begin, owner[order], len(matrix.begin) - 1)


def row_products(left: Rows, right: Rows, room: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries (row, column, value) of left x right, in order, some rows at a time: each row of the product gathers the rows of
    ``right`` that the row of ``left`` names."""
    width = np.diff(right.begin)
    work = np.concatenate([[0], np.cumsum(width[left.at])])[left.begin]
    row, rows = 0, len(left.begin) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(work, work[row] + room, "right")) - 1)
        named = left.at[left.begin[row]:left.begin[stop]]
        wide = width[named]
        owner = np.repeat(np.repeat(np.arange(row, stop), np.diff(left.begin[row:stop + 1])), wide)
        column = right.at[np.repeat(right.begin[named] - np.cumsum(wide) + wide, wide) + np.arange(len(owner))]
        row = stop
        if not len(owner):
            continue
        cell = owner * right.columns + column
        if (cell[1:] < cell[:-1]).any():
            order = np.argsort(cell, kind="stable")
            cell, owner, column = cell[order], owner[order], column[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        yield owner[first], column[first], np.diff(np.append(first, len(cell)))


# ---- tokens ----------------------------------------------------------------------------------------------------------------

class TokenPair:
    """Both tokenizers, and the bytes of each token."""

    def __init__(self, definition: str, model: bytes, pattern: str | None):
        self.definition = definition
        alphabet = byte_alphabet()
        described = json.loads(definition)
        special = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
        vocabulary = described["model"]["vocab"] | special
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, number in vocabulary.items():
            self.bytes_a[number] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        self.ranks = None
        if pattern is not None and self._ranked(described):
            ranks = {self.bytes_a[n]: n for t, n in vocabulary.items() if t not in special}
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.total_a = self.ranks is not None and len({t for t in self.bytes_a if len(t) == 1}) == 256  # so any bytes come back
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size()))]

    @cached_property
    def library(self) -> Tokenizer:
        """The definition as its own library reads it; large, so only made where ranks do not say all."""
        made = Tokenizer.from_str(self.definition)
        made.encode_special_tokens = True
        made.no_truncation()
        return made

    @staticmethod
    def _ranked(described: dict) -> bool:
        """True where ids ascend as merges are listed and the pre-tokenizer is the plain byte-level one: then ranks say all."""
        model, before = described["model"], described.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or described.get("normalizer"):
            return False
        if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return False
        made = [model["vocab"].get("".join(m) if not isinstance(m, str) else m.replace(" ", "")) for m in model["merges"]]
        return None not in made and all(a < b for a, b in zip([255, *made], made))

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        if self.ranks is not None:
            return [np.asarray(self.ranks.encode_to_numpy(t, disallowed_special=()), np.int32) for t in texts]
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and B of each text; none where a text is null or empty, or its bytes do not come back."""
        none = np.zeros(0, np.int32)
        out = [(none, none)] * len(texts)
        at = [i for i, t in enumerate(texts) if t]
        begin = 0
        while begin < len(at):  # lists of ids take far more room than texts, so some texts at a time
            end, held = begin, 0
            while end < len(at) and (end == begin or held + len(texts[at[end]]) <= CHARS):
                held += len(texts[at[end]])
                end += 1
            kept = [texts[i] for i in at[begin:end]]
            spaced = [" " + t for t in kept]
            for i, text, x, y in zip(at[begin:end], spaced, self.encode_a(spaced), self.pieces.encode(kept, num_threads=1)):
                want = text.encode()
                if b"".join(map(self.bytes_b.__getitem__, y)) == want and (
                        self.total_a or b"".join(map(self.bytes_a.__getitem__, x.tolist())) == want):
                    out[i] = x, np.frombuffer(array("i", y), np.int32)
            begin = end
        return out


class Tables(NamedTuple):
    """What alignment needs of the vocabularies: bytes of each token, and ids written with the mark behind them."""
    bytes_a: np.ndarray
    bytes_b: np.ndarray
    written: np.ndarray   # rows of 8 characters: for each id of A, then of B, one with ',' and one with '|' or ';'
    width: np.ndarray


def tables(pair: TokenPair) -> Tables:
    words = [f"{i}{mark}".encode() for side, last in ((pair.bytes_a, "|"), (pair.bytes_b, ";")) for i in range(len(side)) for mark in (",", last)]
    width = np.array([len(w) for w in words], np.int64)
    written = np.frombuffer(b"".join(w.ljust(width.max()) for w in words), np.uint8).reshape(len(words), width.max())
    return Tables(*(np.array([len(x) for x in side], np.int64) for side in (pair.bytes_a, pair.bytes_b)), written, width)


class Tokenizers:
    """What the tasks need: a definition, a model, and the pattern of the pre-tokens if ranks may be used."""

    def __init__(self, spark, definition: str, model: bytes, pattern: str | None = None):
        self.key = hash((definition, model, pattern))
        self.shared = spark.sparkContext.broadcast((definition, model, pattern))  # two files of a few megabytes
        made = tables(TokenPair(definition, model, pattern))
        self.of_b = len(made.bytes_b)
        self.tables = spark.sparkContext.broadcast(made)  # 8 numbers a token

    def __call__(self) -> TokenPair:
        if self.key not in _pairs:
            _pairs.clear()
            _pairs[self.key] = TokenPair(*self.shared.value)
        return _pairs[self.key]


def tokenize(docs: DataFrame, pair: Tokenizers, text: str = "text") -> DataFrame:
    """Replace the text by a_ids, b_ids and block; written once, as blocks are numbered by place."""
    @F.pandas_udf("a_ids array<int>, b_ids array<int>")
    def encode(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(pair().encode([t if t else None for t in texts]), columns=["a_ids", "b_ids"], dtype=object)

    rest = [c for c in docs.columns if c.lower() not in (text.lower(), "a_ids", "b_ids", "block")]
    coded = docs.select(*[F.col(f"`{c}`") for c in rest], encode(F.col(text)).alias("ids"))
    return write_packed(coded.select(*[F.col(f"`{c}`") for c in rest], "ids.*",
                                     F.expr(f"monotonically_increasing_id() div {BLOCK_ROWS}").alias("block")))


# ---- alignment of some texts -----------------------------------------------------------------------------------------------

class Aligned:
    """The matrices of some texts laid end to end; every text ends where tokens of both end, so no group crosses texts."""

    def __init__(self, own: Tables, a_ids, b_ids):
        a_ids, b_ids = ([np.asarray(x if x is not None else [], np.int64) for x in ids] for ids in (a_ids, b_ids))
        self.own, self.texts = own, len(a_ids)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
        self.a, self.b = (np.concatenate([*ids, np.zeros(0, np.int64)]) for ids in (a_ids, b_ids))
        self.text_of_a = np.repeat(np.arange(self.texts), self.n_a)
        self.a_bytes, self.b_bytes = rows_of_sizes(own.bytes_a[self.a]), rows_of_sizes(own.bytes_b[self.b])
        ends = np.zeros(self.a_bytes.columns + 1, np.uint8)
        for side, bit in ((self.a_bytes, 1), (self.b_bytes, 2)):
            ends[side.begin[1:]] += bit
        common = ends == 3
        before = np.cumsum(common) - common  # groups that end before an offset
        self.groups = int(before[-1] + common[-1])
        self.group_of_a, self.group_of_b = before[self.a_bytes.begin[1:]], before[self.b_bytes.begin[1:]]

    def links(self):
        """(token of A, token of B, shared bytes)"""
        return row_products(self.a_bytes, transpose(self.b_bytes))

    def shared_groups(self):
        """(token of A, token of B, 1) of the same group"""
        return row_products(rows_of_owners(self.group_of_a, self.groups), transpose(rows_of_owners(self.group_of_b, self.groups)))

    def pairs(self, of_b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, pair of ids) of every overlap link"""
        for x, y, _ in self.links():
            yield self.text_of_a[x], self.a[x] * of_b + self.b[y]

    def listings(self) -> list[str]:
        """Per text its groups, as a1,a2|b1;a3|b2,b3: read off the transposed group-incidence matrices."""
        by_a = transpose(rows_of_owners(self.group_of_a, self.groups)).begin
        by_b = transpose(rows_of_owners(self.group_of_b, self.groups)).begin
        word_a, word_b = 2 * self.a, 2 * (len(self.own.bytes_a) + self.b)
        word_a[by_a[1:] - 1] += 1  # the last of its side in a group
        word_b[by_b[1:] - 1] += 1
        # A token stands behind the tokens of its own side before it, and those of the other side in earlier groups (for B: and in its own).
        words = np.empty(len(word_a) + len(word_b), np.int64)
        words[np.arange(len(word_a)) + by_b[self.group_of_a]] = word_a
        words[np.arange(len(word_b)) + by_a[self.group_of_b + 1]] = word_b
        width = self.own.width[words]
        signs = self.own.written[words][np.arange(self.own.written.shape[1]) < width[:, None]].tobytes().decode("ascii")
        ends = np.concatenate([[0], np.cumsum(width)])[np.cumsum(self.n_a + self.n_b)].tolist()
        return [signs[begin:max(end - 1, begin)] for begin, end in zip([0, *ends], ends)]


def _parts(batch: pd.DataFrame, own: Tables) -> Iterator[tuple[int, int, Aligned]]:
    """Some rows of a batch at a time: (first row, row behind the last, their alignment)."""
    n = [max(len(x) if x is not None else 0, 1) for x in batch["a_ids"]]
    begin = held = 0
    for k, size in enumerate(n):
        if held and held + size > TOKENS:
            yield begin, k, Aligned(own, batch["a_ids"].iloc[begin:k], batch["b_ids"].iloc[begin:k])
            begin, held = k, 0
        held += size
    if len(n) > begin:
        yield begin, len(n), Aligned(own, batch["a_ids"].iloc[begin:], batch["b_ids"].iloc[begin:])


# ---- jobs ------------------------------------------------------------------------------------------------------------------

def links(coded: DataFrame, pair: Tokenizers, key: str = "doc_id", shared: bool = False) -> DataFrame:
    """A row per link: key, a_pos, b_pos (token numbers in the text), a_id, b_id, n_bytes; shared-group links have null n_bytes."""
    def find(batches):
        own = pair.tables.value
        for batch in batches:
            for begin, end, aligned in _parts(batch, own):
                keys = batch["key"].iloc[begin:end].to_numpy()
                before_a, before_b = np.cumsum(aligned.n_a) - aligned.n_a, np.cumsum(aligned.n_b) - aligned.n_b
                for x, y, n in aligned.shared_groups() if shared else aligned.links():
                    text = aligned.text_of_a[x]
                    yield pd.DataFrame({"key": keys[text], "a_pos": x - before_a[text], "b_pos": y - before_b[text], "a_id": aligned.a[x],
                                        "b_id": aligned.b[y], "n_bytes": None if shared else n})

    kind = coded.schema[key].dataType.simpleString()
    rows = coded.select(F.col(key).alias("key"), "a_ids", "b_ids").mapInPandas(
        find, f"key {kind}, a_pos long, b_pos long, a_id long, b_id long, n_bytes long")
    return rows.withColumnRenamed("key", key)


def pair_counts(coded: DataFrame, pair: Tokenizers) -> DataFrame:
    """pair (a_id * ids of B + b_id), n (links that hold it), best (no pair with its b_id has more); a row per pair of ids."""
    of_b = pair.of_b

    def count(batches):
        own = pair.tables.value
        kept, waiting, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def merged():
            names = np.concatenate([kept[0], *waiting])
            weights = np.concatenate([kept[1], np.ones(len(names) - len(kept[0]), np.int64)])
            found, at = np.unique(names, return_inverse=True)
            return found, np.bincount(at, weights, len(found)).astype(np.int64)

        for batch in batches:
            for _, _, aligned in _parts(batch, own):
                for _, pairs in aligned.pairs(of_b):
                    waiting.append(pairs)
                    size += len(pairs)
                    if size > PENDING:
                        kept, waiting, size = merged(), [], 0
                        if len(kept[0]) > PENDING:
                            yield pd.DataFrame({"pair": kept[0], "n": kept[1]})
                            kept = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        kept = merged()
        yield pd.DataFrame({"pair": kept[0], "n": kept[1]})

    partial = coded.select("a_ids", "b_ids").mapInPandas(count, "pair long, n long")
    counts = write_through(partial.groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair") % of_b
    most = counts.groupBy(b.alias("b_id")).agg(F.max("n").alias("most"))
    joined = counts.join(F.broadcast(most), b == F.col("b_id"))  # a row per id of B's vocabulary at most
    return joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
SUMMARY = ", ".join(f"{c} long" for c in NUMBERS) + ", listing string"


def _summary(aligned: Aligned, names, counts, best) -> pd.DataFrame:
    """Numbers of each text; ``names`` (sorted pairs) hold every pair of the texts."""
    sums = {c: np.zeros(aligned.texts, np.int64) for c in ("n_links", "n_best", "count_sum")}
    for text, pairs in aligned.pairs(len(aligned.own.bytes_b)):
        at = np.searchsorted(names, pairs)
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        for name, values in (("n_links", np.ones(len(at), np.int64)), ("n_best", best[at].astype(np.int64)), ("count_sum", counts[at])):
            sums[name][text[first]] += np.add.reduceat(values, first)
    groups = np.bincount(aligned.text_of_a[np.append(np.flatnonzero(np.diff(aligned.group_of_a)), len(aligned.a) - 1)],
                         minlength=aligned.texts) if len(aligned.a) else np.zeros(aligned.texts, np.int64)
    return pd.DataFrame({"n_a": aligned.n_a, "n_b": aligned.n_b, "n_groups": groups, **sums, "listing": aligned.listings()})


def summaries(coded: DataFrame, pair: Tokenizers, held: int = HELD_PAIRS) -> DataFrame:
    """Replace the ids by n_a, n_b, n_groups, n_links, n_best, count_sum and the listing of the groups."""
    spark = coded.sparkSession
    counts = write_through(pair_counts(coded, pair))
    rest = [F.col(f"`{c}`") for c in coded.columns if c.lower() not in {"a_ids", "b_ids", "block", "listing", *NUMBERS}]
    if counts.count() > held:
        return _summaries_by_block(coded, counts, pair, rest)
    table = counts.orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))

    @F.pandas_udf(SUMMARY)
    def tell(a_ids: pd.Series, b_ids: pd.Series) -> pd.DataFrame:
        batch = pd.DataFrame({"a_ids": a_ids, "b_ids": b_ids})
        parts = [_summary(aligned, *shared.value) for _, _, aligned in _parts(batch, pair.tables.value)]
        return pd.concat(parts, ignore_index=True)

    return coded.select(*rest, tell("a_ids", "b_ids").alias("told")).select(*rest, "told.*")


def _summaries_by_block(coded: DataFrame, counts: DataFrame, pair: Tokenizers, rest) -> DataFrame:
    """The same where the counts are too many to send: each block's pairs fetch their counts and meet the texts of the block."""
    def name(rows: pd.DataFrame) -> pd.DataFrame:
        found = [np.unique(p) for _, _, aligned in _parts(rows, pair.tables.value) for _, p in aligned.pairs(pair.of_b)]
        found = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
        return pd.DataFrame({"block": np.full(len(found), rows["block"].iloc[0]), "pair": found})

    def tell(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("pair")
        table = tuple(known[c].to_numpy() for c in ("pair", "n", "best"))
        parts = [_summary(aligned, *table) for _, _, aligned in _parts(rows, pair.tables.value)]
        return pd.concat([pd.DataFrame({"row": rows["row"].to_numpy()}), pd.concat(parts, ignore_index=True)], axis=1)

    numbered = write_packed(coded.withColumn("row", F.monotonically_increasing_id()))
    blocks = numbered.select("block", "row", "a_ids", "b_ids")
    named = blocks.groupBy("block").applyInPandas(name, "block long, pair long").join(counts, "pair")
    told = blocks.groupBy("block").cogroup(named.groupBy("block")).applyInPandas(tell, f"row long, {SUMMARY}")
    return numbered.select("row", *rest).join(told, "row").select(*rest, *NUMBERS, "listing")


def align(docs: DataFrame, definition: str, model: bytes, pattern: str | None = None, text: str = "text", held: int = HELD_PAIRS) -> DataFrame:
    """The whole job: replace the text by the numbers and the listing of its groups."""
    pair = Tokenizers(docs.sparkSession, definition, model, pattern)
    return summaries(tokenize(docs, pair, text), pair, held)
