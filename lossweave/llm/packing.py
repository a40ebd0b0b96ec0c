"""Bounded-space online best-fit packing of token pieces into sequences.

A fixed number of bins is open at a time. A bitset over free space says which free spaces are on hand,
so best fit is "lowest set bit at or above the length". When a piece fits nowhere and all bins are open,
the fullest is closed first. Pieces are dealt into hash groups of bounded token count; each group is one
stream, so packing needs one shuffle of short rows and no task sees more than its group.

Null texts are empty documents (one end token); repeated rows are packed one by one; an empty table
gives an empty result; ``pack`` keeps further columns and replaces its own three.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossweave.session import staged

from .common import arrow_pass

CAPACITY = 2048
OPEN_BINS = 512
GROUP_TOKENS = 16_000_000
END = 0
ADDED, ADDED_ID = "<|endoftext|>", 50256  # fixed values: the one added token of the vocabulary; its string in a text is that token
VOCABULARY = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json; a test holds the ids of both together
CACHE_WORDS, LONGEST_KEPT = 400_000, 64  # words remembered, and the longest of them: together they bound the memory


def load_encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class WordIds(dict):
    """Token ids, packed as little-endian 32-bit integers, of a word that follows one space.

    A space after a character that is no white space always starts a new pre-token, as does one between
    white space and a word. Only a space inside a run of white space may not; such words map to None and
    send the whole text to the plain encoder.
    """

    def __init__(self, encoding: tiktoken.Encoding, room: int = CACHE_WORDS):
        super().__init__()
        self.encoding, self.room = encoding, room

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= self.room:
            self.clear()
        ids = None if not word or word[0].isspace() else self.plain(" " + word)
        if len(word) <= LONGEST_KEPT:
            self[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if ADDED in text:
            return ADDED_ID.to_bytes(4, "little").join(self.encode(part) if part else b"" for part in text.split(ADDED))
        first, *rest = text.split(" ")
        found = [self[w] for w in rest]
        if not first or None in found:
            return self.plain(text)
        return self.plain(first) + b"".join(found)


def cuts(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces: all full but perhaps the first."""
    head = length % capacity or capacity
    yield 0, min(head, length)
    for start in range(head, length, capacity):
        yield start, capacity


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Token pieces of every whole text: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array of int)."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds(load_encoding(path)), END.to_bytes(4, "little")
        for batch in batches:
            at, rows, crcs, blobs = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = words.encode(text or "") + end
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    piece = ids[4 * start : 4 * (start + length)]
                    at.append(i)
                    rows.append((k, start, length))
                    crcs.append(zlib.crc32(piece))
                    if with_ids:
                        blobs.append(np.frombuffer(piece, "<i4"))
            k, start, length = zip(*rows) if rows else ((), (), ())
            columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(blobs, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return arrow_pass(docs.select("doc_id", "text"), encode, schema)


class BestFit:
    """The open bins of one stream."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free, self.bins, self.used, self.made = 0, defaultdict(list), {}, 0

    def _take(self, space: int) -> int:
        bin_id = self.bins[space].pop()
        if not self.bins[space]:
            self.free ^= 1 << space
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """Sequence number and offset of the next piece."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens does not fit a sequence of {self.capacity}")
        fitting = self.free >> length
        if fitting:
            bin_id = self._take(length + (fitting & -fitting).bit_length() - 1)
        else:
            if len(self.used) >= self.open_bins:
                del self.used[self._take((self.free & -self.free).bit_length() - 1)]
            bin_id, self.made = self.made, self.made + 1
            self.used[bin_id] = 0
        offset = self.used[bin_id]
        space = self.capacity - offset - length
        if space:
            self.used[bin_id] = offset + length
            self.bins[space].append(bin_id)
            self.free |= 1 << space
        else:
            del self.used[bin_id]
        return bin_id, offset


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to rows that have a ``length``; ``parts`` should be a written table, it is read twice."""
    total = parts.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / group_tokens))
    kept = parts.drop("sequence_id", "offset", "_group")
    dealt = kept.withColumn("_group", F.pmod(F.xxhash64(F.lit("pack"), *[kept[c] for c in ("doc_id", "piece", "ids_crc32")]), F.lit(groups)))

    def stream(table: pa.Table) -> pa.Table:
        ids, crcs, lengths = (table.column(c) for c in ("doc_id", "ids_crc32", "length"))
        # arrival order: a hash of the content, the same on every run and unrelated to length
        order = np.lexsort((table.column("piece").to_numpy(), crcs.to_numpy()))
        fit, size = BestFit(capacity, open_bins), lengths.to_numpy()
        where, offset = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        for i in order:
            where[i], offset[i] = fit.place(int(size[i]))
        group = table.column("_group").to_numpy()
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(where * groups + group)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(stream, schema)


def packed(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    return pack(staged(pieces(docs, capacity=capacity, with_ids=with_ids)), capacity)
