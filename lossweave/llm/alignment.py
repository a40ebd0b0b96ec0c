"""Alignment of two tokenisations of a text through products of sparse token-byte incidence matrices.

A (byte-level pairs) and B (pieces with byte fallback) both cut the bytes of " " + text. A token's row in an incidence
matrix has a one for each of its bytes, kept by hand in compressed rows. The row products A·Bᵀ, in Gustavson's
order, are the overlap links with the number of common bytes; links whose tokens end together are among them. Offsets
where both tokenisations end cut the tokens into groups; products of token-group matrices are the shared-group links.

Both tokenisers cut before a single space, or a single line break, that a word follows and that follows a word: no pre-token of A and no
piece of B reaches across. So a text is aligned chunk by chunk, and a chunk once for all its occurrences in a task. Texts with
other runs of white space are one chunk. Counts of linked id pairs are summed over all documents first. Two tokens that
end together are suffixes of each other, so the pair table is bounded by the suffixes of two vocabularies (below a
million rows), whatever the corpus: it may travel to all tasks.

Null and empty texts, and texts whose joined token bytes differ from " " + text, have no tokens: zeros and an empty
``groups``. A very long text takes a few dozen bytes for each of its own while its chunks are new. Repeated rows and rows without
an id are aligned one by one; further columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass

BYTES_FILE, PIECES_FILE = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"  # the first: the ranks of byte_bpe_50k.json
KEPT_CHUNKS, KEPT_BYTES = 400_000, 1 << 27  # what a task remembers
PRODUCTS = 1 << 22  # elementary products expanded at once
LOW32 = np.int64(2**32 - 1)


@dataclass
class Csr:
    """Compressed rows: the columns of row i are ``column[row[i]:row[i + 1]]``; all values are one."""

    row: np.ndarray
    column: np.ndarray
    width: int

    def transposed(self) -> Csr:
        """Counting sort by column; rows stay in order inside a column."""
        order = np.argsort(self.column, kind="stable")
        row = np.concatenate(([0], np.cumsum(np.bincount(self.column, minlength=self.width))))
        owner = np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))
        return Csr(row, owner[order], len(self.row) - 1)


def incidence(ends: np.ndarray, width: int) -> Csr:
    """Token by byte, from the end offsets of consecutive tokens."""
    return Csr(np.concatenate(([0], ends)), np.arange(width), width)


def membership(group: np.ndarray, width: int) -> Csr:
    """Token by group: one group a token."""
    return Csr(np.arange(len(group) + 1), group, width)


def products(a: Csr, b: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cells (row, column, value) of a·b, in blocks of whole rows of about ``PRODUCTS`` elementary products.

    Gustavson: a row of the product is the sum of those rows of ``b`` that the row of ``a`` names.
    """
    long = np.diff(b.row)[a.column]
    work = np.concatenate(([0], np.cumsum(long)))[a.row]
    lo, rows = 0, len(a.row) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + PRODUCTS, "right")) - 1)
        named = slice(a.row[lo], a.row[hi])
        size = long[named]
        first = np.repeat(b.row[:-1][a.column[named]] - np.cumsum(size) + size, size)
        column = b.column[first + np.arange(len(first))]
        row = np.repeat(np.repeat(np.arange(lo, hi), np.diff(a.row[lo : hi + 1])), size)
        cell, value = np.unique(row * np.int64(b.width) + column, return_counts=True)
        yield cell // b.width, cell % b.width, value
        lo = hi


def overlap_links(a: Csr, b: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return products(a, b.transposed())


def group_links(a: Csr, b: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of tokens of one group. Their number is the product of a group's sizes, hence blocks."""
    return products(a, b.transposed())


def load_bytes(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sorted(ranks, key=ranks.get)


def load_pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    text = [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in range(own.get_piece_size())]
    return own, text


def apart(parts: list[str]) -> bool:
    return all(p and not p[0].isspace() for p in parts)


def chunks(text: str) -> list[str]:
    """Parts of " " + text that both tokenisers treat apart, each with the single space or line break before it."""
    lines = [line.split(" ") for line in text.split("\n")]
    if all(map(apart, lines)):
        return [("\n" if k and not i else " ") + p for k, line in enumerate(lines) for i, p in enumerate(line)]
    parts = text.split(" ")
    return [" " + p for p in parts] if apart(parts) else [" " + text]


class Aligner:
    """Chunks aligned so far. ``stats`` has a row for each: tokens of A and B, groups, links, best links, sum of counts."""

    def __init__(self, bytes_path: str, pieces_path: str, pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.a, self.a_text = load_bytes(bytes_path)
        self.b, self.b_text = load_pieces(pieces_path)
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_text, self.b_text))
        self.pairs = pairs
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.stats, self.linked = np.zeros((0, 6), np.int64), []
        self.groups: list[bytes] = []
        self.whole = np.zeros(0, bool)
        self.size = 0

    @property
    def full(self) -> bool:
        return len(self.place) >= KEPT_CHUNKS or self.size >= KEPT_BYTES

    def pieces(self, new: list[str]) -> list[list[int]]:
        """B puts a space before each text: that is a chunk's own, or before a line break a piece of its own to leave out."""
        found = self.b.encode([c[c[0] == " " :] for c in new], num_threads=1)
        return [y if c[0] == " " else y[1:] for c, y in zip(new, found)]

    def add(self, new: list[str]) -> None:
        raw = [c.encode() for c in new]
        a = [self.a.encode_ordinary(c) for c in new]
        b = self.pieces(new)
        good = np.array([b"".join([self.a_text[i] for i in x]) == b"".join([self.b_text[i] for i in y]) == r for x, y, r in zip(a, b, raw)], bool)
        a, b = ([x if ok else [] for x, ok in zip(side, good)] for side in (a, b))
        width = sum(len(r) for r, ok in zip(raw, good) if ok)
        a_ids, b_ids = (np.array([i for x in side for i in x], np.int64) for side in (a, b))
        a_from, b_from = (np.concatenate(([0], np.cumsum([len(x) for x in side]))) for side in (a, b))
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j, _ in overlap_links(incidence(a_end, width), incidence(b_end, width)):
            ends = a_end[i] == b_end[j]
            rows.append(i[ends])
            columns.append(j[ends])
        i, j = np.concatenate(rows), np.concatenate(columns)
        code = (a_ids[i] << 32) | b_ids[j]
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        text = [""] * len(common)
        if self.pairs is not None:  # counting needs no groups
            in_a, in_b = (membership(np.searchsorted(common, end), len(common)).transposed() for end in (a_end, b_end))
            a_name, b_name = (list(map(str, ids.tolist())) for ids in (a_ids, b_ids))
            text = [f"{','.join(a_name[p:q])}|{','.join(b_name[r:s])}" for p, q, r, s in zip(in_a.row, in_a.row[1:], in_b.row, in_b.row[1:])]
        link_from, group_from = np.searchsorted(i, a_from), np.searchsorted(common, np.concatenate(([0], a_end))[a_from], "right")
        group_from[0] = 0
        stats = np.zeros((len(new), 6), np.int64)
        for k, edges in enumerate((a_from, b_from, group_from, link_from)):
            stats[:, k] = np.diff(edges)
        if self.pairs is not None:
            known, count, best = self.pairs
            at = np.searchsorted(known, code)
            for k, value in ((4, best), (5, count)):
                stats[:, k] = np.diff(np.concatenate(([0], np.cumsum(value[at], dtype=np.int64)))[link_from])
        groups = [";".join(text[p:q]).encode() for p, q in zip(group_from, group_from[1:])]
        self.place |= {c: len(self.groups) + k for k, c in enumerate(new)}
        self.linked += [code[p:q] for p, q in zip(link_from, link_from[1:])]
        self.stats, self.whole = np.concatenate((self.stats, stats)), np.concatenate((self.whole, good))
        self.groups += groups
        self.size += sum(map(len, groups)) + 3 * sum(map(len, raw)) + 8 * len(code)

    def look(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of all texts and their borders; a text without tokens has no chunks."""
        parts = [chunks(t) if t else [] for t in texts]
        new = list(dict.fromkeys(c for p in parts for c in p if c not in self.place))
        if new:
            self.add(new)
        at = np.array([self.place[c] for p in parts for c in p], np.int64)
        size = np.array([len(p) for p in parts], np.int64)
        owner = np.repeat(np.arange(len(parts)), size)
        bad = np.zeros(len(parts), bool)
        bad[owner[~self.whole[at]]] = True
        return at[~bad[owner]], np.concatenate(([0], np.cumsum(np.where(bad, 0, size))))


def paths(bytes_path: str | None, pieces_path: str | None) -> tuple[str, str]:
    return bytes_path or public_tokenizers.path(BYTES_FILE), pieces_path or public_tokenizers.path(PIECES_FILE)


def pair_counts(docs: DataFrame, bytes_path: str | None = None, pieces_path: str | None = None) -> DataFrame:
    """(a, b, n): how many links of the whole corpus join the two ids."""
    where = paths(bytes_path, pieces_path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Aligner(*where)
        seen = np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            code = np.concatenate([np.zeros(0, np.int64), *own.linked])
            times = np.repeat(seen, [len(x) for x in own.linked]) if own.linked else np.zeros(0, np.int64)
            found, place = np.unique(code, return_inverse=True)
            n = np.zeros(len(found), np.int64)
            np.add.at(n, place, times)
            real = n > 0
            columns = [pa.array((found[real] >> 32).astype(np.int32)), pa.array((found[real] & LOW32).astype(np.int32)), pa.array(n[real])]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

        for batch in batches:
            at, _ = own.look(batch.column("text").to_pylist())
            more = np.bincount(at, minlength=len(own.groups))
            more[: len(seen)] += seen
            seen = more
            if own.full:
                yield flush()
                own.clear()
                seen = np.zeros(0, np.int64)
        yield flush()

    parts = arrow_pass(docs.select("text"), counted, "a int, b int, n long")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"))


def marked_pairs(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted codes of id pairs, their counts, and whether a pair has the highest count of its B id."""
    rows = counts.toArrow()
    a, b, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
    code = (a << 32) | b
    order = np.argsort(code)
    most = np.zeros(int(b.max()) + 1 if len(b) else 1, np.int64)
    np.maximum.at(most, b, n)
    return code[order], n[order], (n == most[b])[order]


def aligned(docs: DataFrame, bytes_path: str | None = None, pieces_path: str | None = None, with_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups (text) of every document."""
    where = paths(bytes_path, pieces_path)
    pairs = docs.sparkSession.sparkContext.broadcast(marked_pairs(pair_counts(docs, *where)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Aligner(*where, pairs.value)
        for batch in batches:
            if own.full:
                own.clear()
            at, border = own.look(batch.column("text").to_pylist())
            sums = np.diff(np.concatenate((np.zeros((1, 6), np.int64), np.cumsum(own.stats[at], axis=0)))[border], axis=0)
            chosen = [own.groups[k] for k in at.tolist()]
            groups = [b";".join(chosen[p:q]) for p, q in zip(border, border[1:])]
            digest = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            columns = [batch.column("doc_id"), *(pa.array(sums[:, k]) for k in range(6)), pa.array(digest, pa.string())]
            if with_groups:
                columns.append(pa.array(groups, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "groups_sha256", *["groups"] * with_groups])

    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names) + ", groups_sha256 string" + ", groups string" * with_groups
    return arrow_pass(docs.select("doc_id", "text"), rows, schema)
