"""Fill-in-middle documents: cuts between words found with arithmetic on eight bytes at a time.

A unit is a word with the white space before it; white space at the end of a text is a unit of its own. UTF-8 bytes
are viewed as uint64 words. A byte ends a unit when it is no white space and the next one is, which a few additions and
masks tell for eight bytes at once; ``bitwise_count`` counts the ends of a word, a search in the running counts
finds the word of the k-th end, and prefix sums inside that word (one multiplication) find the byte. No text is split.

A document's hash decides its form and its two cuts, so that reruns and other partitionings agree. Texts that hold a
marker stay plain; hence no marker can be mistaken when a document is restored.

Null and empty texts are plain and empty with no units. Very long texts take a few times their own size in memory.
Rows that share an id are cut by the same hash, rows without an id by that of the empty string. Repeated rows are kept;
further columns are left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_pass, utf8

SEED = 42
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_SHARE, SPM_SHARE = 50, 80  # of 100
PLAIN, SPM, PSM = "plain", "spm", "psm"
BATCH_BYTES = 1 << 25  # texts scanned together
PAD = [b" " * (8 - k) for k in range(8)]  # at least one, so that a last word meets white space


def each(byte: int) -> np.uint64:
    return np.uint64(byte * 0x0101010101010101)


TOP, LOW, ONES = each(0x80), each(0x7F), each(1)
FROM_TAB, PAST_RETURN, BLANK = each(0x80 - 0x09), each(0x80 - 0x0E), each(0x20)


def white(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that is white space. Sums of two seven-bit numbers never reach the next byte."""
    low = words & LOW
    control = (low + FROM_TAB) & ~(low + PAST_RETURN)
    blank = ~((low ^ BLANK) + LOW)
    return (control | blank) & ~words & TOP


class Units:
    """Ends of the units of several texts; each text fills whole words of eight bytes of one buffer."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate(([0], np.cumsum(sizes // 8 + 1)))  # first word of each text
        words = np.frombuffer(b"".join(x for t in texts for x in (t, PAD[len(t) % 8])), "<u8").astype(np.uint64)
        space = white(words)
        after = space >> np.uint64(8)
        after[:-1] |= space[1:] << np.uint64(56)
        self.marks = ~space & after & TOP
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)))
        self.sizes = sizes
        self.words = self.before[self.first[1:]] - self.before[self.first[:-1]]
        self.tail = np.array([t[-1:].isspace() for t in texts], bool)
        self.counts = self.words + self.tail

    def end(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Byte offset behind the k-th unit of text ``at``; 0 for k = 0."""
        out = np.where(k > self.words[at], self.sizes[at], 0)
        real = (k > 0) & (k <= self.words[at])
        rank = self.before[self.first[at[real]]] + k[real]
        word = np.searchsorted(self.before, rank, "left") - 1
        left = (rank - self.before[word]).astype(np.uint64)  # 1 to 8: which mark of the word
        upto = (self.marks[word] >> np.uint64(7)) * ONES  # marks up to each byte
        reached = (upto + (np.uint64(0x80) - left) * ONES) & TOP
        byte = 8 - np.bitwise_count(reached).astype(np.int64)
        out[real] = 8 * (word - self.first[at[real]]) + byte + 1
        return out


def draws(doc_id: object) -> tuple[int, int, int, int]:
    name = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(name[8 * k : 8 * k + 8], 16) for k in range(4))


def form_of(text: bytes, h3: int, h4: int) -> str:
    if not text or h3 % 100 >= PLAIN_SHARE or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return PLAIN
    return SPM if h4 % 100 < SPM_SHARE else PSM


def arranged(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    first, second = (SUFFIX + suffix, PREFIX + prefix) if form == SPM else (PREFIX + prefix, SUFFIX + suffix)
    return b"".join((first, second, MIDDLE, middle))


def original(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made from. Its parts hold no marker and no marker can begin inside another."""
    if form == PLAIN:
        return output
    rest, middle = output.split(MIDDLE, 1)
    if form == SPM:
        suffix, prefix = rest[len(SUFFIX) :].split(PREFIX, 1)
    else:
        prefix, suffix = rest[len(PREFIX) :].split(SUFFIX, 1)
    return prefix + middle + suffix


def blocks(texts: list[bytes], room: int = BATCH_BYTES) -> Iterator[slice]:
    """Runs of texts of about ``room`` bytes."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > room:
            yield slice(lo, i)
            lo, size = i, 0
        size += len(t)
    if texts:
        yield slice(lo, len(texts))


def transformed(docs: DataFrame) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and the output text of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), utf8(batch)
            for part in blocks(texts):
                own = texts[part]
                units = Units(own)
                h = np.array([draws(i) for i in ids[part.start : part.stop].to_pylist()], np.int64).reshape(-1, 4)
                places = h[:, :2] % (units.counts[:, None] + 1)
                rows = np.arange(len(own))
                lo, hi = units.end(rows, places.min(axis=1)), units.end(rows, places.max(axis=1))
                forms, outputs, chars = [], [], []
                for t, (h3, h4), a, b in zip(own, h[:, 2:].tolist(), lo.tolist(), hi.tolist()):
                    form = form_of(t, h3, h4)
                    forms.append(form)
                    outputs.append(t if form == PLAIN else arranged(t[:a], t[a:b], t[b:], form))
                    chars.append((None, None) if form == PLAIN else (len(t[:a].decode()), len(t[a:b].decode())))
                before, middle = zip(*chars)
                yield pa.RecordBatch.from_arrays(
                    [ids[part.start : part.stop], pa.array(units.counts), pa.array(forms), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return arrow_pass(docs.select("doc_id", "text"), cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(outputs: DataFrame) -> DataFrame:
    """Adds ``restored``, the text behind ``output`` and ``form``; other columns pass through."""
    kept = outputs.drop("restored")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [original(t, f) for t, f in zip(utf8(batch, "output"), batch.column("form").to_pylist())]
            yield batch.append_column("restored", pa.array(texts, pa.binary()).cast(pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return arrow_pass(kept, back, f"{schema}, restored string")
