"""Language-model scoring: a gated recurrent model over frequent words and classes of rare ones.

Counting: words of all training texts, summed per task and then by one shuffle. The most frequent words (a bounded
list) are known to every task; the counts of all others meet the texts in a join on the word, which
no frequent word enters. Training: every training text once, dealt to ``ROUNDS`` rounds by hash; in each round
every partition runs truncated backpropagation on its own texts and the parameters are averaged by tokens.
Every text is read once: its symbols are written, and training and scoring read those.
Scoring: whole texts, states carried across windows.

A word outside the model's own list is its class, predicted from the state, times its add-one share of the
training tokens of the class; one slot of each class is for words never seen. So all texts have a probability.

Null and empty texts are one end token; repeated rows score alike; a table without training rows is scored by
the untrained model, in which every count is zero; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossweave.session import staged

from . import gru
from .common import arrow_pass, remainder, utf8

KNOWN_WORDS = 100_000  # most words that travel to every task
FLUSH_WORDS = 400_000
ROUNDS = 3  # a training text takes part in one of them
SUMMING_TASKS = 8
BUFFER_TOKENS = 3_000_000
SEED = 5
END = ""  # no word is empty
FINE = 32  # steps of the count histogram for each doubling


def rare_class(word: bytes) -> int:
    """The class of a word outside the model's list: by its last two bytes, which every language shares out differently."""
    return zlib.crc32(word[-2:]) % gru.RARE


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, rare, n): how often each word, and the end, occurs in all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ends = Counter(), 0

        def flush() -> pa.RecordBatch:
            words = [*seen, b""] if ends else [*seen]
            out = [pa.array(words, pa.binary()).cast(pa.string()), pa.array([rare_class(w) for w in words], pa.int32()), pa.array([*seen.values(), ends] if ends else [*seen.values()], pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "rare", "n"])

        for batch in batches:
            for text in utf8(batch):
                seen.update(text.lower().split())
                ends += 1
            if len(seen) > FLUSH_WORDS:
                ends, held = 0, ends
                yield flush()
                ends = held
        yield flush()

    parts = arrow_pass(texts.select("text"), counted, "word string, rare int, n long")
    return parts.groupBy("word", "rare").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task knows: the frequent words with their counts, totals, and what the rare classes hold."""

    words: list[bytes]  # most frequent first
    counts: np.ndarray
    end: int
    tokens: int
    types: int
    room: np.ndarray  # of each rare class: tokens + types + 1 outside the model's list

    @property
    def symbol_counts(self) -> np.ndarray:
        head = np.zeros(gru.HEAD)
        head[0] = self.end
        own = self.counts[: gru.HEAD - 1]
        head[1 : 1 + len(own)] = own
        return np.concatenate((head, self.room - 1))


def vocabulary(counts: DataFrame, known: int = KNOWN_WORDS) -> Vocabulary:
    """``counts`` is a written table. A histogram over fine steps of the count finds the bound without sorting."""
    words = counts.where(F.col("word") != END)
    step = F.floor(F.log2(F.col("n").cast("double")) * FINE)
    steps = words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, math.inf
    for r in steps:
        total += r["count"]
        if total > known:
            break
        least = r.step
    top = words.where(step >= (float(least) if least < math.inf else 1e18)).select("word", "rare", "n").toArrow().to_pylist()
    top.sort(key=lambda r: (-r["n"], r["word"].encode()))
    whole = counts.groupBy("rare", (F.col("word") == END).alias("end")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    room, end = np.ones(gru.RARE), 0
    for r in whole:
        if r.end:
            end = r.n
        else:
            room[r.rare] += r.n + r.types
    for r in top[: gru.HEAD - 1]:
        room[r["rare"]] -= r["n"] + 1
    return Vocabulary(
        [r["word"].encode() for r in top], np.array([r["n"] for r in top], np.int64), end,
        sum(r.n for r in whole), sum(r.types for r in whole), room,
    )


class Reader:
    """Texts to positions in the known words and to the model's symbols."""

    def __init__(self, v: Vocabulary):
        self.place = {w: i for i, w in enumerate(v.words)}
        self.rare = np.array([rare_class(w) for w in v.words], np.int32)
        self.symbol = np.where(np.arange(len(v.words)) < gru.HEAD - 1, np.arange(len(v.words)) + 1, gru.HEAD + self.rare).astype(np.int32)

    def read(self, text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        words = text.lower().split()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))
        new = np.flatnonzero(at < 0)
        symbol = np.empty(len(at), np.int32)
        if len(self.symbol):
            symbol[:] = self.symbol[at]
        symbol[new] = [gru.HEAD + rare_class(words[i]) for i in new]
        return [words[i] for i in new], at, symbol


def encoded(marked: DataFrame, v: Vocabulary) -> DataFrame:
    """Every text read once: symbols, what its words add outside the model, and the words that no task knows, with counts.

    ``marked`` has doc_id, text and held_out. ``turn`` is the round in which a training text takes part.
    """
    turn = F.pmod(F.xxhash64(F.lit("turn"), "doc_id"), F.lit(ROUNDS)).cast("int").alias("turn")
    span = pa.struct([("word", pa.string()), ("n", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(v)
        logs = np.log10(v.counts + 1.0)
        room = np.log10(v.room)
        inside = np.where(np.arange(len(logs)) < gru.HEAD - 1, 0.0, logs - room[reader.rare])  # of known words in rare classes
        for batch in batches:
            read = [reader.read(t) for t in utf8(batch)]
            known = [at[at >= 0] for _, at, _ in read]
            rare = [Counter(new) for new, _, _ in read]
            words = pa.array([w for c in rare for w in c], pa.binary()).cast(pa.string())
            spans = pa.StructArray.from_arrays([words, pa.array([n for c in rare for n in c.values()], pa.int64())], fields=list(span))
            made = {
                "n_tokens": pa.array([len(at) + 1 for _, at, _ in read], pa.int64()),
                "n_seen": pa.array([len(k) + (v.end > 0) for k in known], pa.int64()),
                "seen": pa.array([float(logs[k].sum()) + math.log10(v.end + 1) for k in known], pa.float64()),
                "inside": pa.array([float(inside[k].sum() - room[s[at < 0] - gru.HEAD].sum()) for k, (_, at, s) in zip(known, read)], pa.float64()),
                "symbols": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(s) for _, _, s in read)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *(s for _, _, s in read)]))),
                "rare": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)]), pa.int32()), spans),
            }
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "held_out", "turn")), *made.values()], names=["doc_id", "held_out", "turn", *made])

    kind = marked.schema["doc_id"].dataType.simpleString()
    kinds = "n_tokens long, n_seen long, seen double, inside double, symbols array<int>, rare array<struct<word:string,n:long>>"
    return arrow_pass(marked.select("doc_id", "held_out", turn, "text"), rows, f"doc_id {kind}, held_out boolean, turn int, {kinds}")


def symbols_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    cells = batch.column("symbols")
    ends, values = cells.offsets.to_numpy(), cells.values.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def trained(lessons: DataFrame, v: Vocabulary) -> np.ndarray:
    """Parameters after ``ROUNDS`` rounds. ``lessons``: turn and symbols of training texts, written."""
    flat = gru.initial(v.symbol_counts, SEED)
    for k in range(ROUNDS):
        flat = _round(lessons.where(F.col("turn") == k), flat)
    return flat


def _round(rows: DataFrame, flat: np.ndarray) -> np.ndarray:
    """One averaged round: sums of parameters, weighted by tokens, first per partition, then in a few tasks, then on the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, held, size = flat, 0, [], 0
        for batch in batches:
            more = symbols_of(batch)
            held += more
            size += sum(map(len, more)) + len(more)
            if size >= BUFFER_TOKENS:
                now, tokens, held, size = gru.train(now, held), tokens + size, [], 0
        if held:
            now, tokens = gru.train(now, held), tokens + size
        if tokens:
            blob = (now.astype(np.float64) * tokens).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([blob]), pa.array([tokens], pa.int64())], names=["part", "sum", "tokens"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = None, 0
        for batch in batches:
            for blob, n in zip(batch.column("sum").to_pylist(), batch.column("tokens").to_pylist()):
                add = np.frombuffer(blob, np.float64)
                total, tokens = add.copy() if total is None else total + add, tokens + n
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([tokens], pa.int64())], names=["sum", "tokens"])

    kinds = "sum binary, tokens long"
    parts = arrow_pass(rows.select("symbols"), local, f"part int, {kinds}")
    some = arrow_pass(parts.repartition(SUMMING_TASKS, "part").select("sum", "tokens"), summed, kinds).collect()
    tokens = sum(r.tokens for r in some)
    if not tokens:
        return flat
    return (sum(np.frombuffer(r.sum, np.float64) for r in some) / tokens).astype(np.float32)


def scored(docs: DataFrame, held_out_of: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    marked = docs.select("doc_id", "text").withColumn("held_out", remainder(held_out_of) == held_out)
    counts = staged(word_counts(marked.where(~F.col("held_out"))))
    v = vocabulary(counts)
    # the written table fixes the row numbers
    found = staged(encoded(marked, v).withColumn("_row", F.monotonically_increasing_id()))
    flat = trained(found.where(~F.col("held_out")), v)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gru.score(flat, held), pa.float64())], names=["_row", "model"])

        for batch in batches:
            # a buffer may end inside a batch, so that few long texts do not fill it many times over
            for row, symbols in zip(batch.column("_row").to_pylist(), symbols_of(batch)):
                ids.append(row)
                held.append(symbols)
                size += len(symbols) + 1
                if size >= BUFFER_TOKENS:
                    yield flush()
                    ids, held, size = [], [], 0
        if held:
            yield flush()

    models = arrow_pass(found.select("_row", "symbols"), rows, "_row long, model double")
    rare = found.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.n")
    joined = rare.join(counts.select("word", F.col("n").alias("c")).hint("shuffle_hash"), "word", "left")
    sums = joined.groupBy("_row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("_logs"),
    )
    own = found.select("_row", "doc_id", "held_out", "n_tokens", "n_seen", "seen", "inside")
    whole = own.join(staged(models), "_row").join(sums, "_row", "left")
    logs = F.coalesce("_logs", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_seen") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("seen") + logs - F.col("n_tokens") * math.log10(v.tokens + v.types + 1)).alias("base_score"),
        (F.col("model") + F.col("inside") + logs).alias("score"),
    )
