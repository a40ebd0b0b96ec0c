"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Features are indicators of word unigrams and bigrams, hashed to a fixed number of columns. Each is scaled
by the log ratio of its smoothed frequencies in the two classes, counted over all training documents by
one pass of partial sums. A linear hinge-loss model on the scaled indicators is fitted by dual coordinate
descent (Hsieh et al., 2008) on at most about ``fit_rows`` training documents, the documented bound: ids
whose hash falls below a threshold. Scoring is a narrow pass over whole texts.

Null and empty texts have no features and get the score of the bias; rows without an id or a label do
not train; ids labelled more than once count with their smallest label; repeated rows score alike; without
labels of both classes every score is the share of label 1 (0.5 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossweave.session import lookup_join, staged

from .common import arrow_pass, remainder, utf8

COLUMNS_LOG2 = 18
FIT_ROWS = 20_000
LABEL_ROWS = 2_000_000  # some 60 MB as a hash table
SMOOTHING, COST, BLEND, EPOCHS, SEED = 1.0, 0.1, 0.25, 30, 17
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
MIX = np.uint64(0xD6E8FEB86659FD93)
BLOCK_BYTES = 1 << 22


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    letters = np.random.default_rng(SEED).integers(1, 2**63, 256, np.uint64)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        powers = [np.cumprod(np.full(BLOCK_BYTES, b, np.uint64)) for b in (BASE, inverse)]
    return letters, lower, *powers


class Features:
    """Columns of the different unigrams and bigrams of texts, computed for many texts at once."""

    def __init__(self, columns_log2: int = COLUMNS_LOG2):
        self.letters, self.lower, self.up, self.down = _tables()
        self.white = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        self.shift, self.columns = np.uint64(64 - columns_log2), 1 << columns_log2

    def _words(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of words; a hash depends on the bytes of the word only."""
        white = self.white[block]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], white, [True])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(self.letters[self.lower[block]] * self.up[: len(block)], out=sums[1:])
        return starts, ends, (sums[ends] - sums[starts]) * self.down[starts]

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) pairs, sorted and different."""
        found, lo = [], 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) + 1 <= BLOCK_BYTES):
                size += len(texts[hi]) + 1
                hi += 1
            found.append(self._of(texts[lo:hi], lo))
            lo = hi
        keys = np.concatenate(found) if found else np.empty(0, np.int64)
        return keys // self.columns, keys % self.columns

    def _of(self, texts: list[bytes], first: int) -> np.ndarray:
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        rows, hashes = [], []
        lo = 0
        while lo < len(data):  # one step, but for a single text longer than a block
            hi = min(lo + BLOCK_BYTES, len(data))
            if hi < len(data):
                gaps = np.flatnonzero(self.white[data[lo:hi]])
                hi = lo + int(gaps[-1]) + 1 if len(gaps) else hi
            starts, _, h = self._words(data[lo:hi])
            rows.append(np.searchsorted(begins, starts + lo, "right") - 1)
            hashes.append(h)
            lo = hi
        if not rows:
            return np.empty(0, np.int64)
        row, h = np.concatenate(rows), np.concatenate(hashes)
        h = (h ^ (h >> np.uint64(29))) * MIX
        pair = row[1:] == row[:-1]
        two = (h[:-1][pair] * BASE ^ (h[1:][pair] >> np.uint64(7))) * MIX
        column = np.concatenate((h >> self.shift, two >> self.shift)).astype(np.int64)
        return np.unique((np.concatenate((row, row[1:][pair])) + first) * self.columns + column)


@dataclass
class Model:
    weight: np.ndarray  # per column, already times the log-count ratio
    bias: float
    slope: float
    columns_log2: int

    def score(self, features: Features, texts: list[bytes]) -> np.ndarray:
        row, column = features.of(texts)
        norm = np.sqrt(np.maximum(np.bincount(row, minlength=len(texts)), 1))
        margin = np.bincount(row, self.weight[column], len(texts)) / norm + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin, -500, 500)))


def dual_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over ``ratio`` times unit-length indicators.

    Each step solves one document's dual variable exactly inside its box [0, cost]; the bias is one more
    indicator. Stops once no projected gradient of an epoch exceeds a thousandth.
    """
    w, bias = np.zeros(len(ratio)), 0.0
    x = [ratio[c] / np.sqrt(max(len(c), 1)) for c in rows]
    square = np.array([float(v @ v) + 1.0 for v in x])
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (float(w[rows[i]] @ x[i]) + bias) - 1.0
            free = min(slope, 0.0) if alpha[i] <= 0 else max(slope, 0.0) if alpha[i] >= cost[i] else slope
            worst = max(worst, abs(free))
            if free:
                after = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
                step, alpha[i] = (after - alpha[i]) * y[i], after
                w[rows[i]] += step * x[i]
                bias += step
        if worst < 1e-3:
            break
    return w, bias


def training(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Texts of labelled rows whose id is not held out.

    Labels are two numbers a row: up to ``LABEL_ROWS`` of them, counted first, travel to the texts; more are
    joined by a shuffle of both sides.
    """
    marked = labels.where(F.col(label).isin(0, 1) & (remainder(3) != 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    return lookup_join(docs.select("doc_id", "text"), marked, ["doc_id"], "inner", LABEL_ROWS)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, columns_log2: int = COLUMNS_LOG2) -> Model:
    columns = 1 << columns_log2

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(columns_log2)
        for batch in batches:
            row, column = features.of(utf8(batch))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(column.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), cells], names=["doc_id", "y", "cells"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = staged(arrow_pass(training(docs, labels), featured, f"doc_id {kind}, y int, cells array<int>"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, columns), np.int64)
        for batch in batches:
            cells, y = batch.column("cells"), batch.column("y").to_numpy()
            size = np.diff(cells.offsets.to_numpy())
            of = np.repeat(y, size)
            for k in (0, 1):
                seen[k] += np.bincount(cells.flatten().to_numpy()[of == k], minlength=columns)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["cell", "zero", "one"])

    by_class = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    total = sum(by_class.values())
    if len(by_class) < 2:
        share = by_class.get(1, 0) / total if total else 0.5
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(columns), float(np.log(p / (1 - p))), 1.0, columns_log2)
    # at most ``columns`` rows come back
    sums = arrow_pass(rows.select("y", "cells"), counted, "cell int, zero long, one long").groupBy("cell").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toArrow()
    counts = np.full((2, columns), SMOOTHING)
    for k, name in enumerate(("zero", "one")):
        counts[k, sums.column("cell").to_numpy()] += sums.column(name).to_numpy()
    share = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    ratio[counts.sum(axis=0) <= 2 * SMOOTHING] = 0.0

    part = min(1.0, fit_rows / total)
    below = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < int(part * (1 << 30))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, y = [], []
        for batch in batches:
            column = batch.column("cells")
            flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
            cells += [flat[a:b] for a, b in zip(ends, ends[1:])]
            y.append(batch.column("y").to_numpy())
        sign = np.where(np.concatenate(y) == 1, 1.0, -1.0) if y else np.empty(0)
        # both classes carry the same total cost
        cost = np.where(sign > 0, 0.5 / max((sign > 0).mean(), 1e-9), 0.5 / max((sign < 0).mean(), 1e-9)) * COST if len(sign) else sign
        w, bias = dual_descent(cells, ratio, sign, cost, EPOCHS, SEED)
        mean = np.abs(w[w != 0]).mean() if (w != 0).any() else 0.0
        blended = ((1 - BLEND) * mean * np.sign(w) * (w != 0) + BLEND * w) * ratio
        margin = np.array([blended[c].sum() / np.sqrt(max(len(c), 1)) for c in cells]) + BLEND * bias
        cut = _cut(margin, sign)
        spread = np.abs(margin - cut).mean() if len(margin) else 1.0
        yield pa.RecordBatch.from_arrays([pa.array([blended.astype(np.float32).tobytes()]), pa.array([float(BLEND * bias - cut)]), pa.array([float(2 / max(spread, 1e-9))])], names=["w", "bias", "slope"])

    # about ``fit_rows`` rows at most, sorted so that reruns agree
    sample = rows.where(below).repartition(1).sortWithinPartitions("doc_id").select("y", "cells")
    w, bias, slope = arrow_pass(sample, descend, "w binary, bias double, slope double").first()
    return Model(np.frombuffer(w, np.float32).astype(np.float64), bias, slope, columns_log2)


def _cut(margin: np.ndarray, sign: np.ndarray) -> float:
    """The threshold with the best mean of both classes' shares on the fitted rows, in the middle of its gap."""
    if not len(margin):
        return 0.0
    order = np.argsort(margin, kind="stable")
    m, s = margin[order], sign[order]
    below = np.cumsum(s < 0) / max((s < 0).sum(), 1)
    above = 1 - np.cumsum(s > 0) / max((s > 0).sum(), 1)
    k = int(np.argmax(below + above))
    return float((m[k] + m[min(k + 1, len(m) - 1)]) / 2)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score; the model is one short vector, of the size of the feature columns."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    w, bias, slope, log2 = model.weight.astype(np.float32), model.bias, model.slope, model.columns_log2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(log2), Model(w, bias, slope, log2)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.score(features, utf8(batch)))], names=["doc_id", "score"])

    return arrow_pass(docs.select("doc_id", "text"), rows, f"doc_id {kind}, score double")
