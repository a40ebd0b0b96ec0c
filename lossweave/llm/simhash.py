"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are collapsed to distinct ones and dealt by their leading bits. A task holds one subtree, or
two whose prefixes differ, as sorted arrays in which every trie node is a range. Pairs of nodes descend
together, add up differing bits and are dropped when the error budget is spent.

Of three thirds of the bits, one holds at most a third of the allowed differences. So the join runs over
three rotations, with the small budget inside the leading third; that keeps the top of the trie, where all
prefixes exist, from pairing everything. A task returns a spanning forest of what it linked, never the
pairs of a group; pairs of ranges already in one component are skipped. Prefixes with too many
fingerprints are dealt by more bits.

Null texts and texts without words have fingerprint zero, which links like any other. Rows without an id
get a component but never name one. Rows that share an id are one document for ``keep_one``: they stay or
go together; rows without an id stay. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossweave.session import staged

from .common import arrow_pass, utf8
from .components import connected

SHINGLE, RADIUS, SEED = 4, 4, 42
PARTS = 3
LEAF = 50_000  # distinct fingerprints aimed at in a subtree
LEAST_BITS, MOST_BITS, MORE_BITS = 6, 14, 7
PAIRS = 1 << 15  # node pairs handled at once
CHUNK = 1 << 16
ONE = np.uint64(1)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    if len(words) <= shingle:
        return digest(joined, SEED)
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    ends = ends[shingle - 1 :]
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + CHUNK], ends[lo : lo + CHUNK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns and the fingerprint as a long (the same 64 bits)."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in utf8(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], names=[*keep, "fingerprint"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", fingerprint long"
    return arrow_pass(docs.select(*dict.fromkeys([*keep, "text"])), prints, schema)


def rotated(values: np.ndarray, left: int) -> np.ndarray:
    return (values << np.uint64(left)) | (values >> np.uint64(64 - left)) if left else values


class Forest:
    """Components of a task's own values; ``label`` is the smallest index of the component."""

    def __init__(self, size: int):
        self.label, self.stale = np.arange(size), True
        self.border = np.zeros(size, np.int64)

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(after := self.label[self.label], self.label):
                self.label = after
            self.stale = True

    def joined(self, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> np.ndarray:
        """Which pairs of ranges lie in one component as a whole."""
        if self.stale:
            self.border = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1])))
            self.stale = False
        border, label = self.border, self.label
        return (border[ah - 1] == border[al]) & (border[bh - 1] == border[bl]) & (label[al] == label[bl])


def trie_links(values: np.ndarray, split: int, depth: int, radius: int, head_bits: int, head_budget: int) -> np.ndarray:
    """Component labels of sorted distinct values after joining the trie with itself.

    ``split`` 0: one subtree. Otherwise the values from ``split`` on form a second subtree whose prefix of
    ``depth`` bits differs in one bit, and only pairs between the two are sought.
    """
    n, forest = len(values), Forest(len(values))
    full = np.uint64(2**64 - 1)
    first = (np.array([0]), np.array([split or n]), np.array([split]), np.array([n]), np.array([1 if split else 0]))
    stack = [(depth, *first)]
    while stack:
        depth, al, ah, bl, bh, spent = stack.pop()
        same = al == bl
        alone = (ah - al == 1) & (bh - bl == 1)
        if alone.any():
            # a path of single children: the remaining bits are added at once
            pick = alone & ~same
            i, j = al[pick], bl[pick]
            near = np.bitwise_count(values[i] ^ values[j]) <= radius
            forest.unite(i[near], j[near])
        go = ~alone
        if go.any():
            go &= ~forest.joined(al, ah, bl, bh)
        if not go.any():
            continue
        al, ah, bl, bh, spent, same = al[go], ah[go], bl[go], bh[go], spent[go], same[go]
        keep, bit = full << np.uint64(64 - depth) if depth else np.uint64(0), ONE << np.uint64(63 - depth)
        am = np.searchsorted(values, (values[al] & keep) | bit)
        bm = np.searchsorted(values, (values[bl] & keep) | bit)
        budget = head_budget if depth < head_bits else radius
        may = spent < budget
        part = (  # straight pairs lead: they come off the stack first and join what is close
            np.concatenate((al, am, al[may], am[may & ~same])), np.concatenate((am, ah, am[may], ah[may & ~same])),
            np.concatenate((bl, bm, bm[may], bl[may & ~same])), np.concatenate((bm, bh, bh[may], bm[may & ~same])),
            np.concatenate((spent, spent, spent[may] + 1, spent[may & ~same] + 1)),
        )
        real = (part[1] > part[0]) & (part[3] > part[2])
        part = tuple(x[real] for x in part)
        for lo in reversed(range(0, len(part[0]), PAIRS)):
            stack.append((depth + 1, *(x[lo : lo + PAIRS] for x in part)))
    return forest.label


def links(prints: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) whose components are those of "at most ``radius`` differing bits" over distinct ``fingerprint``."""
    size = prints.count()
    bits = min(max(math.ceil(math.log2(max(size, 1) / leaf)) if size > leaf else 0, LEAST_BITS), MOST_BITS)
    head_bits, head_budget = 64 // PARTS, radius // PARTS
    if head_budget > 1:
        raise ValueError("the dealing covers one differing bit in a prefix: radius below 6")
    turns = [k * head_bits for k in range(PARTS)]
    deep = bits + MORE_BITS
    prefix = F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), F.shiftrightunsigned(_turned("fingerprint", t), 64 - bits).alias("prefix")) for k, t in enumerate(turns)]))
    # at most one in four of 2**bits prefixes can hold four times the mean: a bounded list
    limit = max(2 * leaf, 4 * size // (1 << bits))
    crowded = {(r.turn, r.prefix) for r in prints.select(prefix.alias("p")).groupBy("p.turn", "p.prefix").count().where(F.col("count") > limit).collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = [np.array(sorted(p for t, p in crowded if t == k), np.uint64) for k in range(PARTS)]
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, vals = [], []
            for k, turn in enumerate(turns):
                v = rotated(raw, turn)

                def send(pick: np.ndarray, width: int, flip: int) -> None:
                    own = v[pick] >> np.uint64(64 - width)
                    low = np.minimum(own, own ^ (ONE << np.uint64(flip - 1))) if flip else own
                    keys.append(((low << np.uint64(8)) | np.uint64(flip)).astype(np.int64) + (np.int64(2 * k + (width == deep)) << np.int64(40)))
                    vals.append(v[pick])

                own = v >> np.uint64(64 - bits)
                is_hot = np.isin(own, hot[k])
                send(~is_hot, bits, 0)
                send(is_hot, deep, 0)
                if head_budget:
                    for flip in range(1, MORE_BITS + 1):
                        send(is_hot, deep, flip)
                    for flip in range(1, bits + 1):
                        either = is_hot | np.isin(own ^ (ONE << np.uint64(flip - 1)), hot[k])
                        send(~either, bits, flip)
                        send(either, deep, flip + MORE_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(vals).view(np.int64))], names=["place", "value"])

    def join(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        turn, width, flip = turns[(place >> 40) // 2], deep if (place >> 40) % 2 else bits, place & 255
        values = np.unique(table.column("value").to_numpy().view(np.uint64))
        split = 0
        if flip:
            split = int(np.count_nonzero(((values >> np.uint64(64 - width)) >> np.uint64(flip - 1)) & ONE == 0))
        label = np.arange(len(values))
        if len(values) > 1 and (not flip or 0 < split < len(values)):
            label = trie_links(values, split, width, radius, head_bits, head_budget)
        member = label != np.arange(len(values))
        back = rotated(values, 64 - turn if turn else 0).view(np.int64)
        return pa.table({"a": back[member], "b": back[label[member]]})

    sent = arrow_pass(prints.select("fingerprint"), deal, "place long, value long")
    return sent.groupBy("place").applyInArrow(join, "a long, b long")


def _turned(column: str, left: int):
    c = F.col(column)
    return F.shiftleft(c, left).bitwiseOR(F.shiftrightunsigned(c, 64 - left)) if left else c


def components(prints: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """``prints`` (doc_id, fingerprint) with component_id, the smallest id that links lead to."""
    distinct = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = connected(links(distinct, radius, leaf)).toDF("fingerprint", "root")
    members = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = staged(members.join(named, "root").select("fingerprint", "component_id"))
    return prints.join(classes, "fingerprint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every document."""
    return components(staged(with_fingerprint(docs)), radius)


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents without those that a smaller id of their component stands for."""
    found = near_duplicates(docs, radius).where("doc_id is not null")
    goes = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where("not stays")
    return docs.join(goes.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
