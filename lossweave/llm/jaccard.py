"""Exact join of documents by the Jaccard similarity of their word n-grams, and its connected components.

A set of which more tokens occur nowhere else than a link allows has no link. First the tokens in the lowest part of the hash range are
counted, then all tokens of the sets that are left; only sets that pass both counts go on.

Pigeonhole over a partition of the universe. Sizes fall into bands, so that a set and a partner at least as large lie in the same
band or in neighbouring ones. Linked sets of a band differ in at most H tokens; a hash deals all tokens to 2P segments, in pairs,
with 2P > H. So some pair of segments differs in at most one token: one half holds equal subsets, the other half equal ones or
ones that one deletion makes equal. The signature of a set is its subset in a half (its token sum). Sets with a signature
in common are candidates. Cost decides how a signature is used: one shared by few sets, as it is; one shared by so many that their pairs
cost more than entries for the other half, together with that half and its one-deletion neighbours. Every link is verified on whole sets.

Small groups of sets under a signature are compared, large ones never expanded into pairs. Their sets meet a leading set; a group that is
then one component is done, for nothing in it can be linked anew. What is still large is refined, and then recentred: with
R the tokens of more than half the group, two sets differ exactly where their differences from R do. Sets
close to R are linked to the closest one without a test; all other links need a common token in the differences. Such tokens
make new groups, of at most half the size. What is mixed even then is compared whole, block by block: a task counts the common tokens
of two blocks of sets in matrix products and returns a spanning forest. So every link is found or already implied, however large a group
of near copies is; memory is bounded by the blocks, and the pairs of such a rest are spread over tasks.

Equal sets are one node, by a 128-bit digest; tokens are 64-bit hashes of n-grams. A text with fewer words than n is one n-gram. Null
and empty texts and such without words have no n-grams, and each is a component of its own. Rows that share an id are
linked as separate rows and named by the same id; rows without an id take part but never name a component.
Repeated rows are kept. Very long texts take about 30 bytes a word while their n-grams are made. Further columns are left out, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossweave.session import BROADCAST_ROWS, staged

from .common import arrow_pass, utf8
from .components import connected, labels

SEED = 42
KEPT_WORDS, LONGEST_KEPT = 400_000, 64
BLOCK_SETS, BLOCK_TOKENS, COLUMNS = 256, 400_000, 4096  # aimed at in a block; columns of a matrix
MIX_A, MIX_B, MIX_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: a 64-bit mixer


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * MIX_C
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; short words are remembered, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found


HASHES = WordHashes()


def ngrams(text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a text: a chain over the hashes of its words."""
    words = text.lower().split()
    own = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    if not len(own):
        return own
    wide = min(width, len(own))
    chain = np.full(len(own) - wide + 1, MIX_A ^ np.uint64(wide))
    for k in range(wide):
        chain = mixed(chain + own[k : k + len(chain)])
    chain.sort()
    return chain[np.concatenate(([True], chain[1:] != chain[:-1]))]


@dataclass(frozen=True)
class Rule:
    """Sets link when ``whole`` * intersection >= ``part`` * union."""

    width: int = 3
    part: int = 90
    whole: int = 100

    @property
    def near(self) -> int:
        """Linked means near * (sum of sizes) >= far * (size of the symmetric difference)."""
        return self.whole - self.part

    @property
    def far(self) -> int:
        return self.whole + self.part

    @cached_property
    def few(self) -> int:
        """Up to this size pairs are cheaper: n(n - 1) / 2 against n entries of a half, itself and its neighbours."""
        return 2 * (2 + self.far // (2 * self.near))

    @lru_cache(4096)  # noqa: B019
    def bands(self, size: int) -> list[tuple[int, int]]:
        """(band, pairs of segments) in which a set of this size needs signatures: its own and the one below, if partners can lie there."""
        found, low, band = [], 1, 0
        while low <= size:
            high = low * self.whole // self.part + 1
            partner = (high - 1) * self.whole // self.part
            most = self.near * (high - 1 + partner) // self.far
            if size <= partner and most:  # without a difference the sets are equal, and one node
                found.append((band, most // 2 + 1))
            low, band = high, band + 1
        return found

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return self.whole * common >= self.part * (len(a) + len(b) - common)


def halves(tokens: np.ndarray, pairs: int) -> np.ndarray:
    """Which of 2 * ``pairs`` segments each token falls into."""
    return (((tokens >> np.uint64(32)) * np.uint64(2 * pairs)) >> np.uint64(32)).astype(np.int64)


def signatures(tokens: np.ndarray, rule: Rule) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Keys of all segments of the bands of a set; and, for each band, the segments of the tokens and the sums of the segments."""
    keys, parts = [np.zeros(0, np.uint64)], []
    for band, pairs in rule.bands(len(tokens)):
        own, sums = halves(tokens, pairs), np.zeros(2 * pairs, np.uint64)
        np.add.at(sums, own, tokens)
        keys.append(mixed(sums + mixed(np.arange(2 * pairs, dtype=np.uint64) + np.uint64(band << 32) + MIX_A)))
        parts.append((own, sums))
    return np.concatenate(keys), parts


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def lists(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    cells = batch.column(name)
    at, values = cells.offsets.to_numpy(), cells.values.to_numpy()
    return [values[a:b] for a, b in zip(at, at[1:])]


def lowest(tokens: np.ndarray, above: int, below: int) -> np.ndarray:
    """The tokens in the lowest ``above`` / ``below`` of the hash range."""
    return tokens[: np.searchsorted(tokens, np.uint64(min(2**64 - 1, above * 2**64 // below)))]


def with_digests(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, content (hash of the text, made by Spark), n, digest and the lowest tokens of every row.

    Half as many tokens again as may differ are enough to refute a set that has little in common with any other.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngrams(t, rule.width) for t in utf8(batch)]
            columns = [
                batch.column("doc_id"), batch.column("content"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), lists([signed(lowest(s, 3 * rule.near, 2 * rule.whole)) for s in sets]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "content", "n", "digest", "low"])

    return arrow_pass(docs.select("doc_id", "text", F.xxhash64("text").alias("content")), rows, f"doc_id {kind}, content long, n long, digest binary, low array<long>")


def alone(tokens: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """Those sets of ``sizes`` (name, n) that cannot link: of ``n`` tokens ``part`` in ``whole`` must occur in other sets too.

    ``tokens``: (name, t) of all sets, repeats allowed, of any part of the tokens that is the same for all sets.
    """
    lone = tokens.groupBy("t").agg(F.min("name").alias("name"), F.max("name").alias("last")).where("name = last")
    own = lone.groupBy("name").agg(F.count("*").alias("own")).join(sizes, "name")
    return own.where(F.lit(rule.whole) * F.col("own") > F.lit(rule.near) * F.col("n")).select("name")


def outline(tokens: np.ndarray, rule: Rule) -> np.ndarray:
    """32 bits of the tokens in the lowest part of the hash range, each once.

    Outlines differ in no more places than the sets, so one difference too many refutes a link; half as large a share again
    as may differ is enough for that in sets with little in common.
    """
    low = lowest(tokens, 3 * rule.near, 2 * rule.far)
    return np.unique(low.astype(np.uint32)).view(np.int32)


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, digest, text) of nodes (node, content, digest), from the rows with their content hashes.

    Up to a counted bound the hashes travel, so that only texts of these nodes are shuffled; beyond it all texts are.
    """
    wanted = nodes.select("content")
    wanted = F.broadcast(wanted) if nodes.count() <= BROADCAST_ROWS else wanted
    texts = docs.select("text", F.xxhash64("text").alias("content")).join(wanted, "content", "left_semi")
    return nodes.select("node", "content", "digest").join(texts.groupBy("content").agg(F.first("text").alias("text")), "content").drop("content")


def token_sets(texts: DataFrame, rule: Rule) -> DataFrame:
    """(node, tokens, n, outline) of the nodes with their whole texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngrams(t, rule.width) for t in utf8(batch)]
            if [xxhash.xxh3_128_digest(s.tobytes()) for s in sets] != batch.column("digest").to_pylist():
                raise ValueError("two different texts have one content hash")
            columns = [
                batch.column("node"), lists([signed(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([outline(s, rule) for s in sets], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "tokens", "n", "outline"])

    return arrow_pass(texts.select("node", "digest", "text"), rows, "node long, tokens array<long>, n long, outline array<int>")


def with_signatures(sets: DataFrame, rule: Rule) -> DataFrame:
    """(node, key): the keys of each set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [signed(signatures(t.view(np.uint64), rule)[0]) for t in arrays(batch, "tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists(keys)], names=["node", "keys"])

    return arrow_pass(sets.select("node", "tokens"), rows, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))


def possible(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those pairs (a, b) that outlines do not refute: what is shuffled for every pair is a small part of a set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(c).to_numpy() for c in ("m", "n"))
            apart = np.array([len(np.setxor1d(x, y, assume_unique=True)) for x, y in zip(arrays(batch, "x"), arrays(batch, "y"))], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(rule.near * (m + n) >= rule.far * apart, pa.bool_()))

    short = sets.select("node", "outline", "n")
    both = pairs.join(short.toDF("a", "x", "m"), "a").join(short.toDF("b", "y", "n"), "b")
    return arrow_pass(both.select("a", "b", "x", "y", "m", "n"), rows, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those pairs (a, b) of nodes that link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [rule.linked(x, y) for x, y in zip(arrays(batch, "x"), arrays(batch, "y"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets, left = sets.select("node", "tokens"), staged(possible(pairs, sets, rule))
    both = left.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return arrow_pass(both.select("a", "b", "x", "y"), rows, "a long, b long")


def sized(spots: DataFrame) -> DataFrame:
    """key, node, size and leader of groups with several nodes. ``spots`` has each (key, node) once; they are shuffled once for the count and the join."""
    spots = spots.repartition("key")
    several = spots.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader")).where("size > 1")
    return staged(spots.join(several, "key"))


class Links:
    """What has been tested and linked so far."""

    def __init__(self, sets: DataFrame, rule: Rule):
        self.sets, self.rule = sets, rule
        self.tested = self.roots = None

    def add(self, edges: DataFrame) -> None:
        new = staged(edges)
        if self.roots is None or not new.isEmpty():
            # a forest of what was linked before stands for its edges
            self.roots = connected(new if self.roots is None else self.roots.toDF("a", "b").unionByName(new))

    def test(self, pairs: DataFrame) -> None:
        """``pairs`` may repeat pairs that were tested before; those are left out."""
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = staged(pairs)
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        self.add(verified(pairs, self.sets, self.rule))

    def mixed_groups(self, live: DataFrame) -> DataFrame:
        """The groups that are not within one component, with the component of each node."""
        if self.roots is not None:
            live = live.drop("root").join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        else:
            live = live.withColumn("root", F.col("node"))
        several = live.groupBy("key").agg((F.min("root") < F.max("root")).alias("several")).where("several")
        return staged(live.join(several.select("key"), "key", "left_semi"))


def pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def refined(large: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(key, node) of large groups under a signature: the signature together with the other half of its pair or a one-deletion neighbour."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for node, hot, tokens in zip(batch.column("node").to_pylist(), arrays(batch, "hot"), arrays(batch, "tokens")):
                tokens, hot = tokens.view(np.uint64), hot.view(np.uint64)
                all_keys, parts = signatures(tokens, rule)
                at = 0
                for own, sums in parts:
                    band = all_keys[at : at + len(sums)]
                    at += len(sums)
                    for half in np.flatnonzero(np.isin(band, hot)):
                        other = sums[half ^ 1]
                        found = np.unique(mixed((np.concatenate(([other], other - tokens[own == half ^ 1])) * MIX_A) ^ band[half]))
                        keys.append(found)
                        nodes.append(np.full(len(found), node))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(nodes))], names=["key", "node"])

    hot = large.groupBy("node").agg(F.collect_set("key").alias("hot"))
    return arrow_pass(hot.join(sets, "node").select("node", "hot", "tokens"), rows, "key long, node long")


def recentred(large: DataFrame, sets: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Certain links (a, b), and new groups (key, node), of large groups; groups with one leader are joined first."""
    near, far = F.lit(rule.near), F.lit(rule.far)
    members = staged(large.select("leader", "node").distinct())
    shapes = members.join(sets.toDF("leader", "l"), "leader").join(sets, "node")
    away = F.concat(F.array_except("tokens", "l"), F.array_except("l", "tokens"))
    from_leader = staged(shapes.select("leader", "node", F.size("tokens").alias("n"), away.alias("away")))
    whole = from_leader.groupBy("leader").agg(F.count("*").alias("size"))
    often = from_leader.select("leader", F.explode("away").alias("t")).groupBy("leader", "t").count().join(whole, "leader").where(2 * F.col("count") > F.col("size"))
    turned = from_leader.join(often.groupBy("leader").agg(F.collect_list("t").alias("f")), "leader", "left").withColumn("f", F.coalesce("f", F.array().cast("array<long>")))
    away = F.concat(F.array_except("away", "f"), F.array_except("f", "away"))
    turned = turned.select("leader", "node", away.alias("away"), (far * F.size(away) - near * F.col("n")).alias("w"))
    turned = staged(turned)
    ends = turned.groupBy("leader").agg(F.min(F.struct("w", "node")).alias("least"), F.max("w").alias("most"))
    placed = turned.join(ends, "leader")
    certain = placed.where((F.col("node") != F.col("least.node")) & (F.col("w") + F.col("least.w") <= 0)).select("node", F.col("least.node").alias("to"))
    again = placed.where(F.col("w") + F.col("most") > 0).select("leader", "node", F.explode("away").alias("t"))
    return staged(certain.select(*pair("node", "to")).distinct()), again.select(F.xxhash64("leader", "t").alias("key"), "node").distinct()


def common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of ``x`` shares with each of ``y``."""
    found, rows = np.zeros((len(x), len(y)), np.int64), [np.repeat(np.arange(len(z)), [len(s) for s in z]) for z in (x, y)]
    (values, at), (others, to) = (np.unique(np.concatenate(z), return_inverse=True) for z in (x, y))
    _, left, right = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    columns = [np.full(len(v), -1) for v in (values, others)]
    columns[0][left], columns[1][right] = np.arange(len(left)), np.arange(len(left))
    cells = []
    for own, column, place in ((rows[0], columns[0], at), (rows[1], columns[1], to)):
        column = column[place]
        order = np.argsort(column, kind="stable")[np.count_nonzero(column < 0) :]
        cells.append((own[order], column[order]))
    for low in range(0, len(left), COLUMNS):
        parts = []
        for (own, column), z in zip(cells, (x, y)):
            a, b = np.searchsorted(column, (low, low + COLUMNS))
            part = np.zeros((len(z), COLUMNS), np.float32)
            part[own[a:b], column[a:b] - low] = 1
            parts.append(part)
        found += (parts[0] @ parts[1].T).astype(np.int64)
    return found


def in_blocks(live: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b) whose components are those of all links inside groups (leader, node); groups with one leader are joined first."""

    def join(table: pa.Table) -> pa.Table:
        node, own, i = (table.column(c).to_numpy() for c in ("node", "own", "i"))
        tokens = [t.values.to_numpy() for t in table.column("tokens")]
        x = np.flatnonzero(own == i)
        y = x if table.column("j")[0].as_py() == i[0] else np.flatnonzero(own != i)
        m, n = (np.array([len(tokens[k]) for k in z], np.int64) for z in (x, y))
        both = common([tokens[k] for k in x], [tokens[k] for k in y]) if len(x) and len(y) else np.zeros((len(x), len(y)), np.int64)
        p, q = np.nonzero(rule.whole * both >= rule.part * (m[:, None] + n - both))
        a, b = labels(node[x[p]], node[y[q]])
        return pa.table({"a": a[a != b], "b": b[a != b]})

    members = staged(live.select("leader", "node").distinct().join(sets.select("node", "n"), "node"))
    parts = members.groupBy("leader").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)).alias("parts"))
    dealt = members.join(parts, "leader").withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")
    return dealt.join(sets.select("node", "tokens"), "node").groupBy("leader", "i", "j").applyInArrow(join, "a long, b long")


def led(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of the first node of each group (node, key) with its others."""
    members = staged(groups.select("key", "node").distinct())
    leaders = members.groupBy("key").agg(F.min("node").alias("leader"))
    return members.join(leaders, "key").where("node <> leader").select(*pair("node", "leader"))


def node_links(sets: DataFrame, rule: Rule, few: int, first: DataFrame | None = None) -> DataFrame | None:
    """(node, root) of all linked nodes. ``sets``: as ``token_sets`` makes them, each set once.

    Candidates of another join come in as ``first``, groups (node, key): they are tested first, and signatures whose sets
    they bring into one component are not looked at again.
    """
    live = sized(with_signatures(sets, rule)).withColumn("root", F.col("node"))
    if live.isEmpty():
        return None
    links, turn = Links(sets, rule), 0
    if first is not None:
        links.test(led(first))
        live = links.mixed_groups(live)
    while not live.isEmpty():
        if turn > 1:
            links.add(in_blocks(live, sets, rule))
            break
        small, large = live.where(F.col("size") <= few), live.where((F.col("size") > few) & (F.col("node") != F.col("leader")))
        left, right = small.select("key", F.col("node").alias("x"), "root"), small.select("key", F.col("node").alias("y"), F.col("root").alias("other"))
        every = left.join(right, "key").where("x < y and root <> other").select(*pair("x", "y"))
        links.test(every.unionByName(large.select(*pair("node", "leader"))))
        large = links.mixed_groups(live.where(F.col("size") > few))
        if large.isEmpty():
            break
        if turn:
            certain, groups = recentred(large, sets.select("node", "tokens"), rule)
            links.add(certain)
        else:
            groups = refined(large, sets, rule).distinct()
        live, turn = links.mixed_groups(sized(groups)), turn + 1
    return links.roots


def components(docs: DataFrame, rule: Rule = Rule(), few: int | None = None, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id that links lead to, of every row.

    ``first`` makes groups (doc_id, key) of candidates from rows (doc_id, text): see ``node_links``. It gets each set once, of those that may link.
    """
    prints = staged(with_digests(docs, rule).withColumns({"row": F.monotonically_increasing_id(), "name": F.xxhash64("digest")}))
    nodes = staged(prints.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.first("content").alias("content"), F.first("n").alias("n"), F.first("name").alias("name")))
    refuted = alone(prints.select("name", F.explode("low").alias("t")), nodes.select("name", "n"), rule)
    texts = staged(texts_of(docs, staged(nodes.join(refuted, "name", "left_anti"))))
    sets = staged(token_sets(texts, rule))
    tokens = sets.select(F.col("node").alias("name"), F.explode("tokens").alias("t"))
    left = staged(sets.join(alone(tokens, sets.select(F.col("node").alias("name"), "n"), rule).toDF("node"), "node", "left_anti"))
    groups = None
    if first is not None:
        rows = texts.join(left.select("node"), "node", "left_semi").select(F.col("node").alias("doc_id"), "text")
        groups = first(rows).withColumnRenamed("doc_id", "node")
    roots = node_links(left, rule, few or rule.few, groups)
    names = nodes.select("digest", "node", "first_id")
    if roots is None:
        named = names.withColumn("component_id", F.col("first_id"))
    else:
        members = names.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = members.join(members.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    named = staged(named.select("digest", "component_id"))
    empty = prints.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return prints.where("n > 0").join(named, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)
