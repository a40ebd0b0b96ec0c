import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lossweave.llm import packing, queries, sharding

from .conftest import SF


def plain_jump(key, shards):
    key, shard, at = key % 2**64, -1, 0
    while at < shards:
        shard = at
        key = (key * 2862933555777941757 + 1) % 2**64
        at = int((shard + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return shard


@pytest.mark.parametrize("shards", [1, 2, 7, 40, 41, 1000, 70_000])
def test_jump_equals_the_plain_loop(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(5, 4000, 37), *(int(x) for x in np.random.default_rng(1).integers(-(2**63), 2**63, 300))]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump(F.col("k"), shards).alias("s")).collect()
    assert [r.s for r in got] == [plain_jump(r.k, shards) for r in got]


def test_long_loop_takes_over(spark, monkeypatch):
    df = spark.range(50).select(F.xxhash64("id").alias("k"))
    want = [plain_jump(r.k, 500) for r in df.collect()]
    assert [r.s for r in df.select(sharding.jump(F.col("k"), 500).alias("s")).collect()] == want


def test_query_has_gapless_slots_and_stable_shards(spark, rows):
    got = queries.op1_jump_shards(spark, SF).collect()
    text = dict(rows)
    slots = defaultdict(list)
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_over_many_blocks_and_repeated_rows(spark, odd):
    many = odd.select("doc_id", "text").union(spark.range(3000).selectExpr("id as doc_id", "'t' as text"))
    digest = sharding.with_shard(many.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")), 3)
    got = sharding.with_slot(digest, 3, sharding.with_shard(many.select("doc_id"), 3), ["doc_id", "size"], rows_per_block=64).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == many.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_edges_and_written_shards(spark, odd, empty, tmp_path):
    assert sharding.assignments(odd, 40).count() == odd.count()
    assert sharding.assignments(empty, 40).count() == 0
    sharding.write_shards(odd.select("doc_id", "text"), 4, str(tmp_path / "s"), rows_per_file=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == odd.count()


def checked_packing(got, capacity):
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("source", ["table", "odd"])
def test_pieces_equal_the_tokenizers_library(spark, docs, odd, source):
    frame = docs
    if source == "odd":
        texts = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", " <|endoftext|>\n", "<|endoftext|", "x <|endoftext|>y"]
        frame = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 50)), "doc_id long, text string"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in frame.select("doc_id", "text").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b]))
    got = packing.packed(frame, with_ids=True).collect()
    key = lambda x: (x[0] is None, *[y or 0 for y in x[:5]])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got), key=key) == sorted(want, key=key)
    checked_packing(got, 2048)


def test_packing_is_tight_and_bounded(spark, empty):
    sizes = np.random.default_rng(2).integers(1, 700, 6000)
    frame = spark.createDataFrame([(i, 0, int(s), i) for i, s in enumerate(sizes)], "doc_id long, piece int, length long, ids_crc32 long")
    got = packing.pack(frame, open_bins=64).collect()
    assert checked_packing(got, 2048) <= 1.02 * sizes.sum() / 2048 + 2
    several = packing.pack(frame, open_bins=16, group_tokens=200_000).collect()
    assert checked_packing(several, 2048) <= 1.08 * sizes.sum() / 2048 + 12
    assert packing.packed(empty).count() == 0


def test_fullest_bin_closes_first():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 8, 3, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]
    with pytest.raises(ValueError):
        fit.place(11)
