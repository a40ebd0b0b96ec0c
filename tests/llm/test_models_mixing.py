import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lossweave.llm import gru, lm, mixing, nbsvm, queries, secrets

from .conftest import SF
from .test_near_copies import brute


def test_features_are_unigrams_and_bigrams():
    f = nbsvm.Features()
    row, column = f.of([b"foo bar", b"", b"x FOO", b"foo  bar foo bar"])
    sets = [set(column[row == k].tolist()) for k in range(4)]
    assert len(sets[0]) == 3 and not sets[1] and len(sets[0] & sets[2]) == 1
    assert sets[0] < sets[3] and len(sets[3]) == 4


def test_features_do_not_depend_on_blocks(monkeypatch):
    texts = [("w%d " % (k % 7) * k).encode() for k in range(40)]
    f = nbsvm.Features()
    want = f.of(texts)
    monkeypatch.setattr(nbsvm, "BLOCK_BYTES", 64)
    small = nbsvm.Features()
    # words are never cut, except words longer than a block; pairs over a block's edge are kept
    got = small.of(texts)
    assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(80)]
    y = np.where([3 in r or 5 in r for r in rows], 1.0, -1.0)
    ratio, cost = rng.uniform(0.5, 1.5, 12), np.full(80, 0.7)
    w, bias = nbsvm.dual_descent(rows, ratio, y, cost, 2000, 1)
    x = np.zeros((80, 13))
    for i, r in enumerate(rows):
        x[i, r], x[i, 12] = ratio[r] / 2, 1
    full = np.append(w, bias)
    primal = 0.5 * full @ full + (cost * np.maximum(0, 1 - y * (x @ full))).sum()
    for _ in range(300):
        other = full + rng.normal(0, 0.02, 13)
        assert primal <= 0.5 * other @ other + (cost * np.maximum(0, 1 - y * (x @ other))).sum() + 1e-3


def test_quality_query_learns(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op3_nbsvm_quality(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in out) >= 0.9 * len(out)
    low = [r.score for r in out if labels[r.doc_id] == 0]
    high = [r.score for r in out if labels[r.doc_id] == 1]
    assert np.mean([a > b for a in high for b in low]) > 0.95


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    for frame, marks in ((odd, labels), (odd, labels.where("false")), (odd, labels.where("quality = 1")), (empty, labels)):
        got = nbsvm.scored(frame, nbsvm.fit(frame, marks)).collect()
        assert len(got) == frame.count() and all(0 <= r.score <= 1 for r in got)


def test_targets_share_excess():
    goal = mixing.targets({"=a": 100, "=b": 10, "=c": 500, "~": 90})
    assert goal["=b"] <= 20 and goal["=a"] <= 200 and sum(goal.values()) == pytest.approx(1.5 * 700)
    assert goal["=a"] == 200 and goal["=b"] == 20
    assert goal["=c"] / goal["~"] == pytest.approx(2 / 3) or goal["~"] == 180
    assert mixing.targets({}) == {}


def test_tree_hands_out_every_block_once():
    quota = np.array([5, 0, 17, 100, 1])
    parts = [mixing.shard_path(quota, 7, s, 3) for s in range(7)]
    assert (sum(p[0] for p in parts) == quota).all()
    for s in range(1, 7):
        assert (parts[s][1] == sum(p[0] for p in parts[:s])).all()
    sizes = [int(p[0].sum()) for p in parts]
    assert max(sizes) - min(sizes) <= 1


def test_split_has_hypergeometric_mean():
    held, rng = np.array([10, 30, 60]), np.random.default_rng(1)
    draws = np.array([mixing.split(held, 40, rng) for _ in range(2000)])
    assert (draws.sum(axis=1) == 40).all() and np.allclose(draws.mean(axis=0), [4, 12, 24], atol=0.2)


@pytest.mark.parametrize("block_rows", [4, 1024])
def test_mix_meets_its_targets(docs, block_rows):
    got = mixing.mixed(docs, shards=8, block_rows=block_rows).collect()
    again = mixing.mixed(docs.repartition(5), shards=8, block_rows=block_rows).collect()
    assert len(got) == docs.count() and {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, goal, size, largest = Counter(), {}, {}, Counter()
    for r in got:
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.size * len(r.draws)
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]], size[source[r.doc_id]] = r.target, r.source_size
    # a block of four documents can only come as near as their sizes allow
    assert all(abs(taken[s] - goal[s]) <= (max(0.03 * goal[s], 60) if block_rows > 4 else largest[s]) for s in goal)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(size.values()))


def test_fill_comes_as_near_as_sizes_allow():
    rng = np.random.default_rng(5)
    for _ in range(50):
        size = rng.integers(0, 40, 9)
        sums = {sum(int(x) for k, x in enumerate(size) if m >> k & 1) for m in range(512)}
        room = float(rng.uniform(0, size.sum() + 1))
        got = mixing.fill(size, rng.permutation(9), room)
        assert size[got].sum() == max(s for s in sums if s <= room) and not got[size == 0].any()


def test_fill_is_bounded_for_long_texts(monkeypatch):
    rng = np.random.default_rng(6)
    size = np.minimum(np.exp(rng.normal(9, 2, 1024)).astype(np.int64), 200_000)
    for share in (0.1, 0.5, 0.9):
        room = float(size.sum() * share)
        got = mixing.fill(size, rng.permutation(1024), room)
        assert 0 <= room - size[got].sum() <= 1e-3 * room
    monkeypatch.setattr(mixing, "MOST_BITS", 32)
    for _ in range(50):
        size = rng.integers(0, 5_000, 40)
        room = float(rng.uniform(0, size.sum() + 1))
        got = mixing.fill(size, rng.permutation(40), room)
        assert size[got].sum() <= room and not got[size == 0].any() and not (size[~got & (size > 0)] <= room - size[got].sum()).any()


def test_mix_deals_rows_without_an_id(docs):
    same = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    digest = mixing.staged(mixing.sized(same).select("doc_id", "size", mixing.SOURCE, mixing.CONTENT).withColumn("_row", F.monotonically_increasing_id()))
    rows, _ = mixing.plan(digest, shards=4, block_rows=8)
    lost = rows.where("doc_id is null").groupBy(mixing.SOURCE, "_block").count()
    assert lost.agg(F.max("count")).first()[0] <= 16 and lost.count() > 4


def test_mix_edges(odd, empty):
    got = mixing.mixed(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mixed(empty).count() == 0
    out = mixing.sampled(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes and out.count() == sum(len(r.draws) for r in got)
    assert mixing.sampled(empty).count() == 0


def test_gru_score_equals_a_plain_loop():
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, gru.SYMBOLS, n).astype(np.int32) for n in (0, 1, 33, 5, 90, 17, 64)]
    flat = gru.initial(np.ones(gru.SYMBOLS), 1)
    flat = flat + 0.1 * rng.standard_normal(len(flat)).astype(np.float32)
    p, u = gru.unpacked(flat.astype(np.float64)), gru.UNITS

    def soft(v):
        return v - np.log(np.exp(v - v.max()).sum()) - v.max()

    def plain(text):
        h, x, total = np.zeros(u), 0, 0.0
        for y in [*text, 0]:
            a, b = p["inward"][x], h @ p["across"]
            g = 1 / (1 + np.exp(-(a[: 2 * u] + b[: 2 * u])))
            fresh = np.tanh(a[2 * u :] + g[u:] * b[2 * u :])
            h, x = (1 - g[:u]) * fresh + g[:u] * h, y
            c = int(gru.class_of(np.array([y]))[0])
            total += soft(h @ p["to_class"] + p["class_bias"])[c]
            if y < gru.HEAD:
                total += soft(h @ p["to_word"][c] + p["word_bias"][c])[y % gru.WIDTH]
        return total * gru.LOG10

    for most, window in ((3, 8), (512, 32)):
        assert gru.score(flat, texts, most, window) == pytest.approx([plain(t) for t in texts], rel=1e-4, abs=1e-4)


def test_gru_tables_grow_with_the_tokens_not_with_the_longest_text(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, gru.SYMBOLS, n).astype(np.int32) for n in (5000, *[3] * 511)]
    cells, dealt = [], gru.lanes

    def counted(*args):
        lane = dealt(*args)
        cells.append(lane.symbol.size)
        return lane

    monkeypatch.setattr(gru, "lanes", counted)
    flat = gru.initial(np.ones(gru.SYMBOLS), 1)
    got = gru.score(flat, texts)
    assert cells[0] <= 4 * sum(len(t) + 1 for t in texts)
    assert got == pytest.approx(np.concatenate([gru.score(flat, [t]) for t in texts]), rel=1e-4, abs=1e-4)


def test_gru_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    text = [rng.integers(1, gru.SYMBOLS, 12).astype(np.int32)]
    flat = gru.initial(np.ones(gru.SYMBOLS), 1)
    base = gru.score(flat, text)[0]
    after = flat
    for _ in range(5):
        after = gru.train(after, text, rate=0.02)
    assert gru.score(after, text)[0] > base
    # one step of one window moves every parameter against the sign of the numeric gradient
    step = gru.train(flat, text, rate=1e-3) - flat
    moved = np.flatnonzero(np.abs(step) > np.abs(step).max() / 50)
    agree = 0
    for i in rng.choice(moved, 25, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 0.02
        down[i] -= 0.02
        agree += (gru.score(up, text)[0] - gru.score(down, text)[0] > 0) == (step[i] > 0)
    assert agree >= 24


def test_training_stream_holds_every_token_once():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, gru.SYMBOLS, n).astype(np.int32) for n in (0, 1, 700, 5, 90, 0, 64)]
    want = Counter((0 if i == 0 else int(t[i - 1]), 0 if i == len(t) else int(t[i])) for t in texts for i in range(len(t) + 1))
    for most in (1, 3, 128):
        lane = gru.stream(texts, most)
        real = lane.text.T.ravel() == 0
        symbol, target, start = (x.T.ravel()[real] for x in (lane.symbol, lane.target, lane.start))
        assert Counter(zip(symbol.tolist(), target.tolist())) == want
        assert np.all(start[1:][target[:-1] == 0]) and start[0] and start.sum() <= len(texts) + len(lane.length)


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [""]


def test_language_model_counts_and_base(spark, rows):
    got = {r.doc_id: r for r in queries.op7_gru_scores(spark, SF).collect()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    count = Counter(t for d, x in rows if not out[d] for t in tokens(x))
    n, v = sum(count.values()), len(count)
    for d, x in rows:
        r, t = got[d], tokens(x)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(t), sum(count[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r.score < 0


def test_words_beyond_the_known_list_meet_their_counts(docs, monkeypatch):
    want = {r.doc_id: r for r in lm.scored(docs).collect()}
    monkeypatch.setattr(lm, "KNOWN_WORDS", 1500)
    original = lm.vocabulary
    monkeypatch.setattr(lm, "vocabulary", lambda counts: original(counts, 1500))
    for r in lm.scored(docs).collect():
        assert (r.n_known, r.n_tokens) == (want[r.doc_id].n_known, want[r.doc_id].n_tokens)
        assert r.base_score == pytest.approx(want[r.doc_id].base_score, rel=1e-9)
        assert r.score == pytest.approx(want[r.doc_id].score, rel=1e-3, abs=0.05)


def test_language_model_edges(odd, empty):
    got = lm.scored(odd).collect()
    assert len(got) == odd.count() and all(r.n_tokens >= 1 and math.isfinite(r.score) for r in got)
    assert lm.scored(empty).count() == 0


def test_class_probabilities_sum_to_one(docs):
    counts = lm.word_counts(docs)
    v = lm.vocabulary(counts)
    inside = np.ones(gru.RARE)  # the slot of words never seen
    for i, (w, c) in enumerate(zip(v.words, v.counts)):
        if i >= gru.HEAD - 1:
            inside[lm.rare_class(w)] += c + 1
    assert len(v.words) == v.types - 1 and inside == pytest.approx(v.room)


def test_pipeline_stages_take_effect(spark, docs, odd, empty):
    frame = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, frame = frame, stage(spark, frame, SF).persist()
        if k < 4:
            assert frame.columns == docs.columns, name
            assert stage(spark, odd, SF).columns == odd.columns and stage(spark, empty, SF).count() == 0
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in frame.collect()) == brute([(r.doc_id, r.text) for r in before.collect()])
        if name == "secret_scan":
            assert frame.count() == before.count() and not secrets.scanned(frame).where(F.size("certain") > 0).count()
    sizes = frame.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).collect()
    assert all(r.n == r.m <= 2048 for r in sizes)
    assert corpus_pipeline.run(spark, SF).count() == frame.count()
