import random

import numpy as np

from lossweave.llm import jaccard, queries
from lossweave.llm.jaccard import Rule

from .conftest import SF


def grams(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, rule=Rule()):
    """(doc_id, n_shingles, component_id) of every row, from all pairs that share an n-gram."""
    sets = [grams(t, rule.width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for j in index.setdefault(g, []):
                common[j] = common.get(j, 0) + 1
            index[g].append(i)
        for j, c in common.items():
            if rule.whole * c >= rule.part * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(doc, names.get(find(i), doc))
    return sorted(((doc, len(sets[i]), names.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def family(rng, size, words, changed, same=0):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)] * same
    for _ in range(size):
        own = list(base)
        for _ in range(changed):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def compared(spark, texts, rule=Rule(), few=None):
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), rule, few).collect()
    want = brute(rows, rule)
    assert sorted(map(tuple, got), key=repr) == want
    return want


def test_query_equals_brute_force(spark, rows):
    assert sorted(map(tuple, queries.op13_jaccard_join(spark, SF).collect()), key=repr) == brute(rows)


def test_families_around_the_threshold(spark):
    rng = random.Random(3)
    texts = []
    for words in (1, 2, 3, 4, 12, 13, 20, 21, 22, 45, 62, 100, 130, 300):
        for changed in (1, 2, 4):
            texts += family(rng, 6, words, changed)
    # two copies of one text differ by twice what each differs from it: linked through the text or a closer copy only
    texts += family(rng, 40, 100, 1, same=1) + family(rng, 40, 100, 1) + family(rng, 30, 150, 3)
    chain = [f"c{k}" for k in range(140)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 40, 3)]
    want = compared(spark, texts)
    assert 100 < len({w[2] for w in want}) < len(texts)


def test_large_groups_are_refined_and_recentred(spark, monkeypatch):
    calls = []
    for name in ("refined", "recentred"):
        monkeypatch.setattr(jaccard, name, lambda *a, f=getattr(jaccard, name), n=name: calls.append(n) or f(*a))
    rng = random.Random(8)
    want = compared(spark, family(rng, 24, 100, 1) + family(rng, 12, 100, 1, same=1), few=6)
    assert {"refined", "recentred"} <= set(calls) and len({w[2] for w in want}) == 2


def test_bands_hold_every_linked_pair():
    rng = np.random.default_rng(5)
    for rule in (Rule(), Rule(5, 80, 100), Rule(3, 50, 100)):
        for size in [*range(1, 70), 137, 500, 2001]:
            for low in range(size * rule.part // rule.whole, size + 1):
                # the largest difference that still links sets of these sizes
                most = rule.near * (size + low) // rule.far
                most -= (most - size - low) % 2
                if low < 1 or most < max(size - low, 1) or rule.part * size > rule.whole * low:
                    continue
                both = (size + low - most) // 2
                tokens = rng.integers(0, 2**64, size + low - both, np.uint64)
                a, b = np.unique(tokens[:size]), np.unique(np.concatenate((tokens[:both], tokens[size:])))
                assert rule.linked(a, b) and set(jaccard.signatures(a, rule)[0].tolist()) & set(jaccard.signatures(b, rule)[0].tolist())


def test_edges(spark, odd, empty):
    got = jaccard.components(odd)
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert jaccard.components(empty).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None), (3, " \n")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.components(blank).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_outlines_refute_only_what_is_not_linked():
    rng = np.random.default_rng(3)
    for rule in (jaccard.Rule(), jaccard.Rule(5, 80, 100)):
        refuted = 0
        for size in (1, 2, 9, 40, 300, 2000):
            for share in (0, 1, 2, 5, 10, 12, 30, 100):
                a = np.unique(rng.integers(0, 2**64, size, np.uint64))
                b = np.unique(np.concatenate((a[len(a) * share // 100 :], rng.integers(0, 2**64, size * share // 200 + 1, np.uint64))))
                apart = len(np.setxor1d(jaccard.outline(a, rule), jaccard.outline(b, rule)))
                possible = rule.near * (len(a) + len(b)) >= rule.far * apart
                assert possible or not rule.linked(a, b)
                refuted += not possible
                assert share < 100 or size < 300 or not possible
        assert refuted
    assert len(jaccard.outline(a, jaccard.Rule())) < len(a) // 8


def test_groups_that_stay_large_and_mixed_are_compared_in_blocks(spark, monkeypatch):
    calls = []
    for name in ("sized", "in_blocks"):
        monkeypatch.setattr(jaccard, name, lambda *a, f=getattr(jaccard, name), n=name: calls.append(n) or f(*a))
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(100)]
    swaps = [(rng.randrange(100), f"x{k}") for k in range(9)]  # few edits, shared by many copies: groups overlap and halve slowly
    texts = []
    for _ in range(70):
        own = list(base)
        for at, word in rng.sample(swaps, rng.randrange(1, 5)):
            own[at] = word
        texts.append(" ".join(own))
    compared(spark, texts, few=3)
    assert "in_blocks" in calls and calls.count("sized") == 3


def test_only_sets_that_cannot_link_are_left_out(spark):
    rule, one = Rule(), [f"a{k}" for k in range(60)]
    texts = [one, one[:58] + ["b", "c"], one[:30] + [f"d{k}" for k in range(30)], one[20:55]]
    sets = [jaccard.ngrams(" ".join(t).encode(), rule.width).view(np.int64).tolist() for t in texts]
    tokens = spark.createDataFrame([(i, t) for i, s in enumerate(sets) for t in s], "name long, t long")
    sizes = spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "name long, n long")
    assert [r.name for r in jaccard.alone(tokens, sizes, rule).collect()] == [2]


def test_texts_of_left_out_sets_are_not_shuffled(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    nodes = docs.where("doc_id < 3").selectExpr("doc_id as node", "xxhash64(text) as content", "cast(text as binary) as digest")
    found = jaccard.texts_of(docs, nodes)
    assert sorted((r.node, r.text) for r in found.collect()) == [(k, f"text {k}") for k in range(3)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi, BuildRight" in plan
