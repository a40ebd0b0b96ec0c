import random
from collections import Counter

import corpus_pipeline
from lossweave.llm import jaccard, nearcopies


def plain(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def family(rng, size, words, changed):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(changed):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def brute(rows):
    """Ids that stay: the smallest of each component of pairs that share 0.8 of their shingles."""
    sets = [plain(t or "") for _, t in rows]
    root, index = list(range(len(rows))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in index.get(g, []))
        for j, c in common.items():
            if 10 * c >= 8 * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
        for g in s:
            index.setdefault(g, []).append(i)
    stays = {}
    for i, (doc, _) in enumerate(rows):
        stays[find(i)] = min(doc, stays.get(find(i), doc))
    return sorted(stays.values())


def test_similar_documents_are_linked_whatever_their_bits(spark):
    rng = random.Random(5)
    texts = [t for k in range(30) for t in family(rng, 2, 60 + 8 * k, 1 + k // 10)]
    texts += family(rng, 12, 400, 1) + family(rng, 12, 400, 14) + family(rng, 40, 60, 2)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()) == brute(rows)


def test_near_copies_equal_brute_force(spark, docs, rows):
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs).collect()) == brute(rows)


def test_near_copies_edges(odd, empty):
    kept = nearcopies.keep_one(odd)
    assert kept.columns == odd.columns
    # 0: the texts without words; 4: its copies and repeats; 6 has a space that separates no words; (4, "other") and (null, "no id") are texts of their own
    assert sorted(repr((r.doc_id, (r.text or "")[:5])) for r in kept.collect()) == sorted(map(repr, [
        (0, ""), (3, "word "), (4, "a b c"), (6, "A B\xa0C"), (7, "漢字 かな"), (8, "<|end"), (4, "other"), (None, "no id"),
    ]))
    assert nearcopies.keep_one(empty).count() == 0


def test_rows_without_an_id_are_copies_too(spark):
    text = " ".join(f"t{k}" for k in range(80))
    frame = spark.createDataFrame([(None, text)] * 3 + [(None, text + " x"), (7, text), (7, text), (9, "else")], "doc_id long, text string")
    assert sorted(map(tuple, nearcopies.keep_one(frame).collect())) == [(7, text), (9, "else")]


def test_candidates_come_from_the_tries_of_the_same_shingles(spark, monkeypatch):
    rng = random.Random(8)
    rows = list(enumerate(family(rng, 3, 900, 1) + family(rng, 2, 60, 0) + family(rng, 1, 60, 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for r in nearcopies.candidates(frame, 5).collect():
        groups.setdefault(r.key, set()).add(r.doc_id)
    assert {0, 1, 2} in groups.values() and {3, 4} in groups.values()
    tested = []
    plain_test = jaccard.Links.test
    monkeypatch.setattr(jaccard.Links, "test", lambda self, pairs: (tested.append(sorted(map(tuple, pairs.distinct().collect()))), plain_test(self, pairs))[1])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()) == brute(rows) == [0, 3, 5]
    assert len(tested[0]) == 2  # both near copies with the first, from the tries; equal texts are one node
    assert not any(tested[1:])  # nothing is left for the signatures
