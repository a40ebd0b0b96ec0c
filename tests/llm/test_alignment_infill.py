import hashlib
import re
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lossweave.llm import alignment, infill, queries

from .conftest import SF

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SPOTS = st.text(st.sampled_from("ab \t\n\r\x0b\x0c\x0e\x1f\x00é漢𝒳'0.<PSM>▁ "), max_size=40)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(SPOTS, min_size=1, max_size=5))
def test_units_end_where_the_pattern_says(texts):
    units = infill.Units([t.encode() for t in texts])
    for i, t in enumerate(texts):
        found = UNIT.findall(t)
        assert units.counts[i] == len(found) and "".join(found) == t
        ends = [len("".join(found[:k]).encode()) for k in range(len(found) + 1)]
        k = np.arange(len(found) + 1)
        assert units.end(np.full(len(k), i), k).tolist() == ends


@settings(max_examples=300, deadline=None)
@given(SPOTS.filter(lambda t: not any(m in t for m in ("<P>", "<S>", "<M>"))), st.sampled_from(["spm", "psm"]), st.data())
def test_outputs_lead_back_to_the_text(text, form, data):
    lo = data.draw(st.integers(0, len(text)))
    hi = data.draw(st.integers(lo, len(text)))
    p, m, s = text[:lo].encode(), text[lo:hi].encode(), text[hi:].encode()
    assert infill.original(infill.arranged(p, m, s, form), form) == text.encode()


def filled(doc, text):
    """The contract by plain slicing."""
    h = [int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = UNIT.findall(text)
    lo, hi = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def marked(spark):
    texts = ["<P> in a text", "x <M>", "a <S", "P> b", "<", "ends with space ", "\n", "é" * 9 + " 漢字", "word " * 60_000 + "end", None]
    return spark.createDataFrame([(i, t) for t in texts for i in range(12)], "doc_id long, text string")


def test_fill_in_middle_equals_plain_slicing(odd, marked, docs):
    for frame in (odd, marked, docs):
        got = infill.restored(infill.transformed(frame)).collect()
        want = [(r.doc_id, *filled(r.doc_id, r.text or "")) for r in frame.collect()]
        assert sorted(map(repr, [tuple(r)[:-1] for r in got])) == sorted(map(repr, want))
        back = Counter((r.doc_id, r.restored) for r in got)
        assert back == Counter((r.doc_id, r.text or "") for r in frame.collect())
    forms = Counter(r.form for r in infill.transformed(docs).collect())
    assert set(forms) == {"plain", "spm", "psm"}


def test_fill_in_middle_edges(spark, empty):
    assert infill.restored(infill.transformed(empty)).count() == 0
    assert [len(list(infill.blocks([b"x" * 10] * 5, room))) for room in (1, 20, 100)] == [5, 3, 1] and not list(infill.blocks([]))


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), byte_table()


def byte_table():
    """Byte-level characters back to bytes: printable ones stand for themselves, the others from 256 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def tokens_of(tools, text):
    a, b, table = tools
    if not text:
        return None
    enc = a.encode(" " + text, add_special_tokens=False)
    ta = [bytes(table[c] for c in t) for t in enc.tokens]
    ids_b = b.encode(text)
    pieces = [b.id_to_piece(i) for i in ids_b]
    tb = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
    whole = (" " + text).encode()
    return None if b"".join(ta) != whole or b"".join(tb) != whole else (enc.ids, np.cumsum([len(t) for t in ta]).tolist(), ids_b, np.cumsum([len(t) for t in tb]).tolist())


def brute(tools, rows):
    found = [(doc, tokens_of(tools, text)) for doc, text in rows]
    linked = []
    for _, t in found:
        by_end = dict(zip(t[3], t[2])) if t else {}
        linked.append([(i, by_end[e]) for i, e in zip(t[0], t[1]) if e in by_end] if t else [])
    count = Counter(p for links in linked for p in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for (doc, t), links in zip(found, linked):
        if not t:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        common = set(t[1]) & set(t[3])
        sides = []
        for ids, ends in ((t[0], t[1]), (t[2], t[3])):
            parts = [[]]
            for i, e in zip(ids, ends):
                parts[-1].append(str(i))
                if e in common:
                    parts.append([])
            sides.append([",".join(p) for p in parts[:-1]])
        groups = ["|".join(g) for g in zip(*sides)]
        best = sum(count[p] == most[p[1]] for p in links)
        out.append((doc, len(t[0]), len(t[2]), len(groups), len(links), best, sum(count[p] for p in links), sha(";".join(groups))))
    return sorted(out, key=repr)


def test_alignment_equals_whole_text_tokenisers(spark, docs, odd, tools):
    got = sorted((tuple(r) for r in queries.op11_token_alignment(spark, SF).collect()), key=repr)
    assert got == brute(tools, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    texts = ["two  spaces", " leads", "trails ", "tab\tand\nnewline", "nbsp x 　y", "▁x", "ﬁ ½", "don't  stop", "a \n b", "x\x00y", "<s> <unk> <0x41>", "<|endoftext|> x", "\r\n;\r )\r", "é" * 200, "z" * 3000, "word\n\n next", "1 2  3"]
    more = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    own = alignment.aligned(more).collect()
    assert sorted((tuple(r)[:8] for r in own), key=repr) == brute(tools, [(r.doc_id, r.text) for r in more.collect()])
    assert all((sha(r.groups) if r.groups else "") == r.groups_sha256 for r in own)


@cache
def aligner():
    return alignment.Aligner(*alignment.paths(None, None))


@settings(max_examples=200, deadline=None)
@given(SPOTS)
def test_chunks_do_not_change_tokens(text):
    own = aligner()
    parts = alignment.chunks(text)
    assert "".join(parts) == " " + text
    assert [i for p in parts for i in own.a.encode_ordinary(p)] == own.a.encode_ordinary(" " + text)
    if text:
        assert [i for p in own.pieces(parts) for i in p] == own.b.encode(text)


def test_full_memory_is_cleared_without_losing_counts(docs, monkeypatch):
    want = sorted(map(tuple, alignment.pair_counts(docs).collect()))
    monkeypatch.setattr(alignment.Aligner, "full", property(lambda self: True))
    assert sorted(map(tuple, alignment.pair_counts(docs).collect())) == want


def test_products_equal_dense_ones(monkeypatch):
    rng = np.random.default_rng(1)
    for room in (3, 1 << 20):
        monkeypatch.setattr(alignment, "PRODUCTS", room)
        cuts = [np.unique(np.concatenate((rng.integers(1, 60, 15), [60]))) for _ in range(2)]
        a, b = (alignment.incidence(c, 60) for c in cuts)
        dense = []
        for m in (a, b):
            x = np.zeros((len(m.row) - 1, 60), int)
            for i in range(len(x)):
                x[i, m.column[m.row[i] : m.row[i + 1]]] = 1
            dense.append(x)
        got = np.zeros((len(dense[0]), len(dense[1])), int)
        for i, j, v in alignment.overlap_links(a, b):
            got[i, j] = v
        assert np.array_equal(got, dense[0] @ dense[1].T)
        common = np.intersect1d(*cuts)
        group = [np.searchsorted(common, c) for c in cuts]
        links = {(int(i), int(j)) for r, c, _ in alignment.group_links(*(alignment.membership(g, len(common)) for g in group)) for i, j in zip(r, c)}
        assert links == {(i, j) for i in range(len(cuts[0])) for j in range(len(cuts[1])) if group[0][i] == group[1][j]}


def test_alignment_edges(empty):
    assert alignment.aligned(empty).count() == 0 and alignment.pair_counts(empty.where(F.lit(False))).count() == 0
