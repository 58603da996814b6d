"""Decontamination, repeated passages, near copies and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import SCHEMA, brute_components, lowered, prose, rows, table
from pyspark.sql import functions as F

from candlewick.llm import decontaminate, lsh_forest, paragraph_sketch, suffix_dedup
from candlewick.llm.fm_index import FMIndex, suffix_array
from candlewick.llm.induced_sort import suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, window=10):
    words, hit, found = WORD.findall(lowered(text)), set(), set()
    for name, item in items:
        own = WORD.findall(lowered(item))
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit.update(range(j, j + size))
                    found |= {name} - {None}
    return len(words), hit, sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_benchmark_windows(spark, block_bytes):
    made = rows()
    items = [("b1", " ".join(made[0][1].split()[5:25])), ("b2", "two, WORDS"), ("b3", None), ("b4", "..."), (None, made[3][1][:200]), ("b1", made[4][1][-150:]), ("b5", "größer")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.find_contamination(table(spark, extra=True), benchmark, block_bytes=block_bytes)
    assert "kept" in got.columns
    seen = sorted((r.doc_id, r.n_words, tuple((s.first_word, s.end_word) for s in r.spans), tuple(r["items"])) for r in got.collect())
    want = []
    for doc, text, *_ in made:
        n, hit, found = brute_hits(text, items)
        edges = [i for i in sorted(hit) if i - 1 not in hit], [i + 1 for i in sorted(hit) if i + 1 not in hit]
        want.append((doc, n, tuple(zip(*edges)), tuple(found)))
    assert seen == sorted(want)
    cut = {(r.doc_id, r.text) for r in decontaminate.without_spans(got).collect()}
    assert (14, "Two Words") not in cut and (10, None) in cut and any(d == 0 and "  " in t for d, t in cut)


def test_no_documents_and_no_benchmark(spark):
    nothing = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.find_contamination(table(spark, []), nothing).count() == 0
    assert all(not r.spans for r in decontaminate.find_contamination(table(spark), nothing).collect())


def test_fm_index_counts_and_places():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 5, 700)
    index = FMIndex(text, 4)
    for size in (1, 3, 6):
        patterns = rng.integers(1, 5, (200, size))
        low, high = index.search(patterns, np.full(200, size))
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
    assert suffix_array(np.array([1, 1, 1, 0])).tolist() == [3, 2, 1, 0]


@pytest.mark.parametrize("memory", [1 << 20, 64, 1])
def test_induced_order_and_prefixes(memory):
    rng = random.Random(memory)
    for _ in range(60):
        text = bytes(rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.randint(1, 50))) * rng.randint(1, 3) + b"\0"
        limit = rng.choice([2, 9, 400])
        order, common = suffix_order(np.frombuffer(text, np.uint8), limit, memory)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        for a, b, got in zip(want, want[1:], common[1:].tolist()):
            same = next(k for k in range(len(text)) if text[a + k] != text[b + k])
            assert got == min(same, limit)


def brute_runs(texts, limit):
    seen = Counter(t[i : i + limit] for t in texts for i in range(len(t) - limit + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - limit + 1):
            if seen[t[i : i + limit]] > 1:
                gone[i : i + limit] = b"\1" * limit
        kept = bytes(b for b, x in zip(t, gone) if not x)
        out.append((len(t), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limit,gram,memory", [(200, 40, 1 << 20), (60, 12, 256)])
def test_repeated_passages(spark, limit, gram, memory):
    made = rows()
    got = suffix_dedup.repeated_passages(table(spark, extra=True), limit, gram, memory=memory)
    seen = sorted((r.doc_id, r.n_bytes, sum(x.end - x.begin for x in r.runs), r.kept_sha256) for r in got.collect())
    assert seen == sorted((m[0], *w) for m, w in zip(made, brute_runs([(m[1] or "").encode() for m in made], limit)))
    texts = {r.doc_id: (r.text, r.kept_text, r.kept) for r in got.collect()}
    assert texts[10] == (None, None, "extra") and texts[16][1] == "" and texts[13][1] == "one"
    assert suffix_dedup.repeated_passages(table(spark, [])).count() == 0


def test_runs_shrink_to_whole_characters():
    raw = "aéèb".encode()
    assert suffix_dedup.whole_characters(raw, [(2, 4)]) == []
    assert suffix_dedup.whole_characters(raw, [(1, 4)]) == [(1, 3)]
    assert suffix_dedup.merged_runs([{"begin": 5, "end": 9}, {"begin": 0, "end": 5}, {"begin": 20, "end": 21}]) == [(0, 9), (20, 21)]


def near_rows():
    rng = random.Random(5)
    made, base = [r for r in rows()], prose(rng, 120).split()
    for i in range(60):  # a chain-like group: the copies differ in up to eight words
        copy = list(base)
        for at in rng.sample(range(len(copy)), rng.randint(0, 8)):
            copy[at] = f"new{rng.randint(0, 10**6)}"
        made.append((200 + i, " ".join(copy), None, None, None))
    return made


@pytest.mark.parametrize("words,block", [(4, 1024), (5, 7)])
def test_near_copies(spark, words, block, monkeypatch):
    monkeypatch.setattr(lsh_forest.candidate_links, "__defaults__", (block,))
    monkeypatch.setitem(lsh_forest.exact_links.__kwdefaults__, "block", block)
    made = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_copies(table(spark, made, extra=True), words, 80).collect()}
    assert got == brute_components(made, words, 80)


def test_near_copies_of_nothing(spark):
    assert lsh_forest.near_copies(table(spark, [])).count() == 0
    odd = [(None, "a b c d e f", None, None, None), (3, "a b c d e f", None, None, None), (4, None, None, None, None)]
    got = {(r.doc_id, r.component_id, r.kept) for r in lsh_forest.near_copies(table(spark, odd)).collect()}
    assert got == {(None, None, True), (3, 3, True), (4, 4, True)}


def test_fingerprints(spark):
    made = [r for i, r in enumerate(rows()) if r[0] not in [x[0] for x in rows()[:i]]]
    rng = random.Random(8)
    lines = ["\n".join(prose(rng, 4) for _ in range(n)) for n in (3, 20, 60)]
    made += [(300 + i, t, None, None, None) for i, t in enumerate([*lines, lines[2]])]
    texts = [(m[0], m[1] or "") for m in sorted(made, key=lambda m: -m[0])]
    got = {r.doc_id: r for r in paragraph_sketch.compared_versions(table(spark, made, extra=True)).collect()}
    assert len(got) == len(made)

    def like(a, b):
        one, two = ({x for x in t.split("\n") if x} for t in (a, b))
        return len(one & two) / len(one | two) if one | two else 1.0

    for (doc, text), (_, following) in zip(texts, texts[1:] + texts[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(text, changed)) and r.near_next == pytest.approx(like(text, following))
    assert got[302].fingerprint == got[303].fingerprint != got[301].fingerprint
    assert got[10].fingerprint == got[11].fingerprint


def test_sketches_peel(spark):
    """Most differences of the intended size are recovered from the first sketch."""
    rng = random.Random(4)
    made = [([rng.getrandbits(62) for _ in range(n)], [rng.getrandbits(62) for _ in range(m)]) for n, m in [(4, 5)] * 40 + [(0, 0), (1, 0)]]
    df = spark.createDataFrame(made, "a array<long>, b array<long>")
    one = F.concat(paragraph_sketch.signed(F.col("a"), 1, F.lit(0), F.lit(1)), paragraph_sketch.signed(F.col("b"), -1, F.lit(0), F.lit(1)))
    peeled = [r[0] for r in df.select(paragraph_sketch._peel(one, paragraph_sketch.CELLS)).collect()]
    assert sum(p is not None and (p.plus, p.minus) == (4, 5) for p in peeled[:40]) >= 36
    assert [tuple(p) for p in peeled[40:]] == [(0, 0), (1, 0)]


def test_fingerprints_of_one_and_none(spark):
    assert paragraph_sketch.compared_versions(table(spark, [])).count() == 0
    only = paragraph_sketch.compared_versions(spark.createDataFrame([(1, "a\nb", None, None, None)], SCHEMA)).collect()[0]
    assert only.near_next == 1.0
