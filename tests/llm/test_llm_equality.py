"""Texts that sums of powers confuse, and rows that share a number."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_cases import SCHEMA, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from candlewick.llm import decontaminate, lsh_forest, slack_packing, token_transducer
from candlewick.llm.common import text_hashes
from candlewick.llm.pretokens import Seen

BPE = public_tokenizers.path("byte_bpe_50k.json")


def regular(size, one, other):
    """A word of two letters and its complement whose difference divides by high powers of two."""
    bits = [0]
    while len(bits) < size:
        bits += [1 - x for x in bits]
    return "".join((one, other)[x] for x in bits), "".join((other, one)[x] for x in bits)


@pytest.fixture(params=[(1024, "a", "b"), (2048, "e", "t"), (1024, "e", "a")])
def pair(request):
    return regular(*request.param)


def test_hashes_tell_regular_words_apart():
    for size in (8, 64, 256, 512, 1024, 4096):
        one, other = (x.encode() for x in regular(size, "a", "b"))
        data = np.frombuffer(one + other + one, np.uint8)
        h = text_hashes(data, np.arange(3) * size, np.arange(1, 4) * size)
        assert h[0] == h[2] != h[1]


def test_regular_words_in_every_operator(spark, pair):
    docs = spark.createDataFrame([(1, pair[0], None, None, None), (2, pair[1], None, None, None), (3, pair[0] + " " + pair[1], None, None, None)], SCHEMA)
    library = Tokenizer.from_file(BPE)
    ids = {r.doc_id: [*library.encode(r.text).ids, 1] for r in docs.collect()}
    assert {r.doc_id: r.n_tokens + 1 for r in token_transducer.token_counts(docs, BPE).collect()} == {d: len(x) for d, x in ids.items()}
    for r in slack_packing.pack(docs, BPE).collect():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    items = spark.createDataFrame([(7, pair[0])], "item_id long, text string")
    assert {r.doc_id: r["items"] for r in decontaminate.find_contamination(docs, items).collect()} == {1: ["7"], 2: [], 3: ["7"]}
    assert all(r.kept for r in lsh_forest.near_copies(docs, 4, 80).collect())


def test_memo_forgets_what_is_cold():
    seen = Seen(100)
    seen.add(np.arange(0, 200, 2, dtype=np.uint64), np.arange(100))
    seen.find(np.arange(50, 70, 2, dtype=np.uint64))
    seen.add(np.arange(1, 41, 4, dtype=np.uint64), np.arange(100, 110))
    assert seen.full and (np.diff(seen.keys.astype(np.int64)) > 0).all()
    kept = seen.halve()
    assert len(kept) == 50 and not seen.full
    values, known = seen.find(np.arange(50, 70, 2, dtype=np.uint64))
    assert known.all() and values.tolist() == list(range(25, 35)) and seen.find(np.arange(1, 41, 4, dtype=np.uint64))[1].all()


def test_packing_with_a_small_memo(spark, monkeypatch):
    monkeypatch.setattr(slack_packing, "MAX_SEEN", 20)
    library, store = Tokenizer.from_file(BPE), slack_packing.IdStore(BPE)
    import random

    rng = random.Random(2)
    for _ in range(12):
        text = prose(rng, 40)
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, bounds = store.encode(raw, np.array([0, len(raw)]), 1)
        assert ids.tolist() == [*library.encode(text).ids, 1] and bounds.tolist() == [0, len(ids)]
    assert len(store.ids) < 800


def test_rows_that_share_a_number_are_documents_of_their_own(spark):
    import random

    rng = random.Random(3)
    a, b, c = (prose(rng, 60) for _ in range(3))
    made = [(1, a, "en", "x", 1), (1, b, "en", "x", 1), (2, a, "de", "y", 1), (2, c, "en", "y", 1), (None, b, None, None, None), (None, "alone " + c[:40], None, None, None), (3, c, "en", "z", 1), (3, c, "en", "z", 1)]
    docs = spark.createDataFrame(made, SCHEMA).withColumn("__key", F.lit("mine"))
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == Counter([(1, a), (1, b), (2, c), (None, "alone " + c[:40])])
