"""Shards, chats, tokens, packing and the pipeline."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_cases import brute_components, prose, rows, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from candlewick.llm import chat_parts, histogram_shards, slack_packing, token_transducer
from candlewick.llm.token_transducer import ByteTransducer
from tests.compare import compare, connect

SMALL = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
OPERATORS = sorted(n for n in queries() if n.startswith("op"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def odd_texts():
    rng = random.Random(3)
    parts = ["'", "s", "'re", "r", "v", "l", " ", "  ", "\n", "x", "1", "!", "é", "<|endoftext|>", "'ll", "漢", "　", "\t"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["a" * 400, " " * 90 + "x", "'s", "x'r"]


def test_token_counts(spark, library):
    made = rows() + [(500 + i, t, None, None, None) for i, t in enumerate(odd_texts())]
    got = token_transducer.token_counts(table(spark, made, extra=True), BPE, keep=("doc_id", "text", "n_tokens")).collect()
    assert len(got) == len(made)
    for r in got:
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert r.n_bytes == len((r.text or "").encode())
    assert token_transducer.token_counts(table(spark, []), BPE).count() == 0


def test_transducer_starts_afresh(library):
    machine = ByteTransducer(BPE, max_states=50)
    for text in ("thandnteredble", "worthless", "zzzzqqqq", "antidisestablishmentarianism"):
        data = np.frombuffer(text.encode(), np.uint8)
        assert machine.counts(data, np.array([0]), np.array([len(data)]))[0] == len(library.encode(text).ids)


def test_packing(spark, library):
    made = rows()
    got = slack_packing.pack(table(spark, made, extra=True), BPE, 64).collect()
    ids = defaultdict(list)
    for doc, text, *_ in made:
        ids[doc].append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    total = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        total[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert total == {d: sum(map(len, x)) for d, x in ids.items()}
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 64
    assert sorted(sequences) == list(range(len(sequences)))
    assert slack_packing.pack(table(spark, []), BPE).count() == 0


def test_minimum_slack_is_closest():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted({rng.randint(1, 40) for _ in range(6)}, reverse=True)
        counts = [rng.randint(1, 3) for _ in lengths]
        chosen = slack_packing.closest(lengths, counts, 60)
        sums = {0}
        for x, n in zip(lengths, counts):
            sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= 60}
        assert sum(x * n for x, n in chosen.items()) == max(sums)
        assert all(n <= counts[lengths.index(x)] for x, n in chosen.items())
    histogram = {x: rng.randint(1, 9) for x in range(1, 64)}
    plan = slack_packing.minimum_slack(histogram, 64)
    assert plan.windows * 64 - sum(x * n for x, n in histogram.items()) < 64 * 3


def test_shards(spark):
    rng = random.Random(6)
    hot = prose(rng, 50)
    made = [(i, hot if i % 3 == 0 else prose(rng, rng.randint(1, 80)), None, None, None) for i in range(3000)] + rows()[:15]
    got = histogram_shards.balanced_shards(table(spark, made, extra=True), 6, ranges=4).collect()
    assert len(got) == len(made)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert sorted(slots) == list(range(6)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest + 0.01 * sum(sizes.values()) / 6
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(m[0], len((m[1] or "").encode()) + 8, zlib.crc32((m[1] or "").encode())) for m in made}
    assert histogram_shards.balanced_shards(table(spark, [])).count() == 0


def test_chat_parts(spark):
    part = "array<struct<kind: string, text: string, ref: string, units: double>>"
    made = [
        (1, 0, "user", [("text", "look <|image|> \\| <", None, None), ("image", None, "a.png", 2.0), ("text", "| there", None, None)]),
        (1, 1, "assistant", [("text", "fine<|im_end|>", None, None)]),
        (1, 1, "assistant", [("text", "fine<|im_end|>", None, None)]),
        (1, None, None, None),
        (None, 0, "odd|role\n", [("audio", None, "b.wav", 1.5), ("document", None, None, None), (None, "x", None, None)]),
    ]
    turns = spark.createDataFrame(made, f"conv_id long, turn long, role string, parts {part}").withColumn("formatted", F.lit("mine"))
    got = {r.conv_id: r for r in chat_parts.read_back(chat_parts.format_conversations(turns)).collect()}
    one, other = got[1], got[None]
    assert [(t.role, t.text) for t in one.turns] == [("", ""), ("user", "look <|image|> \\| <| there"), *[("assistant", "fine<|im_end|>")] * 2]
    assert one.loss_text == "fine<|im_end|>" * 2 and one.expanded_tokens == 512
    assert [(a.kind, a.ref, a.tokens) for a in other.attachments] == [("audio", "b.wav", 38), ("document", None, 640)]
    assert [(t.role, t.text) for t in other.turns] == [("odd|role\n", "x")] and other.loss_text == ""
    assert one.formatted.count("<|im_end|>") == 4
    for span in one.loss_spans:
        assert one.formatted[span.start :][: span.length] == "fine<\\|im_end\\|>"
    assert chat_parts.format_conversations(turns.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    made = rows()
    for name, df in (("documents", table(spark, made, extra=True)), ("labels", spark.createDataFrame([], "doc_id long, toxic int")), ("benchmark", spark.createDataFrame([(1, made[4][1])], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs, seen = table(spark, made, extra=True), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        seen[name] = out.toPandas()
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    assert sorted(seen["near_copies"].doc_id) == sorted(d for d, (_, _, kept) in brute_components(made, 5, 80).items() if kept)
    assert 16 not in set(seen["repeated_passages"].doc_id) and 10 in set(seen["benchmark"].doc_id)
    text = dict(zip(seen["benchmark"].doc_id, seen["benchmark"].text))
    assert all(" ".join(made[4][1].split()[:10]) not in (t or "") for t in text.values())
    assert set(seen["packing"].doc_id) == set(text)
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(got.ids_crc32) == sorted(seen["packing"].ids_crc32)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are absent")
@pytest.mark.parametrize("name", [*OPERATORS, "pipeline"])
def test_registered(spark, name):
    df = queries()[name](spark, SMALL)
    if name in oracle_sql():
        assert compare(df, connect(SMALL), oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_read_back_digest(spark):
    turns = spark.createDataFrame([(4, 0, "user", "a"), (4, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    formatted = chat_parts.format_conversations(turns.withColumn("parts", chat_parts.text_part(F.col("text"))))
    said = "".join(f"{t.role}\n{t.text}\n" for t in chat_parts.read_back(formatted).collect()[0].turns)
    assert hashlib.sha256(said.encode()).hexdigest() == hashlib.sha256(b"user\na\nassistant\n\n").hexdigest()
