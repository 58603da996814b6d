"""Merkle manifest, importance resampling and WARC archives against plain readings."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import lowered, rows, table
from pyspark.sql import functions as F

from candlewick.llm import importance_bits, merkle_manifest, warc
from candlewick.llm.positions import numbered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LEAF = "tree string, key long, leaf string"


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def brute_manifest(leaves, fanout):
    def levels(below):
        out = [below]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
        return out

    def path(grown, i):
        steps = []
        for level in grown[:-1]:
            first = i // fanout * fanout
            steps.append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
            i //= fanout
        return steps

    trees = defaultdict(list)
    for tree, key, leaf in leaves:
        trees[tree].append((key is not None, key or 0, leaf))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    grown = {t: levels([leaf for *_, leaf in sorted(trees[t])]) for t in names}
    top = levels([grown[t][-1][0] for t in names])
    return [
        (t, key if known else None, leaf, grown[t][-1][0], top[-1][0], tuple(path(grown[t], i) + path(top, n)))
        for n, t in enumerate(names) for i, (known, key, leaf) in enumerate(sorted(trees[t]))
    ]


@pytest.mark.parametrize("fanout,block_levels", [(2, 8), (2, 2), (3, 1)])
def test_manifest(spark, fanout, block_levels):
    rng = random.Random(fanout)
    leaves = [(rng.choice(["en"] * 9 + ["de", "é", None, ""]), rng.choice([None, *range(90)]), sha(str(i))) for i in range(150)]
    leaves += [("one", 1, sha("x")), *[leaves[5]] * 7]
    df = spark.createDataFrame(leaves, LEAF).withColumn("path", F.lit("mine")).withColumn("n", F.lit(1))
    got = merkle_manifest.manifest(df, fanout=fanout, block_levels=block_levels)
    assert got.columns == ["tree", "key", "leaf", "n", "subroot", "root", "path"]
    found = got.withColumn("folded", merkle_manifest.fold(F.col("leaf"), F.col("path"))).collect()
    assert all(r.folded == r.root for r in found)
    seen = [(r.tree, r.key, r.leaf, r.subroot, r.root, tuple(tuple(s) for s in r.path)) for r in found]
    assert sorted(seen, key=str) == sorted(brute_manifest(leaves, fanout), key=str)


def test_manifest_of_nothing_and_of_one_row(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], LEAF)).count() == 0
    one = merkle_manifest.manifest(spark.createDataFrame([(None, None, sha("x"))], LEAF)).first()
    assert one.root == one.subroot == one.leaf == sha("x") and one.path == []


def test_leaf_digests(spark):
    got = spark.createDataFrame([(None, "é", ""), (12, None, "a:b")], "a long, b string, c string")
    seen = [r[0] for r in got.select(merkle_manifest.leaf_digest(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert seen == [sha("-2:é0:"), sha("2:12-3:a:b")]


def test_positions(spark):
    made = [(random.Random(i).choice([None, "a", "b"]), i % 5) for i in range(60)] + [("a", 2)] * 9000
    got = numbered(spark.createDataFrame(made, "g string, v long"), [F.col("v").desc()], ["g"]).collect()
    for g in (None, "a", "b"):
        own = sorted((r.position, r.v) for r in got if r.g == g)
        assert [p for p, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted((v for x, v in made if x == g), reverse=True)
        assert {r.position_total for r in got if r.g == g} == {len(own)}
    assert len(got) == len(made)


def features(text, grams):
    words = WORD.findall(lowered(text))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("grams", [1, 2])
def test_importance(spark, grams):
    made, target = rows(), ["alpha beta Gamma", None, "größer straße", "alpha"]
    counted = [features(t, grams) for _, t, *_ in made]
    s, t = Counter(b for _, f in counted for b in f), Counter(b for x in target for b in features(x, grams)[1])
    whole, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (whole + 10_000) / ((s[b] + 1) * (wanted + 10_000)))) for b in s}
    want = []
    for (doc, *_), (n, own) in zip(made, counted):
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
        want.append((n, doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-score, doc) for n, doc, _, _, score in want if n >= 20)
    drawn = [(doc, -score) for score, doc in able[: len(able) * 30 // 100]]
    df = table(spark, extra=True).withColumn("rank", F.lit("mine")).withColumn("key", F.lit("mine"))
    got = importance_bits.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), grams=grams, percent=30).collect()
    assert sorted((r.n_words, r.doc_id, r.n_features, r.weight, r.score) for r in got) == sorted(want)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1)) and len(drawn) > 2


def test_importance_of_nothing(spark):
    texts = spark.createDataFrame([], "text string")
    assert importance_bits.resample(table(spark, []), texts).count() == 0
    nulls = importance_bits.resample(spark.createDataFrame([(None, None)] * 2, "doc_id long, text string"), texts).collect()
    assert [(r.doc_id, r.n_features, r.weight, r["rank"]) for r in nulls] == [(None, 0, 0, None)] * 2


@pytest.mark.parametrize("piece", [4, 7, 1 << 20])
def test_words_by_pieces(monkeypatch, piece):
    monkeypatch.setattr(importance_bits, "PIECE_BYTES", piece)
    rng = random.Random(piece)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", " ", "é", "9", "_", "{", "`", "@", "\x85", "\xa0", "漢", "zz", "\n", "-"]) for _ in range(rng.randint(0, 60)))
        assert [w for p in importance_bits.pieces(text.encode()) for w in p] == [w.encode() for w in WORD.findall(lowered(text))]
        for grams in (1, 3):
            n, own = features(text, grams)
            parts = list(importance_bits.text_buckets(text.encode(), grams))
            assert (sum(k for k, _ in parts), sorted(b for _, p in parts for b in p.tolist())) == (n, sorted(own))


def test_bit_planes_sum_exactly():
    rng = np.random.default_rng(1)
    for size in (10_000, 130, 64, 1):
        model = importance_bits.Gains(rng.integers(-9000, 9000, size))
        counts = rng.integers(0, 9, size) * (rng.random(size) < 0.1)
        counts[0] = 10**9
        assert model.total(counts) == sum(a * b for a, b in zip(model.values.tolist(), counts.tolist()))


PAGES = [
    (1, "http://a", "x"), (2, None, "x"), (3, "u\r\nWARC-Type: forged", "y\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (4, "é", "größ" * 50_000), (5, "", None),
    (6, "u", ""), (7, "u", "x"), (7, "u", "x"), (None, "u", "x"), (None, "q", "only"),
]


@pytest.mark.parametrize("gzipped", [False, True])
@pytest.mark.parametrize("least", [0, 2])
def test_archive(spark, gzipped, least, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 3)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("keeper", F.lit("mine"))
    folder = warc.fresh_folder(spark)
    warc.archive(spark, pages, folder, least_bytes=least, gzip=gzipped)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived_pages(spark, folder).collect()), key=str)
    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "")]
        keeper = max((p for p in same if p is not None), default=None)
        revisit = len(raw) >= least and keeper != page
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    assert got == sorted(want, key=str)
    uris = {r.page_id: r.target_uri for r in warc.archived_pages(spark, folder).collect()}
    assert uris[3] == "u%0D%0AWARC-Type: forged" and uris[4] == "é" and uris[2] is None
    assert spark.read.format("warc").load(folder).count() == len(PAGES)


def test_pushed_predicates_skip_blocks(spark):
    warc.register(spark)
    folder = warc.fresh_folder(spark)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.archive(spark, pages, folder)
    revisits = spark.read.format("warc").load(folder).filter("record_type = 'revisit' and target_uri in ('u', 'http://a')")
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert revisits.count() == 2

    class Counting:
        def __init__(self, raw):
            self.raw, self.at, self.read_bytes = raw, 0, 0

        def read(self, n):
            out = self.raw[self.at : self.at + n]
            self.at, self.read_bytes = self.at + len(out), self.read_bytes + len(out)
            return out

        def tell(self):
            return self.at

        def seek(self, at):
            self.at = at

    large = warc.record({"WARC-Type": "response"}, b"z" * 5_000_000) + warc.record({"WARC-Type": "revisit"}, b"")
    source = Counting(large)
    found = list(warc.read_records(warc.Plain(source), lambda r: r["record_type"] == "revisit", True))
    assert len(found) == 1 and source.read_bytes < 200_000


def test_foreign_and_damaged_archives(spark, tmp_path):
    warc.register(spark)
    raw = b"WARC/1.0\r\nwarc-type: response\r\nX-Note: one\r\n two\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(raw) + gzip.compress(raw))
    (tmp_path / "b.warc").write_bytes(raw)
    (tmp_path / "c.txt").write_bytes(b"not one")
    got = spark.read.format("warc").load(str(tmp_path)).collect()
    assert [(r.record_type, bytes(r.block), r.extra) for r in got] == [("response", b"abc", {"X-Note": "one two"})] * 3
    assert spark.read.format("warc").option("partitionBytes", 1).load(str(tmp_path)).rdd.getNumPartitions() == 2
    assert spark.read.format("warc").load(str(tmp_path)).rdd.getNumPartitions() == 1
    (tmp_path / "d.warc").write_bytes(raw[:-6])
    with pytest.raises(Exception, match="d.warc"):
        spark.read.format("warc").load(str(tmp_path)).collect()


def test_empty_archive(spark):
    folder = warc.fresh_folder(spark)
    warc.archive(spark, spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.archived_pages(spark, folder).count() == 0
