"""Text, files, candles, proposals and retrieval on small fixtures."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.functions import text as tx, times
from candlewick.operators import corpus, proposals, retrieval
from candlewick.sources import candles, files, sections, tables


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def loop_chunks(text, size, overlap):
    w = text.split()
    if not w:
        return []
    if len(w) <= size:
        return [" ".join(w)]
    out, s, step = [], 0, max(1, size - overlap)
    while True:
        out.append(" ".join(w[s : s + size]))
        if s + size >= len(w):
            return out
        s += step


def loop_split(chunks, limit):
    out = []
    for c in chunks:
        if len(c) <= limit:
            out.append(c)
            continue
        cur = ""
        for w in c.split():
            if cur and len(cur) + 1 + len(w) > limit:
                out.append(cur)
                cur = w
            else:
                cur = f"{cur} {w}" if cur else w
        out.append(cur)
    return out


TEXTS = ["", "  \n", "one", "a b c\x1cd", "x" * 60 + " y z", "y " + "x" * 60 + " z", " ".join(f"w{i}é" for i in range(100)), "ab " * 10 + "c" * 31 + " d"]


@pytest.mark.parametrize("size, overlap", [(500, 50), (7, 2), (5, 5), (3, 9), (10, 0)])
def test_chunks_match_a_loop(spark, size, overlap):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(
        "t", corpus.word_chunks(F.col("t"), size, overlap).alias("c"), corpus.text_pieces(F.col("t"), size, overlap, 30).alias("p"),
        corpus.split_long(F.array("t"), 30).alias("s"),
    ).collect()
    for r in rows:
        assert r["c"] == loop_chunks(r["t"], size, overlap)
        assert r["p"] == loop_split(r["c"], 30)
        if len(r["t"]) > 30:
            assert r["s"] == [p for p in loop_split([r["t"]], 30) if p]


def test_prefix_and_ids(spark):
    prefix = tx.context_prefix(F.lit("s"), F.lit(None).cast("string"), F.lit("fx"), F.lit("a,b"))
    assert one(spark, prefix) == "[s | fx | topics: a,b]"
    assert one(spark, tx.figure_id(F.lit("s"), F.lit(7), F.lit(2))) == "s::fig::p0007::2"
    assert one(spark, tx.slug(F.lit("Ünï Code!! x"))) == "ünï_code_x"
    assert one(spark, tx.slug(F.lit("!!!"))) == "document"


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a &amp; b</p><script>x</script><!-- c --><b> d </b>", "a & b\nd"),
        ("x &#233;&#x20AC; &eacute; &bogus; &", "x é€ é &bogus; &"),
        ("<style>p{}</style>&amp;lt;", "&lt;"),
        ("a < b", "a < b"),
    ],
)
def test_html(spark, html, want):
    assert one(spark, tx.html_to_text(F.lit(html))) == want


def test_images_in_sections(spark):
    html = '<div><p>near <img src="../img/a.png#x"> text</p><img src="http://h/x.png"><img src="b%20c.png"></div><img src="../img/a.png">'
    rows = spark.createDataFrame([("s", 1, "text/ch1.html", html)], "source string, chapter int, name string, html string")
    got = [(r["place"], r["path"], r["nearby"]) for r in sections.image_references(rows).orderBy("place").collect()]
    assert got == [(0, "img/a.png", "near text"), (2, "text/b c.png", "near text"), (3, "img/a.png", "")]


def png(width, height):
    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\x00" + b"\x00" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_files(spark, tmp_path):
    (tmp_path / "big.png").write_bytes(png(160, 150))
    (tmp_path / "small.png").write_bytes(png(149, 400))
    assert [r["width"] for r in files.read_images(spark, str(tmp_path / "*.png")).collect()] == [160]
    (tmp_path / "u.txt").write_bytes("é".encode())
    (tmp_path / "l.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "blank.txt").write_bytes(b"  ")
    assert [r["text"] for r in files.read_text_files(spark, str(tmp_path / "*.txt")).collect()] == ["é", "é"]


def test_upsert_keeps_stale_tails(spark):
    old = spark.createDataFrame([("s::0", "a"), ("s::1", "b")], "id string, text string")
    new = spark.createDataFrame([("s::0", "c", 1)], "id string, text string, page int")
    assert {tuple(r) for r in tables.upsert(old, new).collect()} == {("s::0", "c", 1), ("s::1", "b", None)}


def test_candle_payload(spark):
    payload = '{"candles":[{"time":"2024-01-02T00:00:00.000000000Z","complete":false,"mid":{"o":"1","h":"2","l":"0.5","c":"1.5"}},{"time":"x","bid":{"o":"3","h":"3","l":"3","c":"3"}},{"time":"y"}]}'
    rows = candles.parse_payloads(spark.createDataFrame([("E", payload)], "i string, p string"), "p", ["i"]).collect()
    assert [(r["close"], r["complete"], r["ts"] is None) for r in rows] == [(1.5, False, False), (3.0, True, True)]


def test_window_arguments(spark):
    bars = spark.createDataFrame([("a", None)], "k string, ts timestamp")
    with pytest.raises(ValueError):
        candles.select_bars(bars, ["k"], F.current_timestamp(), F.current_timestamp(), 5)
    with pytest.raises(ValueError):
        candles.select_bars(bars, ["k"], count=0)


def test_untimed_rows_are_kept(spark):
    rows = spark.createDataFrame([("a", "t", 1), ("a", "t", 2), ("a", None, 3), ("a", None, 4), ("a", "", 5)], "k string, time string, n int")
    assert sorted(r["n"] for r in candles.first_per_time(rows, ["k"], "time", ["n"]).collect()) == [1, 3, 4, 5]


@pytest.mark.parametrize("text, seconds", [("2024-01-01T00:00:00.123456789Z", 1704067200), ("2024-01-01T02:00:00+02:00", 1704067200), ("junk", None), ("", None)])
def test_rfc3339(spark, text, seconds):
    assert one(spark, times.parse_seconds(F.lit(text))) == seconds


@pytest.mark.parametrize(
    "answer, want",
    [
        ('{"confidence":"high","side":"BUY","notes":["a",1]}', ("join_trend", "long", 0.8, "a; 1", "model omitted thesis")),
        ('<think>{</think>```json\n{"play_class":"fade_range","confidence":7,"thesis":"t"}\n```', ("fade_range", "none", 1.0, "", "t")),
        ('text {"confidence":"45%","thesis":null} tail', ("join_trend", "none", 0.45, "", "model omitted thesis")),
        ('{"confidence":true,"side":"short"}', ("join_trend", "short", 1.0, "", "model omitted thesis")),
        ('{"confidence":"??","side":""}', ("join_trend", "none", 0.0, "", "model omitted thesis")),
    ],
)
def test_proposals(spark, answer, want):
    rows = spark.createDataFrame([(answer, ["", "join_trend"])], "a string, allowed array<string>")
    p = proposals.parse_proposals(rows, "a", "allowed")[0].select("proposal.*").first()
    assert (p["play_class"], p["side"], p["confidence"], p["notes"], p["thesis"]) == want


@pytest.mark.parametrize("answer, reason", [("nothing", "not a JSON"), ('{"side":"up"}', "side"), ('{"play_class":"zzz"}', "play_class"), ('{"entry":"abc"}', "entry")])
def test_bad_proposals(spark, answer, reason):
    rows = spark.createDataFrame([(answer, ["join_trend"])], "a string, allowed array<string>")
    assert reason in proposals.parse_proposals(rows, "a", "allowed")[1].first()["reason"]


def test_top_k_in_several_blocks_with_ties(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 6))
    rows = [(i, [float(x) for x in base[i % 40]]) for i in range(120)]
    vectors = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(q, [float(x) for x in base[q]]) for q in range(9)], "query_id bigint, embedding array<double>")
    vectors = vectors.union(spark.createDataFrame([(500, [1.0] * 4), (501, None)], vectors.schema))
    got = retrieval.cosine_top_k(queries, vectors, 3, query_blocks=2, vector_blocks=3).orderBy("query_id", "rank").collect()
    assert sorted(r["id"] for r in retrieval.dimension_rejects(queries, vectors).collect()) == [500, 501]
    assert [r["id"] for r in got] == [i for q in range(9) for i in (q, q + 40, q + 80)]


@pytest.mark.parametrize(
    "html, want",
    [
        ('<a title="a>b">x</a>', "x"), ("<a title='1>0'>y</a>", "y"), ('<b x="never closed>z</b>', "z"), ("&copy y &notit;", "© y ¬it;"), ("&#150;&#x80;", "–€"),
        ("&#0;&#55555555;", "��"), ("a<script>var x = '<b>'", "a"), ("a<style>p {}", "a"), ("a<!-- b", "a"), ("&amp;lt;", "&lt;"), ("AT&T", "AT&T"),
    ],
)
def test_html_shapes(spark, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(tx.html_to_text(F.col("h"))).first()[0] == want


@pytest.mark.parametrize(
    "answer, want",
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}'), ('```python\nq\n``` and ```json{"b": 2}```', '{"b": 2}'), ('so {"c": {"d": 3}} it is', '{"c": {"d": 3}}'),
        ('```{"open": 1}', '{"open": 1}'), ("none", None), ("} {", None), ('<think>{"x": 1}</think>{"y": 2}', '{"y": 2}'),
    ],
)
def test_json_objects(spark, answer, want):
    assert spark.createDataFrame([(answer,)], "a string").select(tx.json_object(F.col("a"))).first()[0] == want


def test_last_row_of_a_repeated_id(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "id string, n int, text string")
    old = spark.createDataFrame([("b", 0, "old"), ("c", 0, "kept")], rows.schema)
    assert {tuple(r) for r in tables.upsert(old, rows, order=["n"]).collect()} == {("a", 3, "z"), ("b", 1, "q"), ("c", 0, "kept")}


def test_blank_files_are_dropped(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n \t\n")
    (tmp_path / "b.txt").write_text(" x\n")
    assert [r["text"] for r in files.read_text_files(spark, str(tmp_path)).collect()] == [" x\n"]


def test_shapes_of_times(spark):
    shapes = ["2024-01-15T14:00:00Z", "2024-01-15T14:00:00.5+02:00", "2024-01-15T14:00:00", "2024-01-15 14:00:00", "2024-01-15T14:00:00.", "2024-01-15T14:00:00+2:00", ""]
    got = spark.createDataFrame([(s,) for s in shapes], "t string").select(times.well_formed(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, True, False, False, False, False]
    pairs = [("2024-01-01T00:00:00Z", "2024-01-01T01:00:00+01:00", 0), ("b", "a", 1), ("", "a", 0), (None, "a", 0), ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00.1Z", -1)]
    found = spark.createDataFrame(pairs, "a string, b string, w int").select(times.compare_instants(F.col("a"), F.col("b")), "w").collect()
    assert all(r[0] == r["w"] for r in found)
