"""The text of pages against its SQL, on pages that end anywhere and references without semicolons."""

import random

import duckdb

from __spark_entry__ import oracle_sql, queries
from tests.compare import compare

ODD = [
    "<p>en.&&&amp</p><p>a &am</p>&", "&ampx &copysr; &copysr &quot&QUOT;&middot&notit;&notin;&hellip;&hellip", "&amp;quot; &amp;amp;lt; &ltt;",
    "&#65;&#x41;&#X41&#128;&#129;&#0;&#xD800;&#1114112;&#99999999999999999999999;&#xFFFFFFFFFFFFFFFFFFFFFF;&#;&#x;&#xg &#12a", "&nbsp;x&nbsp;<b>&nbsp;</b>",
    "a<script>b", "a<SCRIPT x>b</script ><style>c</STYLE\x0b>d<style>e", "a<!--b", "a<!-- <p> -->b<!--->c-->d", "<style><script></style>a</script>b",
    "<a title='>x>\"'>in</a><a title=\"y>out", "< p>1 <3 <!doctype x><?xml y?></p q>z<b", "<p>\x01 \x1c\x85a b　 </p>", "", None,
]


def test_odd_pages_match_their_sql(spark, tmp_path):
    rng, parts = random.Random(3), ["<", ">", "&", "amp", "quot;", ";", "#", "x41", "6", "<p>", "</p>", "<!--", "-->", "<script>", "</script>", "<style", "'", '"', " ", "é", "copy", "notin"]
    pages = ODD + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(1500)]
    spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "page_id bigint, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert compare(queries()["s7_html_to_text"](spark, str(tmp_path)), con, oracle_sql()["s7_html_to_text"]) is None
