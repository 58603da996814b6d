"""Documents, chunks, retrieval and model answers."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from candlewick.functions import text as tx
from candlewick.operators import corpus, proposals, retrieval
from candlewick.operators.patterns import analysis_windows, formation
from candlewick.operators.series import tiles
from candlewick.operators.vector_blocks import VectorBlocks
from candlewick.plans.catalog.analytics import STRIDE, TILE, TILES, _FORMATIONS, _tiled_sql
from candlewick.plans.catalog.inputs import hourly, hourly_labels, out, outer, table
from candlewick.plans.registry import query
from candlewick.session import fresh_path
from candlewick.sources import files, manifest, sections, tables
from candlewick.sources.bucketed import BucketedTable

# The whitespace set of the text pipeline, spelled for RE2.
_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TOKENS = f"list_filter(regexp_split_to_array(text, '{_WS}'), lambda w: w <> '')"


def _documents(spark, sf):
    """Documents as ingest input: one source per document, metadata from its columns."""
    docs = table(spark, sf, "documents")
    return docs.select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source"),
        "text",
        F.concat(F.lit(" doc "), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("source")).alias("author"),
        F.when(F.col("lang") == "en", "fx").when(F.col("lang") == "de", "general").when(F.col("lang") == "fr", "bonds").alias("asset_class"),
        F.col("lang").alias("topics"),
        F.lit("principle").alias("evidence_level"),
    )


_DOCS = f"""
    docs AS MATERIALIZED (SELECT source || '/' || doc_id AS src, doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS author,
        CASE lang WHEN 'en' THEN 'fx' WHEN 'de' THEN 'general' END AS asset_class, {_TOKENS} AS t FROM documents WHERE lang <> 'fr')"""


def _chunk_sql(size: int, overlap: int) -> str:
    step = max(1, size - overlap)
    return f"""
    wc AS MATERIALIZED (SELECT src, lang, author, asset_class, s // {step} AS k, t[s + 1 : s + {size}] AS w, array_to_string(t[s + 1 : s + {size}], ' ') AS c
        FROM (SELECT *, unnest(range(0, greatest(len(t) - {size}, 0) + {step}, {step})) AS s FROM docs WHERE len(t) > 0)
        WHERE s = 0 OR s - {step} + {size} < len(t))"""


@query("t1_word_chunks", f"""WITH {_DOCS.replace("WHERE lang <> 'fr'", '')}, {_chunk_sql(500, 50)}
    SELECT src AS source, k AS chunk_index, md5(c) AS digest, length(c) AS chars FROM wc""")
def word_chunks(spark, sf):
    docs = _documents(spark, sf)
    rows = docs.select("source", F.posexplode(corpus.word_chunks(F.col("text"))).alias("chunk_index", "c"))
    return out(rows.select("source", "chunk_index", F.md5("c").alias("digest"), F.length("c").alias("chars")))


_PACKED = """
    pk AS MATERIALIZED (SELECT src, lang, author, asset_class, k, unnest(parts) AS c, generate_subscripts(parts, 1) AS j FROM (
        SELECT *, CASE WHEN length(c) <= 1800 THEN [c] ELSE string_split(list_reduce(w,
            lambda a, x: CASE WHEN length(split_part(a, chr(1), -1)) + 1 + length(x) > 1800 THEN a || chr(1) || x ELSE a || ' ' || x END), chr(1)) END AS parts FROM wc)),
    ch AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src ORDER BY k, j) - 1 AS chunk_index,
        '[' || src || coalesce(' | ' || author, '') || coalesce(' | ' || asset_class, '') || ' | topics: ' || lang || ']' || chr(10) || c AS text FROM pk)"""


@query("t2_t3_t5_t6_ingested_chunks", f"""WITH {_DOCS}, {_chunk_sql(500, 50)}, {_PACKED}
    SELECT src || '::' || chunk_index AS id, src AS source, chunk_index, asset_class, md5(text) AS digest, length(text) AS chars FROM ch""")
def ingested_chunks(spark, sf):
    chunks, _ = corpus.ingest_documents(_documents(spark, sf))
    return out(chunks.select("id", "source", "chunk_index", "asset_class", F.md5("text").alias("digest"), F.length("text").alias("chars")))


@query("t1_t2_small_chunks", f"""WITH {_DOCS}, {_chunk_sql(40, 8)} SELECT src AS source, k AS chunk_index, md5(c) AS digest FROM wc""")
def small_chunks(spark, sf):
    good, _ = corpus.validate_documents(_documents(spark, sf))
    rows = good.select("source", F.posexplode(corpus.word_chunks(F.col("text"), 40, 8)).alias("chunk_index", "c"))
    return out(rows.select("source", "chunk_index", F.md5("c").alias("digest")))


@query("f8_metadata_rejects", "SELECT source || '/' || doc_id AS source, 'Invalid asset_class: bonds' AS reason FROM documents WHERE lang = 'fr'")
def metadata_rejects(spark, sf):
    return out(corpus.validate_documents(_documents(spark, sf))[1], "source", "reason")


@query("f8_unknown_keys", """SELECT lang, CASE WHEN lang = 'en' THEN 'Unknown metadata keys: [''isbn'', ''year'']' END AS reason, count(*) AS n FROM documents GROUP BY 1, 2""")
def unknown_keys(spark, sf):
    meta = F.when(F.col("lang") == "en", F.create_map(F.lit("year"), F.lit("1"), F.lit("title"), F.lit("x"), F.lit("isbn"), F.lit("2"))).otherwise(
        F.create_map(F.lit("author"), F.col("source"))
    )
    rows = table(spark, sf, "documents").select("lang", corpus.unknown_keys(meta).alias("reason"))
    return out(rows.groupBy("lang", "reason").agg(F.count("*").alias("n")))


def _chunks(spark, sf):
    return corpus.ingest_documents(_documents(spark, sf))[0]


_TWO_INGESTS = f"""{_DOCS}, {_chunk_sql(500, 50)}, {_PACKED.replace('ch AS', 'ch0 AS')},
    old AS (SELECT src || '::' || chunk_index AS id, 1 AS v, md5(text) AS digest FROM ch0), nw AS (SELECT id, 2 AS v, md5('again' || chr(10) || text) AS digest FROM (
        SELECT src || '::' || chunk_index AS id, chunk_index, text, count(*) OVER (PARTITION BY src) AS n FROM ch0) WHERE chunk_index < (n + 1) // 2),
    latest AS (SELECT id, v::BIGINT AS version, digest FROM nw UNION ALL SELECT id, v, digest FROM old WHERE id NOT IN (SELECT id FROM nw))"""


def _two_ingests(spark, sf):
    first = _chunks(spark, sf).select("id", "source", "chunk_index", "text")
    sizes = first.groupBy("source").agg(F.count("*").alias("n"))
    half = first.join(sizes, "source").filter(F.col("chunk_index") < F.floor((F.col("n") + 1) / 2))
    return first, half.select("id", "source", "chunk_index", tx.prefixed(F.col("text"), F.lit("again")).alias("text"))


@query("s11_upserted_chunks", f"WITH {_TWO_INGESTS} SELECT id, version, digest FROM latest")
def upserted_chunks(spark, sf):
    """A second ingest with new texts and half of every document's chunks: tail chunks of the first stay."""
    root = fresh_path(spark, "chunks")
    first, second = _two_ingests(spark, sf)
    tables.upsert_version(first, root, 1)
    tables.upsert_version(second, root, 2)
    latest = tables.latest_rows(spark, root)
    return out(latest.select("id", F.col(tables.VERSION).alias("version"), F.md5("text").alias("digest")))


def _bucketed_chunks(spark, sf):
    stored = BucketedTable(spark, fresh_path(spark, "buckets"), buckets=16)
    first, second = _two_ingests(spark, sf)
    stored.upsert(first, 1)
    twice = F.explode(F.array(F.lit(1), F.lit(2)))
    stored.upsert(second.withColumn("copy", twice).drop("copy"), 2)
    stored.upsert(first, 2)  # applied before: nothing happens
    return stored


@query("s11_bucketed_chunks", f"WITH {_TWO_INGESTS} SELECT id, version, digest FROM latest")
def bucketed_chunks(spark, sf):
    """The same two ingests into hash buckets, the second with every row twice and then repeated."""
    return out(_bucketed_chunks(spark, sf).rows().select("id", F.col(tables.VERSION).alias("version"), F.md5("text").alias("digest")))


@query("s11_bucket_lookup", f"WITH {_TWO_INGESTS} SELECT id, version, digest FROM latest WHERE id IN (SELECT source || '/' || doc_id || '::1' FROM documents WHERE lang = 'es')")
def bucket_lookup(spark, sf):
    """The second chunk of every document in one language, by id: only buckets that can hold one are read."""
    wanted = table(spark, sf, "documents").filter(F.col("lang") == "es")
    ids = wanted.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("::1")).alias("id"))
    return out(_bucketed_chunks(spark, sf).rows_for(ids).select("id", F.col(tables.VERSION).alias("version"), F.md5("text").alias("digest")))


def _letters(text):
    """A vector that SQL can make too: length, and how often three letters stand in the text."""
    return F.transform(F.array(F.lit(""), F.lit("e"), F.lit("n"), F.lit("s")), lambda x: (F.length(text) - F.length(F.replace(text, x, F.lit("")))).cast("double") + F.when(x == "", F.length(text)).otherwise(0))


@query("t6_ingested_vectors", f"""WITH {_DOCS}, {_chunk_sql(500, 50)}, {_PACKED},
    every AS (SELECT src || '::' || chunk_index AS id, src, text FROM ch),
    first AS (SELECT md5(text) AS digest FROM every WHERE src IN (SELECT src FROM docs WHERE doc_id % 2 = 0))
    SELECT id, [length(text), length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, 'n', '')), length(text) - length(replace(text, 's', ''))]::DOUBLE[] AS embedding,
        CASE WHEN md5(text) IN (SELECT digest FROM first) THEN 1 ELSE 2 END::BIGINT AS version FROM every""")
def ingested_vectors(spark, sf):
    """Half of the documents, then all of them: a text gets its vector in the ingest that saw it first."""
    vectors = BucketedTable(spark, fresh_path(spark, "vectors"), "digest", buckets=16)
    docs = _documents(spark, sf)
    even = F.element_at(F.split("title", " "), -1).cast("long") % 2 == 0
    corpus.ingest_documents(docs.filter(even), _letters, vectors)
    chunks, _ = corpus.ingest_documents(docs, _letters, vectors)
    made = vectors.rows().select("digest", F.col(tables.VERSION).alias("version"))
    return out(chunks.join(made, "digest").select("id", "embedding", "version"))


@query("s11_repeated_ids", "SELECT source AS id, max(doc_id)::BIGINT AS doc_id, count(*)::BIGINT AS rows FROM documents GROUP BY source")
def repeated_ids(spark, sf):
    """Documents under their source's name: the last of each replaces what was stored."""
    batch = table(spark, sf, "documents").select(F.col("source").alias("id"), "doc_id", "text")
    stored = tables.upsert(batch.limit(0), batch, order=["doc_id"])
    counts = batch.groupBy("id").agg(F.count("*").alias("rows"))
    return out(stored.join(counts, "id"), "id", "doc_id", "rows")


@query("s8_assembled_documents", """SELECT 'conv/' || conv_id AS source, md5(string_agg(txt, chr(10) || chr(10) ORDER BY pos)) AS digest FROM (
    SELECT conv_id, min(turn) AS pos, arg_min(text, turn) AS txt FROM conversations GROUP BY conv_id, turn // 2) WHERE txt <> '' GROUP BY conv_id""")
def assembled_documents(spark, sf):
    """One document per conversation; every second turn repeats a section id."""
    turns = table(spark, sf, "conversations").select(
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("source"),
        F.col("turn").alias("pos"),
        F.floor(F.col("turn") / 2).cast("string").alias("section_id"),
        "text",
    )
    return out(sections.assemble_documents(turns).select("source", F.md5("text").alias("digest")))


def _text_map(pairs) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{quoted(k) if isinstance(k, str) else k}: {quoted(v)}" for k, v in pairs) + "}"


def _tag(name: str) -> str:
    """A name in letters of either case; no others fold to it."""
    return "".join(f"[{c}{c.upper()}]" for c in name)


# What follows an ampersand, decoded: a numeric reference, a name with its semicolon, or the longest old name without one.
_REFERENCE = rf"""CASE
    WHEN regexp_matches(p, '^#([0-9]|[xX][0-9a-fA-F])') THEN list_transform([regexp_extract(p, '^#([0-9]+|[xX][0-9a-fA-F]+);?')], lambda number:
        list_transform([try_cast(regexp_replace(replace(number[2:], ';', ''), '^[xX]', '0x') AS BIGINT)], lambda code:
            coalesce({_text_map((c, bytes([c]).decode("cp1252", "ignore")) for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore"))}[code],
                CASE WHEN code BETWEEN 1 AND 55295 OR code BETWEEN 57344 AND 1114111 THEN chr(code::INT) ELSE chr(65533) END))[1]
        || substr(p, length(number) + 1))[1]
    ELSE list_transform([CASE WHEN NAMES[regexp_extract(p, '^(\w+;)', 1)] IS NOT NULL THEN regexp_extract(p, '^(\w+;)', 1)
            ELSE regexp_extract(p, '^({"|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))})', 1) END], lambda name:
        CASE WHEN name <> '' THEN NAMES[name] || substr(p, length(name) + 1) ELSE '&' || p END)[1] END""".replace("NAMES", _text_map(html5.items()))


@query("s7_html_to_text", rf"""
    SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(
        html, '<{_tag("script")}(?:[\t\n\f\r /][^>]*)?>.*?(?:</{_tag("script")}[\s\x0B]*>|\z)|<{_tag("style")}(?:[\t\n\f\r /][^>]*)?>.*?(?:</{_tag("style")}[\s\x0B]*>|\z)', chr(1), 'gs'),
        '<!--.*?(?:-->|\z)', chr(1), 'gs'), '<[/!?]?[A-Za-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[/!?]?[A-Za-z][^>]*>', chr(1), 'g'), chr(1)),
        lambda x: regexp_replace(regexp_replace(array_to_string(list_transform(string_split(x, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {_REFERENCE} END), ''),
            '^WS', ''), 'WS$', '')), lambda x: x <> ''), chr(10))) AS digest FROM pages""".replace("WS", _WS))
def html_text(spark, sf):
    rows = sections.sections_text(table(spark, sf, "pages").select("page_id", "html"))
    return out(rows.select("page_id", F.md5("text").alias("digest")))


def _illustrated(spark, sf):
    """Pages whose links became images, as sections of one document per hundred pages."""
    pages = table(spark, sf, "pages")
    return pages.select(
        F.concat(F.lit("book"), F.floor(F.col("page_id") / 100).cast("string")).alias("source"),
        (F.col("page_id") % 100 + 1).alias("chapter"),
        F.concat(F.lit("text/ch"), (F.col("page_id") % 100).cast("string"), F.lit(".html")).alias("name"),
        F.regexp_replace("html", '<a href="/([^"]*)">', '<img src="../img/$1.png#f">').alias("html"),
    )


_IMAGES = r"""
    refs AS MATERIALIZED (SELECT 'book' || (page_id // 100) AS source, page_id % 100 + 1 AS chapter, unnest(regexp_extract_all(html, '<a href="/([^"]*)">', 1)) AS stem,
        generate_subscripts(regexp_extract_all(html, '<a href="/([^"]*)">', 1), 1) - 1 AS place FROM pages)"""


@query("s15_image_references", f"""WITH {_IMAGES} SELECT source, chapter, place, 'img/' || stem || '.png' AS path, '' AS nearby FROM refs""")
def image_references(spark, sf):
    found = sections.image_references(_illustrated(spark, sf))
    return out(found, "source", "chapter", "place", "path", "nearby")


@query("s13_s15_document_figures", f"""WITH {_IMAGES}
    SELECT source, 'img/' || stem || '.png' AS path, chapter AS page, row_number() OVER (PARTITION BY source ORDER BY chapter, place) - 1 AS figure_index FROM (
        SELECT source, stem, min(chapter) AS chapter, arg_min(place, chapter * 1000000 + place) AS place FROM refs WHERE length(stem) >= 3 GROUP BY 1, 2)""")
def document_figures(spark, sf):
    """Image sizes follow from the name: names under three letters are too small to be figures."""
    found = sections.image_references(_illustrated(spark, sf)).persist()
    stem = F.regexp_extract("path", r"^img/(.*)\.png$", 1)
    images = found.select("source", "path").distinct().select(
        "source", "path", F.length(stem).cast("bigint").alias("item"), (F.length(stem) * 50).alias("width"), F.lit(400).alias("height")
    )
    return out(sections.document_figures(found, images), "source", "path", "page", "figure_index")


@query("s16_page_figures", """
    SELECT page_id AS page, figure_index, whole_page FROM (
        SELECT page_id, 0 AS figure_index, false AS whole_page FROM pages WHERE page_id % 3 = 0
        UNION ALL SELECT page_id, 0, true FROM pages WHERE page_id % 3 <> 0 AND length(url) < 40 AND page_id % 2 = 0)""")
def page_figures(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.lit("scan").alias("source"), F.col("page_id").alias("page"), F.lpad("url", 200, ".").alias("padded"), "url", (F.col("page_id") % 2 == 0).alias("ocr_used")
    ).withColumn("text", F.when(F.length("url") < 40, F.col("url")).otherwise(F.col("padded")))
    embedded = pages.select("source", "page", F.lit(0).alias("figure_index"), F.when(F.col("page") % 3 == 0, 150).otherwise(149).alias("width"), F.lit(150).alias("height"))
    return out(files.page_figures(pages, embedded), "page", "figure_index", "whole_page")


@query("s6_scanned_files", "SELECT source, md5(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS digest FROM documents GROUP BY source")
def scanned_files(spark, sf):
    """One text file per source, written by Spark and scanned as bytes."""
    root = fresh_path(spark, "files")
    docs = table(spark, sf, "documents").repartition("source").sortWithinPartitions("source", "doc_id")
    docs.select("source", "text").write.partitionBy("source").text(root)
    found = files.read_text_files(spark, f"{root}/source=*/*")
    return out(found.select(F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source"), F.md5("text").alias("digest")))


@query("s13_image_sizes", "SELECT doc_id, doc_id % 500 + 1 AS width, n_chars % 700 + 1 AS height FROM documents WHERE doc_id % 4 <> 3")
def image_sizes(spark, sf):
    """Headers of images of every kind made of each document's numbers; every fourth is none."""
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 500 + 1).alias("w"), (F.col("n_chars") % 700 + 1).alias("h"), "text")
    big = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    little = lambda c: F.concat(F.substring(big(c, 2), 3, 2), F.substring(big(c, 2), 1, 2))
    w, h, kind = F.col("w"), F.col("h"), F.col("doc_id") % 4
    note = F.substring(F.hex(F.encode("text", "UTF-8")), 1, 40)  # a comment before the frame
    made = (
        F.when(kind == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4)))
        .when(kind == 1, F.concat(F.lit("474946383961"), little(w), little(h)))
        .when(kind == 2, F.concat(F.lit("FFD8FFE000040000FFFE"), big((F.length(note) / 2 + 2).cast("bigint"), 2), note, F.lit("FFC2001108"), big(h, 2), big(w, 2)))
        .otherwise(F.hex(F.encode("text", "UTF-8")))
    )
    found = docs.select("doc_id", files.image_size(F.unhex(made)).alias("size")).filter("size is not null")
    return out(found.select("doc_id", "size.width", "size.height"))


@query("s6_decoded_bytes", "SELECT doc_id, md5(text) AS digest FROM documents")
def decoded_bytes(spark, sf):
    """Every text as bytes, half of them Latin-1 where that encoding can hold the text."""
    docs = table(spark, sf, "documents")
    latin = F.col("text").rlike(r"\A[\x00-\xff]*\z") & (F.col("doc_id") % 2 == 0)
    raw = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return out(docs.select("doc_id", F.md5(files.decode_bytes(raw)).alias("digest")))


def _entries(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        F.when(F.col("doc_id") % 2 == 0, "").otherwise("own title").alias("title"),
        F.array("lang", F.lit(" "), "source").alias("topics"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(False)).alias("enabled"),
        "doc_id",
    )


@query("s9_manifest_defaults", """SELECT 'd' || doc_id AS source_id, CASE WHEN doc_id % 2 = 0 THEN 'untitled' ELSE 'own title' END AS title,
    lang || ',' || source AS topics, 'principle' AS evidence_level, NULL::VARCHAR AS author FROM documents""")
def manifest_defaults(spark, sf):
    filled = manifest.apply_defaults(_entries(spark, sf), {"title": "untitled", "evidence_level": "principle"})
    return out(filled, "source_id", "title", "topics", "evidence_level", "author")


def _plan(spark, sf):
    entries = _entries(spark, sf)
    files_there = entries.filter(F.col("doc_id") % 7 != 0).select("file")
    state = entries.filter(F.col("doc_id") % 3 == 0).select("source_id")
    return manifest.plan_ingest(entries, files_there, state)


@query("f9_ingest_plan", """SELECT 'd' || doc_id AS source_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'pending' END AS status
    FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0""")
def ingest_plan(spark, sf):
    pending, missing = _plan(spark, sf)
    label = lambda df, s: df.select("source_id", F.lit(s).alias("status"))
    return out(label(pending, "pending").unionByName(label(missing, "missing")))


@query("s10_ingest_state", f"""WITH {_DOCS}, {_chunk_sql(500, 50)}, {_PACKED} SELECT src AS source_id, count(*) + (CASE WHEN any_value(lang) = 'de' THEN 1000 ELSE 0 END) AS chunks_added, 0::BIGINT AS figures_added FROM ch GROUP BY 1""")
def ingest_state(spark, sf):
    """State of a first batch, then a second batch that recounts the German documents."""
    first = manifest.state_rows(_chunks(spark, sf), 1)
    german = _chunks(spark, sf).filter(F.col("topics") == "de")
    second = manifest.state_rows(german, 2).withColumn("chunks_added", F.col("chunks_added") + 1000)
    return out(manifest.latest_state(first.unionByName(second)), "source_id", "chunks_added", "figures_added")


@query("s14_json_documents", "SELECT source || '/' || doc_id AS source, length(text) AS chars FROM documents")
def json_documents(spark, sf):
    path = fresh_path(spark, "json")
    tables.write_json(_documents(spark, sf).select("source", "text"), path)
    return out(spark.read.schema("source string, text string").json(path).select("source", F.length("text").alias("chars")))


@query("t4_t5_t7_figures", """SELECT 'scan/' || (page_id // 50) || '::fig::p' || lpad((page_id % 50)::VARCHAR, 4, '0') || '::1' AS id, page_id % 50 AS page,
    '[scan/' || (page_id // 50) || ' | fx]' || chr(10) || '[Figure page ' || (page_id % 50) || '] ' || url || CASE WHEN page_id % 2 = 0 THEN chr(10) || chr(10) || 'Nearby text: near' ELSE '' END AS text
    FROM pages WHERE page_id % 4 <> 0 AND page_id % 5 <> 0""")
def figures(spark, sf):
    """A fourth of the captions failed and a fifth of the figures are stored already."""
    pages = table(spark, sf, "pages")
    source = F.concat(F.lit("scan/"), F.floor(F.col("page_id") / 50).cast("string"))
    rows = pages.select(
        "page_id", source.alias("source"), (F.col("page_id") % 50).alias("page"), F.lit(1).alias("figure_index"), F.col("url").alias("image_path"),
        F.when(F.col("page_id") % 2 == 0, " near ").otherwise("").alias("nearby"), F.lit(0).alias("chunk_index"), F.lit("fx").alias("asset_class"),
    )
    # The image path carries the page so that captions stay one per figure.
    rows = rows.withColumn("image_path", F.concat("image_path", F.lit("#"), F.col("page_id").cast("string")))
    captions = rows.select("image_path", F.when(F.col("page_id") % 4 != 0, F.regexp_replace("image_path", r"#\d+$", "")).alias("caption"))
    stored = rows.filter(F.col("page_id") % 5 == 0).select(tx.figure_id(F.col("source"), F.col("page"), F.col("figure_index")).alias("id"))
    return out(corpus.ingest_figures(rows, captions, stored), "id", "page", "text")


# Retrieval ------------------------------------------------------------------------


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))


def _questions(spark, sf):
    """One question per label: the mean of its vectors."""
    parts = _vectors(spark, sf).select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))
    return ordered.select(F.col("label").alias("query_id"), F.col("v.m").alias("embedding"), "label")


_TOPK = """
    q AS MATERIALIZED (SELECT label::BIGINT AS query_id, list(m ORDER BY i) AS qv FROM (
        SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
    hits AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
        SELECT query_id, vec_id, label::BIGINT AS label, round(1.0 - list_cosine_similarity(qv, embedding::DOUBLE[]), 12) AS distance FROM q, embeddings WHERE {where}))"""


@query("v1_cosine_top_k", f"WITH {_TOPK.format(where='true')} SELECT query_id, vec_id, rank, round(distance, 8) AS distance FROM hits WHERE rank <= 5")
def cosine_top_k(spark, sf):
    return out(retrieval.cosine_top_k(_questions(spark, sf), _vectors(spark, sf), 5, "vec_id"), "query_id", "vec_id", "rank", "distance", digits=8)


@query("v2_filtered_top_k", f"WITH {_TOPK.format(where='label = query_id')} SELECT query_id, vec_id, rank, round(distance, 8) AS distance FROM hits WHERE rank <= 7")
def filtered_top_k(spark, sf):
    hits = retrieval.cosine_top_k(_questions(spark, sf), _vectors(spark, sf), 7, "vec_id", "label")
    return out(hits, "query_id", "vec_id", "rank", "distance", digits=8)


def _indexed(spark, sf, group=None):
    return VectorBlocks(spark, fresh_path(spark, "vector-blocks"), 64, "vec_id", group).build(_vectors(spark, sf), pivots=32, block_bytes=64 << 10)


@query("v1_block_top_k", f"WITH {_TOPK.format(where='true')} SELECT query_id, vec_id, rank, round(distance, 8) AS distance FROM hits WHERE rank <= 5")
def block_top_k(spark, sf):
    """Top-k over the block index, blocks of 64 kB."""
    return out(_indexed(spark, sf).top_k(_questions(spark, sf).drop("label"), 5), "query_id", "vec_id", "rank", "distance", digits=8)


@query("v2_filtered_block_top_k", f"WITH {_TOPK.format(where='label = query_id')} SELECT query_id, vec_id, rank, round(distance, 8) AS distance FROM hits WHERE rank <= 7")
def filtered_block_top_k(spark, sf):
    """The same with a filter value: cells and blocks are those of one label."""
    asked = _questions(spark, sf).select("query_id", "embedding", F.col("query_id").cast(_vectors(spark, sf).schema["label"].dataType).alias("label"))
    return out(_indexed(spark, sf, "label").top_k(asked, 7), "query_id", "vec_id", "rank", "distance", digits=8)


@query("v2_source_filtered_chunks", f"""WITH {_TOPK.format(where='true').replace('FROM q, embeddings', "FROM q, (SELECT e.*, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id) embeddings").replace('SELECT query_id, vec_id, label::BIGINT AS label,', 'SELECT query_id, vec_id, source,').replace('WHERE true', "WHERE source = 'src' || query_id")}
    SELECT query_id, vec_id, source, rank, round(distance, 8) AS distance, 'text' AS chunk_type, vec_id % 100 + 1 AS page, 'doc ' || vec_id AS title FROM hits WHERE rank <= 4""")
def source_filtered_chunks(spark, sf):
    """Each question asks one source only; the hit carries the chunk's whole record."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    chunks = _vectors(spark, sf).drop("label").join(docs, "vec_id")
    asked = _questions(spark, sf).select("query_id", "embedding", F.concat(F.lit("src"), F.col("query_id").cast("string")).alias("source"))
    record = docs.select(
        "vec_id", "source", F.lit("text").alias("chunk_type"), (F.col("vec_id") % 100 + 1).alias("page"), F.concat(F.lit("doc "), F.col("vec_id").cast("string")).alias("title")
    )
    hits = retrieval.with_chunks(retrieval.cosine_top_k(asked, chunks, 4, "vec_id", "source"), record, "vec_id")
    return out(hits, "query_id", "vec_id", "source", "rank", "distance", "chunk_type", "page", "title", digits=8)


def _hits(spark, sf, k: int = 6):
    """Hits joined to the document whose number is the vector's."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("vec_id"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 100).alias("chunk_index"),
        "text",
    )
    return retrieval.with_chunks(retrieval.cosine_top_k(_questions(spark, sf), _vectors(spark, sf), k, "vec_id"), docs, "vec_id")


_JOINED = f"""{_TOPK.format(where='true')},
    hd AS MATERIALIZED (SELECT query_id, rank, vec_id, distance, coalesce(CASE WHEN doc_id % 5 <> 0 THEN source END, 'unknown') AS source,
        CASE WHEN doc_id % 7 <> 0 THEN doc_id % 100 END AS chunk_index, text FROM hits LEFT JOIN documents ON doc_id = vec_id WHERE rank <= 6)"""


@query("v3_v7_source_list", f"""WITH {_JOINED} SELECT query_id, rank, source, coalesce(chunk_index, -1) AS chunk_index, round(distance, 8) AS distance,
    md5(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END) AS preview FROM hd""")
def source_list(spark, sf):
    rows = retrieval.source_list(_hits(spark, sf)).withColumn("preview", F.md5("preview"))
    return out(rows, digits=8)


@query("v3_retrieved_records", f"""WITH {_JOINED} SELECT query_id, rank, source, chunk_index, round(distance, 8) AS distance, md5(text) AS digest, CASE WHEN vec_id % 4 <> 0 THEN 'text' END AS chunk_type,
    CASE WHEN vec_id % 3 <> 0 THEN vec_id % 100 + 1 END AS page, 'doc ' || vec_id AS title FROM hd""")
def retrieved_records(spark, sf):
    """Every field of a hit, with pages stored as text and some of them none."""
    told = {
        "page": F.when(F.col("vec_id") % 3 == 0, "n/a").otherwise((F.col("vec_id") % 100 + 1).cast("string")), "title": F.concat(F.lit("doc "), F.col("vec_id").cast("string")),
        "chunk_type": F.when(F.col("vec_id") % 4 == 0, "").otherwise("text"),
    }
    rows = retrieval.knowledge_records(_hits(spark, sf).withColumns(told))
    return out(rows.withColumn("digest", F.md5("text")).drop("text"), digits=8)


@query("v8_numbered_context", f"""WITH {_JOINED} SELECT query_id, md5(string_agg('[' || n || '] ' || text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM hd WHERE text IS NOT NULL) GROUP BY 1""")
def numbered_context(spark, sf):
    rows = retrieval.numbered_context(_hits(spark, sf).filter(F.col("text").isNotNull()))
    return out(rows.select("query_id", F.md5("context").alias("digest")))


@query("v9_excerpts", f"""WITH {_JOINED} SELECT query_id, md5(string_agg('[' || source || ' #' || chunk_index || ']' || chr(10) || substr(text, 1, 800), chr(10) || chr(10) ORDER BY rank)) AS digest
    FROM hd WHERE chunk_index IS NOT NULL AND text IS NOT NULL AND rank <= 4 GROUP BY 1""")
def excerpts(spark, sf):
    hits = _hits(spark, sf).filter(F.col("chunk_index").isNotNull() & F.col("text").isNotNull() & (F.col("rank") <= 4))
    return out(retrieval.excerpt_block(hits).select("query_id", F.md5("excerpts").alias("digest")))


@query("v10_citations", f"WITH {_JOINED} SELECT query_id, rank, source, chunk_index FROM hd WHERE chunk_index IS NOT NULL")
def citations(spark, sf):
    return out(retrieval.citations(_hits(spark, sf)).select("query_id", "rank", "citation.source", "citation.chunk_index"))


@query("v4_source_chunks", f"""WITH {_DOCS}, {_chunk_sql(500, 50)}, {_PACKED} SELECT src || '::' || chunk_index AS id FROM ch WHERE chunk_index = 1""")
def source_chunks(spark, sf):
    """The second chunk of every source."""
    chunks = _chunks(spark, sf)
    wanted = _documents(spark, sf).select("source", F.lit(1).alias("chunk_index"))
    return out(corpus.source_chunks(chunks, wanted), "id")


@query("v5_v6_corpus_stats", f"""WITH {_DOCS}, {_chunk_sql(500, 50)}, {_PACKED} SELECT count(*) AS chunk_count, count(DISTINCT src) AS source_count FROM ch""")
def corpus_stats(spark, sf):
    return out(corpus.corpus_stats(_chunks(spark, sf)))


@query("v5_corpus_sources", f"""WITH {_DOCS}, {_chunk_sql(500, 50)}, {_PACKED} SELECT src AS source, count(*) AS chunks FROM ch GROUP BY 1""")
def corpus_sources(spark, sf):
    return out(corpus.corpus_sources(_chunks(spark, sf)))


@query("v11_regime_queries", outer("hlab", """instrument, idx, 'Kathy Lien ' || regime || ' ' || coalesce(direction, '') || ' ' || play_class
    || ' currency market regime filter strategy' AS question"""))
def regime_queries(spark, sf):
    question = tx.regime_query(F.col("regime"), F.col("direction"), F.col("allowed_play_classes"))
    return out(hourly_labels(spark, sf).select("instrument", "idx", question.alias("question")))


_STAGE_CASE = "CASE stage " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.STAGE_QUERIES.items()) + f" ELSE '{tx.OTHER_STAGE_QUERY}' END"


@query("v11_v17_stage_questions", _tiled_sql(_FORMATIONS + f"\n    SELECT stage, {_STAGE_CASE} AS question, count(*) AS n FROM st GROUP BY 1, 2"))
def stage_questions(spark, sf):
    stages = formation(analysis_windows(tiles(hourly(spark, sf), TILE, stride=STRIDE), TILES), TILES)
    return out(stages.groupBy("stage", tx.stage_query(F.col("stage")).alias("question")).agg(F.count("*").alias("n")))


@query("v17_checklist_context", f"""WITH {_JOINED} SELECT query_id, md5(string_agg('[' || n || '] (' || source || ' #' || chunk_index || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM hd WHERE text IS NOT NULL AND chunk_index IS NOT NULL AND rank <= 4) GROUP BY 1""")
def checklist_context(spark, sf):
    hits = _hits(spark, sf).filter(F.col("text").isNotNull() & F.col("chunk_index").isNotNull() & (F.col("rank") <= 4))
    return out(retrieval.numbered_context(hits, retrieval.source_header()).select("query_id", F.md5("context").alias("digest")))


# Model answers ----------------------------------------------------------------------


def _answers(spark, sf):
    """One model answer per document, in the shapes models produce."""
    kind = F.col("doc_id") % 6
    body = F.to_json(
        F.struct(
            F.when(kind != 1, F.concat("source", F.lit(" thesis"))).alias("thesis"),
            F.when(kind != 2, "fade_range").alias("play_class"),
            F.element_at(F.array(F.lit("buy"), F.lit("SELL"), F.lit("none"), F.lit("long")), (F.col("doc_id") % 4 + 1).cast("int")).alias("side"),
            F.when(kind != 3, F.col("doc_id") / 4).alias("entry"),
            F.element_at(F.array(F.lit("High"), F.lit("80%"), F.lit("0.3"), F.lit("junk"), F.lit("250")), (F.col("doc_id") % 5 + 1).cast("int")).alias("confidence"),
            F.array(F.struct(F.lit("a").alias("source"), F.col("doc_id").alias("chunk_index")), F.struct(F.lit("b").alias("source"), F.lit(None).cast("bigint").alias("chunk_index"))).alias("citations"),
            F.array(F.lit("one"), F.col("lang")).alias("notes"),
        )
    )
    text = (
        F.when(kind == 0, F.concat(F.lit("<think>maybe {\n}</think>\n```json\n"), body, F.lit("\n```")))
        .when(kind == 4, F.concat(F.lit("Here it is: "), body, F.lit(" done")))
        .when(kind == 5, F.concat(F.lit("no object for "), F.col("source")))
        .otherwise(body)
    )
    return table(spark, sf, "documents").select("doc_id", text.alias("answer"), F.array(F.lit(""), F.lit("join_trend")).alias("allowed"))


@query("v12_v13_v14_v15_v16_proposals", """SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'model omitted thesis' ELSE source || ' thesis' END AS thesis,
    CASE WHEN doc_id % 6 = 2 THEN 'join_trend' ELSE 'fade_range' END AS play_class,
    CASE doc_id % 4 WHEN 0 THEN 'long' WHEN 1 THEN 'short' WHEN 2 THEN 'none' ELSE 'long' END AS side,
    CASE WHEN doc_id % 6 <> 3 THEN doc_id / 4 END AS entry, CASE doc_id % 5 WHEN 0 THEN 0.8 WHEN 1 THEN 0.8 WHEN 2 THEN 0.3 WHEN 3 THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence,
    'one; ' || lang AS notes, 1::BIGINT AS cited, doc_id AS cited_index FROM documents WHERE doc_id % 6 <> 5""")
def parsed_proposals(spark, sf):
    good, _ = proposals.parse_proposals(_answers(spark, sf), "answer", "allowed")
    p = F.col("proposal")
    return out(
        good.select(
            "doc_id", *[p[c].alias(c) for c in ("thesis", "play_class", "side", "entry", "confidence", "notes")],
            F.size(p["citations"]).alias("cited"), p["citations"][0]["chunk_index"].alias("cited_index"),
        )
    )


@query("v13_unparsed_answers", "SELECT doc_id, 'model output is not a JSON object' AS reason FROM documents WHERE doc_id % 6 = 5")
def unparsed_answers(spark, sf):
    return out(proposals.parse_proposals(_answers(spark, sf), "answer", "allowed")[1], "doc_id", "reason")
