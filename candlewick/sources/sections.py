"""HTML sections: text, document assembly and image references."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from candlewick.functions.text import html_to_text, strip
from candlewick.operators.series import running_offsets
from candlewick.sources.files import MIN_FIGURE_SIDE, SNIPPET_CHARS, large_images

# Images no section refers to are numbered after all chapters, in parts of this many.
LEFTOVER_PART = 1 << 40
LEFTOVER_ROWS = 1000

# Blocks whose text counts as nearby, and elements without content.
_BLOCKS = ("p", "div", "figure", "section")
_VOID = ("area", "base", "br", "col", "embed", "hr", "input", "link", "meta", "source", "track", "wbr")


def assemble_documents(sections: DataFrame) -> DataFrame:
    """(source, text): non-empty section texts in order, joined by blank lines.

    ``sections``: source, pos, section_id, text. A section id met again is skipped.
    """
    once = sections.groupBy("source", "section_id").agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    grouped = once.filter(F.coalesce("text", F.lit("")) != "").groupBy("source").agg(parts.alias("_s"))
    return grouped.select("source", F.array_join(F.transform("_s", lambda s: s["text"]), "\n\n").alias("text"))


def sections_text(sections: DataFrame) -> DataFrame:
    """Replace the ``html`` column by its ``text``."""
    return sections.withColumn("text", html_to_text(F.col("html"))).drop("html")


def resolve_reference(base: Column, src: Column) -> Column:
    """Image path relative to its section; null for external and data URLs."""
    clean = F.url_decode(F.replace(F.regexp_replace(strip(src), "#.*$", ""), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(base, r"^(.*/)[^/]*$", 1)
    joined = F.when(clean.startswith("/"), clean).otherwise(F.concat(folder, clean))
    parts = F.aggregate(
        F.filter(F.split(joined, "/"), lambda p: (p != ".") & (p != "")),
        F.array().cast("array<string>"),
        lambda kept, p: F.when(p == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, p)),
    )
    outside = strip(src).rlike("^(https?://|data:)") | (strip(src) == "")
    return F.when(~outside, F.array_join(parts, "/"))


class _ImageTags(HTMLParser):
    """Collects image sources with the text nodes of their innermost enclosing block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str]]] = []
        self.found: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "img":
            around = next((texts for name, texts in reversed(self.open) if name in _BLOCKS), [])
            self.found.append(((dict(attrs).get("src") or "").strip(), around))
        elif tag not in _VOID:
            self.open.append((tag, []))

    def handle_startendtag(self, tag, attrs):
        if tag == "img":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        names = [name for name, _ in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        if data.strip() and not any(name in ("script", "style") for name, _ in self.open):
            for _, texts in self.open:
                texts.append(data.strip())


_TAGS = ArrayType(StructType([StructField("src", StringType()), StructField("nearby", StringType())]))


@F.pandas_udf(_TAGS)
def image_tags(html: pd.Series) -> pd.Series:
    """Image tags of a section in order, with up to 500 characters of nearby text."""

    def tags(text: str | None) -> list[dict]:
        parser = _ImageTags()
        parser.feed(text or "")
        parser.close()
        return [{"src": src, "nearby": " ".join(texts)[:SNIPPET_CHARS]} for src, texts in parser.found if src]

    return html.map(tags)


def image_references(sections: DataFrame) -> DataFrame:
    """One row per image reference: source, chapter, place in the chapter, path, nearby text.

    ``sections``: source, chapter, name, html.
    """
    tagged = F.when(F.col("html").rlike("(?i)<img"), image_tags("html"))
    rows = sections.select("source", "chapter", "name", F.posexplode(tagged).alias("place", "r"))
    return rows.select(
        "source", "chapter", "place", resolve_reference(F.col("name"), F.col("r.src")).alias("path"), F.col("r.nearby").alias("nearby")
    ).filter(F.col("path").isNotNull())


def document_figures(references: DataFrame, images: DataFrame, side: int = MIN_FIGURE_SIDE) -> DataFrame:
    """Figures of a document: referenced images in reading order, then the others, numbered together.

    ``images``: source, path, item (its place among the document's images), width,
    height. A path counts once, where it is first referenced; small images never
    count. Numbers are ranks inside a chapter plus what earlier chapters hold, so
    a document of any length is numbered in parts.
    """
    firsts = references.join(images.select("source", "path"), ["source", "path"], "left_semi").groupBy("source", "path").agg(
        F.min(F.struct("chapter", "place", "nearby")).alias("_first")
    )
    referenced = F.col("_first").isNotNull()
    big = large_images(images, side).join(firsts, ["source", "path"], "left").withColumns(
        {
            "page": F.coalesce("_first.chapter", F.lit(0)).cast("bigint"),
            "nearby": F.coalesce("_first.nearby", F.lit("")),
            "_part": F.when(referenced, F.col("_first.chapter")).otherwise(LEFTOVER_PART + F.floor(F.col("item") / LEFTOVER_ROWS)).cast("bigint"),
            "_place": F.when(referenced, F.col("_first.place")).otherwise(F.col("item")).cast("bigint"),
        }
    )
    totals = big.groupBy("source", "_part").agg(F.count("*").alias("_n"))
    offsets = running_offsets(totals, ["source"], "_part", ["_n"]).select("source", "_part", "_n_before")
    w = Window.partitionBy("source", "_part").orderBy("_place", "path")
    numbered = big.withColumn("_rank", F.row_number().over(w)).join(offsets, ["source", "_part"])
    return numbered.select(
        "source", "path", "page", "nearby", (F.col("_n_before") + F.col("_rank") - 1).alias("figure_index")
    )
