"""Text and image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from candlewick.functions.text import strip

# Figure size and page heuristics.
MIN_FIGURE_SIDE = 150
SHORT_PAGE_CHARS = 200
SNIPPET_CHARS = 500


def decode_bytes(content: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files; blank files are dropped."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode_bytes(F.col("content")).alias("text")).filter(strip(F.col("text")) != "")


def large_images(images: DataFrame, side: int = MIN_FIGURE_SIDE) -> DataFrame:
    """Images at least ``side`` pixels wide and high; expects width and height columns."""
    return images.filter((F.col("width") >= side) & (F.col("height") >= side))


#: Segments of a JPEG file that are looked through for its size.
JPEG_SEGMENTS = 64
# JPEG markers that carry the size of the frame.
_FRAMES = [0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF]


def image_size(content: Column) -> Column:
    """(width, height) that the header of a PNG, GIF or JPEG file states; null for anything else. No pixel is decoded."""
    number = lambda raw: F.conv(F.hex(raw), 16, 10).cast("int")
    big = lambda at, n: number(F.substr(content, at, F.lit(n)))
    little = lambda at: number(F.concat(F.substring(content, at + 1, 1), F.substring(content, at, 1)))
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    head = F.hex(F.substring(content, 1, 8))
    none = F.lit(None).cast("int")
    state = lambda at, w, h: F.struct(at.cast("int").alias("at"), w.alias("width"), h.alias("height"))

    def segment(s: Column) -> Column:
        at = s["at"]
        here = big(at, 1) == 0xFF
        framed = here & big(at + 1, 1).isin(*_FRAMES)
        return F.when(framed, state(none, big(at + 7, 2), big(at + 5, 2))).when(here, state(at + 2 + big(at + 2, 2), none, none)).otherwise(state(none, none, none))

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(JPEG_SEGMENTS)), state(F.lit(3), none, none), lambda s, _: F.when(s["at"].isNull(), s).otherwise(segment(s)))
    found = (
        F.when(head == "89504E470D0A1A0A", size(big(F.lit(17), 4), big(F.lit(21), 4)))
        .when(head.startswith("47494638"), size(little(7), little(9)))
        .when(head.startswith("FFD8"), F.transform(F.array(walk), lambda s: size(s["width"], s["height"]))[0])
    )
    return F.when(found["width"].isNotNull() & found["height"].isNotNull(), found)


def read_images(spark: SparkSession, path: str, side: int = MIN_FIGURE_SIDE) -> DataFrame:
    """(path, width, height) of images large enough to be figures, by their headers; other files are dropped."""
    files = spark.read.format("binaryFile").load(path)
    sizes = files.select("path", image_size(F.col("content")).alias("size")).select("path", "size.width", "size.height")
    return large_images(sizes, side)


def page_figures(pages: DataFrame, embedded: DataFrame) -> DataFrame:
    """Figures per page: its large embedded images, else the whole page when OCR found little text.

    ``pages``: source, page, text, ocr_used; ``embedded``: source, page,
    figure_index, width, height.
    """
    snippet = F.substring(F.coalesce("text", F.lit("")), 1, SNIPPET_CHARS).alias("nearby")
    big = large_images(embedded)
    inside = pages.join(big, ["source", "page"]).select("source", "page", "figure_index", snippet, F.lit(False).alias("whole_page"))
    bare = pages.join(big.select("source", "page"), ["source", "page"], "left_anti")
    whole = bare.filter(F.col("ocr_used") & (F.length(F.coalesce("text", F.lit(""))) < SHORT_PAGE_CHARS)).select(
        "source", "page", F.lit(0).alias("figure_index"), snippet, F.lit(True).alias("whole_page")
    )
    return inside.unionByName(whole)
