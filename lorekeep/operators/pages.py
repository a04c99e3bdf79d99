"""Textbook pages: cleaning, carried headings, overlapping chunks, import selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.functions.binding import let
from lorekeep.operators.ordering import carry_forward

FIRST_CHAPTER = "前言"
PAGES_PER_BLOCK = 4096
CHUNK_CHARS = 1000
OVERLAP_CHARS = 200


def cleaned_pages(
    raw: DataFrame, extra_noise: Sequence[str] = (), ocr_enabled: bool = True, ocr_below: int = text.OCR_MIN_CHARS
) -> DataFrame:
    """Pages that hold text after cleaning. `raw` has source, page, text and optionally error, ocr."""
    ocr = F.col("ocr") if "ocr" in raw.columns else text.needs_ocr(F.col("text"), ocr_enabled, ocr_below)
    rest = [c for c in raw.columns if c not in ("source", "page", "text", "ocr", "error")]
    readable = raw.where(F.col("error").isNull()) if "error" in raw.columns else raw
    cleaned = text.without_noise(F.col("text"), extra_noise)
    # A filter on a computed text is pushed below the projection and computes the
    # text a second time. Emitting it through explode runs the patterns once.
    return readable.select(
        "source",
        "page",
        F.explode(F.filter(F.array(cleaned), lambda t: t != "")).alias("text"),
        ocr.alias("ocr"),
        *rest,
    )


def _page_headings(page_text: Column) -> Column:
    """struct(chapter, section) as the lines of one page leave them; NULL = untouched."""
    headings = text.heading_lines(page_text)
    nothing = F.struct(
        F.lit(None).cast("string").alias("chapter"), F.lit(None).cast("string").alias("section")
    )
    return F.aggregate(headings, nothing, _after_heading)


def _after_heading(state: Column, line: Column) -> Column:
    def moved(kind: Column) -> Column:
        chapter = F.when(kind == "chapter", line).otherwise(state["chapter"])
        section = F.when(kind == "chapter", F.lit("")).when(kind == "section", line).otherwise(state["section"])
        return F.struct(chapter.alias("chapter"), section.alias("section"))

    return let(text.heading_kind(line), moved)


def heading_events(pages: DataFrame, pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    """Pages with the headings they set (NULL = none) and their block of the file."""
    return pages.withColumn("_head", _page_headings(F.col("text"))).select(
        *pages.columns,
        F.col("_head.chapter").alias("_chapter"),
        F.col("_head.section").alias("_section"),
        F.floor(F.col("page") / pages_per_block).alias("_block"),
    )


def carried_headings(marked: DataFrame) -> DataFrame:
    """Chapter and section in force at the end of each page of a file.

    `marked` is read twice, for the pages and for the ends of blocks: a staged
    table spares the second reading of the texts.
    """
    events = {"chapter": ("_chapter", FIRST_CHAPTER), "section": ("_section", "")}
    return carry_forward(marked, ["source"], "_block", "page", events).drop("_chapter", "_section", "_block")


def with_headings(pages: DataFrame, pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    return carried_headings(heading_events(pages, pages_per_block))


def _paragraphs(page_text: Column) -> Column:
    parts = F.transform(F.split(page_text, "\n{2,}"), text.stripped)
    return F.filter(parts, lambda part: part != "")


def _chunks_of_page(page_text: Column, chapter: Column, section: Column, size: int, overlap: int) -> Column:
    """array<struct<text,chapter,section>>: paragraphs packed greedily, never split.

    A chunk carries the headings in force when it is closed, so a heading that
    closes a chunk labels that chunk too.
    """
    chunk_type = "array<struct<text:string,chapter:string,section:string>>"
    start = F.struct(
        F.lit("").alias("open"),
        chapter.alias("chapter"),
        section.alias("section"),
        F.array().cast(chunk_type).alias("done"),
    )

    def chunk(body: Column, state: Column) -> Column:
        return F.array(
            F.struct(body.alias("text"), state["chapter"].alias("chapter"), state["section"].alias("section"))
        )

    def add(state: Column, part: Column) -> Column:
        head = _after_heading(state, part)
        return let(F.struct(head.alias("head"), state["open"].alias("open"), state["done"].alias("done")), pack(part))

    def pack(part: Column) -> Callable[[Column], Column]:
        def body(s: Column) -> Column:
            used = F.length(s["open"])
            full = used + F.length(part) + 1 > size
            tail = F.concat(F.right(s["open"], F.lit(overlap)), F.lit("\n"), part)
            reopened = F.when(used > overlap, tail).otherwise(part)
            grown = F.when(used > 0, F.concat(s["open"], F.lit("\n"), part)).otherwise(part)
            closed = F.when(full & (used > 0), F.concat(s["done"], chunk(s["open"], s["head"])))
            return F.struct(
                F.when(full, reopened).otherwise(grown).alias("open"),
                s["head"]["chapter"].alias("chapter"),
                s["head"]["section"].alias("section"),
                F.coalesce(closed, s["done"]).alias("done"),
            )

        return body

    def finish(state: Column) -> Column:
        rest = text.stripped(state["open"]) != ""
        return F.when(rest, F.concat(state["done"], chunk(state["open"], state))).otherwise(state["done"])

    return F.aggregate(_paragraphs(page_text), start, add, finish)


def page_chunks(pages: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Chunks of pages with headings: source, page, chunk_no, text, chapter, section, type, ocr."""
    cut = pages.select(
        "source",
        "page",
        "ocr",
        F.posexplode(
            _chunks_of_page(F.col("text"), F.col("chapter"), F.col("section"), size, overlap)
        ).alias("chunk_no", "chunk"),
    )
    return cut.select(
        "source",
        "page",
        F.col("chunk_no").cast("int"),
        F.col("chunk.text").alias("text"),
        F.col("chunk.chapter").alias("chapter"),
        F.col("chunk.section").alias("section"),
        F.lit("textbook").alias("type"),
        "ocr",
    )


def with_chunk_keys(chunks: DataFrame) -> DataFrame:
    """Content hash for tracking and a repeatable storage id."""
    place = F.concat_ws("|", "source", "page", "chunk_no", "text")
    return chunks.withColumn("text_hash", F.md5("text")).withColumn("id", F.md5(place))


def new_chunks(chunks: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """Chunks to import: text not tracked, and not seen in an earlier file of this run.

    Copies inside one file all stay, as a file is checked before any of it is stored.
    """
    keyed = with_chunk_keys(chunks)
    if tracked is not None:
        keyed = keyed.join(tracked.select("text_hash"), "text_hash", "left_anti")
    owner = keyed.groupBy("text_hash").agg(F.min("source").alias("source"))
    # Joined on text and file, not text alone: copies of one text in many files
    # land in many partitions. AQE splits what one file repeats too often.
    return keyed.join(owner, ["text_hash", "source"], "left_semi")


def page_counts(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """Per file: pages read, pages with text, pages from OCR."""
    read = raw.groupBy("source").agg(F.count(F.lit(1)).alias("total_pages"))
    good = pages.groupBy("source").agg(
        F.count(F.lit(1)).alias("valid_pages"), F.count_if(F.col("ocr")).alias("ocr_pages")
    )
    zero = F.lit(0)
    return read.join(good, "source", "left").select(
        "source",
        "total_pages",
        F.coalesce("valid_pages", zero).alias("valid_pages"),
        F.coalesce("ocr_pages", zero).alias("ocr_pages"),
    )


def import_summary(chunks: DataFrame, stored: DataFrame, selected: DataFrame) -> DataFrame:
    """Chunks cut, selected for import, stored and failed, per file."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("source").agg(F.count(F.lit(1)).alias(name))

    joined = count(chunks, "chunks").join(count(selected, "selected"), "source", "left").join(
        count(stored, "imported"), "source", "left"
    )
    zero = F.lit(0)
    return joined.select(
        "source",
        "chunks",
        F.coalesce("selected", zero).alias("selected"),
        F.coalesce("imported", zero).alias("imported"),
        (F.coalesce("selected", zero) - F.coalesce("imported", zero)).alias("failed"),
    )
