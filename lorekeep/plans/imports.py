"""Import runs: chat cleaning, chat files into a collection, books into a collection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import chatrows, pages, stats
from lorekeep.sources import chat_csv, files
from lorekeep.sources.collections import Collections, staged
from lorekeep.sources.pages import PageReader, read_pages
from lorekeep.sources.persona_store import PersonaStore
from lorekeep.sources.providers import Embedder, with_embeddings
from lorekeep.sources.tracking import Tracking


# ── cleaning ─────────────────────────────────────────────────────────────────


def _cleanable(rows: DataFrame) -> DataFrame:
    """Raw rows with the three columns cleaning looks at, NULL where the file lacks them."""
    for name in ("msg", "type_name", "CreateTime"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows


def clean_chat_folder(
    spark: SparkSession, folder: str, out: str, pattern: str = "*.csv", in_place: bool = False
) -> DataFrame:
    """Write cleaned copies of all files with their own columns; returns counts per file.

    With in_place the cleaned rows are written into the folder before its old files
    go; `out` is not used. After a failure in between both are there, and cleaning
    again drops the rows that are there twice.
    """
    groups = chat_csv.header_groups(spark, folder, pattern)
    if not groups:
        raise ValueError(f"no file matches {folder}/{pattern}")
    counts, copies = None, []
    for group in groups:
        raw = chat_csv.read_group(spark, group)
        full = _cleanable(raw)
        # Staged once: it serves the counts and the output, and outlives the input.
        copy = staged(chatrows.cleaned_rows(full).select(*raw.columns))
        part = chatrows.counts_beside(full, copy)
        counts = part if counts is None else counts.unionByName(part)
        copies.append(copy)
    counts = staged(counts)
    for copy in copies:
        chat_csv.write_clean(copy, folder if in_place else out)
    if in_place:
        for path in [p for g in groups for p in g.paths]:
            files.delete(spark, path)
    return counts


# ── chat import ──────────────────────────────────────────────────────────────


@dataclass(frozen=True)
class ImportReport:
    documents: int
    written: int
    failed: int
    max_tokens: int
    collection_size: int


def chat_tracking(spark: SparkSession, root: str, collection: str) -> Tracking:
    return Tracking(spark, f"{root}/{collection}/tracked")


def documents_of(raw: DataFrame) -> DataFrame:
    """Chat documents of raw rows with source, block and position."""
    return chatrows.chat_documents(chatrows.numbered_records(chatrows.normalised_records(raw)))


def import_documents(
    documents: DataFrame,
    store: Collections,
    collection: str,
    embedder: Embedder,
    import_no: int,
    embed_tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Embed and upsert new documents, track what was stored. Returns (all, unique embedded), staged."""
    spark = documents.sparkSession
    documents = staged(documents.withColumn("import_no", F.lit(import_no)))
    embedded = staged(with_embeddings(chatrows.with_upsert_ids(documents), embedder, tasks=embed_tasks))
    written = embedded.where(F.col("embedding").isNotNull())
    store.upsert(collection, written.drop("record_hash"))
    # Copies of a stored record count as imported; rows whose embedding failed do not.
    keyed = documents.withColumn("id", chatrows.chat.upsert_id(F.col("source"), F.col("chat_time"), F.col("msg_content")))
    chat_tracking(spark, store.root, collection).add(keyed.join(written.select("id"), "id", "left_semi"))
    return documents, embedded


def import_chat(
    spark: SparkSession,
    store: Collections,
    collection: str,
    folder: str,
    embedder: Embedder,
    pattern: str = "*.csv",
    incremental: bool = True,
    personas: PersonaStore | None = None,
    persona_id: str | None = None,
    embed_tasks: int | None = None,
) -> ImportReport:
    """Import chat files into a collection; a full import replaces it."""
    tracking = chat_tracking(spark, store.root, collection)
    documents = documents_of(chat_csv.read_chat(spark, folder, pattern))
    if incremental:
        documents = chatrows.unseen(documents, tracking.read(), "record_hash")
    else:
        documents = staged(documents)
        store.delete(collection)
    store.open(collection, metric="l2")
    import_no = 1
    if store.has_rows(collection):
        import_no = (store.read(collection).agg(F.max("import_no")).head()[0] or 0) + 1
    new, embedded = import_documents(documents, store, collection, embedder, import_no, embed_tasks)
    limits = stats.reply_token_limit(new).head()
    n_new, n_unique = new.count(), embedded.count()
    n_written = embedded.where(F.col("embedding").isNotNull()).count()
    size = store.read(collection).count() if store.has_rows(collection) else 0
    if personas is not None and persona_id is not None and n_new:
        personas.set_doc_count(persona_id, size)
        personas.set_max_tokens(persona_id, limits.max_tokens)
    return ImportReport(n_new, n_written, n_unique - n_written, limits.max_tokens, size)


# ── book import ──────────────────────────────────────────────────────────────


@dataclass(frozen=True)
class BookReport:
    files: int
    chunks: int
    imported: int
    failed: int
    collection_size: int


def book_chunks(
    raw_pages: DataFrame,
    size: int = pages.CHUNK_CHARS,
    overlap: int = pages.OVERLAP_CHARS,
    extra_noise: Sequence[str] = (),
) -> DataFrame:
    """Chunks of raw pages. The cleaned pages are staged, so that no text is cleaned twice."""
    marked = staged(pages.heading_events(pages.cleaned_pages(raw_pages, extra_noise)))
    return pages.page_chunks(pages.carried_headings(marked), size, overlap)


def import_books(
    spark: SparkSession,
    store: Collections,
    collection: str,
    folder: str,
    reader: PageReader,
    embedder: Embedder,
    incremental: bool = True,
    pattern: str | None = None,
    embed_tasks: int | None = None,
    **cut,
) -> BookReport:
    """Import all books of a folder into a collection; a full import replaces it."""
    raw = staged(read_pages(spark, folder, reader, **({"pattern": pattern} if pattern else {})))
    chunks = staged(book_chunks(raw.drop("path"), **cut))
    tracking = Tracking(spark, f"{store.root}/{collection}/tracked", "text_hash")
    if not incremental:
        store.delete(collection)
    store.open(collection, metric="cosine")
    selected = pages.new_chunks(chunks, tracking.read()).withColumnRenamed("text", "content")
    embedded = staged(with_embeddings(selected, embedder, tasks=embed_tasks))
    written = embedded.where(F.col("embedding").isNotNull())
    store.upsert(collection, written.drop("text_hash"), sort_by=None)
    tracking.add(written)
    n_selected, n_written = embedded.count(), written.count()
    return BookReport(
        raw.select("source").distinct().count(), chunks.count(), n_written, n_selected - n_written,
        store.read(collection).count() if store.has_rows(collection) else 0,
    )

