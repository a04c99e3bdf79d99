"""The registered queries: each runs one operator or search over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import chat, context, labels, text, uploads, vectors
from lorekeep.operators import batch, chatrows, neighbours, ordering, pages, personas, results, sessions, similarity, stats, timeline
from lorekeep.plans import imports, search, tables
from lorekeep.plans.reflective import Wording, reflective_answers
from lorekeep.session import checkpoint_dir
from lorekeep.sources import chat_csv
from lorekeep.sources.collections import Collections, staged
from lorekeep.sources.providers import HashEmbedder, message
from lorekeep.sources.sketches import SenderSketches, estimated, sender_sketches
from lorekeep.sources.tracking import Tracking
from lorekeep.streaming.imports import start_import
from lorekeep.streaming.replies import replies_within
from lorekeep.streaming.sessions import MESSAGE, live_sessions, session_tails

TRACKED_BEFORE = "2024-01-16.csv"
STORED_UNTIL = "2024-01-20.csv"
INCOMING_FROM = "2024-01-10.csv"


def _big(*names: str) -> dict:
    return {n: F.col(n).cast("long") for n in names}


# ── chat rows ────────────────────────────────────────────────────────────────


def valid_messages(spark: SparkSession, sf: str) -> DataFrame:
    return chatrows.valid_rows(tables.chat_rows(spark, sf)).select("source", "position", "msg")


def cleaned_messages(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = chatrows.cleaned_rows(tables.chat_rows(spark, sf))
    return cleaned.select("source", "position", "CreateTime", "msg")


def cleaning_counts(spark: SparkSession, sf: str) -> DataFrame:
    return chatrows.cleaning_counts(tables.chat_rows(spark, sf))


def cleaning_totals(spark: SparkSession, sf: str) -> DataFrame:
    return chatrows.cleaning_totals(cleaning_counts(spark, sf))


def cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    report = chatrows.cleaning_report(tables.chat_rows(spark, sf))
    return report.withColumns(_big("is_total"))


def normalised_records(spark: SparkSession, sf: str) -> DataFrame:
    records = chatrows.normalised_records(tables.chat_rows(spark, sf))
    return records.select(
        "source",
        "position",
        *chat.ALL_FIELDS,
        chat.has_time(F.col("CreateTime")).cast("long").alias("has_time"),
        chat.has_room(F.col("room_name")).cast("long").alias("has_room"),
        chat.message_type(F.col("type_name")).alias("msg_type"),
    ).withColumns(_big("is_sender", "is_forward"))


def sparse_records(spark: SparkSession, sf: str) -> DataFrame:
    records = chatrows.normalised_records(tables.chat_rows(spark, sf))
    fields = ["talker", "msg", "is_sender", "CreateTime", "type_name", "is_forward"]
    return records.select("source", "position", chat.sparse_json(fields).alias("record"))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return chatrows.numbered_records(chatrows.normalised_records(tables.chat_rows(spark, sf)))


def numbered_records(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(spark, sf).select("source", "position", F.col("row_no").cast("long"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return chatrows.chat_documents(_numbered(spark, sf)).withColumns(
        _big("row_no", "is_sender", "is_forward")
    )


def chat_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf)


def _chat_folder(spark: SparkSession, sf: str) -> str:
    """The chat rows as CSV files in the shared folder, one sub-folder per day."""
    folder = f"{checkpoint_dir(spark)}/chat-{uuid.uuid4().hex}"
    chat_csv.write_clean(tables.chat_rows(spark, sf), folder)
    return folder


def csv_chat_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Chat documents of rows that were written to CSV files and read from there."""
    documents = imports.documents_of(chat_csv.read_chat(spark, _chat_folder(spark, sf)))
    return documents.withColumns(_big("row_no", "is_sender", "is_forward"))


def csv_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a cleaned copy of a chat folder."""
    folder = _chat_folder(spark, sf)
    imports.clean_chat_folder(spark, folder, f"{folder}-clean")
    cleaned = chat_csv.read_chat(spark, f"{folder}-clean")
    # A file does not tell an empty field from one without a value.
    time = F.coalesce("CreateTime", F.lit("")).alias("CreateTime")
    return cleaned.select("source", F.col("id").cast("long").alias("position"), time, "msg")


def csv_cleaning_counts(spark: SparkSession, sf: str) -> DataFrame:
    folder = _chat_folder(spark, sf)
    return imports.clean_chat_folder(spark, folder, f"{folder}-clean")


def chat_times(spark: SparkSession, sf: str) -> DataFrame:
    timed = tables.timed_texts(spark, sf)
    return timed.select("event_id", chat.chat_time(F.col("create_time")).alias("chat_time"))


def incremental_documents(spark: SparkSession, sf: str) -> DataFrame:
    documents = _documents(spark, sf).select("source", "row_no", "record_hash")
    tracked = documents.where(F.col("source") < TRACKED_BEFORE)
    return chatrows.unseen(documents, tracked, "record_hash").select("source", "row_no", "record_hash")


def tracked_import(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that a tracking table does not know: its rows stay where they are."""
    documents = _documents(spark, sf).select("source", "row_no", "record_hash")
    tracking = Tracking(spark, f"{checkpoint_dir(spark)}/tracked-{uuid.uuid4().hex}")
    tracking.add(documents.where(F.col("source") < INCOMING_FROM))
    tracking.add(documents.where(F.col("source") < TRACKED_BEFORE))
    return chatrows.unseen(documents, tracking.read(), "record_hash").select("source", "row_no", "record_hash")


def load_counts(spark: SparkSession, sf: str) -> DataFrame:
    tracked = _documents(spark, sf).where(F.col("source") < TRACKED_BEFORE).select("record_hash")
    return chatrows.load_counts(_numbered(spark, sf), tracked)


def upsert_documents(spark: SparkSession, sf: str) -> DataFrame:
    return chatrows.with_upsert_ids(_documents(spark, sf)).select("id", "source", "row_no", "content")


def merged_collection(spark: SparkSession, sf: str) -> DataFrame:
    rows = chatrows.with_upsert_ids(_documents(spark, sf)).select("id", "source", "row_no")
    stored = rows.where(F.col("source") <= STORED_UNTIL).withColumn("run", F.lit("stored"))
    incoming = rows.where(F.col("source") >= INCOMING_FROM).withColumn("run", F.lit("incoming"))
    return chatrows.merged_by_id(stored, incoming)


def reimported_collection(spark: SparkSession, sf: str) -> DataFrame:
    """A collection after its first import, a second one that replaces and adds, compaction, and a third one."""
    store = Collections(spark, f"{checkpoint_dir(spark)}/reimported-{uuid.uuid4().hex}", buckets=8)
    # Each run stores a part of these rows; they are made once.
    rows = staged(chatrows.with_upsert_ids(_documents(spark, sf)).select("id", "source", "row_no", "content", "chat_time"))
    store.open("chat")
    runs = (
        ("stored", F.col("source") <= STORED_UNTIL), ("incoming", F.col("source") >= INCOMING_FROM), ("again", F.col("source") == TRACKED_BEFORE)
    )
    for i, (run, part) in enumerate(runs):
        store.upsert("chat", rows.where(part).withColumn("run", F.lit(run)))
        if i == 1:
            store.compact("chat")
    return store.read("chat").select("id", "source", "row_no", "run")


def merged_hashes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _documents(spark, sf).select("source", "record_hash")
    return chatrows.merged_hashes(
        rows.where(F.col("source") <= STORED_UNTIL), rows.where(F.col("source") >= INCOMING_FROM)
    )


def reply_token_limit(spark: SparkSession, sf: str) -> DataFrame:
    return stats.reply_token_limit(_documents(spark, sf)).select(
        *[F.col(c).cast("long") for c in ("own_messages", "length_at_percentile", "max_tokens")]
    )


def reply_token_limits_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return stats.reply_token_limit(_documents(spark, sf), ["source"]).withColumns(
        _big("own_messages", "length_at_percentile", "max_tokens")
    )


# ── textbook pages ───────────────────────────────────────────────────────────


def _cleaned_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.cleaned_pages(tables.book_pages(spark, sf))


def cleaned_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _cleaned_pages(spark, sf).select(
        "source", "page", F.col("ocr").cast("long"), F.md5("text").alias("text_md5"),
        F.length("text").cast("long").alias("chars"),
    )


def scanned_pages(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.table(spark, sf, "documents")
    return d.select("doc_id", text.needs_ocr(F.col("text")).cast("long").alias("needs_ocr"))


def _headed_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.with_headings(_cleaned_pages(spark, sf))


def page_headings(spark: SparkSession, sf: str) -> DataFrame:
    return _headed_pages(spark, sf).select("source", "page", "chapter", "section")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_chunks(_headed_pages(spark, sf))


def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select(
        "source", "page", F.col("chunk_no").cast("long"), "chapter", "section", "type",
        F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"),
    )


def _plain_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Pages without page lines, so that copied documents give equal chunks."""
    raw = tables.table(spark, sf, "documents").select(
        "source", F.col("doc_id").alias("page"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")
    )
    return pages.page_chunks(pages.with_headings(pages.cleaned_pages(raw)))


def new_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _plain_chunks(spark, sf)
    tracked = pages.with_chunk_keys(chunks.where(F.col("source") == "src1")).select("text_hash")
    return pages.new_chunks(chunks, tracked).select("id", "source", "page", F.col("chunk_no").cast("long"), "text_hash")


def page_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_counts(tables.book_pages(spark, sf), _cleaned_pages(spark, sf))


def chunk_import_summary(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _plain_chunks(spark, sf)
    selected = pages.new_chunks(chunks)
    return pages.import_summary(chunks, selected.where(F.length("text") > 200), selected)


# ── vectors ──────────────────────────────────────────────────────────────────


def _nearest(spark: SparkSession, sf: str, k: int, metric: str) -> DataFrame:
    found = similarity.nearest(tables.vectors(spark, sf), tables.query_vector(spark, sf), k, metric)
    return found.select("id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long"))


def nearest_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, 20, "cosine")


def nearest_l2(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, 20, "l2")


def nearest_two(spark: SparkSession, sf: str) -> DataFrame:
    """The two nearest records with a preview, as the manual retrieval check prints them."""
    found = _nearest(spark, sf, 2, "cosine")
    records = tables.memory_records(spark, sf).select(
        "id", "talker", text.one_line(F.col("content"), 100).alias("preview")
    )
    return records.join(F.broadcast(found), "id")


def _mmr(spark: SparkSession, sf: str, k: int, fetch_k: int) -> DataFrame:
    found = similarity.mmr(tables.vectors(spark, sf), tables.query_vector(spark, sf), k, fetch_k)
    return found.select("id", F.col("rank").cast("long"))


def diverse_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _mmr(spark, sf, 15, 60)


def diverse_hits_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _mmr(spark, sf, 50, 200)


def batch_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every vector of label 0."""
    found = batch.batch_nearest(tables.vectors(spark, sf), tables.query_vectors(spark, sf), 10)
    return found.select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long"))


def batch_search(spark: SparkSession, sf: str) -> DataFrame:
    """Diverse hits for every vector of label 0."""
    found = batch.batch_search(tables.vectors(spark, sf), tables.query_vectors(spark, sf), 8, 40)
    return found.select("query_id", "id", F.col("rank").cast("long"))


# ── chat search ──────────────────────────────────────────────────────────────


def _chat_results(spark: SparkSession, sf: str, params: search.ChatSearch = search.ChatSearch()) -> DataFrame:
    """Search over the records that have a vector; event n has vector n, events beyond the last vector are no hits."""
    return search.chat_search(
        tables.vectors(spark, sf), tables.memory_records(spark, sf), tables.query_vector(spark, sf), params,
        within=tables.seconds_of_ts,
    )


def _shown(found: DataFrame) -> DataFrame:
    return found.select(
        "id", "content", "result_source", F.round("score", 6).alias("score"), F.col("rank").cast("long")
    )


def chat_search(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_chat_results(spark, sf))


def chat_search_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Few hits with many neighbours over a long window."""
    params = search.ChatSearch(k=4, time_window_minutes=240, nearby_per_result=20, max_total_results=45)
    return _shown(_chat_results(spark, sf, params))


def chat_context(spark: SparkSession, sf: str) -> DataFrame:
    found = results.chat_context(_chat_results(spark, sf), budget=2000)
    return found.select("context", F.col("lines").cast("long"))


def result_sources(spark: SparkSession, sf: str) -> DataFrame:
    return stats.result_source_counts(_chat_results(spark, sf))


def chain_context(spark: SparkSession, sf: str) -> DataFrame:
    found = search.chain_context(
        tables.vectors(spark, sf), tables.memory_records(spark, sf), tables.query_vector(spark, sf)
    )
    return found.select("context", F.col("lines").cast("long"))


def time_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours in time of the nearest records, every pair that survives the two limits."""
    found = similarity.nearest(tables.vectors(spark, sf), tables.query_vector(spark, sf), 20)
    ranks = {r.id: r["rank"] for r in found.collect()}
    records = tables.memory_records(spark, sf)
    anchors = records.where(F.col("id").isin(list(ranks))).select("id", "chat_time").collect()
    near = neighbours.time_neighbours(records, [(ranks[a.id], a.chat_time) for a in anchors], within=tables.seconds_of_ts)
    return near.select(
        F.col("anchor_rank").cast("long"), F.col("neighbour_pos").cast("long"), "id",
        F.round("proximity", 6).alias("proximity"),
    )


def time_range(spark: SparkSession, sf: str) -> DataFrame:
    records = tables.memory_records(spark, sf)
    day = 1705276800  # 2024-01-15
    found = neighbours.in_time_range(records, day, day + 86400, 30, [F.col("seq")], tables.seconds_of_ts)
    return found.select("id", "content", "chat_time")


def all_time_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The eight earliest records in the window of every record."""
    near = timeline.all_time_neighbours(tables.memory_records(spark, sf))
    return near.select("anchor_id", F.col("neighbour_pos").cast("long"), "id", F.round("proximity", 6).alias("proximity"))


def sender_sample(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.sender_sample(tables.memory_records(spark, sf), [F.col("seq")])
    return found.select(
        "total_records", "sample_size", F.array_join("unique_senders", ",").alias("senders"),
        F.col("is_approximate").cast("long"),
    )


def sender_count(spark: SparkSession, sf: str) -> DataFrame:
    return stats.sender_count(tables.memory_records(spark, sf))


def sender_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct senders of each collection beside the estimate of sketches from two imports, and of one sketch of all."""
    records = tables.memory_records(spark, sf)
    kept = SenderSketches(spark, f"{checkpoint_dir(spark)}/sketches-{uuid.uuid4().hex}")
    kept.add(records.where("seq % 3 = 0"))
    kept.add(records.where("seq % 3 > 0"))
    rebuilt = sender_sketches(records).select("collection", estimated("senders").alias("rebuilt"))
    exact = records.groupBy("collection").agg(F.count_distinct("talker").alias("senders"))
    both = kept.counts().join(rebuilt, "collection").join(exact, "collection")
    error = F.abs(F.col("unique_senders") - F.col("senders")) / F.col("senders")
    return both.select(
        "collection", "records", "senders", (error <= 0.05).cast("long").alias("close"),
        (F.col("unique_senders") == F.col("rebuilt")).cast("long").alias("as_rebuilt"))


def collection_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return stats.collection_sizes(tables.memory_records(spark, sf))


def write_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Records of each collection in write batches of 500, in store order."""
    records = tables.memory_records(spark, sf).select(
        "id", "collection", "seq", F.floor(F.col("seq") / tables.ROWS_PER_BLOCK).alias("block")
    )
    numbered = ordering.number_in_order(records, ["collection"], "block", ["seq"])
    return numbered.select("id", "collection", F.floor((F.col("row_no") - 1) / 500).alias("batch"))


# ── textbook search ──────────────────────────────────────────────────────────


def _book_results(spark: SparkSession, sf: str) -> DataFrame:
    """Search over the chunks that have a vector; chunk n in page order has vector n, chunks beyond the last vector are no hits."""
    chunks = _chunks(spark, sf).withColumns(
        {"shelf": F.lit("all"), "block": F.floor(F.col("page") / pages.PAGES_PER_BLOCK)}
    )
    numbered = ordering.number_in_order(chunks, ["shelf"], "block", ["page", "chunk_no"], "id", start=0)
    stored = numbered.select("id", F.col("text").alias("content"), "source", "page", "chapter", "section")
    return search.book_search(tables.vectors(spark, sf), stored, tables.query_vector(spark, sf))


def book_search(spark: SparkSession, sf: str) -> DataFrame:
    return _book_results(spark, sf).select(
        "id", "source", "page", "chapter", "section", F.md5("content").alias("text_md5"), F.col("rank").cast("long")
    )


def book_context(spark: SparkSession, sf: str) -> DataFrame:
    found = results.book_context(_book_results(spark, sf), budget=4000)
    return found.select("context", F.col("lines").cast("long"))


def book_sources(spark: SparkSession, sf: str) -> DataFrame:
    return results.chapter_sources(_book_results(spark, sf)).withColumns(_big("source_no"))


def book_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of all chunks for every benchmark passage, by vectors that each chunk and passage gets here."""
    chunk = F.concat_ws("/", "source", "page", "chunk_no").alias("id")
    stored = staged(_chunks(spark, sf).select(chunk, vectors.hashed(F.col("text")).alias("embedding")))
    asked = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), vectors.hashed(F.col("text")).alias("embedding"))
    found = batch.batch_nearest(stored, asked, 5, "l2")
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("chunk"), "distance", F.col("rank").cast("long"))


# ── reflection ───────────────────────────────────────────────────────────────


def relevance_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Per answer: one row per judged passage with its final flag."""
    judged = tables.model_outputs(spark, sf).select(
        "doc_id", labels.relevance_flags(F.col("output"), F.lit(15)).alias("flags")
    )
    each = judged.select(
        "doc_id", "flags", F.explode(F.array_distinct(F.transform("flags", lambda p: p["idx"]))).alias("idx")
    )
    return each.select(
        "doc_id",
        F.col("idx").cast("long"),
        labels.flag_of(F.col("flags"), F.col("idx")).cast("long").alias("relevant"),
    )


def answer_labels(spark: SparkSession, sf: str) -> DataFrame:
    out = F.col("output")
    read = tables.model_outputs(spark, sf).select(
        "doc_id",
        labels.support(out).alias("is_sup"),
        labels.use_score(out).cast("long").alias("is_use"),
        F.md5(labels.grounded_reply(out)).alias("reply_md5"),
    )
    return read.withColumn("retry", labels.needs_retry(F.col("is_sup"), F.col("is_use")).cast("long"))


def stripped_answers(spark: SparkSession, sf: str) -> DataFrame:
    out = F.col("output")
    return tables.model_outputs(spark, sf).select(
        "doc_id",
        F.md5(labels.without_labels(out)).alias("without_labels_md5"),
        F.md5(labels.without_model_markup(out)).alias("without_markup_md5"),
    )


def replies_between_labels(spark: SparkSession, sf: str) -> DataFrame:
    return tables.model_outputs(spark, sf).select(
        "doc_id", F.md5(labels.reply_between_labels(F.col("output"))).alias("reply_md5")
    )


def retrieval_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return tables.model_outputs(spark, sf).select(
        "doc_id", labels.wants_retrieval(F.col("routing")).cast("long").alias("retrieve")
    )


def relevant_results(spark: SparkSession, sf: str) -> DataFrame:
    """Search results without those whose label says irrelevant."""
    found = _chat_results(spark, sf, search.ChatSearch(k=20))
    quality = tables.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("relevant")
    )
    flags = found.select("id", "rank").join(quality, "id").select("rank", "relevant")
    return _shown(results.relevant_results(found, flags, judged=None))


def numbered_passages(spark: SparkSession, sf: str) -> DataFrame:
    found = results.numbered_passages(_chat_results(spark, sf))
    return found.select("passages", F.col("lines").cast("long"))


class _RuleModel:
    """Answers by plain rules on the texts it gets, so that SQL can tell them too."""

    def reply(self, messages, max_tokens: int) -> str | None:
        system, last = messages[0]["content"], messages[-1]["content"]
        if system.startswith("ROUTE "):
            size = len(system) - len("ROUTE ")
            return "[Retrieve] 否" if size < 100 else (None if size < 200 else "[Retrieve] 是")
        if system.startswith("JUDGE "):
            passages = (p.split("] ", 1) for p in system.removeprefix("JUDGE ").split("\n"))
            return "\n".join(f"[IsRel] {n[1:]} {'相关' if len(t) > 40 else '不相关'}" for n, t in passages)
        if system.endswith(" GROUNDED"):
            support = "无支持" if len(last) > 800 else "完全支持"
            return f"grounded {len(system)}\n[IsSup] {support}\n[IsUse] {2 if 'ü' in last else 9}"
        return f"[IsUse] 1\nplain {len(last)}"


def reflective_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Every message as a request whose hits are its own lines."""
    lines = F.split("text", "\n")
    hits = F.transform(
        lines,
        lambda line, i: F.struct(
            (i + 1).alias("rank"), line.alias("content"), F.lit(0).cast("long").alias("chat_time"), F.lit("").alias("chat_time_str")
        ),
    )
    requests = tables.table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.col("text").alias("query"),
        F.array(message("user", F.col("text"))).alias("conversation"),
        F.lit("S").alias("system_prompt"),
        F.lit(100).alias("max_tokens"),
        hits.alias("hits"),
    )
    words = Wording(routing="ROUTE ", judging="JUDGE ", grounded=" GROUNDED", plain=" PLAIN", context_prefix="C:")
    return reflective_answers(requests, _RuleModel(), words, budget=600).select(
        "request_id", "reply", "is_sup", F.col("is_use").cast("long"), F.col("retried").cast("long")
    )


# ── sessions, personas, texts ────────────────────────────────────────────────


def session_tail(spark: SparkSession, sf: str) -> DataFrame:
    kept = sessions.latest_messages(tables.session_messages(spark, sf), keep=3)
    return kept.select("session_id", "seq", "role", "content")


def session_history(spark: SparkSession, sf: str) -> DataFrame:
    kept = sessions.latest_messages(tables.session_messages(spark, sf))
    return kept.select("session_id", "seq", "role")


def persona_parameters(spark: SparkSession, sf: str) -> DataFrame:
    p = personas.with_parameters(tables.personas(spark, sf))
    return p.select(
        "id", "name", "collection", F.col("k").cast("long"), F.col("include_nearby").cast("long"),
        F.col("time_window_minutes").cast("long"), F.col("nearby_per_result").cast("long"),
        F.col("max_total_results").cast("long"), "lambda_mult", F.col("max_tokens").cast("long"),
    )


def persona_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Personas with open parameters after one change for each order, without the deleted ones."""
    final = personas.catalogue(*tables.persona_changes(spark, sf))
    value = lambda name, kind: personas.open_value(F.col("params"), name, kind).alias(name)
    return final.select(
        "id", "name", value("max_tokens", "bigint"), value("tone", "string"), value("priority", "string"), value("price", "double"),
        F.array_join(F.sort_array(F.map_keys("params")), ",").alias("names"),
    )


def persona_requests(spark: SparkSession, sf: str) -> DataFrame:
    orders = tables.table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("persona_id")
    )
    found = personas.matched(orders, tables.personas(spark, sf))
    return found.select("o_orderkey", "persona_id", "used_persona")


def persona_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.collection_sizes(personas.visible(tables.personas(spark, sf)))


def query_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Which messages are blank and which hold a pronoun to resolve."""
    size = F.length("text")
    q = (
        F.when(size < 60, F.lit(" \t　\n"))
        .when(size < 200, F.concat(F.col("text"), F.lit("那些")))
        .when(F.col("role") == "user", F.concat(F.lit("他"), F.col("text")))
        .otherwise(F.col("text"))
    )
    return tables.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        text.is_blank(q).cast("long").alias("blank"),
        text.has_pronoun(q).cast("long").alias("pronoun"),
    )


def message_previews(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("\n　"), F.col("text"), F.lit(" \t"))
    return tables.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        text.one_line(t).alias("preview"),
        text.shortened(F.col("text")).alias("short"),
        context.chat_line(t, F.lit(""), F.col("conv_id")).alias("line"),
    )


def upload_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as uploaded files: English ones as text, others by type and size."""
    size = F.col("n_chars") * F.col("n_chars")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    content = F.when(F.col("lang") == "en", F.col("text"))
    files = tables.table(spark, sf, "documents").where(uploads.is_accepted(size))
    return files.select(
        "doc_id",
        uploads.size_text(size).alias("size_text"),
        uploads.upload_message(name, F.col("lang"), size, content).alias("message"),
    )


# ── streams ──────────────────────────────────────────────────────────────────


def streamed_import(spark: SparkSession, sf: str) -> DataFrame:
    """The chat rows as a stream, imported into a new collection; returns what it then holds."""
    store = Collections(spark, f"{checkpoint_dir(spark)}/streamed-{uuid.uuid4().hex}")
    rows = tables.chat_rows_of(tables.stream(spark, sf, "events"))
    start_import(rows, store, "live", HashEmbedder(), f"{store.root}/checkpoint").awaitTermination()
    return store.read("live").select(
        "id", "source", F.col("row_no").cast("long"), "content", F.size("embedding").cast("long").alias("dim"),
        F.array_join(F.col("embedding").cast("array<long>").cast("array<string>"), ",").alias("vector"),
    )


def streamed_session_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The conversations as a stream; returns the last three messages of each session."""
    root = f"{checkpoint_dir(spark)}/streamed-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/tails/batch={batch_id}")

    tails = session_tails(tables.session_messages_of(tables.stream(spark, sf, "conversations")), keep=3)
    (
        tails.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start().awaitTermination()
    )
    updates = spark.read.schema(f"{MESSAGE}, batch long").parquet(f"{root}/tails")
    last = updates.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return updates.join(last, ["session_id", "batch"], "left_semi").select("session_id", "seq", "role", "content")


def _in_files(spark: SparkSession, parts: list[DataFrame]) -> str:
    """The parts as files of one folder, one after the other."""
    folder = f"{checkpoint_dir(spark)}/arriving-{uuid.uuid4().hex}"
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def streamed_live_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations in three files, some of them going on after a long pause; returns what each session kept last."""
    long_pause = (F.col("conv_id") % 3 == 0) & (F.col("turn") >= 3)
    minutes = F.col("turn") + F.when(long_pause, F.lit(300)).otherwise(F.lit(0))
    timed = tables.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"),
        F.timestamp_add("MINUTE", minutes.cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("ts"),
    )
    late_half = F.col("ts") >= F.lit("2024-01-01 04:00:00").cast("timestamp")
    folder = _in_files(spark, [timed.where("seq < 2"), timed.where(~late_half & (F.col("seq") >= 2)), timed.where(late_half)])
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}-tails/batch={batch_id}")

    (
        live_sessions(stream, keep=3, idle="2 hours").writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    updates = spark.read.schema(f"{MESSAGE}, batch long").parquet(f"{folder}-tails")
    last = updates.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return updates.join(last, ["session_id", "batch"], "left_semi").select("session_id", "seq", "role", "content")


def streamed_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases within six hours after a click of the same user, from events in three files; some come days too late."""
    events = tables.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("talker"), "event_type")
    day = lambda d: F.lit(f"2024-01-{d}").cast("timestamp")
    too_late = (F.col("ts") < day("06")) & (F.substring("talker", -1, 1) == "0")
    first, second = F.col("ts") < day("11"), F.col("ts") < day("21")
    folder = _in_files(spark, [events.where(first & ~too_late), events.where(~first & second), events.where(~second | too_late)])
    stream = lambda kind: (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder).where(F.col("event_type") == kind))
    pairs = replies_within(stream("click"), stream("purchase"), "6 hours", "1 hour")
    (
        pairs.writeStream.format("parquet").option("path", f"{folder}-pairs").option("checkpointLocation", f"{folder}-checkpoint")
        .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema(pairs.schema).parquet(f"{folder}-pairs").select("message_id", "reply_id", "talker")


QUERIES = {
    f.__name__: f
    for f in (
        valid_messages, cleaned_messages, cleaning_counts, cleaning_totals, normalised_records,
        sparse_records, numbered_records, chat_documents, csv_chat_documents, csv_cleaned, csv_cleaning_counts, chat_times, incremental_documents,
        load_counts, upsert_documents, merged_collection, merged_hashes, reply_token_limit,
        reply_token_limits_by_file, cleaned_pages, scanned_pages, page_headings, page_chunks,
        new_chunks, page_counts, chunk_import_summary, nearest_cosine, nearest_l2, nearest_two,
        diverse_hits, diverse_hits_wide, chat_search, chat_search_wide, chat_context,
        result_sources, chain_context, time_neighbours, time_range, sender_sample, sender_count,
        collection_sizes, write_batches, book_search, book_context, book_sources,
        relevance_labels, answer_labels, stripped_answers, replies_between_labels, retrieval_decisions, relevant_results,
        numbered_passages, reflective_replies, session_tail, session_history, persona_parameters, persona_catalogue, persona_requests,
        persona_stats, query_guards, message_previews, upload_messages, streamed_import, streamed_session_tail,
        batch_nearest, batch_search, all_time_neighbours, reimported_collection, cleaning_report, tracked_import, sender_sketch, streamed_live_sessions, streamed_replies,
        book_answers,
    )
}