"""Cleaning, normalising and incremental selection of chat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import chat, text
from lorekeep.operators.ordering import first_rows, number_in_order


def _valid() -> Column:
    return text.is_valid_message(F.col("msg"), F.col("type_name"))


def valid_rows(raw: DataFrame) -> DataFrame:
    return raw.where(_valid())


def cleaned_rows(raw: DataFrame, order: str = "position", key_chars: int | None = None) -> DataFrame:
    """Valid rows, one per (file, time, message): the earliest. With key_chars only a message's start counts."""
    keys = [
        F.col("source"),
        F.coalesce(F.col("CreateTime"), F.lit("")),
        text.prefix(F.col("msg"), key_chars),
    ]
    return first_rows(valid_rows(raw), keys, [F.col(order)])


def _rows_by_key(raw: DataFrame, key_chars: int | None) -> DataFrame:
    """Rows per file and cleaning key; rows that are not valid share one key."""
    return raw.groupBy(
        "source",
        _valid().alias("_valid"),
        F.when(_valid(), F.coalesce(F.col("CreateTime"), F.lit(""))).alias("_time"),
        F.when(_valid(), text.prefix(F.col("msg"), key_chars)).alias("_key"),
    ).agg(F.count(F.lit(1)).alias("_rows"))


def _key_counts() -> list[Column]:
    valid_sum = F.coalesce(F.sum(F.when(F.col("_valid"), F.col("_rows"))), F.lit(0))
    total = F.coalesce(F.sum("_rows"), F.lit(0))
    return [
        total.alias("total"),
        (total - valid_sum).alias("filtered"),
        (valid_sum - F.count_if(F.col("_valid"))).alias("duplicates"),
        F.count_if(F.col("_valid")).alias("kept"),
    ]


def cleaning_counts(raw: DataFrame, key_chars: int | None = None) -> DataFrame:
    """Per file: rows read, dropped as invalid, dropped as copies, kept, share saved. key_chars as in cleaned_rows."""
    return _rows_by_key(raw, key_chars).groupBy("source").agg(*_key_counts()).withColumn("saved_pct", _saved())


def cleaning_report(raw: DataFrame, key_chars: int | None = None) -> DataFrame:
    """The counts of each file and of all files (is_total, source NULL), from one scan by grouping sets."""
    by_key = _rows_by_key(raw, key_chars)
    counts = by_key.groupingSets([[F.col("source")], []], F.col("source")).agg(F.grouping_id().alias("_set"), *_key_counts())
    return counts.withColumn("saved_pct", _saved()).withColumn("is_total", F.col("_set") == 1).drop("_set")


def counts_beside(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The same counts from raw rows and rows already cleaned, without finding the copies again."""
    read = raw.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(_valid()).alias("_valid"))
    left = cleaned.groupBy("source").agg(F.count(F.lit(1)).alias("_kept"))
    kept = F.coalesce(F.col("_kept"), F.lit(0))
    counts = read.join(left, "source", "left").select(
        "source",
        "total",
        (F.col("total") - F.col("_valid")).alias("filtered"),
        (F.col("_valid") - kept).alias("duplicates"),
        kept.alias("kept"),
    )
    return counts.withColumn("saved_pct", _saved())


def _saved() -> Column:
    gone = F.col("total") - F.col("kept")
    return F.round(F.try_divide(gone * F.lit(100.0), F.col("total")), 1)


def cleaning_totals(counts: DataFrame) -> DataFrame:
    """Totals over all files. The share is NULL when nothing was read."""
    sums = counts.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"),
    )
    return sums.withColumn("saved", F.col("total") - F.col("kept")).withColumn("saved_pct", _saved())


def normalised_records(raw: DataFrame) -> DataFrame:
    """Typed chat records; rows without talker or message are gone."""
    fields = chat.normalised_fields()
    rest = [c for c in raw.columns if c not in fields]
    typed = raw.select(*rest, *[expr.alias(name) for name, expr in fields.items()])
    return typed.where(chat.has_required(F.col("talker"), F.col("msg")))


def numbered_records(records: DataFrame, block: str = "block", order: str = "position") -> DataFrame:
    """Row numbers per file from 2 on (row 1 is the header), counting accepted records only."""
    return number_in_order(records, ["source"], block, [F.col(order)], start=2)


def chat_documents(numbered: DataFrame, message_chars: int | None = None) -> DataFrame:
    """Records worth indexing, with content text, metadata and identity hash.

    msg_content, from which storage keys are made, is the whole message, or its first message_chars characters.
    """
    kept = valid_rows(numbered)
    return kept.select(
        "source",
        "row_no",
        chat.content(F.col("talker"), F.col("room_name"), F.col("msg")).alias("content"),
        "talker",
        chat.chat_time(F.col("CreateTime")).alias("chat_time"),
        F.coalesce(F.col("CreateTime"), F.lit("")).alias("chat_time_str"),
        F.coalesce(F.col("room_name"), F.lit("")).alias("room"),
        "is_sender",
        "is_forward",
        text.prefix(F.col("msg"), message_chars).alias("msg_content"),
        chat.record_hash(
            F.col("source"), F.col("row_no"), F.col("CreateTime"), F.col("msg")
        ).alias("record_hash"),
    )


def unseen(rows: DataFrame, tracked: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not tracked yet."""
    return rows.join(tracked.select(key), key, "left_anti")


def without_known(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys are not stored, for few incoming rows against a large store.

    The store is first reduced to the keys that come in: Spark broadcasts those, or
    builds a Bloom filter from them, instead of shuffling the whole store. `incoming`
    is read twice and must be cheap to read.
    """
    known = stored.select(*keys).join(incoming.select(*keys), keys, "left_semi").distinct()
    return incoming.join(known, keys, "left_anti")


def load_counts(numbered: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """Per file: records read, skipped by the message filter, already imported, new."""
    marked = numbered.select(
        "source",
        _valid().alias("_valid"),
        chat.record_hash(
            F.col("source"), F.col("row_no"), F.col("CreateTime"), F.col("msg")
        ).alias("record_hash"),
    )
    if tracked is None:
        marked = marked.withColumn("_seen", F.lit(False))
    else:
        known = tracked.select("record_hash").distinct().withColumn("_known", F.lit(True))
        marked = marked.join(known, "record_hash", "left").withColumn(
            "_seen", F.col("_known").isNotNull()
        )
    return marked.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(~F.col("_valid")).alias("filtered"),
        F.count_if(F.col("_valid") & F.col("_seen")).alias("already_imported"),
        F.count_if(F.col("_valid") & ~F.col("_seen")).alias("imported"),
    )


def with_upsert_ids(documents: DataFrame) -> DataFrame:
    """One document per storage key: the earliest by file and row."""
    keyed = documents.withColumn(
        "id", chat.upsert_id(F.col("source"), F.col("chat_time"), F.col("msg_content"))
    )
    return first_rows(keyed, ["id"], [F.col("source"), F.col("row_no")])


def merged_by_id(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert as a table: incoming rows replace stored rows of the same id."""
    kept = existing.join(incoming.select("id"), "id", "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def merged_hashes(*tracked: DataFrame) -> DataFrame:
    """Union of tracked hash tables without repeats."""
    first, *others = [t.select("record_hash") for t in tracked]
    for other in others:
        first = first.unionByName(other)
    return first.distinct()
