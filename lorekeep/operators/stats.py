"""Counts and summaries over collections and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_REPLY_TOKENS = 150
SENDER_SAMPLE = 200


def reply_token_limit(
    documents: DataFrame,
    group: Sequence[str] = (),
    percentile: int = 90,
    scale: float = 1.5,
    minimum: int = 30,
    longest: int = 200,
) -> DataFrame:
    """Token limit from the length of own messages: the value at index floor(n*p/100).

    A message counts as `longest` characters at most, so a histogram of lengths stands for the sorted list.
    """
    own = F.col("is_sender") == 1
    histogram = documents.groupBy(*group, F.when(own, F.least(F.length("msg_content"), F.lit(longest))).alias("_len")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    known = F.when(F.col("_len").isNotNull(), F.col("_n"))
    # At most longest + 2 rows per group reach this window.
    per_group = W.partitionBy(*[F.col(g) for g in group]) if group else W.partitionBy(F.lit(0))
    up_to = per_group.orderBy(F.col("_len").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    ranked = histogram.select(
        *group,
        "_len",
        F.coalesce(F.sum(known).over(up_to), F.lit(0)).alias("_through"),
        F.coalesce(F.sum(known).over(per_group), F.lit(0)).alias("_total"),
    )
    index = F.least(F.floor(F.col("_total") * percentile / 100), F.col("_total") - 1)
    at_index = F.min(F.when(F.col("_through") > index, F.col("_len")))
    limit = F.greatest(F.lit(minimum), F.floor(at_index * scale).cast("int"))
    return ranked.groupBy(*group).agg(
        F.max("_total").alias("own_messages"),
        at_index.alias("length_at_percentile"),
        F.coalesce(F.when(at_index.isNotNull(), limit), F.lit(DEFAULT_REPLY_TOKENS)).alias("max_tokens"),
    )


def sender_sample(collection: DataFrame, order: Sequence[Column], sample: int = SENDER_SAMPLE) -> DataFrame:
    """Talkers among the first rows of a collection, and whether that left rows out."""
    head = collection.orderBy(*order).limit(sample).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.array_sort(F.collect_set("talker")).alias("unique_senders"),
    )
    total = collection.agg(F.count(F.lit(1)))
    return head.withColumn("total_records", total.scalar()).withColumn(
        "is_approximate", F.col("total_records") > F.col("sample_size")
    )


def sender_count(collection: DataFrame) -> DataFrame:
    """Exact number of records and talkers."""
    return collection.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_distinct("talker").alias("unique_senders")
    )


def collection_sizes(rows: DataFrame, name: str = "collection") -> DataFrame:
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("total_records"))


def result_source_counts(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("results"),
        F.count_if(F.col("result_source") == "semantic").alias("semantic"),
        F.count_if(F.col("result_source") == "temporal").alias("temporal"),
    )
