"""Merging, ranking and formatting of search results. A result list has at most a few hundred rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.functions import context, text
from lorekeep.operators.neighbours import TEMPORAL_WEIGHT
from lorekeep.operators.ordering import first_rows

RESULT_CAP = 50
JUDGED_PASSAGES = 15


def merged_results(
    hits: DataFrame, near: DataFrame | None, max_results: int = RESULT_CAP, content_key_chars: int | None = None
) -> DataFrame:
    """Hits and their neighbours in one ranked list, without repeats.

    Order of arrival: each hit by rank, then its neighbours in time order. The
    first arrival of a content stays, with the score it arrived with; with
    content_key_chars, contents that start alike count as one. The list is then
    ordered by score; equal scores keep the order of arrival.
    """
    semantic = hits.withColumns(
        {
            "result_source": F.lit("semantic"),
            "score": F.lit(1.0),
            "_hit": F.col("rank"),
            "_pos": F.lit(0),
        }
    ).drop("rank")
    both = semantic
    if near is not None:
        temporal = near.withColumns(
            {
                "result_source": F.lit("temporal"),
                "score": F.col("proximity") * TEMPORAL_WEIGHT,
                "_hit": F.col("anchor_rank"),
                "_pos": F.col("neighbour_pos"),
            }
        ).drop("anchor_rank", "anchor_time", "neighbour_pos", "proximity")
        both = semantic.unionByName(temporal)
    unique = first_rows(
        both, [text.prefix(F.col("content"), content_key_chars)], [F.col("_hit"), F.col("_pos")]
    )
    order = [F.col("score").desc(), F.col("_hit"), F.col("_pos")]
    top = unique.orderBy(*order).limit(max_results)
    return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))).drop(
        "_hit", "_pos"
    )


def unique_passages(hits: DataFrame, max_results: int = 15) -> DataFrame:
    """Book hits without repeats of (file, page, text), in rank order, cut and ranked anew."""
    unique = first_rows(hits, ["source", "page", "content"], [F.col("rank")])
    top = unique.orderBy("rank").limit(max_results)
    return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("rank")))


def within_budget(results: DataFrame, line: Column, budget: int, group: Sequence[str] = ()) -> DataFrame:
    """Results in rank order up to the first one that overflows the budget, with their line."""
    per_list = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    used = F.sum(F.length("line")).over(per_list.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return results.withColumn("line", line).withColumn("_used", used).where(F.col("_used") <= budget).drop("_used")


def joined_lines(results: DataFrame, line: Column, separator: str = "\n", name: str = "context") -> DataFrame:
    """One row: the lines in rank order as one text, empty when there are none."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return results.agg(
        F.array_join(F.transform(ordered, lambda r: r["line"]), separator).alias(name),
        F.count(F.lit(1)).alias("lines"),
    )


def chat_context(results: DataFrame, budget: int = 2000, with_time: bool = True) -> DataFrame:
    line = context.chat_line(F.col("content"), F.col("chat_time_str"), F.col("chat_time"), with_time)
    return joined_lines(within_budget(results, line, budget), F.col("line"))


def book_context(results: DataFrame, budget: int = 4000) -> DataFrame:
    line = context.cited_passage(
        F.col("content"), F.col("chapter"), F.col("section"), F.col("page"), F.col("source")
    )
    return joined_lines(within_budget(results, line, budget), F.col("line"))


def numbered_passages(results: DataFrame, limit: int = JUDGED_PASSAGES) -> DataFrame:
    line = context.numbered_passage(F.col("rank"), F.col("content"))
    return joined_lines(results.where(F.col("rank") <= limit), line, name="passages")


def chapter_sources(results: DataFrame, chapters: int = 3, pages: int = 3) -> DataFrame:
    """Cited chapters in order of their first hit, with pages sorted as text."""
    cited = results.where(F.col("chapter") != "").groupBy("chapter").agg(
        F.min("rank").alias("_first"),
        F.min_by(F.coalesce("section", F.lit("")), "rank").alias("section"),
        F.min_by(F.coalesce("source", F.lit("")), "rank").alias("source"),
        F.array_sort(F.collect_set(F.when(F.col("page") != 0, F.col("page").cast("string")))).alias("_pages"),
    )
    more = F.when(F.size("_pages") > pages, F.lit("...")).otherwise(F.lit(""))
    shown = F.concat(F.array_join(F.slice("_pages", 1, pages), ", "), more)
    top = cited.withColumn("page", shown).orderBy("_first").limit(chapters)
    return top.select(
        F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_first")).alias("source_no"),
        "chapter",
        "section",
        "page",
        "source",
    )


def relevant_results(
    results: DataFrame, flags: DataFrame, group: Sequence[str] = (), judged: int | None = JUDGED_PASSAGES
) -> DataFrame:
    """Drop judged results flagged as irrelevant; no flag means relevant, later ranks stay unjudged. None judges all.

    `flags` has the group columns, rank and relevant, one row per rank.
    """
    joined = results.join(flags, [*group, "rank"], "left")
    keep = F.coalesce("relevant", F.lit(True))
    return joined.where((F.col("rank") > judged) | keep if judged else keep).drop("relevant")
