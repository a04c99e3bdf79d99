"""Chat and textbook search over a collection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators import results as R
from lorekeep.operators.neighbours import in_seconds, time_neighbours
from lorekeep.operators.similarity import by_id, mmr


@dataclass(frozen=True)
class ChatSearch:
    """Parameters of one chat search."""

    k: int = 15
    include_nearby: bool = True
    time_window_minutes: int = 30
    nearby_per_result: int = 8
    nearby_stored_first: int | None = None
    max_total_results: int = 50
    lambda_mult: float = 0.6
    metric: str = "l2"

    @property
    def fetch_k(self) -> int:
        return max(self.k * 4, 60)


@dataclass(frozen=True)
class BookSearch:
    """Parameters of one textbook search."""

    k: int = 8
    max_total_results: int = 15
    lambda_mult: float = 0.6
    metric: str = "cosine"

    @property
    def fetch_k(self) -> int:
        return max(self.k * 4, 40)


Pick = Callable[[DataFrame, list], DataFrame]


def _selected(vectors: DataFrame, query: Sequence[float], p: ChatSearch | BookSearch, pick: Pick) -> dict:
    """id -> rank of the selected rows: at most k entries."""
    chosen = mmr(vectors, query, p.k, p.fetch_k, p.lambda_mult, p.metric, pick)
    return {row.id: row.rank for row in chosen.collect()}


def _ranked(records: DataFrame, ranks: dict, pick: Pick) -> DataFrame:
    """The selected records with their rank."""
    spark = records.sparkSession
    id_type = records.schema["id"].dataType.simpleString()
    table = spark.createDataFrame(list(ranks.items()), f"id {id_type}, rank int")
    return pick(records, list(ranks)).join(F.broadcast(table), "id")


def chat_search(
    vectors: DataFrame,
    records: DataFrame,
    query: Sequence[float],
    params: ChatSearch = ChatSearch(),
    store_order: Sequence[str] = ("seq",),
    pick: Pick = by_id,
    within: Callable[[int, int], Column] = in_seconds,
) -> DataFrame:
    """Ranked results for a query vector: selected hits plus their neighbours in time.

    `vectors` has id and embedding; `records` has id, content, chat_time and any metadata.
    `pick` reads the rows of a few ids from either, `within` is the records' condition on a range of seconds.
    """
    ranks = _selected(vectors, query, params, pick)
    hits = _ranked(records, ranks, pick)
    near = None
    if params.include_nearby:
        times = [(r.rank, r.chat_time) for r in hits.select("rank", "chat_time").collect()]
        near = time_neighbours(
            records, times, params.time_window_minutes, params.nearby_per_result, store_order,
            stored_first=params.nearby_stored_first, within=within,
        )
    return R.merged_results(hits, near, params.max_total_results)


def book_search(
    vectors: DataFrame,
    chunks: DataFrame,
    query: Sequence[float],
    params: BookSearch = BookSearch(),
    pick: Pick = by_id,
) -> DataFrame:
    """Ranked passages for a query vector. `chunks` has id, content, source, page, chapter, section."""
    ranks = _selected(vectors, query, params, pick)
    return R.unique_passages(_ranked(chunks, ranks, pick), params.max_total_results)


def chain_context(
    vectors: DataFrame, records: DataFrame, query: Sequence[float], k: int = 20, fetch_k: int = 80, lambda_mult: float = 0.6
) -> DataFrame:
    """Context of the question-answering chain: selected records joined by a blank line."""
    chosen = mmr(vectors, query, k, fetch_k, lambda_mult, "l2")
    ranked = _ranked(records, {row.id: row.rank for row in chosen.collect()}, by_id)
    return R.joined_lines(ranked, F.col("content"), separator="\n\n")
