"""Nearest vectors and diverse selection for one query vector."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import vectors as V
from lorekeep.functions.binding import let


# Upper bound of tasks in a search scan: each hands k rows to the one task that
# merges them, so that task sees at most SEARCH_TASKS * k small rows.
SEARCH_TASKS = 16384


def nearest(
    table: DataFrame,
    query: Sequence[float],
    k: int,
    metric: str = "cosine",
) -> DataFrame:
    """The k nearest rows of a table with id and embedding, as (id, distance, rank).

    Exact; only id and distance are sorted.

    Each task keeps its own k rows (TakeOrderedAndProject) before anything moves.
    """
    scored = table.where(F.col("embedding").isNotNull()).select(
        "id", V.distance_to(F.col("embedding"), query, metric).alias("distance")
    )
    best = scored.coalesce(SEARCH_TASKS).orderBy("distance", "id").limit(k)
    # k rows in one array: ranks without a second sort.
    ordered = best.agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("hits"))
    return ordered.select(F.posexplode("hits").alias("_pos", "hit")).select(
        F.col("hit.id").alias("id"), F.col("hit.distance").alias("distance"), (F.col("_pos") + 1).alias("rank")
    )


def by_id(table: DataFrame, ids: list) -> DataFrame:
    """Rows of a few ids. The ids reach the scan as an IN filter."""
    return table.where(F.col("id").isin(ids))


def candidates_for(
    table: DataFrame,
    query: Sequence[float],
    fetch_k: int,
    metric: str = "cosine",
    pick: Callable[[DataFrame, list], DataFrame] = by_id,
) -> DataFrame:
    """Vectors of the fetch_k nearest rows.

    The first pass ships ids and distances only. Its at most fetch_k ids come
    to the driver and go back to the scan, so that the second pass reads only
    the buckets and row groups that can hold them.
    """
    ids = [row.id for row in nearest(table, query, fetch_k, metric).collect()]
    return pick(table, ids).select("id", "embedding")


def diverse_selection(
    candidates: DataFrame, query: Sequence[float], k: int, lambda_mult: float = 0.6
) -> DataFrame:
    """Maximal marginal relevance for one query: (id, rank) of k candidates, as in diverse_selections."""
    target = V.unit_literal(query)
    scored = candidates.select("id", V.unit(F.col("embedding")).alias("vec")).select(
        "id", "vec", V.dot(F.col("vec"), target).alias("sim")
    )
    return diverse_selections(scored, k, lambda_mult)


def diverse_selections(scored: DataFrame, k: int, lambda_mult: float = 0.6, group: Sequence[str] = ()) -> DataFrame:
    """Maximal marginal relevance: group, id and rank of k candidates of each group.

    `scored` has id, vec (of length one) and sim, its similarity to the query. Each step takes the candidate with
    the highest lambda * similarity to the query - (1 - lambda) * highest similarity to a chosen one.
    Candidates are at most fetch_k rows a group, so one array holds them. Ties go to the
    more similar candidate, then to the smaller id.
    """
    pool = scored.groupBy(*group).agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("sim")).alias("far"), "id", "vec", "sim")), asc=True
        ).alias("pool")
    ).where(F.size("pool") > 0)

    unseen = F.lit(None).cast("double")
    first = F.struct(
        F.array().cast("array<int>").alias("chosen"),
        F.transform(F.col("pool"), lambda c: unseen).alias("near"),
    )

    def step(state: Column, _i: Column) -> Column:
        def gain(c: Column, i: Column) -> Column:
            redundancy = F.coalesce(F.get(state["near"], i), F.lit(0.0))
            value = F.lit(lambda_mult) * c["sim"] - F.lit(1.0 - lambda_mult) * redundancy
            open_ = ~F.array_contains(state["chosen"], i)
            # Before the first choice only the similarity counts, whatever lambda is.
            start = F.size(state["chosen"]) == 0
            return F.when(open_, F.struct(F.when(start, c["sim"]).otherwise(value).alias("v"), (-i).alias("i")))

        best = (-F.array_max(F.transform(F.col("pool"), gain))["i"]).cast("int")
        return let(best, lambda b: let(F.get(F.col("pool"), b)["vec"], lambda vec: F.struct(
            F.concat(state["chosen"], F.array(b)).alias("chosen"),
            F.zip_with(
                state["near"],
                F.col("pool"),
                lambda near, c: F.greatest(near, V.dot(c["vec"], vec)),
            ).alias("near"),
        )))

    steps = F.sequence(F.lit(1), F.least(F.lit(k), F.size("pool")))
    chosen = pool.select(
        *group,
        F.transform(
            F.aggregate(steps, first, step, lambda s: s["chosen"]), lambda i: F.get(F.col("pool"), i)["id"]
        ).alias("ids"),
    )
    return chosen.select(*group, F.posexplode("ids").alias("_pos", "id")).select(
        *group, "id", (F.col("_pos") + 1).alias("rank")
    )


def mmr(
    table: DataFrame,
    query: Sequence[float],
    k: int,
    fetch_k: int,
    lambda_mult: float = 0.6,
    metric: str = "cosine",
    pick: Callable[[DataFrame, list], DataFrame] = by_id,
) -> DataFrame:
    """Fetch fetch_k nearest rows, then select k of them for relevance and variety."""
    return diverse_selection(candidates_for(table, query, fetch_k, metric, pick), query, k, lambda_mult)
