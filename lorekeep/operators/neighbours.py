"""Records close in time to a few anchors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TEMPORAL_WEIGHT = 0.5


def in_seconds(low: int, high: int) -> Column:
    """The range as a condition on stored seconds, which Parquet scans use to skip row groups."""
    return F.col("chat_time").between(low, high)


def in_time_range(
    records: DataFrame, start: int, end: int, limit: int, order: Sequence[Column], within: Callable[[int, int], Column] = in_seconds
) -> DataFrame:
    """Records with start <= chat_time <= end, the first `limit` in store order."""
    return records.where(within(start, end)).orderBy(*order).limit(limit)


def merged_windows(times: Sequence[int], window: int) -> list[tuple[int, int]]:
    """Overlapping [t-window, t+window] ranges joined into few disjoint ones."""
    ranges: list[tuple[int, int]] = []
    for t in sorted(times):
        low, high = t - window, t + window
        if ranges and low <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], high)
        else:
            ranges.append((low, high))
    return ranges


def time_neighbours(
    records: DataFrame,
    anchors: Sequence[tuple[int, int]],
    window_minutes: int = 30,
    per_anchor: int = 8,
    store_order: Sequence[str] = ("seq",),
    mode: str = "earliest",
    stored_first: int | None = None,
    within: Callable[[int, int], Column] = in_seconds,
) -> DataFrame:
    """Neighbours of each anchor: anchor_rank, neighbour_pos, proximity and the record.

    `anchors` are (rank, epoch seconds) of the selected hits, at most a few hundred;
    anchors without a positive time have no neighbours. Of all records in the window
    the n earliest are kept, or with mode="nearest" the n closest in time; with
    `stored_first` only so many first ones in store order are looked at.
    `within` is the condition on a range of seconds that the scan understands.
    """
    window = window_minutes * 60
    timed: dict[int, list[int]] = {}
    for rank, t in anchors:
        if window > 0 and t is not None and t > 0:
            timed.setdefault(int(t), []).append(int(rank))
    spark = records.sparkSession
    # Anchors of one time share their neighbours, so each time is probed once.
    # Window-sized buckets: a record in the window of an anchor lies in the
    # anchor's bucket or in one next to it.
    probes = spark.createDataFrame(
        [(ranks, t, t // window + step) for t, ranks in timed.items() for step in (-1, 0, 1)],
        "_ranks array<int>, anchor_time long, _bucket long",
    )
    # The same windows as ranges: they reach the scan and skip row groups.
    near_any = F.lit(False)
    for low, high in merged_windows(list(timed), window):
        near_any = near_any | within(low, high)
    close = (
        records.where(near_any)
        .withColumn("_bucket", F.floor(F.col("chat_time") / max(window, 1)))
        .join(F.broadcast(probes), "_bucket")
        .where(F.abs(F.col("chat_time") - F.col("anchor_time")) <= window)
        .drop("_bucket")
    )
    gap = F.abs(F.col("chat_time") - F.col("anchor_time"))
    by_anchor = W.partitionBy("anchor_time")
    if stored_first:
        close = _numbered(close, by_anchor.orderBy(*store_order), "_stored", stored_first)
    if mode == "nearest":
        close = _numbered(close, by_anchor.orderBy(gap, *store_order), "_near", per_anchor)
    elif mode != "earliest":
        raise ValueError(f"unknown mode {mode!r}")
    kept = _numbered(close, by_anchor.orderBy("chat_time", *store_order), "neighbour_pos", per_anchor)
    proximity = F.greatest(F.lit(0.0), F.lit(1.0) - gap / F.lit(float(max(window, 1))))
    ranked = kept.withColumn("proximity", proximity).withColumn("anchor_rank", F.explode("_ranks"))
    return ranked.drop("_near", "_stored", "_ranks")


def _numbered(df: DataFrame, window, name: str, n: int) -> DataFrame:
    """First n rows per window; the limit applies in each task before the shuffle."""
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
