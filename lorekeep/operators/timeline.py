"""Neighbours in time for every record of a table.

A join on time windows makes as many pairs as a busy hour has records, squared. Here records are put in order
of time once, in ranges of equal size, and numbered. A window then is a place in this order: the number of
records before its start. Its n earliest records have the next n numbers, and a join on numbers finds them:
n rows for each record, however busy its hour is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorekeep.sources.collections import staged


def all_time_neighbours(
    records: DataFrame, window_minutes: int = 30, per_anchor: int = 8, store_order: Sequence[str] = ("seq",), ranges: int | None = None
) -> DataFrame:
    """anchor_id, neighbour_pos, id, chat_time, proximity: the `per_anchor` earliest records of each record's window.

    The window reaches `window_minutes` back and on, and holds the record itself. Equal times keep the store order.
    Records without a time above 0 are anchors of nothing, but a window that reaches below 0 may hold them; records with a
    NULL time take no part. `records` has id, chat_time and the columns of the store order, by which rows of one
    time must differ. An empty table gives an empty result. `ranges` sets the number of ranges.
    """
    window = window_minutes * 60
    order = ["chat_time", "is_record", *store_order]
    timed = records.where(F.col("chat_time").isNotNull())
    here = timed.select(F.col("id").alias("item"), "chat_time", F.lit(1).alias("is_record"), *store_order)
    # Where a window starts: before all records of that second.
    starts = timed.where(F.col("chat_time") > 0).select(
        F.col("id").alias("item"), (F.col("chat_time") - window).alias("chat_time"), F.lit(0).alias("is_record"), *store_order)
    both = here.unionByName(starts)
    ranged = both.repartitionByRange(ranges, *order) if ranges else both.repartitionByRange(*order)
    # Staged: the number of a range must stay what it was when rows were dealt out.
    placed = staged(ranged.withColumn("range", F.spark_partition_id()))
    sums = placed.groupBy("range").agg(F.sum("is_record").alias("records"))  # a row for each range
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("range", F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("before"))
    inside = F.sum("is_record").over(W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    numbered = staged(
        placed.withColumn("inside", inside).join(F.broadcast(before), "range")
        .select("item", "chat_time", "is_record", (F.col("inside") + F.col("before")).alias("no"))
    )
    wanted = numbered.where("is_record = 0").select(
        F.col("item").alias("anchor_id"), (F.col("chat_time") + window).alias("anchor_time"),
        F.posexplode(F.sequence(F.col("no") + 1, F.col("no") + per_anchor)).alias("step", "no"),
    )
    there = numbered.where("is_record = 1").select("no", F.col("item").alias("id"), "chat_time")
    gap = F.abs(F.col("chat_time") - F.col("anchor_time"))
    return wanted.join(there, "no").where(gap <= window).select(
        "anchor_id", (F.col("step") + 1).alias("neighbour_pos"), "id", "chat_time",
        F.greatest(F.lit(0.0), F.lit(1.0) - gap / F.lit(float(max(window, 1)))).alias("proximity"),
    )
