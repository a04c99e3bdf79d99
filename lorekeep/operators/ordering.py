"""Order-dependent steps that stay distributed inside a large group.

A window over a whole file or session puts that group in one task. These steps
take a `block` column as well: blocks of a group follow each other in order and
are of bounded size. Work inside a block is a window per block; what crosses
blocks is carried by one small row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key. Spark cuts each task to n rows per key before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def number_in_order(
    df: DataFrame,
    group: Sequence[str],
    block: str,
    order: Sequence[Column | str],
    out: str = "row_no",
    start: int = 1,
) -> DataFrame:
    """Consecutive numbers per group. Group and block columns must not be NULL."""
    keys = [*group, block]
    earlier = W.partitionBy(*group).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return (
        df.withColumn("_inside", inside)
        .join(offsets, keys)
        .withColumn(out, F.col("_inside") + F.col("_before") + F.lit(start - 1))
        .drop("_inside", "_before")
    )


def carry_forward(
    df: DataFrame,
    group: Sequence[str],
    block: str,
    order: str,
    events: dict[str, tuple[str, str]],
) -> DataFrame:
    """Latest non-NULL event up to each row.

    `events` maps an output column to (event column, value before the first event).
    """
    keys = [*group, block]
    ends = df.groupBy(*keys).agg(
        *[
            F.max_by(F.col(event), F.when(F.col(event).isNotNull(), F.col(order))).alias(f"_end_{out}")
            for out, (event, _) in events.items()
        ]
    )
    earlier = W.partitionBy(*group).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    incoming = ends.select(
        *keys,
        *[F.last(f"_end_{out}", ignorenulls=True).over(earlier).alias(f"_in_{out}") for out in events],
    )
    so_far = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    here = df.select(
        "*",
        *[F.last(event, ignorenulls=True).over(so_far).alias(f"_here_{out}") for out, (event, _) in events.items()],
    )
    joined = here.join(incoming, keys)
    for out, (_, initial) in events.items():
        joined = joined.withColumn(
            out, F.coalesce(F.col(f"_here_{out}"), F.col(f"_in_{out}"), F.lit(initial))
        )
    return joined.drop(*[f"{side}{out}" for out in events for side in ("_here_", "_in_")])
