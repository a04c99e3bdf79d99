"""Reading the pipeline's tables and asking about their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many rows of a few numbers each (some 30 MB), beyond it is shuffled.
BROADCAST_ROWS = 1_000_000

#: A word: what stands between the six separators.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if a count proves it small. `df` must be cheap to read twice (a staged table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores put before them until no column of `df` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame, *names: str) -> list[Column]:
    """Exactly these columns of `df`, so that further columns can't clash with the operator's own."""
    return [df[n] for n in names]
